"""Operator 8: quality rules that clean a text line by line and then judge how much is left.  Native expressions only.

Each non-blank line is held against four rules.  It ends in closing punctuation or holds the end of a sentence, in any of
several scripts.  It is no navigation: it has fewer than three bars between items, and fewer than a third of its words are
addresses.  It holds few symbols and little shouting.  It is no boilerplate: it holds none of the fixed phrases, and, up to
FURNITURE_CHARS characters, fewer than a quarter of its words are terms of site furniture.  A line that fails, or that equals an
earlier line, is removed.  A document is kept where the base rules pass and the lines left hold at least half of the characters.

Everything is computed within a row, so nothing is shuffled and no group can grow hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import load

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# Marks that close a sentence or a quotation, ends of sentences within a line, bars of navigation, parts of
# addresses, phrases and terms of site furniture.
CLOSING = [".", "!", "?", "…", '"', "”", "»", ")", "。", "！", "？", "」", "』", "）", "؟", "۔", "।", "॥", "။", "។", "።"]
SENTENCE_ENDS = [". ", "! ", "? ", "。", "！", "？", "؟ ", "। "]
BARS = [" | ", " · ", " • ", " › ", " » "]
ADDRESSES = ["://", "www."]
BOILERPLATE = ["lorem ipsum", "enable javascript", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "click here", "sign up for our newsletter"]
TERMS = [
    "cookie", "privacy", "newsletter", "subscribe", "copyright", "©", "login", "sitemap", "javascript", "datenschutz", "impressum", "anmelden", "abonnieren",
    "confidentialité", "connexion", "abonnez", "mentions légales", "privacidad", "suscríbete", "aviso legal", "iniciar sesión",
]
#: Longer lines are not held against the terms.
FURNITURE_CHARS = 80
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def _count(text: Column, part: str) -> Column:
    """Places of a fixed string in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def _sum(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts)


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def _line_passes(line: Column, flags: dict[str, Column]) -> Column:
    """The four rules for one trimmed line; the flags of the whole text spare most lines the slower ones."""
    words = _count(line, " ") + 1
    closed = F.substring(line, -1, 1).isin(CLOSING) | _any(line, SENTENCE_ENDS)
    navigation = flags["bar"] & ((_sum([_count(line, p) for p in BARS]) >= 3) | (_sum([_count(line, p) for p in ADDRESSES]) * 3 >= words))
    symbols = flags["symbol"] & (_symbols(line) * 10 > words)
    shouting = flags["shout"] & (_count(line, "!!") * 10 > words)
    # a line of many words is long, which is known at once, and furniture has few
    furniture = flags["phrase"] & _any(F.lower(line), BOILERPLATE) | (F.length(line) <= FURNITURE_CHARS) & (_sum([_count(F.lower(line), p) for p in TERMS]) * 4 >= words)
    return closed & ~navigation & ~symbols & ~shouting & ~furniture


def measure(documents: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, the base measures, `base_failed`, `kept` and `clean_text` of every document.

    Null and empty texts have no words and fail; a long text is measured like any other, as a whole; repeated rows give repeated rows; other columns are not read.  Windows of
    words are compared by 64-bit hashes.  Own columns start with an underscore until the end, so `keep` may hold any other name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*[F.col(c) for c in keep], text.alias("_text"))
    trimmed = F.btrim(F.col("_text"), F.lit(SPACES))
    rows = rows.select(
        "*",
        F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, WORD_GAP), lambda w: F.xxhash64(w))).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
        (F.length("_text") - F.length(F.translate("_text", SPACES, ""))).alias("_spaces"),
        _symbols(F.col("_text")).alias("n_symbols"),
    )
    h = F.col("_words")
    window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    rows = rows.select(
        "*",
        F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), window)).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
        F.array_distinct("_lines").alias("_distinct"),
    )
    # a text whose windows all differ, as most do, is spared the sort
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.select("*", F.when(repeats, placed).alias("_placed"))
    p = F.col("_placed")
    twice = F.filter(p, lambda x, i: (x["w"] == F.get(p, i - 1)["w"]) | (x["w"] == F.get(p, i + 1)["w"]))
    rows = rows.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_at"))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x
    )
    rows = rows.select("*", F.lower("_text").alias("_lower"))
    rows = rows.select("*", _any(F.col("_text"), BARS + ADDRESSES).alias("_bar"), F.contains("_text", F.lit("!!")).alias("_shout"), _any(F.col("_lower"), BOILERPLATE).alias("_phrase"))
    flags = {"symbol": F.col("n_symbols") > 0, "bar": F.col("_bar"), "shout": F.col("_shout"), "phrase": F.col("_phrase")}
    rows = rows.select(
        *keep,
        "_lines",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.col("_spaces")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size("_distinct")).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.filter("_distinct", lambda x: _line_passes(F.btrim(x, F.lit(SPACES)), flags)).alias("_clean"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.select("*", failed.alias("base_failed"), F.length(F.array_join("_lines", "")).alias("_all"), F.length(F.array_join("_clean", "")).alias("_left"))
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (2 * F.col("_left") >= F.col("_all"))).alias("kept"), F.array_join("_clean", "\n").alias("clean_text"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(load(spark, sf_dir, "documents"), ["doc_id"]).drop("clean_text")


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql_count(text: str, parts: list[str]) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, '{p}', ''))) // {len(p)}" for p in parts) + ")"


_SQL_ENDS = " OR ".join(f"contains(x, '{p}')" for p in SENTENCE_ENDS)
_SQL_BOILERPLATE = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
_SQL_X, _SQL_T = (f"translate({c}, '{SYMBOLS}', '')" for c in "xt")
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM dup) GROUP BY rid),
l AS (SELECT rid, line, min(k) AS k, count(*) AS c FROM (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM w) GROUP BY rid, line),
lx AS (SELECT rid, line, c, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS x FROM l),
ly AS (SELECT rid, line, c, x, length(x) - length(replace(x, ' ', '')) + 1 AS nw FROM lx),
lz AS (SELECT rid, length(line) AS n, c,
        (right(x, 1) IN ({_sql_list(CLOSING)}) OR {_SQL_ENDS})
        AND {_sql_count("x", BARS)} < 3 AND {_sql_count("x", ADDRESSES)} * 3 < nw
        AND (length(x) - length({_SQL_X})) * 10 <= nw
        AND (length(x) - length(replace(x, '!!', ''))) / 2 * 10 <= nw
        AND NOT ({_SQL_BOILERPLATE}) AND (length(x) > {FURNITURE_CHARS} OR {_sql_count("lower(x)", TERMS)} * 4 < nw) AS ok FROM ly),
j AS (SELECT rid, sum(n * c) AS all_chars, sum(CASE WHEN ok THEN n ELSE 0 END) AS left_chars, sum(c - 1) AS dups FROM lz GROUP BY rid),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
        length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length({_SQL_T}))::BIGINT AS n_symbols,
        coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        coalesce(all_chars, 0) AS all_chars, coalesce(left_chars, 0) AS left_chars
      FROM w LEFT JOIN cov USING (rid) LEFT JOIN j USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * left_chars >= all_chars AS kept
FROM b
"""
