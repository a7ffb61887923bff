"""Operator 7: document fingerprints as invertible Bloom lookup sketches.  Native expressions only.

A text's paragraphs (its distinct non-empty lines; lines above LONG_LINE characters are cut after sentences) are digested to 64
bits.  Digests are dealt into parts by their lowest bits, about PART_DIGESTS to a part, and each goes into one cell of each of
three sub-tables of its part; a cell holds a count, the XOR of its digests and the XOR of their check values.  Cells of two
versions subtract, and peeling recovers the digests that differ: a cell with a count of one and a fitting check value names a
digest, which then leaves its other cells.  A part where peeling gets stuck is sketched again as four larger-in-all parts, by two
more bits and with other cells, until nothing is stuck; digests that differ are told apart by their 64 bits at the latest.

A fingerprint lists the cells of all parts of a text's own sketch, grown until each part peels.  So it can be inverted to the
text's digests, and the likeness of two texts follows from their two fingerprints and nothing else.  Cells are made by
aggregation over rows, so a text of very many lines costs in proportion to its lines.

The next document in id order is found through a range sort of the ids alone; texts are shuffled once, and once more the
prefixes that the edited texts need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import load, materialize

TABLES, CELLS = 3, 8
#: Digests that a part should hold, of both texts where two are compared.
PART_DIGESTS = 10
#: Rounds of peeling; a part that needs more counts as stuck and is made again.
ROUNDS = 24
#: A line above so many characters is cut after each sentence.
LONG_LINE = 1000
SENTENCE = r"(?<=[.!?\u2026\u061F\u0964]\s)|(?<=[\u3002\uFF01\uFF1F])"
#: What is sketched: a text alone, its edited text alone, and two differences: with the edited text and with the next document.
OWN, EDITED, NEAR_EDITED, NEAR_NEXT = range(4)
_CELL = "struct<i:int,n:bigint,k:bigint,c:bigint>"


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cell(key: Column, level: int, table: int) -> Column:
    """A digest's cell in a sub-table; every level has cells of its own."""
    return (F.xxhash64(key, F.lit(level * TABLES + table)).bitwiseAND(F.lit(CELLS - 1).cast("long")) + table * CELLS).cast("int")


def _part(key: Column, bits: Column) -> Column:
    mask = F.when(bits >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    return key.bitwiseAND(mask)


def _peeled(cells: Column, level: int) -> Column:
    """How many digests a part's cells hold; -1 where peeling gets stuck."""
    state = f"struct<cells:array<{_CELL}>,found:bigint,go:boolean>"
    start = F.struct(cells.alias("cells"), F.lit(0).cast("long").alias("found"), F.lit(True).alias("go")).cast(state)

    def round_(s: Column, _) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"])))
        named = F.array_distinct(F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["c"].alias("c"), *[_cell(c["k"], level, t).alias(f"i{t}") for t in range(TABLES)])))

        def without(found: Column) -> Column:
            def cell(c: Column) -> Column:
                mine = F.filter(found, lambda p: (c["i"] == p["i0"]) | (c["i"] == p["i1"]) | (c["i"] == p["i2"]))
                return F.aggregate(mine, c, lambda x, p: F.struct(x["i"].alias("i"), (x["n"] - p["n"]).alias("n"), x["k"].bitwiseXOR(p["k"]).alias("k"), x["c"].bitwiseXOR(p["c"]).alias("c")))

            left = F.filter(F.transform(s["cells"], cell), lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))
            return F.struct(left.alias("cells"), (s["found"] + F.size(found)).alias("found"), ((F.size(found) > 0) & (F.size(left) > 0)).alias("go")).cast(state)

        # let-binding: an array of one element, so that what is named is found once
        return F.when(~s["go"], s).otherwise(F.get(F.transform(F.array(named), without), 0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.when(F.size(s["cells"]) == 0, s["found"]).otherwise(F.lit(-1).cast("long")))


def _sets(rows: DataFrame, *which: int) -> DataFrame:
    """(_row, which, bits, signed): what is sketched of each row (_row, _a, _b, _c) and the bits that name its parts at first."""
    signed = lambda c, sign: F.transform(c, lambda k: F.struct(F.lit(sign).alias("s"), k.alias("k")))
    a, b = signed("_a", 1), signed("_b", 1)
    kinds = {OWN: a, EDITED: b, NEAR_EDITED: F.concat(a, signed("_b", -1)), NEAR_NEXT: F.concat(a, signed("_c", -1))}
    each = F.array(*[F.struct(F.lit(w).alias("which"), kinds[w].alias("signed")) for w in which])
    sets = rows.select("_row", F.explode(each).alias("x")).select("_row", "x.which", "x.signed")
    return sets.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.size("signed") / PART_DIGESTS))).cast("int"))


def _digest_rows(sets: DataFrame, level: int) -> DataFrame:
    """(_row, which, bits, part, s, k): a row per digest."""
    rows = sets.select("_row", "which", "bits", F.explode("signed").alias("x")).select("_row", "which", "bits", "x.s", "x.k")
    return rows.withColumn("part", _part(F.col("k"), F.col("bits") + 2 * level))


def _cells(digests: DataFrame, level: int) -> DataFrame:
    """(_row, which, bits, part, cells): the cells of each part that hold anything, in order."""
    hits = F.explode(F.array(*[_cell(F.col("k"), level, t) for t in range(TABLES)])).alias("i")
    hits = digests.select("_row", "which", "bits", "part", "s", "k", _check(F.col("k")).alias("c"), hits)
    made = hits.groupBy("_row", "which", "bits", "part", "i").agg(F.sum("s").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).where("n <> 0 or k <> 0 or c <> 0")
    return made.groupBy("_row", "which", "bits", "part").agg(F.array_sort(F.collect_list(F.struct("i", F.col("n").cast("long").alias("n"), "k", "c"))).alias("cells"))


def _settled(parts: DataFrame, level: int) -> DataFrame:
    """(_row, which, found, stuck): digests found in the parts of a set that peel, and the parts that do not."""
    peeled = parts.withColumn("found", _peeled(F.col("cells"), level))
    return peeled.groupBy("_row", "which", "bits").agg(F.sum(F.greatest("found", F.lit(0))).cast("long").alias("found"), F.collect_list(F.when(F.col("found") < 0, F.col("part"))).alias("stuck"))


def _cells_text(level, part: Column, cells: Column) -> Column:
    """A part as text: level, part and every cell's place, count, digest and check value, in hexadecimal."""
    cell = lambda c: F.concat_ws(",", c["i"].cast("string"), c["n"].cast("string"), F.lower(F.hex(c["k"])), F.lower(F.hex(c["c"])))
    return F.concat(F.lit(f"{level}."), F.lower(F.hex(part)), F.lit(":"), F.array_join(F.transform(cells, cell), ";"))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard similarity of two sets, from their sizes and the size of their difference; 1 where both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise((total - differing) / (total + differing)).cast("double")


def digests(text: Column) -> Column:
    """Digests of a text's paragraphs."""
    lines = F.split(text, "\n", -1)
    pieces = F.when(F.exists(lines, lambda x: F.length(x) > LONG_LINE), F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > LONG_LINE, F.split(x, SENTENCE, -1)).otherwise(F.array(x))))).otherwise(lines)
    return F.array_distinct(F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.xxhash64(x)))


def _followers(keyed: DataFrame) -> DataFrame:
    """(_k, _next, _half): each document's successor in id order and the length of its exchanged part."""
    light = keyed.select("_k", "doc_id", F.length("text").alias("n")).distinct()
    placed = light.repartitionByRange(F.asc_nulls_last("doc_id"), "_k").sortWithinPartitions(F.asc_nulls_last("doc_id"), "_k")
    # consecutive within a partition of the range sort, which is written before it is read again
    placed = materialize(placed.withColumn("_seq", F.monotonically_increasing_id()), "order")
    runs = placed.groupBy(F.shiftright("_seq", 33).alias("p")).agg(F.min("_seq").alias("low"), F.max("_seq").alias("high"))
    # one row per partition of the sort: few, whatever the input; the last run is followed by the first
    runs = materialize(runs, "runs")
    order = Window.orderBy("p")
    first = runs.agg(F.min("low").alias("start"))
    ends = runs.withColumn("after", F.lead("low").over(order)).crossJoin(F.broadcast(first)).select(F.col("high").alias("_seq"), F.coalesce("after", "start").alias("after"))
    step = placed.join(F.broadcast(ends), "_seq", "left").withColumn("after", F.coalesce("after", F.col("_seq") + 1))
    following = placed.select(F.col("_seq").alias("after"), F.col("_k").alias("_next"))
    return step.join(following, "after").select("_k", "_next", F.floor(F.col("n") / 2).cast("int").alias("_half"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row per row of `documents` (doc_id, text).

    Null texts are empty; an empty text has no paragraphs and its edited text is itself.  Rows equal in id and text are one
    document in the order and give equal rows; equal ids with different texts follow in the order of the texts' hashes; null
    ids come last.  A single document is followed by itself.  Very long texts are sketched whole, in more parts; an empty table gives no
    rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(text).cast("string")).alias("_k"), "doc_id", text.alias("text"))
    follow = materialize(_followers(keyed), "followers")
    wanted = follow.select(F.col("_next").alias("_k"), F.col("_k").alias("_before"), "_half")
    # the texts' exchange is the same in both joins, so Spark makes it once
    given = keyed.join(wanted, "_k").select("_before", F.col("doc_id").alias("next_id"), F.substring(F.col("text"), F.lit(1), F.col("_half")).alias("_prefix"), digests(F.col("text")).alias("_c"), "_half")
    # a document that is there twice offers its prefix twice
    given = given.dropDuplicates(["_before"])
    rows = keyed.join(given.withColumnRenamed("_before", "_k"), "_k")
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("_half")), F.col("_prefix"))
    rows = rows.select("doc_id", "next_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), digests(F.col("text")).alias("_a"), "_c")
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "next_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_a", digests(F.col("_edited")).alias("_b"), "_c")
    rows = materialize(rows, "digests")
    # digests are dealt by row once; whatever is made of them afterwards stays where it is
    placed = rows.select("_row", "_a", "_b", "_c").repartition("_row")
    level = 0
    settled = materialize(_settled(_cells(_digest_rows(_sets(placed, OWN, EDITED, NEAR_EDITED, NEAR_NEXT), level), level), level), "settled")
    results, finer = [settled], []
    while not (stuck := settled.where(F.size("stuck") > 0)).isEmpty():
        parts = stuck.select("_row", "which", F.explode("stuck").alias("part"))
        again = _sets(rows.join(stuck.select("_row").distinct(), "_row", "left_semi"), OWN, EDITED, NEAR_EDITED, NEAR_NEXT)
        again = _digest_rows(again, level).join(parts, ["_row", "which", "part"], "left_semi")
        level += 1
        made = materialize(_cells(again.withColumn("part", _part(F.col("k"), F.col("bits") + 2 * level)), level), "cells")
        settled = materialize(_settled(made, level), "settled")
        results.append(settled)
        still = settled.select("_row", "which", F.explode("stuck").alias("part"))
        texts = made.where(F.col("which").isin(OWN, EDITED)).join(still, ["_row", "which", "part"], "left_anti")
        finer.append(texts.select("_row", "which", F.lit(level).alias("level"), "part", _cells_text(level, F.col("part"), F.col("cells")).alias("text")))
    found = reduce(DataFrame.unionByName, [r.select("_row", "which", "found") for r in results])
    differing = lambda w: F.coalesce(F.sum(F.when(F.col("which") == w, F.col("found"))), F.lit(0)).alias(f"_d{w}")
    found = found.groupBy("_row").agg(differing(NEAR_EDITED), differing(NEAR_NEXT))
    # a fingerprint: the parts of the first level that peel, and those that took the place of the others
    listed = lambda w: F.collect_list(F.when(F.col("which") == w, F.col("p"))).alias(f"_p{w}")
    first = _cells(_digest_rows(_sets(placed, OWN, EDITED), 0), 0)
    first = first.select("_row", "which", F.struct(F.lit(0).alias("level"), "part", _cells_text(0, F.col("part"), F.col("cells")).alias("text")).alias("p"))
    first = first.groupBy("_row").agg(listed(OWN), listed(EDITED))
    if finer:
        more = reduce(DataFrame.unionByName, finer).select("_row", "which", F.struct("level", "part", "text").alias("p")).groupBy("_row").agg(listed(OWN), listed(EDITED))
        gone = lambda w: F.flatten(F.collect_list(F.when(F.col("which") == w, F.col("stuck")))).alias(f"_g{w}")
        gone = results[0].where(F.size("stuck") > 0).groupBy("_row").agg(gone(OWN), gone(EDITED))
        more = gone.join(more.select("_row", *[F.col(f"_p{w}").alias(f"_m{w}") for w in (OWN, EDITED)]), "_row")
        kept = lambda w: F.filter(f"_p{w}", lambda p: ~F.array_contains(f"_g{w}", p["part"]))
        whole = lambda w: F.when(F.col(f"_g{w}").isNull(), F.col(f"_p{w}")).otherwise(F.concat(kept(w), f"_m{w}")).alias(f"_p{w}")
        first = first.join(more, "_row", "left").select("_row", whole(OWN), whole(EDITED))
    text = lambda w, size: F.concat_ws("|", size.cast("string"), F.transform(F.array_sort(f"_p{w}"), lambda p: p["text"]))
    zero = lambda w: F.coalesce(f"_d{w}", F.lit(0))
    # an empty text has no cells
    return rows.join(first, "_row", "left").join(found, "_row", "left").select(
        "doc_id", "n_chars", "edited_sha256", text(OWN, F.size("_a")).alias("fingerprint"), text(EDITED, F.size("_b")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b"), zero(NEAR_EDITED)).alias("near_edited"), likeness(F.col("_a"), F.col("_c"), zero(NEAR_NEXT)).alias("near_next"),
        "next_id",
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))
