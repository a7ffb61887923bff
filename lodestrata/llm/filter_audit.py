"""Interaction audit of document filters: what each filter removes, in every order of the filters.

Each document becomes a mask of five bits, one for each filter that it fails.  Four bits follow from its text alone; the fifth says
that a document with a smaller id has the same text.  Counts of the 32 masks per part then hold all that any order of the filters
can tell: a filter removes the masks that hold its bit and none of the bits before it.

Masks are native expressions.  Equal texts are found by their SHA-256 and length.  Copies of one text are summed up by part and
label before and after the exchange, so that a text with very many copies costs a row for each part and label.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import load, materialize

FILTERS = "ABCDE"
#: All orders, by name.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COPY = 1 << FILTERS.index("E")


def with_mask(df: DataFrame, text: str) -> DataFrame:
    """Adds `mask`, the bits of the filters that read one text: few words (A), few distinct words (B), many capitals (C), symbols of
    markup (D).

    Texts are read twice: once to cut them at white space and once to leave capitals and symbols only.  Both are columns of
    their own, so that no expression repeats them.
    """
    columns = df.columns
    df = df.withColumn("_words", F.split(text, r"[ \t-\r]+")).withColumn("_marks", F.regexp_replace(text, r"[^A-Z#$%&*|]+", ""))
    # white space at an end leaves an empty word there
    first, last = F.col("_words")[0] == "", F.element_at("_words", -1) == ""
    ends = first.cast("int") + (last & (F.size("_words") > 1)).cast("int")
    df = df.select(
        *columns, (F.size("_words") - ends).alias("_n"), (F.size(F.array_distinct("_words")) - (first | last).cast("int")).alias("_distinct"),
        F.length(F.translate("_marks", "#$%&*|", "")).alias("_capitals"), F.length("_marks").alias("_n_marks"), F.length(text).alias("_size"),
    )
    fails = [F.col("_n") < 200, 100 * F.col("_distinct") < 50 * F.col("_n"), 100 * F.col("_capitals") > 2 * F.col("_size"), F.col("_n_marks") > F.col("_capitals")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))
    return df.select(*columns, mask.alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents with a mask, and how many of them have quality 1, toxic 1; masks without documents
    have no row.

    Null texts are empty, null sources the empty part.  A document that shares its text and its id with another has no smaller id
    than that one; null ids are no smaller than any, and no document is a copy of one.  A document is good or toxic if any
    row of its id in `labels` says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_text"))
    rows = with_mask(rows, "_text").select("doc_id", "part", "mask", F.unhex(F.sha2(F.col("_text"), 256)).alias("digest"), F.length("_text").alias("size"))
    # rows with one id are one row with a count: it tells how many rows hold a text's smallest id
    rows = rows.groupBy("doc_id", "part", "mask", "digest", "size").agg(F.count("*").alias("n"))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic")).where("quality = 1 or toxic = 1")
    rows = rows.join(known, "doc_id", "left").na.fill(0, ["quality", "toxic"])
    texts = rows.groupBy("digest", "size", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    texts = materialize(texts, "texts")
    firsts = texts.groupBy("digest", "size").agg(F.min("first.doc_id").alias("least"))
    texts = texts.join(firsts, ["digest", "size"])
    copies = F.col("with_id") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), copies.alias("n")))
    cells = texts.select("part", "quality", "toxic", F.inline(both)).where("n > 0")
    total = lambda what, name: F.sum(what).cast("long").alias(name)
    return cells.groupBy("part", "mask").agg(total("n", "docs"), total(F.col("n") * F.col("quality"), "good"), total(F.col("n") * F.col("toxic"), "toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: documents kept after it, removed by it, failing it but removed before, failing
    it alone, good and toxic ones among the removed, and its Shapley sum over all orders.

    Of null texts, sources and ids and of repeated rows see `mask_cells`; empty and very long texts are handled whole; an empty
    table gives no rows; columns besides those named are not read.
    """
    cells = mask_cells(docs, labels)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))  # 32 at most
    steps = len(FILTERS)
    rows = parts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) * steps - 1))))
    order = F.element_at(F.lit(ORDERS), (F.floor(F.col("_i") / steps) + 1).cast("int"))
    rows = rows.select("part", "cells", order.alias("filter_order"), (F.col("_i") % steps + 1).cast("int").alias("step"))
    bit = lambda name: F.lit(1 << FILTERS.index(name))
    place = lambda name: F.instr("filter_order", name)
    own, before = F.lit(0), F.lit(0)
    for name in FILTERS:
        own = own + F.when(place(name) == F.col("step"), bit(name)).otherwise(0)
        before = before + F.when(place(name) < F.col("step"), bit(name)).otherwise(0)
    rows = rows.withColumn("_own", own).withColumn("_before", before)

    def total(what, where) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + what(c))

    has = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    removed = lambda c: has(c, F.col("_own")) & ~has(c, F.col("_before"))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c["docs"], lambda c: ~has(c, F.col("_own").bitwiseOR(F.col("_before")))).alias("kept"),
        total(lambda c: c["docs"], removed).alias("removed"),
        total(lambda c: c["docs"], lambda c: has(c, F.col("_own")) & has(c, F.col("_before"))).alias("redundant"),
        total(lambda c: c["docs"], lambda c: c["mask"] == F.col("_own")).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        # a mask of k bits falls to each of its filters in one k-th of the orders
        total(lambda c: c["docs"] * F.floor(len(ORDERS) / F.bit_count(c["mask"])).cast("long"), lambda c: has(c, F.col("_own"))).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
w AS (SELECT d.doc_id, part, d.text, least, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS words FROM d JOIN firsts ON firsts.text = d.text),
f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS quality, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS docs, sum(coalesce(quality, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(filter_order) AS (SELECT x.v || y.v || z.v || u.v || t.v FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS x(v), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS y(v), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS z(v),
  (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS u(v), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t(v) WHERE len(list_distinct([x.v, y.v, z.v, u.v, t.v])) = 5),
-- the first failing filter of each mask in each order
p AS (SELECT part, filter_order, unnest([1, 2, 3, 4, 5]) AS step, docs, good, toxic, list_transform(string_split(filter_order, ''), lambda n: CASE n WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM m, o),
s AS (SELECT part, filter_order, step, docs, good, toxic, fails[step] AS here, list_bool_or(fails[1:step - 1]) IS TRUE AS before, list_sum(list_transform(fails, lambda x: x::INTEGER)) AS n_fails FROM p),
r AS (SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(docs) FILTER (NOT here AND NOT before), 0)::BIGINT AS kept, coalesce(sum(docs) FILTER (here AND NOT before), 0)::BIGINT AS removed,
  coalesce(sum(docs) FILTER (here AND before), 0)::BIGINT AS redundant, coalesce(sum(docs) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (here AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT before), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM r"""
