"""Bucketed tables join without an exchange, and lookups skip row groups."""

import os

from pyspark.sql import functions as F

from lodestrata.operators import layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_clustered_tables_need_no_exchange(spark, tmp_path):
    facts = spark.range(4000).select((F.col("id") % 97).alias("k"), F.col("id").alias("x"))
    dims = spark.range(97).select(F.col("id").alias("k"), (F.col("id") % 5).alias("g"))
    a = layout.write(facts, f"file://{tmp_path}/facts", "k", 8)
    b = layout.write(dims, f"file://{tmp_path}/dims", "k", 8)
    joined = a.hint("merge").join(b, "k").groupBy("k").agg(F.sum("x").alias("s"), F.max("g").alias("g"))
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    want = facts.join(dims, "k").groupBy("k").agg(F.sum("x").alias("s"), F.max("g").alias("g"))
    assert sorted(joined.collect()) == sorted(want.collect())
    # the layout is found again in another session
    other = spark.newSession()
    again = layout.read(other, f"file://{tmp_path}/facts").hint("merge").join(layout.read(other, f"file://{tmp_path}/dims"), "k")
    assert "Exchange" not in plan(again) and again.count() == 4000
    assert all(f.endswith(".parquet") for f in os.listdir(tmp_path / "facts") if not f.startswith(("_", ".")))


def test_a_lookup_skips_row_groups(spark, tmp_path):
    """Ids in random order: only Bloom filters tell which row groups may hold one."""
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), (F.col("id") % 3).alias("k"))

    def scanned(df):
        df.collect()
        node = df._jdf.queryExecution().executedPlan()
        leaves = node.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    found = {}
    for name, ids in (("with", ("event_id",)), ("without", ())):
        t = layout.write(rows, f"file://{tmp_path}/{name}", "k", 2, ids, row_group=1 << 20)
        one = t.where(F.col("event_id") == F.sha2(F.lit("77"), 256))
        assert one.count() == 1
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found[name] = scanned(t.where(F.col("event_id") == F.sha2(F.lit("77"), 256)).select("k"))
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found["with"] < found["without"] / 2
