"""Running values in two phases, lookups that follow from them, and exact percentiles."""

import random
import statistics
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import scan, selection


def table(spark, seed, n, keys):
    r = random.Random(seed)
    data = [(i, r.choice(keys), r.randrange(n // 2), Decimal(r.randrange(-500, 500)) / 100 if r.random() > 0.2 else None) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, k string, t long, x decimal(14,2)").repartition(3)


@pytest.mark.parametrize("keys", [["a"], ["a", "a", "a", "b", None], list("abcdefghijklmnopqrstuvwxyz"), None])
@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_scan_is_a_plain_window(spark, keys, ranges):
    data, df = table(spark, 5, 400, keys or ["a", "b"])
    by = ["k"] if keys else []
    got = scan.scan(df, by, [F.col("t"), F.col("id")], ranges, total=scan.total(F.col("x")), most=scan.largest(F.col("x")), last=scan.latest(F.col("x")), at=scan.position(), before=scan.previous(F.col("x")))
    groups = defaultdict(list)
    for row in sorted(data, key=lambda r: (r[2], r[0])):
        groups[row[1] if keys else 0].append(row)
    want = []
    for rows in groups.values():
        sofar = []
        for n, row in enumerate(rows, 1):
            sofar += [] if row[3] is None else [row[3]]
            want.append((row[0], sum(sofar) if sofar else None, max(sofar, default=None), sofar[-1] if sofar else None, n, rows[n - 2][3] if n > 1 else None))
    assert sorted(tuple(r) for r in got.select("id", "total", "most", "last", "at", "before").collect()) == sorted(want)


def test_columns_of_the_table_keep_their_values(spark):
    df = spark.createDataFrame([(i, 10 * i, 7, 8) for i in range(9)], "t long, _n long, _w_total long, _before_total long")
    got = scan.scan(df, [], [F.col("t")], 4, total=scan.total(F.col("_n"))).collect()
    assert sorted(tuple(r) for r in got) == [(i, 10 * i, 7, 8, 5 * i * (i + 1)) for i in range(9)]


def test_places_in_a_descending_order(spark):
    data, df = table(spark, 6, 300, ["a", "a", "b"])
    for r in scan.scan(df, ["k"], [F.desc_nulls_last("x")], 9, at=scan.place()).collect():
        better = sum(k == r.k and x is not None and (r.x is None or x > r.x) for _, k, _, x in data)
        assert r["at"] == 1 + better
    assert scan.scan(df.limit(0), ["k"], [F.col("x")], at=scan.place()).collect() == []


def test_one_key_with_all_rows_is_scanned_in_many_ranges(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    sizes = [r["count"] for r in scan.in_ranges(df, ["k"], [F.col("t")], 10).groupBy("_scan_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 4000
    assert scan.scan(df, ["k"], [F.col("t")], 10, s=scan.total(F.col("t"))).where("s <> t * (t + 1) / 2").count() == 0


@pytest.mark.parametrize("most", [1, 20, 4096])
def test_percentiles_are_exact(spark, most):
    r = random.Random(3)
    cases = {
        "distinct": [r.random() * 1e6 for _ in range(3000)],
        "ties": [float(r.choice([1, 2, 2, 2, 7])) for _ in range(2000)],
        "one value": [4.0] * 500,
        "hot": [5.0] * 900 + [r.random() * 10 for _ in range(900)],
        "few": [3.0, 1.0],
    }
    for name, values in cases.items():
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double")
        got = selection.percentiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], most)
        cuts = statistics.quantiles(values, n=20, method="inclusive")
        assert got == pytest.approx([min(values), cuts[4], cuts[9], cuts[17], max(values)], rel=1e-12), name
    assert selection.percentiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_percentiles_of_decimals_and_long_ranges(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("decimal(12,2)").alias("v"))
    assert selection.percentiles(df, "v", [0.5, 0.999], 10) == [24999.5, pytest.approx(0.999 * 49999)]


def test_no_task_holds_all_values(spark):
    """Of distinct values only, the rows that are read at the end are few; before that a task sends sketches."""
    seen = []
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("v"))
    collect = type(df).collect

    def watched(self):
        rows = collect(self)
        seen.append(len(rows))
        return rows

    type(df).collect = watched
    try:
        values = selection.values_at(df, "v", [0, 100_000, 199_999], 200_000, 500)
    finally:
        type(df).collect = collect
    every = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert values == {r: every[r] for r in (0, 100_000, 199_999)} and max(seen) <= 500
