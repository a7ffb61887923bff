"""Constraints checked on a batch alone, against what earlier batches held.

The keys of earlier batches lie in folders by bucket of their hash, so a batch opens the buckets that its own keys are in.  Of versions
their spans lie there too: a version of the batch can only overlap versions of its own key.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class History:
    """`columns` of all batches so far, in buckets of `key`.

    A batch is added once, under a number; what a batch under the same or a larger number added is not earlier than it, so a batch
    that failed halfway is checked again as if for the first time.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: Iterable[str] = (), buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.columns = list(dict.fromkeys([*key, *columns]))

    def _bucket(self, key: list[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _folders(self) -> set[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        p = hadoop.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}

    def near(self, batch: DataFrame, number: int, key: list[str] | None = None) -> DataFrame:
        """Rows of earlier batches in the buckets that the batch's keys (in its columns `key`) are in; no other folder is opened."""
        asked = batch.select(self._bucket(key or self.key).alias("b")).distinct().collect()  # a row for each bucket at most
        there = sorted({r["b"] for r in asked} & self._folders())
        if not there:
            return self.spark.createDataFrame([], batch.select(*[F.col(a).alias(b) for a, b in zip(key or self.key, self.key, strict=True)], *[c for c in self.columns if c not in self.key]).schema)
        rows = self.spark.read.parquet(*[f"{self.path}/bucket={b}" for b in there])
        return rows.where(F.col("_batch") < number).select(*self.columns)

    def add(self, batch: DataFrame, number: int) -> None:
        rows = batch.select(*self.columns, F.lit(number).alias("_batch"), self._bucket(self.key).alias("bucket"))
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)


def _same(held: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, Column]:
    """Distinct held keys under other names, and the condition that they equal the batch's columns; nulls are equal to each other."""
    held = held.select(*[F.col(y).alias(f"_h_{y}") for _, y in pairs]).distinct()
    return held, reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(f"_h_{y}")) for x, y in pairs])


def repeated(batch: DataFrame, history: History, number: int) -> DataFrame:
    """Keys of the batch that are in it more than once or in an earlier batch, with the rows that it has of each."""
    counts = batch.groupBy(*history.key).agg(F.count("*").alias("copies"))
    held, same = _same(history.near(batch, number), [(k, k) for k in history.key])
    joined = counts.join(held.withColumn("_held", F.lit(True)), same, "left")
    return joined.where("copies > 1 or _held").select(*history.key, "copies")


def without_parent(batch: DataFrame, column: str, parents: History, number: int) -> DataFrame:
    """Values of a column, null left out, that no parent has; parents of the batch's own number count."""
    values = batch.select(column).where(F.col(column).isNotNull()).distinct()
    held, same = _same(parents.near(values, number + 1, [column]), [(column, parents.key[0])])
    return values.join(held, same, "left_anti")


def overlapping(batch: DataFrame, history: History, number: int, key: str, start: str, end: str) -> DataFrame:
    """Versions that overlap an earlier-starting one of their key because of the batch: its own, and earlier batches' that one of its
    versions now runs into.  Over all batches these are the versions that `temporal.overlapping` finds in the whole."""
    columns = [key, start, end]
    keys = batch.select(F.col(key).alias("_own")).distinct()
    earlier = history.near(batch, number).select(*columns).join(keys, F.col(key) == F.col("_own"), "left_semi")
    line = batch.select(*columns, F.lit(True).alias("_new")).unionByName(earlier.withColumn("_new", F.lit(False)))
    day = F.col(start).cast("date")
    until = F.when(day.isNotNull(), F.coalesce(F.col(end).cast("date"), F.to_date(F.lit("9999-12-31"))))
    # frames by value leave out versions with the same start
    before = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("_any", F.max(until).over(before)).withColumn("_old", F.max(F.when(~F.col("_new"), until)).over(before))
    hit = F.col(key).isNotNull() & (day < F.col("_any"))
    known = ~F.col("_new") & F.coalesce(day < F.col("_old"), F.lit(False))
    return line.where(hit & ~known).select(*columns)
