"""Snapshots, keys, de-duplication, spines and comparisons."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import differs
from lodestrata.operators import scan
from lodestrata.operators.work import work_table


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; Spark keeps one candidate per key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def surplus(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def distinct_where(df: DataFrame, by: list[str], member: list[str], **conditions: Column) -> DataFrame:
    """Per group, how many distinct members have a row for which each condition holds; members with a null do not count.

    Each member's rows become one with a flag for each condition, in the tasks that read them and then once more where they
    meet, so that several distinct counts cost one exchange of members and no copies of rows for each of them.
    """
    flags = {name: F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()}
    whole = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in member])
    return df.groupBy(*by, *member).agg(*flags.values()).groupBy(*by).agg(*[F.count_if(F.col(name) & whole).alias(name) for name in conditions])


def orphans(df: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return df.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], key_column: str, delete_missing: bool = False, never: int = -1, in_key_order: bool = False, top: int | None = None) -> DataFrame:
    """The next snapshot of a keyed table.

    Natural keys that exist keep their surrogate and take the source's values; new ones get surrogates above the largest; rows
    that the source lacks stay, or go if `delete_missing`, save the row at `never`.  `_action` tells insert, update, keep.
    New surrogates follow the order of buckets by the keys' hash, or with `in_key_order` that of the keys; many tasks number them.
    `top`: the largest surrogate, where `target` is a part of the table.
    """
    values = [c for c in source.columns if c not in keys]
    t = target.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(key_column).alias("_key"), *[F.col(v).alias(f"_t_{v}") for v in values])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    flagged = source.withColumn("_in", F.lit(True))
    joined = flagged.join(t, on, "full")
    largest = target.agg(F.coalesce(F.max(F.when(F.col(key_column) > 0, F.col(key_column))), F.lit(0)).alias("_top")) if top is None else target.sparkSession.range(1).select(F.lit(top).alias("_top"))
    # numbers are given to new keys only
    fresh = joined.where("_key is null")
    fresh = scan.scan(fresh, [], [F.asc_nulls_first(k) for k in keys], _number=scan.position()) if in_key_order else numbered(fresh, keys)
    fresh = fresh.crossJoin(F.broadcast(largest)).withColumn("_key", F.col("_top") + F.col("_number")).drop("_top", "_number").withColumn("_action", F.lit("insert"))
    known = joined.where("_key is not null")
    changed = differs({v: F.col(v) for v in values}, {v: F.col(f"_t_{v}") for v in values})
    known = known.withColumn("_action", F.when(F.col("_in").isNull(), "keep").when(changed, "update").otherwise("keep"))
    if delete_missing:
        known = known.where(F.col("_in") | (F.col("_key") == never))
    rows = known.unionByName(fresh)
    pick = lambda c: F.when(F.col("_in"), F.col(c)).otherwise(F.col(f"_t_{c}")).alias(c)
    return rows.select(F.col("_key").alias(key_column), *[pick(c) for c in [*keys, *values]], "_action")


def first_snapshot(source: DataFrame, keys: list[str], key_column: str, never: int, member: dict[str, Column]) -> DataFrame:
    """What `upsert` makes of a table that has only the member at `never`, without a join: rows are moved for their numbers alone.

    A source row with the member's natural key takes its place.
    """
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(member[k]) for k in keys])
    columns = lambda key: [key.cast("long").alias(key_column), *source.columns]
    fresh = numbered(source.where(~same), keys).select(*columns(F.col("_number")))
    own = source.where(same).select(*columns(F.lit(never)))
    spare = source.sparkSession.range(1).select(F.lit(never).cast("long").alias(key_column), *[value.alias(c) for c, value in member.items()])
    return fresh.unionByName(own).unionByName(spare.join(source.where(same).select(F.lit(never).cast("long").alias(key_column)), key_column, "left_anti"))


def numbered(df: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """`_number` from 1 without gaps, the same on every run: rows are numbered within buckets of their keys' hash, and buckets
    start where the ones before end.  Only the counts of `buckets` buckets meet in one task."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = df.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return df.withColumn("_within", within).join(F.broadcast(starts), "_bucket").withColumn("_number", F.col("_start") + F.col("_within")).drop("_bucket", "_within", "_start")


def rank_over(df: DataFrame, value: str, weight: str, out: str, ranges: int | None = None) -> DataFrame:
    """Adds `out`: one more than the `weight` of rows with a larger `value`; nulls come last.  Values are distinct."""
    summed = scan.scan(df, [], [F.desc_nulls_last(value)], ranges, **{out: scan.total(F.col(weight))})
    return summed.withColumn(out, F.col(out) - F.col(weight) + 1)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target and the source rows whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def month_spine(bounds: DataFrame, low: str, high: str) -> DataFrame:
    """(month_start, month_end) from the month of `low` to the month of `high` of a one-row frame."""
    months = bounds.select(F.explode(F.sequence(F.trunc(low, "MM"), F.trunc(high, "MM"), F.expr("interval 1 month"))).alias("month_start"))
    return months.withColumn("month_end", F.last_day("month_start"))


def compare(left: DataFrame, right: DataFrame, tolerance_digits: int = 2) -> DataFrame:
    """(side, row_count): rows of one side that the other lacks, as multisets of values rounded first; see `parity` for a tolerance."""

    def rounded(df: DataFrame) -> DataFrame:
        number = lambda kind: kind in ("double", "float") or kind.startswith("decimal")
        return df.select(*[F.round(F.col(c).cast("double"), tolerance_digits).alias(c) if number(kind) else F.col(c) for c, kind in df.dtypes])

    a, b = rounded(left), rounded(right.select(*left.columns))
    sides = [("left_only", a.exceptAll(b)), ("right_only", b.exceptAll(a)), ("both", a.intersectAll(b))]
    return reduce(DataFrame.unionAll, [df.agg(F.count("*").alias("row_count")).select(F.lit(side).alias("side"), "row_count") for side, df in sides])


@dataclass(frozen=True)
class Parity:
    """How two tables compare: columns that are not the same end the comparison; diffs are pairs of rows (None: no such row)."""

    same_columns: bool
    rows: tuple[int, int]
    differing: int = 0
    diffs: tuple[tuple[dict | None, dict | None], ...] = ()

    @property
    def ok(self) -> bool:
        return self.same_columns and self.rows[0] == self.rows[1] and not self.differing


def _fraction(kind: str) -> bool:
    return kind in ("double", "float") or kind.startswith("decimal")


def paired(left: DataFrame, right: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(left, right): pairs of rows that differ, as structs; numbers with a fraction may be `tolerance` apart, null is like null only.

    Rows that agree in all other columns are paired in the order of those numbers, nulls first.  Places in that order are given by
    a scan over ranges, so a table of such numbers alone is many tasks too.
    """
    numbers = [c for c, kind in left.dtypes if _fraction(kind)]
    exact = [c for c in left.columns if c not in numbers]

    def placed(df: DataFrame, side: str) -> DataFrame:
        rows = scan.scan(df, exact, [F.asc_nulls_first(c) for c in numbers] or [F.lit(0)], _place=scan.position())
        return rows.select(F.struct(*left.columns).alias(side), F.col("_place").alias(f"_{side}"))

    a, b = placed(left, "left"), placed(right, "right")
    on = [F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")) for c in exact] + [F.col("_left") == F.col("_right")]
    both = a.join(b, reduce(lambda x, y: x & y, on), "full")
    near = lambda x, y: x.eqNullSafe(y) | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= tolerance + 1e-12, F.lit(False))
    alike = reduce(lambda x, y: x & y, [near(F.col(f"left.{c}"), F.col(f"right.{c}")) for c in numbers], F.col("left").isNotNull() & F.col("right").isNotNull())
    return both.where(~alike).select("left", "right")


def unlike_ranges(left: DataFrame, right: DataFrame, ranges: int = 1024, within: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that lie in ranges where the tables differ at all; of equal tables none.

    Rows are dealt to ranges by the hash of the columns that must be equal, and a range is summed up by its count and two sums of
    row hashes, which the order of rows does not change.  Ranges that differ are cut again, and the finer ones that differ
    remain.  Rows stay where they are: only sums are exchanged, at most one for each range and task.
    """
    exact = [c for c, kind in left.dtypes if not _fraction(kind)]
    coarse = F.pmod(F.xxhash64(*exact, F.lit(1)), F.lit(ranges)).cast("int")
    fine = F.pmod(F.xxhash64(*exact, F.lit(2)), F.lit(within)).cast("int")
    # a null leaves a hash as it is, so where nulls are is hashed too
    row = lambda seed: F.xxhash64(F.array(*[F.col(c).isNull() for c in left.columns]), *left.columns, F.lit(seed)).cast("decimal(38,0)")

    def differing(a: DataFrame, b: DataFrame, cuts: dict[str, Column]) -> DataFrame:
        sums = lambda df, side: df.groupBy(*[c.alias(n) for n, c in cuts.items()]).agg(F.struct(F.count("*"), F.sum(row(3)), F.sum(row(4))).alias(side))
        return sums(a, "a").join(sums(b, "b"), list(cuts), "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*cuts)

    found = [r["_coarse"] for r in differing(left, right, {"_coarse": coarse}).collect()]  # `ranges` numbers at most
    a, b = (df.where(coarse.isin(found) if found else F.lit(False)) for df in (left, right))
    if not found:
        return a, b
    finer = work_table(differing(a, b, {"_coarse": coarse, "_fine": fine}), "unlike")
    keep = lambda df: df.withColumns({"_coarse": coarse, "_fine": fine}).join(finer, ["_coarse", "_fine"], "left_semi").select(*left.columns)
    return keep(a), keep(b)


def unlike(left: DataFrame, right: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """`paired` over the ranges where the tables differ."""
    return paired(*unlike_ranges(left, right), tolerance)


def parity(left: DataFrame, right: DataFrame, tolerance: float = 0.01, most: int = 8) -> Parity:
    """Compares two tables: columns with their order, row counts, and rows; at most `most` differing pairs are reported, the
    first in the order of the left row's columns, nulls first."""
    counts = (left.count(), right.count())
    if left.columns != right.columns:
        return Parity(False, counts)
    found = unlike(left, right, tolerance)
    order = [F.asc_nulls_first(F.coalesce(f"left.{c}", f"right.{c}")) for c in left.columns]
    shown = found.orderBy(*order).limit(most).collect()
    as_dict = lambda row: row.asDict() if row is not None else None
    return Parity(True, counts, found.count(), tuple((as_dict(r["left"]), as_dict(r["right"])) for r in shown))


def scorecard(seeded: DataFrame, detected: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Per rule: seeded, detected, matched, missed, false positives and recall of distinct keys."""
    s = seeded.select(*keys).distinct().withColumn("_s", F.lit(1))
    d = detected.select(*keys).distinct().withColumn("_d", F.lit(1))
    both = s.join(d, keys, "full")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    has_s, has_d = F.col("_s").isNotNull(), F.col("_d").isNotNull()
    out = both.groupBy(by).agg(count(has_s).alias("seeded"), count(has_d).alias("detected"), count(has_s & has_d).alias("matched"), count(has_s & ~has_d).alias("missed"), count(~has_s & has_d).alias("false_positives"))
    return out.withColumn("recall", F.col("matched") / F.nullif(F.col("seeded"), F.lit(0)))
