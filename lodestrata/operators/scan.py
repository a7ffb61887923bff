"""Running values over ordered rows in two phases.

A window over a key puts all rows of the key in one task, and one without a key all rows there are.  Here rows are cut into ranges of
(key, order), so that a key with very many rows lies in many ranges.  Each range is scanned on its own; then the values at the end of
each range, one row a range, are carried over into the next one if the key goes on there, and are added to what the scan found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.work import work_table


@dataclass(frozen=True)
class Running:
    """A running value: `within` a range by a window over rows up to the current one; `edge`, what the range's last row hands on;
    `join`, an earlier state and a later one to one state; `whole`, the value within the range and the state before it to the value."""

    within: Callable
    edge: Callable[[str], Column]
    join: Callable
    whole: Callable[[Column, Column, Column], Column]


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _either(f: Callable) -> Callable:
    return lambda a, b: b if a is None else a if b is None else f(a, b)


def total(value: Column) -> Running:
    """The sum so far; nulls add nothing."""
    return Running(lambda w: F.sum(value).over(_so_far(w)), F.col, _either(lambda a, b: a + b), lambda here, before, goes_on: F.coalesce(here + before, here, before))


def largest(value: Column) -> Running:
    return Running(lambda w: F.max(value).over(_so_far(w)), F.col, _either(max), lambda here, before, goes_on: F.greatest(here, before))


def latest(value: Column) -> Running:
    """The last value so far that is not null."""
    return Running(lambda w: F.last(value, ignorenulls=True).over(_so_far(w)), F.col, _either(lambda a, b: b), lambda here, before, goes_on: F.coalesce(here, before))


def position() -> Running:
    """The row's number from 1 on."""
    return Running(lambda w: F.row_number().over(w).cast("long"), F.col, _either(lambda a, b: a + b), lambda here, before, goes_on: here + F.coalesce(before, F.lit(0)))


def place() -> Running:
    """The row's rank: rows that are equal in the order lie in one range."""
    return Running(lambda w: F.struct(F.rank().over(w).cast("long").alias("rank"), F.row_number().over(w).cast("long").alias("n")), lambda c: F.col(f"{c}.n"), _either(lambda a, b: a + b), lambda here, before, goes_on: here["rank"] + F.coalesce(before, F.lit(0)))


def previous(value: Column) -> Running:
    """The value of the row before, null or not."""
    w_value = lambda w: F.struct(F.lag(F.struct(value.alias("v"))).over(w).alias("before"), value.alias("own"))
    return Running(w_value, lambda c: F.struct(F.col(f"{c}.own").alias("v")), lambda a, b: b, lambda here, before, goes_on: F.when(here["before"].isNull() & goes_on, before["v"]).otherwise(here["before"]["v"]))


def in_ranges(df: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """Adds `_scan_range`, the number of the row's range of keys and order.  There are as many ranges as shuffle partitions, unless given."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_scan_range", F.spark_partition_id())


def borders(scanned: DataFrame, keys: list[str], state: dict[str, Column], join: Callable[[tuple, tuple], tuple]) -> DataFrame:
    """(_scan_range, keys, state as `_scan_before_` columns): what ranges before hand on to a range, for the key that goes on there.

    `scanned` has `_scan_range`, and `_scan_row`, the row's number within range and key.  `join` makes an earlier and a later state one; what it
    gets is one row for each range.
    """
    spark = scanned.sparkSession
    last = scanned.groupBy("_scan_range").agg(F.max_by(F.struct(*[F.col(k) for k in keys], *[c.alias(f"_scan_before_{s}") for s, c in state.items()]), F.struct(*[F.col(k) for k in keys], "_scan_row")).alias("s"))
    kind = last.schema["s"].dataType
    schema = T.StructType([T.StructField("_scan_range", T.IntegerType()), *[T.StructField(f.name, f.dataType) for f in kind.fields]])
    rows, at, held = [], None, None
    for r in sorted(last.collect(), key=lambda r: r["_scan_range"]):
        key, own = tuple(r["s"][: len(keys)]), tuple(r["s"][len(keys) :])
        if held is not None:
            rows.append((r["_scan_range"], *at, *held))
        held = join(held, own) if held is not None and key == at else own
        at = key
    return spark.createDataFrame(rows, schema)


def with_borders(scanned: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the `_scan_before_` columns and `_scan_goes_on`, true where the row's key began in a range before."""
    carried = carried.select(F.col("_scan_range").alias("_scan_r"), *[F.col(k).alias(f"_scan_k_{k}") for k in keys], *[c for c in carried.columns if c.startswith("_scan_before_")], F.lit(True).alias("_scan_goes_on"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_scan_k_{k}")) for k in keys], F.col("_scan_range") == F.col("_scan_r"))
    # a row for each range
    joined = scanned.join(F.broadcast(carried), on, "left").drop("_scan_r", *[f"_scan_k_{k}" for k in keys])
    return joined.withColumn("_scan_goes_on", F.coalesce("_scan_goes_on", F.lit(False)))


def scan(df: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None, **values: Running) -> DataFrame:
    """Adds running values over the rows of each key (without keys: of all rows) in an order.

    Null keys are a key.  Rows that are equal in keys and order stand in any order, but always together.
    """
    w = Window.partitionBy("_scan_range", *keys).orderBy(*order)
    scanned = in_ranges(df, keys, order, ranges).withColumns({"_scan_row": F.row_number().over(w), **{f"_scan_w_{name}": v.within(w) for name, v in values.items()}})
    scanned = work_table(scanned, "scanned")
    joins = [v.join for v in values.values()]
    carried = borders(scanned, keys, {name: v.edge(f"_scan_w_{name}") for name, v in values.items()}, lambda a, b: tuple(f(x, y) for f, x, y in zip(joins, a, b, strict=True)))
    whole = with_borders(scanned, carried, keys)
    kinds = {name: whole.schema[f"_scan_w_{name}"].dataType for name in values}
    out = {}
    for name, v in values.items():
        value = v.whole(F.col(f"_scan_w_{name}"), F.col(f"_scan_before_{name}"), F.col("_scan_goes_on"))
        out[name] = value if isinstance(kinds[name], T.StructType) else value.cast(kinds[name])
    return whole.select(*df.columns, *[c.alias(name) for name, c in out.items()])
