"""Lookups in versions with half-open validity [valid_from, valid_to), null valid_to meaning open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import scan
from lodestrata.operators.work import work_table


def with_valid_to(versions: DataFrame, key: str, start: str, end: str = "valid_to") -> DataFrame:
    """Each version ends where the key's next one starts."""
    return versions.withColumn(end, F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def covers(start: Column, end: Column, day: Column) -> Column:
    return (start <= day) & (end.isNull() | (day < end))


def as_of(facts: DataFrame, versions: DataFrame, key: str, day: str, value: str, start: str = "valid_from", end: str = "valid_to", forgiving: bool = False, out: str | None = None) -> DataFrame:
    """Adds `value` of the version of `key` that covers `day`.

    Strict: null where none does.  Forgiving: then the key's latest version, whatever the day.  Versions of a key must not
    overlap.  Facts and versions meet on the key, so the join stays an equi-join with a residual range.
    """
    out = out or value
    v = versions.select(F.col(key).alias("_k"), F.col(start).alias("_from"), F.col(end).alias("_to"), F.col(value).alias("_v"))
    if not forgiving:
        joined = facts.join(v, (F.col(key) == F.col("_k")) & covers(F.col("_from"), F.col("_to"), F.col(day)), "left")
        return joined.withColumn(out, F.col("_v")).drop("_k", "_from", "_to", "_v") if out not in facts.columns else joined.drop(out).withColumnRenamed("_v", out).drop("_k", "_from", "_to")
    # the fallback is a row per key, so the second join adds no rows
    latest = v.groupBy("_k").agg(F.max_by("_v", "_from").alias("_last"))
    joined = facts.join(v, (F.col(key) == F.col("_k")) & covers(F.col("_from"), F.col("_to"), F.col(day)), "left").drop("_k", "_from", "_to")
    joined = joined.join(latest, F.col(key) == F.col("_k"), "left")
    return joined.withColumn(out, F.coalesce("_v", "_last")).drop("_k", "_v", "_last")


def as_of_merge(facts: DataFrame, versions: DataFrame, key: str, day: str, value: str, start: str = "valid_from", end: str = "valid_to", forgiving: bool = False, out: str | None = None) -> DataFrame:
    """`as_of` without a join: facts and versions of a key stand on one time line, and a fact takes the version that began last.

    A join compares every fact of a key with every version of it.  This costs a sort, cut into ranges of key and time, so a key with
    half of all rows and thousands of versions is many tasks; for keys of few versions `as_of` moves less.
    """
    out = out or value
    moment = F.struct(F.col(start).alias("from"), F.col(end).alias("to"), F.col(value).alias("value"))
    # a version that covers nothing would hide the one before it
    real = versions.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    begun = real.select(F.col(key).alias("_k"), F.col(start).alias("_at"), F.lit(0).alias("_fact"), moment.alias("_version"))
    asked = facts.select(F.col(key).alias("_k"), F.col(day).alias("_at"), F.lit(1).alias("_fact"), F.struct(*facts.columns).alias("_row"))
    line = scan.scan(begun.unionByName(asked, allowMissingColumns=True), ["_k"], [F.col("_at"), F.col("_fact")], _open=scan.latest(F.col("_version")))
    found = F.when(F.col("_open.to").isNull() | (F.col("_at") < F.col("_open.to")), F.col("_open.value"))
    line = line.where("_fact = 1").withColumn("_found", found)
    if forgiving:
        latest = versions.groupBy(F.col(key).alias("_l")).agg(F.max_by(value, start).alias("_last"))  # a row a key
        line = line.join(latest, F.col("_k") == F.col("_l"), "left").withColumn("_found", F.coalesce("_found", "_last"))
    return line.select(*[F.col(f"_row.{c}").alias(c) for c in facts.columns if c != out], F.col("_found").alias(out))


def overlap_flag(key: str, start: str, end: str) -> Column:
    """True for a version that starts before an earlier-starting one of the same key ends, else false.

    A running maximum of the ends before, per key, finds them with one sort and no self-join.  Null keys and null starts
    overlap nothing.
    """
    day = F.col(start).cast("date")
    until = F.when(day.isNotNull(), F.coalesce(F.col(end).cast("date"), F.to_date(F.lit("9999-12-31"))))
    # frames by value leave out versions with the same start, which do not overlap each other here
    before = F.max(until).over(Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.col(key).isNotNull() & (day < before), F.lit(False))


def overlapping(versions: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Versions for which `overlap_flag` holds."""
    return versions.withColumn("_overlap", overlap_flag(key, start, end)).where("_overlap").drop("_overlap")


def level_series(spans: DataFrame, start: str, end: str, amount: Column, points: DataFrame, point: str) -> DataFrame:
    """(point, level): the sum of amounts of spans that cover each point, by running sum over starts and ends.

    A pure range join would compare every span with every point; here each span is two events on one time line.
    """
    events = spans.select(F.col(start).alias("_at"), amount.alias("_delta")).unionAll(spans.where(F.col(end).isNotNull()).select(F.col(end), -amount))
    daily = events.groupBy("_at").agg(F.sum("_delta").alias("_delta")).withColumn("_point", F.lit(0))
    marks = points.select(F.col(point).alias("_at"), F.lit(None).cast(daily.schema["_delta"].dataType).alias("_delta"), F.lit(1).alias("_point"))
    # events of the same instant come first: a span covers its start and not its end
    line = daily.unionByName(marks)
    line = scan.scan(line, [], [F.col("_at"), F.col("_point")], level=scan.total(F.col("_delta")))
    return line.where("_point = 1").select(F.col("_at").alias(point), F.coalesce("level", F.lit(0)).alias("level"))


def near_pairs(events: DataFrame, key: str, at: str, event_id: str, seconds: int, differ: str, later_where: Column | None = None, show: tuple[str, ...] = ()) -> DataFrame:
    """For each event (of those where `later_where` holds) the nearest earlier one of the same key, at most `seconds` before,
    whose `differ` is another: both ids, the whole minutes between, and the columns in `show` of both.  Nulls in key, time, id
    or `differ` pair with nothing.

    Nothing is paired: the last earlier event is the anchor if it differs, and otherwise the last event before the run of like events
    that it ends.  Keys are cut into ranges of time; the last event of a range and the one before its run are handed on to
    the next range, so that a key with very many events, in one hour or over years, is many sorts.
    """
    is_later = F.lit(True) if later_where is None else F.coalesce(later_where, F.lit(False))
    shown = F.struct(F.lit(0).alias("_none"), *show)
    base = events.select(F.col(key).alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_s"), F.col(event_id).alias("_id"), F.col(differ).alias("_d"), is_later.alias("_asks"), shown.alias("_x"))
    base = base.where("_key is not null and _s is not null and _id is not null and _d is not null")
    event = F.struct("_s", "_id", "_d", "_x")
    runs = Window.partitionBy("_scan_range", "_key").orderBy("_s", "_id")
    # events of one instant lie in one range
    placed = scan.in_ranges(base, ["_key"], [F.col("_s")]).withColumn("_before", F.lag(event).over(runs)).withColumn("_scan_row", F.row_number().over(runs))
    placed = placed.withColumn("_ended", F.when(F.col("_before._d") != F.col("_d"), F.col("_before")))
    placed = placed.withColumn("_other", F.last("_ended", ignorenulls=True).over(runs.rowsBetween(Window.unboundedPreceding, 0)))
    # strictly earlier: frames by value leave out events of the same instant
    earlier = Window.partitionBy("_scan_range", "_key").orderBy("_s").rangeBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_last", F.max_by(F.struct("_s", "_id", "_d", "_x", "_other"), F.struct("_s", "_id")).over(earlier))
    placed = work_table(placed.drop("_before", "_ended"), "events")

    def joined(before: tuple, own: tuple) -> tuple:
        (last, other), (own_last, own_other) = before, own
        return own_last, own_other or (last if last["_d"] != own_last["_d"] else other)

    carried = scan.borders(placed, ["_key"], {"last": event, "other": F.col("_other")}, joined)
    placed = scan.with_borders(placed.where("_asks"), carried, ["_key"])
    over_border = F.when(F.col("_scan_before_last._d") != F.col("_d"), F.col("_scan_before_last")).otherwise(F.col("_scan_before_other"))
    within = F.when(F.col("_last._d") != F.col("_d"), F.struct("_last._s", "_last._id", "_last._d", "_last._x")).otherwise(F.col("_last._other"))
    placed = placed.withColumn("_anchor", F.coalesce(within, over_border)).withColumn("_gap", F.col("_s") - F.col("_anchor._s")).where(F.col("_gap") <= seconds * 1_000_000)
    both = [c for name in show for c in (F.col(f"_x.{name}").alias(name), F.col(f"_anchor._x.{name}").alias(f"anchor_{name}"))]
    return placed.select(F.col("_id").alias(event_id), F.col("_key").alias(key), F.col("_anchor._id").alias("anchor_id"), F.floor(F.col("_gap") / 60_000_000).alias("minutes"), *both)
