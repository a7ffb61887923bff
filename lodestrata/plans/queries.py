"""The engine's operators as queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import date_key, fiscal_period, fiscal_quarter, iso_day, ratio
from lodestrata.operators import constraints, governance, layout, merge, scan, selection, tables, temporal
from lodestrata.operators.work import shared_folder, work_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _money(column) -> F.Column:
    return F.col(column).cast("decimal(14,2)")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer: each lasts until the customer's next order."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("valid_from"), F.col("o_orderpriority").alias("dept"), _money("o_totalprice").alias("amount"))
    return temporal.with_valid_to(tables.dedup(o, ["o_custkey", "valid_from"], [F.col("o_orderkey").asc()]), "o_custkey", "valid_from")


_V = """WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS valid_from, o_orderpriority AS dept, o_totalprice::DECIMAL(14,2) AS amount FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) = 1),
v AS (SELECT *, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS valid_to FROM d)"""


@query(f"""{_V}, m AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(valid_from) FROM v)), date_trunc('month', (SELECT max(valid_from) FROM v)), INTERVAL 1 MONTH))::DATE AS month_start),
h AS (SELECT dept, month_start, count(*) AS headcount FROM m JOIN v ON valid_from <= last_day(month_start) AND (valid_to IS NULL OR last_day(month_start) < valid_to) GROUP BY ALL)
SELECT dept, month_start, headcount, headcount - lag(headcount) OVER w AS change, round(avg(headcount) OVER (PARTITION BY dept ORDER BY month_start ROWS 2 PRECEDING), 1) AS avg3 FROM h WINDOW w AS (PARTITION BY dept ORDER BY month_start)""")
def headcount_trend(spark, sf_dir):
    v = _versions(spark, sf_dir)
    spine = tables.month_spine(v.agg(F.min("valid_from").alias("a"), F.max("valid_from").alias("b")), "a", "b")
    # months since the first are few and known from a version's own dates, so versions are exploded, not joined by range
    last = v.agg(F.max("valid_from").alias("b"))
    covered = v.crossJoin(F.broadcast(last)).withColumn("until", F.coalesce(F.date_sub("valid_to", 1), F.last_day("b")))
    months = covered.withColumn("month_start", F.explode(F.sequence(F.trunc("valid_from", "MM"), F.trunc("until", "MM"), F.expr("interval 1 month"))))
    h = months.where(F.last_day("month_start").between(F.col("valid_from"), F.col("until"))).groupBy("dept", "month_start").agg(F.count("*").alias("headcount"))
    h = h.join(F.broadcast(spine.select("month_start")), "month_start", "left_semi")
    w = Window.partitionBy("dept").orderBy("month_start")
    return h.select("dept", "month_start", "headcount", (F.col("headcount") - F.lag("headcount").over(w)).alias("change"), F.round(F.avg("headcount").over(w.rowsBetween(-2, 0)), 1).alias("avg3"))


@query(f"""{_V}, b AS (SELECT max(valid_from) AS d1, (max(valid_from) - INTERVAL 12 MONTH)::DATE AS d0 FROM v),
s AS (SELECT dept, count(DISTINCT o_custkey) AS n FROM v, b WHERE valid_from <= d0 AND (valid_to IS NULL OR d0 < valid_to) GROUP BY dept),
e AS (SELECT dept, count(DISTINCT o_custkey) AS n FROM v, b WHERE valid_from <= d1 AND (valid_to IS NULL OR d1 < valid_to) GROUP BY dept),
l AS (SELECT dept, count(DISTINCT o_custkey) AS n FROM v, b WHERE valid_to BETWEEN d0 AND d1 GROUP BY dept),
a AS (SELECT coalesce(s.dept, e.dept) AS dept, (coalesce(s.n, 0) + coalesce(e.n, 0)) / 2.0 AS avg_n FROM s FULL JOIN e ON s.dept = e.dept),
r AS (SELECT a.dept, coalesce(l.n, 0) AS leavers, avg_n, 100.0 * coalesce(l.n, 0) / nullif(avg_n, 0) AS rate FROM a LEFT JOIN l ON a.dept = l.dept)
SELECT dept, leavers, avg_n::DOUBLE AS avg_n, round(rate::DOUBLE, 1) AS rate_pct, rank() OVER (ORDER BY rate DESC NULLS LAST) AS rate_rank FROM r""")
def attrition(spark, sf_dir):
    v = _versions(spark, sf_dir)
    bounds = F.broadcast(v.agg(F.max("valid_from").alias("d1")).withColumn("d0", F.add_months("d1", -12)))
    v = v.crossJoin(bounds)
    on = lambda d: temporal.covers(F.col("valid_from"), F.col("valid_to"), F.col(d))
    # one pass instead of three aggregates and a full join: departments absent at both dates drop out
    a = tables.distinct_where(v, ["dept"], ["o_custkey"], s=on("d0"), e=on("d1"), leavers=F.col("valid_to").between(F.col("d0"), F.col("d1"))).where("s + e > 0")
    a = a.withColumn("avg_n", (F.col("s") + F.col("e")) / 2.0).withColumn("rate", ratio(100.0 * F.col("leavers"), F.col("avg_n")))
    return a.select("dept", "leavers", "avg_n", F.round("rate", 1).alias("rate_pct"), F.rank().over(Window.orderBy(F.desc_nulls_last("rate"))).cast("long").alias("rate_rank"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice::DECIMAL(14,2) AS amount FROM orders WHERE o_orderstatus NOT LIKE 'F%'),
t AS (SELECT o_custkey, sum(amount) AS total FROM o GROUP BY o_custkey)
SELECT o.o_custkey, c_name, o_orderkey, sum(amount) OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS running, total::DOUBLE AS total, rank() OVER (ORDER BY total DESC) AS pipeline_rank
FROM o JOIN t USING (o_custkey) JOIN customer ON c_custkey = o.o_custkey""")
def sales_pipeline(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").where(~F.col("o_orderstatus").like("F%")).withColumn("amount", _money("o_totalprice"))
    o = scan.scan(o.select("o_custkey", "o_orderkey", "o_orderdate", "amount"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], running=scan.total(F.col("amount")))
    o = o.join(o.groupBy("o_custkey").agg(F.sum("amount").alias("total")), "o_custkey")
    # a rank over rows equals one plus the rows with a larger total: totals are few beside rows, so only they are ranked
    ranks = tables.rank_over(o.groupBy("total").agg(F.count("*").alias("n")), "total", "n", "pipeline_rank").drop("n")
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return o.join(ranks, "total").join(c, "o_custkey").select("o_custkey", "c_name", "o_orderkey", F.col("running").cast("double").alias("running"), F.col("total").cast("double").alias("total"), "pipeline_rank")


@query(f"""{_V}, m AS (SELECT DISTINCT last_day(valid_from) AS month_end FROM v),
a AS (SELECT month_end, sum(amount) AS arr FROM m JOIN v ON valid_from <= month_end AND (valid_to IS NULL OR valid_to > month_end) GROUP BY month_end),
n AS (SELECT month_end, arr, arr - lag(arr) OVER (ORDER BY month_end) AS net FROM a)
SELECT month_end, arr::DOUBLE AS arr, net::DOUBLE AS net, round((100 * net::DOUBLE / nullif(arr - net, 0)::DOUBLE), 1) AS growth_pct, sum(coalesce(net, arr)) OVER (ORDER BY month_end ROWS UNBOUNDED PRECEDING)::DOUBLE AS cumulative FROM n""")
def revenue_trend(spark, sf_dir):
    v = _versions(spark, sf_dir)
    # per month first: the time line then has a row or two per month, not one per version
    points = v.select(F.last_day("valid_from").alias("month_end")).distinct()
    level = temporal.level_series(v, "valid_from", "valid_to", F.col("amount"), points, "month_end").withColumnRenamed("level", "arr")
    w = Window.orderBy("month_end")
    n = level.withColumn("net", F.col("arr") - F.lag("arr").over(w))
    growth = F.round(100 * F.col("net").cast("double") / F.nullif(F.col("arr") - F.col("net"), F.lit(0)).cast("double"), 1)
    total = F.sum(F.coalesce("net", "arr")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.select("month_end", F.col("arr").cast("double").alias("arr"), F.col("net").cast("double").alias("net"), growth.alias("growth_pct"), total.cast("double").alias("cumulative"))


@query("""WITH d AS (SELECT ts::DATE AS day, event_type, sum(value::DECIMAL(14,2)) AS total, count(*) AS n FROM events GROUP BY ALL)
SELECT day, event_type, total::DOUBLE AS total, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING), 3) AS avg7, n - lag(n, 7) OVER (PARTITION BY event_type ORDER BY day) AS change7 FROM d""")
def usage_trend(spark, sf_dir):
    d = _read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.sum(_money("value")).cast("double").alias("total"), F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    return d.select("day", "event_type", "total", "n", F.round(F.avg("n").over(w.rowsBetween(-6, 0)), 3).alias("avg7"), (F.col("n") - F.lag("n", 7).over(w)).alias("change7"))


@query("""WITH c AS (SELECT 'FY' || strftime(o_orderdate, '%Y') || '-M' || strftime(o_orderdate, '%m') AS period, o_orderpriority AS dept, sum(o_totalprice::DECIMAL(14,2)) AS cost, count(*) AS n FROM orders GROUP BY ALL)
SELECT period, dept, n, cost::DOUBLE AS cost, round(100.0 * cost::DOUBLE / (sum(cost) OVER (PARTITION BY period))::DOUBLE, 1) AS pct, rank() OVER (PARTITION BY period ORDER BY cost DESC) AS cost_rank FROM c""")
def cost_share(spark, sf_dir):
    c = _read(spark, sf_dir, "orders").groupBy(fiscal_period(F.col("o_orderdate")).alias("period"), F.col("o_orderpriority").alias("dept")).agg(F.sum(_money("o_totalprice")).alias("cost"), F.count("*").alias("n"))
    p = Window.partitionBy("period")
    return c.select("period", "dept", "n", F.col("cost").cast("double").alias("cost"), F.round(100.0 * F.col("cost").cast("double") / F.sum("cost").over(p).cast("double"), 1).alias("pct"), F.rank().over(p.orderBy(F.desc("cost"))).cast("long").alias("cost_rank"))


@query("""WITH b AS (SELECT o_orderpriority AS dept, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(14,2)) AS budget FROM orders GROUP BY ALL),
a AS (SELECT o_orderpriority AS dept, year(o_orderdate) AS y, sum(l_extendedprice::DECIMAL(14,2)) AS actual FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY ALL),
j AS (SELECT b.dept, b.y, budget, coalesce(actual, 0) AS actual, coalesce(actual, 0) - budget AS variance FROM b LEFT JOIN a ON a.dept = b.dept AND a.y = b.y)
SELECT dept, y, budget::DOUBLE AS budget, actual::DOUBLE AS actual, variance::DOUBLE AS variance, round(100.0 * variance::DOUBLE / nullif(budget, 0)::DOUBLE, 1) AS variance_pct,
  sum(variance) OVER (PARTITION BY dept ORDER BY y ROWS UNBOUNDED PRECEDING)::DOUBLE AS running, round(percent_rank() OVER (PARTITION BY y ORDER BY variance), 3) AS percentile FROM j""")
def budget_variance(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("dept"), F.year("o_orderdate").cast("long").alias("y"), _money("o_totalprice").alias("p"))
    b = o.groupBy("dept", "y").agg(F.sum("p").alias("budget"))
    l = _read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"), _money("l_extendedprice").alias("e"))
    a = l.join(o, "o_orderkey").groupBy("dept", "y").agg(F.sum("e").alias("actual"))
    j = b.join(a, ["dept", "y"], "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("variance", F.col("actual") - F.col("budget"))
    d = Window.partitionBy("dept").orderBy("y")
    pct = F.round(100.0 * F.col("variance").cast("double") / F.nullif(F.col("budget"), F.lit(0)).cast("double"), 1)
    return j.select("dept", "y", *[F.col(c).cast("double").alias(c) for c in ("budget", "actual", "variance")], pct.alias("variance_pct"), F.sum("variance").over(d.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"), F.round(F.percent_rank().over(Window.partitionBy("y").orderBy("variance")), 3).alias("percentile"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(14,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join(spark, sf_dir):
    dims = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _read(spark, sf_dir, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    return _read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(_money("o_totalprice")).cast("double").alias("total"))


@query("""SELECT o_orderkey, o_custkey, count(*) AS items, sum(l_quantity::DECIMAL(14,2))::DOUBLE AS quantity, max(l_shipdate) AS last_ship FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def clustered_join(spark, sf_dir):
    # laid out once, joined and grouped by the same key without an exchange
    folder, n = f"{shared_folder(spark)}/lodestrata/clustered-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = layout.write(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), f"{folder}/orders", "o_orderkey", n)
    l = layout.write(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_shipdate"), f"{folder}/lineitem", "o_orderkey", n)
    joined = o.hint("merge").join(l, "o_orderkey").groupBy("o_orderkey", "o_custkey")
    return joined.agg(F.count("*").alias("items"), F.sum(_money("l_quantity")).cast("double").alias("quantity"), F.max("l_shipdate").alias("last_ship"))


_FACTS = "f AS (SELECT l_orderkey, l_linenumber, o_custkey, (l_shipdate + INTERVAL 400 DAY - INTERVAL 600 DAY * (l_linenumber % 2))::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _facts(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    day = F.date_add(F.col("l_shipdate").cast("date"), (400 - 600 * F.pmod("l_linenumber", F.lit(2))).cast("int"))
    return _read(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey", day.alias("day"))


@query(f"""{_V}, {_FACTS} SELECT l_orderkey, l_linenumber, day, v.o_orderkey AS version FROM f LEFT JOIN v ON v.o_custkey = f.o_custkey AND valid_from <= day AND (valid_to IS NULL OR day < valid_to)""")
def as_of_strict(spark, sf_dir):
    return temporal.as_of_merge(_facts(spark, sf_dir), _versions(spark, sf_dir), "o_custkey", "day", "o_orderkey", out="version").drop("o_custkey")


@query(f"""{_V}, {_FACTS}, last AS (SELECT o_custkey, max_by(o_orderkey, valid_from) AS k FROM v GROUP BY o_custkey)
SELECT l_orderkey, l_linenumber, day, coalesce(v.o_orderkey, last.k) AS version FROM f LEFT JOIN v ON v.o_custkey = f.o_custkey AND valid_from <= day AND (valid_to IS NULL OR day < valid_to) LEFT JOIN last ON last.o_custkey = f.o_custkey""")
def as_of_forgiving(spark, sf_dir):
    return temporal.as_of_merge(_facts(spark, sf_dir), _versions(spark, sf_dir), "o_custkey", "day", "o_orderkey", forgiving=True, out="version").drop("o_custkey")


@query("""WITH s AS (SELECT event_id, user_id, ts::DATE AS a, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts::DATE + (event_id % 3)::INTEGER END AS b FROM events)
SELECT DISTINCT l.event_id, l.user_id FROM s l JOIN s e ON l.user_id = e.user_id AND e.a < l.a AND (e.b IS NULL OR l.a < e.b)""")
def span_overlap(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("a", F.col("ts").cast("date"))
    e = e.withColumn("b", F.when(F.col("event_id") % 11 != 0, F.date_add("a", (F.col("event_id") % 3).cast("int"))))
    return temporal.overlapping(e, "user_id", "a", "b").select("event_id", "user_id")


@query("""WITH s AS (SELECT event_id, user_id, ts::DATE AS a, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts::DATE + (event_id % 3)::INTEGER END AS b FROM events)
SELECT user_id, a, b, count(*) AS n FROM (SELECT DISTINCT l.* FROM s l JOIN s e ON l.user_id = e.user_id AND e.a < l.a AND (e.b IS NULL OR l.a < e.b)) GROUP BY ALL""")
def batch_overlaps(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("a", F.col("ts").cast("date"))
    e = e.select("event_id", "user_id", "a", F.when(F.col("event_id") % 11 != 0, F.date_add("a", (F.col("event_id") % 3).cast("int"))).alias("b"))
    held = constraints.History(spark, f"{shared_folder(spark)}/lodestrata/spans-{uuid.uuid4().hex}", ["user_id"], ["a", "b"], 16)
    found = []
    # the events in three batches, each checked against those before it
    for n in range(3):
        batch = e.where(F.col("event_id") % 3 == n).select("user_id", "a", "b")
        found.append(work_table(constraints.overlapping(batch, held, n, "user_id", "a", "b"), "overlaps"))
        held.add(batch, n)
    return reduce(DataFrame.unionByName, found).groupBy("user_id", "a", "b").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT e.event_id, e.user_id, a.event_id AS anchor_id, row_number() OVER (PARTITION BY e.event_id ORDER BY a.ts DESC, a.event_id DESC) AS n FROM events e JOIN events a ON e.user_id = a.user_id AND a.ts < e.ts AND e.ts <= a.ts + INTERVAL 1 HOUR AND a.event_type <> e.event_type)
SELECT event_id, user_id, anchor_id FROM l WHERE n = 1""")
def impossible_travel(spark, sf_dir):
    return temporal.near_pairs(_read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600, "event_type").drop("minutes")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def orphan_anti(spark, sf_dir):
    return tables.orphans(_read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def known_semi(spark, sf_dir):
    l = _read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return _read(spark, sf_dir, "part").join(l, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) = 1""")
def dedup_grain(spark, sf_dir):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = _read(spark, sf_dir, "lineitem").select(*cols, "l_shipdate")
    # the smallest tuple per key: partial aggregation before the shuffle, and no sort
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate")).alias("m")).select("l_orderkey", "l_linenumber", "m.l_partkey", "m.l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_grain(spark, sf_dir):
    return tables.surplus(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, o_totalprice FROM orders CROSS JOIN (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS m FROM orders) WHERE o_totalprice > 1.9 * m""")
def median_outlier(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.where(F.col("o_totalprice") > 1.9 * F.lit(selection.percentiles(o, "o_totalprice", [0.5])[0]).cast("double"))


_FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@query(f"""SELECT unnest({_FRACTIONS}) AS fraction, unnest(quantile_cont(l_extendedprice, {_FRACTIONS})) AS price FROM lineitem""")
def price_percentiles(spark, sf_dir):
    l = _read(spark, sf_dir, "lineitem")
    found = selection.percentiles(l, "l_extendedprice", _FRACTIONS)
    # a row for each fraction asked for
    return spark.createDataFrame(list(zip(_FRACTIONS, found, strict=True)), "fraction double, price double")


@query("""SELECT o_orderkey, sum(o_totalprice::DECIMAL(14,2)) OVER w::DOUBLE AS so_far, lag(o_custkey) OVER w AS customer_before, row_number() OVER w AS number, max(o_totalprice) OVER w AS most, rank() OVER (ORDER BY o_orderpriority DESC) AS priority_rank
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def order_ledger(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    o = scan.scan(o, [], [F.col("o_orderdate"), F.col("o_orderkey")], so_far=scan.total(_money("o_totalprice")), customer_before=scan.previous(F.col("o_custkey")), number=scan.position(), most=scan.largest(F.col("o_totalprice")))
    # priorities are few: their counts are scanned, not the rows
    ranks = tables.rank_over(o.groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", "n", "priority_rank").drop("n")
    return o.join(ranks, "o_orderpriority").select("o_orderkey", F.col("so_far").cast("double").alias("so_far"), "customer_before", "number", "most", "priority_rank")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, sum(l_quantity::DECIMAL(14,2)) OVER w::DOUBLE AS quantity_so_far, lag(l_suppkey) OVER w AS supplier_before, rank() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS ship_rank
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)""")
def return_ledger(spark, sf_dir):
    # three keys for all rows
    l = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate", "l_partkey", "l_suppkey")
    l = scan.scan(l, ["l_returnflag"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], q=scan.total(_money("l_quantity")), supplier_before=scan.previous(F.col("l_suppkey")))
    days = l.groupBy("l_returnflag", "l_shipdate").agg(F.count("*").alias("n"))
    days = scan.scan(days, ["l_returnflag"], [F.col("l_shipdate")], upto=scan.total(F.col("n"))).select(F.col("l_returnflag").alias("_f"), F.col("l_shipdate").alias("_d"), (F.col("upto") - F.col("n") + 1).alias("ship_rank"))
    return l.join(days, (F.col("l_returnflag") == F.col("_f")) & (F.col("l_shipdate") == F.col("_d"))).select("l_orderkey", "l_linenumber", "l_returnflag", F.col("q").cast("double").alias("quantity_so_far"), "supplier_before", "ship_rank")


@query("""WITH p AS (SELECT o_orderstatus AS status, o_orderdate::DATE AS valid_from, max(o_orderkey) AS k FROM orders GROUP BY ALL),
v AS (SELECT *, lead(valid_from) OVER (PARTITION BY status ORDER BY valid_from) AS next, least(valid_from + 20, coalesce(lead(valid_from) OVER (PARTITION BY status ORDER BY valid_from), valid_from + 20)) AS valid_to FROM p),
f AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_shipdate::DATE AS day FROM lineitem)
SELECT l_orderkey, l_linenumber, day, CASE WHEN day < valid_to THEN k END AS version FROM f ASOF LEFT JOIN v ON v.status = l_linestatus AND v.valid_from <= f.day""")
def as_of_hot_keys(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("valid_from")).agg(F.max("o_orderkey").alias("k"))
    v = temporal.with_valid_to(o, "status", "valid_from", "next").withColumn("valid_to", F.least(F.date_add("valid_from", 20), "next"))
    f = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("status"), F.col("l_shipdate").cast("date").alias("day"))
    return temporal.as_of_merge(f, v, "status", "day", "k", out="version").drop("status")


_RATES = [("click", 0.5), ("view", 0.25), ("signup", 2.0), ("purchase", 1.0)]


@query("""SELECT event_id, event_type, value FROM events JOIN (VALUES ('click', 0.5), ('view', 0.25), ('signup', 2.0), ('purchase', 1.0)) AS r(kind, rate) ON kind = event_type WHERE abs(value - 50 * rate) > 0.10 * 50 * rate""")
def cost_mismatch(spark, sf_dir):
    rates = spark.createDataFrame(_RATES, "event_type string, rate double")
    return _read(spark, sf_dir, "events").join(F.broadcast(rates), "event_type").where("abs(value - 50 * rate) > 0.10 * 50 * rate").select("event_id", "event_type", "value")


@query("""SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'signup') AND value < 20 AND event_type NOT ILIKE '%PURCH%'""")
def rule_filters(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.where(~F.col("event_type").isin("click", "view", "signup") & (F.col("value") < 20) & ~F.col("event_type").ilike("%PURCH%")).select("event_id", "event_type")


_TARGET = "t AS (SELECT c_custkey AS nat_key, row_number() OVER (ORDER BY c_custkey) AS key, CASE WHEN c_custkey % 7 = 0 THEN 'OLD' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey AS nat_key, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0)"


def _target(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    t = scan.scan(c.where("c_custkey % 3 <> 0"), [], [F.col("c_custkey")], key=scan.position())
    t = t.select(F.col("c_custkey").alias("nat_key"), "key", F.when(F.col("c_custkey") % 7 == 0, "OLD").otherwise(F.col("c_mktsegment")).alias("segment"))
    return t, c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("nat_key"), F.col("c_mktsegment").alias("segment"))


@query(f"""WITH {_TARGET}, n AS (SELECT nat_key, segment, (SELECT max(key) FROM t) + row_number() OVER (ORDER BY nat_key) AS key FROM s WHERE nat_key NOT IN (SELECT nat_key FROM t))
SELECT t.key::BIGINT AS key, t.nat_key, coalesce(s.segment, t.segment) AS segment, CASE WHEN s.nat_key IS NULL OR s.segment = t.segment THEN 'keep' ELSE 'update' END AS action FROM t LEFT JOIN s USING (nat_key) UNION ALL SELECT key, nat_key, segment, 'insert' FROM n""")
def merge_upsert(spark, sf_dir):
    t, s = _target(spark, sf_dir)
    return tables.upsert(t, s, ["nat_key"], "key", in_key_order=True).select(F.col("key").cast("long").alias("key"), "nat_key", "segment", F.col("_action").alias("action"))


@query(f"""WITH {_TARGET} SELECT t.key::BIGINT AS key, nat_key, s.segment FROM t JOIN s USING (nat_key) UNION ALL SELECT (SELECT max(key) FROM t) + row_number() OVER (ORDER BY nat_key), nat_key, segment FROM s WHERE nat_key NOT IN (SELECT nat_key FROM t)""")
def merge_reconcile(spark, sf_dir):
    t, s = _target(spark, sf_dir)
    return tables.upsert(t, s, ["nat_key"], "key", delete_missing=True, in_key_order=True).select(F.col("key").cast("long").alias("key"), "nat_key", "segment")


@query(f"""WITH {_TARGET.replace("c_custkey % 5 <> 0", "c_custkey % 100 = 1")}
SELECT CASE WHEN t.key IS NULL THEN -1 ELSE t.key END::BIGINT AS key, nat_key, coalesce(s.segment, t.segment) AS segment, (SELECT count(*) FROM s WHERE nat_key NOT IN (SELECT nat_key FROM t)) AS inserted,
  (SELECT count(*) FROM s JOIN t USING (nat_key) WHERE s.segment <> t.segment) AS updated FROM t FULL JOIN s USING (nat_key)""")
def merge_incremental(spark, sf_dir):
    t, _ = _target(spark, sf_dir)
    snapshot = merge.create(t, f"{shared_folder(spark)}/lodestrata/merge-{uuid.uuid4().hex}", ["nat_key"], "key", 32)
    # one customer in a hundred, two thirds of them known
    batch = _read(spark, sf_dir, "customer").where("c_custkey % 100 = 1").select(F.col("c_custkey").alias("nat_key"), F.col("c_mktsegment").alias("segment"))
    done = merge.merge(snapshot, batch)
    top = max(x.top for x in snapshot.held.values())
    return done.snapshot.rows(spark).select(F.when(F.col("key") > top, -1).otherwise(F.col("key")).cast("long").alias("key"), "nat_key", "segment", F.lit(done.inserted).cast("long").alias("inserted"), F.lit(done.updated).cast("long").alias("updated"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 <> 0""")
def insert_only_merge(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return tables.insert_missing(c.where("c_custkey % 2 = 0"), c.select("c_custkey", F.lit("new").alias("c_mktsegment")), ["c_custkey"])


@query("""SELECT strftime(d, '%Y%m%d')::INTEGER AS date_key, d::DATE AS full_date, quarter(d)::INTEGER AS quarter, monthname(d) AS month_name, isodow(d)::INTEGER AS day_of_week, dayname(d) AS day_name, weekofyear(d)::INTEGER AS iso_week, isodow(d) >= 6 AS is_weekend, 'FY' || year(d) || '-M' || strftime(d, '%m') AS fiscal_period, 'FY' || year(d) || '-Q' || quarter(d) AS fiscal_quarter
FROM (SELECT unnest(generate_series(date_trunc('year', (SELECT min(l_shipdate) FROM lineitem)), date_trunc('year', (SELECT max(l_shipdate) FROM lineitem)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d)""")
def dim_date(spark, sf_dir):
    """The calendar of all years in which something was shipped."""
    day = F.col("l_shipdate").cast("date")
    years = _read(spark, sf_dir, "lineitem").agg(F.trunc(F.min(day), "YYYY").alias("a"), F.date_sub(F.add_months(F.trunc(F.max(day), "YYYY"), 12), 1).alias("b"))
    d = years.select(F.explode(F.sequence("a", "b")).alias("full_date"))
    c = F.col("full_date")
    return d.select(date_key(c).alias("date_key"), "full_date", F.quarter(c).alias("quarter"), F.date_format(c, "MMMM").alias("month_name"), iso_day(c).alias("day_of_week"), F.date_format(c, "EEEE").alias("day_name"), F.weekofyear(c).alias("iso_week"), (iso_day(c) >= 6).alias("is_weekend"), fiscal_period(c).alias("fiscal_period"), fiscal_quarter(c).alias("fiscal_quarter"))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month_start, last_day(o_orderdate::DATE) AS month_end, (o_orderdate::DATE - INTERVAL 12 MONTH)::DATE AS year_before, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS days, o_orderstatus || '|' || o_orderkey AS target_key, nullif(o_orderstatus, 'O') AS status, abs(round(o_totalprice - 100000, 0)) AS distance FROM orders""")
def scalar_functions(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.trunc(d, "MM").alias("month_start"), F.last_day(d).alias("month_end"), F.add_months(d, -12).alias("year_before"), F.datediff(F.lit("2002-01-01").cast("date"), d).cast("long").alias("days"), F.concat("o_orderstatus", F.lit("|"), F.col("o_orderkey").cast("string")).alias("target_key"), F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.abs(F.round(F.col("o_totalprice") - 100000, 0)).alias("distance"))


@query("""WITH a AS (SELECT l_orderkey % 1000 AS k, round(l_quantity, 2) AS q FROM lineitem), b AS (SELECT l_orderkey % 1000 AS k, round(l_quantity, 2) AS q FROM lineitem WHERE l_linenumber > 1)
SELECT 'left_only' AS side, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS row_count UNION ALL SELECT 'right_only', (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) UNION ALL SELECT 'both', (SELECT count(*) FROM (FROM a INTERSECT ALL FROM b))""")
def parity_compare(spark, sf_dir):
    l = _read(spark, sf_dir, "lineitem")
    pick = lambda df: df.select((F.col("l_orderkey") % 1000).alias("k"), F.col("l_quantity").alias("q"))
    return tables.compare(pick(l), pick(l.where("l_linenumber > 1")))


_NEAR = "CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice + 0.02 WHEN l_orderkey % 7 = 0 THEN l_extendedprice + 0.004 ELSE l_extendedprice END"


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, l_quantity, {_NEAR} AS l_extendedprice FROM lineitem WHERE l_orderkey % 1009 <> 5),
x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_extendedprice) AS n FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_extendedprice) AS n FROM b)
SELECT coalesce(x.l_orderkey, y.l_orderkey) AS l_orderkey, coalesce(x.l_linenumber, y.l_linenumber) AS l_linenumber, x.l_extendedprice AS left_price, y.l_extendedprice AS right_price FROM x FULL JOIN y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber AND x.n = y.n
WHERE x.n IS NULL OR y.n IS NULL OR abs(x.l_quantity - y.l_quantity) > 0.01 OR abs(x.l_extendedprice - y.l_extendedprice) > 0.01""")
def parity_tolerance(spark, sf_dir):
    l = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    found = tables.unlike(l, l.where("l_orderkey % 1009 <> 5").withColumn("l_extendedprice", F.expr(_NEAR)))
    either = lambda c: F.coalesce(f"left.{c}", f"right.{c}").alias(c)
    return found.select(either("l_orderkey"), either("l_linenumber"), F.col("left.l_extendedprice").alias("left_price"), F.col("right.l_extendedprice").alias("right_price"))


@query("""WITH s AS (SELECT DISTINCT event_type AS rule, user_id AS k FROM events WHERE value > 90), d AS (SELECT DISTINCT event_type AS rule, user_id AS k FROM events WHERE value > 85 AND event_id % 2 = 0),
j AS (SELECT coalesce(s.rule, d.rule) AS rule, s.k AS sk, d.k AS dk FROM s FULL JOIN d ON s.rule = d.rule AND s.k = d.k)
SELECT rule, count(sk) AS seeded, count(dk) AS detected, count(CASE WHEN sk IS NOT NULL AND dk IS NOT NULL THEN 1 END) AS matched, count(CASE WHEN dk IS NULL THEN 1 END) AS missed, count(CASE WHEN sk IS NULL THEN 1 END) AS false_positives,
  count(CASE WHEN sk IS NOT NULL AND dk IS NOT NULL THEN 1 END) / nullif(count(sk), 0)::DOUBLE AS recall FROM j GROUP BY rule""")
def dq_scorecard(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumnRenamed("event_type", "rule").withColumnRenamed("user_id", "k")
    return tables.scorecard(e.where("value > 90"), e.where("value > 85 and event_id % 2 = 0"), ["rule", "k"], "rule")


_PRINCIPAL = governance.Principal(scopes={"grp_manager": {"BUILDING"}, "grp_auto": {"AUTOMOBILE"}, "grp_exec": governance.ALL}, capabilities={"grp_auto": {"view_name"}}, groups=("grp_manager", "grp_auto"))


@query("""SELECT c_custkey, c_name, c_mktsegment, NULL::DOUBLE AS c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')""")
def row_filter_masks(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return governance.secure(c, _PRINCIPAL, "c_mktsegment", {"c_name": "view_name", "c_acctbal": "view_balance"})


@query("""SELECT c_mktsegment, count(*) AS n, 0 AS seen FROM customer GROUP BY c_mktsegment""")
def default_deny(spark, sf_dir):
    nobody = governance.Principal(groups=("grp_none",))
    every = _read(spark, sf_dir, "customer")
    seen = governance.secure(every, nobody, "c_mktsegment", {}).groupBy("c_mktsegment").agg(F.count("*").alias("seen"))
    return every.groupBy("c_mktsegment").agg(F.count("*").alias("n")).join(seen, "c_mktsegment", "left").na.fill(0, ["seen"])


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def top_orders(spark, sf_dir):
    return _read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity::DECIMAL(14,2))::DOUBLE AS quantity, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    l = _read(spark, sf_dir, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum(_money("l_quantity")).cast("double").alias("quantity"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
