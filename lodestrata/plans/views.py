"""The seven reports and the measures over them, from the tables of the star schema (or secured forms of them)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import UNKNOWN_KEY, ratio
from lodestrata.operators import scan, tables, temporal

Tables = Mapping[str, DataFrame]


def _known(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) != UNKNOWN_KEY)


def _so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _percent(part: Column, whole: Column) -> Column:
    return F.round(ratio(100 * part, whole), 1)


def headcount_trend(t: Tables) -> DataFrame:
    """Employees by department at the end of each month; months without any have no row, and changes skip them."""
    people = _known(t["dim_employee"], "employee_key")
    bounds = people.agg(F.trunc(F.min("hire_date"), "MM").alias("_first"), F.trunc(F.max(F.coalesce("termination_date", "valid_from")), "MM").alias("_last"))
    # a version names its own months, at most the spine's, so there is no range join
    low = F.greatest(F.trunc("valid_from", "MM"), F.col("_first"))
    high = F.least(F.trunc(F.coalesce(F.date_sub("valid_to", 1), F.last_day("_last")), "MM"), F.col("_last"))
    spans = people.crossJoin(F.broadcast(bounds)).withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    months = spans.withColumn("month_start", F.explode(F.sequence("_low", "_high", F.expr("interval 1 month"))))
    covered = months.where(temporal.covers(F.col("valid_from"), F.col("valid_to"), F.last_day("month_start")))
    counts = covered.groupBy("department_code", "month_start").agg(F.count("*").alias("headcount"))
    names = _known(t["dim_department"], "department_key").select("department_code", "department_name")
    w = Window.partitionBy("department_code").orderBy("month_start")
    return counts.join(names, "department_code").select(
        "department_code", "department_name", "month_start", "headcount", (F.col("headcount") - F.lag("headcount").over(w)).alias("headcount_change_mom"),
        F.round(F.avg("headcount").over(w.rowsBetween(-2, 0)), 1).alias("headcount_3mo_avg"),
    )


def attrition_by_department(t: Tables) -> DataFrame:
    """Leavers of the twelve months before the last change, against the mean of the headcounts at both ends."""
    people = _known(t["dim_employee"], "employee_key")
    bounds = people.agg(F.max("valid_from").alias("_d1")).withColumn("_d0", F.add_months("_d1", -12))
    on = lambda day: temporal.covers(F.col("valid_from"), F.col("valid_to"), F.col(day))
    left = F.col("is_current") & F.col("termination_date").between(F.col("_d0"), F.col("_d1"))
    # one pass; a department without people at both ends has no row
    n = tables.distinct_where(people.crossJoin(F.broadcast(bounds)), ["department_code"], ["employee_id"], _s=on("_d0"), _e=on("_d1"), leavers=left).where("_s + _e > 0")
    n = n.withColumn("_avg", ((F.col("_s") + F.col("_e")) / F.lit(2).cast("decimal(1,0)"))).withColumn("_rate", 100 * F.col("leavers") / F.col("_avg"))
    names = _known(t["dim_department"], "department_key").select("department_code", "department_name")
    return n.join(names, "department_code").select(
        "department_code", "department_name", F.col("leavers").alias("trailing_12mo_terminations"), F.round("_avg", 1).alias("avg_headcount"),
        F.round("_rate", 1).alias("attrition_rate_pct"), F.rank().over(Window.orderBy(F.desc_nulls_last("_rate"))).alias("attrition_rank"),
    )


def sales_pipeline_by_rep(t: Tables) -> DataFrame:
    """Open opportunities with a running total for each owner's version, ranked by row over the owners' totals."""
    days = t["dim_date"].select(F.col("date_key").alias("created_date_key"), F.col("full_date").alias("created_date"))
    people = t["dim_employee"].select(F.col("employee_key").alias("owner_employee_key"), F.col("employee_id").alias("owner_employee_id"), F.col("full_name").alias("owner_name"), "region")
    o = t["fact_opportunity"].where(~F.col("stage").like("Closed%"))
    o = o.join(people, "owner_employee_key").join(t["dim_account"].select("account_key", "account_name"), "account_key").join(days, "created_date_key")
    # an owner may have very many; the scan writes the joined rows, so totals and ranks do not join again
    o = scan.scan(o, ["owner_employee_key"], [F.col("created_date"), F.col("opportunity_id")], cumulative_pipeline_usd=scan.total(F.col("amount_usd")))
    sums = o.groupBy(F.col("owner_employee_key").alias("_owner")).agg(F.sum("amount_usd").alias("total_open_pipeline_usd"))
    o = o.join(sums, F.col("owner_employee_key").eqNullSafe(F.col("_owner")))
    # a row's rank is one more than the rows with larger totals; totals are far fewer than rows, and null ones come last
    totals = o.groupBy(F.col("total_open_pipeline_usd").alias("_total")).agg(F.count("*").alias("_n"))
    ranks = tables.rank_over(totals, "_total", "_n", "pipeline_rank").drop("_n")
    return o.join(ranks, F.col("total_open_pipeline_usd").eqNullSafe(F.col("_total"))).select(
        "owner_employee_id", "owner_name", "region", "opportunity_id", "account_name", "created_date", "stage", "amount_usd", "cumulative_pipeline_usd", "total_open_pipeline_usd", "pipeline_rank",
    )


def revenue_trend(t: Tables) -> DataFrame:
    """Recurring revenue at the end of each month in which a subscription started."""
    # a key of a day has its date in it, so the calendar only tells which days are in it
    day = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
    s = t["fact_subscription"].select(day("start_date_key").alias("start"), day("end_date_key").alias("end"), "arr_usd")
    points = s.select(F.last_day("start").alias("month_end")).distinct()
    # a span whose end is not after its start covers nothing
    spans = s.where("end is null or start < end")
    level = temporal.level_series(spans, "start", "end", F.col("arr_usd"), points, "month_end").withColumnRenamed("level", "total_arr_usd")
    w = Window.orderBy("month_end")
    net = level.withColumn("net_new_arr_usd", F.col("total_arr_usd") - F.lag("total_arr_usd").over(w))
    return net.select(
        "month_end", "total_arr_usd", "net_new_arr_usd", _percent(F.col("net_new_arr_usd"), F.col("total_arr_usd") - F.col("net_new_arr_usd")).alias("mom_growth_pct"),
        F.sum(F.coalesce("net_new_arr_usd", "total_arr_usd")).over(_so_far(w)).alias("cumulative_net_new_arr_usd"),
    )


def product_usage_trend(t: Tables) -> DataFrame:
    """Users and sessions by day and product; the frame and the lag count rows, not days."""
    # keys first: the fact shrinks to a row for each day and product before names are joined
    daily = t["fact_usage_daily"].groupBy("date_key", "product_key").agg(F.sum("active_users").alias("active_users"), F.sum("sessions").alias("sessions"))
    daily = daily.join(t["dim_date"].select("date_key", "full_date"), "date_key").join(t["dim_product"], "product_key")
    w = Window.partitionBy("product_code").orderBy("full_date")
    return daily.select(
        "full_date", "product_code", "product_name", "active_users", "sessions", F.round(F.avg("active_users").over(w.rowsBetween(-6, 0)), 1).alias("active_users_7day_avg"),
        (F.col("active_users") - F.lag("active_users", 7).over(w)).alias("active_users_change_vs_last_week"),
    )


def ai_cost_by_department(t: Tables) -> DataFrame:
    """Cost by month and known department, its share of the month's and its rank."""
    cost = _known(t["fact_ai_usage"], "department_key").groupBy("date_key", "department_key").agg(F.sum("cost_usd").alias("_cost"), F.count("*").alias("_n"))
    cost = cost.join(t["dim_date"].select("date_key", "fiscal_period"), "date_key").join(t["dim_department"].select("department_key", "department_code", "department_name"), "department_key")
    cost = cost.groupBy("fiscal_period", "department_code", "department_name").agg(F.sum("_cost").alias("total_cost_usd"), F.sum("_n").alias("request_count"))
    p = Window.partitionBy("fiscal_period")
    return cost.select(
        "fiscal_period", "department_code", "department_name", "request_count", "total_cost_usd", _percent(F.col("total_cost_usd"), F.sum("total_cost_usd").over(p)).alias("pct_of_month_total"),
        F.rank().over(p.orderBy(F.desc_nulls_last("total_cost_usd"))).alias("department_rank_in_month"),
    )


def budget_variance(t: Tables) -> DataFrame:
    """Actual against budget by department and labelled month; a month without a budget has no row."""
    grain = ["department_key", "fiscal_period"]
    b = _known(t["fact_budget"], "department_key").where("fiscal_period is not null").groupBy(*grain).agg(F.sum("budget_usd").alias("_b"))
    a = t["fact_gl_actual"].groupBy(*grain).agg(F.sum("amount_usd").alias("_a"))
    j = b.join(a, grain, "left").join(t["dim_department"].select("department_key", "department_code", "department_name"), "department_key")
    zero = F.lit(0).cast("decimal(1,0)")
    j = j.withColumn("budget_usd", F.coalesce("_b", zero)).withColumn("actual_usd", F.coalesce("_a", zero)).withColumn("variance_usd", F.col("actual_usd") - F.col("budget_usd"))
    return j.select(
        "department_code", "department_name", "fiscal_period", "budget_usd", "actual_usd", "variance_usd", _percent(F.col("variance_usd"), F.col("budget_usd")).alias("variance_pct"),
        F.sum("variance_usd").over(_so_far(Window.partitionBy("department_code").orderBy("fiscal_period"))).alias("cumulative_variance_usd"),
        F.round(F.percent_rank().over(Window.partitionBy("fiscal_period").orderBy("variance_usd")), 3).alias("overspend_percentile_in_period"),
    )


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "rpt_headcount_trend": headcount_trend, "rpt_attrition_by_department": attrition_by_department, "rpt_sales_pipeline_by_rep": sales_pipeline_by_rep, "rpt_revenue_trend": revenue_trend,
    "rpt_product_usage_trend": product_usage_trend, "rpt_ai_cost_by_department": ai_cost_by_department, "rpt_budget_variance": budget_variance,
}


#: The order in which each report is shown; the last column makes it total where rows tie.
ORDER = {
    "rpt_headcount_trend": ["department_code", "month_start"], "rpt_attrition_by_department": ["attrition_rank", "department_code"],
    "rpt_sales_pipeline_by_rep": ["pipeline_rank", "created_date", "opportunity_id"], "rpt_revenue_trend": ["month_end"],
    "rpt_product_usage_trend": ["product_code", "full_date"], "rpt_ai_cost_by_department": ["fiscal_period", "department_rank_in_month", "department_code"],
    "rpt_budget_variance": ["department_code", "fiscal_period"],
}


def ordered(name: str, report: DataFrame) -> DataFrame:
    """A report's rows in its order, nulls last."""
    return report.orderBy(*[F.asc_nulls_last(c) for c in ORDER[name]])


def create(t: Tables) -> None:
    """Temporary views of all reports, in order."""
    for name, view in VIEWS.items():
        ordered(name, view(t)).createOrReplaceTempView(name)


def measures(views: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the eight headline figures; ratios are of sums, and levels are of the last period."""

    def last(df: DataFrame, period: str, value: str, name: str) -> DataFrame:
        return df.groupBy(period).agg(F.sum(value).alias("_v")).agg(F.max_by("_v", period).cast("double").alias(name))

    total = lambda c: F.sum(c).cast("double")
    parts = [
        last(views["rpt_headcount_trend"], "month_start", "headcount", "current_headcount"),
        views["rpt_attrition_by_department"].agg(ratio(100 * total("trailing_12mo_terminations"), total("avg_headcount")).alias("company_attrition_rate_pct")),
        views["rpt_budget_variance"].agg(total("variance_usd").alias("total_budget_variance_usd"), ratio(100 * (total("actual_usd") - total("budget_usd")), total("budget_usd")).alias("budget_variance_pct")),
        views["rpt_ai_cost_by_department"].agg(total("total_cost_usd").alias("total_ai_cost_usd")),
        views["rpt_sales_pipeline_by_rep"].agg(total("amount_usd").alias("total_open_pipeline_usd")),
        last(views["rpt_revenue_trend"], "month_end", "total_arr_usd", "current_arr_usd"),
        last(views["rpt_product_usage_trend"], "full_date", "active_users", "latest_day_active_users"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
