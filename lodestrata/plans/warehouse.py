"""The star schema: dimensions with stable keys, facts with as-of keys, quality exceptions, published as one version."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import UNKNOWN_KEY, date_key, fiscal_period, fiscal_quarter, iso_day, or_unknown
from lodestrata.operators import tables, temporal
from lodestrata.plans import checks, rules
from lodestrata.sources import extract
from lodestrata.sources.registry import DATASETS
from lodestrata.sources.store import Store, now

AREA = "warehouse"
RUNS = "runs"
_RUNS_SCHEMA = "version int, landing int, status string, detail string, started_at timestamp_ntz, finished_at timestamp_ntz"

Tables = Mapping[str, DataFrame]


def conform(landed: Tables, lenient: bool = False) -> dict[str, DataFrame]:
    """All landed datasets with their types."""
    return {name: d.conform(landed[name], lenient) for name, d in DATASETS.items()}


# Dimensions: the rows that the source has now, without surrogate keys.


def calendar(spark: SparkSession) -> DataFrame:
    """A row for each day from 2010 to 2035."""
    d = F.col("full_date")
    small = lambda c: c.cast("smallint")
    return spark.sql("SELECT explode(sequence(DATE'2010-01-01', DATE'2035-12-31')) AS full_date").select(
        date_key(d).alias("date_key"), d, small(F.year(d)).alias("year"), small(F.quarter(d)).alias("quarter"), small(F.month(d)).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), small(F.dayofmonth(d)).alias("day_of_month"), small(iso_day(d)).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), small(F.weekofyear(d)).alias("iso_week"), (iso_day(d) >= 6).alias("is_weekend"),
        fiscal_period(d).alias("fiscal_period"), fiscal_quarter(d).alias("fiscal_quarter"), small(F.year(d)).alias("fiscal_year"),
    )


def departments(t: Tables) -> DataFrame:
    costs = t["fin_budget"].where("department_code is not null").groupBy("department_code").agg(F.min("cost_center").alias("cost_center"))
    return t["hr_employee_history"].where("department_code is not null").select("department_code", "department_name").distinct().join(costs, "department_code", "left")


def employees(t: Tables) -> DataFrame:
    """Versions of employees without overlapping ones; managers that are no employees are null."""
    source = t["hr_employee_history"]
    kept = source.withColumn("_overlap", temporal.overlap_flag("employee_id", "valid_from", "valid_to")).where("not _overlap").drop("_overlap")
    known = source.where("employee_id is not null").select(F.col("employee_id").alias("_known")).distinct()
    # both windows lie on the same key, so rows move once for them
    newest = Window.partitionBy("employee_id").orderBy(F.desc("valid_from"), F.desc_nulls_first("valid_to"))
    kept = kept.withColumn("is_current", F.row_number().over(newest) == 1)
    kept = kept.join(known, F.col("manager_id") == F.col("_known"), "left")
    return kept.select(
        "employee_id", "valid_from", "valid_to", "is_current", "first_name", "last_name",
        F.concat("first_name", F.lit(" "), "last_name").alias("full_name"), "work_email", "region", "location", "department_code", "department_name",
        "job_level", "job_title", F.col("_known").alias("manager_employee_id"), "employment_type", "change_reason", "hire_date", "termination_date", "termination_reason",
    )


def accounts(t: Tables) -> DataFrame:
    """One row for each account; the date of leaving, not the status, tells whether it is active."""
    columns = ["account_id", "account_name", "region", "segment", "industry", "created_date", "owner_employee_id", "status", "churn_date"]
    # the columns after the first two make the order total
    order = [F.asc_nulls_last(c) for c in ["account_name", "created_date", "region", "segment", "industry", "owner_employee_id", "status", "churn_date"]]
    return tables.dedup(t["crm_account"].where("account_id is not null"), ["account_id"], order).select(*columns, F.col("churn_date").isNull().alias("is_active"))


def products(t: Tables) -> DataFrame:
    return t["crm_subscription"].where("product_code is not null").groupBy("product_code").agg(F.max("product_name").alias("product_name"))


# name: (builder, surrogate, natural key, whether rows that the source lacks go, values of the unknown member as text)
DIMENSIONS: dict[str, tuple[Callable[[Tables], DataFrame], str, list[str], bool, dict[str, str]]] = {
    "dim_department": (departments, "department_key", ["department_code"], False, {"department_code": "UNKNOWN", "department_name": "Unknown Department"}),
    "dim_employee": (employees, "employee_key", ["employee_id", "valid_from"], True, {"employee_id": "UNKNOWN", "valid_from": "1900-01-01", "is_current": "true", "full_name": "Unknown Employee"}),
    "dim_account": (accounts, "account_key", ["account_id"], True, {"account_id": "UNKNOWN", "account_name": "Unknown Account", "is_active": "false"}),
    "dim_product": (products, "product_key", ["product_code"], False, {"product_code": "UNKNOWN", "product_name": "Unknown Product"}),
}


def dimension(name: str, t: Tables, previous: DataFrame | None = None) -> DataFrame:
    """The next snapshot of a dimension: keys that were given before stay; the unknown member has key -1."""
    build, key, natural, deletes, unknown = DIMENSIONS[name]
    source = build(t)
    if previous is None:
        return tables.first_snapshot(source, natural, key, UNKNOWN_KEY, {c: F.lit(unknown.get(c)).cast(kind) for c, kind in source.dtypes})
    rows = tables.upsert(previous, source, natural, key, delete_missing=deletes, never=UNKNOWN_KEY, in_key_order=False)
    return rows.select(F.col(key).cast("long").alias(key), *source.columns)


# Facts: landed rows with the keys of their dimensions.


def _key(df: DataFrame, dim: DataFrame, natural: str, key: str, how: str = "left") -> DataFrame:
    """Adds a dimension's surrogate; rows without one get -1, or go if `how` is inner."""
    joined = df.join(dim.select(F.col(natural).alias("_natural"), key), F.col(natural) == F.col("_natural"), how).drop("_natural")
    return joined if how == "inner" else joined.withColumn(key, or_unknown(F.col(key)))


def _person(df: DataFrame, people: DataFrame, person: str, day: Column, out: str, unknown: bool = True) -> DataFrame:
    """Adds the key of the person's version on a day, else of the last one, else -1 (or null unless `unknown`)."""
    versions = people.select(F.col("employee_id").alias(person), "valid_from", "valid_to", F.col("employee_key").alias("_person"))
    found = temporal.as_of(df.withColumn("_day", day), versions, person, "_day", "_person", forgiving=True, out=out).drop("_day")
    return found.withColumn(out, or_unknown(F.col(out))) if unknown else found


def compensation(t: Tables) -> DataFrame:
    f = _person(t["hr_compensation"], t["dim_employee"], "employee_id", F.col("effective_from"), "employee_key")
    return f.select("compensation_id", "employee_key", date_key(F.col("effective_from")).alias("date_key"), "pay_grade", "annual_salary_usd", "bonus_target_pct", "equity_units", "currency", "change_reason")


def performance_review(t: Tables) -> DataFrame:
    """A reviewer who is not known has a null key, not -1."""
    day = F.col("submitted_date")
    f = _person(t["hr_performance_review"], t["dim_employee"], "employee_id", day, "employee_key")
    f = _person(f, t["dim_employee"], "reviewer_id", day, "reviewer_employee_key", unknown=False)
    return f.select("review_id", "employee_key", "reviewer_employee_key", date_key(day).alias("date_key"), "review_period", "rating", "rating_label", "promotion_recommended")


def subscription(t: Tables) -> DataFrame:
    f = _key(_key(t["crm_subscription"], t["dim_account"], "account_id", "account_key"), t["dim_product"], "product_code", "product_key")
    return f.select("subscription_id", "account_key", "product_key", date_key(F.col("start_date")).alias("start_date_key"), date_key(F.col("end_date")).alias("end_date_key"), "seats", "arr_usd", "billing_frequency")


def invoice(t: Tables) -> DataFrame:
    f = _key(t["crm_invoice"], t["dim_account"], "account_id", "account_key")
    days = [date_key(F.col(c)).alias(f"{c}_key") for c in ("issue_date", "due_date", "paid_date")]
    return f.select("invoice_id", "account_key", "subscription_id", *days, "amount_usd", "currency", "status")


def opportunity(t: Tables) -> DataFrame:
    """Opportunities of accounts that are known."""
    f = _key(_key(t["crm_opportunity"], t["dim_account"], "account_id", "account_key", "inner"), t["dim_product"], "product_code", "product_key")
    f = _person(f, t["dim_employee"], "owner_employee_id", F.col("created_date"), "owner_employee_key")
    days = [date_key(F.col(c)).alias(f"{c}_key") for c in ("created_date", "close_date")]
    return f.select("opportunity_id", "account_key", "owner_employee_key", "product_key", *days, "opportunity_type", "stage", "amount_usd", "probability_pct", "is_won")


def usage_daily(t: Tables) -> DataFrame:
    """One row for each day, account and product, of accounts that are known."""
    measures = ["active_users", "sessions", "api_calls", "storage_gb", "avg_latency_ms", "error_count"]
    grain = list(DATASETS["usage_daily"].key)
    # the measures after the first two make the order total; a struct's minimum is taken before the shuffle.
    # Nulls are last in the order, so each measure is led by whether it is null.
    ordered = F.struct(*[x for m in measures for x in (F.col(m).isNull().alias(f"{m}_null"), F.col(m))])
    first = t["usage_daily"].groupBy(*grain).agg(F.min(ordered).alias("m")).select(*grain, *[F.col(f"m.{m}").alias(m) for m in measures])
    f = _key(_key(first, t["dim_account"], "account_id", "account_key", "inner"), t["dim_product"], "product_code", "product_key")
    return f.select(date_key(F.col("usage_date")).alias("date_key"), "account_key", "product_key", *measures)


def ai_usage(t: Tables, people: bool = True) -> DataFrame:
    day = F.col("event_ts").cast("date")
    f = _key(t["ai_usage_event"], t["dim_department"], "department_code", "department_key")
    f = _person(f, t["dim_employee"], "employee_id", day, "employee_key") if people else f
    return f.select("event_id", "employee_id", *["employee_key"] * people, "department_key", date_key(day).alias("date_key"), "event_ts", "model", "feature", "prompt_tokens", "completion_tokens", "cost_usd", "latency_ms", "flagged_by_policy")


def access_event(t: Tables) -> DataFrame:
    day = F.col("event_ts").cast("date")
    f = _person(_key(t["sec_access_event"], t["dim_department"], "department_code", "department_key"), t["dim_employee"], "employee_id", day, "employee_key")
    return f.select("event_id", "employee_id", "employee_key", "department_key", date_key(day).alias("date_key"), "event_ts", "system", "action", "resource", "source_ip", "source_country", "result", "mfa_used")


def gl_actual(t: Tables, people: bool = True) -> DataFrame:
    f = _key(t["fin_actual"], t["dim_department"], "department_code", "department_key")
    f = _person(f, t["dim_employee"], "posted_by", F.col("posting_date"), "posted_by_employee_key") if people else f
    return f.select("actual_id", "department_key", date_key(F.col("posting_date")).alias("date_key"), "fiscal_period", "gl_account", "gl_account_name", "amount_usd", "vendor", "description", *["posted_by_employee_key"] * people)


def budget(t: Tables, people: bool = True) -> DataFrame:
    f = _key(t["fin_budget"], t["dim_department"], "department_code", "department_key")
    f = _person(f, t["dim_employee"], "approved_by", F.col("approved_date"), "approved_by_employee_key") if people else f
    return f.select("budget_id", "department_key", "fiscal_period", "fiscal_year", "fiscal_quarter", "gl_account", "gl_account_name", "budget_usd", *["approved_by_employee_key"] * people, date_key(F.col("approved_date")).alias("approved_date_key"))


FACTS: dict[str, Callable[[Tables], DataFrame]] = {
    "fact_compensation": compensation, "fact_performance_review": performance_review, "fact_subscription": subscription, "fact_invoice": invoice, "fact_opportunity": opportunity,
    "fact_usage_daily": usage_daily, "fact_ai_usage": ai_usage, "fact_access_event": access_event, "fact_gl_actual": gl_actual, "fact_budget": budget,
}


#: Facts without the keys of people, for reports that read none: an as-of lookup may repeat rows, so no optimizer leaves it out.
WITHOUT_PEOPLE: dict[str, Callable[[Tables], DataFrame]] = {"fact_ai_usage": partial(ai_usage, people=False), "fact_gl_actual": partial(gl_actual, people=False), "fact_budget": partial(budget, people=False)}


#: Columns that each fact's files are ranges of and sorted by; the last makes ties of a hot key fall into many files.
ORDER = {
    "fact_compensation": ["employee_key", "compensation_id"], "fact_performance_review": ["employee_key", "review_id"], "fact_subscription": ["account_key", "subscription_id"],
    "fact_invoice": ["account_key", "subscription_id", "invoice_id"], "fact_opportunity": ["account_key", "owner_employee_key", "opportunity_id"],
    "fact_usage_daily": ["date_key", "account_key", "product_key"], "fact_ai_usage": ["date_key", "employee_key", "event_id"], "fact_access_event": ["date_key", "employee_key", "event_id"],
    "fact_gl_actual": ["department_key", "fiscal_period", "actual_id"], "fact_budget": ["department_key", "fiscal_period", "budget_id"], "dq_exception": ["rule_code", "target_key"],
}


#: Columns of each fact that single rows are looked up by.
IDS = {
    "fact_subscription": ("subscription_id",), "fact_invoice": ("invoice_id", "subscription_id"), "fact_opportunity": ("opportunity_id",),
    "fact_ai_usage": ("event_id",), "fact_access_event": ("event_id",), "fact_gl_actual": ("actual_id",), "dq_exception": ("target_key",),
}


class BuildError(Exception):
    """The new version breaks an invariant; the previous one stays current."""


def latest_run(store: Store) -> dict | None:
    """The last run's log entry with its exceptions by rule, if it succeeded; None before the first run."""
    runs = store.log(RUNS)
    last = runs.orderBy(F.desc("version"), F.desc("started_at")).limit(1).collect() if runs is not None else []
    if not last:
        return None
    found = {}
    if last[0].status == "succeeded":
        found = {r.rule_code: r.n for r in store.read(AREA, last[0].version)["dq_exception"].groupBy("rule_code").agg(F.count("*").alias("n")).collect()}
    return {**last[0].asDict(), "exceptions": found}


def build(spark: SparkSession, store: Store, lenient: bool = False) -> int:
    """Build the current landing into a new version of the warehouse and return its number.

    Tables are written one by one, invariants are checked on what was written, and only then does the version become current.
    The run is logged whether it succeeds or fails.
    """
    landings = store.history(extract.AREA)
    if not landings:
        raise BuildError("nothing has been landed")
    version, started = store.begin(AREA), now()
    try:
        t: dict[str, DataFrame] = conform(store.read(extract.AREA, landings[-1]), lenient)
        before = store.read(AREA)
        keep = lambda name, df: t.__setitem__(name, store.write(AREA, version, name, df, ORDER.get(name), IDS.get(name, ())))
        keep("dim_date", calendar(spark))
        for name in DIMENSIONS:
            keep(name, dimension(name, t, before.get(name)))
        for name, fact in FACTS.items():
            keep(name, fact(t))
        keep("dq_exception", rules.exceptions(t, run=version))
        if broken := checks.broken(t):
            raise BuildError("; ".join(f"{name}: {n} rows" for name, n in broken.items()))
        store.publish(AREA, version)
    except Exception as problem:
        store.append(RUNS, [(version, landings[-1], "failed", str(problem)[:2000], started, now())], _RUNS_SCHEMA)
        raise
    store.append(RUNS, [(version, landings[-1], "succeeded", None, started, now())], _RUNS_SCHEMA)
    return version
