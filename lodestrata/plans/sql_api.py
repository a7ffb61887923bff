"""Lookups and policies for SQL text: functions that it can call, and views of all tables as one principal sees them.

Functions read small tables by uncorrelated subqueries and large ones by equality with a parameter, so a call over a fact is a
join on the key or a filter, never a nested loop over versions or scopes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import governance
from lodestrata.plans import policy, views
from lodestrata.plans.policy import Tables

# Each mask's type and the capability that shows its value.
MASK_FUNCTIONS = {
    "mask_compensation_amount": ("decimal(12,2)", "view_compensation_detail"),
    "mask_compensation_pct": ("decimal(5,4)", "view_compensation_detail"),
    "mask_compensation_units": ("int", "view_compensation_detail"),
    "mask_rating_value": ("smallint", "view_performance_rating"),
    "mask_rating_label": ("string", "view_performance_rating"),
    "mask_promotion_flag": ("boolean", "view_performance_rating"),
    "mask_source_ip": ("string", "view_pii_network"),
    "mask_termination_reason": ("string", "view_hr_sensitive"),
    "mask_job_level": ("smallint", "view_hr_sensitive"),
    "mask_employee_identity": ("string", "view_pii_identity"),
    "mask_ai_policy_flag": ("boolean", "view_pii_identity"),
}

#: The facts that reports read, beside dimensions.
FACTS_OF = {
    "rpt_revenue_trend": {"fact_subscription"}, "rpt_sales_pipeline_by_rep": {"fact_opportunity"}, "rpt_product_usage_trend": {"fact_usage_daily"},
    "rpt_ai_cost_by_department": {"fact_ai_usage"}, "rpt_budget_variance": {"fact_budget", "fact_gl_actual"},
}


def _function(spark: SparkSession, signature: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")


def lookups(spark: SparkSession) -> None:
    """employee_key_as_of, employee_key_best and the table function employees_on, over the session's view dim_employee."""
    # in three: a subquery stands in no higher-order function, and one that compares days would be a nested loop over versions
    spans = "ARRAY<STRUCT<k: BIGINT, a: DATE, b: DATE>>"
    _function(spark, "employee_spans(p_employee_id STRING)", spans, "(SELECT collect_list(named_struct('k', employee_key, 'a', valid_from, 'b', valid_to)) FROM dim_employee WHERE employee_id = p_employee_id)")
    _function(spark, f"span_on(p_spans {spans}, p_as_of DATE)", "BIGINT", "get(filter(p_spans, v -> v.a <= p_as_of AND (v.b IS NULL OR p_as_of < v.b)), 0).k")
    _function(spark, "employee_key_as_of(p_employee_id STRING, p_as_of DATE)", "BIGINT", "span_on(employee_spans(p_employee_id), p_as_of)")
    latest = "(SELECT max_by(employee_key, valid_from) FROM dim_employee WHERE employee_id = p_employee_id)"
    _function(spark, "employee_key_best(p_employee_id STRING, p_as_of DATE)", "BIGINT", f"coalesce(employee_key_as_of(p_employee_id, p_as_of), {latest})")
    _function(spark, "employees_on(p_as_of DATE)", "TABLE (employee_key BIGINT, employee_id STRING, department_code STRING)", "SELECT employee_key, employee_id, department_code FROM dim_employee WHERE employee_key <> -1 AND valid_from <= p_as_of AND (valid_to IS NULL OR p_as_of < valid_to)")


def policies(spark: SparkSession, t: Tables, who: governance.Principal) -> None:
    """rf_department_key, rf_department_by_employee and the masks, for one principal.

    A department that no group names, and a key that is null or has no department, is not seen.
    """
    names = t["dim_department"].select("department_key", F.col("department_name").alias("_name"))
    scopes = [(g, None if s is governance.ALL else d) for g, s in who.scopes.items() for d in (["*"] if s is governance.ALL else sorted(s))]
    scope = spark.createDataFrame(scopes, "group_name string, department_name string")  # a row for each group and department
    scope = scope.join(names, F.col("department_name") == F.col("_name"), "left").select("group_name", F.col("department_name").isNull().alias("all_rows"), "department_key")
    scope.createOrReplaceTempView("department_scope")
    grants = [(g, c) for g, cs in who.capabilities.items() for c in sorted(cs)]
    spark.createDataFrame(grants, "group_name string, capability string").createOrReplaceTempView("capability_grant")
    policy.employee_department(t).createOrReplaceTempView("employee_department")
    groups = ", ".join(f"'{g}'" for g in who.groups) or "NULL"
    _function(spark, "is_account_group_member(p_group STRING)", "BOOLEAN", f"coalesce(p_group IN ({groups}), false)")
    # a function may not stand in the filter of another's subquery
    own = f"FROM department_scope WHERE group_name IN ({groups})"
    _function(spark, "rf_department_key(p_department_key BIGINT)", "BOOLEAN", f"coalesce((SELECT bool_or(all_rows) {own}), false) OR coalesce(array_contains((SELECT collect_set(department_key) {own}), p_department_key), false)")
    _function(spark, "rf_department_by_employee(p_employee_key BIGINT)", "BOOLEAN", "rf_department_key((SELECT max(department_key) FROM employee_department WHERE employee_key = p_employee_key))")
    for name, (kind, capability) in MASK_FUNCTIONS.items():
        _function(spark, f"{name}(p_value {kind})", kind, f"CASE WHEN (SELECT count(*) > 0 FROM capability_grant WHERE capability = '{capability}' AND group_name IN ({groups})) THEN p_value END")


def open_for(spark: SparkSession, t: Tables, who: governance.Principal) -> None:
    """Makes a session the principal's: its tables and reports become views of what the principal may read, by their names, and
    the functions work on them.

    Tables that no group of the principal may read have no view.  The session should be one of its own (`spark.newSession()`),
    with `t` read in it; the unfiltered tables are in no view.
    """
    granted = set().union(*[policy.GRANTS.get(g, set()) for g in who.groups])
    seen = policy.secure(t, who)
    for name in sorted(granted & set(t)):
        seen[name].createOrReplaceTempView(name)
    if any(g in policy.GRANTS for g in who.groups):
        for name, view in views.VIEWS.items():
            if FACTS_OF.get(name, set()) <= set(t):
                views.ordered(name, view(seen)).createOrReplaceTempView(name)
    policies(spark, t, who)
    if "dim_employee" in granted:
        lookups(spark)
