"""Who may read what: personas, the rows and columns that they see, and reports over what they see."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import governance
from lodestrata.plans.lazy import LazyTables
from lodestrata.plans.views import VIEWS

Tables = Mapping[str, DataFrame]

# Departments by name that each group's rows are of (ALL: every row; a group that is not named sees none),
# capabilities, and tables that it may read beside the reports.
SCOPES = {"grp_exec": governance.ALL, "grp_hr_analyst": governance.ALL, "grp_total_rewards": governance.ALL, "grp_security": governance.ALL, "grp_fp_a": governance.ALL, "grp_dept_manager_engineering": {"Engineering"}}
CAPABILITIES = {
    "grp_hr_analyst": {"view_performance_rating", "view_hr_sensitive"},
    "grp_total_rewards": {"view_compensation_detail"},
    "grp_security": {"view_pii_network", "view_pii_identity"},
}
DIMENSIONS_AND_FACTS = {
    "dim_date", "dim_department", "dim_employee", "dim_account", "dim_product", "fact_compensation", "fact_performance_review", "fact_subscription", "fact_invoice",
    "fact_opportunity", "fact_usage_daily", "fact_ai_usage", "fact_access_event", "fact_gl_actual", "fact_budget", "dq_exception",
}
GRANTS = {
    "grp_exec": DIMENSIONS_AND_FACTS,
    "grp_hr_analyst": {"dim_employee", "fact_compensation", "fact_performance_review"},
    "grp_total_rewards": {"fact_compensation"},
    "grp_security": {"fact_access_event", "fact_ai_usage"},
    "grp_fp_a": {"fact_gl_actual", "fact_budget"},
    "grp_sales_ops": {"dim_account", "fact_opportunity", "fact_subscription", "fact_invoice"},
    "grp_dept_manager_engineering": {"fact_compensation", "fact_performance_review", "fact_access_event", "fact_ai_usage", "fact_gl_actual", "fact_budget"},
}
# The capability that each masked column needs, by table.
MASKS = {
    "dim_employee": {"termination_reason": "view_hr_sensitive", "job_level": "view_hr_sensitive"},
    "fact_compensation": {"annual_salary_usd": "view_compensation_detail", "bonus_target_pct": "view_compensation_detail", "equity_units": "view_compensation_detail"},
    "fact_performance_review": {"rating": "view_performance_rating", "rating_label": "view_performance_rating", "promotion_recommended": "view_performance_rating"},
    "fact_access_event": {"source_ip": "view_pii_network", "employee_id": "view_pii_identity"},
    "fact_ai_usage": {"employee_id": "view_pii_identity", "flagged_by_policy": "view_pii_identity"},
}
#: The column by which rows of a table belong to a department; tables that are not named have no row filter.
ROW_FILTERS = {
    "fact_access_event": "department_key", "fact_ai_usage": "department_key", "fact_gl_actual": "department_key", "fact_budget": "department_key",
    "fact_compensation": "employee_key", "fact_performance_review": "employee_key",
}


class AccessDenied(Exception):
    """No group of the principal may read the table."""


def principal(*groups: str) -> governance.Principal:
    return governance.Principal(scopes=SCOPES, capabilities=CAPABILITIES, groups=groups)


def employee_department(t: Tables) -> DataFrame:
    """(employee_key, department_key) by the department's name, a table of its own so that policies read no governed one."""
    names = t["dim_department"].select("department_key", F.col("department_name").alias("_name"))
    return t["dim_employee"].select("employee_key", F.col("department_name").alias("_of")).join(names, F.col("_of") == F.col("_name"), "left").select("employee_key", "department_key")


def secure(t: Tables, who: governance.Principal) -> Tables:
    """All tables as the principal sees them: rows of their departments only, and masked columns as typed nulls.

    Keys of departments are joined by semi-join, so names are looked up when the plan runs and the filter stays in Spark.
    """
    scope = who.departments()
    if scope is not governance.ALL:
        keys = t["dim_department"].where(F.col("department_name").isin(*sorted(scope)) if scope else F.lit(False)).select("department_key")
        people = employee_department(t).join(keys, "department_key", "left_semi").select("employee_key")
        allowed = {"department_key": keys, "employee_key": people}

    def seen(name: str) -> DataFrame:
        df = t[name]
        if scope is not governance.ALL and name in ROW_FILTERS:
            df = df.join(allowed[ROW_FILTERS[name]], ROW_FILTERS[name], "left_semi").select(*df.columns)
        return governance.secure(df, who, None, MASKS.get(name, {}))

    return LazyTables({name: lambda _, name=name: seen(name) for name in t})


def read(t: Tables, who: governance.Principal, name: str) -> DataFrame:
    """A table or a report for a principal; reports are open to every persona and are computed from what it sees."""
    if name in VIEWS:
        if not any(g in GRANTS for g in who.groups):
            raise AccessDenied(f"no group may read {name}")
        return VIEWS[name](secure(t, who))
    if not any(name in GRANTS.get(g, ()) for g in who.groups):
        raise AccessDenied(f"no group may read {name}")
    return secure(t, who)[name]


#: Reports with a department, which a department's manager reads by that department's rows only.
DEPARTMENT_REPORTS = ("rpt_headcount_trend", "rpt_attrition_by_department", "rpt_ai_cost_by_department", "rpt_budget_variance")


def for_role(reports: Tables, department: str | None) -> dict[str, DataFrame]:
    """Finished reports for a reader's role: an executive (None) sees all, a manager the department's rows where there are any."""
    keep = lambda name, df: df if department is None or name not in DEPARTMENT_REPORTS else df.where(F.col("department_name") == department)
    return {name: keep(name, df) for name, df in reports.items()}
