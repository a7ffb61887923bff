"""The data-quality rules: each finds keys of landed rows that break it, as (target_key, detail)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import fiscal_period
from lodestrata.operators import selection, tables, temporal
from lodestrata.sources.registry import DATASETS

# Dollars for a thousand tokens of input and of output, by model.
RATES = {"atlas-large": ("0.0030", "0.0150"), "atlas-mini": ("0.0008", "0.0040"), "orion-pro": ("0.0050", "0.0200"), "orion-lite": ("0.0004", "0.0016")}
# The region of each country.
REGIONS = {"US": "Americas", "CA": "Americas", "BR": "Americas", "GB": "EMEA", "IE": "EMEA", "NL": "EMEA", "DE": "EMEA", "SG": "APAC", "AU": "APAC", "IN": "APAC", "JP": "APAC"}
SALARY_MULTIPLE, COST_TOLERANCE, TRAVEL_SECONDS = 5, "0.10", 3600

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    code: str
    dataset: str
    severity: str
    disposition: str
    find: Callable[[Tables], DataFrame]


RULES: dict[str, Rule] = {}


def _rule(code: str, dataset: str, severity: str, disposition: str):
    def add(find):
        RULES[code] = Rule(code, dataset, severity, disposition, find)
        return find

    return add


def constant_map(values: Mapping[str, object]) -> Column:
    """A literal map; a lookup in it needs no join."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def model_rate(model: Column, side: int) -> Column:
    """Dollars for a thousand tokens of input (0) or output (1); null for other models."""
    return F.try_element_at(constant_map({m: r[side] for m, r in RATES.items()}), model).cast("decimal(8,4)")


def expected_cost(prompt: Column, completion: Column, model: Column) -> Column:
    return (prompt.cast("decimal(12,0)") * model_rate(model, 0) + completion.cast("decimal(12,0)") * model_rate(model, 1)) / F.lit(1000).cast("decimal(4,0)")


def region_of(country: Column) -> Column:
    return F.try_element_at(constant_map(REGIONS), country)


def target_key(dataset: str) -> Column:
    """The key's parts joined by |, dates as ISO text; a null part is empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in DATASETS[dataset].key])


def _found(df: DataFrame, dataset: str, *detail: str) -> DataFrame:
    """Keys with a text put together from literals and, where a part starts with @, columns (a null one reads null)."""
    parts = [F.coalesce(F.col(p[1:]).cast("string"), F.lit("null")) if p.startswith("@") else F.lit(p) for p in detail]
    return df.select(target_key(dataset).alias("target_key"), F.concat(*parts).alias("detail"))


def _filter(code: str, dataset: str, severity: str, disposition: str, where: Column | str, *detail: str) -> None:
    _rule(code, dataset, severity, disposition)(lambda t: _found(t[dataset].where(where() if callable(where) else where), dataset, *detail))


def _without(code: str, dataset: str, severity: str, disposition: str, column: str, parent: str, parent_column: str, *detail: str, nulls: bool = False) -> None:
    """Rows whose value has no row in the parent table; rows without a value too if `nulls`."""

    def find(t: Tables) -> DataFrame:
        parents = t[parent].select(F.col(parent_column).alias("_p")).where("_p is not null").distinct()
        rows = t[dataset] if nulls else t[dataset].where(F.col(column).isNotNull())
        return _found(rows.join(parents, F.col(column) == F.col("_p"), "left_anti"), dataset, *detail).distinct()

    _rule(code, dataset, severity, disposition)(find)


def _repeated(code: str, dataset: str) -> None:
    _rule(code, dataset, "error", "rejected")(lambda t: _found(tables.surplus(t[dataset], list(DATASETS[dataset].key)), dataset, "@copies", " rows with this key"))


_filter("HR_MISSING_TERMINATION_REASON", "hr_employee_history", "warning", "flagged", "termination_date is not null and termination_reason is null", "terminated on ", "@termination_date", " without a reason")
_filter("CRM_CLOSED_BEFORE_CREATED", "crm_opportunity", "error", "flagged", "close_date < created_date", "closed on ", "@close_date", ", created on ", "@created_date")
_filter("CRM_NEGATIVE_INVOICE", "crm_invoice", "error", "flagged", "amount_usd < 0 and not coalesce(status, '') ilike '%credit%'", "amount ", "@amount_usd", " with status ", "@status")
_filter("USAGE_NEGATIVE_SESSIONS", "usage_daily", "error", "flagged", "sessions < 0", "@sessions", " sessions")
_filter("AI_UNKNOWN_MODEL", "ai_usage_event", "warning", "flagged", lambda: ~F.col("model").isin(*RATES), "model ", "@model", " is not approved")
_filter("SEC_MISSING_ACTOR", "sec_access_event", "error", "flagged", "employee_id is null", "@action", " on ", "@system", " by nobody")
_filter("FIN_CLOSED_PERIOD_POSTING", "fin_actual", "error", "flagged", lambda: F.col("fiscal_period") != fiscal_period(F.col("posting_date")), "posted on ", "@posting_date", " to ", "@fiscal_period")
_without("HR_ORPHAN_MANAGER", "hr_employee_history", "warning", "repaired", "manager_id", "hr_employee_history", "employee_id", "no such manager as ", "@manager_id")
_without("CRM_ORPHAN_OPPORTUNITY", "crm_opportunity", "error", "rejected", "account_id", "dim_account", "account_id", "no such account as ", "@account_id", nulls=True)
_without("USAGE_UNKNOWN_ACCOUNT", "usage_daily", "error", "rejected", "account_id", "dim_account", "account_id", "no such account as ", "@account_id", nulls=True)
_without("FIN_ORPHAN_COST_CENTER", "fin_actual", "error", "flagged", "cost_center", "dim_department", "cost_center", "no department has cost centre ", "@cost_center", nulls=True)
_without("FIN_UNAUTHORISED_APPROVER", "fin_budget", "error", "flagged", "approved_by", "dim_employee", "employee_id", "approved by ", "@approved_by", ", who is not an employee", nulls=True)
_repeated("CRM_DUPLICATE_ACCOUNT", "crm_account")
_repeated("USAGE_DUPLICATE_EVENT", "usage_daily")


@_rule("HR_OVERLAPPING_SPAN", "hr_employee_history", "error", "rejected")
def _overlapping_span(t: Tables) -> DataFrame:
    rows = temporal.overlapping(t["hr_employee_history"], "employee_id", "valid_from", "valid_to")
    return _found(rows, "hr_employee_history", "starts on ", "@valid_from", ", before an earlier span ends").distinct()


@_rule("HR_SALARY_OUTLIER", "hr_compensation", "error", "flagged")
def _salary_outlier(t: Tables) -> DataFrame:
    pay = t["hr_compensation"]
    median = selection.percentiles(pay, "annual_salary_usd", [0.5])[0]
    rows = pay.withColumn("_median", F.lit(median).cast("double")).where(F.col("annual_salary_usd").cast("double") > SALARY_MULTIPLE * F.col("_median"))
    return _found(rows, "hr_compensation", "salary ", "@annual_salary_usd", " where the median is ", "@_median")


@_rule("AI_COST_MISMATCH", "ai_usage_event", "error", "flagged")
def _cost_mismatch(t: Tables) -> DataFrame:
    rows = t["ai_usage_event"].withColumn("_expected", expected_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("model")))
    far = F.abs(F.col("cost_usd") - F.col("_expected")) > F.lit(COST_TOLERANCE).cast("decimal(3,2)") * F.col("_expected")
    return _found(rows.where(far), "ai_usage_event", "cost ", "@cost_usd", " where tokens make ", "@_expected")


_LOGIN = "action = 'LOGIN' and result = 'SUCCESS'"


@_rule("SEC_LOGIN_AFTER_TERMINATION", "sec_access_event", "error", "flagged")
def _login_after_termination(t: Tables) -> DataFrame:
    people = t["dim_employee"]
    gone = people.where("is_current and termination_date is not null").select("employee_id", F.col("termination_date").alias("_gone"))
    late = t["sec_access_event"].where(_LOGIN).join(gone, "employee_id").withColumn("_day", F.col("event_ts").cast("date")).where("_day >= _gone")
    unemployed = temporal.as_of(late, people, "employee_id", "_day", "employee_key", out="_key").where("_key is null")
    return _found(unemployed, "sec_access_event", "login on ", "@_day", " after leaving on ", "@_gone")


@_rule("SEC_IMPOSSIBLE_TRAVEL", "sec_access_event", "error", "flagged")
def _impossible_travel(t: Tables) -> DataFrame:
    events = t["sec_access_event"].withColumn("_region", region_of(F.col("source_country")))
    pairs = temporal.near_pairs(events.where("employee_id is not null and _region is not null"), "employee_id", "event_ts", "event_id", TRAVEL_SECONDS, "_region", F.expr(_LOGIN), ("source_country", "_region"))
    place = lambda prefix: ("@" + prefix + "source_country", " (", "@" + prefix + "_region", ")")
    return _found(pairs, "sec_access_event", "@employee_id", " in ", *place(""), ", ", "@minutes", " min after event ", "@anchor_id", " in ", *place("anchor_"))


def exceptions(t: Tables, codes: list[str] | None = None, run: int | None = None) -> DataFrame:
    """(run_id, dataset, rule_code, severity, disposition, target_key, detail, detected_at) of all rules, or of those named."""
    found = []
    for rule in [RULES[c] for c in codes or sorted(RULES)]:
        labels = {"dataset": rule.dataset, "rule_code": rule.code, "severity": rule.severity, "disposition": rule.disposition}
        found.append(rule.find(t).select(F.lit(run).cast("int").alias("run_id"), *[F.lit(v).alias(k) for k, v in labels.items()], "target_key", "detail"))
    return reduce(DataFrame.unionByName, found).withColumn("detected_at", F.current_timestamp())


def score(detected: DataFrame, seeded: DataFrame) -> DataFrame:
    """Per rule: seeded, detected, matched, missed, false positives, recall; `implemented` tells whether the rule exists here.

    A seeded rule without a single hit has recall 0, however it came about.
    """
    keys = ["rule_code", "dataset", "target_key"]
    return tables.scorecard(seeded, detected, keys, "rule_code").withColumn("implemented", F.col("rule_code").isin(*sorted(RULES)))
