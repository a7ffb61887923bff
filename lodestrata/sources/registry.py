"""The landed datasets: columns, types, keys, stewards and sensitivity; every reader and rule takes them from here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.functions import typed

#: From least to most sensitive; compare by position, never as text.
TIERS = ("public", "internal", "confidential", "restricted")


@dataclass(frozen=True)
class Dataset:
    """A landed file.  `spec` names a column a line: name, type, and its tier where that is not internal."""

    name: str
    steward: str
    key: tuple[str, ...]
    spec: str
    retention_days: int | None = None
    columns: dict[str, str] = field(init=False)
    tiers: dict[str, str] = field(init=False)

    def __post_init__(self):
        rows = [line.split() for line in self.spec.strip().splitlines()]
        columns = {r[0]: r[1] for r in rows}
        tiers = {r[0]: r[2] if len(r) > 2 else "internal" for r in rows}
        if len(columns) != len(rows):
            raise ValueError(f"{self.name}: a column is declared twice")
        if missing := [k for k in self.key if k not in columns]:
            raise ValueError(f"{self.name}: no such key columns {missing}")
        if unknown := set(tiers.values()) - set(TIERS):
            raise ValueError(f"{self.name}: no such tiers {sorted(unknown)}")
        object.__setattr__(self, "columns", columns)
        object.__setattr__(self, "tiers", tiers)

    @property
    def max_tier(self) -> str:
        return max(self.tiers.values(), key=TIERS.index)

    def columns_of(self, tier: str) -> list[str]:
        return [c for c, t in self.tiers.items() if t == tier]

    @property
    def landed_schema(self) -> T.StructType:
        """All text, with the tier in each field's metadata."""
        return T.StructType([T.StructField(c, T.StringType(), True, {"tier": self.tiers[c]}) for c in self.columns])

    def conform(self, landed: DataFrame, lenient: bool = False) -> DataFrame:
        """Typed columns in declared order; empty text is null.

        Text that does not fit its type is an error, or null if `lenient`; columns that are not declared are left out.
        """
        return landed.select(*[typed(c, kind, lenient) for c, kind in self.columns.items()])


# Names, order, types, keys and tiers of the files as they are landed.
_DATASETS = [
    Dataset("hr_employee_history", "People Operations", ("employee_id", "valid_from"), """
        employee_id string
        valid_from date
        valid_to date
        first_name string
        last_name string
        work_email string
        region string
        location string
        department_code string
        department_name string
        job_level smallint confidential
        job_title string
        manager_id string
        employment_type string
        change_reason string confidential
        hire_date date
        termination_date date confidential
        termination_reason string restricted"""),
    Dataset("hr_compensation", "Total Rewards", ("compensation_id",), """
        compensation_id string
        employee_id string
        effective_from date confidential
        effective_to date confidential
        pay_grade string confidential
        annual_salary_usd decimal(12,2) restricted
        bonus_target_pct decimal(5,4) restricted
        equity_units int restricted
        currency string
        change_reason string confidential"""),
    Dataset("hr_performance_review", "People Operations", ("review_id",), """
        review_id string
        employee_id string
        review_period string
        reviewer_id string confidential
        rating smallint restricted
        rating_label string restricted
        promotion_recommended boolean restricted
        submitted_date date confidential"""),
    Dataset("crm_account", "Sales Operations", ("account_id",), """
        account_id string
        account_name string
        region string
        segment string
        industry string
        created_date date
        owner_employee_id string
        status string
        churn_date date confidential"""),
    Dataset("crm_subscription", "Sales Operations", ("subscription_id",), """
        subscription_id string
        account_id string
        product_code string public
        product_name string public
        start_date date
        end_date date
        seats int confidential
        arr_usd decimal(12,2) confidential
        billing_frequency string"""),
    Dataset("crm_opportunity", "Sales Operations", ("opportunity_id",), """
        opportunity_id string
        account_id string
        owner_employee_id string
        product_code string public
        opportunity_type string
        created_date date
        close_date date
        stage string confidential
        amount_usd decimal(12,2) confidential
        probability_pct smallint confidential
        is_won boolean confidential"""),
    Dataset("crm_invoice", "Finance — Revenue", ("invoice_id",), """
        invoice_id string
        account_id string
        subscription_id string
        issue_date date
        due_date date
        paid_date date confidential
        amount_usd decimal(12,2) confidential
        currency string public
        status string confidential"""),
    Dataset("usage_daily", "Product Analytics", ("usage_date", "account_id", "product_code"), """
        usage_date date public
        account_id string
        product_code string public
        active_users int confidential
        sessions int confidential
        api_calls int confidential
        storage_gb decimal(12,3) confidential
        avg_latency_ms int
        error_count int"""),
    Dataset("ai_usage_event", "Information Technology", ("event_id",), """
        event_id string
        event_ts timestamp_ntz
        employee_id string restricted
        department_code string
        region string
        model string
        feature string
        prompt_tokens int confidential
        completion_tokens int confidential
        cost_usd decimal(14,6) confidential
        latency_ms int
        flagged_by_policy boolean restricted"""),
    Dataset("fin_budget", "Financial Planning & Analysis", ("budget_id",), """
        budget_id string
        fiscal_period string public
        fiscal_year smallint public
        fiscal_quarter smallint public
        cost_center string
        department_code string
        gl_account string
        gl_account_name string public
        budget_usd decimal(14,2) confidential
        approved_by string confidential
        approved_date date confidential"""),
    Dataset("fin_actual", "Financial Planning & Analysis", ("actual_id",), """
        actual_id string
        fiscal_period string public
        posting_date date
        cost_center string
        department_code string
        gl_account string
        gl_account_name string public
        amount_usd decimal(14,2) confidential
        vendor string confidential
        description string confidential
        posted_by string confidential"""),
    Dataset("sec_access_event", "Information Security", ("event_id",), """
        event_id string
        event_ts timestamp_ntz
        employee_id string restricted
        department_code string
        system string
        action string
        resource string confidential
        source_ip string restricted
        source_country string confidential
        result string
        mfa_used boolean confidential""", retention_days=180),
]

DATASETS: dict[str, Dataset] = {d.name: d for d in _DATASETS}


def catalog() -> str:
    """The registry as Markdown: a section for each dataset and a row for each column."""
    out = ["# Data catalog"]
    for d in DATASETS.values():
        keep = f"{d.retention_days} days" if d.retention_days else "not limited"
        out += ["", f"## {d.name}", "", f"Steward: {d.steward}. Key: {', '.join(d.key)}. Highest tier: {d.max_tier}. Retention: {keep}.", ""]
        out += ["| Column | Type | Tier |", "|-|-|-|", *[f"| {c} | {kind} | {d.tiers[c]} |" for c, kind in d.columns.items()]]
    return "\n".join(out) + "\n"
