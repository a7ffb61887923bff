"""A made-up company as an extract, with known defects: every value is a hash of the seed and the row's number, so any number
of tasks gives the same rows."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fiscal_period
from lodestrata.plans.rules import RATES, REGIONS, expected_cost, region_of, target_key
from lodestrata.sources import extract
from lodestrata.sources.registry import DATASETS

VERSION = "1"
DEFAULT_SEED, DEFAULT_DAY = 1789, dt.date(2026, 6, 30)


@dataclass(frozen=True)
class Scale:
    """Employees, accounts, days of usage, and days of event logs."""

    staff: int
    accounts: int
    days: int
    log_days: int


SCALES = {"small": Scale(60, 45, 120, 45), "full": Scale(800, 1100, 912, 45)}
DEPARTMENTS = [
    ("ENG", "Engineering", "CC-110"), ("PRD", "Product", "CC-120"), ("SAL", "Sales", "CC-210"), ("MKT", "Marketing", "CC-220"), ("SUP", "Support", "CC-230"),
    ("FIN", "Finance", "CC-310"), ("PPL", "People", "CC-320"), ("SEC", "Security", "CC-410"), ("OPS", "Operations", "CC-420"),
]
PRODUCTS = [("PR-CORE", "Core"), ("PR-FLOW", "Flow"), ("PR-SIGHT", "Sight"), ("PR-VAULT", "Vault")]
ACCOUNTS_GL = [(f"{6000 + 100 * i}", name) for i, name in enumerate(["Salaries", "Benefits", "Travel", "Software", "Cloud", "Facilities", "Training", "Marketing", "Services", "Equipment"])]
STAGES = ["Prospect", "Qualified", "Proposal", "Closed Won", "Closed Lost"]
FIRST = ["Ada", "Ben", "Cleo", "Dov", "Ema", "Finn", "Gia", "Hal", "Ines", "Jon", "Kai", "Lea"]
LAST = ["Abel", "Berg", "Cole", "Dahl", "Esk", "Frost", "Gray", "Holm", "Ivers", "Jansen", "Kern", "Lund"]


class World:
    """Tables of a company of some scale, by dataset name; typed, and without defects."""

    def __init__(self, spark: SparkSession, scale: Scale, seed: int, day: dt.date):
        self.spark, self.scale, self.seed = spark, scale, seed
        self.day = F.lit(day.isoformat()).cast("date")
        self.people = self._people()
        self.tables = {name: build() for name, build in {
            "hr_employee_history": self._history, "hr_compensation": self._compensation, "hr_performance_review": self._reviews, "crm_account": self._accounts,
            "crm_subscription": self._subscriptions, "crm_opportunity": self._opportunities, "crm_invoice": self._invoices, "usage_daily": self._usage,
            "ai_usage_event": self._ai_events, "fin_budget": self._budget, "fin_actual": self._actuals, "sec_access_event": self._access_events}.items()}

    def u(self, stream: str, *parts: str) -> Column:
        """Uniform in [0, 1), of a named stream and columns."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(stream), *parts), F.lit(1_000_000)) / 1e6

    def number(self, stream: str, low: int, high: int, *parts: str) -> Column:
        return (low + F.floor(self.u(stream, *parts) * (high - low + 1))).cast("int")

    def pick(self, stream: str, values: list, *parts: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.number(stream, 1, len(values), *parts))

    @staticmethod
    def ident(prefix: str, digits: int, n: Column | str) -> Column:
        return F.concat(F.lit(prefix), F.lpad(F.col(n).cast("string") if isinstance(n, str) else n.cast("string"), digits, "0"))

    @staticmethod
    def of(pairs: list[tuple], column: int, index: str) -> Column:
        return F.element_at(F.array(*[F.lit(p[column]) for p in pairs]), F.col(index) + 1)

    def _people(self) -> DataFrame:
        p = self.spark.range(1, self.scale.staff + 1).withColumnRenamed("id", "n")
        p = p.withColumn("hire_date", F.date_sub(self.day, self.number("hired", 400, 1800, "n"))).withColumn("dept", F.pmod("n", F.lit(len(DEPARTMENTS))).cast("int"))
        leaves = F.date_add("hire_date", (120 + F.floor(self.u("left", "n") * (F.datediff(self.day, "hire_date") - 120))).cast("int"))
        p = p.withColumn("termination_date", F.when((F.col("n") > 1) & (self.u("leaves", "n") < 0.15), leaves)).withColumn("spans", self.number("spans", 1, 3, "n"))
        p = p.withColumn("span_days", F.floor(F.datediff(F.coalesce("termination_date", self.day), "hire_date") / F.col("spans")).cast("int"))
        p = p.withColumn("region", self.pick("region", ["Americas", "EMEA", "APAC"], "n")).withColumn("level", self.number("level", 1, 6, "n"))
        return p.withColumn("employee_id", self.ident("E", 5, "n")).withColumn("manager", F.when(F.col("n") > 1, self.ident("E", 5, F.pmod("n", F.lit(max(1, self.scale.staff // 10))) + 1)))

    def _versions(self) -> DataFrame:
        v = self.people.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).withColumn("valid_from", F.date_add("hire_date", F.col("k") * F.col("span_days")))
        last = F.col("k") == F.col("spans") - 1
        return v.withColumn("last", last).withColumn("valid_to", F.when(last, F.col("termination_date")).otherwise(F.date_add("hire_date", (F.col("k") + 1) * F.col("span_days"))))

    def _history(self) -> DataFrame:
        v = self._versions().withColumn("first_name", self.pick("first", FIRST, "n")).withColumn("last_name", self.pick("last", LAST, "n"))
        return v.select(
            "employee_id", "valid_from", "valid_to", "first_name", "last_name", F.concat(F.lower("employee_id"), F.lit("@example.com")).alias("work_email"), "region", F.concat("region", F.lit(" office")).alias("location"),
            self.of(DEPARTMENTS, 0, "dept").alias("department_code"), self.of(DEPARTMENTS, 1, "dept").alias("department_name"), (F.col("level") + F.col("k")).cast("smallint").alias("job_level"),
            F.concat(F.lit("Level "), (F.col("level") + F.col("k")).cast("string")).alias("job_title"), F.col("manager").alias("manager_id"), F.lit("Full-time").alias("employment_type"),
            F.when(F.col("k") == 0, "Hire").otherwise("Promotion").alias("change_reason"), "hire_date", F.when(F.col("last"), F.col("termination_date")).alias("termination_date"),
            F.when(F.col("last") & F.col("termination_date").isNotNull(), self.pick("reason", ["Resigned", "Retired", "Contract ended"], "n")).alias("termination_reason"),
        )

    def _compensation(self) -> DataFrame:
        pay = (60000 + 12000 * (F.col("level") + F.col("k")) + 100 * self.number("pay", 0, 60, "n", "k")).cast("decimal(12,2)")
        return self._versions().select(
            self.ident("C", 7, F.col("n") * 10 + F.col("k")).alias("compensation_id"), "employee_id", F.col("valid_from").alias("effective_from"), F.col("valid_to").alias("effective_to"),
            F.concat(F.lit("G"), (F.col("level") + F.col("k")).cast("string")).alias("pay_grade"), pay.alias("annual_salary_usd"), (self.number("bonus", 5, 25, "n", "k") / 100).cast("decimal(5,4)").alias("bonus_target_pct"),
            self.number("equity", 0, 500, "n", "k").alias("equity_units"), F.lit("USD").alias("currency"), F.when(F.col("k") == 0, "Hire").otherwise("Promotion").alias("change_reason"),
        )

    def _reviews(self) -> DataFrame:
        v = self._versions().withColumn("day", F.date_add("valid_from", 30)).withColumn("r", self.number("rating", 1, 5, "n", "k"))
        return v.select(
            self.ident("R", 7, F.col("n") * 10 + F.col("k")).alias("review_id"), "employee_id", F.concat(F.year("day").cast("string"), F.lit("-H"), F.when(F.month("day") < 7, "1").otherwise("2")).alias("review_period"),
            F.col("manager").alias("reviewer_id"), F.col("r").cast("smallint").alias("rating"), F.element_at(F.array(*[F.lit(x) for x in ("Low", "Fair", "Good", "Strong", "Top")]), F.col("r")).alias("rating_label"),
            (F.col("r") > 4).alias("promotion_recommended"), F.col("day").alias("submitted_date"),
        )

    def _customers(self) -> DataFrame:
        a = self.spark.range(1, self.scale.accounts + 1).withColumnRenamed("id", "a").withColumn("account_id", self.ident("A", 5, "a"))
        return a.withColumn("created_date", F.date_sub(self.day, self.number("since", 400, 1500, "a"))).withColumn("owner", self.ident("E", 5, self.number("owner", 1, self.scale.staff, "a")))

    def _accounts(self) -> DataFrame:
        a = self._customers().withColumn("churn_date", F.when(self.u("churn", "a") < 0.1, F.date_sub(self.day, self.number("gone", 1, 300, "a"))))
        return a.select(
            "account_id", F.concat(F.lit("Account "), F.col("a").cast("string")).alias("account_name"), self.pick("where", ["Americas", "EMEA", "APAC"], "a").alias("region"),
            self.pick("segment", ["SMB", "Mid-Market", "Enterprise"], "a").alias("segment"), self.pick("industry", ["Retail", "Health", "Energy", "Media"], "a").alias("industry"), "created_date",
            F.col("owner").alias("owner_employee_id"), F.when(F.col("churn_date").isNull(), "Active").otherwise("Churned").alias("status"), "churn_date",
        )

    def _contracts(self) -> DataFrame:
        c = self._customers().withColumn("k", F.explode(F.sequence(F.lit(0), self.number("contracts", 0, 2, "a")))).withColumn("s", (F.col("a") * 3 + F.col("k")).cast("long"))
        c = c.withColumn("p", F.pmod(F.col("a") + F.col("k"), F.lit(len(PRODUCTS))).cast("int")).withColumn("start_date", F.date_add("created_date", 10 + 100 * F.col("k")))
        return c.withColumn("arr", (1000 * self.number("arr", 5, 120, "s")).cast("decimal(12,2)"))

    def _subscriptions(self) -> DataFrame:
        return self._contracts().select(
            self.ident("S", 6, "s").alias("subscription_id"), "account_id", self.of(PRODUCTS, 0, "p").alias("product_code"), self.of(PRODUCTS, 1, "p").alias("product_name"), "start_date",
            F.when(self.u("ends", "s") < 0.3, F.date_add("start_date", 365)).alias("end_date"), self.number("seats", 5, 400, "s").alias("seats"), F.col("arr").alias("arr_usd"),
            self.pick("billing", ["Monthly", "Annual"], "s").alias("billing_frequency"),
        )

    def _opportunities(self) -> DataFrame:
        o = self._customers().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("o", (F.col("a") * 6 + F.col("k")).cast("long"))
        o = o.withColumn("created", F.date_sub(self.day, self.number("opened", 100, 390, "o"))).withColumn("stage", self.pick("stage", STAGES, "o")).withColumn("closed", F.col("stage").like("Closed%"))
        return o.select(
            self.ident("OPP", 6, "o").alias("opportunity_id"), "account_id", F.col("owner").alias("owner_employee_id"), self.pick("sold", [p[0] for p in PRODUCTS], "o").alias("product_code"),
            self.pick("kind", ["New", "Renewal", "Expansion"], "o").alias("opportunity_type"), F.col("created").alias("created_date"), F.when(F.col("closed"), F.date_add("created", self.number("took", 10, 90, "o"))).alias("close_date"),
            "stage", (500 * self.number("amount", 4, 200, "o")).cast("decimal(12,2)").alias("amount_usd"), F.when(F.col("closed"), F.when(F.col("stage") == "Closed Won", 100).otherwise(0)).otherwise(self.number("odds", 10, 80, "o")).cast("smallint").alias("probability_pct"),
            F.when(F.col("closed"), F.col("stage") == "Closed Won").alias("is_won"),
        )

    def _invoices(self) -> DataFrame:
        i = self._contracts().withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("i", F.col("s") * 4 + F.col("q")).withColumn("issue_date", F.date_add("start_date", 91 * F.col("q")))
        i = i.withColumn("status", F.when(self.u("credit", "i") < 0.04, "Credit Note").when(self.u("paid", "i") < 0.8, "Paid").otherwise("Open"))
        amount = (F.col("arr") / 4).cast("decimal(12,2)")
        return i.select(
            self.ident("INV", 7, "i").alias("invoice_id"), "account_id", self.ident("S", 6, "s").alias("subscription_id"), "issue_date", F.date_add("issue_date", 30).alias("due_date"),
            F.when(F.col("status") == "Paid", F.date_add("issue_date", self.number("pays", 5, 45, "i"))).alias("paid_date"), F.when(F.col("status") == "Credit Note", -amount).otherwise(amount).alias("amount_usd"),
            F.lit("USD").alias("currency"), "status",
        )

    def _usage(self) -> DataFrame:
        n = self.scale.accounts
        d = self.spark.range(self.scale.days * n).select((F.col("id") % n + 1).alias("a"), F.floor(F.col("id") / n).cast("int").alias("ago"), "id")
        d = d.withColumn("users", self.number("users", 0, 200, "id")).where("users > 0").withColumn("p", F.pmod("a", F.lit(len(PRODUCTS))).cast("int"))
        return d.select(
            F.date_sub(self.day, F.col("ago")).alias("usage_date"), self.ident("A", 5, "a").alias("account_id"), self.of(PRODUCTS, 0, "p").alias("product_code"), F.col("users").alias("active_users"),
            (F.col("users") * self.number("sessions", 1, 6, "id")).alias("sessions"), (F.col("users") * self.number("calls", 10, 90, "id")).alias("api_calls"), (F.col("users") * self.u("gb", "id")).cast("decimal(12,3)").alias("storage_gb"),
            self.number("latency", 20, 400, "id").alias("avg_latency_ms"), self.number("errors", 0, 9, "id").alias("error_count"),
        )

    def _log(self, per_day: int) -> DataFrame:
        """Events of people who have not left, hours apart from each other."""
        staff = self.scale.staff
        e = self.spark.range(self.scale.log_days * staff * per_day).select("id", (F.col("id") % staff + 1).alias("n"), F.floor(F.col("id") / staff).cast("int").alias("slot"))
        day = F.date_sub(self.day, F.floor(F.col("slot") / per_day).cast("int"))
        at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=9 + 5 * F.pmod("slot", F.lit(per_day)), mins=self.number("minute", 0, 59, "id"))
        return e.withColumn("day", day).withColumn("event_ts", at).join(self.people.where("termination_date is null").drop("hire_date"), "n")

    def _ai_events(self) -> DataFrame:
        e = self._log(2).withColumn("model", self.pick("model", list(RATES), "id")).withColumn("pt", self.number("prompt", 100, 4000, "id")).withColumn("ct", self.number("answer", 50, 2000, "id"))
        return e.select(
            self.ident("AI", 8, "id").alias("event_id"), "event_ts", "employee_id", self.of(DEPARTMENTS, 0, "dept").alias("department_code"), "region", "model", self.pick("feature", ["chat", "search", "code"], "id").alias("feature"),
            F.col("pt").alias("prompt_tokens"), F.col("ct").alias("completion_tokens"), F.round(expected_cost(F.col("pt"), F.col("ct"), F.col("model")), 6).cast("decimal(14,6)").alias("cost_usd"),
            self.number("wait", 200, 5000, "id").alias("latency_ms"), (self.u("policy", "id") < 0.02).alias("flagged_by_policy"),
        )

    def _access_events(self) -> DataFrame:
        return self._log(2).select(
            self.ident("SEC", 8, "id").alias("event_id"), "event_ts", "employee_id", self.of(DEPARTMENTS, 0, "dept").alias("department_code"), self.pick("system", ["erp", "crm", "vpn"], "id").alias("system"),
            self.pick("action", ["LOGIN", "READ", "EXPORT"], "id").alias("action"), F.concat(F.lit("/r/"), self.number("resource", 1, 50, "id").cast("string")).alias("resource"),
            F.concat(F.lit("10.0."), self.number("net", 0, 255, "id").cast("string"), F.lit("."), self.number("host", 1, 254, "id").cast("string")).alias("source_ip"), _country(F.col("region")).alias("source_country"),
            F.when(self.u("fails", "id") < 0.05, "FAILURE").otherwise("SUCCESS").alias("result"), (self.u("mfa", "id") < 0.9).alias("mfa_used"),
        )

    def _ledger(self, per_month: int) -> DataFrame:
        months = F.explode(F.sequence(F.trunc(F.date_sub(self.day, self.scale.days), "MM"), F.trunc(self.day, "MM"), F.expr("interval 1 month")))
        g = self.spark.range(len(DEPARTMENTS) * len(ACCOUNTS_GL) * per_month).select(F.pmod("id", F.lit(len(DEPARTMENTS))).cast("int").alias("dept"), F.pmod(F.floor(F.col("id") / len(DEPARTMENTS)), F.lit(len(ACCOUNTS_GL))).cast("int").alias("gl"), "id", months.alias("month"))
        g = g.withColumn("line", F.months_between("month", F.lit("2000-01-01").cast("date")).cast("long") * (len(DEPARTMENTS) * len(ACCOUNTS_GL) * per_month) + F.col("id"))
        for name, pairs, column, index in (("cost_center", DEPARTMENTS, 2, "dept"), ("department_code", DEPARTMENTS, 0, "dept"), ("gl_account", ACCOUNTS_GL, 0, "gl"), ("gl_account_name", ACCOUNTS_GL, 1, "gl")):
            g = g.withColumn(name, self.of(pairs, column, index))
        return g

    def _budget(self) -> DataFrame:
        approved = F.make_date(F.year("month") - 1, F.lit(11), F.lit(15))
        return self._ledger(1).select(
            self.ident("B", 7, "line").alias("budget_id"), fiscal_period(F.col("month")).alias("fiscal_period"), F.year("month").cast("smallint").alias("fiscal_year"), F.quarter("month").cast("smallint").alias("fiscal_quarter"), "cost_center",
            "department_code", "gl_account", "gl_account_name", (250 * self.number("budget", 20, 400, "line")).cast("decimal(14,2)").alias("budget_usd"), F.lit("E00001").alias("approved_by"), approved.alias("approved_date"),
        )

    def _actuals(self) -> DataFrame:
        # the poster is one of the staff
        posted = F.date_add("month", self.number("posted", 0, 26, "line"))
        return self._ledger(2).select(
            self.ident("GL", 8, "line").alias("actual_id"), fiscal_period(F.col("month")).alias("fiscal_period"), posted.alias("posting_date"), "cost_center", "department_code", "gl_account", "gl_account_name",
            (125 * self.number("spent", 15, 420, "line")).cast("decimal(14,2)").alias("amount_usd"), F.concat(F.lit("Vendor "), self.number("vendor", 1, 40, "line").cast("string")).alias("vendor"),
            F.concat(F.col("gl_account_name"), F.lit(" expense")).alias("description"), self.ident("E", 5, self.number("poster", 1, self.scale.staff, "line")).alias("posted_by"),
        )


def _country(region: Column, other: bool = False) -> Column:
    """A country of the region, or of another one."""
    first = {}
    for country, place in REGIONS.items():
        first.setdefault(place, country)
    names = list(first)
    out = F.lit(None).cast("string")
    for i, name in enumerate(names):
        out = F.when(region == name, first[names[(i + 1) % len(names)] if other else name]).otherwise(out)
    return out


class Defects:
    """Puts known defects into a world's tables and notes the keys that a rule must find.

    A row takes at most one defect.  The rows of a defect are those whose hashed keys are smallest, a handful by its definition.
    """

    def __init__(self, world: World):
        self.world, self.tables, self.noted = world, dict(world.tables), []
        self.used: dict[str, set[str]] = {name: set() for name in DATASETS}

    def choose(self, code: str, dataset: str, n: int, where: str = "true") -> list[str]:
        """The keys of up to n rows without a defect yet."""
        rows = self.tables[dataset].where(where).select(target_key(dataset).alias("key")).where(~F.col("key").isin(*self.used[dataset]) if self.used[dataset] else F.lit(True))
        keys = [r.key for r in rows.orderBy(F.xxhash64(F.lit(self.world.seed), F.lit(code), "key"), "key").limit(n).collect()]
        self.used[dataset] |= set(keys)
        return keys

    def note(self, code: str, dataset: str, rows: DataFrame) -> None:
        keys = [r.key for r in rows.select(target_key(dataset).alias("key")).collect()]
        self.used[dataset] |= set(keys)
        self.noted += [{"defect": code, "dataset": dataset, "target_key": k, "detail": "seeded"} for k in keys]

    def change(self, code: str, dataset: str, n: int, changes: dict[str, Column], where: str = "true") -> None:
        """Chosen rows take new values."""
        hit = target_key(dataset).isin(*self.choose(code, dataset, n, where))
        df, kinds = self.tables[dataset], dict(self.tables[dataset].dtypes)
        changed = df.where(hit).withColumns({c: v.cast(kinds[c]) for c, v in changes.items()})
        self.note(code, dataset, changed)
        self.tables[dataset] = df.where(~hit).unionByName(changed)

    def add(self, code: str, dataset: str, n: int, changes: dict[str, Column], where: str = "true") -> None:
        """Chosen rows have copies with new values beside them."""
        hit = target_key(dataset).isin(*self.choose(code, dataset, n, where))
        df, kinds = self.tables[dataset], dict(self.tables[dataset].dtypes)
        added = df.where(hit).withColumns({c: v.cast(kinds[c]) for c, v in changes.items()})
        self.note(code, dataset, added)
        self.tables[dataset] = df.unionByName(added)

    def all(self) -> tuple[dict[str, DataFrame], list[dict]]:
        col, ghost = F.col, lambda prefix, c: F.concat(F.lit(prefix), F.substring(c, -4, 4))
        self.change("HR_ORPHAN_MANAGER", "hr_employee_history", 4, {"manager_id": ghost("E9", "employee_id")}, "manager_id is not null")
        self.change("HR_OVERLAPPING_SPAN", "hr_employee_history", 3, {"valid_from": F.date_sub("valid_from", 20)}, "valid_from > hire_date and termination_date is null")
        self.change("HR_MISSING_TERMINATION_REASON", "hr_employee_history", 3, {"termination_reason": F.lit(None)}, "termination_date is not null")
        self.change("HR_SALARY_OUTLIER", "hr_compensation", 3, {"annual_salary_usd": col("annual_salary_usd") * 20})
        self.add("CRM_DUPLICATE_ACCOUNT", "crm_account", 2, {"account_name": F.concat("account_name", F.lit(" Inc"))})
        self.change("CRM_CLOSED_BEFORE_CREATED", "crm_opportunity", 3, {"close_date": F.date_sub("created_date", 10)}, "close_date is not null")
        self.change("CRM_ORPHAN_OPPORTUNITY", "crm_opportunity", 3, {"account_id": ghost("A9", "account_id")})
        self.change("CRM_NEGATIVE_INVOICE", "crm_invoice", 3, {"amount_usd": -col("amount_usd")}, "status <> 'Credit Note'")
        self.add("USAGE_DUPLICATE_EVENT", "usage_daily", 6, {"active_users": col("active_users") + 1})
        self.change("USAGE_NEGATIVE_SESSIONS", "usage_daily", 4, {"sessions": -col("sessions")})
        self.change("USAGE_UNKNOWN_ACCOUNT", "usage_daily", 4, {"account_id": ghost("A9", "account_id")})
        self.change("AI_COST_MISMATCH", "ai_usage_event", 5, {"cost_usd": col("cost_usd") * 3})
        self.change("AI_UNKNOWN_MODEL", "ai_usage_event", 4, {"model": F.lit("nova-preview")})
        self.change("SEC_MISSING_ACTOR", "sec_access_event", 4, {"employee_id": F.lit(None)})
        again = F.regexp_replace("event_id", "^SEC", "SEC9")
        self.add("SEC_IMPOSSIBLE_TRAVEL", "sec_access_event", 3, {"event_id": again, "event_ts": col("event_ts") + F.expr("interval 30 minutes"), "action": F.lit("LOGIN"), "result": F.lit("SUCCESS"), "source_country": _country(region_of(col("source_country")), other=True)}, "employee_id is not null")
        self._late_logins(4)
        self.change("FIN_ORPHAN_COST_CENTER", "fin_actual", 3, {"cost_center": F.lit("CC-9001")})
        self.change("FIN_CLOSED_PERIOD_POSTING", "fin_actual", 3, {"fiscal_period": fiscal_period(F.add_months("posting_date", -2))})
        self.change("FIN_UNAUTHORISED_APPROVER", "fin_budget", 2, {"approved_by": F.lit("E99001")})
        return self.tables, self.noted

    def _late_logins(self, n: int) -> None:
        gone = self.tables["hr_employee_history"].where("termination_date is not null").orderBy("employee_id").limit(n)
        late = gone.select(
            F.concat(F.lit("SEC8"), F.substring("employee_id", 2, 5)).alias("event_id"), (F.col("termination_date").cast("timestamp_ntz") + F.expr("interval 3 days 9 hours")).alias("event_ts"), "employee_id", "department_code",
            F.lit("vpn").alias("system"), F.lit("LOGIN").alias("action"), F.lit("/r/1").alias("resource"), F.lit("10.1.1.1").alias("source_ip"), _country(F.col("region")).alias("source_country"), F.lit("SUCCESS").alias("result"), F.lit(False).alias("mfa_used"),
        )
        self.note("SEC_LOGIN_AFTER_TERMINATION", "sec_access_event", late)
        self.tables["sec_access_event"] = self.tables["sec_access_event"].unionByName(late)


def generate(spark: SparkSession, folder: str, scale: str = "small", seed: int = DEFAULT_SEED, day: dt.date = DEFAULT_DAY, defects: bool = True) -> dict:
    """Write an extract of twelve files and a manifest; the same arguments give the same bytes."""
    os.makedirs(folder, exist_ok=True)
    world = World(spark, SCALES[scale], seed, day)
    tables, noted = Defects(world).all() if defects else (world.tables, [])
    files = [extract.write_dataset(tables[name], name, folder) for name in DATASETS]
    start = day - dt.timedelta(days=SCALES[scale].days)
    return extract.write_manifest(folder, files, noted, generator_version=VERSION, seed=seed, scale=scale, as_of_date=day.isoformat(), start_date=start.isoformat(), defects_enabled=defects)
