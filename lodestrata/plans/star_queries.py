"""The star schema's rules, dimensions, facts and reports over the driver's tables, which stand in for landed datasets.

The stand-ins are SQL that Spark and DuckDB both read, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.work import work_table
from lodestrata.plans import policy, rules, sql_api, views, warehouse
from lodestrata.plans.lazy import LazyTables
from lodestrata.sources.registry import DATASETS

_PERIOD = "concat('FY', year({0}), '-M', lpad(CAST(month({0}) AS STRING), 2, '0'))"
_DEPT = "substr(o_orderpriority, 1, 1)"

# orders and line items are 5479 days later here, so that they lie in the calendar, which starts in 2010
SOURCES = {
    "hr_employee_history": """SELECT concat('E', c) AS employee_id, d AS valid_from, CASE WHEN k % 9 = 0 THEN NULL ELSE d + CAST(k % 400 + 1 AS INT) END AS valid_to, concat('F', c) AS first_name,
        CASE WHEN c % 10 = 0 THEN NULL ELSE concat('L', c) END AS last_name, concat('e', c, '@example.com') AS work_email, CASE k % 3 WHEN 0 THEN 'EMEA' WHEN 1 THEN 'Americas' ELSE 'APAC' END AS region, concat('Site ', k % 12) AS location, substr(p, 1, 1) AS department_code, p AS department_name, CAST(k % 7 + 1 AS SMALLINT) AS job_level,
        concat('Title ', k % 20) AS job_title, concat('E', c + 1) AS manager_id, CASE WHEN k % 6 = 0 THEN 'Contract' ELSE 'Full-time' END AS employment_type, CASE WHEN k % 2 = 0 THEN 'Hire' ELSE 'Transfer' END AS change_reason, d AS hire_date, CASE WHEN k % 4 = 0 THEN d + CAST(k % 400 + 1 AS INT) ELSE NULL END AS termination_date,
        CASE WHEN k % 8 = 0 THEN 'Left' ELSE NULL END AS termination_reason
        FROM (SELECT o_custkey AS c, (CAST(o_orderdate AS DATE) + 5479) AS d, min(o_orderkey) AS k, max(o_orderpriority) AS p FROM {orders} GROUP BY 1, 2) AS v""",
    "hr_compensation": """SELECT concat('C', o_orderkey) AS compensation_id, concat('E', o_custkey) AS employee_id, (CAST(o_orderdate AS DATE) + 5479) AS effective_from, concat('G', o_orderkey % 9) AS pay_grade,
        CAST(o_totalprice * (CASE WHEN o_orderkey % 500 = 0 THEN 10 ELSE 1 END) AS DECIMAL(12, 2)) AS annual_salary_usd, CAST((o_orderkey % 40) / 100.0 AS DECIMAL(5, 4)) AS bonus_target_pct, CAST(o_orderkey % 1000 AS INT) AS equity_units, CASE WHEN o_orderkey % 4 = 0 THEN 'GBP' ELSE 'USD' END AS currency, CASE WHEN o_orderkey % 3 = 0 THEN 'Merit' ELSE 'Hire' END AS change_reason FROM {orders}""",
    "hr_performance_review": """SELECT concat('R', o_orderkey) AS review_id, concat('E', o_custkey) AS employee_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('E', o_custkey + 7) END AS reviewer_id,
        (CAST(o_orderdate AS DATE) + 5479) + 30 AS submitted_date, CASE WHEN o_orderkey % 2 = 0 THEN 'H1' ELSE 'H2' END AS review_period, CAST(o_orderkey % 5 + 1 AS SMALLINT) AS rating, CASE WHEN o_orderkey % 5 < 2 THEN 'Below' WHEN o_orderkey % 5 = 2 THEN 'Good' ELSE 'Above' END AS rating_label, o_orderkey % 9 = 0 AS promotion_recommended FROM {orders}""",
    "crm_account": """SELECT concat('A', c_custkey) AS account_id, concat(c_name, CASE WHEN n = 2 THEN ' Inc' ELSE '' END) AS account_name, CASE c_custkey % 3 WHEN 0 THEN 'EMEA' WHEN 1 THEN 'Americas' ELSE 'APAC' END AS region, c_mktsegment AS segment, concat('industry ', c_custkey % 8) AS industry, CAST('2020-01-01' AS DATE) + CAST(c_custkey % 300 AS INT) AS created_date,
        concat('E', c_custkey) AS owner_employee_id, CASE WHEN c_custkey % 4 = 0 THEN 'Churned' ELSE 'Active' END AS status, CASE WHEN c_custkey % 6 = 0 THEN CAST('2021-01-01' AS DATE) ELSE NULL END AS churn_date
        FROM {customer} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) AS twice WHERE c_custkey % 11 <> 0 AND (n = 1 OR c_custkey % 50 = 0)""",
    "crm_subscription": f"""SELECT concat('S', o_orderkey) AS subscription_id, concat('A', o_custkey) AS account_id, concat('P', {_DEPT}) AS product_code, o_orderpriority AS product_name, (CAST(o_orderdate AS DATE) + 5479) AS start_date,
        CASE WHEN o_orderkey % 3 = 0 THEN (CAST(o_orderdate AS DATE) + 5479) + CAST(o_orderkey % 300 AS INT) ELSE NULL END AS end_date, CAST(o_orderkey % 90 + 1 AS INT) AS seats, CAST(o_totalprice AS DECIMAL(12, 2)) AS arr_usd, CASE WHEN o_orderkey % 2 = 0 THEN 'Monthly' ELSE 'Annual' END AS billing_frequency FROM {{orders}}""",
    "crm_opportunity": f"""SELECT concat('O', o_orderkey) AS opportunity_id, concat('A', o_custkey) AS account_id, concat('E', o_custkey) AS owner_employee_id, concat('P', {_DEPT}) AS product_code, CASE WHEN o_orderkey % 3 = 0 THEN 'Renewal' ELSE 'New' END AS opportunity_type,
        (CAST(o_orderdate AS DATE) + 5479) AS created_date, CASE WHEN o_orderstatus = 'F' THEN (CAST(o_orderdate AS DATE) + 5479) + CAST(o_orderkey % 40 - 3 AS INT) ELSE NULL END AS close_date,
        CASE WHEN o_orderstatus = 'F' THEN 'Closed Won' WHEN o_orderstatus = 'O' THEN 'Proposal' ELSE 'Prospect' END AS stage, CAST(o_totalprice AS DECIMAL(12, 2)) AS amount_usd, CAST(o_orderkey % 101 AS SMALLINT) AS probability_pct, o_orderstatus = 'F' AS is_won FROM {{orders}}""",
    "crm_invoice": """SELECT concat('I', o_orderkey) AS invoice_id, concat('A', o_custkey) AS account_id, concat('S', o_orderkey) AS subscription_id, (CAST(o_orderdate AS DATE) + 5479) AS issue_date, (CAST(o_orderdate AS DATE) + 5479) + 30 AS due_date,
        CASE WHEN o_orderkey % 2 = 0 THEN (CAST(o_orderdate AS DATE) + 5479) + 9 ELSE NULL END AS paid_date, CAST(o_totalprice * (CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 1 END) AS DECIMAL(12, 2)) AS amount_usd, 'USD' AS currency,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Credit Note' WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'Paid' END AS status FROM {orders}""",
    "usage_daily": """SELECT (CAST(l_shipdate AS DATE) + 5479) AS usage_date, concat('A', l_suppkey) AS account_id, concat('P', l_linenumber) AS product_code, CAST(l_quantity AS INT) AS active_users, CAST(l_quantity AS INT) - 2 AS sessions,
        CAST(l_partkey AS INT) AS api_calls, CAST(l_tax AS DECIMAL(12, 3)) AS storage_gb, CAST(l_orderkey % 500 AS INT) AS avg_latency_ms, CAST(l_linenumber AS INT) AS error_count FROM {lineitem}""",
    "ai_usage_event": """SELECT concat('I', event_id) AS event_id, ts AS event_ts, concat('E', user_id) AS employee_id, CAST(user_id % 6 + 1 AS STRING) AS department_code,
        CASE event_type WHEN 'click' THEN 'atlas-large' WHEN 'view' THEN 'orion-lite' WHEN 'signup' THEN 'orion-pro' WHEN 'error' THEN NULL ELSE 'nova' END AS model, CASE WHEN event_id % 3 = 0 THEN 'search' ELSE 'chat' END AS feature, CAST(event_id % 4000 AS INT) AS prompt_tokens,
        CAST(event_id % 1500 AS INT) AS completion_tokens, CAST(((event_id % 4000) * 3 + (event_id % 1500) * 15) * (CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END) / 1000000.0 AS DECIMAL(14, 6)) AS cost_usd, CAST(event_id % 900 AS INT) AS latency_ms, event_id % 19 = 0 AS flagged_by_policy FROM {events}""",
    "fin_budget": f"""SELECT concat('B', o_orderkey) AS budget_id, {_PERIOD.format("(CAST(o_orderdate AS DATE) + 5479)")} AS fiscal_period, CAST(year(o_orderdate) + 15 AS SMALLINT) AS fiscal_year, CAST(quarter(o_orderdate) AS SMALLINT) AS fiscal_quarter, concat('CC-', {_DEPT}) AS cost_center,
        {_DEPT} AS department_code, concat('G', o_orderkey % 5) AS gl_account, concat('account ', o_orderkey % 5) AS gl_account_name, CAST(o_totalprice AS DECIMAL(14, 2)) AS budget_usd, concat('E', o_custkey * (CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE 1 END)) AS approved_by, (CAST(o_orderdate AS DATE) + 5479) AS approved_date FROM {{orders}}""",
    "fin_actual": f"""SELECT concat('G', l_orderkey, '-', l_linenumber) AS actual_id, {_PERIOD.format("(CAST(o_orderdate AS DATE) + 5479)")} AS fiscal_period, (CAST(l_shipdate AS DATE) + 5479) AS posting_date, CASE WHEN l_partkey % 100 = 0 THEN 'CC-9' ELSE concat('CC-', {_DEPT}) END AS cost_center,
        {_DEPT} AS department_code, concat('G', l_linenumber) AS gl_account, concat('account ', l_linenumber) AS gl_account_name, CAST(l_extendedprice AS DECIMAL(14, 2)) AS amount_usd, concat('v', l_suppkey) AS vendor, concat('part ', l_partkey) AS description, concat('E', o_custkey) AS posted_by FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "sec_access_event": """SELECT concat('X', event_id) AS event_id, ts AS event_ts, CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('E', user_id) END AS employee_id, CAST(user_id % 6 + 1 AS STRING) AS department_code, CASE WHEN event_id % 3 = 0 THEN 'crm' ELSE 'vpn' END AS system,
        CASE WHEN event_type IN ('click', 'view') THEN 'LOGIN' ELSE 'READ' END AS action, concat('/r/', event_id % 30) AS resource, concat('10.0.', event_id % 200, '.', user_id % 250) AS source_ip, CASE event_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'CA' ELSE 'XX' END AS source_country,
        CASE WHEN event_id % 10 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS result, event_id % 7 <> 0 AS mfa_used FROM {events}""",
}
_TABLES = ("orders", "lineitem", "customer", "events")

#: Tables of the star schema by natural keys, in DuckDB's SQL.
_STAR = {
    "dim_department": "SELECT DISTINCT department_code, department_name, cost_center FROM hr_employee_history LEFT JOIN (SELECT department_code, min(cost_center) AS cost_center FROM fin_budget GROUP BY 1) USING (department_code)",
    "overlapped": "SELECT DISTINCT l.employee_id, l.valid_from FROM hr_employee_history l JOIN hr_employee_history e ON e.employee_id = l.employee_id AND e.valid_from < l.valid_from AND (e.valid_to IS NULL OR l.valid_from < e.valid_to)",
    "dim_employee": """SELECT employee_id, valid_from, valid_to, row_number() OVER (PARTITION BY employee_id ORDER BY valid_from DESC) = 1 AS is_current, first_name || ' ' || last_name AS full_name, region, department_code, department_name,
        CASE WHEN manager_id IN (SELECT employee_id FROM hr_employee_history) THEN manager_id END AS manager_employee_id, hire_date, termination_date, termination_reason FROM hr_employee_history ANTI JOIN overlapped USING (employee_id, valid_from)""",
    "dim_account": "SELECT account_id, account_name, segment, owner_employee_id, churn_date, churn_date IS NULL AS is_active FROM crm_account QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY account_name, created_date) = 1",
    "dim_product": "SELECT product_code, max(product_name) AS product_name FROM crm_subscription GROUP BY 1",
}
_NEEDS = {"overlapped": ["hr_employee_history"], "dim_department": ["hr_employee_history", "fin_budget"], "dim_employee": ["hr_employee_history", "overlapped"], "dim_account": ["crm_account"], "dim_product": ["crm_subscription"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def landed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stand-ins as typed datasets; columns that a stand-in lacks are null."""
    given = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _TABLES}
    out = {}
    for name, sql in SOURCES.items():
        df = spark.sql(sql, **{n: given[n] for n in _TABLES if "{" + n + "}" in sql})
        out[name] = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in DATASETS[name].columns.items()])
    return out


def star(spark: SparkSession, sf_dir: str, facts: tuple[str, ...] | Mapping[str, Callable] = ()) -> Mapping[str, DataFrame]:
    """Stand-ins, dimensions, and the named facts, or those given with how they are made; a dimension is written when it is first asked
    for, so no plan makes it twice."""
    make = {name: lambda t, df=df: df for name, df in landed(spark, sf_dir).items()}
    make["dim_date"] = lambda t: warehouse.calendar(spark)
    for name in warehouse.DIMENSIONS:
        make[name] = lambda t, name=name: work_table(warehouse.dimension(name, t), name)
    return LazyTables({**make, **(facts if isinstance(facts, Mapping) else {name: warehouse.FACTS[name] for name in facts})})


def _with(select: str, *names: str) -> str:
    """The SELECT with definitions of the stand-ins and star tables that it names, and of those that these need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    plain = {n: n for n in _TABLES}
    return "WITH " + ", ".join(f"{n} AS ({SOURCES[n].format(**plain) if n in SOURCES else _STAR[n]})" for n in ordered) + " " + select


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


_USAGE_KEY = "concat_ws('|', usage_date, account_id, product_code)"
_HR_KEY = "concat_ws('|', employee_id, valid_from)"
_REGION = "CASE WHEN source_country IN ('US', 'CA') THEN 'Americas' WHEN source_country = 'GB' THEN 'EMEA' END"
_NULL = "coalesce({0}::VARCHAR, 'null')"
_COST = "CASE model WHEN 'atlas-large' THEN {0} WHEN 'orion-lite' THEN {1} WHEN 'orion-pro' THEN {2} END::DECIMAL(8, 4)"
# code: (dataset, severity, disposition, key, detail, rows, names)
_RULE_SQL = {
    "HR_OVERLAPPING_SPAN": ("hr_employee_history", "error", "rejected", _HR_KEY, "'starts on ' || valid_from || ', before an earlier span ends'", "FROM overlapped", "overlapped"),
    "HR_ORPHAN_MANAGER": ("hr_employee_history", "warning", "repaired", _HR_KEY, "'no such manager as ' || manager_id", "FROM hr_employee_history WHERE manager_id NOT IN (SELECT employee_id FROM hr_employee_history)", "hr_employee_history"),
    "HR_MISSING_TERMINATION_REASON": ("hr_employee_history", "warning", "flagged", _HR_KEY, "'terminated on ' || termination_date || ' without a reason'", "FROM hr_employee_history WHERE termination_date IS NOT NULL AND termination_reason IS NULL", "hr_employee_history"),
    "HR_SALARY_OUTLIER": ("hr_compensation", "error", "flagged", "compensation_id", "'salary ' || annual_salary_usd || ' where the median is ' || m", "FROM hr_compensation, (SELECT quantile_cont(annual_salary_usd::DOUBLE, 0.5) AS m FROM hr_compensation) WHERE annual_salary_usd::DOUBLE > 5 * m", "hr_compensation"),
    "CRM_DUPLICATE_ACCOUNT": ("crm_account", "error", "rejected", "account_id", "count(*) || ' rows with this key'", "FROM crm_account GROUP BY account_id HAVING count(*) > 1", "crm_account"),
    "CRM_ORPHAN_OPPORTUNITY": ("crm_opportunity", "error", "rejected", "opportunity_id", "'no such account as ' || account_id", "FROM crm_opportunity WHERE account_id NOT IN (SELECT account_id FROM crm_account)", "crm_opportunity", "crm_account"),
    "CRM_CLOSED_BEFORE_CREATED": ("crm_opportunity", "error", "flagged", "opportunity_id", "'closed on ' || close_date || ', created on ' || created_date", "FROM crm_opportunity WHERE close_date < created_date", "crm_opportunity"),
    "CRM_NEGATIVE_INVOICE": ("crm_invoice", "error", "flagged", "invoice_id", f"'amount ' || amount_usd || ' with status ' || {_NULL.format('status')}", "FROM crm_invoice WHERE amount_usd < 0 AND coalesce(status, '') NOT ILIKE '%credit%'", "crm_invoice"),
    "USAGE_DUPLICATE_EVENT": ("usage_daily", "error", "rejected", _USAGE_KEY, "count(*) || ' rows with this key'", "FROM usage_daily GROUP BY usage_date, account_id, product_code HAVING count(*) > 1", "usage_daily"),
    "USAGE_UNKNOWN_ACCOUNT": ("usage_daily", "error", "rejected", _USAGE_KEY, "'no such account as ' || account_id", "FROM (SELECT DISTINCT usage_date, account_id, product_code FROM usage_daily) WHERE account_id NOT IN (SELECT account_id FROM crm_account)", "usage_daily", "crm_account"),
    "USAGE_NEGATIVE_SESSIONS": ("usage_daily", "error", "flagged", _USAGE_KEY, "sessions || ' sessions'", "FROM usage_daily WHERE sessions < 0", "usage_daily"),
    "AI_COST_MISMATCH": ("ai_usage_event", "error", "flagged", "event_id", "'cost ' || cost_usd || ' where tokens make ' || e", f"""FROM (SELECT *, ((prompt_tokens * {_COST.format(0.003, 0.0004, 0.005)} + completion_tokens * {_COST.format(0.015, 0.0016, 0.02)})::DECIMAL(30, 10) / 1000)::DECIMAL(30, 9) AS e
        FROM ai_usage_event) WHERE abs(cost_usd - e) > 0.10 * e""", "ai_usage_event"),
    "AI_UNKNOWN_MODEL": ("ai_usage_event", "warning", "flagged", "event_id", "'model ' || model || ' is not approved'", "FROM ai_usage_event WHERE model NOT IN ('atlas-large', 'atlas-mini', 'orion-pro', 'orion-lite')", "ai_usage_event"),
    "SEC_MISSING_ACTOR": ("sec_access_event", "error", "flagged", "event_id", "action || ' on ' || system || ' by nobody'", "FROM sec_access_event WHERE employee_id IS NULL", "sec_access_event"),
    "SEC_LOGIN_AFTER_TERMINATION": ("sec_access_event", "error", "flagged", "s.event_id", "'login on ' || event_ts::DATE || ' after leaving on ' || termination_date", """FROM sec_access_event s JOIN dim_employee p ON p.employee_id = s.employee_id AND is_current WHERE action = 'LOGIN' AND result = 'SUCCESS' AND event_ts::DATE >= termination_date
        AND NOT EXISTS (SELECT 1 FROM dim_employee v WHERE v.employee_id = s.employee_id AND v.valid_from <= s.event_ts::DATE AND (v.valid_to IS NULL OR s.event_ts::DATE < v.valid_to))""", "sec_access_event", "dim_employee"),
    "SEC_IMPOSSIBLE_TRAVEL": ("sec_access_event", "error", "flagged", "event_id", "employee_id || ' in ' || country || ' (' || region || '), ' || minutes || ' min after event ' || anchor || ' in ' || anchor_country || ' (' || anchor_region || ')'", f"""FROM (SELECT l.event_id, l.employee_id, l.source_country AS country, l.region, floor(epoch(l.event_ts - e.event_ts) / 60)::BIGINT AS minutes, e.event_id AS anchor, e.source_country AS anchor_country, e.region AS anchor_region FROM (SELECT *, {_REGION} AS region FROM sec_access_event) l JOIN (SELECT *, {_REGION} AS region FROM sec_access_event) e
        ON e.employee_id = l.employee_id AND e.event_ts < l.event_ts AND l.event_ts <= e.event_ts + INTERVAL 1 HOUR AND e.region <> l.region WHERE l.action = 'LOGIN' AND l.result = 'SUCCESS'
        QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY e.event_ts DESC, e.event_id DESC) = 1)""", "sec_access_event"),
    "FIN_ORPHAN_COST_CENTER": ("fin_actual", "error", "flagged", "actual_id", "'no department has cost centre ' || cost_center", "FROM (SELECT DISTINCT actual_id, cost_center FROM fin_actual) WHERE cost_center NOT IN (SELECT cost_center FROM dim_department WHERE cost_center IS NOT NULL)", "fin_actual", "dim_department"),
    "FIN_CLOSED_PERIOD_POSTING": ("fin_actual", "error", "flagged", "actual_id", "'posted on ' || posting_date || ' to ' || fiscal_period", f"FROM fin_actual WHERE fiscal_period <> {_PERIOD.format('posting_date')}", "fin_actual"),
    "FIN_UNAUTHORISED_APPROVER": ("fin_budget", "error", "flagged", "budget_id", "'approved by ' || approved_by || ', who is not an employee'", "FROM (SELECT DISTINCT budget_id, approved_by FROM fin_budget) WHERE approved_by NOT IN (SELECT employee_id FROM dim_employee)", "fin_budget", "dim_employee"),
}


def _rule_query(code: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rule's exceptions as they are written to dq_exception, but for the run and the time."""
    return lambda spark, sf_dir: rules.exceptions(star(spark, sf_dir), [code]).drop("run_id", "detected_at")


for _code, (_dataset, _severity, _disposition, _key, _detail, _rows, *_names) in _RULE_SQL.items():
    _labels = f"'{_dataset}' AS dataset, '{_code}' AS rule_code, '{_severity}' AS severity, '{_disposition}' AS disposition"
    _add("rule_" + _code.lower(), _rule_query(_code), _with(f"SELECT {_labels}, {_key} AS target_key, {_detail} AS detail {_rows}", *_names))


def _dimension_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """All columns but the surrogate key, of which the rows are counted: every row has one of its own, from 1 on."""
    key = warehouse.DIMENSIONS[name][1]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = warehouse.dimension(name, landed(spark, sf_dir))
        number = rows.agg(F.countDistinct(key).alias("keys"), F.min(key).alias("least_key"), F.max(key).alias("largest_key"))
        return rows.where(F.col(key) != -1).drop(key).crossJoin(F.broadcast(number))

    return run


_HR = "valid_from, valid_to, first_name, last_name, work_email, region, location, department_code, department_name, job_level, job_title, employment_type, change_reason, hire_date, termination_date, termination_reason"
_DIMENSION_SQL = {
    "dim_department": ("department_code, department_name, cost_center", "dim_department"),
    "dim_employee": (f"employee_id, {_HR}, row_number() OVER (PARTITION BY employee_id ORDER BY valid_from DESC) = 1 AS is_current, first_name || ' ' || last_name AS full_name, CASE WHEN manager_id IN (SELECT employee_id FROM hr_employee_history) THEN manager_id END AS manager_employee_id", "hr_employee_history ANTI JOIN overlapped USING (employee_id, valid_from)"),
    "dim_account": ("account_id, account_name, region, segment, industry, created_date, owner_employee_id, status, churn_date, churn_date IS NULL AS is_active", "crm_account WHERE true QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY account_name, created_date) = 1"),
    "dim_product": ("product_code, product_name", "dim_product"),
}
for _name, (_columns, _from) in _DIMENSION_SQL.items():
    _sql = f"SELECT r.*, n + 1 AS keys, -1::BIGINT AS least_key, n AS largest_key FROM (SELECT {_columns} FROM {_from}) r, (SELECT count(*) AS n FROM (SELECT 1 FROM {_from}))"
    _add(_name, _dimension_query(_name), _with(_sql, _name, "overlapped", "crm_account"))


def _version(person: str, day: str) -> str:
    """DuckDB: the start of the person's version on a day, else of the last one."""
    strict = f"(SELECT max(v.valid_from) FROM dim_employee v WHERE v.employee_id = s.{person} AND v.valid_from <= s.{day}::DATE AND (v.valid_to IS NULL OR s.{day}::DATE < v.valid_to))"
    return f"coalesce({strict}, (SELECT max(v.valid_from) FROM dim_employee v WHERE v.employee_id = s.{person}))"


# fact: (dataset, columns of its own, {date key: day}, {person's key: (person, day, whether an unknown one has a key)}, other dimensions by natural key, rows)
_KNOWN = "WHERE account_id IN (SELECT account_id FROM crm_account)"
_FACTS = {
    "fact_compensation": ("hr_compensation", "compensation_id, pay_grade, annual_salary_usd, bonus_target_pct, equity_units, currency, change_reason", {"date_key": "effective_from"}, {"employee_key": ("employee_id", "effective_from", True)}, [], ""),
    "fact_performance_review": ("hr_performance_review", "review_id, review_period, rating, rating_label, promotion_recommended", {"date_key": "submitted_date"}, {"employee_key": ("employee_id", "submitted_date", True), "reviewer_employee_key": ("reviewer_id", "submitted_date", False)}, [], ""),
    "fact_subscription": ("crm_subscription", "subscription_id, seats, arr_usd, billing_frequency", {"start_date_key": "start_date", "end_date_key": "end_date"}, {}, ["account", "product"], ""),
    "fact_invoice": ("crm_invoice", "invoice_id, subscription_id, amount_usd, currency, status", {"issue_date_key": "issue_date", "due_date_key": "due_date", "paid_date_key": "paid_date"}, {}, ["account"], ""),
    "fact_opportunity": ("crm_opportunity", "opportunity_id, opportunity_type, stage, amount_usd, probability_pct, is_won", {"created_date_key": "created_date", "close_date_key": "close_date"}, {"owner_employee_key": ("owner_employee_id", "created_date", True)}, ["account", "product"], _KNOWN),
    "fact_usage_daily": ("usage_daily", "active_users, sessions, api_calls, storage_gb, avg_latency_ms, error_count", {"date_key": "usage_date"}, {}, ["account", "product"], f"{_KNOWN} QUALIFY row_number() OVER (PARTITION BY usage_date, account_id, product_code ORDER BY active_users, sessions, api_calls, storage_gb, avg_latency_ms, error_count) = 1"),
    "fact_ai_usage": ("ai_usage_event", "event_id, employee_id, event_ts, model, feature, prompt_tokens, completion_tokens, cost_usd, latency_ms, flagged_by_policy", {"date_key": "event_ts"}, {"employee_key": ("employee_id", "event_ts", True)}, ["department"], ""),
    "fact_access_event": ("sec_access_event", "event_id, employee_id, event_ts, system, action, resource, source_ip, source_country, result, mfa_used", {"date_key": "event_ts"}, {"employee_key": ("employee_id", "event_ts", True)}, ["department"], ""),
    "fact_gl_actual": ("fin_actual", "actual_id, fiscal_period, gl_account, gl_account_name, amount_usd, vendor, description", {"date_key": "posting_date"}, {"posted_by_employee_key": ("posted_by", "posting_date", True)}, ["department"], ""),
    "fact_budget": ("fin_budget", "budget_id, fiscal_period, fiscal_year, fiscal_quarter, gl_account, gl_account_name, budget_usd", {"approved_date_key": "approved_date"}, {"approved_by_employee_key": ("approved_by", "approved_date", True)}, ["department"], ""),
}
_FRACTIONS = ("_usd", "_pct", "_gb")


def _fact_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """All columns of the fact, with keys turned back into what they stand for: a person's id and the start of the version, the
    natural key of other dimensions; numbers with a fraction as doubles."""
    _, columns, days, people, dims, _ = _FACTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = star(spark, sf_dir, (name,))
        f, out = t[name], []
        if sorted(f.columns) != sorted([*columns.split(", "), *days, *people, *[f"{d}_key" for d in dims]]):
            raise ValueError(f"{name} has other columns: {f.columns}")
        for key in people:
            versions = t["dim_employee"].select(F.col("employee_key").alias("_k"), F.col("employee_id").alias(f"{key}_id"), F.col("valid_from").alias(f"{key}_from"))
            f = f.join(versions, F.col(key) == F.col("_k"), "left").drop("_k")
            out += [f"{key}_id", f"{key}_from"]
        for d in dims:
            natural = warehouse.DIMENSIONS[f"dim_{d}"][2][0]
            f = f.join(t[f"dim_{d}"].select(F.col(f"{d}_key").alias("_k"), F.col(natural).alias(f"{d}_of")), F.col(f"{d}_key") == F.col("_k"), "left").drop("_k")
            out.append(f"{d}_of")
        number = lambda c: F.col(c).cast("double").alias(c) if c.endswith(_FRACTIONS) else F.col(c)
        return f.select(*[number(c) for c in columns.split(", ")], *days, *out)

    return run


def _fact_sql(name: str) -> str:
    dataset, columns, days, people, dims, rows = _FACTS[name]
    out = [f"s.{c}::DOUBLE AS {c}" if c.endswith(_FRACTIONS) else f"s.{c}" for c in columns.split(", ")]
    out += [f"strftime(s.{day}, '%Y%m%d')::INTEGER AS {key}" for key, day in days.items()]
    for key, (person, day, unknown) in people.items():
        start = _version(person, day)
        who, first = ("'UNKNOWN'", "DATE '1900-01-01'") if unknown else ("NULL", "NULL")
        out += [f"CASE WHEN {start} IS NULL THEN {who} ELSE s.{person} END AS {key}_id", f"coalesce({start}, {first}) AS {key}_from"]
    for d in dims:
        natural = f"{d}_id" if d == "account" else f"{d}_code"
        out.append(f"CASE WHEN s.{natural} IN (SELECT {natural} FROM dim_{d}) THEN s.{natural} ELSE 'UNKNOWN' END AS {d}_of")
    return _with(f"SELECT {', '.join(out)} FROM (SELECT * FROM {dataset} {rows}) s", dataset, "crm_account", "dim_employee", *[f"dim_{d}" for d in dims])


for _name in _FACTS:
    _add(_name, _fact_query(_name), _fact_sql(_name))


#: Reports that read the keys of people in facts.
_OF_PEOPLE = ("rpt_sales_pipeline_by_rep",)


def _view_query(name: str, facts: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = views.VIEWS[name](star(spark, sf_dir, {f: warehouse.FACTS[f] if name in _OF_PEOPLE else warehouse.WITHOUT_PEOPLE.get(f, warehouse.FACTS[f]) for f in facts}))
        return df.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])

    return run


_VIEWS = {
    "rpt_headcount_trend": ((), """, m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(hire_date)) FROM dim_employee), (SELECT max(coalesce(termination_date, valid_from)) FROM dim_employee), INTERVAL 1 MONTH))::DATE AS month_start),
        h AS (SELECT d.department_code, d.department_name, month_start, count(*) AS headcount FROM m, dim_department d JOIN dim_employee e ON e.department_code = d.department_code AND valid_from <= last_day(month_start) AND (valid_to IS NULL OR last_day(month_start) < valid_to) GROUP BY ALL)
        SELECT *, headcount - lag(headcount) OVER w AS headcount_change_mom, round(avg(headcount) OVER (PARTITION BY department_code ORDER BY month_start ROWS 2 PRECEDING), 1) AS headcount_3mo_avg FROM h WINDOW w AS (PARTITION BY department_code ORDER BY month_start)""", "dim_employee", "dim_department"),
    "rpt_revenue_trend": (("fact_subscription",), """, m AS (SELECT DISTINCT last_day(start_date) AS month_end FROM crm_subscription), l AS (SELECT month_end, sum(arr_usd) AS v FROM m JOIN crm_subscription ON start_date <= month_end AND (end_date IS NULL OR end_date > month_end) GROUP BY 1),
        n AS (SELECT *, v - lag(v) OVER (ORDER BY month_end) AS d FROM l) SELECT month_end, v::DOUBLE AS total_arr_usd, d::DOUBLE AS net_new_arr_usd, round(100 * d / nullif(v - d, 0), 1)::DOUBLE AS mom_growth_pct, v::DOUBLE AS cumulative_net_new_arr_usd FROM n""", "crm_subscription"),
    "rpt_ai_cost_by_department": (("fact_ai_usage",), f""", c AS (SELECT {_PERIOD.format('event_ts')} AS fiscal_period, department_code, department_name, count(*) AS request_count, sum(cost_usd) AS c FROM ai_usage_event JOIN dim_department USING (department_code) GROUP BY ALL)
        SELECT fiscal_period, department_code, department_name, request_count, c::DOUBLE AS total_cost_usd, round(100 * c / sum(c) OVER (PARTITION BY fiscal_period), 1)::DOUBLE AS pct_of_month_total, rank() OVER (PARTITION BY fiscal_period ORDER BY c DESC) AS department_rank_in_month FROM c""", "ai_usage_event", "dim_department"),
    "rpt_budget_variance": (("fact_budget", "fact_gl_actual"), """, b AS (SELECT department_code, fiscal_period, sum(budget_usd) AS b FROM fin_budget GROUP BY ALL), a AS (SELECT department_code, fiscal_period, sum(amount_usd) AS a FROM fin_actual GROUP BY ALL),
        j AS (SELECT department_code, department_name, fiscal_period, b, coalesce(a, 0) AS a, coalesce(a, 0) - b AS v FROM b LEFT JOIN a USING (department_code, fiscal_period) JOIN dim_department USING (department_code))
        SELECT department_code, department_name, fiscal_period, b::DOUBLE AS budget_usd, a::DOUBLE AS actual_usd, v::DOUBLE AS variance_usd, round(100 * v / nullif(b, 0), 1)::DOUBLE AS variance_pct, sum(v) OVER (PARTITION BY department_code ORDER BY fiscal_period ROWS UNBOUNDED PRECEDING)::DOUBLE AS cumulative_variance_usd,
        round(percent_rank() OVER (PARTITION BY fiscal_period ORDER BY v), 3) AS overspend_percentile_in_period FROM j""", "fin_budget", "fin_actual", "dim_department"),
    "rpt_sales_pipeline_by_rep": (("fact_opportunity",), f""", o AS (SELECT s.*, {_version('owner_employee_id', 'created_date')} AS version FROM crm_opportunity s WHERE account_id IN (SELECT account_id FROM dim_account) AND stage NOT LIKE 'Closed%'),
        p AS (SELECT o.*, coalesce(e.employee_id, 'UNKNOWN') AS who, CASE WHEN e.employee_id IS NULL THEN 'Unknown Employee' ELSE full_name END AS owner_name, e.region, account_name FROM o JOIN dim_account USING (account_id) LEFT JOIN dim_employee e ON e.employee_id = o.owner_employee_id AND e.valid_from = o.version),
        q AS (SELECT *, sum(amount_usd) OVER (PARTITION BY who, version ORDER BY created_date, opportunity_id ROWS UNBOUNDED PRECEDING) AS running, sum(amount_usd) OVER (PARTITION BY who, version) AS total FROM p)
        SELECT who AS owner_employee_id, owner_name, region, opportunity_id, account_name, created_date, stage, amount_usd::DOUBLE AS amount_usd, running::DOUBLE AS cumulative_pipeline_usd, total::DOUBLE AS total_open_pipeline_usd, rank() OVER (ORDER BY total DESC) AS pipeline_rank FROM q""", "crm_opportunity", "dim_account", "dim_employee"),
}
_VIEWS["rpt_attrition_by_department"] = ((), """, b AS (SELECT max(valid_from) AS d1, (max(valid_from) - INTERVAL 12 MONTH)::DATE AS d0 FROM dim_employee),
    s AS (SELECT department_code, count(DISTINCT employee_id) AS n FROM dim_employee, b WHERE valid_from <= d0 AND (valid_to IS NULL OR d0 < valid_to) GROUP BY 1),
    e AS (SELECT department_code, count(DISTINCT employee_id) AS n FROM dim_employee, b WHERE valid_from <= d1 AND (valid_to IS NULL OR d1 < valid_to) GROUP BY 1),
    l AS (SELECT department_code, count(DISTINCT employee_id) AS n FROM dim_employee, b WHERE is_current AND termination_date BETWEEN d0 AND d1 GROUP BY 1),
    a AS (SELECT coalesce(s.department_code, e.department_code) AS department_code, (coalesce(s.n, 0) + coalesce(e.n, 0)) / 2.0 AS v FROM s FULL JOIN e ON s.department_code = e.department_code),
    r AS (SELECT department_code, department_name, coalesce(l.n, 0) AS k, v, 100.0 * coalesce(l.n, 0) / v AS rate FROM a JOIN dim_department USING (department_code) LEFT JOIN l USING (department_code))
    SELECT department_code, department_name, k AS trailing_12mo_terminations, round(v, 1)::DOUBLE AS avg_headcount, round(rate, 1)::DOUBLE AS attrition_rate_pct, rank() OVER (ORDER BY rate DESC NULLS LAST) AS attrition_rank FROM r""", "dim_employee", "dim_department")
_VIEWS["rpt_product_usage_trend"] = (("fact_usage_daily",), """, f AS (SELECT usage_date, coalesce(p.product_code, 'UNKNOWN') AS product_code, coalesce(p.product_name, 'Unknown Product') AS product_name, active_users, sessions
    FROM (SELECT * FROM usage_daily WHERE account_id IN (SELECT account_id FROM crm_account) QUALIFY row_number() OVER (PARTITION BY usage_date, account_id, product_code ORDER BY active_users, sessions) = 1) u LEFT JOIN dim_product p ON p.product_code = u.product_code),
    g AS (SELECT usage_date AS full_date, product_code, product_name, sum(active_users)::BIGINT AS active_users, sum(sessions)::BIGINT AS sessions FROM f GROUP BY ALL)
    SELECT *, round(avg(active_users) OVER (PARTITION BY product_code ORDER BY full_date ROWS 6 PRECEDING), 1) AS active_users_7day_avg, active_users - lag(active_users, 7) OVER (PARTITION BY product_code ORDER BY full_date) AS active_users_change_vs_last_week FROM g""", "usage_daily", "crm_account", "dim_product")
for _name, (_facts, _select, *_names) in _VIEWS.items():
    _add(_name, _view_query(_name, _facts), _with("", *_names).rstrip() + _select)


# What a manager of one department and an analyst without any scope see of the governed tables: rows by department, masked
# columns as nulls.  {table: (dataset, key, columns, masks, how a row belongs to a department)}
_BY_CODE = "department_code IN (SELECT department_code FROM dim_department WHERE department_name = '1-URGENT')"
_BY_PERSON = "(SELECT department_name FROM dim_employee v WHERE v.employee_id = s.employee_id AND v.valid_from = {0}) = '1-URGENT'"
_GOVERNED = {
    "fact_ai_usage": ("ai_usage_event", "event_id, model", {"employee_id": "VARCHAR", "flagged_by_policy": "BOOLEAN"}, _BY_CODE),
    "fact_access_event": ("sec_access_event", "event_id, action, system", {"employee_id": "VARCHAR", "source_ip": "VARCHAR"}, _BY_CODE),
    "fact_gl_actual": ("fin_actual", "actual_id, fiscal_period", {}, _BY_CODE),
    "fact_budget": ("fin_budget", "budget_id, fiscal_period", {}, _BY_CODE),
    "fact_compensation": ("hr_compensation", "compensation_id, pay_grade", {"annual_salary_usd": "DOUBLE", "bonus_target_pct": "DOUBLE", "equity_units": "INTEGER"}, _BY_PERSON.format(_version("employee_id", "effective_from"))),
    "fact_performance_review": ("hr_performance_review", "review_id, review_period", {"rating": "SMALLINT", "rating_label": "VARCHAR", "promotion_recommended": "BOOLEAN"}, _BY_PERSON.format(_version("employee_id", "submitted_date"))),
    "dim_employee": ("dim_employee", "employee_id, valid_from, department_name", {"termination_reason": "VARCHAR", "job_level": "SMALLINT"}, "true"),
}


def _governed_query(name: str, *groups: str) -> Callable[[SparkSession, str], DataFrame]:
    """A governed table for a principal; groups and capabilities are the policy's own, departments those of the stand-ins."""
    _, columns, masks, _ = _GOVERNED[name]
    who = policy.governance.Principal(scopes={**policy.SCOPES, "grp_dept_manager_engineering": {"1-URGENT"}}, capabilities=policy.CAPABILITIES, groups=groups)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = policy.secure(star(spark, sf_dir, (name,) if name in warehouse.FACTS else ()), who)[name]
        t = t.where("employee_key <> -1") if name == "dim_employee" else t
        number = lambda c: F.col(c).cast("double").alias(c) if c.endswith(_FRACTIONS) else F.col(c)
        return t.select(*columns.split(", "), *[number(c) for c in masks])

    return run


for _name, (_dataset, _columns, _masks, _where) in _GOVERNED.items():
    _from = "hr_employee_history ANTI JOIN overlapped USING (employee_id, valid_from)" if _dataset == "dim_employee" else f"{_dataset} s"
    _needs = ["dim_department", "dim_employee", "overlapped"] + ([_dataset] if _dataset in SOURCES else [])
    _hidden = "".join(f", NULL::{kind} AS {c}" for c, kind in _masks.items())
    _add(f"manager_{_name}", _governed_query(_name, "grp_dept_manager_engineering"), _with(f"SELECT {_columns}{_hidden} FROM {_from} WHERE {_where}", *_needs))
    _shown = "".join(f", {c}::{kind} AS {c}" for c, kind in _masks.items())
    _add(f"analyst_{_name}", _governed_query(_name, "grp_hr_analyst", "grp_total_rewards", "grp_security"), _with(f"SELECT {_columns}{_shown} FROM {_from}", *_needs))


def _sql_session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def _sql_query(text: str, facts: tuple[str, ...], *groups: str) -> Callable[[SparkSession, str], DataFrame]:
    """SQL text in a session of a principal's own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _sql_session(spark)
        who = policy.governance.Principal(scopes={**policy.SCOPES, "grp_dept_manager_engineering": {"1-URGENT"}}, capabilities=policy.CAPABILITIES, groups=groups)
        sql_api.open_for(own, star(own, sf_dir, facts), who)
        return own.sql(text)

    return run


def _sql_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _sql_session(spark)
    t = star(own, sf_dir)
    for name in ("dim_employee", "ai_usage_event"):
        t[name].createOrReplaceTempView(name)
    sql_api.lookups(own)
    return own.sql("""SELECT event_id, s.valid_from AS strict_from, b.valid_from AS best_from FROM
        (SELECT event_id, employee_key_as_of(employee_id, CAST(event_ts AS DATE)) AS strict_key, employee_key_best(employee_id, CAST(event_ts AS DATE)) AS best_key FROM ai_usage_event)
        LEFT JOIN dim_employee s ON s.employee_key = strict_key LEFT JOIN dim_employee b ON b.employee_key = best_key""")


_add("sql_lookups", _sql_lookups, _with(f"""SELECT event_id, (SELECT v.valid_from FROM dim_employee v WHERE v.employee_id = s.employee_id AND v.valid_from <= event_ts::DATE AND (v.valid_to IS NULL OR event_ts::DATE < v.valid_to)) AS strict_from,
    {_version("employee_id", "event_ts::DATE")} AS best_from FROM ai_usage_event s""", "ai_usage_event", "dim_employee"))
_COSTS = "model, count(*) AS n, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(employee_id) AS people, count(flagged_by_policy) AS flags"
_add("sql_manager_ai_cost", _sql_query(f"SELECT {_COSTS} FROM fact_ai_usage GROUP BY model", ("fact_ai_usage",), "grp_dept_manager_engineering"),
    _with(f"SELECT model, count(*) AS n, sum(cost_usd)::DOUBLE AS cost_usd, 0::BIGINT AS people, 0::BIGINT AS flags FROM ai_usage_event WHERE {_BY_CODE} GROUP BY model", "ai_usage_event", "dim_department"))
_add("sql_security_ai_cost", _sql_query(f"SELECT {_COSTS} FROM fact_ai_usage GROUP BY model", ("fact_ai_usage",), "grp_security"), _with(f"SELECT {_COSTS} FROM ai_usage_event GROUP BY model", "ai_usage_event"))


def _sql_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and masks called by name, over all rows of a fact."""
    own = _sql_session(spark)
    t = star(own, sf_dir, ("fact_access_event",))
    t["fact_access_event"].createOrReplaceTempView("events_of_all")
    sql_api.policies(own, t, policy.governance.Principal(scopes={"m": {"1-URGENT"}, "n": {"2-HIGH"}, "x": policy.governance.ALL}, capabilities={"m": {"view_pii_network"}, "x": {"view_pii_identity"}}, groups=("m", "n")))
    return own.sql("SELECT event_id, rf_department_key(department_key) AS own, mask_source_ip(source_ip) AS source_ip, mask_employee_identity(employee_id) AS who FROM events_of_all")


_add("sql_policies", _sql_policies, _with("SELECT event_id, coalesce(department_code IN (SELECT department_code FROM dim_department WHERE department_name IN ('1-URGENT', '2-HIGH')), false) AS own, source_ip::VARCHAR AS source_ip, NULL::VARCHAR AS who FROM sec_access_event", "sec_access_event", "dim_department"))
