"""An extract from generation to reports: landing, build, rules, invariants, policies."""

import json
import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import tables
from lodestrata.plans import checks, policy, rules, views, warehouse
from lodestrata.sources import extract, generate
from lodestrata.sources.registry import DATASETS, TIERS
from lodestrata.sources.store import Store


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("extract")
    generate.generate(spark, str(path), "small", seed=2)
    return str(path)


@pytest.fixture(scope="module")
def store(spark, folder, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    extract.load(spark, folder, s)
    warehouse.build(spark, s)
    return s


@pytest.fixture(scope="module")
def star(store):
    return store.read(warehouse.AREA)


def test_registry_rejects_wrong_declarations():
    from lodestrata.sources.registry import Dataset

    for key, spec in ((("b",), "a string"), (("a",), "a string\na int"), (("a",), "a string secret")):
        with pytest.raises(ValueError):
            Dataset("d", "s", key, spec)
    assert all(d.max_tier in TIERS for d in DATASETS.values())


def test_every_seeded_defect_is_found_and_nothing_else(spark, folder, star):
    manifest = extract.read_manifest(spark, folder)
    assert {i["defect"] for i in manifest["injections"]} == set(rules.RULES)
    for r in rules.score(star["dq_exception"], extract.injections(spark, manifest)).collect():
        assert (r.missed, r.false_positives, r.recall, r.implemented) == (0, 0, 1.0, True), r


def test_an_upload_is_whole(spark, folder, tmp_path):
    extract.upload(spark, folder, f"file://{tmp_path}/landing/extract")
    assert extract.read_manifest(spark, f"{tmp_path}/landing/extract") == extract.read_manifest(spark, folder)
    (tmp_path / "landing/extract/.crm_account.csv.crc").unlink()
    (tmp_path / "landing/extract/crm_account.csv").write_text("altered")
    with pytest.raises(extract.LoadError):
        extract.upload(spark, f"{tmp_path}/landing/extract", f"file://{tmp_path}/again")


def test_files_of_any_size_are_hashed(spark, tmp_path):
    import hashlib

    for name, size in (("small", 1000), ("large", (1 << 31) + 5)):
        with open(tmp_path / f"{name}.csv", "wb") as f:
            f.truncate(size)
            f.seek(size - 3)
            f.write(b"end")
    whole = hashlib.sha256()
    with open(tmp_path / "large.csv", "rb") as f:
        while chunk := f.read(1 << 24):
            whole.update(chunk)
    want = {"small.csv": extract.sha256_of(str(tmp_path / "small.csv")), "large.csv": whole.hexdigest()}
    assert extract.digests(spark, str(tmp_path)) == want
    (tmp_path / "large.csv").unlink()
    assert extract.digests(spark, str(tmp_path), large=10) == {"small.csv": want["small.csv"]}


def test_clean_extract_has_no_exceptions_and_same_bytes_every_time(spark, tmp_path):
    a = generate.generate(spark, f"{tmp_path}/a", "small", seed=5, defects=False)
    assert a["injections"] == []
    t = warehouse.conform({n: extract.read_csv(spark, n, f"file://{tmp_path}/a/{n}.csv") for n in DATASETS})
    again = generate.World(spark, generate.SCALES["small"], 5, generate.DEFAULT_DAY).tables
    os.makedirs(f"{tmp_path}/b")
    for name in ("hr_employee_history", "fin_actual"):
        assert extract.write_dataset(again[name], name, f"{tmp_path}/b")["sha256"] == next(f for f in a["files"] if f["dataset"] == name)["sha256"]
    for name in warehouse.DIMENSIONS:
        t[name] = warehouse.dimension(name, t)
    assert rules.exceptions(t).collect() == []


def test_invariants_hold_and_broken_ones_are_named(star):
    assert checks.broken(star) == {}
    people = star["dim_employee"]
    assert "dim_employee: employee_key is unique" in checks.broken({"dim_employee": people.unionByName(people.limit(1))})


def test_rebuild_keeps_keys_and_failed_load_keeps_the_landing(spark, folder, store, star, tmp_path):
    before = {n: sorted(map(tuple, star[n].collect()), key=repr) for n in warehouse.DIMENSIONS}
    version = warehouse.build(spark, store)
    assert store.history(warehouse.AREA)[-1] == version
    again = store.read(warehouse.AREA)
    assert {n: sorted(map(tuple, again[n].collect()), key=repr) for n in warehouse.DIMENSIONS} == before
    bad = f"{tmp_path}/bad"
    shutil.copytree(folder, bad)
    with open(f"{bad}/crm_account.csv", "a") as f:
        f.write("x\n")
    landed = store.history(extract.AREA)
    with pytest.raises(extract.LoadError, match="crm_account"):
        extract.load(spark, bad, store)
    os.remove(f"{bad}/crm_account.csv")
    with pytest.raises(extract.LoadError, match="no file"):
        extract.load(spark, bad, store)
    with open(f"{bad}/manifest.json") as f:
        manifest = json.load(f)
    manifest["files"][0]["dataset"] = "other"
    with open(f"{bad}/manifest.json", "w") as f:
        json.dump(manifest, f)
    with pytest.raises(extract.LoadError, match="unknown"):
        extract.load(spark, bad, store)
    assert store.history(extract.AREA) == landed
    assert store.log(extract.AUDIT).count() == len(DATASETS)


def test_failed_build_is_logged_and_not_published(spark, folder, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    with pytest.raises(warehouse.BuildError):
        warehouse.build(spark, s)
    v = s.begin(extract.AREA)
    for name, d in DATASETS.items():
        s.write(extract.AREA, v, name, spark.createDataFrame([], d.landed_schema))
    s.publish(extract.AREA, v)
    first = warehouse.build(spark, s)  # empty tables make a warehouse of unknown members
    assert s.read(warehouse.AREA)["dim_account"].count() == 1
    v = s.begin(extract.AREA)
    for name, d in DATASETS.items():
        rows = [tuple("x" if c == "account_id" else "nine" if c == "created_date" else None for c in d.columns)] if name == "crm_account" else []
        s.write(extract.AREA, v, name, spark.createDataFrame(rows, d.landed_schema))
    s.publish(extract.AREA, v)
    with pytest.raises(Exception, match="nine"):
        warehouse.build(spark, s)
    assert s.history(warehouse.AREA) == [first]
    assert sorted(r.status for r in s.log(warehouse.RUNS).collect()) == ["failed", "succeeded"]


def test_facts_against_plain_sql(folder, star, tmp_path):
    con = duckdb.connect()
    for name in DATASETS:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_csv('{folder}/{name}.csv', all_varchar=true, nullstr='')")
    for name, df in star.items():
        df.write.parquet(f"{tmp_path}/{name}")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    one = lambda sql: con.sql(sql).fetchall()[0][0]
    assert one("SELECT count(*) FROM fact_usage_daily") == one("SELECT count(DISTINCT (usage_date, account_id, product_code)) FROM usage_daily WHERE account_id IN (SELECT account_id FROM crm_account)")
    assert one("SELECT count(*) FROM fact_access_event WHERE employee_key = -1") == one("SELECT count(*) FROM sec_access_event WHERE employee_id IS NULL")
    strict = """(SELECT p.employee_key FROM dim_employee p WHERE p.employee_id = s.{0} AND p.valid_from <= s.{1}::DATE AND (p.valid_to IS NULL OR s.{1}::DATE < p.valid_to))"""
    latest = """(SELECT max_by(p.employee_key, p.valid_from) FROM dim_employee p WHERE p.employee_id = s.{0})"""
    for fact, key, source, natural, person, day in (
        ("fact_compensation", "employee_key", "hr_compensation", "compensation_id", "employee_id", "effective_from"),
        ("fact_opportunity", "owner_employee_key", "crm_opportunity", "opportunity_id", "owner_employee_id", "created_date"),
        ("fact_gl_actual", "posted_by_employee_key", "fin_actual", "actual_id", "posted_by", "posting_date"),
        ("fact_budget", "approved_by_employee_key", "fin_budget", "budget_id", "approved_by", "approved_date"),
        ("fact_ai_usage", "employee_key", "ai_usage_event", "event_id", "employee_id", "event_ts"),
    ):
        best = f"coalesce({strict.format(person, day)}, {latest.format(person)}, -1)"
        assert one(f"SELECT count(*) FROM {fact} f JOIN {source} s USING ({natural}) WHERE f.{key} <> {best}") == 0, fact
    assert one("SELECT count(*) FROM dim_employee WHERE is_current") == one("SELECT count(DISTINCT employee_id) FROM dim_employee")


def test_reports_against_plain_sql(star, tmp_path):
    con = duckdb.connect()
    for name, df in star.items():
        df.write.parquet(f"{tmp_path}/{name}")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    expected = {
        "rpt_headcount_trend": """WITH m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(hire_date)) FROM dim_employee WHERE employee_key <> -1), (SELECT max(coalesce(termination_date, valid_from)) FROM dim_employee WHERE employee_key <> -1), INTERVAL 1 MONTH))::DATE AS month_start),
            h AS (SELECT d.department_code, d.department_name, month_start, count(*) AS headcount FROM m, dim_department d JOIN dim_employee e ON e.department_code = d.department_code AND valid_from <= last_day(month_start) AND (valid_to IS NULL OR last_day(month_start) < valid_to) WHERE department_key <> -1 GROUP BY ALL)
            SELECT *, headcount - lag(headcount) OVER w, round(avg(headcount) OVER (w ROWS 2 PRECEDING), 1) FROM h WINDOW w AS (PARTITION BY department_code ORDER BY month_start)""",
        "rpt_revenue_trend": """WITH s AS (SELECT strptime(start_date_key::VARCHAR, '%Y%m%d')::DATE AS a, strptime(end_date_key::VARCHAR, '%Y%m%d')::DATE AS b, arr_usd FROM fact_subscription), m AS (SELECT DISTINCT last_day(a) AS m FROM s),
            l AS (SELECT m, sum(arr_usd) AS v FROM m JOIN s ON a <= m AND (b IS NULL OR b > m) GROUP BY m), n AS (SELECT m, v, v - lag(v) OVER (ORDER BY m) AS d FROM l) SELECT m, v, d, round(100.0 * d / nullif(v - d, 0), 1), v FROM n""",
        "rpt_sales_pipeline_by_rep": """WITH o AS (SELECT f.*, e.employee_id, full_name, e.region, account_name, full_date, sum(amount_usd) OVER (PARTITION BY owner_employee_key) AS total FROM fact_opportunity f JOIN dim_employee e ON employee_key = owner_employee_key JOIN dim_account USING (account_key) JOIN dim_date ON date_key = created_date_key WHERE stage NOT LIKE 'Closed%')
            SELECT employee_id, full_name, region, opportunity_id, account_name, full_date, stage, amount_usd, sum(amount_usd) OVER (PARTITION BY owner_employee_key ORDER BY full_date, opportunity_id ROWS UNBOUNDED PRECEDING), total, rank() OVER (ORDER BY total DESC) FROM o""",
        "rpt_budget_variance": """WITH b AS (SELECT department_key, fiscal_period, sum(budget_usd) AS b FROM fact_budget GROUP BY ALL), a AS (SELECT department_key, fiscal_period, sum(amount_usd) AS a FROM fact_gl_actual GROUP BY ALL),
            j AS (SELECT department_code, department_name, fiscal_period, b, coalesce(a, 0) AS a, coalesce(a, 0) - b AS v FROM b LEFT JOIN a USING (department_key, fiscal_period) JOIN dim_department USING (department_key) WHERE department_key <> -1)
            SELECT *, round(100.0 * v / nullif(b, 0), 1), sum(v) OVER (PARTITION BY department_code ORDER BY fiscal_period ROWS UNBOUNDED PRECEDING), round(percent_rank() OVER (PARTITION BY fiscal_period ORDER BY v), 3) FROM j""",
        "rpt_ai_cost_by_department": """WITH c AS (SELECT fiscal_period, department_code, department_name, count(*) AS n, sum(cost_usd) AS c FROM fact_ai_usage JOIN dim_date USING (date_key) JOIN dim_department USING (department_key) WHERE department_key <> -1 GROUP BY ALL)
            SELECT *, round(100.0 * c / sum(c) OVER (PARTITION BY fiscal_period), 1), rank() OVER (PARTITION BY fiscal_period ORDER BY c DESC) FROM c""",
        "rpt_product_usage_trend": """WITH d AS (SELECT full_date, product_code, product_name, sum(active_users) AS u, sum(sessions) AS s FROM fact_usage_daily JOIN dim_date USING (date_key) JOIN dim_product USING (product_key) GROUP BY ALL)
            SELECT *, round(avg(u) OVER (PARTITION BY product_code ORDER BY full_date ROWS 6 PRECEDING), 1), u - lag(u, 7) OVER (PARTITION BY product_code ORDER BY full_date) FROM d""",
    }
    plain = lambda rows: sorted([tuple(None if v is None else round(float(v), 3) if not isinstance(v, str) and not hasattr(v, "year") else str(v) for v in r) for r in rows], key=repr)
    for name, sql in expected.items():
        assert plain(views.VIEWS[name](star).collect()) == plain(con.sql(sql).fetchall()), name
    rates = views.attrition_by_department(star).collect()
    assert rates and all(0 <= r.attrition_rate_pct < 100 for r in rates)
    figures = views.measures({n: v(star) for n, v in views.VIEWS.items()}).collect()
    assert len(figures) == 1 and len(figures[0]) == 8 and None not in figures[0]


def test_no_report_has_a_restricted_column(star):
    restricted = {c for d in DATASETS.values() for c in d.columns_of("restricted")}
    for name, view in views.VIEWS.items():
        assert not restricted & set(view(star).columns), name


def test_personas(star):
    who = policy.principal
    nobody = policy.secure(star, who())
    assert nobody["fact_budget"].count() == nobody["fact_compensation"].count() == 0
    engineering = policy.secure(star, who("grp_dept_manager_engineering"))
    assert {r.department_name for r in policy.read(star, who("grp_dept_manager_engineering"), "rpt_budget_variance").collect()} == {"Engineering"}
    assert 0 < engineering["fact_compensation"].count() < star["fact_compensation"].count()
    assert policy.read(star, who("grp_exec"), "fact_compensation").where("annual_salary_usd is not null").count() == 0
    assert policy.read(star, who("grp_total_rewards"), "fact_compensation").where("annual_salary_usd is null").count() == 0
    both = policy.secure(star, who("grp_dept_manager_engineering", "grp_total_rewards"))
    assert both["fact_compensation"].where("annual_salary_usd is not null").count() == star["fact_compensation"].count()
    assert policy.read(star, who("grp_sales_ops"), "rpt_budget_variance").count() == 0
    with pytest.raises(policy.AccessDenied):
        policy.read(star, who("grp_fp_a"), "fact_compensation")
    with pytest.raises(policy.AccessDenied):
        policy.read(star, who(), "rpt_revenue_trend")
    roles = policy.for_role({n: v(star) for n, v in views.VIEWS.items()}, "Engineering")
    assert {r.department_name for r in roles["rpt_headcount_trend"].select("department_name").distinct().collect()} == {"Engineering"}


def test_reports_have_an_order_and_runs_a_last_one(spark, store, star):
    for name, view in views.VIEWS.items():
        rows = views.ordered(name, view(star)).collect()
        keys = [tuple((r[c] is None, r[c]) for c in views.ORDER[name]) for r in rows]
        assert rows and keys == sorted(keys) and len(set(keys)) == len(keys), name
    views.create(star)
    assert spark.table("rpt_revenue_trend").first().month_end == min(r.month_end for r in spark.table("rpt_revenue_trend").collect())
    last = warehouse.latest_run(store)
    found = store.read(warehouse.AREA)["dq_exception"]
    assert last["status"] == "succeeded" and last["version"] == store.history(warehouse.AREA)[-1] and sum(last["exceptions"].values()) == found.count()
    assert {r.run_id for r in found.select("run_id").distinct().collect()} == {last["version"]}


def test_facts_lie_in_ranges(store, star):
    """A filter on the first column of a fact's order needs only the files whose range holds the value."""
    for name in ("fact_usage_daily", "fact_access_event"):
        ranges = [(r.low, r.high) for r in star[name].groupBy(F.input_file_name().alias("f")).agg(F.min("date_key").alias("low"), F.max("date_key").alias("high")).orderBy("low").collect()]
        assert all(a[1] <= b[0] for a, b in zip(ranges[:-1], ranges[1:], strict=True))


def test_parity_of_a_store_with_itself_and_drift(spark, store, star):
    assert all(tables.parity(view(star), view(store.read(warehouse.AREA))).ok for view in list(views.VIEWS.values())[:2])
    declared = {n: list(d.columns) for n, d in DATASETS.items()}
    assert checks.drift(declared, {n: df.columns for n, df in store.read(extract.AREA).items()}) == []
