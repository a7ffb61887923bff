"""Lookups and policies called from SQL give what the DataFrame forms give."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException

from lodestrata.operators import temporal
from lodestrata.plans import policy, sql_api


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


@pytest.fixture
def own(spark):
    session = spark.newSession()
    people = [(-1, "UNKNOWN", None, day(-9999), None), (1, "a", "Engineering", day(0), day(31)), (2, "a", "Sales", day(60), None), (3, "b", "Engineering", day(5), None)]
    session.createDataFrame(people, "employee_key long, employee_id string, department_name string, valid_from date, valid_to date").selectExpr("*", "'gone' AS termination_reason", "CAST(3 AS SMALLINT) AS job_level", "'E' AS department_code", "valid_from AS hire_date", "valid_to AS termination_date", "valid_to IS NULL AS is_current").createOrReplaceTempView("raw_people")
    t = {
        "dim_employee": session.table("raw_people"),
        "dim_department": session.sql("SELECT * FROM VALUES (-1L, 'Unknown Department', 'UNKNOWN'), (10L, 'Engineering', 'E'), (11L, 'Sales', 'S') AS t(department_key, department_name, department_code)"),
        "fact_access_event": session.sql("SELECT * FROM VALUES (1, 10L, 'a', '1.1.1.1'), (2, 11L, 'b', '2.2.2.2'), (3, -1L, NULL, NULL), (4, NULL, 'c', '3.3.3.3') AS t(event_id, department_key, employee_id, source_ip)"),
        "fact_compensation": session.sql("SELECT *, 1 AS equity_units, CAST(0.1 AS DECIMAL(5, 4)) AS bonus_target_pct FROM VALUES (1, 1L, CAST(5 AS DECIMAL(12, 2))), (2, 2L, CAST(6 AS DECIMAL(12, 2))), (3, -1L, CAST(7 AS DECIMAL(12, 2))), (4, NULL, CAST(8 AS DECIMAL(12, 2))) AS t(compensation_id, employee_key, annual_salary_usd)"),
    }
    return session, t


def test_lookups_are_those_of_as_of(own):
    session, t = own
    t["dim_employee"].createOrReplaceTempView("dim_employee")
    sql_api.lookups(session)
    asked = session.createDataFrame([(i, e, day(n) if n is not None else None) for i, (e, n) in enumerate([(e, n) for e in ("a", "b", "nobody", None) for n in (-5, 0, 5, 30, 31, 45, 60, 99, None)])], "i int, e string, d date")
    asked.createOrReplaceTempView("asked")
    got = session.sql("SELECT i, employee_key_as_of(e, d) AS s, employee_key_best(e, d) AS b FROM asked")
    versions = t["dim_employee"].withColumnRenamed("employee_id", "e")
    for forgiving, column in ((False, "s"), (True, "b")):
        want = {r.i: r.employee_key for r in temporal.as_of(asked, versions, "e", "d", "employee_key", forgiving=forgiving).collect()}
        assert {r.i: r[column] for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.employee_key for r in session.sql("SELECT * FROM employees_on(DATE'2024-01-10')").collect()) == [1, 3]


@pytest.mark.parametrize("groups", [(), ("grp_dept_manager_engineering",), ("grp_security",), ("grp_hr_analyst", "grp_dept_manager_engineering"), ("grp_exec",), ("grp_unheard_of",), ("grp_total_rewards",)])
def test_functions_filter_and_mask_as_views_do(own, groups):
    session, t = own
    who = policy.principal(*groups)
    sql_api.policies(session, t, who)
    for name, df in t.items():
        df.createOrReplaceTempView(f"all_{name}")
    seen = policy.secure(t, who)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    events = session.sql("SELECT event_id, department_key, mask_employee_identity(employee_id) AS employee_id, mask_source_ip(source_ip) AS source_ip FROM all_fact_access_event WHERE rf_department_key(department_key)")
    assert rows(events) == rows(seen["fact_access_event"])
    pay = session.sql("SELECT compensation_id, employee_key, mask_compensation_amount(annual_salary_usd) AS annual_salary_usd, mask_compensation_units(equity_units) AS equity_units, mask_compensation_pct(bonus_target_pct) AS bonus_target_pct FROM all_fact_compensation WHERE rf_department_by_employee(employee_key)")
    assert rows(pay) == rows(seen["fact_compensation"])
    people = session.sql("SELECT employee_key, mask_termination_reason(termination_reason) AS r, mask_job_level(job_level) AS l FROM all_dim_employee")
    assert rows(people) == rows(seen["dim_employee"].select("employee_key", "termination_reason", "job_level"))
    assert [r[0] for r in session.sql("SELECT is_account_group_member('grp_exec')").collect()] == ["grp_exec" in groups]


def test_a_principals_session_has_what_it_may_read(own, spark):
    session, t = own
    sql_api.open_for(session, t, policy.principal("grp_security"))
    assert session.sql("SELECT count(*) AS n, count(source_ip) AS ips FROM fact_access_event").first() == (4, 3)
    assert session.sql("SELECT max(headcount) AS n FROM rpt_headcount_trend WHERE department_code = 'E'").first().n == 2
    for text in ("SELECT * FROM fact_compensation", "SELECT * FROM rpt_revenue_trend"):
        with pytest.raises(AnalysisException):
            session.sql(text)
    other = spark.newSession()
    with pytest.raises(AnalysisException):
        other.sql("SELECT * FROM fact_access_event")
