"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestrata.plans import queries, star_queries, warehouse

QUERIES, SQL = {**queries.QUERIES, **star_queries.QUERIES}, {**queries.SQL, **star_queries.SQL}

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module", autouse=True)
def one_star(spark):
    """Queries of one session share its dimensions, which are written once."""
    make, made = star_queries.star, {}

    def star(session, sf_dir, facts=()):
        if session is not spark:
            return make(session, sf_dir, facts)
        if sf_dir not in made:
            made[sf_dir] = make(session, sf_dir, tuple(warehouse.FACTS))
        return made[sf_dir]

    star_queries.star = star
    yield
    star_queries.star = make


def test_a_star_writes_a_dimension_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(star_queries, "work_table", lambda df, name: written.append(name) or df)
    t = star_queries.star(spark.newSession(), SF)
    assert written == [] and t["dim_product"] is t["dim_product"] and written == ["dim_product"]


@pytest.mark.parametrize("name", ["rpt_budget_variance", "rpt_ai_cost_by_department"])
def test_a_report_without_people_makes_no_employees(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(star_queries, "work_table", lambda df, name: written.append(name) or df)
    star_queries.QUERIES[name](spark.newSession(), SF)
    assert written == ["dim_department"]


def test_a_first_snapshot_joins_with_no_empty_one(spark):
    """Employees move once for their windows, once for their managers and once for their numbers."""
    for name in warehouse.DIMENSIONS:
        plan = warehouse.dimension(name, star_queries.landed(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
        assert "FullOuter" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    con.sql(f"CREATE TABLE s AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    con.sql(f"CREATE TABLE o AS {SQL[name]}")
    columns = sorted(r[0] for r in con.sql("DESCRIBE o").fetchall())
    assert columns == sorted(r[0] for r in con.sql("DESCRIBE s").fetchall())
    c = ", ".join(columns)
    assert con.sql(f"SELECT {c} FROM o EXCEPT ALL SELECT {c} FROM s").fetchall() == []
    assert con.sql(f"SELECT {c} FROM s EXCEPT ALL SELECT {c} FROM o").fetchall() == []
