"""Operators on small hand-made tables."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import typed
from lodestrata.operators import governance, tables, temporal
from lodestrata.plans import checks
from lodestrata.sources import migrate, reports
from lodestrata.sources.store import Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_of_strict_and_forgiving(spark):
    v = spark.sql("SELECT * FROM VALUES ('a', DATE'2024-01-01', DATE'2024-02-01', 1L), ('a', DATE'2024-03-01', NULL, 2L) AS t(id, valid_from, valid_to, key)")
    f = spark.sql("SELECT * FROM VALUES (1, 'a', DATE'2024-01-15'), (2, 'a', DATE'2024-02-01'), (3, 'a', DATE'2023-01-01'), (4, 'b', DATE'2024-01-15'), (5, NULL, DATE'2024-01-15') AS t(n, id, day)")
    assert [r.key for r in temporal.as_of(f, v, "id", "day", "key").orderBy("n").collect()] == [1, None, None, None, None]
    assert [r.key for r in temporal.as_of(f, v, "id", "day", "key", forgiving=True).orderBy("n").collect()] == [1, 2, 2, None, None]


@pytest.mark.parametrize("forgiving", [False, True])
def test_as_of_merge_against_the_join_and_brute_force(spark, forgiving):
    """Half of the rows have one key; versions may be open, empty or touch each other."""
    r = random.Random(8)
    versions, n = [], 0
    for k, count in (("hot", 120), ("b", 3), ("c", 1), (None, 2)):
        day = 0
        for _ in range(count):
            day += r.randrange(1, 5)
            end = day + r.randrange(0, 5)
            versions.append((k, day, end, n))
            day, n = end, n + 1
        versions.append((k, day + 9, None, n))
        n += 1
    versions += [("b", None, 5, 900), ("c", 50, 40, 901)]
    facts = [(i, r.choice(["hot", "hot", "b", "c", "nobody", None]), r.randrange(-5, 520) if i % 40 else None) for i in range(500)]
    days = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c))
    v = spark.createDataFrame(versions, "k string, a int, b int, v long").select("k", days("a").alias("valid_from"), days("b").alias("valid_to"), "v")
    f = spark.createDataFrame(facts, "i int, k string, d int").select("i", "k", days("d").alias("d"))
    got = {x.i: x.v for x in temporal.as_of_merge(f, v, "k", "d", "v", forgiving=forgiving).collect()}
    want = {}
    for i, k, d in facts:
        covering = [n for vk, a, b, n in versions if d is not None and k is not None and vk == k and a is not None and a <= d and (b is None or d < b)]
        last = [(a, n) for vk, a, _, n in versions if k is not None and vk == k and a is not None]
        want[i] = covering[0] if covering else max(last)[1] if forgiving and last else None
    assert got == want == {x.i: x.v for x in temporal.as_of(f, v, "k", "d", "v", forgiving=forgiving).collect()}


def test_equal_starts_do_not_overlap(spark):
    v = spark.sql("SELECT * FROM VALUES (1, 'a', DATE'2024-01-01', DATE'2024-02-01'), (2, 'a', DATE'2024-01-01', NULL), (3, 'a', DATE'2024-01-10', NULL), (4, 'b', DATE'2024-01-01', DATE'2024-01-02'), (5, 'b', DATE'2024-01-02', NULL) AS t(n, id, f, u)")
    assert [r.n for r in temporal.overlapping(v, "id", "f", "u").orderBy("n").collect()] == [3]


def test_upsert_keeps_surrogates_and_the_unknown_member(spark):
    target = spark.sql("SELECT * FROM VALUES (-1L, 'unknown', 'x'), (1L, 'a', 'old'), (2L, 'b', 'same'), (3L, 'gone', 'y') AS t(key, id, name)")
    source = spark.sql("SELECT * FROM VALUES ('a', 'new'), ('b', 'same'), ('c', CAST(NULL AS STRING)) AS t(id, name)")
    assert rows(tables.upsert(target, source, ["id"], "key", delete_missing=True, in_key_order=True).select("key", "id", "_action")) == [(-1, "unknown", "keep"), (1, "a", "update"), (2, "b", "keep"), (4, "c", "insert")]
    assert len(tables.upsert(target, source, ["id"], "key").collect()) == 5


def test_scopes_union_and_no_group_sees_nothing(spark):
    df = spark.sql("SELECT * FROM VALUES ('eng', 1), ('hr', 2), ('fin', 3) AS t(dept, pay)")
    p = governance.Principal(scopes={"g1": {"eng"}, "g2": {"hr"}, "all": governance.ALL}, capabilities={"pay": {"see_pay"}}, groups=("g1", "g2"))
    assert rows(governance.secure(df, p, "dept", {"pay": "see_pay"})) == [("eng", None), ("hr", None)]
    full = governance.Principal(scopes=p.scopes, capabilities=p.capabilities, groups=("all", "pay"))
    assert len(governance.secure(df, full, "dept", {"pay": "see_pay"}).where("pay is not null").collect()) == 3
    assert governance.secure(df, governance.Principal(), "dept", {}).collect() == []


def test_compare_and_lenient_types(spark):
    a = spark.sql("SELECT * FROM VALUES (1, 1.001D), (1, 1.001D), (2, NULL) AS t(k, x)")
    b = spark.sql("SELECT * FROM VALUES (1, 1.002D), (2, NULL), (3, 0D) AS t(k, x)")
    assert rows(tables.compare(a, b)) == [("both", 2), ("left_only", 1), ("right_only", 1)]
    t = spark.sql("SELECT * FROM VALUES ('1'), (''), ('x') AS t(v)")
    assert [r.v for r in t.select(typed("v", "int", lenient=True)).collect()] == [1, None, None]


def test_rank_over_ranges(spark):
    values = [(i % 97 * 1.5, 1 + i % 3) for i in range(97)] + [(None, 2)]
    df = spark.createDataFrame(values, "value double, n long")
    for ranges in (None, 1, 8, 60):
        for r in tables.rank_over(df, "value", "n", "place", ranges).collect():
            assert r.place == 1 + sum(n for v, n in values if v is not None and (r.value is None or v > r.value))
    assert tables.rank_over(df.limit(0), "value", "n", "place").collect() == []


def test_parity_with_a_tolerance(spark):
    a = spark.sql("SELECT * FROM VALUES (1, 'a', 1.004D), (1, 'a', 2D), (2, NULL, CAST(NULL AS DOUBLE)), (3, 'c', 5D), (4, 'd', 1D) AS t(k, s, x)")
    b = spark.sql("SELECT * FROM VALUES (1, 'a', 2.006D), (1, 'a', 1.006D), (2, NULL, NULL), (3, 'c', 5.02D), (5, 'd', 1D) AS t(k, s, x)")
    assert tables.parity(a, a).ok
    p = tables.parity(a, b)
    assert not p.ok and p.same_columns and p.rows == (5, 5) and p.differing == 3
    assert p.diffs[0] == ({"k": 3, "s": "c", "x": 5.0}, {"k": 3, "s": "c", "x": 5.02}) and p.diffs[1][1] is None and p.diffs[2][0] is None
    assert len(tables.parity(a, b, most=1).diffs) == 1 and tables.parity(a, b, most=1).differing == 3
    assert not tables.parity(a, b.select("s", "k", "x")).same_columns
    assert not tables.parity(a, a.limit(4)).ok


def test_drift_and_declared_columns():
    declared = checks.declared_in("""-- a comment, with (brackets
        CREATE TABLE IF NOT EXISTS w.a (x INT NOT NULL, y DECIMAL(12, 2) COMMENT 'y, of (x)', z STRING) USING parquet; CREATE OR REPLACE TABLE b (k BIGINT);""")
    assert declared == {"a": ["x", "y", "z"], "b": ["k"]}
    assert checks.drift(declared, declared) == []
    assert checks.drift(declared, {"a": ["y", "x", "z"], "c": []}) == ["c: not declared", "b: not there", "a: columns are in another order"]
    assert checks.drift({"a": ["x", "y"]}, {"a": ["x", "w"]}) == ["a.y: not there", "a.w: not declared"]


def test_reports_of_other_systems(spark, tmp_path):
    view = "rpt_revenue_trend"
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.sql("SELECT 1 AS n, CAST(2.5 AS DECIMAL(12, 2)) AS v").write.format("jdbc").options(url=url, dbtable=view).save()
    assert [tuple(r) for r in reports.from_jdbc(spark, url, view, "APP").collect()] == [(1, Decimal("2.50"))]
    with pytest.raises(reports.SourceError):
        reports.from_jdbc(spark, url, "users; drop table x")


def test_migrations_run_once_and_never_change(spark, tmp_path):
    store, folder = Store(spark, f"file://{tmp_path}/store"), tmp_path / "sql"
    folder.mkdir()
    (folder / "001_first.sql").write_text("-- makes; a view\nCREATE OR REPLACE TEMP VIEW migrated AS SELECT 1 AS n;\n")
    assert [m.version for m in migrate.run(store, str(folder))] == ["001"] and spark.table("migrated").first().n == 1
    assert migrate.run(store, str(folder)) == []
    (folder / "001_first.sql").write_bytes((folder / "001_first.sql").read_bytes().replace(b"\n", b"\r\n"))
    (folder / "002_broken.sql").write_text("SELECT 1; SELECT no_such_column;")
    with pytest.raises(Exception, match="no_such_column"):
        migrate.run(store, str(folder))
    assert [m.version for m in migrate.pending(store, migrate.discover(str(folder)))] == ["002"]
    (folder / "001_first.sql").write_text("SELECT 2")
    with pytest.raises(migrate.MigrationError, match="changed"):
        migrate.run(store, str(folder))
    (folder / "001_first.sql").rename(folder / "003_first.sql")
    with pytest.raises(migrate.MigrationError, match="without a file"):
        migrate.run(store, str(folder))
    (folder / "003_other.sql").write_text("SELECT 1")
    with pytest.raises(migrate.MigrationError, match="number 003"):
        migrate.discover(str(folder))
    (folder / "x.sql").write_text("")
    with pytest.raises(migrate.MigrationError):
        migrate.discover(str(folder))


def test_near_pairs_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ab") if i % 50 else None, r.choice([r.randrange(4000), 60 * r.randrange(100)]), r.choice("xyz") if i % 31 else None, r.random() < 0.7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, s long, d string, asks boolean").withColumn("at", F.timestamp_seconds("s"))
    found = temporal.near_pairs(df, "k", "at", "id", 300, "d", F.col("asks"), ("s", "d")).collect()
    got = {x.id: x.anchor_id for x in found}
    assert all(x.minutes == (x.s - x.anchor_s) // 60 and x.d == rows[x.id][3] and x.anchor_d == rows[x.anchor_id][3] for x in found)
    want = {}
    for i, k, s, d, asks in rows:
        found = [(s0, i0) for i0, k0, s0, d0, _ in rows if asks and k and d and d0 and k0 == k and s0 < s <= s0 + 300 and d0 != d]
        if found:
            want[i] = max(found)[1]
    assert want and got == want


def test_a_first_snapshot_is_an_upsert_into_the_member_alone(spark):
    member = {"k": F.lit("UNKNOWN"), "d": F.lit("1900-01-01").cast("date"), "v": F.lit("u")}
    kind = "k string, d string, v string"
    for extra in ([], [("UNKNOWN", "1900-01-01", "own")]):
        rows = [(f"k{i}", f"2020-01-{i % 28 + 1:02}", None if i % 3 else "x") for i in range(50)] + [(None, None, "n"), ("UNKNOWN", None, "m"), *extra]
        source = spark.createDataFrame(rows, kind).withColumn("d", F.col("d").cast("date"))
        target = spark.range(1).select(F.lit(-1).cast("long").alias("key"), *[c.alias(n) for n, c in member.items()])
        want = tables.upsert(target, source, ["k", "d"], "key", delete_missing=True).select("key", "k", "d", "v").collect()
        got = tables.first_snapshot(source, ["k", "d"], "key", -1, member).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(rows) + 1 - len(extra)
