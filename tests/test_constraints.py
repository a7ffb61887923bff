"""Constraints over a history of batches are those of the whole table."""

import datetime as dt
import os
import random

from lodestrata.operators import constraints, tables, temporal
from lodestrata.plans import checks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repeated_keys_and_missing_parents_over_batches(spark, tmp_path):
    r = random.Random(2)
    batches = [[(r.randrange(60) if r.random() > 0.05 else None, r.choice("ab"), r.randrange(40) if r.random() > 0.1 else None) for _ in range(25)] for _ in range(4)]
    parents = [[(i,) for i in range(n * 9, n * 9 + 9)] for n in range(4)]
    held = constraints.History(spark, f"file://{tmp_path}/facts", ["k", "s"], buckets=8)
    above = constraints.History(spark, f"file://{tmp_path}/parents", ["p"], buckets=8)
    schema, repeated = "k int, s string, ref int", set()
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema)
        above.add(spark.createDataFrame(parents[n], "p int"), n)
        found = constraints.repeated(df, held, n)
        earlier = [b[:2] for past in batches[:n] for b in past]
        assert rows(found) == sorted({(k, s, sum(b[:2] == (k, s) for b in batch)) for k, s, _ in batch if (k, s) in earlier or sum(b[:2] == (k, s) for b in batch) > 1}, key=str)
        repeated |= {(x.k, x.s) for x in found.collect()}
        known = {p for past in parents[: n + 1] for (p,) in past}
        assert rows(constraints.without_parent(df, "ref", above, n)) == sorted({(ref,) for *_, ref in batch if ref is not None and ref not in known}, key=str)
        held.add(df, n)
        assert rows(constraints.repeated(df, held, n)) == rows(found)  # checked again, its own rows are not earlier ones
    whole = spark.createDataFrame([b for batch in batches for b in batch], schema)
    assert repeated == {(x.k, x.s) for x in tables.surplus(whole, ["k", "s"]).collect()}


def test_overlaps_over_batches_are_those_of_the_whole(spark, tmp_path):
    r = random.Random(9)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    batches = []
    for _ in range(5):
        starts = [r.randrange(200) for _ in range(12)]
        batches.append([(r.choice(["a", "b", "c", None]), day(s) if r.random() > 0.05 else None, day(s + r.randrange(1, 12)) if r.random() > 0.1 else None) for s in starts])
    schema = "k string, a date, b date"
    held, found = constraints.History(spark, f"file://{tmp_path}/spans", ["k"], ["a", "b"], buckets=4), []
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema)
        found += rows(constraints.overlapping(df, held, n, "k", "a", "b"))
        held.add(df, n)
    whole = temporal.overlapping(spark.createDataFrame([b for batch in batches for b in batch], schema), "k", "a", "b")
    assert found and sorted(found, key=str) == rows(whole)


def test_a_batch_opens_its_own_buckets(spark, tmp_path):
    held = constraints.History(spark, f"file://{tmp_path}/keys", ["id"], buckets=64)
    held.add(spark.range(5000), 0)
    near = held.near(spark.range(3), 1)
    opened = {os.path.basename(os.path.dirname(f)) for f in near.inputFiles()}
    assert len(opened) <= 3 and rows(constraints.repeated(spark.range(4998, 5002), held, 1)) == [(4998, 1), (4999, 1)]
    assert held.near(spark.range(3), 0).count() == 0


def test_batches_of_the_star_schema(spark, tmp_path):
    departments = lambda *keys: spark.createDataFrame([(k, f"D{k}") for k in keys], "department_key long, department_code string")
    budgets = lambda *rows: spark.createDataFrame(rows, "budget_id string, department_key long")
    held = checks.Batches(spark, f"file://{tmp_path}/held")

    def check(batch, n):
        found = {name: rows(df) for name, df in held.violations(batch, n).items()}
        held.accept(batch, n)
        return {name: x for name, x in found.items() if x}

    assert check({"dim_department": departments(-1, 1), "fact_budget": budgets(("a", 1), ("b", -1))}, 0) == {}
    assert check({"fact_budget": budgets(("c", 1), ("a", 2), ("d", None))}, 1) == {
        "fact_budget: budget_id is unique": [("a", 1)], "fact_budget: department_key is in dim_department": [(2,)], "fact_budget: department_key is not null": [(None,)],
    }
    assert check({"dim_department": departments(2, 1), "fact_budget": budgets(("e", 2))}, 2) == {
        "dim_department: department_key is unique": [(1, 1)], "dim_department: department_code is unique": [("D1", 1)],
    }
