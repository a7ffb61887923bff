"""Invariants of the star schema, as queries that find the rows that break them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.operators import constraints, tables, temporal

Tables = Mapping[str, DataFrame]

#: Columns that identify a row, by table.
UNIQUE = {
    "dim_date": [["date_key"]], "dim_department": [["department_key"], ["department_code"]], "dim_employee": [["employee_key"], ["employee_id", "valid_from"]],
    "dim_account": [["account_key"], ["account_id"]], "dim_product": [["product_key"], ["product_code"]], "fact_compensation": [["compensation_id"]],
    "fact_performance_review": [["review_id"]], "fact_subscription": [["subscription_id"]], "fact_invoice": [["invoice_id"]], "fact_opportunity": [["opportunity_id"]],
    "fact_usage_daily": [["date_key", "account_key", "product_key"]], "fact_ai_usage": [["event_id"]], "fact_access_event": [["event_id"]],
    "fact_gl_actual": [["actual_id"]], "fact_budget": [["budget_id"]],
}
#: Key columns that may be null; all others must not.
OPTIONAL = {("fact_performance_review", "reviewer_employee_key"), ("fact_subscription", "end_date_key"), ("fact_invoice", "paid_date_key"), ("fact_opportunity", "close_date_key"), ("fact_budget", "approved_date_key")}
_PARENTS = {"date_key": "dim_date", "department_key": "dim_department", "employee_key": "dim_employee", "account_key": "dim_account", "product_key": "dim_product"}


def parent_of(column: str) -> tuple[str, str] | None:
    """(table, key) that a fact's column refers to, by the column's ending."""
    return next(((table, key) for key, table in _PARENTS.items() if column == key or column.endswith("_" + key)), None)


def drift(declared: Mapping[str, list[str]], found: Mapping[str, list[str]]) -> list[str]:
    """What differs between declared and found tables: names, missing and undeclared columns, and their order."""
    out = [f"{t}: not declared" for t in sorted(set(found) - set(declared))] + [f"{t}: not there" for t in sorted(set(declared) - set(found))]
    for t in sorted(set(declared) & set(found)):
        missing, more = [c for c in declared[t] if c not in found[t]], [c for c in found[t] if c not in declared[t]]
        out += [f"{t}.{c}: not there" for c in missing] + [f"{t}.{c}: not declared" for c in more]
        if not missing and not more and declared[t] != found[t]:
            out.append(f"{t}: columns are in another order")
    return out


def declared_in(sql: str) -> dict[str, list[str]]:
    """Columns of each CREATE TABLE in a text of SQL statements; the column list is read by Spark's own parser."""
    out = {}
    plain = re.sub(r"--[^\n]*", "", sql)
    for found in re.finditer(r"(?i)\bcreate\s+(?:or\s+replace\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.]+)\s*\(", plain):
        depth, end = 1, found.end()
        while depth and end < len(plain):
            depth += {"(": 1, ")": -1}.get(plain[end], 0)
            end += 1
        out[found.group(1).split(".")[-1]] = StructType.fromDDL(plain[found.end() : end - 1]).names
    return out


def violations(t: Tables) -> dict[str, DataFrame]:
    """A query by invariant; each has rows only where the invariant does not hold.  Tables that are not given are not checked."""
    out = {}
    for name, keys in UNIQUE.items():
        if name in t:
            for key in keys:
                out[f"{name}: {', '.join(key)} is unique"] = tables.surplus(t[name], key)
    for name in (n for n in UNIQUE if n in t and n.startswith("fact_")):
        for column in t[name].columns:
            parent = parent_of(column)
            if parent and parent[0] in t:
                used = t[name].select(column).distinct()
                out[f"{name}: {column} is in {parent[0]}"] = tables.orphans(used, t[parent[0]], column, parent[1])
                if (name, column) not in OPTIONAL:
                    out[f"{name}: {column} is not null"] = used.where(F.col(column).isNull())
    if "dim_employee" in t:
        people = t["dim_employee"]
        out["dim_employee: versions do not overlap"] = temporal.overlapping(people, "employee_id", "valid_from", "valid_to")
        out["dim_employee: valid_to is after valid_from"] = people.where("valid_to <= valid_from")
        out["dim_employee: one version is current"] = people.groupBy("employee_id").agg(F.count_if("is_current").alias("n")).where("n <> 1")
    if "dq_exception" in t:
        labels = F.col("severity").isin("error", "warning") & F.col("disposition").isin("rejected", "repaired", "flagged")
        found = t["dq_exception"].where(~labels | F.col("target_key").isNull() | F.col("detail").isNull())
        out["dq_exception: labels are known and nothing is null"] = found
    return out


def broken(t: Tables) -> dict[str, int]:
    """Invariants that do not hold, with the rows that break them, found in one job."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in violations(t).items()]
    return {r.name: r.n for r in reduce(DataFrame.unionAll, counts).where("n > 0").collect()} if counts else {}


class Batches:
    """The invariants of keys, parents and versions, checked on each batch alone; what was accepted is kept by bucket under `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _history(self, table: str, key: list[str], columns: tuple[str, ...] = ()) -> constraints.History:
        return constraints.History(self.spark, f"{self.path}/{table}/{'-'.join(key)}", key, columns)

    def _spans(self) -> constraints.History:
        return self._history("dim_employee", ["employee_id"], ("valid_from", "valid_to"))

    def violations(self, batch: Tables, number: int) -> dict[str, DataFrame]:
        """As `violations`, with rows that only the batch can be blamed for.  Parents are looked for in the batch's own tables too."""
        out = {}
        for name, df in batch.items():
            for key in UNIQUE.get(name, []):
                out[f"{name}: {', '.join(key)} is unique"] = constraints.repeated(df, self._history(name, key), number)
            for column in df.columns if name.startswith("fact_") else []:
                if not (parent := parent_of(column)):
                    continue
                missing = constraints.without_parent(df, column, self._history(parent[0], [parent[1]]), number)
                if parent[0] in batch:
                    missing = tables.orphans(missing, batch[parent[0]], column, parent[1])
                out[f"{name}: {column} is in {parent[0]}"] = missing
                if (name, column) not in OPTIONAL:
                    out[f"{name}: {column} is not null"] = df.where(F.col(column).isNull()).select(column)
        if "dim_employee" in batch:
            out["dim_employee: versions do not overlap"] = constraints.overlapping(batch["dim_employee"], self._spans(), number, "employee_id", "valid_from", "valid_to")
        return out

    def accept(self, batch: Tables, number: int) -> None:
        for name, df in batch.items():
            for key in UNIQUE.get(name, []):
                self._history(name, key).add(df, number)
        if "dim_employee" in batch:
            self._spans().add(batch["dim_employee"], number)
