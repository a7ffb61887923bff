"""Row scopes and column masks, two axes that a principal's groups widen independently."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = None


@dataclass(frozen=True)
class Principal:
    """Groups give departments (a scope of ALL sees every row) and capabilities; no group gives nothing."""

    scopes: dict[str, set | None] = field(default_factory=dict)
    capabilities: dict[str, set[str]] = field(default_factory=dict)
    groups: tuple[str, ...] = ()

    def departments(self) -> set | None:
        found: set = set()
        for group in self.groups:
            if group in self.scopes:
                if self.scopes[group] is ALL:
                    return ALL
                found |= self.scopes[group]
        return found

    def can(self, capability: str) -> bool:
        return any(capability in self.capabilities.get(g, ()) for g in self.groups)


def secure(df: DataFrame, principal: Principal, scope_column: str | None, masks: dict[str, str]) -> DataFrame:
    """Rows of the principal's departments, and typed nulls in columns whose capability the principal lacks.

    The scope becomes a literal predicate, which is pushed to the scan.
    """
    if scope_column is not None and (departments := principal.departments()) is not ALL:
        df = df.where(F.col(scope_column).isin(sorted(departments))) if departments else df.where(F.lit(False))
    hidden = {c for c, capability in masks.items() if not principal.can(capability)}
    return df.select(*[F.lit(None).cast(kind).alias(c) if c in hidden else F.col(c) for c, kind in df.dtypes])
