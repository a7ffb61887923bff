"""Migrations: numbered SQL files that are applied once, in order, and never change afterwards."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from pathlib import Path

from lodestrata.sources.store import Store, now

LOG = "schema_migration"
_SCHEMA = "version string, name string, checksum string, applied_at timestamp_ntz"
_NAME = re.compile(r"(\d{3})_([a-z0-9_]+)\.sql")


class MigrationError(Exception):
    """Files are named wrongly, have changed since they were applied, or are fewer than what was applied."""


@dataclass(frozen=True)
class Migration:
    version: str
    name: str
    sql: str

    @property
    def checksum(self) -> str:
        """The same for LF and CRLF line ends."""
        return hashlib.sha256(self.sql.replace("\r\n", "\n").encode()).hexdigest()


def discover(folder: str) -> list[Migration]:
    """All migrations of a folder in the order in which they are applied."""
    if not Path(folder).is_dir():
        raise MigrationError(f"no folder {folder}")
    found = {}
    for path in sorted(Path(folder).glob("*.sql")):
        named = _NAME.fullmatch(path.name)
        if not named:
            raise MigrationError(f"{path.name} is not named like 001_some_words.sql")
        if named[1] in found:
            raise MigrationError(f"two migrations have number {named[1]}")
        found[named[1]] = Migration(named[1], named[2], path.read_text(encoding="utf-8"))
    return list(found.values())


def pending(store: Store, migrations: list[Migration]) -> list[Migration]:
    """Those that are still to be applied; an error where what was applied is not what is there now."""
    log = store.log(LOG)
    applied = {r.version: r.checksum for r in log.collect()} if log is not None else {}
    there = {m.version: m.checksum for m in migrations}
    if changed := sorted(v for v, c in applied.items() if there.get(v, c) != c):
        raise MigrationError(f"changed after they were applied: {', '.join(changed)}")
    if unknown := sorted(set(applied) - set(there)):
        raise MigrationError(f"applied, but without a file: {', '.join(unknown)}")
    return [m for m in migrations if m.version not in applied]


def run(store: Store, folder: str) -> list[Migration]:
    """Apply what is pending.  Each migration is logged when its last statement is through, so a failure keeps those before it."""
    todo = pending(store, discover(folder))
    for m in todo:
        for statement in re.sub(r"--[^\n]*", "", m.sql).split(";"):
            if statement.strip():
                store.spark.sql(statement)
        store.append(LOG, [(m.version, m.name, m.checksum, now())], _SCHEMA)
    return todo
