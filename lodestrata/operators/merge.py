"""Merges that touch only what changes: a keyed table in buckets of its keys' hash, each bucket a folder of its own.

A snapshot names a folder for each bucket.  A merge reads and writes the buckets that its rows can be in, and the next snapshot names
the old folders of all others, which stay as they are, unread.  Where the source is a whole table, buckets are compared by digests
first, so that a source without changes reads and writes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import tables
from lodestrata.operators.work import work_table

_MANIFEST = "bucket int, folder string, n bigint, digest decimal(38,0), top bigint"


@dataclass(frozen=True)
class Bucket:
    """A bucket's folder, its rows without the kept member, their digest, and its largest surrogate."""

    folder: str
    n: int
    digest: object
    top: int


@dataclass(frozen=True)
class Snapshot:
    """A version of a table: rows with `keys`, a surrogate in `key_column` and values; the row at `never` belongs to no source."""

    path: str
    keys: tuple[str, ...]
    key_column: str
    buckets: int
    schema: object
    never: int = -1
    held: dict[int, Bucket] = field(default_factory=dict)

    def of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def rows(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other folder is opened."""
        wanted = [self.held[b].folder for b in sorted(self.held) if buckets is None or b in buckets]
        return spark.read.schema(self.schema).parquet(*wanted) if wanted else spark.createDataFrame([], self.schema)

    def key_of(self, spark: SparkSession, **natural) -> DataFrame:
        """The row of one natural key: one folder, and in it only what the files' Bloom filters let through."""
        row = spark.createDataFrame([tuple(natural[k] for k in self.keys)], spark.createDataFrame([], self.schema).select(*self.keys).schema)
        bucket = row.select(self.of().alias("b")).first()["b"]
        found = self.rows(spark, [bucket])
        for k in self.keys:
            found = found.where(F.col(k).eqNullSafe(F.lit(natural[k])))
        return found

    def save(self, spark: SparkSession, name: str) -> None:
        rows = [(b, x.folder, x.n, x.digest, x.top) for b, x in sorted(self.held.items())]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/_snapshots/{name}")

    def load(self, spark: SparkSession, name: str) -> Snapshot:
        rows = spark.read.schema(_MANIFEST).parquet(f"{self.path}/_snapshots/{name}").collect()  # a row for each bucket
        return replace(self, held={r["bucket"]: Bucket(r["folder"], r["n"], r["digest"], r["top"]) for r in rows})


def _digests(df: DataFrame, snapshot: Snapshot, columns: list[str]) -> DataFrame:
    """(bucket, n, digest) over rows in any order; a null is unlike any value and any other column's null."""
    row = F.xxhash64(F.array(*[F.col(c).isNull() for c in columns]), *columns)
    return df.groupBy(snapshot.of().alias("bucket")).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest"))


def _write(snapshot: Snapshot, rows: DataFrame, touched: list[int]) -> Snapshot:
    """The next snapshot, with `rows` in place of the touched buckets."""
    spark = rows.sparkSession
    folder = f"{snapshot.path}/{uuid.uuid4().hex}"
    out = rows.withColumn("_bucket", snapshot.of()).repartition("_bucket").sortWithinPartitions("_bucket", *snapshot.keys)
    blooms = {f"parquet.bloom.filter.enabled#{k}": "true" for k in snapshot.keys}
    out.write.options(compression="zstd", **blooms).partitionBy("_bucket").parquet(folder)
    written = spark.read.schema(snapshot.schema).parquet(folder)
    values = [c for c in snapshot.schema.names if c != snapshot.key_column]
    own = F.col(snapshot.key_column) != snapshot.never
    about = {r["bucket"]: r for r in _digests(written.where(own), snapshot, values).collect()}
    tops = {r["bucket"]: r["top"] for r in written.groupBy(snapshot.of().alias("bucket")).agg(F.max(snapshot.key_column).alias("top")).collect()}
    held = {b: x for b, x in snapshot.held.items() if b not in touched}
    for b, top in tops.items():
        n, digest = (about[b]["n"], about[b]["digest"]) if b in about else (0, None)
        held[b] = Bucket(f"{folder}/_bucket={b}", n, digest, top)
    return replace(snapshot, held=held)


def create(df: DataFrame, path: str, keys: list[str], key_column: str, buckets: int = 256, never: int = -1) -> Snapshot:
    """The first snapshot of a table.  A bucket should hold a file's worth: it is what a change rewrites."""
    empty = Snapshot(path, tuple(keys), key_column, buckets, df.schema, never)
    return _write(empty, df, [])


@dataclass(frozen=True)
class Merged:
    """The snapshot after a merge, the buckets that it read and wrote, and how many rows it inserted, updated and deleted."""

    snapshot: Snapshot
    touched: tuple[int, ...]
    inserted: int = 0
    updated: int = 0
    deleted: int = 0


def merge(snapshot: Snapshot, source: DataFrame, whole: bool = False, delete_missing: bool = False) -> Merged:
    """Rows of the source take the place of those with their keys, or are added with surrogates above the largest.

    A key should be in the source once.  `whole`: the source is all there should be; buckets whose rows have the same digest are
    left alone, and with `delete_missing` rows that it lacks go.  Surrogates are those that `tables.upsert` would give.
    """
    if delete_missing and not whole:
        raise ValueError("only a whole source tells what is missing")
    spark = source.sparkSession
    columns = [c for c in snapshot.schema.names if c != snapshot.key_column]
    source = source.select(*[F.col(c).cast(snapshot.schema[c].dataType).alias(c) for c in columns])
    if whole:
        given = {r["bucket"]: (r["n"], r["digest"]) for r in _digests(source, snapshot, columns).collect()}
        before = {b: (x.n, x.digest) for b, x in snapshot.held.items() if x.n}
        touched = [b for b in range(snapshot.buckets) if given.get(b) != before.get(b) and (delete_missing or b in given)]
    else:
        touched = [r["bucket"] for r in source.select(snapshot.of().alias("bucket")).distinct().collect()]
    if not touched:
        return Merged(snapshot, ())
    old = snapshot.rows(spark, touched)
    rows = source.where(snapshot.of().isin(touched))
    top = max((x.top for x in snapshot.held.values()), default=0)
    done = tables.upsert(old, rows, list(snapshot.keys), snapshot.key_column, delete_missing, snapshot.never, top=max(top, 0))
    done = work_table(done, "merged")
    n = {r["_action"]: r["n"] for r in done.groupBy("_action").agg(F.count("*").alias("n")).collect()}
    deleted = old.count() - n.get("update", 0) - n.get("keep", 0)
    after = _write(snapshot, done.select(*snapshot.schema.names), touched)
    return Merged(after, tuple(sorted(touched)), n.get("insert", 0), n.get("update", 0), deleted)
