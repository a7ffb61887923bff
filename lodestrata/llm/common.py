"""Shared pieces: work tables in the cluster's shared folder, bounded batches, and vectorised text scanning."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time (a longer document is a step of its own).
STEP_BYTES = 4 << 20
#: ASCII white space, the only separator of words here: \t \n \v \f \r and space.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)


#: Temporary folders of sessions on one machine, by application.
_OWN: dict[str, str] = {}
#: Paths made inside work_tables, by block.
_TRACKED: list[list[str]] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data, read by Spark's own reader whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a session on one machine gets a temporary folder; on a cluster that folder would be another one on
    every machine, and reads would silently miss rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a work table in the shared folder."""
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    for paths in _TRACKED:
        paths.append(path)
    return path


@contextlib.contextmanager
def work_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Work tables that are made inside go at the end, but for those given to what this yields; what is computed from the
    others must be written by then."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df.work_path)
        return df

    _TRACKED.append(paths)
    try:
        yield keep
    finally:
        _TRACKED.remove(paths)
        drop_paths(spark, paths)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        p = hadoop.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


def broadcast_arrays(spark: SparkSession, limit: int, **arrays: np.ndarray):
    """Broadcast numpy arrays after checking their total size against `limit` bytes."""
    total = sum(a.nbytes for a in arrays.values())
    if total > limit:
        raise ValueError(f"{total} bytes to broadcast; the bound is {limit}")
    return spark.sparkContext.broadcast(arrays)


def steps(batches: Iterator[pd.DataFrame], column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Cut batches into runs of rows whose texts hold about `limit` bytes; yields the rows and their UTF-8 texts (null: empty)."""
    for frame in batches:
        at, size, texts = 0, 0, []
        for i, value in enumerate(frame[column]):
            text = value.encode("utf-8", "surrogatepass") if isinstance(value, str) else b""
            if texts and size + len(text) > limit:
                yield frame.iloc[at:i], texts
                at, size, texts = i, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield frame.iloc[at:], texts


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of a run of texts: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased on demand, as positions and 64-bit hashes.

    `start`, `end`: byte ranges in the joined texts; `doc`: the text that holds the word; `hash`: equal words have equal
    hashes, and two different words share one with a chance of about 2**-64.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        raw = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
        data = _LOWER[raw] if lower else raw
        gap = _IS_SPACE[data]
        inside = np.empty(len(data) + 1, np.int8)
        inside[0] = 0
        inside[1:] = ~gap
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(lengths)])
        self.n_docs = len(texts)
        self.data = data
        first = np.searchsorted(self.start, self.doc_start)
        self.per_doc = np.diff(first)
        self.first = first
        self.doc = np.repeat(np.arange(self.n_docs), self.per_doc)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _powers(_INVERSE, len(data) + 1)[self.start]
        self.hash = mix64(value + mix64((self.end - self.start).astype(np.uint64)))


def crc_remainder(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n, as a column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def mapped(df: DataFrame, keep: list[str], read: list[str], run, extra: str) -> DataFrame:
    """mapInPandas that passes `keep` columns through unchanged.

    pandas has no null among integers, so kept columns travel as text and get their types back afterwards.  `run` yields
    frames with the kept columns and those that `extra` (a DDL string) declares.
    """
    types = {c: df.schema[c].dataType for c in keep}
    sent = df.select(*[F.col(c).cast("string").alias(c) for c in keep], *[c for c in read if c not in keep])
    out = ", ".join([f"`{c}` string" for c in keep] + [extra])
    made = sent.mapInPandas(run, out)
    return made.select(*[F.col(c).cast(types[c]).alias(c) for c in keep], *[c for c in made.columns if c not in keep])
