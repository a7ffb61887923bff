"""Extracts: CSV files with a manifest, written, checked and landed as text."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.registry import DATASETS, TIERS
from lodestrata.sources.store import Store, now

AREA = "landing"
AUDIT = "load_audit"
#: Bytes of a file from which it is hashed as a stream, and datasets that are landed at a time.
LARGE, AT_ONCE = 128 << 20, 8
_AUDIT_SCHEMA = "version int, dataset string, path string, sha256 string, bytes long, rows_expected long, rows_loaded long, loaded_at timestamp_ntz"


class LoadError(Exception):
    """The extract is incomplete, altered or unknown; what was landed before stays current."""


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def write_dataset(df: DataFrame, name: str, folder: str) -> dict:
    """`<name>.csv`, one file in key order, LF, header, empty for null; returns its manifest entry."""
    d = DATASETS[name]
    text = df.select(*[F.col(c).cast("string").alias(c) for c in d.columns])
    # later columns break ties of the key, so the file is the same on every run
    order = [*d.key, *[c for c in d.columns if c not in d.key]]
    part, path = os.path.join(folder, f".{name}"), os.path.join(folder, f"{name}.csv")
    counted = Observation(name)
    text.orderBy(*order).coalesce(1).observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").csv(f"file://{os.path.abspath(part)}", header=True, emptyValue="", lineSep="\n")
    (written,) = glob.glob(f"{part}/part-*.csv")
    os.replace(written, path)
    shutil.rmtree(part)
    return {"dataset": name, "path": f"{name}.csv", "rows": counted.get["n"], "bytes": os.path.getsize(path), "sha256": sha256_of(path)}


def write_manifest(folder: str, files: list[dict], injections: list[dict], **inputs) -> dict:
    """`manifest.json` with sorted keys and no clock in it."""
    classification = [
        {"dataset": d.name, "steward": d.steward, "max_tier": d.max_tier, "retention_days": d.retention_days, "primary_key": list(d.key), "columns_by_tier": {t: d.columns_of(t) for t in TIERS if d.columns_of(t)}}
        for d in DATASETS.values()
    ]
    injections = sorted(injections, key=lambda i: (i["defect"], i["target_key"]))
    manifest = {**inputs, "total_rows": sum(f["rows"] for f in files), "files": files, "classification": classification, "injections": injections}
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    return manifest


def uri(folder: str) -> str:
    """A folder as Spark's readers name it: a path without a scheme is one of this machine."""
    return folder.rstrip("/") if "://" in folder else f"file://{os.path.abspath(folder)}"


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of an extract in any store that Spark reads."""
    path = f"{uri(folder)}/manifest.json"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise LoadError(f"no manifest at {path}")
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def digests(spark: SparkSession, folder: str, large: int = LARGE) -> dict[str, str]:
    """SHA-256 of each CSV file by name, taken by tasks.

    Files above `large` bytes are read as streams, a few megabytes at a time, so they may be of any size; these must lie in a store that
    Arrow can open (local, HDFS, S3, GCS).  Others are read by Spark's own binary reader in whatever store it knows.
    """

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in batches:
            made = []
            for path in frame["path"]:
                store, at = fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with store.open_input_stream(at, compression=None) as f:
                    while chunk := f.read(4 << 20):
                        digest.update(chunk)
                made.append(digest.hexdigest())
            yield frame.assign(sha256=made)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(uri(folder))
    small = files.where(F.col("length") <= large).select("path", F.sha2("content", 256).alias("sha256"))
    listed = [(r.path,) for r in files.where(F.col("length") > large).select("path").collect()]  # a row for each dataset's file
    found = small.collect()
    if listed:
        found += spark.createDataFrame(listed, "path string").repartition(len(listed)).mapInPandas(streams, "path string, sha256 string").collect()
    return {r.path.rsplit("/", 1)[-1]: r.sha256 for r in found}


def check(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Every listed file is there, unaltered and of a known dataset, and no dataset is missing."""
    names = [f["dataset"] for f in manifest["files"]]
    if unknown := sorted(set(names) - set(DATASETS)):
        raise LoadError(f"unknown datasets: {', '.join(unknown)}")
    if missing := sorted(set(DATASETS) - set(names)):
        raise LoadError(f"datasets without a file: {', '.join(missing)}")
    found = digests(spark, folder)
    for f in manifest["files"]:
        name = f["path"].split("/")[-1]
        if name not in found:
            raise LoadError(f"{f['dataset']}: no file at {uri(folder)}/{f['path']}")
        if found[name] != f["sha256"]:
            raise LoadError(f"{f['dataset']}: {uri(folder)}/{f['path']} is not the file of the manifest")


def upload(spark: SparkSession, folder: str, target: str) -> None:
    """Copies a checked extract to a folder of any store that Spark writes, and checks what arrived; the manifest comes last, so an
    extract that is cut short has none."""
    manifest = read_manifest(spark, folder)
    check(spark, folder, manifest)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name in [*[f["path"] for f in manifest["files"]], "manifest.json"]:
        a, b = hadoop.Path(f"{uri(folder)}/{name}"), hadoop.Path(f"{uri(target)}/{name}")
        hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    check(spark, target, read_manifest(spark, target))


def read_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A dataset's file as text; its header must name the declared columns in order."""
    return spark.read.csv(path, header=True, schema=DATASETS[name].landed_schema, enforceSchema=False)


def load(spark: SparkSession, folder: str, store: Store) -> int:
    """Land a checked extract as a new version and return its number.

    All files or none become current.  Each file leaves a row in the audit log; counts that differ from the manifest's are an
    error, and the version is then not published.
    """
    manifest = read_manifest(spark, folder)
    check(spark, folder, manifest)
    version = store.begin(AREA)

    def land(f: dict) -> tuple:
        path = f"{uri(folder)}/{f['path']}"
        loaded = store.write(AREA, version, f["dataset"], read_csv(spark, f["dataset"], path)).count()
        return (version, f["dataset"], path, f["sha256"], f["bytes"], f["rows"], loaded, now())

    # most datasets are a few tasks: several at a time keep executors busy
    with ThreadPoolExecutor(AT_ONCE) as pool:
        audit = list(pool.map(land, manifest["files"]))
    wrong = [f"{dataset}: {loaded} rows, not {expected}" for _, dataset, _, _, _, expected, loaded, _ in audit if loaded != expected]
    store.append(AUDIT, audit, _AUDIT_SCHEMA)
    if wrong:
        raise LoadError("; ".join(wrong))
    store.publish(AREA, version)
    return version


def injections(spark: SparkSession, manifest: dict) -> DataFrame:
    """The defects that an extract is known to hold: (rule_code, dataset, target_key)."""
    rows = [(i["defect"], i["dataset"], i["target_key"]) for i in manifest.get("injections", [])]
    return spark.createDataFrame(rows, "rule_code string, dataset string, target_key string")
