"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of sessions on one machine, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it names none, a session on one machine gets a temporary one; a cluster gets an error,
    because a folder of one machine would be another one elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return _OWN[app]


def work_table(df: DataFrame, name: str) -> DataFrame:
    """`df`, written and read again: what follows starts from files, whatever executors are lost, and no plan repeats it."""
    path = f"{shared_folder(df.sparkSession)}/lodestrata/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
