"""Tables laid out for joins and lookups: buckets of a key, sorted within, and Bloom filters of ids.

Two tables in as many buckets of the key that they are joined by meet without an exchange, however often they are joined.  A Bloom
filter in each row group lets a lookup of one id skip the row groups that do not hold it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _about(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_layout.json")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write(df: DataFrame, path: str, key: str, buckets: int, ids: tuple[str, ...] = (), row_group: int | None = None) -> DataFrame:
    """Writes `df` in buckets of `key`, sorted by it, with Bloom filters of `ids`, and reads it back.

    Each bucket is one file: rows are dealt to buckets before they are written.  `row_group`: bytes of a row group.
    """
    spark, name = df.sparkSession, f"layout_{uuid.uuid4().hex}"
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ids}
    if row_group:
        options["parquet.block.size"] = str(row_group)
    df.repartition(buckets, key).write.options(compression="zstd", path=path, **options).bucketBy(buckets, key).sortBy(key).saveAsTable(name, format="parquet")
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table only named them
    fs, p = _about(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"schema": df.schema.jsonValue(), "key": key, "buckets": buckets}).encode()))
    out.close()
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table that `write` wrote, in any session, with its layout known to the planner."""
    fs, p = _about(spark, path)
    source = fs.open(p)
    about = json.loads(bytes(source.readAllBytes()).decode())
    source.close()
    schema = StructType.fromJson(about["schema"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    name = f"layout_{uuid.uuid4().hex}"
    key, n = about["key"], about["buckets"]
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)
