"""Reports of another system, read over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans.views import VIEWS


class SourceError(Exception):
    """The report is not known."""


def from_jdbc(spark: SparkSession, url: str, name: str, schema: str = "reporting", **options: str) -> DataFrame:
    """A report's view in a database; a split by a numeric column (partitionColumn and so on) may be given as options."""
    if name not in VIEWS:
        raise SourceError(f"{name} is no report")
    return spark.read.format("jdbc").options(url=url, dbtable=f"{schema}.{name}", **options).load()
