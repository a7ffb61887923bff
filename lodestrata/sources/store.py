"""Tables by version: a version is written whole, checked, and becomes current by one marker file."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

_MARKER = "_PUBLISHED"


class Store:
    """`root/<area>/versions/<n>/<table>`; readers see the highest published version and never a half-written one.

    A build that fails leaves the last version current; the marker is a single create in the folder's own file system.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        p = hadoop.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self, area: str) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.root}/{area}/versions") if n.isdigit())

    def _path(self, area: str, version: int) -> str:
        return f"{self.root}/{area}/versions/{version:09d}"

    def history(self, area: str) -> list[int]:
        """Published versions, oldest first."""
        return [v for v in self._versions(area) if _MARKER in self._names(self._path(area, v))]

    def begin(self, area: str) -> int:
        """A new version number, above all that were ever begun."""
        version = max(self._versions(area), default=0) + 1
        fs, p = self._fs(self._path(area, version))
        fs.mkdirs(p)
        return version

    def write(self, area: str, version: int, table: str, df: DataFrame, order: list[str] | None = None, ids: tuple[str, ...] = ()) -> DataFrame:
        """Write a table of a version and read it back, which ends its lineage.

        With `order` files hold ranges of the first of these columns, sorted by all of them, so that a filter on it skips files
        and row groups by their statistics, as an index would; `ids` get Bloom filters, for lookups of values that are in no order.
        """
        path = f"{self._path(area, version)}/{table}"
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.mode("overwrite").options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in ids}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(self, area: str, version: int) -> None:
        fs, p = self._fs(f"{self._path(area, version)}/{_MARKER}")
        fs.create(p, False).close()

    def read(self, area: str, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a published version (the current one if none is named); none at all before the first."""
        known = self.history(area)
        if version is not None and version not in known:
            raise LookupError(f"{area} has no published version {version}")
        if not known:
            return {}
        path = self._path(area, known[-1] if version is None else version)
        return {n: self.spark.read.parquet(f"{path}/{n}") for n in self._names(path) if not n.startswith(("_", "."))}

    def append(self, log: str, rows: list[tuple], schema: str) -> None:
        """Rows for a log, which accumulates over versions and failures."""
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/logs/{log}")

    def log(self, log: str) -> DataFrame | None:
        path = f"{self.root}/logs/{log}"
        fs, p = self._fs(path)
        return self.spark.read.parquet(path) if fs.exists(p) else None


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
