"""Versioned tables on plain Parquet: write a new version, commit it last, read committed only.

Layout: `<base>/<table>/version=N/` and `<base>/_commits/version=N/`. A run that dies before its
commit leaves files no reader looks at; the next run writes over them under the same number.
One writer at a time is assumed (a scheduler rule), as with any plain-file table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F


# A folder that is not there, or holds no data file yet. Any other error is a fault of the storage or
# of a file, and must not be taken for an empty table.
NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_there(reader: DataFrameReader, path: str) -> DataFrame | None:
    """A Parquet table, or None before anything was written."""
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in NOTHING_THERE:
            return None
        raise


class Versions:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, table: str, version: int | None = None) -> str:
        path = f"{self.base}/{table}"
        return path if version is None else f"{path}/version={version}"

    def commits(self) -> DataFrame | None:
        """Committed versions with their run details; None before the first one."""
        return read_if_there(self.spark.read.option("mergeSchema", "true"), self._path("commits"))

    def latest(self) -> int | None:
        commits = self.commits()
        return None if commits is None else commits.agg(F.max("version")).first()[0]

    def write(self, tables: Mapping[str, DataFrame], details: DataFrame | None = None) -> int:
        """Write all tables of one version, then its one-row commit record."""
        version = (self.latest() or 0) + 1
        for name, rows in tables.items():
            self.write_uncommitted(name, version, rows)
        self.commit(version, details)
        return version

    def write_uncommitted(self, table: str, version: int, rows: DataFrame) -> None:
        """One table of a version; readers see it once the version is committed."""
        rows.write.mode("overwrite").parquet(self._path(table, version))

    def commit(self, version: int, details: DataFrame | None = None) -> None:
        row = details if details is not None else self.spark.range(1).select(
            F.current_timestamp().alias("committed_at"))
        row.coalesce(1).write.mode("overwrite").parquet(self._path("commits", version))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """One version (default: the latest committed)."""
        version = self.latest() if version is None else version
        if version is None:
            raise ValueError(f"{self.base} has no committed version")
        return self.spark.read.parquet(self._path(table, version))

    def read_all(self, table: str) -> DataFrame | None:
        """All committed versions together, with their `version` column."""
        commits = self.commits()
        if commits is None:
            return None
        # one small row per commit; `compact` keeps their number down
        done = commits.select("version").distinct()
        return self.spark.read.parquet(self._path(table)).join(done, "version", "left_semi")
