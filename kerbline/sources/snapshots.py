"""Versioned snapshots of tables in a shared folder: a version is written whole, checked, and only then named the current one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.lineage import shared_folder


class Snapshots:
    """One table's versions under a folder. Readers keep their version while a new one is written."""

    def __init__(self, spark: SparkSession, folder: str, least_share: float = 0.8):
        self.spark, self.folder, self.least_share = spark, folder, least_share

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.json(f"{self.folder}/log", schema="version long, rows long, at double")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def current(self) -> tuple[int, int, float] | None:
        """(version, rows, time) of the newest version."""
        log = self._log()
        last = log.orderBy(F.desc("version")).first() if log is not None else None
        return tuple(last) if last else None

    def read(self) -> DataFrame:
        found = self.current()
        if not found:
            raise LookupError(f"no snapshot in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v{found[0]}")

    def save(self, table: DataFrame) -> int:
        """A new version; refused if it has less than least_share of the rows of the current one."""
        last = self.current()
        version = last[0] + 1 if last else 1
        path = f"{self.folder}/v{version}"
        table.write.mode("overwrite").option("compression", "gzip").parquet(path)
        rows = self.spark.read.parquet(path).count()
        if last and rows < self.least_share * last[1]:
            raise ValueError(f"{rows} rows after {last[1]}: the version is not used")
        entry = self.spark.createDataFrame([(version, rows, time.time())], "version long, rows long, at double")
        entry.coalesce(1).write.mode("append").json(f"{self.folder}/log")
        return version

    def reload(self, build: Callable[[], DataFrame], attempts: int = 5, wait: float = 30.0) -> int:
        """save() of what build makes, tried again after failures."""
        for attempt in range(1, attempts + 1):
            try:
                return self.save(build())
            except ValueError:
                raise
            except Exception:
                if attempt == attempts:
                    raise
                time.sleep(wait)
        raise AssertionError("not reached")

    def is_fresh(self, seconds: float) -> bool:
        found = self.current()
        return bool(found) and time.time() - found[2] < seconds


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """(key, rows): all rows of each key as an array of structs, for look-ups by key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct(*rest)).alias("rows"))


def fetch(groups: DataFrame, keys: DataFrame) -> DataFrame:
    """The groups of several keys (key) at once; keys without one give nothing."""
    return groups.join(keys.distinct(), "key", "left_semi")


def saved_together(spark: SparkSession, tables: dict[str, DataFrame], folder: str | None = None) -> dict[str, DataFrame]:
    """Tables written into one new folder and read back. The folder's `done` file comes last: readers take no folder without it."""
    folder = folder or f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    spark.range(1).coalesce(1).write.parquet(f"{folder}/done")
    return {name: spark.read.schema(rows.schema).parquet(f"{folder}/{name}") for name, rows in tables.items()}
