"""A stream of accessibility reports, applied to the stops' table batch by batch as new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbline.operators.tables import update
from kerbline.sources.snapshots import Snapshots

REPORT = "id long, isAccessible boolean, at timestamp"


def latest(reports: DataFrame) -> DataFrame:
    """The last report of each stop; of reports at one time the one that bars access."""
    return reports.groupBy("id").agg(F.max_by("isAccessible", F.struct("at", ~F.col("isAccessible"))).alias("isAccessible"))


def follow(spark: SparkSession, folder: str, stops: Snapshots, checkpoint: str) -> StreamingQuery:
    """Applies JSON reports (REPORT) that arrive in a folder. A batch that is tried again gives the same table."""

    def apply(batch: DataFrame, _: int) -> None:
        stops.save(update(stops.read(), latest(batch), ["id"]))

    reports = spark.readStream.schema(REPORT).json(folder)
    return reports.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
