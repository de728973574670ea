"""Changes of tables as new DataFrames: upserts, deletions, keys, and first-of-group rows. Results are for one write of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.lineage import checkpoint


def update(table: DataFrame, changes: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """table with the rows of changes of equal keys put in: all other columns of changes, or those named. Keys without a row change nothing."""
    names = [c for c in changes.columns if c not in keys and (only is None or c in only)]
    new = changes.select(*keys, F.struct(*names).alias("_new"))
    return table.join(new, keys, "left").select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """update(), and the changes of new keys added."""
    return update(table, changes, keys).unionByName(changes.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def delete(table: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(ids.select(*keys), keys, "left_anti")


def insert(table: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """table with rows added, whose ids go on from the largest in the given total order."""
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return table.unionByName(dense_ids(rows.drop("id"), order).crossJoin(F.broadcast(last)).withColumn("id", F.col("id") + F.col("last")).select(*table.columns))


def dense_ids(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Ids from 1 in a total order: ranges are sorted apart and numbered from the counts before them, without a global sort in one task."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # written once, so that the rows' parts and the parts' sizes come from one and the same division
    inner = checkpoint(ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(before.drop("_n")), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def first_of(rows: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an order: an aggregation with map-side minima, not a sort of the group."""
    pick = F.max_by if last else F.min_by
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(pick(whole, F.struct(*order)).alias("_row")).select("_row.*")


def associate_ramps(crossings: DataFrame, lines: DataFrame) -> DataFrame:
    """crossings with rampStartId or rampEndId from lines (line, rampId, vertexId, crossingId); later lines overrule earlier ones."""
    ends = lines.join(crossings.select(F.col("id").alias("crossingId"), "vertexStartId", "vertexEndId"), "crossingId")
    pick = lambda end: F.max_by("rampId", F.when(F.col("vertexId") == F.col(end), F.col("line")))
    got = ends.groupBy(F.col("crossingId").alias("id")).agg(pick("vertexStartId").alias("_start"), pick("vertexEndId").alias("_end"))
    return crossings.join(got, "id", "left").withColumns({"rampStartId": F.coalesce("_start", "rampStartId"), "rampEndId": F.coalesce("_end", "rampEndId")}).drop("_start", "_end")


def ramps_of_two_vertices(lines: DataFrame) -> DataFrame:
    """Ramps that an association gives to more than one vertex."""
    return lines.groupBy("rampId").agg(F.count_distinct("vertexId").alias("vertices")).where("vertices > 1")
