"""A street graph from a JSON file: a list of vertices with their incoming and outgoing edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EDGE = "id long, name string, distance double, permission string, wheelchairAccessible boolean, stairs boolean, back boolean, startOsmNodeId long, endOsmNodeId long"
SCHEMA = f"index long, label string, name string, x double, y double, trafficLight boolean, freeFlowing boolean, nodeId long, incomingStreetEdges array<struct<{_EDGE.replace(' ', ':').replace(',:', ',')}>>, outgoingStreetEdges array<struct<{_EDGE.replace(' ', ':').replace(',:', ',')}>>"


def vertices(spark: SparkSession, path: str) -> DataFrame:
    """All vertices of the file, nested edges included; missing fields are null."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def edges(found: DataFrame) -> DataFrame:
    """(vertexStartId, vertexEndId, distance, name, stairs, wheelchairAccessible) of the outgoing edges of vertices."""
    e = found.select(F.explode("outgoingStreetEdges").alias("e"))
    return e.select(F.col("e.startOsmNodeId").alias("vertexStartId"), F.col("e.endOsmNodeId").alias("vertexEndId"), "e.distance", "e.name", "e.stairs", "e.wheelchairAccessible")


def places(found: DataFrame) -> DataFrame:
    """(id, lat, lng) of vertices by their map node."""
    return found.select(F.col("nodeId").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lng"))
