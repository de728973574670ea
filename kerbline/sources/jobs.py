"""Jobs that build a map and save it: streets from a map file, sidewalks around them, ramps and their crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.functions import geo as G
from kerbline.operators import sidewalks, tables
from kerbline.operators.graph import purge
from kerbline.operators.lineage import checkpoint
from kerbline.operators.streets import vertices as ends_of
from kerbline.operators.walk import moved_ramps
from kerbline.sources import osm, ramps
from kerbline.sources.snapshots import saved_together


def build_streets(spark: SparkSession, path: str, folder: str | None = None) -> dict[str, DataFrame]:
    """vertex and edge tables of a map file's streets, only those of the largest connected part, saved together."""
    nodes, edges = osm.street_graph(spark, path)
    kept = checkpoint(purge(checkpoint(edges)))
    return saved_together(spark, {"vertex": ends_of(kept, nodes), "edge": kept}, folder)


def build_sidewalks(spark: SparkSession, vertices: DataFrame, edges: DataFrame, offset: float = G.SIDEWALK_OFFSET, folder: str | None = None) -> dict[str, DataFrame]:
    """corner, sidewalk and crossing tables around a street graph, without the parts that are cut off from the largest, saved together."""
    corners, walks, crosses = sidewalks.build(vertices, edges, offset)
    both = checkpoint(walks.withColumnsRenamed({"fromCorner": "vertexStartId", "toCorner": "vertexEndId"}).select("key", "vertexStartId", "vertexEndId").unionByName(
        crosses.withColumnsRenamed({"fromCorner": "vertexStartId", "toCorner": "vertexEndId"}).select("key", "vertexStartId", "vertexEndId")))
    kept = checkpoint(purge(both).select("key"))
    walks, crosses = walks.join(kept, "key", "left_semi"), crosses.join(kept, "key", "left_semi")
    used = walks.select("fromCorner", "toCorner").union(crosses.select("fromCorner", "toCorner"))
    corners = corners.join(used.selectExpr("explode(array(fromCorner, toCorner)) as corner").distinct(), "corner", "left_semi")
    return saved_together(spark, {"corner": corners, "sidewalk": walks, "crossing": crosses}, folder)


def load_ramps(spark: SparkSession, points: list[str], plain: list[str], folder: str | None = None) -> DataFrame:
    """All ramps of files of both forms with ids in order of place and address, saved."""
    rows = ramps.concat([*(ramps.read_points(spark, p) for p in points), *(ramps.read_plain(spark, p) for p in plain)])
    return saved_together(spark, {"ramp": tables.dense_ids(rows, ["lat", "lng", "address"])}, folder)["ramp"]


def associate_and_move(spark: SparkSession, crossings: DataFrame, vertices: DataFrame, lines: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """Crossings with the ramps that lines give them, and the ramps' new places beside them, saved together."""
    linked = checkpoint(tables.associate_ramps(crossings, lines))
    return saved_together(spark, {"crossing": linked, "ramp": moved_ramps(linked, vertices)}, folder)
