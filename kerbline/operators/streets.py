"""Ordered sequences of a way's nodes, and the street graph that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import tags as T


def _order() -> Window:
    return Window.partitionBy("wayId").orderBy("pos")


def pairs(nodes: DataFrame) -> DataFrame:
    """(wayId, start, next): each node of a way with the one after it."""
    return nodes.select("wayId", F.col("nodeId").alias("start"), F.lead("nodeId").over(_order()).alias("next")).where("next is not null")


def drop_repeats(nodes: DataFrame, same: list[str]) -> DataFrame:
    """nodes (wayId, pos, ...) without those that equal the one before them in all columns of same."""
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(_order()))
    return nodes.withColumn("_repeat", equal & (F.row_number().over(_order()) > 1)).where("not _repeat").drop("_repeat")


def segments(nodes: DataFrame, intersections: DataFrame, cut: Column | None = None) -> DataFrame:
    """(wayId, start, stop): ways (wayId, nodeId, pos) cut at intersections (nodeId), at their ends, after a node that the way has met before,
    and where the boolean column cut says so (a stop, a bollard, an elevation)."""
    seen = F.row_number().over(Window.partitionBy("wayId", "nodeId").orderBy("pos")) > 1
    rows = nodes.withColumn("_seen", seen).withColumn("_cut", F.lit(False) if cut is None else F.coalesce(cut, F.lit(False)))
    rows = rows.join(intersections.select("nodeId", F.lit(True).alias("_cross")), "nodeId", "left")
    last = F.lead("nodeId").over(_order()).isNull()
    first = F.row_number().over(_order()) == 1
    ends = F.coalesce("_cross", F.lit(False)) | F.col("_cut") | last | first | F.coalesce(F.lag("_seen").over(_order()), F.lit(False))
    kept = rows.withColumn("_end", ends).where("_end")
    return kept.select("wayId", F.lag("nodeId").over(_order()).alias("start"), F.col("nodeId").alias("stop")).where("start is not null")


def cyclic_pairs(rows: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """(group, item, next): the last item is followed by the first; a single one by null."""
    w = Window.partitionBy(group).orderBy(order)
    whole = Window.partitionBy(group)
    around = F.when(F.count("*").over(whole) > 1, F.first(item).over(w))
    return rows.select(group, item, F.coalesce(F.lead(item).over(w), around).alias("next"))


def directed_edges(parts: DataFrame, ways: DataFrame, tag: T.Tag) -> DataFrame:
    """Both directions of segments (wayId, start, stop) that the permissions of ways (id, tags...) allow; distance is the constant 10."""
    mask = T.way_permissions(tag)
    front, back = T.direction_permissions(tag, F.col("mask"))
    open_ = ways.where(T.routable_way(tag)).withColumn("mask", mask).where("mask <> 0")
    open_ = open_.select(F.col("id").alias("wayId"), front.alias("front"), back.alias("back"))
    rows = parts.join(open_, "wayId")
    edge = lambda a, b, m: F.struct(F.col(a).alias("vertexStartId"), F.col(b).alias("vertexEndId"), F.col(m).alias("permission"))
    both = rows.select("wayId", F.explode(F.array(edge("start", "stop", "front"), edge("stop", "start", "back"))).alias("e"))
    return both.select("e.vertexStartId", "e.vertexEndId", "wayId", "e.permission").where("permission <> 0").withColumn("distance", F.lit(10.0))


def vertices(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct ends of edges with their coordinates from nodes (id, lat, lng)."""
    used = edges.select(F.explode(F.array("vertexStartId", "vertexEndId")).alias("id")).distinct()
    return nodes.select("id", "lat", "lng").dropDuplicates(["id"]).join(used, "id", "left_semi")
