"""Sidewalks around a street graph: corners between neighbouring edges of each vertex, sidewalks along edges, crossings between corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.operators.spatial import with_endpoints


def corners(vertices: DataFrame, edges: DataFrame, offset: float = G.SIDEWALK_OFFSET) -> DataFrame:
    """(corner, vertex, place, lat, lng, keys): one corner between each two neighbouring edges of a vertex in order of angle, two at a dead end.

    edges are directed, both ways for a street; repeated ones count once. keys are those of the one or two sidewalks that
    meet there. Corners of the same two sidewalks are one, that of the least (vertex, place).
    """
    rows = with_endpoints(edges.select("vertexStartId", "vertexEndId").where("vertexStartId <> vertexEndId").distinct(), vertices)
    rows = rows.select(F.col("vertexStartId").alias("vertex"), F.col("vertexEndId").alias("to"), F.col("start_lng").alias("x1"), F.col("start_lat").alias("y1"), F.col("end_lng").alias("x2"), F.col("end_lat").alias("y2"))
    v = ("x1", "y1", "x2", "y2")
    rows = rows.withColumn("angle", F.round(G.angle_to("y1", "x1", "y2", "x2"), 9))

    def side(left: bool):
        moved = G.parallel_vector(*v, offset, left)
        part = G.line(*[moved[c] for c in v])
        south = G.compare_parallels(G.line(*v), part) == 1
        key = F.concat_ws("-", F.least("vertex", "to"), F.greatest("vertex", "to"), F.when(south, 1).otherwise(0))
        return F.struct(*[moved[c].alias(c) for c in v], key.alias("key"))

    rows = rows.select("vertex", "to", "angle", side(True).alias("left"), side(False).alias("right"))
    order, whole = Window.partitionBy("vertex").orderBy("angle", "to"), Window.partitionBy("vertex")
    rows = rows.select("vertex", "left", F.col("right").alias("own"), F.coalesce(F.lead("right").over(order), F.first("right").over(order)).alias("right"), F.row_number().over(order).alias("place"), F.count("*").over(whole).alias("degree"))
    meet = G.vectors_meet([F.col(f"left.{c}") for c in v], [F.col(f"right.{c}") for c in v])
    point = lambda s: F.struct(F.col(f"{s}.x1").alias("x"), F.col(f"{s}.y1").alias("y"))
    corner = lambda p, place, *keys: F.struct(p.alias("p"), place.alias("place"), F.array_sort(F.array(*keys)).alias("keys"))
    both = F.when(F.col("degree") > 1, F.array(corner(meet, F.col("place"), F.col("left.key"), F.col("right.key")))).otherwise(F.array(corner(point("left"), F.lit(1), F.col("left.key")), corner(point("own"), F.lit(2), F.col("own.key"))))
    found = rows.select("vertex", F.explode(both).alias("c")).where("c.p is not null")
    found = found.select("vertex", "c.place", F.col("c.p.y").alias("lat"), F.col("c.p.x").alias("lng"), "c.keys", F.array_join("c.keys", "|").alias("corner"))
    return found


def sidewalks(found: DataFrame) -> DataFrame:
    """(key, fromCorner, toCorner): each sidewalk with the first two different corners on it; those with one are left out."""
    ends = found.select("vertex", "place", "corner", F.explode("keys").alias("key")).groupBy("key", "corner").agg(F.min(F.struct("vertex", "place")).alias("at"))
    two = ends.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "corner"))).alias("c"))
    return two.where(F.size("c") > 1).select("key", F.col("c")[0]["corner"].alias("fromCorner"), F.col("c")[1]["corner"].alias("toCorner"))


def crossings(found: DataFrame) -> DataFrame:
    """(key, fromCorner, toCorner): from each corner of a vertex to the next, around it if there are more than two."""
    order, whole = Window.partitionBy("vertex").orderBy("place"), Window.partitionBy("vertex")
    around = F.when(F.count("*").over(whole) > 2, F.first("corner").over(order))
    pairs = found.select(F.col("corner").alias("fromCorner"), F.coalesce(F.lead("corner").over(order), around).alias("toCorner")).where("toCorner is not null and fromCorner <> toCorner")
    key = F.concat_ws("-", F.least("fromCorner", "toCorner"), F.greatest("fromCorner", "toCorner"), F.lit("cross"))
    return pairs.withColumn("key", key).groupBy("key").agg(F.min(F.struct("fromCorner", "toCorner")).alias("e")).select("key", "e.*")


def build(vertices: DataFrame, edges: DataFrame, offset: float = G.SIDEWALK_OFFSET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sidewalk vertices (corner, vertex, lat, lng), sidewalks and crossings; vertices on neither are left out."""
    found = corners(vertices, edges, offset)
    walks, crosses = sidewalks(found), crossings(found)
    used = walks.union(crosses).select(F.explode(F.array("fromCorner", "toCorner")).alias("corner")).distinct()
    first = found.groupBy("corner").agg(F.min_by(F.struct("vertex", "lat", "lng"), F.struct("vertex", "place")).alias("c")).select("corner", "c.*")
    return first.join(used, "corner", "left_semi"), walks, crosses
