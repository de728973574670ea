"""Areas of a map: which relations and ways make them, tags that ways take over, rings with their holes, and what an area is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.functions import tags as T
from kerbline.functions.tags import Tag

#: Tags that a way without them takes from the area that it bounds.
INHERITED = ("highway", "name", "ref")
#: Degrees that the smallest cells measure in the search for enclosing rings; a level up is twice as wide.
CELL, LEVELS = 0.0005, 20


def relation_kind(tag: Tag) -> Column:
    """area, restriction, road, level_map or stop_area; null for relations that are not kept."""
    is_ = lambda key, value: F.coalesce(tag(key) == value, F.lit(False))
    polygon = is_("type", "multipolygon") & (T.routable_entity(tag) | T.park_and_ride(tag))
    area = T.routable_way(tag) | T.park_and_ride(tag)
    out = F.when(polygon, F.when(area, "area")).when(is_("type", "restriction"), "restriction").when(is_("type", "route") & is_("route", "road"), "road")
    return out.when(is_("type", "level_map"), "level_map").when(is_("type", "public_transport") & is_("public_transport", "stop_area"), "stop_area")


def member_ways(relations: DataFrame, members: DataFrame, tag: Tag) -> DataFrame:
    """(wayId) of all members of area relations (id, tags) by members (relationId, wayId, role)."""
    areas = relations.where(relation_kind(tag) == "area").select(F.col("id").alias("relationId"))
    return members.join(areas, "relationId", "left_semi").select("wayId").distinct()


def way_classes(ways: DataFrame, of_areas: DataFrame, tag: Tag, nodes: str) -> DataFrame:
    """ways (id, tags) with in_area (bounds a relation's area or is one), single_area (is one by itself) and street."""
    usable = T.routable_way(tag) | T.park_and_ride(tag) | T.bike_parking(tag)
    itself = T.way_flags(tag, F.col(nodes))["area"]
    rows = ways.join(of_areas.select(F.col("wayId").alias("id"), F.lit(True).alias("member")), "id", "left")
    member = F.coalesce("member", F.lit(False))
    single = usable & itself & ~member
    return rows.withColumns({"single_area": single, "street": usable & ~itself, "in_area": member | single}).drop("member")


def way_level(tag: Tag) -> Column:
    """struct<floor, altitude, ...> of the tag level, else of layer; the default level if there is none or it can't be relied on."""
    found, default = T.level(F.coalesce(tag("level"), tag("layer"))), T.level(F.lit(""))
    return F.when(found["reliable"], found).otherwise(default)


def complete(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relationId) whose members are all different known ways (id) with known nodes only; nodes has wayId, nodeId and known."""
    broken = nodes.where("not known").select("wayId").distinct().withColumn("broken", F.lit(1))
    rows = members.join(ways.select(F.col("id").alias("wayId"), F.lit(1).alias("found")), "wayId", "left").join(broken, "wayId", "left")
    counts = rows.groupBy("relationId").agg(F.count("*").alias("n"), F.count_distinct("wayId").alias("different"), F.count("found").alias("found"), F.count("broken").alias("broken"))
    return counts.where("n = different and n = found and broken = 0").select("relationId")


def inherited(ways: DataFrame, relations: DataFrame, members: DataFrame, names: list[str]) -> DataFrame:
    """ways (id, tags as columns) with the missing ones of names from their area relations (id, tags); of several the least relation's."""
    source = members.join(relations.select(F.col("id").alias("relationId"), *[F.col(c).alias(f"from_{c}") for c in names]), "relationId")
    best = [F.min_by(f"from_{c}", F.when(F.col(f"from_{c}").isNotNull(), F.col("relationId"))).alias(f"from_{c}") for c in names]
    got = source.groupBy(F.col("wayId").alias("id")).agg(*best)
    return ways.join(got, "id", "left").withColumns({c: F.coalesce(c, f"from_{c}") for c in names}).drop(*[f"from_{c}" for c in names])


def single_areas(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The single-way areas all of whose nodes are known."""
    broken = nodes.where("not known").select(F.col("wayId").alias("id")).distinct()
    return classes.where("single_area").join(broken, "id", "left_anti")


def area_uses(tag: Tag) -> dict[str, Column]:
    """What an area serves as; it may be several: walkable by permission, park and ride, bicycle parking."""
    walk = T.routable_entity(tag) & (T.entity_permissions(tag, T.PEDESTRIAN | T.BICYCLE) != T.NONE)
    return {"walkable": walk, "park_and_ride": T.park_and_ride(tag), "bike_parking": T.bike_parking(tag)}


def rings(nodes: DataFrame) -> DataFrame:
    """(wayId, nodeIds, ring) of closed ways from nodes (wayId, pos, nodeId, lat, lng): each node once, in order. Open ways make no ring."""
    steps = F.sort_array(F.collect_list(F.struct("pos", "nodeId", "lat", "lng")))
    rows = nodes.groupBy("wayId").agg(steps.alias("s")).where((F.size("s") > 1) & (F.col("s")[0]["nodeId"] == F.element_at("s", -1)["nodeId"]))
    first = F.filter("s", lambda x, i: (i == 0) | ~F.exists(F.slice("s", 1, i), lambda y: y["nodeId"] == x["nodeId"]))
    rows = rows.withColumn("s", first)
    return rows.select("wayId", F.transform("s", lambda x: x["nodeId"]).alias("nodeIds"), F.transform("s", lambda x: F.struct(x["lat"], x["lng"])).alias("ring"))


def _enclosing(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """(area, inner, outer): rings of inside that lie in a ring of outside of the same area (area, wayId, ring), itself left out.

    A ring as wide as a cell of its level covers four of them at most; another ring looks at the cell of its first point on every level.
    """
    extreme = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    low_x, low_y = extreme(F.array_min, "lng"), extreme(F.array_min, "lat")
    wide = F.greatest(extreme(F.array_max, "lng") - low_x, extreme(F.array_max, "lat") - low_y)
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(wide / CELL, F.lit(1.0)))), F.lit(0)), F.lit(LEVELS)).cast("int")
    cell = lambda x, size: F.floor(x / size).cast("long")
    size = CELL * F.pow(F.lit(2.0), F.col("level"))
    span = lambda low, high: F.explode(F.sequence(cell(low, size), cell(high, size)))
    o = outside.withColumn("level", level).withColumn("x", span(low_x, extreme(F.array_max, "lng"))).withColumn("y", span(low_y, extreme(F.array_max, "lat")))
    o = o.select("area", "level", "x", "y", F.col("wayId").alias("outer"), F.col("ring").alias("around"))
    i = inside.withColumn("level", F.explode(F.array(*[F.lit(n) for n in range(LEVELS + 1)])))
    i = i.select("area", "level", cell(F.col("ring")[0]["lng"], size).alias("x"), cell(F.col("ring")[0]["lat"], size).alias("y"), F.col("wayId").alias("inner"), "ring")
    met = i.join(o, ["area", "level", "x", "y"]).where("inner <> outer")
    return met.where(G.polygon_in_polygon(F.col("ring"), F.col("around"))).select("area", "inner", "outer").distinct()


def outermost(every: DataFrame) -> DataFrame:
    """(area, wayId, holes) of the outer rings of every (area, wayId, role, ring) that lie in no other of their area, with the inner rings in them."""
    outer, inner = every.where("role = 'outer'"), every.where("role = 'inner'")
    top = outer.join(_enclosing(outer, outer).select("area", F.col("inner").alias("wayId")), ["area", "wayId"], "left_anti")
    holes = _enclosing(inner, top).groupBy("area", F.col("outer").alias("wayId")).agg(F.sort_array(F.collect_list("inner")).alias("holes"))
    return top.select("area", "wayId").join(holes, ["area", "wayId"], "left").select("area", "wayId", F.coalesce("holes", F.expr("cast(array() as array<bigint>)")).alias("holes"))


def level_vertices(nodes: DataFrame) -> DataFrame:
    """(nodeId, floor): a vertex per node of ways (nodeId, elevator, floor), and of an elevator one per floor; floor is null for other nodes."""
    return nodes.select("nodeId", F.when(F.col("elevator"), F.col("floor")).alias("floor")).distinct()


def path_coordinates(nodes: DataFrame) -> DataFrame:
    """(wayId, path): the known coordinates of each way's nodes (wayId, pos, lat, lng), in order."""
    order = Window.partitionBy("wayId").orderBy("pos")  # positions of the known nodes
    rows = nodes.where("lat is not null and lng is not null").withColumn("at", F.row_number().over(order))
    points = F.transform(F.sort_array(F.collect_list(F.struct("at", "lat", "lng"))), lambda p: F.struct(p["lat"], p["lng"]))
    return rows.groupBy("wayId").agg(points.alias("path"))
