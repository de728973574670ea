"""OpenStreetMap XML as DataFrames of nodes, ways and relations, by Spark's XML source with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import tags as T

_COMMON = "_id long, _visible string, _version int, _changeset long, _timestamp timestamp, _user string, _uid long, tag array<struct<_k:string,_v:string>>"
_SCHEMAS = {
    "node": f"_lat double, _lon double, {_COMMON}",
    "way": f"nd array<struct<_ref:bigint>>, {_COMMON}",
    "relation": f"member array<struct<_type:string,_ref:bigint,_role:string>>, {_COMMON}",
}


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", kind).schema(_SCHEMAS[kind]).load(path)


def _shared() -> list[Column]:
    # of a key that is given twice the last value holds
    pairs = F.coalesce(F.col("tag"), F.expr("cast(array() as array<struct<_k:string,_v:string>>)"))
    tags = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["_k"]), F.create_map(p["_k"], p["_v"])))
    names = ("id", "version", "changeset", "timestamp", "user", "uid")
    return [*[F.col(f"_{c}").alias(c) for c in names], T.secure_boolean(F.col("_visible")).alias("visible"), tags.alias("tags")]


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "node").select(F.col("_lat").alias("lat"), F.col("_lon").alias("lng"), *_shared())


def ways(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "way").select(F.transform(F.coalesce("nd", F.expr("cast(array() as array<struct<_ref:bigint>>)")), lambda n: n["_ref"]).alias("nodeIds"), *_shared())


def relations(spark: SparkSession, path: str) -> DataFrame:
    members = F.transform(F.col("member"), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return _read(spark, path, "relation").select(members.alias("members"), *_shared())


def way_nodes(way: DataFrame) -> DataFrame:
    """(wayId, nodeId, pos) of ways, in order from 1."""
    return way.select(F.col("id").alias("wayId"), F.posexplode("nodeIds").alias("pos", "nodeId")).select("wayId", "nodeId", (F.col("pos") + 1).cast("long").alias("pos"))


def chosen_relations(relation: DataFrame) -> DataFrame:
    """(id, wayId, role) of the way members of multipolygons that are routable or park-and-ride."""
    tag = T.from_map("tags")
    kept = relation.where(F.coalesce(tag("type") == "multipolygon", F.lit(False)) & (T.routable_entity(tag) | T.park_and_ride(tag)))
    member = kept.select("id", F.explode("members").alias("m")).where("m.type = 'way'")
    return member.select("id", F.col("m.ref").alias("wayId"), F.col("m.role").alias("role"))


def resolved(member: DataFrame, way: DataFrame) -> DataFrame:
    """The members of relations all of whose ways are known."""
    known = member.join(way.select(F.col("id").alias("wayId"), F.lit(1).alias("known")), "wayId", "left")
    whole = known.groupBy("id").agg(F.count("*").alias("n"), F.count("known").alias("k")).where("n = k").select("id")
    return member.join(whole, "id", "left_semi")


def rings(member: DataFrame, way: DataFrame, node: DataFrame) -> DataFrame:
    """(id, wayId, role, ring): closed ways of resolved relations as arrays of (lat, lng) in order; open ways make no ring."""
    closed = way.where((F.size("nodeIds") > 3) & (F.col("nodeIds")[0] == F.element_at("nodeIds", -1)))
    steps = resolved(member, way).join(way_nodes(closed), "wayId").join(node.select(F.col("id").alias("nodeId"), "lat", "lng"), "nodeId")
    points = F.transform(F.sort_array(F.collect_list(F.struct("pos", "lat", "lng"))), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng")))
    return steps.groupBy("id", "wayId", "role").agg(points.alias("ring"))


def _members(relation: DataFrame) -> DataFrame:
    """(relationId, wayId, role) of the ways that relations name; other members are no ways, whatever their number. Roles but outer and inner make no ring."""
    rows = relation.select(F.col("id").alias("relationId"), F.explode("members").alias("m")).where("m.type = 'way'")
    return rows.select("relationId", F.col("m.ref").alias("wayId"), F.col("m.role").alias("role"))


def area_rings(relation: DataFrame, classes: DataFrame, node: DataFrame, tag: T.Tag) -> DataFrame:
    """(wayId) of the outermost closed rings of the areas that one walks or parks on: relations all of whose ways and nodes are known, and single ways."""
    from kerbline.operators import areas as A

    serves = lambda: (uses := A.area_uses(tag))["walkable"] | uses["park_and_ride"]
    steps = way_nodes(classes.where("in_area")).join(node.select(F.col("id").alias("nodeId"), "lat", "lng"), "nodeId", "left").withColumn("known", F.col("lat").isNotNull())
    member = _members(relation).join(relation.where((A.relation_kind(tag) == "area") & serves()).select(F.col("id").alias("relationId")), "relationId", "left_semi")
    whole = member.join(A.complete(member, classes, steps), "relationId", "left_semi")
    closed = A.rings(steps.where("known"))
    top = A.outermost(whole.join(closed, "wayId").select(F.col("relationId").alias("area"), "wayId", "role", "ring")).select("wayId")
    alone = A.single_areas(classes.where(serves()), steps).select(F.col("id").alias("wayId")).join(closed, "wayId", "left_semi")
    return top.union(alone).distinct()


def with_area_tags(way: DataFrame, relation: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """ways (id, tags, ...) whose tags have the missing ones of names from the areas that they bound."""
    from kerbline.operators import areas as A

    tag = T.from_map("tags")
    areas = relation.where(A.relation_kind(tag) == "area").select("id", *[F.col("tags")[c].alias(c) for c in names])
    got = A.inherited(way.select("id", *[F.col("tags")[c].alias(c) for c in names]), areas, _members(relation), list(names))
    every = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c) for c in names]))
    got = got.select("id", F.map_filter(every, lambda k, v: v.isNotNull()).alias("area_tags"))
    own = F.map_filter("tags", lambda k, v: ~F.array_contains(F.map_keys("area_tags"), k))
    return way.join(got, "id").withColumn("tags", F.map_concat(own, "area_tags")).drop("area_tags")


def street_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the streets of a file: routable ways cut at intersections, both directions as permitted.

    A way takes the tags that it lacks from the area that it bounds. A node is an intersection if streets meet in it, or if an outermost ring of an area
    that one walks or parks on shares it with a street. A node that a way has just met, or one at the same place and level as the one before, is passed over.
    """
    from kerbline.operators import areas as A
    from kerbline.operators import streets as W

    node, way, tag = nodes(spark, path), ways(spark, path), T.from_map("tags")
    relation = relations(spark, path)
    classes = A.way_classes(way.withColumn("nodeCount", F.size("nodeIds")), A.member_ways(relation, _members(relation), tag), tag, "nodeCount")
    rings_ = way.join(area_rings(relation, classes, node, tag).withColumnRenamed("wayId", "id"), "id", "left_semi")
    way = with_area_tags(classes.where("street").select(way.columns), relation, A.INHERITED).where(T.routable_way(tag))
    mark = T.is_stop(tag) | T.is_bollard(tag) | F.col("tags")["ele"].isNotNull()
    known = node.select(F.col("id").alias("nodeId"), "lat", "lng", F.col("tags")["level"].alias("level"), mark.alias("mark"))
    steps = way_nodes(way)
    # ways with an unknown node are left out whole
    broken = steps.join(known.select("nodeId"), "nodeId", "left_anti").select("wayId")
    steps = W.drop_repeats(steps.join(broken, "wayId", "left_anti").join(known, "nodeId"), ["nodeId"])
    steps = W.drop_repeats(steps, ["lat", "lng", "level"])
    cross = steps.groupBy("nodeId").agg(F.count("*").alias("n")).where("n >= 2").select("nodeId")
    cross = cross.union(way_nodes(rings_).select("nodeId")).distinct()
    parts = W.segments(steps, cross, F.col("mark"))
    edges = W.directed_edges(parts, way, tag)
    return W.vertices(edges, node), edges
