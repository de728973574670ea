"""Queries of areas and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import tags as T
from kerbline.operators import areas as A
from kerbline.plans.base import query, r6, s6

C = F.col
WAY = T.from_columns(["highway", "amenity", "park_ride", "area", "access", "level", "layer", "name"])
RELATION = T.from_columns(["type", "route", "highway", "amenity", "park_ride", "public_transport", "access", "name"])
_NO = "coalesce({0}access IN ('no', 'license'), FALSE)"
_ROUTABLE = "({0}highway IS NOT NULL AND {0}highway NOT IN ('proposed', 'construction') AND NOT " + _NO + ")"
_RIDE = "coalesce({0}amenity = 'parking' AND {0}park_ride <> 'no', FALSE)"
_BIKES = "coalesce({0}amenity = 'bicycle_parking' AND coalesce({0}access NOT IN ('private', 'no'), TRUE), FALSE)"
_KIND = f"""CASE WHEN type = 'multipolygon' AND (highway IS NOT NULL OR coalesce(public_transport = 'platform', FALSE) OR {_RIDE.format('')})
    THEN CASE WHEN (({_ROUTABLE.format('')}) OR (coalesce(public_transport = 'platform', FALSE) AND coalesce(highway NOT IN ('proposed', 'construction'), TRUE) AND NOT {_NO.format('')}) OR {_RIDE.format('')}) THEN 'area' END
    WHEN type = 'restriction' THEN 'restriction' WHEN type = 'route' AND route = 'road' THEN 'road' WHEN type = 'level_map' THEN 'level_map'
    WHEN type = 'public_transport' AND public_transport = 'stop_area' THEN 'stop_area' END"""
_AREAS = f"SELECT * FROM (SELECT *, {_KIND} AS kind FROM area_relation) q WHERE kind = 'area'"
_IN = f"SELECT DISTINCT m.wayId FROM area_member m JOIN ({_AREAS}) a ON a.id = m.relationId"
_USABLE = f"({_ROUTABLE.format('w.')} OR {_RIDE.format('w.')} OR {_BIKES.format('w.')})"
_ITSELF = "((coalesce(w.area = 'yes', FALSE) OR coalesce(w.amenity IN ('parking', 'bicycle_parking'), FALSE)) AND w.nodes > 2)"
_CLASSES = f"SELECT w.id, w.highway, w.amenity, w.park_ride, w.access, coalesce(m.wayId IS NOT NULL, FALSE) OR ({_USABLE} AND {_ITSELF}) AS in_area, {_USABLE} AND {_ITSELF} AND m.wayId IS NULL AS single_area, {_USABLE} AND NOT {_ITSELF} AS street FROM area_way w LEFT JOIN ({_IN}) m ON m.wayId = w.id"
_COMPLETE = """SELECT m.relationId FROM area_member m LEFT JOIN area_way w ON w.id = m.wayId LEFT JOIN (SELECT DISTINCT wayId FROM area_node WHERE NOT known) b ON b.wayId = m.wayId
    GROUP BY m.relationId HAVING count(*) = count(DISTINCT m.wayId) AND count(*) = count(w.id) AND count(b.wayId) = 0"""


def _classes(t):
    return A.way_classes(t("area_way"), A.member_ways(t("area_relation"), t("area_member"), RELATION), WAY, "nodes")


@query("etl-01", f"SELECT id, {_KIND} AS kind FROM area_relation")
def etl_01(t):
    return t("area_relation").select("id", A.relation_kind(RELATION).alias("kind"))


@query("etl-02", f"SELECT id, in_area, single_area, street FROM ({_CLASSES}) c")
def etl_02(t):
    return _classes(t).select("id", "in_area", "single_area", "street")


@query("etl-03", """SELECT id, CAST(CASE WHEN tag IN ('1=first@12.5', '1') THEN 1 WHEN tag = '+2' THEN 2 WHEN tag = '-1' THEN -1 ELSE 0 END AS INT) AS floor,
    CASE WHEN tag = '1=first@12.5' THEN 12.5::DOUBLE ELSE 0::DOUBLE END AS altitude FROM (SELECT id, coalesce(level, layer) AS tag FROM area_way) q""")
def etl_03(t):
    return t("area_way").select("id", A.way_level(WAY).alias("l")).select("id", "l.floor", "l.altitude")


@query("etl-05", f"""SELECT w.id, coalesce(w.highway, f.highway) AS highway, coalesce(w.name, f.name) AS name FROM area_way w JOIN ({_CLASSES}) c ON c.id = w.id AND c.street
    LEFT JOIN (SELECT m.wayId, arg_min(r.highway, r.id) FILTER (WHERE r.highway IS NOT NULL) AS highway, arg_min(r.name, r.id) FILTER (WHERE r.name IS NOT NULL) AS name
      FROM area_member m JOIN ({_AREAS}) r ON r.id = m.relationId JOIN ({_COMPLETE}) k ON k.relationId = m.relationId GROUP BY m.wayId) f ON f.wayId = w.id""")
def etl_05(t):
    whole = A.complete(t("area_member"), t("area_way"), t("area_node"))
    areas = t("area_relation").where(A.relation_kind(RELATION) == "area")
    streets = _classes(t).where("street").select("id", "highway", "name")
    return A.inherited(streets, areas, t("area_member").join(whole, "relationId", "left_semi"), ["highway", "name"])


@query("etl-06", f"SELECT c.id FROM ({_CLASSES}) c WHERE c.single_area AND c.id NOT IN (SELECT wayId FROM area_node WHERE NOT known)")
def etl_06(t):
    return A.single_areas(_classes(t), t("area_node")).select("id")


@query("etl-07", f"SELECT id, highway IS NOT NULL AND NOT {_NO.format('')} AND coalesce(highway <> 'construction', TRUE) AS walkable, {_RIDE.format('')} AS park_and_ride, {_BIKES.format('')} AS bike_parking FROM ({_CLASSES}) c WHERE single_area")
def etl_07(t):
    single = _classes(t).where("single_area")
    return single.select("id", *[x.alias(name) for name, x in A.area_uses(WAY).items()])


_RINGS = "SELECT wayId FROM area_node GROUP BY wayId HAVING arg_min(nodeId, pos) = arg_max(nodeId, pos) AND count(*) > 1"


@query("etl-08", f"SELECT wayId FROM ({_RINGS}) q")
def etl_08(t):
    return A.rings(t("area_node")).select("wayId")


@query("etl-10", f"SELECT wayId, CAST(count(*) AS INT) AS nodes, {s6('sum(lat)')} AS lat FROM (SELECT DISTINCT wayId, nodeId, lat FROM area_node WHERE wayId IN ({_RINGS})) q GROUP BY wayId")
def etl_10(t):
    return A.rings(t("area_node")).select("wayId", F.size("nodeIds").alias("nodes"), r6(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["lat"])).alias("lat"))


# the rings are squares, so that one lies in another if its sides do
_BOXES = f"SELECT m.relationId AS area, m.role, n.wayId, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM area_node n JOIN area_member m ON m.wayId = n.wayId WHERE n.wayId IN ({_RINGS}) GROUP BY 1, 2, 3"
_WITHIN = "{i}.area = {o}.area AND {i}.wayId <> {o}.wayId AND {i}.s > {o}.s AND {i}.n < {o}.n AND {i}.w > {o}.w AND {i}.e < {o}.e"


@query("etl-09", f"""SELECT t.area, t.wayId, coalesce(string_agg(CAST(h.wayId AS VARCHAR), ',' ORDER BY h.wayId), '') AS holes FROM ({_BOXES}) t LEFT JOIN ({_BOXES}) h ON h.role = 'inner' AND {_WITHIN.format(i='h', o='t')}
    WHERE t.role = 'outer' AND NOT EXISTS (SELECT 1 FROM ({_BOXES}) o WHERE o.role = 'outer' AND {_WITHIN.format(i='t', o='o')}) GROUP BY t.area, t.wayId""")
def etl_09(t):
    every = A.rings(t("area_node")).join(t("area_member"), "wayId").select(C("relationId").alias("area"), "wayId", "role", "ring")
    return A.outermost(every).select("area", "wayId", F.array_join(C("holes").cast("array<string>"), ",").alias("holes"))


@query("etl-16", """SELECT DISTINCT n.nodeId, CASE WHEN n.nodeId % 10 = 0 THEN w.floor END AS floor FROM way_node n JOIN
    (SELECT id, CAST(CASE level WHEN '1=first@12.5' THEN 1 WHEN '+2' THEN 2 WHEN '-1' THEN -1 ELSE 0 END AS INT) AS floor FROM way) w ON w.id = n.wayId""")
def etl_16(t):
    floors = t("way").select(C("id").alias("wayId"), A.way_level(T.from_columns(["level"]))["floor"].alias("floor"))
    return A.level_vertices(t("way_node").join(floors, "wayId").withColumn("elevator", C("nodeId") % 10 == 0))


@query("etl-19", f"SELECT wayId, CAST(count(*) AS INT) AS known, {s6('sum(lat)')} AS lat, {s6('arg_min(lng, pos)')} AS first_lng, {s6('arg_max(lng, pos)')} AS last_lng FROM area_node WHERE known GROUP BY wayId")
def etl_19(t):
    at = lambda c: F.when(C("known"), C(c)).alias(c)
    paths = A.path_coordinates(t("area_node").select("wayId", "pos", at("lat"), at("lng")))
    return paths.select("wayId", F.size("path").alias("known"), r6(F.aggregate("path", F.lit(0.0), lambda s, p: s + p["lat"])).alias("lat"), r6(C("path")[0]["lng"]).alias("first_lng"), r6(F.element_at("path", -1)["lng"]).alias("last_lng"))
