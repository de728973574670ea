"""Queries of scans, changes, filters, projections, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.functions import tags as T
from kerbline.operators import spatial as S
from kerbline.operators import tables as B
from kerbline.plans.base import km, planar, query, r6, s6, within
from kerbline.sources import ramps as R

C = F.col
LAT, LNG = -34.61, -58.41
NEAR = within("lat", "lng", LAT, LNG, 0.5)
RECT = "lat BETWEEN -34.612 AND -34.6 AND lng BETWEEN -58.415 AND -58.4"
RECTANGLE = (-34.6, -58.4, -34.612, -58.415)
IDS = (3, 5, 8, 13)


def _near(lat="lat", lng="lng", **k):
    return S.in_radius(LAT, LNG, 0.5, lat, lng, **k)


# Scans and changes.


@query("src-04", "SELECT id, coalesce(oneway = 'yes', FALSE) AS flag FROM way")
def src_04(t):
    return t("way").select("id", T.secure_boolean(F.when(C("oneway") == "yes", "true").otherwise(C("oneway"))).alias("flag"))


@query("src-07", f"SELECT {s6('lat')} AS lat, {s6('lng')} AS lng, address FROM ramp")
def src_07(t):
    lines = t("ramp").select(F.concat_ws(";", F.concat(F.lit("POINT ("), "lng", F.lit(" "), "lat", F.lit(")")), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), "address").alias("value"))
    return R.parse_points(lines).select(r6(C("lat")).alias("lat"), r6(C("lng")).alias("lng"), "address")


@query("src-08", f"SELECT {s6('lat')} AS lat, {s6('lng')} AS lng, address FROM ramp")
def src_08(t):
    lines = t("ramp").select(F.concat_ws(";", "lng", "lat", "address").alias("value"))
    return R.parse_plain(lines).select(r6(C("lat")).alias("lat"), r6(C("lng")).alias("lng"), "address")


@query("src-09", "SELECT address, CAST(count(*) AS BIGINT) AS n FROM (SELECT address FROM ramp UNION ALL SELECT address FROM ramp WHERE isAccessible) u GROUP BY address")
def src_09(t):
    return R.concat([t("ramp"), t("ramp").where("isAccessible")]).groupBy("address").agg(F.count("*").alias("n"))


@query("src-10", "SELECT rampStartId AS rampId, vertexStartId AS vertexId, id AS crossingId FROM crossing WHERE rampStartId IS NOT NULL")
def src_10(t):
    lines = t("crossing").where("rampStartId is not null").select(F.concat_ws(",", "rampStartId", "vertexStartId", "id").alias("value"))
    return R.parse_associations(lines)


@query("src-11", "SELECT id, travelInfoId, sequence, lat, lng, isAccessible FROM stop")
def src_11(t):
    return t("stop")


@query("src-12", "SELECT v.id, v.lat, v.lng, count(e.vertexEndId) AS n_edges, coalesce(string_agg(CAST(e.vertexEndId AS VARCHAR), ',' ORDER BY e.vertexEndId), '') AS edges FROM street_vertex v LEFT JOIN street_edge e ON e.vertexStartId = v.id GROUP BY v.id, v.lat, v.lng")
def src_12(t):
    edges = t("street_edge").groupBy(C("vertexStartId").alias("id")).agg(F.sort_array(F.collect_list("vertexEndId")).alias("edges"))
    rows = t("street_vertex").join(edges, "id", "left")
    return rows.select("id", "lat", "lng", F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("n_edges"), F.coalesce(F.array_join("edges", ","), F.lit("")).alias("edges"))


@query("src-13", "SELECT fromStopId, toTravelInfoId FROM combination ORDER BY fromStopId, toTravelInfoId LIMIT 10 OFFSET 20")
def src_13(t):
    return t("combination").select("fromStopId", "toTravelInfoId").orderBy("fromStopId", "toTravelInfoId").offset(20).limit(10)


@query("src-14", "SELECT CAST((SELECT count(*) FROM street_vertex) AS BIGINT) AS streets, CAST((SELECT count(*) FROM sidewalk_edge) AS BIGINT) AS sidewalks")
def src_14(t):
    return t("street_vertex").agg(F.count("*").alias("streets")).crossJoin(t("sidewalk_edge").agg(F.count("*").alias("sidewalks")))


@query("snk-01", "SELECT id, address FROM ramp UNION ALL SELECT (SELECT max(id) FROM ramp) + ROW_NUMBER() OVER (ORDER BY address), 'new ' || address FROM ramp WHERE id <= 5")
def snk_01(t):
    new = t("ramp").where("id <= 5").select("id", F.concat(F.lit("new "), "address").alias("address"))
    return B.insert(t("ramp").select("id", "address"), new, ["address"])


@query("snk-03", "SELECT id, CASE WHEN id % 3 = 0 THEN address || '!' ELSE address END AS address, CASE WHEN id % 3 = 0 THEN NOT isAccessible ELSE isAccessible END AS isAccessible FROM ramp")
def snk_03(t):
    changes = t("ramp").where("id % 3 = 0").select("id", F.concat("address", F.lit("!")).alias("address"), (~C("isAccessible")).alias("isAccessible"))
    return B.update(t("ramp").select("id", "address", "isAccessible"), changes, ["id"])


@query("snk-04", "SELECT id, address FROM ramp WHERE id NOT IN (SELECT id FROM ramp WHERE id % 4 = 1)")
def snk_04(t):
    return B.delete(t("ramp").select("id", "address"), t("ramp").where("id % 4 = 1"), ["id"])


@query("snk-05", "SELECT id, CASE WHEN id <> 7 THEN rampStartId END AS rampStartId, rampEndId FROM crossing")
def snk_05(t):
    return t("crossing").select("id", F.when(C("id") != 7, C("rampStartId")).alias("rampStartId"), "rampEndId")


@query("snk-06", "SELECT e.vertexStartId, e.vertexEndId, i.infoId FROM street_edge e JOIN (SELECT wayId, ROW_NUMBER() OVER (ORDER BY wayId) AS infoId FROM (SELECT DISTINCT wayId FROM street_edge) w) i ON i.wayId = e.wayId")
def snk_06(t):
    infos = B.dense_ids(t("street_edge").select("wayId").distinct(), ["wayId"], "infoId")
    return t("street_edge").join(infos, "wayId").select("vertexStartId", "vertexEndId", "infoId")


@query("snk-09", """SELECT travelInfoId, '[' || string_agg('{"lat":' || CAST(sequence AS VARCHAR) || ',"lng":' || CAST(id AS VARCHAR) || '}', ',' ORDER BY sequence) || ']' AS path, CAST(sum(id) AS BIGINT) AS back FROM stop GROUP BY travelInfoId""")
def snk_09(t):
    points = F.sort_array(F.collect_list(F.struct("sequence", "id")))
    rows = t("stop").groupBy("travelInfoId").agg(F.to_json(F.transform(points, lambda p: F.struct(p["sequence"].alias("lat"), p["id"].alias("lng")))).alias("path"))
    read = F.from_json("path", "array<struct<lat:bigint,lng:bigint>>")
    return rows.withColumn("back", F.aggregate(read, F.lit(0).cast("long"), lambda s, p: s + p["lng"]))


def _placed(t):
    """Combinations with the places of both stops."""
    at = lambda key, name: t("stop").select(C("id").alias(key), C("lat").alias(f"{name}_lat"), C("lng").alias(f"{name}_lng"))
    return t("combination").join(at("fromStopId", "from"), "fromStopId").join(at("toStopId", "to"), "toStopId")


@query("snk-10", "SELECT c.fromStopId, c.toTravelInfoId, a.lat AS from_lat, a.lng AS from_lng, b.lat AS to_lat, b.lng AS to_lng FROM combination c JOIN stop a ON a.id = c.fromStopId JOIN stop b ON b.id = c.toStopId")
def snk_10(t):
    return _placed(t).select("fromStopId", "toTravelInfoId", "from_lat", "from_lng", "to_lat", "to_lng")



# Filters.


@query("flt-01", "SELECT id, lat, lng FROM street_vertex WHERE id = 42")
def flt_01(t):
    return t("street_vertex").where("id = 42")


@query("flt-02", "SELECT fromStopId, toTravelInfoId, toStopId FROM combination WHERE fromStopId = 1 AND toTravelInfoId = 2")
def flt_02(t):
    return t("combination").where("fromStopId = 1 and toTravelInfoId = 2").select("fromStopId", "toTravelInfoId", "toStopId")


@query("flt-03", f"SELECT id FROM street_vertex WHERE id NOT IN {IDS}")
def flt_03(t):
    return t("street_vertex").where(~C("id").isin(*IDS)).select("id")


@query("flt-04", "SELECT vertexStartId, vertexEndId FROM street_edge WHERE vertexStartId = 41")
def flt_04(t):
    return t("street_edge").where("vertexStartId = 41").select("vertexStartId", "vertexEndId")


@query("flt-05", "SELECT id, vertexStartId, vertexEndId FROM sidewalk_edge WHERE vertexStartId = 41 OR vertexEndId = 41")
def flt_05(t):
    return t("sidewalk_edge").where("vertexStartId = 41 or vertexEndId = 41").select("id", "vertexStartId", "vertexEndId")


@query("flt-06", f"SELECT id FROM street_vertex WHERE {NEAR}")
def flt_06(t):
    return t("street_vertex").where(_near()).select("id")


@query("flt-07", f"SELECT id FROM street_vertex WHERE {RECT}")
def flt_07(t):
    return t("street_vertex").where(S.in_rectangle(*RECTANGLE)).select("id")


@query("flt-08", f"SELECT id, travelInfoId FROM stop WHERE {RECT}")
def flt_08(t):
    return t("stop").where(S.in_rectangle(*RECTANGLE)).select("id", "travelInfoId")


@query("flt-09", f"SELECT s.id, t.name FROM stop s JOIN travel_info t ON t.id = s.travelInfoId WHERE t.name LIKE '%A%' AND {NEAR}")
def flt_09(t):
    lines = t("travel_info").where("name like '%A%'").select(C("id").alias("travelInfoId"), "name")
    return t("stop").where(_near()).join(lines, "travelInfoId").select("id", "name")


_PLACED = "combination c JOIN stop a ON a.id = c.fromStopId JOIN stop b ON b.id = c.toStopId"


@query("flt-10", f"""SELECT fromStopId, toTravelInfoId FROM (SELECT c.*, {planar('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d FROM {_PLACED} WHERE c.fromTravelInfoId IN {IDS}
    AND NOT {within('a.lat', 'a.lng', LAT, LNG, 0.5)} AND NOT {within('b.lat', 'b.lng', LAT, LNG, 0.5)}) q ORDER BY round(d, 12), fromStopId, toTravelInfoId LIMIT 50""")
def flt_10(t):
    rows = _placed(t).where(C("fromTravelInfoId").isin(*IDS))
    rows = rows.where(~_near("from_lat", "from_lng")).where(~_near("to_lat", "to_lng"))
    d = F.round(G.planar_radians("from_lat", "from_lng", "to_lat", "to_lng"), 12)
    return rows.orderBy(d, "fromStopId", "toTravelInfoId").limit(50).select("fromStopId", "toTravelInfoId")


@query("flt-11", f"SELECT e.vertexStartId, e.vertexEndId FROM street_edge e JOIN street_vertex a ON a.id = e.vertexStartId JOIN street_vertex b ON b.id = e.vertexEndId WHERE least({km('a.lat', 'a.lng', str(LAT), str(LNG))}, {km('b.lat', 'b.lng', str(LAT), str(LNG))}) <= 0.5")
def flt_11(t):
    return S.edges_near(t("street_edge"), t("street_vertex"), LAT, LNG, 0.5, "haversine").select("vertexStartId", "vertexEndId")


@query("flt-12", f"SELECT id FROM street_vertex ORDER BY round({km('lat', 'lng', str(LAT), str(LNG))}, 9), id LIMIT 1")
def flt_12(t):
    return S.nearest(t("street_vertex"), LAT, LNG, "haversine").select("id")


@query("flt-13", f"SELECT s.id FROM stop s JOIN travel_info t ON t.id = s.travelInfoId WHERE {km('lat', 'lng', str(LAT), str(LNG))} <= 0.5 AND t.name = 'Linea CANADA'")
def flt_13(t):
    line = t("travel_info").where("name = 'Linea CANADA'").select(C("id").alias("travelInfoId"))
    return t("stop").where(_near(mode="haversine")).join(line, "travelInfoId", "left_semi").select("id")


WAY = T.from_columns(["highway", "oneway", "foot", "access", "bicycle", "cycleway", "motorcar", "level"])
_ALLOW, _DENY = "('yes','1','true','designated','official','permissive','unknown')", "('no','license')"


def _in(x: str, values: str) -> str:
    return f"coalesce({x} IN {values}, FALSE)"


_DENIED, _ROUTABLE = _in("access", _DENY), "coalesce(highway NOT IN ('conveyer','proposed','construction','raceway','unbuilt'), TRUE)"
_ANY = f"({_in('motorcar', _ALLOW)} OR {_in('bicycle', _ALLOW)} OR {_in('foot', _ALLOW)})"


@query("flt-14", "SELECT id, highway IS NOT NULL AS routable FROM way")
def flt_14(t):
    return t("way").select("id", T.routable_entity(WAY).alias("routable"))


@query("flt-15", f"SELECT id, {_ROUTABLE} AS routable FROM way")
def flt_15(t):
    return t("way").select("id", T.routable_highway(WAY).alias("routable"))


@query("flt-16", f"SELECT id FROM way WHERE highway IS NOT NULL AND {_ROUTABLE} AND (NOT {_DENIED} OR {_ANY})")
def flt_16(t):
    return t("way").where(T.routable_way(WAY)).select("id")


@query("flt-17", f"SELECT id, {_DENIED} AS denied FROM way")
def flt_17(t):
    return t("way").select("id", T.general_access_denied(WAY).alias("denied"))


@query("flt-18", f"SELECT id, {_in('motorcar', _ALLOW)} AS car, {_in('bicycle', _ALLOW)} AS bike, {_in('foot', _ALLOW)} AS walk FROM way")
def flt_18(t):
    return t("way").select("id", *[T.explicitly_allowed(WAY, m).alias(n) for m, n in (("motorcar", "car"), ("bicycle", "bike"), ("foot", "walk"))])


@query("flt-19", f"SELECT id, {_in('motorcar', _DENY)} AS car, coalesce(bicycle IN ('no','license','use_sidepath'), FALSE) AS bike, {_in('foot', _DENY)} AS walk FROM way")
def flt_19(t):
    return t("way").select("id", *[T.explicitly_denied(WAY, m).alias(n) for m, n in (("motorcar", "car"), ("bicycle", "bike"), ("foot", "walk"))])


@query("flt-20", "SELECT id, coalesce(bicycle = 'dismount', FALSE) OR coalesce(cycleway = 'dismount', FALSE) AS dismount, coalesce(highway = 'construction', FALSE) AS building FROM way")
def flt_20(t):
    return t("way").select("id", T.dismount(WAY).alias("dismount"), T.under_construction(WAY).alias("building"))


_LOT = "CASE o_orderkey % 4 WHEN 0 THEN 'parking' WHEN 1 THEN 'bicycle_parking' WHEN 2 THEN 'bus_station' END"
_RIDE, _ACCESS = "CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END", "CASE o_orderkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' END"


def _lots(t):
    return t("orders").select(C("o_orderkey").alias("id"), F.expr(_LOT).alias("amenity"), F.expr(_RIDE).alias("park_ride"), F.expr(_ACCESS).alias("access"))


@query("flt-21", f"SELECT id, coalesce(amenity = 'parking' AND r <> 'no', FALSE) AS ride, coalesce(amenity = 'bicycle_parking', FALSE) AND coalesce(a NOT IN ('private', 'no'), TRUE) AS bikes FROM (SELECT o_orderkey AS id, {_LOT} AS amenity, {_RIDE} AS r, {_ACCESS} AS a FROM orders) q")
def flt_21(t):
    tag = T.from_columns(["amenity", "park_ride", "access"])
    return _lots(t).select("id", T.park_and_ride(tag).alias("ride"), T.bike_parking(tag).alias("bikes"))


_ON = lambda *tests: " OR ".join(f"coalesce({x}, FALSE)" for x in tests)


@query("flt-22", f"""SELECT id, {_ON("highway = 'bus_stop'", "railway IN ('tram_stop', 'station', 'halt')", "amenity = 'bus_station'")} AS stop, {_ON("barrier = 'bollard'")} AS bollard, {_ON("highway = 'elevator'")} AS elevator, {_ON("amenity = 'bicycle_rental'")} AS rental FROM tagged""")
def flt_22(t):
    tag = T.from_columns(["highway", "railway", "amenity", "barrier"])
    return t("tagged").select("id", T.is_stop(tag).alias("stop"), T.is_bollard(tag).alias("bollard"), T.is_elevator(tag).alias("elevator"), T.is_bike_rental(tag).alias("rental"))


_YES, _NO = "{} IN ('yes', '1', 'true')", "{} IN ('no', '0', 'false')"
_FLAGS = {
    "steps": _ON("highway = 'steps'"), "roundabout": _ON("junction = 'roundabout'"), "oneway_forward": _ON(_YES.format("oneway")), "oneway_reverse": _ON("oneway = '-1'"),
    "bike_forward": _ON(_YES.format("oneway_bicycle"), _NO.format("bicycle_backwards")), "bike_reverse": _ON("oneway_bicycle = '-1'"), "sidepath_forward": _ON("bicycle_forward = 'use_sidepath'"),
    "sidepath_reverse": _ON("bicycle_backward = 'use_sidepath'"), "opposable": _ON("starts_with(cycleway, 'opposite')", "starts_with(cycleway_left, 'opposite')", "starts_with(cycleway_right, 'opposite')"),
    "area": f"({_ON("area = 'yes'", "amenity IN ('parking', 'bicycle_parking')")}) AND nodes > 2",
}


@query("flt-23", "SELECT id, " + ", ".join(f"{sql} AS {name}" for name, sql in _FLAGS.items()) + " FROM tagged")
def flt_23(t):
    flags = T.way_flags(lambda key: C(key.replace(":", "_")), C("nodes"))
    return t("tagged").select("id", *[flags[k].alias(k) for k in _FLAGS])


@query("flt-24", "SELECT id, coalesce(foot IN ('yes','1','true'), FALSE) AS yes, coalesce(foot IN ('no','0','false'), FALSE) AS no FROM way")
def flt_24(t):
    return t("way").select("id", T.is_true(WAY, "foot").alias("yes"), T.is_false(WAY, "foot").alias("no"))


@query("flt-25", "SELECT DISTINCT nodeId FROM way_node WHERE wayId IN (SELECT wayId FROM way_node GROUP BY wayId HAVING count(*) > 1)")
def flt_25(t):
    many = t("way_node").groupBy("wayId").agg(F.count("*").alias("n")).where("n > 1")
    return t("way_node").join(many, "wayId", "left_semi").select("nodeId").distinct()


@query("flt-26", "SELECT DISTINCT nodeId FROM way_node n JOIN way w ON w.id = n.wayId WHERE w.highway = 'residential' OR n.nodeId % 50 = 0")
def flt_26(t):
    street = t("way").where("highway = 'residential'").select(C("id").alias("wayId"))
    used = t("way_node").join(street, "wayId", "left_semi").select("nodeId")
    return used.union(t("way_node").where("nodeId % 50 = 0").select("nodeId")).distinct()


@query("flt-27", f"SELECT id, CAST(2 AS BIGINT) AS found FROM stop WHERE {NEAR}")
def flt_27(t):
    both = t("stop").where(_near()).select("id").union(t("stop").where(_near(use_box=False)).select("id"))
    return both.groupBy("id").agg(F.count("*").alias("found"))


# Projections.


@query("prj-01", f"SELECT id, {s6('degrees(radians(lat))')} AS v_lat, {s6('degrees(radians(lng))')} AS v_lng FROM street_vertex")
def prj_01(t):
    return t("street_vertex").select("id", r6(F.degrees(F.radians("lat"))).alias("v_lat"), r6(F.degrees(F.radians("lng"))).alias("v_lng"))


@query("prj-02", f"SELECT id, {s6('radians(lng)')} AS x, {s6('radians(lat)')} AS y FROM street_vertex")
def prj_02(t):
    return t("street_vertex").select("id", r6(F.radians("lng")).alias("x"), r6(F.radians("lat")).alias("y"))


@query("prj-03", "SELECT id, name || '-' || branch || '-' || sentido || ' (' || type || ')' AS title FROM travel_info")
def prj_03(t):
    return t("travel_info").select("id", F.concat("name", F.lit("-"), "branch", F.lit("-"), "sentido", F.lit(" ("), "type", F.lit(")")).alias("title"))


@query("prj-04", "SELECT id, type || ' - Line ' || name || ' - Branch ' || branch || ' - ' || sentido || ' - From' AS said FROM travel_info")
def prj_04(t):
    return t("travel_info").select("id", F.concat("type", F.lit(" - Line "), "name", F.lit(" - Branch "), "branch", F.lit(" - "), "sentido", F.lit(" - From")).alias("said"))


@query("prj-05", "SELECT id, least(vertexStartId, vertexEndId) || '-' || greatest(vertexStartId, vertexEndId) || '-' || side AS keyValue FROM sidewalk_edge")
def prj_05(t):
    return t("sidewalk_edge").select("id", F.concat_ws("-", F.least("vertexStartId", "vertexEndId"), F.greatest("vertexStartId", "vertexEndId"), "side").alias("keyValue"))


@query("prj-06", "SELECT id, least(vertexStartId, vertexEndId) || '-' || greatest(vertexStartId, vertexEndId) || '-cross' AS keyValue FROM crossing")
def prj_06(t):
    return t("crossing").select("id", F.concat_ws("-", F.least("vertexStartId", "vertexEndId"), F.greatest("vertexStartId", "vertexEndId"), F.lit("cross")).alias("keyValue"))


@query("prj-07", "SELECT id, 'RAMP' AS type, lat, lng, isAccessible FROM ramp UNION ALL SELECT id, 'STOP', lat, lng, isAccessible FROM stop")
def prj_07(t):
    named = lambda name, kind: t(name).select("id", F.lit(kind).alias("type"), "lat", "lng", "isAccessible")
    return named("ramp", "RAMP").unionByName(named("stop", "STOP"))


@query("prj-08", "SELECT wayId, string_agg(CAST(nodeId AS VARCHAR), ' -> ' ORDER BY pos) AS readable FROM way_node GROUP BY wayId")
def prj_08(t):
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("pos", "nodeId"))), lambda x: x["nodeId"].cast("string"))
    return t("way_node").groupBy("wayId").agg(F.array_join(nodes, " -> ").alias("readable"))


@query("prj-09", """SELECT id, '{"id":' || id || ',"type":"' || type || '"}' AS json FROM travel_info""")
def prj_09(t):
    return t("travel_info").select("id", F.to_json(F.struct("id", "type")).alias("json"))


# Joins.


@query("jon-01", "SELECT e.vertexStartId, e.vertexEndId, i.address FROM street_edge e JOIN street_info i ON i.wayId = e.wayId")
def jon_01(t):
    return t("street_edge").join(t("street_info"), "wayId").select("vertexStartId", "vertexEndId", "address")


_START = "JOIN street_vertex v ON v.id = e.vertexStartId WHERE " + within("v.lat", "v.lng", LAT, LNG, 0.5)


@query("jon-02", f"SELECT e.vertexStartId, e.vertexEndId FROM street_edge e {_START}")
def jon_02(t):
    return S.edges_near(t("street_edge"), t("street_vertex"), LAT, LNG, 0.5).select("vertexStartId", "vertexEndId")


@query("jon-03", f"SELECT e.id FROM sidewalk_edge e {_START}")
def jon_03(t):
    return S.edges_near(t("sidewalk_edge"), t("street_vertex"), LAT, LNG, 0.5).select("id")


@query("jon-04", f"SELECT e.id FROM crossing e {_START}")
def jon_04(t):
    return S.edges_near(t("crossing"), t("street_vertex"), LAT, LNG, 0.5).select("id")


def _rect(v: str) -> str:
    return RECT.replace("lat", f"{v}.lat").replace("lng", f"{v}.lng")


@query("jon-05", f"SELECT e.id FROM sidewalk_edge e JOIN street_vertex a ON a.id = e.vertexStartId JOIN street_vertex b ON b.id = e.vertexEndId WHERE ({_rect('a')}) OR ({_rect('b')})")
def jon_05(t):
    return S.edges_in_rectangle(t("sidewalk_edge"), t("street_vertex"), *RECTANGLE).select("id")


_SERVED = "ramp r JOIN crossing c ON c.rampStartId = r.id OR c.rampEndId = r.id"


@query("jon-06", f"SELECT r.id, c.id AS crossing FROM {_SERVED} WHERE {within('r.lat', 'r.lng', LAT, LNG, 1.5)}")
def jon_06(t):
    return S.ramps_with_crossings(t("ramp").where(S.in_radius(LAT, LNG, 1.5)), t("crossing")).select("id", "crossing")


@query("jon-07", f"SELECT id FROM ramp r WHERE {within('r.lat', 'r.lng', LAT, LNG, 3)} AND NOT EXISTS (SELECT 1 FROM crossing c WHERE c.rampStartId = r.id OR c.rampEndId = r.id)")
def jon_07(t):
    return S.free_ramps(t("ramp").where(S.in_radius(LAT, LNG, 3.0)), t("crossing")).select("id")


@query("jon-08", f"SELECT r.id, c.id AS crossing FROM {_SERVED} WHERE {_rect('r')}")
def jon_08(t):
    return S.ramps_with_crossings(t("ramp").where(S.in_rectangle(*RECTANGLE)), t("crossing")).select("id", "crossing")


@query("jon-09", "SELECT DISTINCT vertexStartId AS id, vertexEndId AS neighbour FROM street_edge UNION SELECT vertexEndId, vertexStartId FROM street_edge")
def jon_09(t):
    return S.street_neighbours(t("street_edge"))


_OPEN = "crossing c JOIN ramp a ON a.id = c.rampStartId AND a.isAccessible JOIN ramp b ON b.id = c.rampEndId AND b.isAccessible"
_OPEN_EDGES = f"SELECT vertexStartId AS s, vertexEndId AS e FROM sidewalk_edge WHERE isAccessible UNION SELECT c.vertexStartId, c.vertexEndId FROM {_OPEN}"


@query("jon-10", f"SELECT s AS id, e AS neighbour FROM ({_OPEN_EDGES}) x UNION SELECT e, s FROM ({_OPEN_EDGES}) y")
def jon_10(t):
    return S.sidewalk_neighbours(t("sidewalk_edge"), t("crossing"), t("ramp"))


@query("jon-11", f"SELECT c.fromStopId, c.toTravelInfoId FROM {_PLACED} WHERE {within('a.lat', 'a.lng', LAT, LNG, 1.5)} AND {within('b.lat', 'b.lng', LAT, LNG, 1.5)}")
def jon_11(t):
    return snk_10(t).where(S.in_radius(LAT, LNG, 1.5, "from_lat", "from_lng") & S.in_radius(LAT, LNG, 1.5, "to_lat", "to_lng")).select("fromStopId", "toTravelInfoId")


_PAIR = f"stop a JOIN stop b ON a.id <> b.id AND a.travelInfoId <> b.travelInfoId AND {planar('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 0.5 / 6371.0"


@query("jon-12", f"SELECT a.id AS from_id, b.id AS to_id FROM {_PAIR}")
def jon_12(t):
    pairs = S.within_distance(t("stop"), t("stop"), 0.5).where("l.id <> r.id and l.travelInfoId <> r.travelInfoId")
    return pairs.select(C("l.id").alias("from_id"), C("r.id").alias("to_id"))


@query("jon-13", "SELECT a.travelInfoId, min(a.sequence) AS from_seq, max(b.sequence) AS to_seq FROM stop a JOIN stop b ON a.travelInfoId = b.travelInfoId WHERE a.isAccessible AND NOT b.isAccessible GROUP BY a.travelInfoId HAVING min(a.sequence) <= max(b.sequence)")
def jon_13(t):
    some = lambda which, agg, name: t("stop").where(which).groupBy("travelInfoId").agg(agg("sequence").alias(name))
    return some("isAccessible", F.min, "from_seq").join(some("not isAccessible", F.max, "to_seq"), "travelInfoId").where("from_seq <= to_seq")


@query("jon-14", f"SELECT c.fromStopId, c.toTravelInfoId, i.name FROM combination c JOIN travel_info i ON i.id = c.fromTravelInfoId WHERE c.fromTravelInfoId IN {IDS}")
def jon_14(t):
    names = t("travel_info").where(C("id").isin(*IDS)).select(C("id").alias("fromTravelInfoId"), "name")
    return t("combination").join(names, "fromTravelInfoId").select("fromStopId", "toTravelInfoId", "name")


@query("jon-15", "SELECT DISTINCT v.id, v.lat, v.lng FROM street_vertex v JOIN sidewalk_edge e ON v.id = e.vertexStartId OR v.id = e.vertexEndId")
def jon_15(t):
    ends = t("sidewalk_edge").select(F.explode(F.array("vertexStartId", "vertexEndId")).alias("id"))
    return t("street_vertex").join(ends, "id", "left_semi")


@query("jon-16", "SELECT c.fromStopId, c.toTravelInfoId, a.sequence AS from_seq, b.sequence AS to_seq FROM combination c JOIN stop a ON a.id = c.fromStopId JOIN stop b ON b.id = c.toStopId")
def jon_16(t):
    seq = lambda key, name: t("stop").select(C("id").alias(key), C("sequence").alias(name))
    return t("combination").join(seq("fromStopId", "from_seq"), "fromStopId").join(seq("toStopId", "to_seq"), "toStopId").select("fromStopId", "toTravelInfoId", "from_seq", "to_seq")


@query("jon-17", "SELECT i.id, min_by(s.id, s.sequence) AS firstStopId, max_by(s.id, s.sequence) AS lastStopId FROM travel_info i JOIN stop s ON s.travelInfoId = i.id GROUP BY i.id")
def jon_17(t):
    ends = t("stop").groupBy(C("travelInfoId").alias("id")).agg(F.min_by("id", "sequence").alias("firstStopId"), F.max_by("id", "sequence").alias("lastStopId"))
    return t("travel_info").select("id").join(ends, "id")


@query("jon-18", "SELECT n.wayId % 100 AS relation, CAST(count(*) AS BIGINT) AS members FROM (SELECT DISTINCT wayId FROM way_node) n LEFT JOIN way w ON w.id = n.wayId AND w.highway <> 'proposed' GROUP BY n.wayId % 100 HAVING count(*) = count(w.id)")
def jon_18(t):
    members = t("way_node").select("wayId").distinct().withColumn("relation", C("wayId") % 100)
    known = t("way").where("highway <> 'proposed'").select(C("id").alias("wayId"), F.lit(1).alias("known"))
    whole = members.join(known, "wayId", "left").groupBy("relation").agg(F.count("*").alias("members"), F.count("known").alias("resolved"))
    return whole.where("members = resolved").drop("resolved")


@query("jon-19", "SELECT s.id, i.address FROM sidewalk_edge s LEFT JOIN street_info i ON i.wayId = s.streetEdgeBelongToId")
def jon_19(t):
    info = t("street_info").select(C("wayId").alias("streetEdgeBelongToId"), "address")
    return t("sidewalk_edge").join(info, "streetEdgeBelongToId", "left").select("id", "address")


@query("jon-20", "SELECT id, CASE WHEN vertexStartId % 2 = 0 THEN vertexEndId ELSE vertexStartId END AS opposite FROM crossing")
def jon_20(t):
    at = F.when(C("vertexStartId") % 2 == 0, C("vertexStartId")).otherwise(C("vertexEndId"))
    return t("crossing").select("id", F.when(C("vertexStartId") == at, C("vertexEndId")).otherwise(C("vertexStartId")).alias("opposite"))


# Aggregates.


@query("agg-01", f"""SELECT from_id, to_line, {s6('min(d) * 1000')} AS distance, min_by(to_id, round(d, 12) * 1000000 + to_id * 1e-9) AS to_id
    FROM (SELECT a.id AS from_id, b.travelInfoId AS to_line, b.id AS to_id, {planar('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d FROM {_PAIR}) q GROUP BY from_id, to_line""")
def agg_01(t):
    pairs = S.within_distance(t("stop"), t("stop"), 0.5).where("l.id <> r.id and l.travelInfoId <> r.travelInfoId")
    rank = F.round("distance", 12) * 1000000 + C("r.id") * 1e-9
    return pairs.groupBy(C("l.id").alias("from_id"), C("r.travelInfoId").alias("to_line")).agg(r6(F.min("distance") * 1000).alias("distance"), F.min_by("r.id", rank).alias("to_id"))


@query("agg-02", "SELECT CAST(count(*) AS BIGINT) AS n FROM street_vertex")
def agg_02(t):
    return t("street_vertex").agg(F.count("*").alias("n"))


@query("agg-03", "SELECT CAST(count(DISTINCT vertexStartId) AS BIGINT) AS n FROM street_edge")
def agg_03(t):
    return t("street_edge").agg(F.count_distinct("vertexStartId").alias("n"))


@query("agg-04", "SELECT travelInfoId, string_agg(CAST(id AS VARCHAR), ',' ORDER BY sequence, id) AS stops FROM stop GROUP BY travelInfoId")
def agg_04(t):
    stops = F.transform(F.sort_array(F.collect_list(F.struct("sequence", "id"))), lambda x: x["id"].cast("string"))
    return t("stop").groupBy("travelInfoId").agg(F.array_join(stops, ",").alias("stops"))


@query("agg-05", "SELECT travelInfoId, min(sequence) AS first_seq, max(sequence) AS last_seq FROM stop GROUP BY travelInfoId")
def agg_05(t):
    return t("stop").groupBy("travelInfoId").agg(F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"))


@query("agg-06", "SELECT fromTravelInfoId, toTravelInfoId, string_agg(fromStopId || '>' || toStopId, ',' ORDER BY fromStopId) AS linked FROM combination GROUP BY fromTravelInfoId, toTravelInfoId")
def agg_06(t):
    linked = F.transform(F.sort_array(F.collect_list(F.struct("fromStopId", "toStopId"))), lambda x: F.concat_ws(">", x["fromStopId"], x["toStopId"]))
    return t("combination").groupBy("fromTravelInfoId", "toTravelInfoId").agg(F.array_join(linked, ",").alias("linked"))


@query("agg-07", "SELECT toTravelInfoId, CAST(count(DISTINCT toStopId) AS BIGINT) AS stops, CAST(count(DISTINCT fromTravelInfoId) AS BIGINT) AS lines FROM combination GROUP BY toTravelInfoId")
def agg_07(t):
    return t("combination").groupBy("toTravelInfoId").agg(F.count_distinct("toStopId").alias("stops"), F.count_distinct("fromTravelInfoId").alias("lines"))


@query("agg-08", "SELECT keyValue, min(id) AS id FROM (SELECT id, vertexEndId % 50 AS keyValue FROM sidewalk_edge) q GROUP BY keyValue")
def agg_08(t):
    return B.first_of(t("sidewalk_edge").select("id", (C("vertexEndId") % 50).alias("keyValue")), ["keyValue"], ["id"])


@query("agg-09", "SELECT nodeId, CAST(count(*) AS BIGINT) AS n FROM way_node GROUP BY nodeId HAVING count(*) >= 2")
def agg_09(t):
    return t("way_node").groupBy("nodeId").agg(F.count("*").alias("n")).where("n >= 2")


@query("agg-10", "SELECT rampStartId AS rampId, CAST(count(DISTINCT vertexStartId) AS BIGINT) AS vertices FROM crossing WHERE rampStartId IS NOT NULL GROUP BY rampStartId HAVING count(DISTINCT vertexStartId) > 1")
def agg_10(t):
    return B.ramps_of_two_vertices(src_10(t))


@query("agg-11", "SELECT travelInfoId, CAST(sum(sequence * 2 + CASE WHEN isAccessible THEN 0 ELSE 60 END) AS BIGINT) AS cost FROM stop GROUP BY travelInfoId")
def agg_11(t):
    return t("stop").groupBy("travelInfoId").agg(F.sum(C("sequence") * 2 + F.when(C("isAccessible"), 0).otherwise(60)).alias("cost"))


@query("agg-13", "SELECT wayId % 500 AS k, max(nodeId * 10000000 + wayId) % 10000000 AS wayId FROM way_node GROUP BY wayId % 500")
def agg_13(t):
    rows = t("way_node").select((C("wayId") % 500).alias("k"), "wayId", "nodeId")
    return B.first_of(rows, ["k"], ["nodeId", "wayId"], last=True).select("k", "wayId")


@query("agg-14")
def agg_14(t):
    from kerbline.operators.stops import cluster

    return cluster(t("stop"), 0.01)


@query("agg-15", f"SELECT travelInfoId, {s6('avg(lat)')} AS lat FROM stop GROUP BY travelInfoId")
def agg_15(t):
    return t("stop").groupBy("travelInfoId").agg(r6(F.avg("lat")).alias("lat"))


@query("agg-16", "SELECT nodeId, string_agg(CAST(wayId AS VARCHAR), ',' ORDER BY wayId) AS ways FROM (SELECT DISTINCT nodeId, wayId FROM way_node) q GROUP BY nodeId")
def agg_16(t):
    ways = F.transform(F.sort_array(F.collect_set("wayId")), lambda x: x.cast("string"))
    return t("way_node").groupBy("nodeId").agg(F.array_join(ways, ",").alias("ways"))


@query("agg-17", "SELECT CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT vertexStartId) AS BIGINT) AS vertices FROM street_edge")
def agg_17(t):
    return t("street_edge").agg(F.count("*").alias("edges"), F.count_distinct("vertexStartId").alias("vertices"))


# Ordered sequences.


@query("win-01", "SELECT wayId, nodeId AS start, next FROM (SELECT wayId, nodeId, lead(nodeId) OVER (PARTITION BY wayId ORDER BY pos) AS next FROM way_node) q WHERE next IS NOT NULL")
def win_01(t):
    from kerbline.operators.streets import pairs

    return pairs(t("way_node"))


@query("win-02", "SELECT wayId, nodeId, pos FROM (SELECT *, lag(nodeId // 300) OVER (PARTITION BY wayId ORDER BY pos) AS before FROM way_node) q WHERE before IS NULL OR before <> nodeId // 300")
def win_02(t):
    from kerbline.operators.streets import drop_repeats

    return drop_repeats(t("way_node").withColumn("spot", F.floor(C("nodeId") / 300)), ["spot"]).select("wayId", "nodeId", "pos")


_CUTS = """way_node n JOIN (SELECT wayId, max(pos) AS last FROM way_node GROUP BY wayId) m ON m.wayId = n.wayId LEFT JOIN (SELECT nodeId FROM way_node GROUP BY nodeId HAVING count(*) >= 2) x ON x.nodeId = n.nodeId
    LEFT JOIN (SELECT wayId, nodeId, min(pos) AS first FROM way_node GROUP BY wayId, nodeId) f ON f.wayId = n.wayId AND f.nodeId = n.nodeId"""


@query("win-03", f"""SELECT wayId, lag(nodeId) OVER (PARTITION BY wayId ORDER BY pos) AS start, nodeId AS stop FROM (SELECT n.wayId, n.nodeId, n.pos,
    lead(f.first < n.pos, 0) OVER (PARTITION BY n.wayId ORDER BY n.pos) AS dummy, x.nodeId IS NOT NULL OR n.pos = m.last OR n.pos = 1 OR coalesce(lag(f.first < n.pos) OVER (PARTITION BY n.wayId ORDER BY n.pos), FALSE) AS cut FROM {_CUTS}) q WHERE cut
    QUALIFY start IS NOT NULL""")
def win_03(t):
    from kerbline.operators.streets import segments

    return segments(t("way_node"), t("way_node").groupBy("nodeId").agg(F.count("*").alias("n")).where("n >= 2").select("nodeId"))


@query("win-04", "SELECT travelInfoId, id, coalesce(lead(id) OVER w, CASE WHEN count(*) OVER (PARTITION BY travelInfoId) > 1 THEN first_value(id) OVER w END) AS next FROM stop WINDOW w AS (PARTITION BY travelInfoId ORDER BY sequence)")
def win_04(t):
    from kerbline.operators.streets import cyclic_pairs

    return cyclic_pairs(t("stop"), "travelInfoId", "sequence", "id")


@query("win-05", "SELECT wayId, string_agg(CAST(nodeId AS VARCHAR), ',' ORDER BY pos) || CASE WHEN count(*) > 2 THEN ',' || CAST(arg_min(nodeId, pos) AS VARCHAR) ELSE '' END AS ring FROM way_node GROUP BY wayId")
def win_05(t):
    ring = F.transform(F.sort_array(F.collect_list(F.struct("pos", "nodeId"))), lambda x: x["nodeId"].cast("string"))
    rings = t("way_node").groupBy("wayId").agg(ring.alias("r"))
    closed = F.when(F.size("r") > 2, F.concat("r", F.slice("r", 1, 1))).otherwise(C("r"))
    return rings.select("wayId", F.array_join(closed, ",").alias("ring"))


@query("win-06", "SELECT e.vertexStartId, e.vertexEndId, CAST(ROW_NUMBER() OVER (PARTITION BY e.vertexStartId ORDER BY round(CASE WHEN atan2(b.lat - a.lat, b.lng - a.lng) < 0 THEN atan2(b.lat - a.lat, b.lng - a.lng) + 2 * pi() ELSE atan2(b.lat - a.lat, b.lng - a.lng) END, 6) % 6.283185, e.vertexEndId) AS INT) AS place FROM street_edge e JOIN street_vertex a ON a.id = e.vertexStartId JOIN street_vertex b ON b.id = e.vertexEndId")
def win_06(t):
    rows = S.with_endpoints(t("street_edge"), t("street_vertex"))
    angle = F.round(G.angle_to("start_lat", "start_lng", "end_lat", "end_lng"), 6) % 6.283185
    return rows.select("vertexStartId", "vertexEndId", F.row_number().over(Window.partitionBy("vertexStartId").orderBy(angle, "vertexEndId")).alias("place"))


@query("win-07", "SELECT least(vertexStartId, vertexEndId) AS a, greatest(vertexStartId, vertexEndId) AS b, min(vertexStartId) AS kept FROM street_edge GROUP BY 1, 2")
def win_07(t):
    rows = t("street_edge").select(F.least("vertexStartId", "vertexEndId").alias("a"), F.greatest("vertexStartId", "vertexEndId").alias("b"), C("vertexStartId").alias("kept"))
    return B.first_of(rows, ["a", "b"], ["kept"])


# Links between the stops of a line: every twelfth stop is the last of its branch, and every line's largest sequence but two leads back to its first stop.
_LINKED = """linked AS (SELECT s.id, s.travelInfoId, CASE WHEN s.sequence % 12 = 0 THEN NULL WHEN s.sequence = m.last - 2 THEN m.first WHEN s.sequence % 17 = 5 THEN s.id + 25000000 ELSE s.id + 25 END AS nextStopId
    FROM stop s JOIN (SELECT travelInfoId, max(sequence) AS last, min(id) AS first FROM stop GROUP BY travelInfoId) m ON m.travelInfoId = s.travelInfoId)"""


@query("win-08")
def win_08(t):
    """Stops of each line by its links, from its first stop to a stop ten sequences on."""
    from kerbline.operators.transit import followed

    lines = t("stop").groupBy("travelInfoId").agg(F.max("sequence").alias("last"), F.min("id").alias("first"))
    s = t("stop").join(lines, "travelInfoId")
    after = F.when(C("sequence") % 12 == 0, None).when(C("sequence") == C("last") - 2, C("first")).when(C("sequence") % 17 == 5, C("id") + 25_000_000).otherwise(C("id") + 25)
    linked = s.select("id", after.alias("nextStopId"))
    asked = t("stop").select(C("id").alias("request"), C("id").alias("first"), (C("id") + 25 * (C("sequence") % 10)).alias("last"))
    ids = F.array_join(F.transform("path", lambda x: x.cast("string")), ",")
    return followed(linked, asked).select("request", "reached", ids.alias("stops"))


# Top-k and sets.


@query("top-01", f"SELECT id FROM stop ORDER BY round({planar('lat', 'lng', str(LAT), str(LNG))}, 9), id LIMIT 1")
def top_01(t):
    return S.nearest(t("stop"), LAT, LNG).select("id")


@query("top-02", f"SELECT s.id, arg_min(v.id, round({km('s.lat', 's.lng', 'v.lat', 'v.lng')}, 9) * 1000000 + v.id * 1e-6) AS nearest FROM stop s, street_vertex v GROUP BY s.id")
def top_02(t):
    """The nearest street vertex of every stop, however far it is."""
    return S.nearest_each(t("stop").select("id", "lat", "lng"), t("street_vertex")).select("id", "nearest")


@query("top-03", f"SELECT id FROM stop ORDER BY round({planar('lat', 'lng', str(LAT), str(LNG))}, 9), id LIMIT 25")
def top_03(t):
    return S.nearest(t("stop"), LAT, LNG, n=25).select("id")


@query("top-05", f"SELECT travelInfoId, arg_min(id, round({km('lat', 'lng', str(LAT), str(LNG))}, 6) * 1000000 + id * 1e-6) AS id FROM stop GROUP BY travelInfoId")
def top_05(t):
    return t("stop").groupBy("travelInfoId").agg(F.min_by("id", F.round(G.haversine_km("lat", "lng", LAT, LNG), 6) * 1000000 + C("id") * 1e-6).alias("id"))


@query("top-06", "SELECT travelInfoId, arg_min(id, CASE WHEN sequence < 5 THEN 0 ELSE 1 END * 1000000 + sequence) AS id FROM stop GROUP BY travelInfoId")
def top_06(t):
    rows = t("stop").withColumn("late", C("sequence") >= 5)
    return B.first_of(rows, ["travelInfoId"], ["late", "sequence", "id"]).select("travelInfoId", "id")


@query("set-01", "SELECT vertexStartId AS id FROM sidewalk_edge UNION SELECT vertexEndId FROM sidewalk_edge UNION SELECT vertexStartId FROM crossing UNION SELECT vertexEndId FROM crossing")
def set_01(t):
    ends = lambda name: t(name).select(F.explode(F.array("vertexStartId", "vertexEndId")).alias("id"))
    return ends("sidewalk_edge").union(ends("crossing")).distinct()


@query("set-02", "SELECT vertexStartId, vertexEndId FROM sidewalk_edge UNION ALL SELECT vertexStartId, vertexEndId FROM crossing")
def set_02(t):
    return t("sidewalk_edge").select("vertexStartId", "vertexEndId").unionByName(t("crossing").select("vertexStartId", "vertexEndId"))


@query("set-03", "SELECT id FROM street_vertex WHERE id % 2 = 0 UNION SELECT id FROM street_vertex WHERE id % 3 = 0")
def set_03(t):
    return t("street_vertex").where("id % 2 = 0").select("id").union(t("street_vertex").where("id % 3 = 0").select("id")).distinct()


@query("set-04", "SELECT DISTINCT travelInfoId FROM stop")
def set_04(t):
    return t("stop").select("travelInfoId").distinct()


@query("set-05", "SELECT id, lat, lng FROM street_vertex UNION ALL SELECT id + 100000, lat, lng FROM street_vertex")
def set_05(t):
    return t("street_vertex").unionByName(t("street_vertex").withColumn("id", C("id") + 100000))
