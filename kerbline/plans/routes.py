"""Queries of whole routes, saved maps and what depends on both."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.operators import spatial as S
from kerbline.operators import streets as W
from kerbline.operators import tables as B
from kerbline.operators import transit as R
from kerbline.plans.base import ORACLES, km, planar, query, r6, s6, within
from kerbline.plans.network import _DIRECT, _FRONT, _MOVED, _OPENWAY, END, START, _column_row, _costed, _leg_ends, _with
from kerbline.plans.relational import LAT, LNG, RECT, RECTANGLE, WAY, win_03

C = F.col
# A start and an end that some lines join directly and others with a change.
FROM, TO = (-34.608, -58.415), (-34.602, -58.4)


_COMB = f"""comb AS (SELECT a.id AS fromStopId, a.travelInfoId AS fromTravelInfoId, b.travelInfoId AS toTravelInfoId, b.id AS toStopId FROM stop a JOIN stop b ON a.id <> b.id AND a.travelInfoId <> b.travelInfoId
  AND {planar('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 0.5 / 6371.0 QUALIFY row_number() OVER (PARTITION BY a.id, b.travelInfoId ORDER BY round({planar('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 12), b.id) = 1)"""
_OUT = lambda name: " AND ".join(f"NOT {within(f'{name}.lat', f'{name}.lng', *p, 0.5)}" for p in (FROM, TO))
_CONTEXT = f"""{_COMB}, lines AS (SELECT travelInfoId AS line, min(sequence) AS lo FROM stop WHERE {within('lat', 'lng', *FROM, 0.5)} GROUP BY 1),
  ctx AS (SELECT DISTINCT CASE WHEN x.lo IS NOT NULL THEN f.id ELSE t.id END AS a, CASE WHEN x.lo IS NOT NULL THEN t.id ELSE f.id END AS b FROM comb c JOIN stop f ON f.id = c.fromStopId JOIN stop t ON t.id = c.toStopId
    LEFT JOIN lines x ON x.line = c.fromTravelInfoId LEFT JOIN lines y ON y.line = c.toTravelInfoId WHERE {_OUT('f')} AND {_OUT('t')} AND CASE WHEN x.lo IS NOT NULL THEN x.lo < f.sequence ELSE y.lo < t.sequence END)"""
_CHANGED = f"""{_CONTEXT}, board AS (SELECT * FROM stop WHERE {within('lat', 'lng', *FROM, 0.5)}),
  leave AS (SELECT *, {km('lat', 'lng', str(TO[0]), str(TO[1]))} AS km FROM stop WHERE {within('lat', 'lng', *TO, 0.5)} QUALIFY row_number() OVER (PARTITION BY travelInfoId ORDER BY round({km('lat', 'lng', str(TO[0]), str(TO[1]))}, 6), id) = 1),
  whole AS (SELECT a.travelInfoId AS first, s.id AS fromStop, a.id AS changeFrom, b.id AS changeTo, b.travelInfoId AS second, e.id AS toStop,
     round(a.sequence - s.sequence + e.sequence - b.sequence + 200 + 60 * ((NOT s.isAccessible)::INT + (NOT a.isAccessible)::INT + (NOT b.isAccessible)::INT + (NOT e.isAccessible)::INT)
       + CASE WHEN i.type <> 'SUBWAY' THEN 50 ELSE 0 END + CASE WHEN j.type <> 'SUBWAY' THEN 50 ELSE 0 END + 10 * ({km('a.lat', 'a.lng', 'b.lat', 'b.lng')} + e.km), 6) AS cost
    FROM ctx JOIN stop a ON a.id = ctx.a JOIN stop b ON b.id = ctx.b JOIN board s ON s.travelInfoId = a.travelInfoId AND s.sequence < a.sequence JOIN leave e ON e.travelInfoId = b.travelInfoId AND b.sequence < e.sequence
    JOIN travel_info i ON i.id = a.travelInfoId JOIN travel_info j ON j.id = b.travelInfoId),
  changed AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY first, second ORDER BY cost, fromStop, changeFrom, changeTo) = 1)"""


def _changes(t):
    return R.combinations(t("stop"))


@query("rte-09")
def rte_09(t):
    found = R.context(R.candidates(t("stop"), *FROM), t("stop"), _changes(t), [FROM, TO])
    return found.groupBy("first", "second").agg(F.count("*").alias("links"), F.min("a.id").alias("least"))


@query("rte-10")
def rte_10(t):
    return R.routes(t("stop"), t("travel_info"), _changes(t), FROM, TO)


@query("rte-10-changes")
def rte_10_changes(t):
    return R.transfer_routes(t("stop"), t("travel_info"), _changes(t), FROM, TO)


@query("rte-10-journeys")
def rte_10_journeys(t):
    """All journeys at once, each route with its walks, rides and incidents, and the requests that have none."""
    from kerbline.operators.journeys import journeys

    found = journeys(t("journey"), t("stop"), t("travel_info"), _changes(t), t("sidewalk_edge"), t("crossing"), t("ramp"), t("street_vertex"))
    rides = F.filter("paths", lambda p: p["kind"] == "RIDE")
    total = lambda size: F.aggregate(rides, F.lit(0), lambda n, p: n + F.size(p[size]))
    return found.select("request", "status", "rank", "first", "fromStop", "changeFrom", "changeTo", "second", "toStop", "cost", F.when(C("paths").isNotNull(), F.size("paths")).alias("parts"), total("points").alias("ridden"), total("incidents").alias("blocked"))


@query("rte-13")
def rte_13(t):
    legs = R.direct_routes(t("stop"), t("travel_info"), START, END).drop("cost")
    done = R.ridden(legs, t("stop"), t("travel_info"))
    ids = F.array_join(F.transform("path", lambda p: p["id"].cast("string")), ",")
    return done.select("travelInfoId", ids.alias("stops"), r6(F.aggregate("path", F.lit(0.0), lambda s, p: s + p["lat"])).alias("lat"), "title", F.size("incidents").alias("incidents"))


def _stored(t):
    """Stored walks of every second combination, as a list of both stops."""
    rows = t("combination").where("fromStopId % 2 = 0")
    return rows.select("fromStopId", "toTravelInfoId", F.to_json(F.array("fromStopId", "toStopId")).alias("walkPath"))


@query("rte-14")
def rte_14(t):
    """The stored walk of a combination, else a live search."""
    from kerbline.operators.walk import combination_walks

    every = t("combination").select("fromStopId", "toTravelInfoId", "toStopId").join(_stored(t), ["fromStopId", "toTravelInfoId"], "left")
    live = combination_walks(every.where("walkPath is null"), t("stop"), t("street_vertex"), _costed(t))
    found = live.select("fromStopId", "toTravelInfoId", F.size("path").alias("walked"))
    rows = every.join(found, ["fromStopId", "toTravelInfoId"], "left")
    stored = F.size(F.from_json("walkPath", "array<long>"))
    return rows.select("fromStopId", "toTravelInfoId", C("walkPath").isNotNull().alias("stored"), F.coalesce(F.when(C("walkPath").isNotNull(), stored), "walked").alias("points"))


_ENDS_IN = " OR ".join(f"({RECT.replace('lat', f'{v}.lat').replace('lng', f'{v}.lng')})" for v in ("a", "b"))


@query("rte-16", f"""SELECT 'RAMP' AS type, id FROM ramp WHERE {RECT} AND EXISTS (SELECT 1 FROM crossing c WHERE c.rampStartId = ramp.id OR c.rampEndId = ramp.id) UNION ALL SELECT 'SIDEWALK', e.id FROM sidewalk_edge e JOIN street_vertex a ON a.id = e.vertexStartId JOIN street_vertex b ON b.id = e.vertexEndId WHERE {_ENDS_IN}
    UNION ALL SELECT 'STOP', id FROM stop WHERE {RECT}""")
def rte_16(t):
    """Ramps that serve a crossing, sidewalks and stops in a rectangle; stops within ten metres are one, which the stops of these tables are not."""
    from kerbline.operators.stops import cluster

    kind = lambda df, name: df.select(F.lit(name).alias("type"), "id")
    inside = t("stop").where(S.in_rectangle(*RECTANGLE))
    leaders = cluster(inside, 0.01).select(C("leader").alias("id")).distinct()
    walks = S.edges_in_rectangle(t("sidewalk_edge").select("id", "vertexStartId", "vertexEndId"), t("street_vertex"), *RECTANGLE)
    ramps = S.ramps_with_crossings(t("ramp").where(S.in_rectangle(*RECTANGLE)), t("crossing")).select("id").distinct()
    return kind(ramps, "RAMP").unionByName(kind(walks, "SIDEWALK")).unionByName(kind(leaders, "STOP"))


_NEAR = "SELECT '{0}' AS kind, e.vertexStartId, e.vertexEndId, a.lat AS start_lat, b.lat AS end_lat FROM {1} e JOIN street_vertex a ON a.id = e.vertexStartId JOIN street_vertex b ON b.id = e.vertexEndId WHERE " + within("a.lat", "a.lng", LAT, LNG, 0.5)


@query("rte-19", " UNION ALL ".join(_NEAR.format(*x) for x in (("street", "street_edge"), ("sidewalk", "sidewalk_edge"), ("crossing", "crossing"))))
def rte_19(t):
    def near(kind, name):
        rows = S.edges_near(t(name).select("vertexStartId", "vertexEndId"), t("street_vertex"), LAT, LNG, 0.5)
        return S.with_endpoints(rows, t("street_vertex")).select(F.lit(kind).alias("kind"), "vertexStartId", "vertexEndId", "start_lat", "end_lat")

    return near("street", "street_edge").unionByName(near("sidewalk", "sidewalk_edge")).unionByName(near("crossing", "crossing"))


@query("etl-14")
def etl_14(t):
    return W.directed_edges(win_03(t), t("way"), WAY).groupBy("wayId").agg(F.count("*").alias("edges"), F.sum("permission").alias("permissions"))


_DEGREE = "SELECT vertexStartId AS vertex, count(DISTINCT vertexEndId) AS degree FROM street_edge GROUP BY 1"


@query("swk-02", f"SELECT vertex, CAST(CASE WHEN degree = 1 THEN 2 ELSE degree END AS BIGINT) AS corners FROM ({_DEGREE}) d")
def swk_02(t):
    """As many corners as edges at a vertex, two at a dead end."""
    from kerbline.operators.sidewalks import corners

    return corners(t("street_vertex"), t("street_edge")).groupBy("vertex").agg(F.count("*").alias("corners"))


@query("swk-05", "SELECT least(vertexStartId, vertexEndId) || '-' || greatest(vertexStartId, vertexEndId) || '-' || side AS key FROM street_edge JOIN (SELECT 0 AS side UNION ALL SELECT 1) s ON vertexStartId < vertexEndId")
def swk_05(t):
    """A sidewalk on both sides of every street."""
    from kerbline.operators.sidewalks import corners, sidewalks

    return sidewalks(corners(t("street_vertex"), t("street_edge"))).select("key")


# on a grid corners are the quarters of its cells: a crossing joins those around a vertex
@query("swk-09", f"""SELECT 'sidewalk' AS kind, CAST(2 * count(*) AS BIGINT) AS n FROM street_edge WHERE vertexStartId < vertexEndId
    UNION ALL SELECT 'crossing', CAST(sum(CASE WHEN degree > 2 THEN degree WHEN degree = 2 THEN 1 ELSE 1 END) AS BIGINT) FROM ({_DEGREE}) d""")
def swk_09(t):
    from kerbline.operators.sidewalks import build

    _, walks, crosses = build(t("street_vertex"), t("street_edge"), G.SIDEWALK_OFFSET)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(walks, "sidewalk").union(count(crosses, "crossing"))


# Saves and snapshots.


@query("snk-02", "SELECT id, lat FROM stop UNION ALL SELECT m.last + row_number() OVER (ORDER BY r.id), r.lat FROM ramp r, (SELECT max(id) AS last FROM stop) m")
def snk_02(t):
    """All ramps added to the stops in one write, with the ids that follow."""
    return B.insert(t("stop").select("id", "lat"), t("ramp").select("id", "lat", C("id").alias("old")), ["old"]).select("id", "lat")


@query("snk-07", """SELECT 'vertex' AS what, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM street_vertex v WHERE EXISTS (SELECT 1 FROM sidewalk_edge e WHERE v.id IN (e.vertexStartId, e.vertexEndId)) OR EXISTS (SELECT 1 FROM crossing e WHERE v.id IN (e.vertexStartId, e.vertexEndId))
    UNION ALL SELECT 'sidewalk', count(*), CAST(sum(id) AS BIGINT) FROM sidewalk_edge UNION ALL SELECT 'crossing', count(*), CAST(sum(id) AS BIGINT) FROM crossing""")
def snk_07(t):
    """Sidewalk vertices, edges and crossings saved together and read back."""
    from kerbline.sources.snapshots import saved_together

    walks, crosses = t("sidewalk_edge"), t("crossing")
    used = walks.select("vertexStartId", "vertexEndId").union(crosses.select("vertexStartId", "vertexEndId")).select(F.explode(F.array("vertexStartId", "vertexEndId")).alias("id")).distinct()
    back = saved_together(t.spark, {"vertex": t("street_vertex").join(used, "id", "left_semi"), "sidewalk": walks, "crossing": crosses})
    count = lambda what: back[what].agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(what).alias("what"), "n", "ids")
    return count("vertex").union(count("sidewalk")).union(count("crossing"))


@query("gra-12", f"SELECT id // 1000 AS block, CAST(count(*) AS INT) AS vertices, {s6('arg_max(lat, id)')} AS last_lat FROM street_vertex GROUP BY 1")
def gra_12(t):
    """Vertices as maps by id, one for each thousand of ids, and a look-up in each."""
    maps = t("street_vertex").groupBy(F.floor(C("id") / 1000).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("lat", "lng")))).alias("m"), F.max("id").alias("last"))
    return maps.select("block", F.size("m").alias("vertices"), r6(C("m")[C("last")]["lat"]).alias("last_lat"))


@query("snp-04", "SELECT vertexStartId AS key, CAST(count(*) AS INT) AS n, min(vertexEndId) AS least FROM street_edge GROUP BY 1")
def snp_04(t):
    from kerbline.sources.snapshots import grouped

    rows = grouped(t("street_edge").select("vertexStartId", "vertexEndId"), "vertexStartId")
    return rows.select("key", F.size("rows").alias("n"), F.array_min(F.transform("rows", lambda r: r["vertexEndId"])).alias("least"))


@query("snp-05", "SELECT s.travelInfoId AS key, CAST(count(*) AS INT) AS n FROM stop s WHERE s.travelInfoId IN (SELECT id FROM travel_info WHERE type = 'SUBWAY') GROUP BY 1")
def snp_05(t):
    from kerbline.sources.snapshots import fetch, grouped

    keys = t("travel_info").where("type = 'SUBWAY'").select(C("id").alias("key"))
    return fetch(grouped(t("stop").select("travelInfoId", "id"), "travelInfoId"), keys).select("key", F.size("rows").alias("n"))


_LINKED = "crossing AS (SELECT c.id, c.vertexStartId, c.vertexEndId, coalesce(s.r, c.rampStartId) AS rampStartId, c.rampEndId FROM crossing0 c LEFT JOIN (SELECT id, id % 9 + 1 AS r FROM crossing0 WHERE id % 4 = 0) s ON s.id = c.id)"


@query("rmp-04")
def rmp_04(t):
    """Ramps associated with crossings, then moved beside them: the whole job."""
    from kerbline.operators.walk import moved_ramps

    lines = t("crossing").where("id % 4 = 0").select(C("id").alias("line"), (C("id") % 9 + 1).alias("rampId"), C("vertexStartId").alias("vertexId"), C("id").alias("crossingId"))
    linked = B.associate_ramps(t("crossing"), lines)
    return moved_ramps(linked, t("street_vertex")).select("id", "crossing", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def _oracles() -> None:
    from kerbline.plans import fixtures

    ORACLES["rte-09"] = _with(_CONTEXT + " SELECT a.travelInfoId AS first, b.travelInfoId AS second, CAST(count(*) AS BIGINT) AS links, min(a.id) AS least FROM ctx JOIN stop a ON a.id = ctx.a JOIN stop b ON b.id = ctx.b GROUP BY 1, 2", "stop")
    ORACLES["rte-10-changes"] = _with(_CHANGED + " SELECT * FROM changed", "stop, travel_info")
    near, to = within("lat", "lng", *FROM, 0.5), within("lat", "lng", *TO, 0.5)
    direct = _DIRECT.replace(within("lat", "lng", *START, 0.5), near).replace(within("lat", "lng", *END, 0.5), to).replace(km("lat", "lng", str(END[0]), str(END[1])), km("lat", "lng", str(TO[0]), str(TO[1])))
    head, tail = direct.rsplit("SELECT o.travelInfoId", 1)
    both = f"{_CHANGED}, {head.rstrip()}, direct AS (SELECT o.travelInfoId{tail}), every AS (SELECT travelInfoId AS first, fromStop, NULL::BIGINT AS changeFrom, NULL::BIGINT AS changeTo, NULL::BIGINT AS second, toStop, cost FROM direct UNION ALL SELECT * FROM changed)"
    ORACLES["rte-10"] = _with(both + " SELECT * FROM every ORDER BY second IS NOT NULL, cost, first, second LIMIT 5", "stop, travel_info")
    ORACLES["rte-13"] = _with(f"legs AS ({'WITH ' + _DIRECT}) SELECT l.travelInfoId, string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY CASE WHEN a.sequence <= b.sequence THEN s.sequence ELSE -s.sequence END) AS stops, {s6('sum(s.lat)')} AS lat, "
        "any_value(i.type || ' - Line ' || i.name || ' - Branch ' || i.branch || ' - ' || i.sentido) AS title, CAST(any_value((NOT a.isAccessible)::INT + (NOT b.isAccessible)::INT) AS INT) AS incidents FROM legs l JOIN stop a ON a.id = l.fromStop JOIN stop b ON b.id = l.toStop "
        "JOIN stop s ON s.travelInfoId = l.travelInfoId AND s.sequence BETWEEN least(a.sequence, b.sequence) AND greatest(a.sequence, b.sequence) JOIN travel_info i ON i.id = l.travelInfoId GROUP BY l.travelInfoId", "stop, travel_info")  # fmt: skip
    near = lambda n: f"{planar('s.lat', 's.lng', f'j.lat{n}', f'j.lng{n}')} <= 0.5 / 6371.0"
    away = " AND ".join(f"{planar(f'{x}.lat', f'{x}.lng', f'j.lat{n}', f'j.lng{n}')} > 0.5 / 6371.0" for x in "ab" for n in (1, 2))
    shut = lambda *names: " + ".join(f"(NOT {x}.isAccessible)::INT" for x in names)
    bus = lambda x: f"CASE WHEN {x}.type <> 'SUBWAY' THEN 50 ELSE 0 END"
    ORACLES["rte-10-journeys"] = _with(f"""{_COMB}, j AS (SELECT *, {km('lat1', 'lng1', 'lat2', 'lng2')} <= 0.3 AS walk FROM journey),
      st AS (SELECT j.request, s.* FROM j JOIN stop s ON NOT j.walk AND {near(1)}), en AS (SELECT j.request, s.*, {km('s.lat', 's.lng', 'j.lat2', 'j.lng2')} AS km FROM j JOIN stop s ON NOT j.walk AND {near(2)}),
      leave AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY request, travelInfoId ORDER BY round(km, 6), id) = 1),
      span AS (SELECT request, travelInfoId FROM (SELECT request, travelInfoId, min(sequence) AS lo FROM st GROUP BY 1, 2) a JOIN (SELECT request, travelInfoId, max(sequence) AS hi FROM en GROUP BY 1, 2) b USING (request, travelInfoId) WHERE lo <= hi),
      direct AS (SELECT s.request, s.travelInfoId AS first, s.id AS fromStop, NULL::BIGINT AS changeFrom, NULL::BIGINT AS changeTo, NULL::BIGINT AS second, e.id AS toStop,
         round(abs(e.sequence - s.sequence) + 100 + 60 * ({shut('s', 'e')}) + {bus('i')} + 10 * e.km, 6) AS cost, abs(e.sequence - s.sequence) + 1 AS ridden, {shut('s', 'e')} AS blocked
         FROM st s JOIN leave e USING (request, travelInfoId) JOIN span USING (request, travelInfoId) JOIN travel_info i ON i.id = s.travelInfoId
         QUALIFY row_number() OVER (PARTITION BY s.request, s.travelInfoId ORDER BY s.sequence >= e.sequence, s.sequence, s.id) = 1),
      own AS (SELECT request, travelInfoId AS line, min(sequence) AS lo FROM st GROUP BY 1, 2),
      link AS (SELECT o.request, c.fromStopId AS a, c.toStopId AS b FROM comb c JOIN own o ON o.line = c.fromTravelInfoId JOIN stop f ON f.id = c.fromStopId WHERE o.lo < f.sequence
         UNION SELECT o.request, c.toStopId, c.fromStopId FROM comb c JOIN own o ON o.line = c.toTravelInfoId JOIN stop f ON f.id = c.toStopId LEFT JOIN own x ON x.request = o.request AND x.line = c.fromTravelInfoId WHERE x.line IS NULL AND o.lo < f.sequence),
      changed AS (SELECT l.request, a.travelInfoId AS first, s.id AS fromStop, a.id AS changeFrom, b.id AS changeTo, b.travelInfoId AS second, e.id AS toStop,
         round(a.sequence - s.sequence + e.sequence - b.sequence + 200 + 60 * ({shut('s', 'a', 'b', 'e')}) + {bus('i')} + {bus('k')} + 10 * ({km('a.lat', 'a.lng', 'b.lat', 'b.lng')} + e.km), 6) AS cost,
         a.sequence - s.sequence + e.sequence - b.sequence + 2 AS ridden, {shut('s', 'a', 'b', 'e')} AS blocked
         FROM link l JOIN j ON j.request = l.request JOIN stop a ON a.id = l.a JOIN stop b ON b.id = l.b JOIN leave e ON e.request = l.request AND e.travelInfoId = b.travelInfoId AND b.sequence < e.sequence
         JOIN st s ON s.request = l.request AND s.travelInfoId = a.travelInfoId AND s.sequence < a.sequence JOIN travel_info i ON i.id = a.travelInfoId JOIN travel_info k ON k.id = b.travelInfoId WHERE {away}
         QUALIFY row_number() OVER (PARTITION BY l.request, a.travelInfoId, b.travelInfoId ORDER BY round(a.sequence - s.sequence + e.sequence - b.sequence + 200 + 60 * ({shut('s', 'a', 'b', 'e')}) + {bus('i')} + {bus('k')} + 10 * ({km('a.lat', 'a.lng', 'b.lat', 'b.lng')} + e.km), 6), s.id, a.id, b.id) = 1),
      every AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY second IS NOT NULL, cost, first, second) AS rank FROM (SELECT * FROM direct UNION ALL SELECT * FROM changed) z QUALIFY rank <= 5)
      SELECT j.request, CASE WHEN NOT j.walk AND (j.request NOT IN (SELECT request FROM st) OR j.request NOT IN (SELECT request FROM en)) THEN 'NoStops' ELSE 'OK' END AS status, CASE WHEN j.walk THEN 1 ELSE r.rank END AS rank, first, fromStop, changeFrom, changeTo, second, toStop, cost,
        CAST(CASE WHEN j.walk THEN 1 WHEN r.second IS NOT NULL THEN 5 WHEN r.request IS NOT NULL THEN 3 END AS INT) AS parts, CAST(CASE WHEN j.walk THEN 0 ELSE ridden END AS INT) AS ridden, CAST(CASE WHEN j.walk THEN 0 ELSE blocked END AS INT) AS blocked FROM j LEFT JOIN every r ON r.request = j.request""", "journey, stop, travel_info")
    row, column = _column_row()
    walked = f"abs({row.format('z.s')} - {row.format('z.d')}) + abs({column.format('z.s')} - {column.format('z.d')}) + 1"
    numbered = "(SELECT row_number() OVER (ORDER BY c.fromStopId, c.toTravelInfoId) AS id, c.fromStopId, c.toTravelInfoId, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2 FROM combination c JOIN stop a ON a.id = c.fromStopId JOIN stop b ON b.id = c.toStopId WHERE c.fromStopId % 2 <> 0)"
    ORACLES["rte-14"] = fixtures.oracle(f"SELECT c.fromStopId, c.toTravelInfoId, c.fromStopId % 2 = 0 AS stored, CAST(CASE WHEN c.fromStopId % 2 = 0 THEN 2 ELSE {walked} END AS INT) AS points FROM combination c LEFT JOIN {numbered} n ON n.fromStopId = c.fromStopId AND n.toTravelInfoId = c.toTravelInfoId LEFT JOIN ({_leg_ends(numbered)}) z ON z.request = n.id LEFT JOIN street_vertex q ON FALSE")
    segments = ORACLES["win-03"]
    head, body = fixtures.oracle("SELECT 1 FROM way_node, way").removesuffix(" SELECT 1 FROM way_node, way"), segments[segments.index("SELECT wayId, lag(") :]
    ORACLES["etl-14"] = f"{head} SELECT n.wayId, CAST(sum((o.f <> 0)::INT + (o.b <> 0)::INT) AS BIGINT) AS edges, CAST(sum(o.f + o.b) AS BIGINT) AS permissions FROM ({body}) n JOIN ({_OPENWAY}) o ON o.id = n.wayId WHERE o.f <> 0 OR o.b <> 0 GROUP BY n.wayId"
    moved = fixtures.oracle("SELECT 1 FROM crossing, street_vertex").removesuffix(" SELECT 1 FROM crossing, street_vertex").replace("crossing AS (", "crossing0 AS (")
    ORACLES["rmp-04"] = f"{moved}, {_LINKED}, {_MOVED}"


_oracles()
