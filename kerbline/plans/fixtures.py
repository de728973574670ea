"""Geographic and transit relations derived from the given tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kerbline.operators.tables import dense_ids

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
DERIVED = {
    "street_vertex": """SELECT CAST(c_custkey + 1 AS BIGINT) AS id, CAST(-34.62 + CAST(FLOOR(c_custkey / 40) AS BIGINT) * 0.001 AS DOUBLE) AS lat,
        CAST(-58.42 + (c_custkey % 40) * 0.001 AS DOUBLE) AS lng FROM customer""",
    "street_edge": """SELECT s AS vertexStartId, e AS vertexEndId, CAST(10 AS DOUBLE) AS distance, CAST(s % 97 AS BIGINT) AS wayId FROM (
        SELECT a.id AS s, b.id AS e FROM street_vertex a JOIN street_vertex b ON b.id = a.id + 1 WHERE (a.id - 1) % 40 <> 39
        UNION ALL SELECT a.id, b.id FROM street_vertex a JOIN street_vertex b ON b.id = a.id + 40
        UNION ALL SELECT b.id, a.id FROM street_vertex a JOIN street_vertex b ON b.id = a.id + 1 WHERE (a.id - 1) % 40 <> 39
        UNION ALL SELECT b.id, a.id FROM street_vertex a JOIN street_vertex b ON b.id = a.id + 40) p""",
    "stop": """SELECT CAST(p_partkey + 1 AS BIGINT) AS id, CAST(p_partkey % 25 + 1 AS BIGINT) AS travelInfoId, CAST(FLOOR(p_partkey / 25) + 1 AS BIGINT) AS sequence,
        CAST(-34.62 + (p_partkey % 25) * 0.0015 + (CAST(FLOOR(p_partkey / 25) AS BIGINT) * 13 % 7) * 0.0001 AS DOUBLE) AS lat,
        CAST(-58.42 + CAST(FLOOR(p_partkey / 25) AS BIGINT) * 0.0005 AS DOUBLE) AS lng, p_size % 5 <> 0 AS isAccessible FROM part""",
    "travel_info": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CONCAT('Linea ', n_name) AS name, CONCAT('R', CAST(n_regionkey AS VARCHAR(10))) AS branch,
        CASE WHEN n_nationkey % 2 = 0 THEN 'Forward' ELSE 'Backward' END AS sentido, CASE WHEN n_regionkey = 0 THEN 'SUBWAY' ELSE 'BUS' END AS type FROM nation""",
    "ramp": """SELECT CAST(s_suppkey + 1 AS BIGINT) AS id, s_name AS address, CAST(-34.62 + (s_suppkey * 37 % 350) * 0.0001 AS DOUBLE) AS lat,
        CAST(-58.42 + (s_suppkey * 91 % 390) * 0.0001 AS DOUBLE) AS lng, s_suppkey % 4 <> 0 AS isAccessible FROM supplier""",
    "way_node": """SELECT l_orderkey AS wayId, CAST(l_partkey * 100 + l_suppkey % 100 AS BIGINT) AS nodeId,
        CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos FROM lineitem""",
    "way": """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'footway' WHEN 2 THEN 'construction' ELSE 'proposed' END AS highway,
        CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' END AS oneway, CASE o_orderkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'designated' END AS foot,
        CASE o_orderkey % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'license' WHEN 2 THEN 'private' END AS access, CASE o_orderkey % 6 WHEN 0 THEN 'use_sidepath' WHEN 1 THEN 'yes' WHEN 2 THEN 'dismount' WHEN 3 THEN 'no' END AS bicycle,
        CASE o_orderkey % 11 WHEN 0 THEN 'opposite_lane' WHEN 1 THEN 'dismount' END AS cycleway, CASE o_orderkey % 13 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS motorcar,
        CASE o_orderkey % 8 WHEN 0 THEN '1=first@12.5' WHEN 1 THEN '+2' WHEN 2 THEN 'roof@9' WHEN 3 THEN '-1' WHEN 4 THEN 'x' END AS level FROM orders""",
    "crossing": """SELECT CAST(ROW_NUMBER() OVER (ORDER BY vertexStartId, vertexEndId) AS BIGINT) AS id, vertexStartId, vertexEndId,
        CASE WHEN vertexStartId % 7 <> 0 THEN vertexStartId % 100 + 1 END AS rampStartId, CASE WHEN vertexEndId % 5 <> 0 THEN vertexEndId % 100 + 1 END AS rampEndId
        FROM street_edge WHERE vertexStartId % 3 = 0""",
    "sidewalk_edge": """SELECT CAST(ROW_NUMBER() OVER (ORDER BY vertexStartId, vertexEndId) AS BIGINT) AS id, vertexStartId, vertexEndId, CAST(vertexStartId % 2 AS INT) AS side,
        vertexStartId % 11 <> 0 AS isAccessible, wayId AS streetEdgeBelongToId FROM street_edge WHERE vertexStartId % 3 <> 0 AND vertexStartId < vertexEndId""",
    "street_info": """SELECT CAST(c_nationkey * 4 + c_custkey % 4 AS BIGINT) AS wayId, MIN(c_mktsegment) AS address FROM customer GROUP BY c_nationkey * 4 + c_custkey % 4""",
    "combination": """SELECT a.id AS fromStopId, a.travelInfoId AS fromTravelInfoId, b.travelInfoId AS toTravelInfoId, MIN(b.id) AS toStopId FROM stop a JOIN stop b
        ON b.sequence = a.sequence AND b.travelInfoId > a.travelInfoId AND b.travelInfoId <= a.travelInfoId + 2 GROUP BY a.id, a.travelInfoId, b.travelInfoId""",
    "shape": """SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 7 - 3 AS DOUBLE) AS x1, CAST(p_partkey % 5 - 2 AS DOUBLE) AS y1, CAST(p_partkey % 11 - 5 AS DOUBLE) AS x2,
        CAST(p_partkey % 9 - 4 AS DOUBLE) AS y2, CAST(p_partkey % 6 - 3 AS DOUBLE) AS x3, CAST(p_partkey % 8 - 4 AS DOUBLE) AS y3, CAST(p_partkey % 13 - 6 AS DOUBLE) AS x4, CAST(p_size % 10 - 5 AS DOUBLE) AS y4 FROM part""",
    "area_way": """SELECT CAST(c_custkey + 1 AS BIGINT) AS id, CASE c_custkey % 7 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'footway' WHEN 2 THEN 'proposed' END AS highway,
        CASE c_custkey % 5 WHEN 0 THEN 'parking' WHEN 1 THEN 'bicycle_parking' END AS amenity, CASE c_custkey % 9 WHEN 0 THEN 'no' WHEN 5 THEN 'yes' END AS park_ride,
        CASE c_custkey % 3 WHEN 0 THEN 'yes' END AS area, CASE c_custkey % 13 WHEN 0 THEN 'no' WHEN 1 THEN 'private' END AS access,
        CASE c_custkey % 8 WHEN 0 THEN '1=first@12.5' WHEN 1 THEN '+2' WHEN 2 THEN 'roof@9' WHEN 3 THEN '-1' WHEN 4 THEN 'x' END AS level,
        CASE c_custkey % 2 WHEN 1 THEN '1' END AS layer, CASE c_custkey % 11 WHEN 0 THEN c_name END AS name, CAST(CASE WHEN c_custkey % 10 = 9 THEN 4 ELSE 5 END AS INT) AS nodes FROM customer""",
    "area_node": """SELECT CAST(c_custkey + 1 AS BIGINT) AS wayId, CAST(pos AS BIGINT) AS pos, CAST((c_custkey + 1) * 10 + CASE WHEN pos = 5 THEN 1 ELSE pos END AS BIGINT) AS nodeId,
        CAST(-34.62 + CAST(FLOOR(c_custkey / 40) AS BIGINT) * 0.001 + dy * CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 8 = 0 THEN 0.0041 ELSE 0.0017 END WHEN 3 THEN 0.0002 ELSE 0.0003 END AS DOUBLE) AS lat,
        CAST(-58.42 + (c_custkey % 40) * 0.001 + dx * CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 8 = 0 THEN 0.0041 ELSE 0.0017 END WHEN 3 THEN 0.0002 ELSE 0.0003 END AS DOUBLE) AS lng,
        (c_custkey * 10 + pos) % 97 <> 0 AS known FROM customer JOIN (SELECT 1 AS pos, -1 AS dx, -1 AS dy UNION ALL SELECT 2, 1, -1 UNION ALL SELECT 3, 1, 1 UNION ALL SELECT 4, -1, 1 UNION ALL SELECT 5, -1, -1) corner
        ON c_custkey % 10 <> 9 OR pos < 5""",
    "area_member": """SELECT CAST(FLOOR(c_custkey / 4) + 1 AS BIGINT) AS relationId, CAST(c_custkey + 1 AS BIGINT) AS wayId, CASE c_custkey % 4 WHEN 3 THEN 'inner' ELSE 'outer' END AS role FROM customer
        UNION ALL SELECT CAST(FLOOR(c_custkey / 4) + 1 AS BIGINT), CAST(c_custkey + 1000000 AS BIGINT), 'outer' FROM customer WHERE c_custkey % 44 = 0""",
    "area_relation": """SELECT CAST(FLOOR(c_custkey / 4) + 1 AS BIGINT) AS id, CASE c_custkey % 20 WHEN 16 THEN 'restriction' WHEN 12 THEN 'route' WHEN 8 THEN CASE WHEN c_custkey % 40 = 8 THEN 'level_map' ELSE 'public_transport' END ELSE 'multipolygon' END AS type,
        CASE c_custkey % 3 WHEN 0 THEN 'road' END AS route, CASE c_custkey % 7 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'service' WHEN 2 THEN 'proposed' END AS highway, CASE c_custkey % 3 WHEN 1 THEN 'parking' END AS amenity,
        CASE c_custkey % 9 WHEN 4 THEN 'yes' END AS park_ride, CASE c_custkey % 5 WHEN 3 THEN 'stop_area' WHEN 4 THEN 'platform' END AS public_transport, CASE c_custkey % 17 WHEN 0 THEN 'no' END AS access, c_name AS name FROM customer WHERE c_custkey % 4 = 0""",
    "tagged": """SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 6 WHEN 0 THEN 'bus_stop' WHEN 1 THEN 'elevator' WHEN 2 THEN 'steps' WHEN 3 THEN 'residential' END AS highway,
        CASE p_partkey % 7 WHEN 0 THEN 'tram_stop' WHEN 1 THEN 'station' WHEN 2 THEN 'halt' WHEN 3 THEN 'rail' END AS railway,
        CASE p_partkey % 8 WHEN 0 THEN 'bus_station' WHEN 1 THEN 'bicycle_rental' WHEN 2 THEN 'parking' WHEN 3 THEN 'bicycle_parking' END AS amenity, CASE p_partkey % 5 WHEN 0 THEN 'bollard' WHEN 1 THEN 'gate' END AS barrier,
        CASE p_partkey % 9 WHEN 0 THEN 'roundabout' END AS junction, CASE p_partkey % 11 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'true' WHEN 3 THEN 'no' END AS oneway,
        CASE p_partkey % 13 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway_bicycle, CASE p_partkey % 10 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS bicycle_backwards,
        CASE p_partkey % 3 WHEN 0 THEN 'use_sidepath' END AS bicycle_forward, CASE p_partkey % 4 WHEN 0 THEN 'use_sidepath' WHEN 1 THEN 'yes' END AS bicycle_backward,
        CASE p_partkey % 12 WHEN 0 THEN 'opposite_lane' WHEN 1 THEN 'lane' END AS cycleway, CASE p_partkey % 14 WHEN 0 THEN 'opposite' END AS cycleway_left, CASE p_partkey % 15 WHEN 0 THEN 'opposite_track' END AS cycleway_right,
        CASE p_partkey % 16 WHEN 0 THEN 'yes' END AS area, CAST(p_size % 6 AS INT) AS nodes FROM part""",
    "zone_edge": """SELECT e.vertexStartId, e.vertexEndId, e.distance, e.wayId FROM street_edge e JOIN customer a ON a.c_custkey + 1 = e.vertexStartId
        JOIN customer b ON b.c_custkey + 1 = e.vertexEndId WHERE a.c_nationkey % 2 = b.c_nationkey % 2""",
    "oneway_edge": """SELECT vertexStartId, vertexEndId FROM zone_edge WHERE CASE WHEN vertexStartId < vertexEndId THEN vertexStartId % 4 <> 1 ELSE vertexEndId % 5 > 1 END""",
    "journey": """SELECT id AS request, lat AS lat1, lng AS lng1, CAST(lat + CASE id % 4 WHEN 0 THEN 0.0005 WHEN 1 THEN 0.002 WHEN 2 THEN 0.009 ELSE -0.012 END AS DOUBLE) AS lat2,
        CAST(lng + CASE id % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 0.012 WHEN 2 THEN 0.011 ELSE -0.013 END AS DOUBLE) AS lng2 FROM ramp""",
    "leg": """SELECT a.id, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2 FROM stop a JOIN stop b ON b.id = a.id + 26 + a.id % 3""",
}


_NUMBERED = "CAST(ROW_NUMBER() OVER (ORDER BY vertexStartId, vertexEndId) AS BIGINT) AS id, "


def _needs(sql: str) -> list[str]:
    return [x for x in DERIVED if re.search(rf"\b{x}\b", sql)]


def oracle(sql: str) -> str:
    """sql with the derived relations that it names, each before those that use it."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _needs(DERIVED[name]):
            if x != name and x not in order:
                add(x)
        if name not in order:
            order.append(name)

    for name in _needs(sql):
        add(name)
    return "WITH " + ", ".join(f"{x} AS ({DERIVED[x]})" for x in order) + " " + sql if order else sql


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or given relation as a DataFrame. Rows that SQL numbers over the whole relation are numbered by ranges here."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    if _NUMBERED in sql:
        rows = _spark_sql(spark, sf_dir, name, sql.replace(_NUMBERED, ""))
        return dense_ids(rows, ["vertexStartId", "vertexEndId"]).select("id", *rows.columns)
    return _spark_sql(spark, sf_dir, name, sql)


def _spark_sql(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    used = [x for x in (*BASE, *DERIVED) if x != name and re.search(rf"(?:FROM|JOIN) {x}\b", sql)]
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql)
    return spark.sql(text, **{x: relation(spark, sf_dir, x) for x in used})
