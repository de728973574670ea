"""Queries of the scalar geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.plans.base import HALF, PI, angular, km, planar, query, r6, s6

_LEG = ("lat1", "lng1", "lat2", "lng2")
_V, _W = ("x1", "y1", "x2", "y2"), ("x3", "y3", "x4", "y4")
_D = f"({{}} / 6371.0)"
_MOVED = "sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"


@query("geo-01", f"SELECT id, {s6(km(*_LEG))} AS km FROM leg")
def geo_01(t):
    return t("leg").select("id", r6(G.haversine_km(*_LEG)).alias("km"))


@query("geo-02", f"SELECT id, {s6('degrees(' + angular(*_LEG) + ')')} AS angle FROM leg")
def geo_02(t):
    return t("leg").select("id", r6(G.angular_degrees(*_LEG)).alias("angle"))


_BOX = "radians(lat1) {} 0.5 / 6371.0"
_SIDE = "asin(sin(0.5 / 6371.0) / cos(radians(lat1)))"


@query("geo-03", f"SELECT id, {s6('degrees(radians(lat1) - 0.5 / 6371.0)')} AS min_lat, {s6(f'degrees(radians(lng1) - {_SIDE})')} AS min_lng, {s6('degrees(radians(lat1) + 0.5 / 6371.0)')} AS max_lat, {s6(f'degrees(radians(lng1) + {_SIDE})')} AS max_lng FROM leg")
def geo_03(t):
    box = t("leg").select("id", G.bounding_box("lat1", "lng1", 0.5).alias("b"))
    return box.select("id", *[r6(F.col(f"b.{c}")).alias(c) for c in ("min_lat", "min_lng", "max_lat", "max_lng")])


@query("geo-04", "SELECT id, id % 361 + 179.999 > 360 OR (id % 361 - 180) * 1.0 > 179.99 AS near_end, abs(id % 361 - 180) > 178 AS crosses FROM stop")
def geo_04(t):
    box = G.bounding_box(F.lit(0.0), (F.col("id") % 361 - 180).cast("double"), 200.0)
    return t("stop").select("id", ((F.col("id") % 361 + 179.999 > 360) | ((F.col("id") % 361 - 180) * 1.0 > 179.99)).alias("near_end"), box["crosses"].alias("crosses"))


_DY, _DX = "(lat2 - lat1)", "(lng2 - lng1)"


@query("geo-05", f"""SELECT id, {s6(f'CASE WHEN {_DX} = 0 AND {_DY} = 0 THEN 0 WHEN {_DX} = 0 THEN CASE WHEN {_DY} > 0 THEN {HALF} ELSE 3 * {HALF} END WHEN {_DY} = 0 THEN CASE WHEN {_DX} > 0 THEN 0 ELSE {PI} END ELSE atan(abs({_DY}) / abs({_DX})) + CASE WHEN {_DY} < 0 AND {_DX} < 0 THEN {PI} WHEN {_DY} < 0 THEN 3 * {HALF} WHEN {_DX} < 0 THEN {HALF} ELSE 0 END END')} AS parity,
    {s6(f'CASE WHEN {_DX} = 0 AND {_DY} = 0 THEN 0 ELSE atan2({_DY}, {_DX}) + CASE WHEN atan2({_DY}, {_DX}) < 0 THEN 2 * {PI} ELSE 0 END END')} AS angle FROM leg""")
def geo_05(t):
    return t("leg").select("id", r6(G.angle_to(*_LEG, exact=False)).alias("parity"), r6(G.angle_to(*_LEG)).alias("angle"))


_Y2 = "asin(sin(radians(lat1)) * cos(2 / 6371.0) + cos(radians(lat1)) * sin(2 / 6371.0) * cos(radians(id % 360)))"


@query("geo-06", f"SELECT id, {s6(f'degrees({_Y2})')} AS lat, {s6(f'degrees(radians(lng1) + atan2(sin(radians(id % 360)) * sin(2 / 6371.0) * cos(radians(lat1)), cos(2 / 6371.0) - sin(radians(lat1)) * sin({_Y2})))')} AS lng FROM leg")
def geo_06(t):
    to = t("leg").select("id", G.destination("lat1", "lng1", F.col("id") % 360, 2.0).alias("p"))
    return to.select("id", r6(F.col("p.lat")).alias("lat"), r6(F.col("p.lng")).alias("lng"))


@query("geo-07", f"SELECT id, {s6('radians(lat)')} AS rad_lat, {s6('degrees(radians(lng))')} AS deg_lng, lng AS x, lat AS y FROM stop")
def geo_07(t):
    return t("stop").select("id", r6(F.radians("lat")).alias("rad_lat"), r6(F.degrees(F.radians("lng"))).alias("deg_lng"), F.col("lng").alias("x"), F.col("lat").alias("y"))


@query("geo-08", f"SELECT id, {s6(planar(*_LEG) + ' * 1000')} AS distance FROM leg")
def geo_08(t):
    return t("leg").select("id", r6(G.planar_radians(*_LEG) * 1000).alias("distance"))


@query("geo-09", f"SELECT id, {s6(_MOVED)} AS distance, x1 * 3 AS tripled_x, y1 * 3 AS tripled_y FROM shape")
def geo_09(t):
    return t("shape").select("id", r6(G.distance(*_V)).alias("distance"), (F.col("x1") * 3).alias("tripled_x"), (F.col("y1") * 3).alias("tripled_y"))


_A2, _B2, _C2 = "(pow(x2-x1,2)+pow(y2-y1,2))", "(pow(x3-x1,2)+pow(y3-y1,2))", "(pow(x3-x2,2)+pow(y3-y2,2))"


@query("geo-10", f"SELECT id, {s6(f'acos(greatest(least(({_A2} + {_B2} - {_C2}) / (2 * sqrt({_A2}) * sqrt({_B2})), 1), -1))')} AS angle FROM shape WHERE {_A2} > 0 AND {_B2} > 0")
def geo_10(t):
    angle = G.angle_at("x1", "y1", "x2", "y2", "x3", "y3")
    return t("shape").select("id", r6(angle).alias("angle")).where("angle is not null")


_ANG = "atan2(y2 - y1, x2 - x1)"


@query("geo-11", f"SELECT id, {s6(_MOVED)} AS magnitude, {s6(_ANG)} AS angle, {s6(f'CASE WHEN {_ANG} < 0 THEN {_ANG} + 2 * {PI} ELSE {_ANG} END')} AS positive FROM shape")
def geo_11(t):
    return t("shape").select("id", r6(G.distance(*_V)).alias("magnitude"), r6(G.vector_angle(*_V)).alias("angle"), r6(G.positive_angle(*_V)).alias("positive"))


@query("geo-12", f"SELECT id, CASE WHEN {_ANG} > {HALF} THEN 2 WHEN {_ANG} >= 0 THEN 1 WHEN {_ANG} < -{HALF} THEN 3 ELSE 4 END AS quadrant FROM shape")
def geo_12(t):
    return t("shape").select("id", G.quadrant(G.vector_angle(*_V)).alias("quadrant"))


@query("geo-13", """SELECT id, CASE WHEN abs(x1 - x2) < 1e-10 THEN abs(x3 - x1) < 1e-10 ELSE (y1 - y2) / (x1 - x2) * x3 + (y1 - (y1 - y2) / (x1 - x2) * x1) = y3 END
    AND x3 >= least(x1, x2) - 1e-10 AND x3 <= greatest(x1, x2) + 1e-10 AND y3 >= least(y1, y2) - 1e-10 AND y3 <= greatest(y1, y2) + 1e-10 AS holds FROM shape""")
def geo_13(t):
    return t("shape").select("id", G.vector_holds(*_V, "x3", "y3").alias("holds"))


@query("geo-14", "SELECT id, x1 + 2 AS px, y1 - 1 AS py, x2 + 2 AS qx, y2 - 1 AS qy, x2 AS ix, y2 AS iy FROM shape")
def geo_14(t):
    c = F.col
    return t("shape").select("id", (c("x1") + 2).alias("px"), (c("y1") - 1).alias("py"), (c("x2") + 2).alias("qx"), (c("y2") - 1).alias("qy"), c("x2").alias("ix"), c("y2").alias("iy"))


@query("geo-15", f"SELECT id, {s6(f'x1 - sin({_ANG})')} AS ax, {s6(f'y1 + cos({_ANG})')} AS ay, {s6(f'x2 + sin({_ANG})')} AS cx, {s6(f'y2 - cos({_ANG})')} AS cy FROM shape WHERE x1 <> x2 OR y1 <> y2")
def geo_15(t):
    both = t("shape").where("x1 <> x2 or y1 <> y2").select("id", G.parallel_vector(*_V, 1.0, True).alias("a"), G.parallel_vector(*_V, 1.0, False).alias("c"))
    return both.select("id", r6(F.col("a.x1")).alias("ax"), r6(F.col("a.y1")).alias("ay"), r6(F.col("c.x2")).alias("cx"), r6(F.col("c.y2")).alias("cy"))


_S1, _S2 = "((y1 - y2) / (x1 - x2))", "((y3 - y4) / (x3 - x4))"
_MX = f"((y3 - {_S2} * x3) - (y1 - {_S1} * x1)) / ({_S1} - {_S2})"


@query("geo-16", f"""SELECT id, {s6(f'CASE WHEN (x1 = x3 AND y1 = y3) OR (x1 = x4 AND y1 = y4) THEN x1 WHEN (x2 = x3 AND y2 = y3) OR (x2 = x4 AND y2 = y4) THEN x2 ELSE {_MX} END')} AS x
    FROM shape WHERE x1 <> x2 AND x3 <> x4 AND abs({_S1} - {_S2}) >= 1e-10""")
def geo_16(t):
    met = t("shape").where("x1 <> x2 and x3 <> x4").select("id", G.vectors_meet(list(_V), list(_W)).alias("p"), G.parallel(G.line(*_V), G.line(*_W)).alias("par"))
    return met.where("not par").select("id", r6(F.col("p.x")).alias("x"))


@query("geo-17", f"SELECT id, {s6(f'CASE WHEN atan2(y4 - y3, x4 - x3) - {_ANG} < 0 THEN atan2(y4 - y3, x4 - x3) - {_ANG} + 2 * {PI} ELSE atan2(y4 - y3, x4 - x3) - {_ANG} END')} AS turn FROM shape WHERE (x1 <> x2 OR y1 <> y2) AND (x3 <> x4 OR y3 <> y4)")
def geo_17(t):
    return t("shape").where("(x1 <> x2 or y1 <> y2) and (x3 <> x4 or y3 <> y4)").select("id", r6(G.anticlockwise_between(G.vector_angle(*_V), G.vector_angle(*_W))).alias("turn"))


@query("geo-18", f"SELECT id, {s6(f'x1 + (x2 - x1) / {_MOVED} * 2.5')} AS x, {s6(f'y1 - (y2 - y1) / {_MOVED} * 2.5')} AS behind_y FROM shape WHERE {_MOVED} > 0")
def geo_18(t):
    at = t("shape").select("id", G.point_along(*_V, 2.5).alias("p"), G.point_along(*_V, -2.5).alias("q"))
    return at.where("p.x is not null").select("id", r6(F.col("p.x")).alias("x"), r6(F.col("q.y")).alias("behind_y"))


_L = "CASE WHEN x1 <> x2 THEN {} END"


@query("geo-19", f"SELECT id, x1 = x2 AS vertical, {s6(_L.format(_S1))} AS slope, {s6(_L.format(f'y1 - {_S1} * x1'))} AS intercept FROM shape")
def geo_19(t):
    return t("shape").select("id", G.line(*_V).alias("l")).select("id", "l.vertical", r6(F.col("l.slope")).alias("slope"), r6(F.col("l.intercept")).alias("intercept"))


@query("geo-20", f"SELECT id, {s6(_L.format(f'{_S1} * x3 + (y1 - {_S1} * x1)'))} AS at_x, CASE WHEN x1 = x2 THEN abs(x1 - x3) < 1e-10 ELSE {_S1} * x3 + (y1 - {_S1} * x1) = y3 END AS defined FROM shape")
def geo_20(t):
    rows = t("shape").withColumn("l", G.line(*_V))
    return rows.select("id", r6(G.line_at(F.col("l"), "x3")).alias("at_x"), G.on_line(F.col("l"), "x3", "y3").alias("defined"))


@query("geo-21", f"""SELECT id, {s6(f'CASE WHEN x1 = x2 THEN x1 WHEN x3 = x4 THEN x3 ELSE {_MX} END')} AS x, {s6(f'CASE WHEN x1 = x2 THEN {_S2} * x1 + (y3 - {_S2} * x3) WHEN x3 = x4 THEN {_S1} * x3 + (y1 - {_S1} * x1) ELSE {_S1} * ({_MX}) + (y1 - {_S1} * x1) END')} AS y
    FROM shape WHERE NOT (x1 = x2 AND x3 = x4) AND (x1 = x2 OR x3 = x4 OR abs({_S1} - {_S2}) >= 1e-10)""")
def geo_21(t):
    met = t("shape").select("id", G.intersection(G.line(*_V), G.line(*_W)).alias("p"), G.line(*_V)["vertical"].alias("v"), G.line(*_W)["vertical"].alias("w"))
    return met.where("p is not null and not (v and w)").select("id", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@query("geo-22", f"""SELECT id, y1 = y2 AS vertical, {s6(f'CASE WHEN y1 <> y2 THEN -1 / {_S1} END')} AS slope, {s6(f'CASE WHEN y1 <> y2 THEN {_S1} * x3 + (y1 - {_S1} * x1) + x3 / {_S1} END')} AS intercept FROM shape WHERE x1 <> x2""")
def geo_22(t):
    rows = t("shape").select("id", G.perpendicular(G.line(*_V), "x3").alias("p")).where("p is not null")
    return rows.select("id", "p.vertical", r6(F.col("p.slope")).alias("slope"), r6(F.col("p.intercept")).alias("intercept"))


@query("geo-23", f"SELECT id, {s6(_L.format(f'y1 - {_S1} * x1 + 2'))} AS above, {s6(_L.format(f'y1 - {_S1} * x1 - 2'))} AS below, CASE WHEN x1 = x2 THEN x1 - 2 END AS west FROM shape")
def geo_23(t):
    rows = t("shape").select("id", G.moved_line(G.line(*_V), 2.0, True).alias("a"), G.moved_line(G.line(*_V), 2.0, False).alias("b"))
    return rows.select("id", r6(F.col("a.intercept")).alias("above"), r6(F.col("b.intercept")).alias("below"), F.col("a.x").alias("west"))


@query("geo-24", f"SELECT id, CASE WHEN x1 = x2 OR x3 = x4 THEN x1 = x2 AND x3 = x4 ELSE abs({_S1} - {_S2}) < 1e-10 END AS parallel FROM shape")
def geo_24(t):
    return t("shape").select("id", G.parallel(G.line(*_V), G.line(*_W)).alias("parallel"))


@query("geo-25", f"""SELECT id, CAST(CASE WHEN x1 = x2 THEN sign(x1 - x3) ELSE sign((y1 - {_S1} * x1) - (y3 - {_S2} * x3)) END AS INT) AS altitude FROM shape
    WHERE CASE WHEN x1 = x2 OR x3 = x4 THEN x1 = x2 AND x3 = x4 ELSE abs({_S1} - {_S2}) < 1e-10 END""")
def geo_25(t):
    return t("shape").select("id", G.compare_parallels(G.line(*_V), G.line(*_W)).alias("altitude")).where("altitude is not null")


@query("geo-26", f"SELECT id, CASE WHEN CASE WHEN x1 = x2 THEN x1 - (x1 - 1) ELSE (y1 - {_S1} * x1) - (y1 - {_S1} * x1 + (id % 3 - 1)) END > 0 THEN 'South' ELSE 'North' END AS side FROM shape")
def geo_26(t):
    line = G.line(*_V)
    moved = F.when(line["vertical"], G.moved_line(line, 1.0, True)).otherwise(G.moved_line(line, F.col("id") % 3 - 1, True))
    return t("shape").select("id", F.when(G.compare_parallels(line, moved) == 1, "South").otherwise("North").alias("side"))


_RING = [(-34.62, -58.42), (-34.60, -58.42), (-34.605, -58.41), (-34.60, -58.40), (-34.62, -58.40)]
_CROSS = " + ".join(f"CASE WHEN ({a[0]} > lat) <> ({b[0]} > lat) AND lng < ({b[1]} - ({a[1]})) * (lat - ({a[0]})) / ({b[0]} - ({a[0]})) + ({a[1]}) THEN 1 ELSE 0 END" for a, b in zip(_RING, [_RING[-1], *_RING[:-1]], strict=True) if a[0] != b[0]).replace("> lat", "::DOUBLE > lat")


def _ring():
    return F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in _RING])


@query("geo-27", f"SELECT id, ({_CROSS}) % 2 = 1 AS inside FROM stop")
def geo_27(t):
    return t("stop").select("id", G.in_polygon("lat", "lng", _ring()).alias("inside"))


@query("geo-28", f"SELECT travelInfoId, bool_and(({_CROSS}) % 2 = 1) AS inside FROM stop GROUP BY travelInfoId")
def geo_28(t):
    shapes = t("stop").groupBy("travelInfoId").agg(F.collect_list(F.struct("lat", "lng")).alias("ring"))
    return shapes.select("travelInfoId", G.polygon_in_polygon(F.col("ring"), _ring()).alias("inside"))


@query("geo-29", "SELECT id, abs(x1 - x3) < 1e-10 AS same, x1 > x3 OR abs(x1 - x3) < 1e-10 AS at_least, x1 < x3 OR abs(x1 - x3) < 1e-10 AS at_most FROM shape")
def geo_29(t):
    return t("shape").select("id", G.near("x1", "x3").alias("same"), G.at_least("x1", "x3").alias("at_least"), G.at_most("x1", "x3").alias("at_most"))


@query("geo-30", "SELECT id, printf('%1.2f', lat * 1.2345678) AS lat FROM stop")
def geo_30(t):
    return t("stop").select("id", G.readable(F.col("lat") * 1.2345678).alias("lat"))


@query("geo-31", f"""SELECT e.vertexStartId, e.vertexEndId, a.lng AS x1, a.lat AS y1, b.lng AS x2, b.lat AS y2, abs(a.lng - b.lng) < 1e-10 AS vertical
    FROM street_edge e JOIN street_vertex a ON a.id = e.vertexStartId JOIN street_vertex b ON b.id = e.vertexEndId""")
def geo_31(t):
    from kerbline.operators.spatial import with_endpoints

    rows = with_endpoints(t("street_edge"), t("street_vertex"))
    v = rows.select("vertexStartId", "vertexEndId", F.col("start_lng").alias("x1"), F.col("start_lat").alias("y1"), F.col("end_lng").alias("x2"), F.col("end_lat").alias("y2"))
    return v.withColumn("vertical", G.line(*_V)["vertical"])


@query("geo-32", """SELECT id, ((id - 1) // 13) * 3 + 1 AS top, ((id - 1) % 13) * 3 + 1 AS "left", ((id - 1) // 13 + 1) * 3 + 1 AS bottom, ((id - 1) % 13 + 1) * 3 + 1 AS "right" FROM stop""")
def geo_32(t):
    return t("stop").select("id", G.cell_bounds("id", 40, 3).alias("b")).select("id", "b.top", "b.left", "b.bottom", "b.right")


@query("geo-33", "SELECT id, CAST((id % 8) | 2 AS BIGINT) AS added, CAST((id % 8) & ~6 AS BIGINT) AS removed, CAST((id % 8) & (id % 5) AS BIGINT) AS common, (id % 8) & 4 <> 0 AS allows_car, id % 8 <> 0 AS allows_any FROM stop")
def geo_33(t):
    from kerbline.functions import tags as T

    p = F.col("id") % 8
    return t("stop").select("id", T.add(p, T.BICYCLE).alias("added"), T.remove(p, T.BICYCLE | T.CAR).alias("removed"), p.bitwiseAND(F.col("id") % 5).alias("common"), T.allows(p, T.CAR).alias("allows_car"), (p != T.NONE).alias("allows_any"))


@query("geo-34", """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 16 ELSE 0 END AS INT) AS mask, o_orderkey % 5 = 0 AS transit FROM orders""")
def geo_34(t):
    from kerbline.functions import tags as T

    k = F.col("o_orderkey")
    names = F.concat_ws(",", F.when(k % 2 == 0, "WALK"), F.when(k % 3 == 0, "BICYCLE"), F.when(k % 5 == 0, "BUS"))
    mask = T.mode_mask(names)
    return t("orders").select(k.alias("id"), mask.alias("mask"), T.is_transit(mask).alias("transit"))
