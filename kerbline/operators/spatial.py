"""Filters and joins by place: radius, rectangle, nearest, within-distance and neighbour joins.

All are DataFrame plans. Searches around given points keep their constants as literals, so that the box reaches the scan as pushed-down
comparisons. Joins of two large sides by distance meet in grid cells by equality, never as a cross join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.operators.lineage import checkpoint
from kerbline.operators.overlay import curve
from kerbline.operators.tables import dense_ids


def in_radius(at_lat: float, at_lng: float, km: float, lat="lat", lng="lng", use_box: bool = True, mode: str = "planar") -> Column:
    """Whether a point lies within km of a constant one: box and planar radian distance, or (mode="haversine") great-circle distance."""
    lat, lng = G._c(lat), G._c(lng)
    if mode == "haversine":
        return G.haversine_km(lat, lng, at_lat, at_lng) <= km
    near = G.planar_radians(lat, lng, at_lat, at_lng) <= km / G.EARTH_KM
    if not use_box:
        return near
    south, west, north, east, crosses = G.box_of(at_lat, at_lng, km)
    across = (lng >= west) | (lng <= east) if crosses else lng.between(west, east)
    return lat.between(south, north) & across & near


def in_rectangle(north: float, east: float, south: float, west: float, lat="lat", lng="lng") -> Column:
    return G._c(lat).between(south, north) & G._c(lng).between(west, east)


def checked_radius(km: float, most: float) -> float:
    if not 0 <= km <= most:
        raise ValueError(f"a radius of {km} km; the most is {most}")
    return km


def nearest(points: DataFrame, at_lat: float, at_lng: float, mode: str = "planar", n: int = 1) -> DataFrame:
    """The n nearest points (id, lat, lng, ...), ties by id. Spark keeps n rows a task: no full sort."""
    d = G.planar_radians("lat", "lng", at_lat, at_lng) if mode == "planar" else G.haversine_km("lat", "lng", at_lat, at_lng)
    return points.withColumn("distance", d).orderBy(F.round("distance", 9), "id").limit(n)


def with_endpoints(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges (vertexStartId, vertexEndId, ...) with start_lat, start_lng, end_lat, end_lng of vertices (id, lat, lng)."""
    end = lambda key, name: vertices.select(F.col("id").alias(key), F.col("lat").alias(f"{name}_lat"), F.col("lng").alias(f"{name}_lng"))
    return edges.join(end("vertexStartId", "start"), "vertexStartId").join(end("vertexEndId", "end"), "vertexEndId")


def edges_near(edges: DataFrame, vertices: DataFrame, at_lat: float, at_lng: float, km: float, mode: str = "planar") -> DataFrame:
    """Edges whose start (planar), or either end (haversine), lies within the radius. The few near vertices are found before the join."""
    near = vertices.where(in_radius(at_lat, at_lng, km, mode=mode)).select(F.col("id").alias("near"))
    if mode == "planar":
        return edges.join(near, edges["vertexStartId"] == near["near"], "left_semi")
    ends = edges.withColumn("near", F.explode(F.array_distinct(F.array("vertexStartId", "vertexEndId"))))
    return ends.join(near, "near", "left_semi").drop("near").dropDuplicates(["vertexStartId", "vertexEndId"])


def edges_in_rectangle(edges: DataFrame, vertices: DataFrame, north: float, east: float, south: float, west: float) -> DataFrame:
    """Edges of which either end lies in the rectangle."""
    inside = vertices.where(in_rectangle(north, east, south, west)).select(F.col("id").alias("near"))
    ends = edges.withColumn("near", F.explode(F.array_distinct(F.array("vertexStartId", "vertexEndId"))))
    return ends.join(inside, "near", "left_semi").drop("near").distinct()


def within_distance(left: DataFrame, right: DataFrame, km: float, mode: str = "planar") -> DataFrame:
    """Pairs of left (id, lat, lng, ...) and right rows at most km apart: columns l and r (structs) and distance.

    Rows meet by equality in grid cells as wide as the distance, left rows in their own cell and right rows in the nine around theirs. In planar mode both
    axes are radians and the plane ends where longitudes do. In haversine mode the cells lie on the sphere: a band of latitude has as many columns as are
    wide enough at its end nearer to a pole, they close to a ring across the antimeridian, and the bands about a pole are one cell each. A
    crowded cell is split by Spark as a skewed join. Both sides are dealt out by cell: Spark's estimate of a side knows neither the nine cells of a row nor how
    well its files are packed, and a broadcast by it holds millions of rows in the driver.
    """
    angle = km / G.EARTH_KM
    size = math.degrees(angle) * 1.000001
    row = lambda lat: F.floor(lat / size).cast("long")
    if mode == "planar":
        around = lambda r, lng: (c := F.floor(lng / size).cast("long"), [c - 1, c, c + 1])
        distance, most = G.planar_radians("l.lat", "l.lng", "r.lat", "r.lng"), angle
    else:
        distance, most = G.haversine_km("l.lat", "l.lng", "r.lat", "r.lng"), km

        def around(r: Column, lng: Column) -> tuple[Column, list[Column]]:
            edge = F.radians(F.greatest(F.abs(r * size), F.abs((r + 1) * size)))  # the most that a latitude of the band can be
            widest = F.asin(F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(edge)) * 1.000001
            columns = F.when(edge + angle * 1.000001 < math.pi / 2, F.greatest(F.floor(2 * math.pi / widest), F.lit(1))).otherwise(1).cast("long")
            c = F.least(F.floor(F.pmod(lng.cast("double"), F.lit(360.0)) / 360 * columns).cast("long"), columns - 1)
            return c, [F.pmod(c + i, columns) for i in (-1, 0, 1)]

    l = left.select(F.struct(*left.columns).alias("l")).withColumn("cell_row", row(F.col("l.lat")))
    l = l.withColumn("cell_column", around(F.col("cell_row"), F.col("l.lng"))[0])
    r = right.select(F.struct(*right.columns).alias("r"), F.explode(F.array(*[row(F.col("lat")) + i for i in (-1, 0, 1)])).alias("cell_row"))
    r = r.withColumn("cell_column", F.explode(F.array_distinct(F.array(*around(F.col("cell_row"), F.col("r.lng"))[1]))))
    return l.join(r.hint("merge"), ["cell_row", "cell_column"]).withColumn("distance", distance).where(F.col("distance") <= most).select("l", "r", "distance")


#: Places that a cell of the tree below holds, and cells that one of the next level holds.
HELD = 16


def nearest_each(points: DataFrame, targets: DataFrame, km: float | None = None) -> DataFrame:
    """For each point the nearest target, ties by id: (id, nearest, distance); with km only those within it.

    With km by the grid join. Without, however far the nearest target is: targets in the order of a space-filling curve are cut into cells of HELD, those into cells
    of HELD cells, up to one. A cell knows one of its targets and how far the others are from it at most, which bounds the distance of its nearest from both
    sides. Each point descends from the top into those cells alone whose lower bound is not above its least upper bound; rounds are a logarithm of the
    targets. Points and targets without a place take no part; no targets, no rows.
    """
    best = lambda d, i: F.min(F.struct(F.round(d, 9).alias("d"), F.col(i).alias("id"))).alias("b")
    if km is not None:
        pairs = within_distance(points, targets, km, "haversine")
        return pairs.groupBy(F.col("l.id").alias("id")).agg(best("distance", "r.id"), F.min("distance").alias("distance")).select("id", F.col("b.id").alias("nearest"), "distance")
    # the farthest target is half a great circle away
    placed = lambda df: df.select("id", "lat", "lng").where("id is not null and lat is not null and lng is not null")
    ranked = dense_ids(placed(targets).withColumn("key", curve("lat", "lng")), ["key", "id", "lat", "lng"], "z")
    cells, levels = ranked.select(F.col("z") - 1, "id", "lat", "lng", F.lit(0.0)).toDF("cell", "id", "lat", "lng", "radius"), []
    while True:
        one = F.struct("cell", "lat", "lng", "radius", "id")
        made = cells.groupBy(F.floor(F.col("cell") / HELD).cast("long").alias("cell")).agg(F.sort_array(F.collect_list(one)).alias("held"))
        middle = F.element_at("held", F.floor((F.size("held") + 1) / 2).cast("int"))  # from the middle of the run the others are nearer
        reach = F.array_max(F.transform("held", lambda x: G.haversine_km(x["lat"], x["lng"], middle["lat"], middle["lng"]) + x["radius"]))
        made = checkpoint(made.select("cell", "held", middle["lat"].alias("lat"), middle["lng"].alias("lng"), reach.alias("radius"), F.lit(None).cast("long").alias("id")))
        levels.append(made)
        n = made.count()
        if n <= 1:
            break
        cells = made
    open_ = placed(points).distinct().select(F.struct("id", "lat", "lng").alias("p"), F.lit(0).cast("long").alias("cell"))
    for k in range(len(levels) - 1, -1, -1):
        held = levels[k].select("cell", "held")
        # the top is one row, the next level HELD at most
        found = open_.join(F.broadcast(held) if k >= len(levels) - 2 else held, "cell").select("p", F.explode("held").alias("h"))
        found = found.withColumn("d", G.haversine_km("p.lat", "p.lng", "h.lat", "h.lng"))
        if k:
            least = F.min("d").over(Window.partitionBy("p"))
            found = found.withColumn("least", least).where(F.col("d") - F.col("h.radius") <= F.col("least") + 1e-7)
            # what is written anew each level keeps Spark's size estimates true
            open_ = checkpoint(found.select("p", F.col("h.cell").alias("cell")))
    return found.groupBy("p").agg(best("d", "h.id"), F.min("d").alias("distance")).groupBy(F.col("p.id").alias("id")).agg(F.min(F.struct("b", "distance")).alias("x")).select("id", F.col("x.b.id").alias("nearest"), "x.distance")


# Joins along the graph's tables.


def ramps_with_crossings(ramps: DataFrame, crossings: DataFrame) -> DataFrame:
    """(ramp columns, crossing) for every crossing that a ramp serves at either end; once if it serves both ends of one."""
    ends = crossings.select(F.col("id").alias("crossing"), F.explode(F.array_distinct(F.array_compact(F.array("rampStartId", "rampEndId")))).alias("ramp"))
    return ramps.join(ends, ramps["id"] == ends["ramp"]).drop("ramp")


def free_ramps(ramps: DataFrame, crossings: DataFrame) -> DataFrame:
    used = crossings.select(F.explode(F.array_compact(F.array("rampStartId", "rampEndId"))).alias("id"))
    return ramps.join(used, "id", "left_anti")


def street_neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour) over edges in both directions."""
    return edges.select(F.col("vertexStartId").alias("id"), F.col("vertexEndId").alias("neighbour")).union(edges.select("vertexEndId", "vertexStartId")).distinct()


def sidewalk_neighbours(sidewalks: DataFrame, crossings: DataFrame, ramps: DataFrame, accessible_only: bool = True) -> DataFrame:
    """(id, neighbour): along sidewalks and over crossings, both ways; if accessible_only, over accessible edges and between two accessible ramps."""
    if accessible_only:
        sidewalks = sidewalks.where("isAccessible")
        good = ramps.where("isAccessible").select("id")
        crossings = crossings.join(good.withColumnRenamed("id", "rampStartId"), "rampStartId", "left_semi").join(good.withColumnRenamed("id", "rampEndId"), "rampEndId", "left_semi")
    ends = ["vertexStartId", "vertexEndId"]
    return street_neighbours(sidewalks.select(*ends).unionByName(crossings.select(*ends)))
