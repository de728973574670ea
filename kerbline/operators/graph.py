"""Graph operators over edge tables: neighbours, reachability, components and shortest paths.

Loops are driven by small counts; state lives in DataFrames whose lineage is cut in the shared checkpoint folder. Components take a logarithm of
rounds, paths and reachability a few per level of an overlay, reachability within a number of hops a round per block of vertices, distances a round per hop.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.operators import overlay
from kerbline.operators.lineage import checkpoint


def reachable(edges: DataFrame, start: int, src: str = "vertexStartId", dst: str = "vertexEndId", most: int | None = None) -> DataFrame:
    """(id, hops) of all vertices that directed edges reach from start, itself included, by the fewest edges; with most, of those that so many edges reach.

    Without most the search goes over an overlay of blocks (operators/overlay.py), a few rounds for any graph. With it only the blocks around start are
    searched, in rounds from block to block."""
    near = edges.select(F.col(src).alias("vertexStartId"), F.col(dst).alias("vertexEndId"), F.lit(1).cast("long").alias("c")).where("vertexStartId <> vertexEndId")
    session = edges.sparkSession
    if most is not None:
        asked = session.createDataFrame([(0, start, [], most)], "request long, start long, targets array<long>, limit long")
        return _searched(_blocked(near.select(F.col("vertexStartId").alias("s"), F.col("vertexEndId").alias("d"), "c")), asked).select("id", F.col("cost").cast("int").alias("hops"))
    found = overlay.spread(overlay.build(near, overlay.BLOCK), start).select("id", F.col("cost").cast("int").alias("hops"))
    alone = session.createDataFrame([(start, 0)], "id long, hops int")
    return found.unionByName(alone).groupBy("id").agg(F.min("hops").alias("hops"))


def components(edges: DataFrame, src: str = "vertexStartId", dst: str = "vertexEndId") -> DataFrame:
    """(node, root): each vertex of an edge with the least vertex of its undirected component; large-star and small-star rounds."""
    links = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node")).distinct()
    links, last = checkpoint(links), None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        links = checkpoint(small.select("x.*").where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())
    return found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))


def largest_component(edges: DataFrame, strong: bool = False) -> DataFrame:
    """The vertices (node) of the component of most vertices, the one of the least root among equals; if strong, of the strong component of most: whoever stands
    on one of them gets to all others and back."""
    found = checkpoint(overlay.strong_components(edges)) if strong else components(edges)
    top = found.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
    return found.join(F.broadcast(top), "root", "left_semi").select("node")  # one row


def purge(edges: DataFrame, strong: bool = False) -> DataFrame:
    """Only the edges within the largest component; if strong, also without streets that only lead away from it or into it."""
    kept = checkpoint(largest_component(edges, strong))
    return edges.join(kept.withColumnRenamed("node", "vertexStartId"), "vertexStartId", "left_semi").join(kept.withColumnRenamed("node", "vertexEndId"), "vertexEndId", "left_semi")


def is_connected(edges: DataFrame) -> DataFrame:
    """(connected): whether directed edges lead from the least vertex to all others; a graph without vertices is connected."""
    ends = edges.select(F.explode(F.array("vertexStartId", "vertexEndId")).alias("id")).where("id is not null").distinct()
    head, n = ends.agg(F.min("id"), F.count("*")).first()
    if head is None:
        return edges.agg(F.lit(True).alias("connected"))
    return reachable(edges, head).agg((F.count("*") == n).alias("connected"))


def distances(edges: DataFrame, sources: DataFrame, cost: str = "distance") -> DataFrame:
    """(source, id, cost) least costs from each source (id) over directed edges with costs that are not negative; rounds of relaxation."""
    edges = checkpoint(edges.groupBy(F.col("vertexStartId").alias("s"), F.col("vertexEndId").alias("d")).agg(F.min(cost).alias("c")))
    best = checkpoint(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("cost")))
    frontier = best
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["id"] == edges["s"]).groupBy("source", F.col("d").alias("id")).agg(F.min(F.col("cost") + F.col("c")).alias("new"))
        frontier = checkpoint(step.join(best, ["source", "id"], "left").where("cost is null or new < cost - 1e-12").select("source", "id", F.col("new").alias("cost")))
        best = checkpoint(best.unionByName(frontier).groupBy("source", "id").agg(F.min("cost").alias("cost")))
    return best


#: Searches that one task takes over a block of vertices at most, about.
SEARCHES = 500


def _within_block(block: int):
    """A function of states and edges of one block of so many ids: least costs of each request there, as (request, id, cost, enters); enters marks
    vertices of other blocks. A search ends at the request's first target in the block, or where it costs more than `most`."""

    def searched(states: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, int]]] = {}
        for s, d, c in zip(edges.s.tolist(), edges.d.tolist(), edges.c.tolist(), strict=True):
            near.setdefault(s, []).append((c, d))
        out: list[tuple] = []
        for request, own in states.groupby("request", sort=False):
            heap = sorted(zip(own.cost.tolist(), own.id.tolist(), strict=True))
            most, targets = own.most.iloc[0], set(own.targets.iloc[0])
            most = float("inf") if pd.isna(most) else most
            done: dict[int, int] = {}
            while heap:
                cost, at = heapq.heappop(heap)
                if cost > most or at in done:
                    continue
                done[at] = cost
                if at in targets:
                    most = cost
                for c, d in near.get(at, ()):
                    if cost + c <= most and d not in done:
                        heapq.heappush(heap, (cost + c, d))
            out += [(request, at, cost) for at, cost in done.items()]
        found = pd.DataFrame(out, columns=["request", "id", "cost"])
        found["enters"] = found.id // block != (states.block.iloc[0] if len(states) else 0)
        return found

    return searched


#: Vertices of ids within so wide a range are a block.
BLOCK = 2048


def shortest_paths(edges: DataFrame, requests: DataFrame, cost: str = "distance", most_edges: int | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(request, path, cost) for requests (request, start, targets array): the cheapest path to any target; no row if none is reached.

    An overlay of blocks is built (operators/overlay.py) and searched from both ends; with vertices (id, lat, lng) blocks are places, else ranges in the order
    of ids. Rounds count the overlay's levels (most_edges, once a bound, is not used). Costs must not be negative; they count in parts of 1e-9, at least
    one an edge. Of targets of equal cost the least is taken, of equal ways to a vertex the one from the least vertex.
    """
    made = overlay.build(edges.select("vertexStartId", "vertexEndId", overlay.whole_cost(cost).alias("c")), min(BLOCK, overlay.BLOCK), vertices)
    return overlay.paths(made, requests, SEARCHES)


def _block(c: str) -> Column:
    return F.floor(F.col(c) / BLOCK).cast("long")


def _blocked(near: DataFrame) -> DataFrame:
    return checkpoint(near.withColumn("block", _block("s")))


def _searched(near: DataFrame, asked: DataFrame) -> DataFrame:
    """(request, id, cost, goal): least costs of the vertices around the start of each of asked (request, start, targets, limit), at least to its cheapest target or
    up to its limit of cost."""
    goals = asked.select("request", F.explode("targets").alias("id")).withColumn("goal", F.lit(True))
    best = asked.select("request", F.col("start").alias("id"), F.lit(0).cast("long").alias("cost"), F.lit(True).alias("new"))
    best = checkpoint(best.join(goals, ["request", "id"], "left"))
    while True:
        bound = best.where("goal").groupBy("request").agg(F.min("cost").alias("most"))
        entered = best.where("new").select("request", "id", "cost", _block("id").alias("block")).join(bound, "request", "left")
        entered = entered.join(F.broadcast(asked), "request").withColumn("most", F.least("most", "limit")).where("most is null or cost <= most").drop("limit", "start")
        if entered.isEmpty():
            return best
        deals = entered.groupBy("block").agg(F.ceil(F.count("*") / SEARCHES).cast("int").alias("deals"))
        states = entered.join(deals, "block").select("request", "id", "cost", "most", "targets", "block", F.pmod(F.xxhash64("request"), F.col("deals")).cast("int").alias("deal"))
        copies = deals.select(F.col("block").alias("part"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("copy"))
        held = near.join(copies, F.col("block") == F.col("part")).select("s", "d", "c", "part", "copy")
        found = states.groupBy("block", "deal").cogroup(held.groupBy("part", "copy")).applyInPandas(_within_block(BLOCK), "request long, id long, cost long, enters boolean")
        found = found.groupBy("request", "id").agg(F.min(F.struct(F.col("cost"), F.col("enters"))).alias("f")).select("request", "id", F.col("f.cost").alias("next"), "f.enters")
        both = best.drop("new").join(found.join(goals.withColumnRenamed("goal", "aim"), ["request", "id"], "left"), ["request", "id"], "full")
        better = F.col("next").isNotNull() & (F.col("cost").isNull() | (F.col("next") < F.col("cost")))
        best = checkpoint(both.select("request", "id", F.least("cost", "next").alias("cost"), (better & F.col("enters")).alias("new"), F.coalesce("goal", "aim").alias("goal")))


def walk_cost(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Great-circle kilometres of edges with ends of known coordinates, and penalties: 10 on an inaccessible sidewalk, 5 per end of a crossing without an accessible ramp.

    edges has vertexStartId, vertexEndId, kind ("sidewalk" or "crossing"), isAccessible, startRamp, endRamp (booleans)."""
    from kerbline.operators.spatial import with_endpoints

    penalty = F.when(F.col("kind") == "sidewalk", F.when(F.col("isAccessible"), 0).otherwise(10)).otherwise(F.when(F.col("startRamp"), 0).otherwise(5) + F.when(F.col("endRamp"), 0).otherwise(5))
    return with_endpoints(edges, vertices).withColumn("cost", G.haversine_km("start_lat", "start_lng", "end_lat", "end_lng") + penalty)


def grid(spark: SparkSession, rows: int, columns: int, offset: int = 0) -> DataFrame:
    """Edges of a grid with four neighbours a vertex, in both directions; ids count by rows from offset + 1."""
    at = F.col("id")
    near: list[Column] = [F.when(at % columns != columns - 1, at + 1), F.when(at % columns != 0, at - 1), F.when(at < columns * (rows - 1), at + columns), F.when(at >= columns, at - columns)]
    edges = spark.range(rows * columns).select((at + 1 + offset).alias("vertexStartId"), F.explode(F.array_compact(F.array(*near))).alias("n"))
    return edges.select("vertexStartId", (F.col("n") + 1 + offset).alias("vertexEndId"))
