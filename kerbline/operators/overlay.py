"""Cheapest paths over an overlay of blocks: least costs between the border vertices of each block, at as many levels as the graph needs.

Vertices are numbered along a space-filling curve (or, without coordinates, in the order of their ids), densely, so that blocks hold neighbouring vertices
whatever the ids are. A block of the first level holds `block` vertices, one of each further level FAN blocks of the level below; the last level is one
block. The graph of a block is the edges between its parts and the least costs across its parts, from a vertex that can be entered from outside to one that
can be left. A search climbs from its start and from its targets at once: in each level's block it spreads to that block's borders, and where both
sides meet there is a way. The least is the cost. Then it descends: of each block only vertices on a cheapest path are kept, down to the
edges. So rounds count levels, a logarithm of the vertices, not hops; a task holds the graph of one block and a bounded number of searches.

The overlay is tables of blocks; if edges change, only their blocks and those that contain them are made anew (`changed`). It suits streets, whose blocks
have few border vertices; if most edges lead far away, results are right, but a block's border is most of it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.lineage import checkpoint
from kerbline.operators.tables import dense_ids

#: Vertices of a block of the first level, and blocks of a level that are one of the next.
BLOCK, FAN = 256, 64
#: Costs are whole numbers of this many to one within searches, so that sums don't depend on their order and ties are ties.
PARTS = 1_000_000_000
NEVER, CELLS = 1 << 60, 1 << 19
EDGE, ACROSS, ENTERED, LEFT = 0, 1, 2, 3  # kinds of a block's rows: an edge, a least cost across a part, a vertex entered from outside, one left
AHEAD, BACK, MET, LINK, GOAL = 0, 1, 2, 3, 4  # kinds of a search's rows

BLOCK_ROWS = "block long, s long, d long, c long, kind int"
SEARCH_ROWS = "request long, kind int, v long, cost long, above long"


def whole_cost(cost: str) -> Column:
    """A cost in whole parts, at least one."""
    return F.greatest(F.round(F.col(cost).cast("double") * PARTS).cast("long"), F.lit(1))


def curve(lat: str, lng: str, bits: int = 20) -> Column:
    """A place's number along the Z-order curve of a grid of 2 ** bits by 2 ** bits cells of latitude and longitude."""

    def spread(c: Column) -> Column:  # a zero between any two bits
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    cell = lambda c, low, width: F.least(F.greatest(F.floor((F.col(c) - low) / width * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    z = F.shiftleft(spread(cell(lat, -90.0, 180.0)), 1).bitwiseOR(spread(cell(lng, -180.0, 360.0)))
    return F.when(F.col(lat).isNotNull() & F.col(lng).isNotNull(), z)


@dataclass(frozen=True)
class Overlay:
    """numbers: (id, z) of all vertices; levels: a table of BLOCK_ROWS a level; sizes: the vertices of a block of each."""

    numbers: DataFrame
    levels: list[DataFrame]
    sizes: list[int]

    def placed(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows with the numbers of the vertices of columns instead of their ids; rows with unknown ones go."""
        for c in columns:
            rows = rows.join(self.numbers.select(F.col("id").alias(c), F.col("z").alias("_z")), c).drop(c).withColumnRenamed("_z", c)
        return rows

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = rows.join(self.numbers.select(F.col("z").alias(c), F.col("id").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
        return rows


class _Graph:
    """A block's graph in arrays; vertices by their place among all of the block's."""

    def __init__(self, rows: pd.DataFrame):
        kind, s, d = (rows[c].to_numpy() for c in ("kind", "s", "d"))
        edges = kind <= ACROSS
        self.nodes = np.unique(np.concatenate([s, d[edges]]))
        self.s, self.d, self.c, self.plain = self.at(s[edges]), self.at(d[edges]), rows["c"].to_numpy()[edges], kind[edges] == EDGE
        self.entered, self.left = self.at(s[kind == ENTERED]), self.at(s[kind == LEFT])

    def at(self, v: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, v)

    def ahead(self, best: np.ndarray, most: np.ndarray | int = NEVER, aims: tuple | None = None) -> np.ndarray:
        return relaxed(best, self.s, self.d, self.c, most, aims)

    def back(self, best: np.ndarray, most: np.ndarray | int = NEVER, before: np.ndarray | None = None) -> np.ndarray:
        return relaxed(best, self.d, self.s, self.c, most, before=before)


def relaxed(best: np.ndarray, s: np.ndarray, d: np.ndarray, c: np.ndarray, most: np.ndarray | int = NEVER, aims: tuple | None = None, before: np.ndarray | None = None) -> np.ndarray:
    """best (a row a vertex, a column a search), lowered along edges until nothing changes; costs beyond a search's `most` go no further.

    aims (vertices, searches, costs from there on) lower the most of their searches as soon as they are reached. before is what was spent before each vertex
    is entered the other way: with it, only vertices whose sum is not beyond the most are entered."""
    order = np.argsort(d, kind="stable")
    s, d, c = s[order], d[order], c[order][:, None]
    most = np.broadcast_to(most, best.shape[1])
    step = max(16, CELLS // max(1, len(s)))
    for a in range(0, best.shape[1], step):
        part, bound = np.ascontiguousarray(best[:, a : a + step]), most[a : a + step].copy()
        spent = None if before is None else before[:, a : a + step]
        if aims is not None:
            own = (aims[1] >= a) & (aims[1] < a + step)
            v, column, rest = aims[0][own], aims[1][own] - a, aims[2][own]
            np.minimum.at(bound, column, part[v, column] + rest)
        open_ = (part < NEVER).any(1)
        while open_.any():
            some = np.flatnonzero(open_[s])
            ends = d[some]
            first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1])) if len(ends) else ends
            open_[:] = False
            if not len(first):
                break
            ends, new = ends[first], np.minimum.reduceat(part[s[some]] + c[some], first, axis=0)
            old = part[ends]
            lower = (new < old) & ((new if spent is None else new + spent[ends]) <= bound)
            part[ends] = np.where(lower, new, old)
            open_[ends[lower.any(1)]] = True
            if aims is not None:
                np.minimum.at(bound, column, part[v, column] + rest)
        best[:, a : a + step] = part
    return best


def _crossed(every: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Least costs across a block, from its entered vertices to those left (or between all of both); those that are the sum of two others are left out."""
        g = _Graph(rows)
        borders = np.union1d(g.entered, g.left)
        best = np.full((len(g.nodes), len(borders)), NEVER)
        best[borders, np.arange(len(borders))] = 0
        best = g.ahead(best)[borders].T  # from a border to a border
        begins, ends = (np.isin(borders, x) | every for x in (g.entered, g.left))
        keep = begins[:, None] & ends[None, :] & (best < NEVER) & ~np.eye(len(borders), dtype=bool)
        for k in np.flatnonzero(begins & ends):  # a way may only be parted where both halves are kept
            a, b = best[:, k, None].copy(), best[None, k, :].copy()
            a[k] = b[0, k] = NEVER
            keep &= a + b != best
        i, j = np.nonzero(keep)
        return pd.DataFrame({"s": g.nodes[borders[i]], "d": g.nodes[borders[j]], "c": best[i, j]})

    return run


def _across(level: DataFrame, every: bool = False) -> DataFrame:
    return level.groupBy("block").applyInPandas(_crossed(every), "s long, d long, c long")


def _at(c: str, size: int) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def build(edges: DataFrame, block: int, vertices: DataFrame | None = None, every: bool = False) -> Overlay:
    """The overlay of edges (vertexStartId, vertexEndId, c whole and positive), with vertices (id, lat, lng) along the curve; vertices without a place come first.

    With every, it holds the costs across blocks between all border vertices, which paths don't need but strong components do."""
    ids = edges.select(F.explode(F.array("vertexStartId", "vertexEndId")).alias("id")).distinct()
    key = F.lit(0).cast("long")
    if vertices is not None:
        ids, key = ids.join(vertices.groupBy("id").agg(F.min(F.struct("lat", "lng")).alias("at")), "id", "left").select("id", "at.lat", "at.lng"), F.coalesce(curve("lat", "lng"), F.lit(-1).cast("long"))
    numbers = checkpoint(dense_ids(ids.select("id", key.alias("key")), ["key", "id"], "z").select("id", (F.col("z") - 1).alias("z")))
    n, sizes = numbers.count(), [block]
    while sizes[-1] < n:
        sizes.append(sizes[-1] * FAN)
    empty = Overlay(numbers, [], sizes)
    rows = empty.placed(edges.where("vertexStartId <> vertexEndId").select(F.col("vertexStartId").alias("s"), F.col("vertexEndId").alias("d"), "c").groupBy("s", "d").agg(F.min("c").alias("c")), "s", "d")
    same = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        same = F.when(_at("s", sizes[k]) == _at("d", sizes[k]), k).otherwise(same)
    rows, levels, lower = checkpoint(rows.withColumn("level", same)), [], None
    none = F.lit(-1).cast("long")
    for k, size in enumerate(sizes):
        row = lambda df, s, d, c, kind, size=size: df.select(_at(s, size).alias("block"), F.col(s).alias("s"), d.alias("d"), c.alias("c"), F.lit(kind).alias("kind"))
        parts = row(rows.where(F.col("level") == k), "s", F.col("d"), F.col("c"), EDGE)
        if lower is not None:
            parts = parts.unionByName(row(lower, "s", F.col("d"), F.col("c"), ACROSS))
        if k < len(sizes) - 1:
            outer = rows.where(F.col("level") > k)
            for c, kind in (("d", ENTERED), ("s", LEFT)):
                parts = parts.unionByName(row(outer.select(c).distinct(), c, none, none, kind))
        levels.append(checkpoint(parts))
        lower = _across(levels[-1], every) if k < len(sizes) - 1 else None
    return replace(empty, levels=levels)


def changed(overlay: Overlay, changes: DataFrame) -> Overlay:
    """The overlay with new costs (vertexStartId, vertexEndId, c) of edges that it has; a null c takes the edge away. Vertices, and so borders, stay.

    In each level only the blocks that hold a changed edge, or a block whose costs across were made anew, are read and written; the rest stays where it is.
    """
    new = changes.select(F.col("vertexStartId").alias("s"), F.col("vertexEndId").alias("d"), F.col("c").alias("new"))
    new = checkpoint(overlay.placed(new, "s", "d"))
    levels, touched, lower = [], None, None
    for k, (level, size) in enumerate(zip(overlay.levels, overlay.sizes, strict=True)):
        here = new.where(_at("s", size) == _at("d", size)).select(_at("s", size).alias("block"))
        touched = checkpoint((here if touched is None else here.union(touched.select(F.floor(F.col("block") / FAN).cast("long").alias("block")))).distinct())
        rows = level.join(touched, "block", "left_semi")
        if lower is not None:  # the costs across touched parts are replaced
            parts = touched_below.withColumnsRenamed({"block": "part"})
            kept = rows.where(F.col("kind") != ACROSS).unionByName(rows.where(F.col("kind") == ACROSS).withColumn("part", _at("s", overlay.sizes[k - 1])).join(parts, "part", "left_anti").drop("part"))
            rows = kept.unionByName(lower.select(_at("s", size).alias("block"), "s", "d", "c", F.lit(ACROSS).alias("kind")))
        rows = rows.join(new.withColumn("kind", F.lit(EDGE)).withColumn("hit", F.lit(True)), ["s", "d", "kind"], "left")
        rows = rows.where("hit is null or new is not null").select("block", "s", "d", F.coalesce("new", "c").alias("c"), "kind")
        rows = checkpoint(rows)
        levels.append(level.join(touched, "block", "left_anti").unionByName(rows))
        lower, touched_below = _across(rows), touched
    return replace(overlay, levels=levels)


def _sides(g: _Graph, found: pd.DataFrame):
    """For some requests at a time, those of neighbouring starts together: their numbers, the most that counts, and the known costs from their starts and to their
    targets in a block, as (vertices, columns, costs)."""
    names, row = np.unique(found["request"].to_numpy(), return_inverse=True)
    kind, v, cost = found["kind"].to_numpy(), g.at(found["v"].to_numpy()), found["cost"].to_numpy()
    most, place = np.full(len(names), NEVER), np.full(len(names), len(g.nodes))
    np.minimum.at(most, row, found["most"].to_numpy())
    np.minimum.at(place, row[kind == AHEAD], v[kind == AHEAD])
    order = np.argsort(place, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    names, most, row = names[order], most[order], rank[row]
    step = max(1, 2 * CELLS // max(1, len(g.nodes)))
    for a in range(0, len(names), step):
        own = (row >= a) & (row < a + step)
        sides = [(v[x], row[x] - a, cost[x]) for x in (own & (kind == side) for side in (AHEAD, BACK))]
        yield names[a : a + step], most[a : a + step], *sides


def _laid(g: _Graph, n: int, side: tuple) -> np.ndarray:
    best = np.full((len(g.nodes), n), NEVER)
    np.minimum.at(best, side[:2], side[2])
    return best


def _climbed(states: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """A block's searches: costs at its borders, and the least cost of each request whose sides meet in it."""
    if not len(states) or not len(rows):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("request", "kind", "v", "cost", "above")})
    g, out = _Graph(rows), []
    for names, most, start, goal in _sides(g, states):
        ahead, least = g.ahead(_laid(g, len(names), start), most, goal), np.full(len(names), NEVER)
        np.minimum.at(least, goal[1], ahead[goal[:2]] + goal[2])
        met = least < NEVER
        out.append(pd.DataFrame({"request": names[met], "kind": MET, "v": -1, "cost": least[met]}))
        sides = [(AHEAD, ahead, g.left)]
        if len(g.entered):  # the last level has no borders
            sides.append((BACK, g.back(_laid(g, len(names), goal), np.minimum(most, least)), g.entered))
        for kind, best, ends in sides:
            j, i = np.nonzero(best[ends] < np.minimum(most, least))
            out.append(pd.DataFrame({"request": names[i], "kind": kind, "v": g.nodes[ends[j]], "cost": best[ends[j], i]}))
    return pd.concat(out).assign(above=-1)


def _descended(lowest: bool):
    def run(states: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """A block's vertices on cheapest paths, with their costs from the start and to the target, and the edges between them that such paths take."""
        if not len(states) or not len(rows):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("request", "kind", "v", "cost", "above")})
        g, out = _Graph(rows), []
        s, d, c = g.s[g.plain], g.d[g.plain], g.c[g.plain][:, None]
        for names, least, start, goal in _sides(g, states):
            ahead = g.ahead(_laid(g, len(names), start), least)
            # back along what can be on a cheapest path alone
            back = g.back(_laid(g, len(names), goal), least, ahead)
            tight = ahead + back == least
            j, i = np.nonzero(tight)
            if lowest:
                end = back[j, i] == 0
                out.append(pd.DataFrame({"request": names[i[end]], "kind": GOAL, "v": g.nodes[j[end]], "cost": ahead[j[end], i[end]]}))
            else:
                out += [pd.DataFrame({"request": names[i], "kind": kind, "v": g.nodes[j], "cost": best[j, i]}) for kind, best in ((AHEAD, ahead), (BACK, back))]
            step = max(1, CELLS // max(1, len(s)))
            for a in range(0, len(names), step):
                t, x = tight[:, a : a + step], ahead[:, a : a + step]
                j, i = np.nonzero(t[s] & t[d] & (x[s] + c == x[d]))
                out.append(pd.DataFrame({"request": names[a + i], "kind": LINK, "v": g.nodes[d[j]], "cost": 0, "above": g.nodes[s[j]]}))
        return pd.concat(out).fillna({"above": -1}).astype({"above": "int64"}) if out else None

    return run


def _met_in_blocks(level: DataFrame, size: int, states: DataFrame, searches: int, run) -> DataFrame:
    """run over each block with its states, those of a crowded block dealt to several tasks."""
    states = states.withColumn("block", _at("v", size))
    deals = states.groupBy("block").agg(F.ceil(F.count("*") / searches).cast("int").alias("deals"))
    own = states.join(deals, "block").withColumn("deal", F.pmod(F.xxhash64("request"), F.col("deals")).cast("int")).drop("deals")
    held = level.join(deals, "block").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    # few rows are much work: without a number, Spark would join the tasks of small partitions
    tasks = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, held = own.repartition(tasks, "block", "deal"), held.repartition(tasks, "block", "deal")
    return own.groupBy("block", "deal").cogroup(held.groupBy("block", "deal")).applyInPandas(run, SEARCH_ROWS)


def _assembled(rows: pd.DataFrame) -> pd.DataFrame:
    """Paths of some requests, from rows (request, kind, v, cost, above): back from the least target along the least vertices before."""
    out = []
    links = {(r, v): a for r, k, v, a in zip(rows["request"].tolist(), rows["kind"].tolist(), rows["v"].tolist(), rows["above"].tolist(), strict=True) if k == LINK}
    goals = rows[rows["kind"] == GOAL].sort_values(["request", "v"]).drop_duplicates("request")
    for request, v, cost in zip(goals["request"].tolist(), goals["v"].tolist(), goals["cost"].tolist(), strict=True):
        path = [v]
        while (request, path[-1]) in links:
            path.append(links[request, path[-1]])
        out.append((request, path[::-1], cost / PARTS))
    return pd.DataFrame(out, columns=["request", "path", "cost"])


def paths(overlay: Overlay, requests: DataFrame, searches: int = 500) -> DataFrame:
    """(request, path, cost) of requests (request, start, targets array): the cheapest path to any target; no row if none is reached.

    Of targets of equal cost the least is taken, of equal ways to a vertex the one from the least vertex. A start that is a target is a path of itself.
    The last task of a request holds the vertices of its cheapest paths, which are many only if many paths cost the same to a part in a thousand million.
    """
    requests = requests.where("request is not null and start is not null").groupBy("request").agg(F.sort_array(F.collect_set("start")).alias("starts"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("targets")))).alias("targets"))
    # requests of the same ends are one search, that of the least of them
    same = checkpoint(requests.withColumn("search", F.min("request").over(Window.partitionBy("starts", "targets"))))
    at_once = F.arrays_overlap("targets", "starts")
    done = same.where(at_once).select("request", F.slice(F.array_intersect("starts", "targets"), 1, 1).alias("path"), F.lit(0.0).alias("cost"))
    open_ = same.where(F.coalesce(~at_once, F.lit(True)) & (F.col("search") == F.col("request")))
    row = lambda v, kind: open_.select("request", F.lit(kind).alias("kind"), v.alias("v")).where("v is not null")
    first = overlay.placed(row(F.explode("starts"), AHEAD).unionByName(row(F.explode("targets"), BACK)), "v").select("request", "kind", "v", F.lit(0).cast("long").alias("cost"))
    both = first.groupBy("request").agg(F.count_distinct("kind").alias("sides")).where("sides = 2")
    states, most, climbed = checkpoint(first.join(both.select("request"), "request", "left_semi")), None, []
    for level, size in zip(overlay.levels, overlay.sizes, strict=True):
        climbed.append(states)
        if most is not None:
            states = states.join(bound, "request", "left")
        else:
            states = states.withColumn("most", F.lit(None).cast("long"))
        found = checkpoint(_met_in_blocks(level, size, states.withColumn("most", F.coalesce("most", F.lit(NEVER))), searches, _climbed).drop("above"))
        met = found.where(F.col("kind") == MET).select("request", "cost")
        most = met if most is None else most.unionByName(met)
        # what costs more than a way that is known leads to no cheaper one
        bound = most.groupBy("request").agg(F.min("cost").alias("most"))
        states = found.where(F.col("kind") != MET).join(bound, "request", "left").where("most is null or cost < most").drop("most")
    least = checkpoint(most.groupBy("request").agg(F.min("cost").alias("most")))
    links, kept = None, None
    for k in range(len(overlay.levels) - 1, -1, -1):
        own = climbed[k].join(least, "request").where("cost <= most")
        states = own if kept is None else own.unionByName(kept.join(least, "request"))
        found = checkpoint(_met_in_blocks(overlay.levels[k], overlay.sizes[k], states, searches, _descended(k == 0)))
        kept = found.where(F.col("kind") <= BACK).drop("above")
        ends = found.where(F.col("kind") >= LINK)
        links = ends if links is None else links.unionByName(ends)
    link = overlay.named(links.where(F.col("kind") == LINK), "v", "above").groupBy("request", "kind", "v").agg(F.min("above").alias("above"), F.max("cost").alias("cost"))
    goal = overlay.named(links.where(F.col("kind") == GOAL), "v")
    every = checkpoint(link.unionByName(goal))
    deals = F.lit(max(1, every.count() // 200_000))
    found = every.groupBy(F.pmod(F.xxhash64("request"), deals).alias("deal")).applyInPandas(_assembled, "request long, path array<long>, cost double")
    found = same.select("request", "search").join(found.withColumnRenamed("request", "search"), "search").drop("search")
    return found.select("request", "path", "cost").unionByName(done)


# all vertices from one -----------------------------------------------------------------------------------------------------


def _spread(states: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Least costs of a block's vertices from those with a known one (v, cost)."""
    if not len(states) or not len(rows):
        return pd.DataFrame({"v": pd.Series(dtype="int64"), "cost": pd.Series(dtype="int64")})
    g = _Graph(rows)
    v, cost = states["v"].to_numpy(), states["cost"].to_numpy()
    known = np.isin(v, g.nodes)
    best = np.full((len(g.nodes), 1), NEVER)
    np.minimum.at(best[:, 0], g.at(v[known]), cost[known])
    best = g.ahead(best)[:, 0]
    return pd.DataFrame({"v": g.nodes, "cost": best})[best < NEVER]


def spread(overlay: Overlay, start: int) -> DataFrame:
    """(id, cost) of all vertices that edges reach from start, itself included if it is in the graph.

    The start's blocks are searched up to the last level, whose vertices then have their costs in the whole graph; each level below takes over those of its
    borders, all blocks at once. Rounds count levels, not hops or blocks.
    """
    session = overlay.numbers.sparkSession
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))

    def searched(states: DataFrame, level: DataFrame, size: int) -> DataFrame:
        own = states.withColumn("block", _at("v", size))
        held = level.join(own.select("block").distinct(), "block", "left_semi")
        both = own.repartition(tasks, "block").groupBy("block").cogroup(held.repartition(tasks, "block").groupBy("block"))
        return checkpoint(both.applyInPandas(_spread, "v long, cost long"))

    climbed = [checkpoint(overlay.numbers.where(F.col("id") == start).select(F.col("z").alias("v"), F.lit(0).cast("long").alias("cost")))]
    for level, size in zip(overlay.levels[:-1], overlay.sizes[:-1], strict=True):
        climbed.append(searched(climbed[-1], level, size))
    known = None
    for states, level, size in zip(reversed(climbed), reversed(overlay.levels), reversed(overlay.sizes), strict=True):
        known = searched(states if known is None else states.unionByName(known), level, size)
    return overlay.named(known, "v").select(F.col("v").alias("id"), "cost")


# strong components ---------------------------------------------------------------------------------------------------------


def _cycles(n: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each of n vertices the least of its strong component: by depth, the last vertex from which all above on the stack were found closes one."""
    order = np.argsort(s, kind="stable")
    near, at = d[order].tolist(), np.searchsorted(s[order], np.arange(n + 1)).tolist()
    index, low, root, stack, counter = [-1] * n, [0] * n, [-1] * n, [], 0
    for first in range(n):
        if index[first] >= 0:
            continue
        work = [(first, at[first])]
        index[first] = low[first] = counter
        counter += 1
        stack.append(first)
        while work:
            v, k = work.pop()
            if k < at[v + 1]:
                work.append((v, k + 1))
                w = near[k]
                if index[w] < 0:
                    index[w] = low[w] = counter
                    counter += 1
                    stack.append(w)
                    work.append((w, at[w]))
                elif root[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                group = [stack.pop()]
                while group[-1] != v:
                    group.append(stack.pop())
                for w in group:
                    root[w] = min(group)
    return np.array(root, np.int64)


def _labelled(known: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The component of each vertex of a block, from those of its border: a vertex that a component's border reaches and that reaches it belongs to it."""
    if not len(rows):
        return pd.DataFrame({"v": pd.Series(dtype="int64"), "label": pd.Series(dtype="int64")})
    g = _Graph(rows)
    label = np.full(len(g.nodes), -1)
    label[g.at(known["v"].to_numpy())] = known["label"].to_numpy()
    names, place = np.unique(label[label >= 0], return_inverse=True)
    if len(names):
        seeds = np.full((len(g.nodes), len(names)), NEVER)
        seeds[np.flatnonzero(label >= 0), place] = 0
        both = (g.ahead(seeds.copy()) < NEVER) & (g.back(seeds) < NEVER)
        label = np.where(label >= 0, label, np.where(both.any(1), names[both.argmax(1)], -1))
    rest = np.flatnonzero(label < 0)
    inner = np.searchsorted(rest, np.arange(len(g.nodes)))
    free = (label[g.s] < 0) & (label[g.d] < 0)
    label[rest] = g.nodes[rest[_cycles(len(rest), inner[g.s[free]], inner[g.d[free]])]] if len(rest) else 0
    return pd.DataFrame({"v": g.nodes, "label": label})


def strong_components(edges: DataFrame, block: int = BLOCK, vertices: DataFrame | None = None) -> DataFrame:
    """(node, root): each vertex of edges (vertexStartId, vertexEndId) with the least vertex of its strong component: all that it reaches and that reach it.

    Costs across blocks say what reaches what. Components of the last level's vertices are those of the whole graph, and each level below takes over those of
    its borders: rounds count levels. A vertex with loops alone is a component of its own.
    """
    ends = edges.select(F.col("vertexStartId").alias("node")).union(edges.select("vertexEndId")).where("node is not null").distinct()
    overlay = build(edges.select("vertexStartId", "vertexEndId", F.lit(1).cast("long").alias("c")), block, vertices, True)
    known, tasks = None, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level, size in zip(reversed(overlay.levels), reversed(overlay.sizes), strict=True):
        own = (level.select("block").limit(0).selectExpr("block", "block as v", "block as label") if known is None else known.select(_at("v", size).alias("block"), "v", "label")).repartition(tasks, "block")
        known = checkpoint(own.groupBy("block").cogroup(level.repartition(tasks, "block").groupBy("block")).applyInPandas(_labelled, "v long, label long"))
    named = overlay.named(known, "v")
    roots = named.groupBy("label").agg(F.min("v").alias("root"))
    found = named.join(roots, "label").select(F.col("v").alias("node"), "root")
    return ends.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
