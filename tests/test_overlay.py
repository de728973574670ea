"""Paths over overlays of blocks, and overlays kept up to date."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import graph as N
from kerbline.operators import overlay as O


def _streets(n: int, seed: int):
    """A town of n by n corners with sparse ids, one-way streets, gaps and a dead part; places and edges."""
    rng = random.Random(seed)
    ids = rng.sample(range(-(10**12), 10**12), n * n)
    places = {ids[i * n + j]: (-34.6 + i * 0.001, -58.4 + j * 0.001) for i in range(n) for j in range(n)}
    edges = {}
    for i in range(n):
        for j in range(n):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n and b < n and rng.random() < 0.9:
                    u, v = ids[i * n + j], ids[a * n + b]
                    edges[u, v] = rng.randint(1, 9)
                    if rng.random() < 0.8:
                        edges[v, u] = rng.randint(1, 9)
    return ids, places, edges


def _plain(edges, start, targets):
    near = {}
    for (a, b), c in edges.items():
        near.setdefault(a, []).append((b, c))
    best, heap = {}, [(0, start)]
    while heap:
        cost, at = heapq.heappop(heap)
        if at not in best:
            best[at] = cost
            for b, c in near.get(at, ()):
                heapq.heappush(heap, (cost + c, b))
    ends = sorted((best[t], t) for t in set(targets) if t in best)
    if not ends:
        return None
    path, back = [ends[0][1]], {}
    for (a, b), c in edges.items():
        if a in best and b in best and best[a] + c == best[b]:
            back[b] = min(a, back.get(b, a))
    while path[-1] != start:
        path.append(back[path[-1]])
    return ends[0][0] / O.PARTS, path[::-1]


def _frames(spark, places, edges, requests):
    return (
        spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "vertexStartId long, vertexEndId long, c long"),
        spark.createDataFrame([(i, *p) for i, p in places.items()], "id long, lat double, lng double"),
        spark.createDataFrame(requests, "request long, start long, targets array<long>"),
    )


def _found(overlay, requests, searches=4000):
    return {r.request: (r.cost, r.path) for r in O.paths(overlay, requests, searches).collect()}


@pytest.mark.parametrize("placed, block, fan, searches", [(True, 16, 4, 50), (False, 32, 64, 4000)])
def test_overlay_paths_against_dijkstra(spark, monkeypatch, placed, block, fan, searches):
    monkeypatch.setattr(O, "FAN", fan)
    ids, places, edges = _streets(14, block)
    rng = random.Random(3)
    asked = [(i, rng.choice(ids), rng.sample(ids, rng.choice((1, 1, 3)))) for i in range(60)] + [(90, ids[0], [ids[0], ids[1]]), (91, 7, [7]), (92, ids[0], [5]), (93, 5, [ids[0]]), (94, ids[3], []), (95, ids[3], None), (None, ids[0], [ids[1]])]
    e, v, q = _frames(spark, places, edges, asked)
    overlay = O.build(e, block, v if placed else None)
    assert len(overlay.levels) > (2 if placed else 1)
    want = {i: p for i, s, t in asked if i is not None and t and s in places and (p := _plain(edges, s, t))}
    assert _found(overlay, q, searches) == want | {91: (0.0, [7])} and len(want) > 40


def test_an_overlay_follows_changes_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(O, "FAN", 4)
    ids, places, edges = _streets(12, 8)
    rng = random.Random(4)
    asked = [(i, rng.choice(ids), [rng.choice(ids)]) for i in range(40)]
    e, v, q = _frames(spark, places, edges, asked)
    overlay = O.build(e, 16, v)
    some = rng.sample(sorted(edges), 3)
    news = {some[0]: 1, some[1]: 400, some[2]: None}
    after = O.changed(overlay, spark.createDataFrame([(a, b, c) for (a, b), c in news.items()], "vertexStartId long, vertexEndId long, c long"))
    now = {k: c for k, c in (edges | news).items() if c is not None}
    assert _found(after, q) == {i: p for i, s, t in asked if (p := _plain(now, s, t))}
    # blocks without a change are as they were
    rows = lambda level: set(map(tuple, level.collect()))
    old, new = rows(overlay.levels[0]), rows(after.levels[0])
    assert {r[0] for r in old ^ new} and len({r[0] for r in old ^ new}) <= 3
    assert O.changed(overlay, spark.createDataFrame([], "vertexStartId long, vertexEndId long, c long")).levels[0].count() == len(old)


def test_rounds_do_not_count_hops_or_ids(spark, monkeypatch):
    written = []
    monkeypatch.setattr(O, "checkpoint", lambda df, f=O.checkpoint: (written.append(1), f(df))[1])
    tables = []
    for step in (1, 5000):
        line = spark.range(1000).select((F.col("id") * step).alias("vertexStartId"), ((F.col("id") + 1) * step).alias("vertexEndId"), F.lit(1).cast("long").alias("c"))
        written.clear()
        overlay = O.build(line, O.BLOCK)
        built = len(written)
        found = O.paths(overlay, spark.createDataFrame([(1, 0, [1000 * step])], "request long, start long, targets array<long>")).first()
        assert found.cost == 1000 / O.PARTS and found.path == [i * step for i in range(1001)]
        tables.append((built, len(written) - built))
    assert tables[0] == tables[1] and tables[0][1] <= 8


def test_the_curve_keeps_neighbours_together(spark):
    at = spark.createDataFrame([(0.0, 0.0), (-90.0, -180.0), (90.0, 180.0), (None, 1.0)], "lat double, lng double").select(O.curve("lat", "lng", 2).alias("z")).collect()
    assert [r.z for r in at] == [12, 0, 15, None]
    assert O.paths(O.build(spark.createDataFrame([], "vertexStartId long, vertexEndId long, c long"), 4), spark.createDataFrame([(1, 2, [3])], "request long, start long, targets array<long>")).count() == 0


@pytest.mark.parametrize("block, fan", [(4, 4), (8, 64), (256, 64)])
def test_strong_components_against_reach(spark, monkeypatch, block, fan):
    monkeypatch.setattr(O, "FAN", fan)
    rng = random.Random(block)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(100 + i, 100 + (i + 1) % 30) for i in range(30)} | {(105, 200), (200, 201), (201, 200), (202, 110), (300, 300)}
    near, nodes = {}, {x for p in pairs for x in p}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for x in near.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    far = {a: reach(a) for a in nodes}
    edges = spark.createDataFrame(sorted(pairs), "vertexStartId long, vertexEndId long")
    got = {r.node: r.root for r in O.strong_components(edges, block).collect()}
    assert got == {a: min(b for b in far[a] if a in far[b]) for a in nodes} and got[300] == 300 and got[129] == 100


def test_reach_from_one_vertex(spark, monkeypatch):
    block = 16
    monkeypatch.setattr(O, "FAN", 4)
    monkeypatch.setattr(O, "BLOCK", block)
    monkeypatch.setattr(N, "BLOCK", 10**11)
    ids, places, edges = _streets(12, block)
    cut = {(a, b) for a, b in edges if (a in ids[:72]) == (b in ids[:72])} | {(5, 6), (ids[0], ids[0])}
    near = {}
    for a, b in cut:
        near.setdefault(a, []).append(b)
    e = spark.createDataFrame(sorted(cut), "vertexStartId long, vertexEndId long")
    for start in (ids[30], 77):
        hops, todo = {start: 0}, [start]
        for a in todo:
            for b in near.get(a, ()):
                if b not in hops:
                    hops[b] = hops[a] + 1
                    todo.append(b)
        assert {r.id: r.hops for r in N.reachable(e, start).collect()} == hops
        if start != 77:
            assert {r.id: r.hops for r in N.reachable(e, start, most=5).collect()} == {v: h for v, h in hops.items() if h <= 5}


def test_reach_takes_rounds_by_levels(spark, monkeypatch):
    written = []
    for module in (O, N):
        monkeypatch.setattr(module, "checkpoint", lambda df, f=O.checkpoint: (written.append(1), f(df))[1])
    line = spark.range(3000).select((F.col("id") * 5000).alias("vertexStartId"), ((F.col("id") + 1) * 5000).alias("vertexEndId"))
    far = N.reachable(line, 0).agg(F.count("*"), F.max("hops"), F.sum(F.col("hops") * 5000 - F.col("id"))).first()
    assert tuple(far) == (3001, 3000, 0) and len(written) <= 12


def test_requests_of_the_same_ends_are_one_search(spark, monkeypatch):
    """Many requests between few places: each different search is done once, and each request has its path."""
    ids, places, edges = _streets(12, 4)
    states = []
    monkeypatch.setattr(O, "_met_in_blocks", lambda level, size, own, *rest, f=O._met_in_blocks: (states.append(own.count()), f(level, size, own, *rest))[1])
    ends = [(ids[0], [ids[77], ids[5]]), (ids[9], [ids[130]]), (ids[140], [ids[2], ids[140]])]
    asked = [(i, ends[i % 3][0], ends[i % 3][1][:: 1 if i % 2 else -1]) for i in range(600)]
    e, v, q = _frames(spark, places, edges, asked)
    got = _found(O.build(e, 16, v), q)
    assert got == {i: _plain(edges, s, t) for i, s, t in asked} and len(got) == 600
    assert states[0] == 5
