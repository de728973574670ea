import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.operators import graph as N
from kerbline.operators import sidewalks, spatial

# Golden graphs, their paths and their counts.
GRAPH = {1: [2, 6], 2: [1, 3], 3: [2, 7, 4], 4: [3, 8], 5: [6, 11], 6: [1, 5], 7: [3], 8: [4, 9], 9: [8, 14], 10: [11, 12, 13], 11: [5, 10], 12: [10, 15], 13: [10, 18], 14: [9, 18], 15: [12, 16], 16: [15, 17], 17: [16, 19], 18: [13, 14, 19], 19: [17, 18]}
PATHS = [
    ([], [4], [1, 2, 3, 4]), ([], [18], [1, 6, 5, 11, 10, 13, 18]), ([], [19], [1, 6, 5, 11, 10, 13, 18, 19]), ([], [19, 14], [1, 2, 3, 4, 8, 9, 14]), ([], [19, 14, 7], [1, 2, 3, 7]),
    ([(10, 13)], [18], [1, 2, 3, 4, 8, 9, 14, 18]), ([(10, 13)], [19], [1, 2, 3, 4, 8, 9, 14, 18, 19]),
    ([(10, 13), (14, 18)], [18], [1, 6, 5, 11, 10, 12, 15, 16, 17, 19, 18]), ([(10, 13), (14, 18)], [19], [1, 6, 5, 11, 10, 12, 15, 16, 17, 19]),
]


def _edges(spark, without=()):
    return spark.createDataFrame([(a, b, 10.0) for a, near in GRAPH.items() for b in near if (a, b) not in without], "vertexStartId long, vertexEndId long, distance double")


@pytest.mark.parametrize("without,targets,path", PATHS)
def test_shortest_paths(spark, without, targets, path):
    request = spark.createDataFrame([(1, 1, targets)], "request long, start long, targets array<long>")
    found = N.shortest_paths(_edges(spark, without), request).first()
    assert (found.path, found.cost) == (path, 10.0 * (len(path) - 1))


def test_both_ways_of_search_agree_and_nothing_is_found_without_a_way(spark):
    requests = spark.createDataFrame([(1, 1, [18]), (2, 12, [7, 1]), (3, 1, [99]), (4, 5, [5])], "request long, start long, targets array<long>")
    few = {r.request: r.cost for r in N.shortest_paths(_edges(spark), requests).collect()}
    many = {r.request: r.cost for r in N.shortest_paths(_edges(spark), requests, most_edges=1).collect()}
    assert few == many == {1: 60.0, 2: few[2], 4: 0.0}


def test_paths_are_the_same_in_small_blocks_and_many_tasks(spark, monkeypatch):
    import heapq
    import random

    random.seed(9)
    edges = [(a, b, random.choice((1.0, 2.0, 2.5))) for a in range(1, 41) for b in random.sample(range(1, 41), 3)]
    requests = [(i, random.randint(1, 40), random.sample(range(1, 45), 2)) for i in range(60)]
    near = {}
    for a, b, c in edges:
        near.setdefault(a, {})[b] = min(c, near.get(a, {}).get(b, c))

    def plain(start, targets):  # costs, then from each target the least vertex before
        best, heap = {}, [(0.0, start)]
        while heap:
            cost, at = heapq.heappop(heap)
            if at not in best:
                best[at] = cost
                for b, c in near.get(at, {}).items():
                    if b != at:
                        heapq.heappush(heap, (cost + c, b))
        ends = sorted((best[t], t) for t in targets if t in best)
        if not ends:
            return None
        path = [ends[0][1]]
        while path[-1] != start:
            path.append(min(a for a in near if path[-1] in near[a] and a != path[-1] and a in best and best[a] + near[a][path[-1]] == best[path[-1]]))
        return path[::-1], ends[0][0]

    for block, searches in ((2048, 20_000), (12, 9)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "SEARCHES", searches)
        e = spark.createDataFrame(edges, "vertexStartId long, vertexEndId long, distance double")
        q = spark.createDataFrame(requests, "request long, start long, targets array<long>")
        found = {r.request: (r.path, r.cost) for r in N.shortest_paths(e, q).collect()}
        assert found == {i: p for i, s, t in requests if (p := plain(s, t))}


@pytest.mark.parametrize(("first", "most"), [(4096, 1 << 18), (8, 40), (2, 3)])
def test_clusters_against_one_by_one(spark, monkeypatch, first, most):
    import random

    from kerbline.operators import stops as S

    monkeypatch.setattr(S, "FIRST", first)
    monkeypatch.setattr(S, "MOST", most)
    random.seed(11)
    points = [(i, round(-34.6 + random.randint(0, 12) * 0.0004, 6), round(-58.4 + random.randint(0, 12) * 0.0004, 6)) for i in random.sample(range(1000), 120)]
    stops = spark.createDataFrame(points, "id long, lat double, lng double")
    close = {(r[0], r[1]) for r in spatial.within_distance(stops, stops, 0.06, "haversine").select("l.id", "r.id").collect()}
    leader = {}
    for x in sorted(p[0] for p in points):
        if x not in leader:
            leader[x] = x
            leader.update((y, x) for y in (p[0] for p in points) if (x, y) in close and y not in leader)
    assert {r.id: r.leader for r in S.cluster(stops, 0.06).collect()} == leader and len(set(leader.values())) < len(leader)
    if first == 4096:
        assert S.cluster(stops.where("id < 0"), 0.06).count() == 0
        odd = stops.limit(1).union(spark.createDataFrame([(None, 1.0, 1.0), (5000, None, 1.0)], stops.schema))
        assert S.cluster(odd, 0.06).count() == 1


def test_clusters_along_a_street_in_few_rounds(spark, monkeypatch):
    from kerbline.operators import stops as S

    written = []
    monkeypatch.setattr(S, "checkpoint", lambda df, plain=S.checkpoint: (written.append(1), plain(df))[1])
    stops = spark.range(10_000).selectExpr("id", "-34.6d AS lat", "-58.4d + id * 0.001d AS lng")  # each is close to the ones before and after it
    found = {r.id: r.leader for r in S.cluster(stops, 0.1).collect()}
    assert found == {i: i - i % 2 for i in range(10_000)}
    assert len(written) <= 5 + 3 * 4


def test_grids_are_components(spark):
    parts = [N.grid(spark, n, n, offset) for n, offset in ((20, 0), (10, 401), (15, 502), (3, 728))]
    edges = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    found = N.components(edges)
    assert sorted(r["count"] for r in found.groupBy("root").count().collect()) == [9, 100, 225, 400]
    assert N.largest_component(edges).count() == 400
    assert N.purge(edges).count() == parts[0].count()
    assert not N.is_connected(edges).first()[0]


def test_a_path_over_a_large_grid(spark):
    edges = N.grid(spark, 100, 200).withColumn("distance", F.lit(1.0))
    request = spark.createDataFrame([(1, 1, [16888])], "request long, start long, targets array<long>")
    assert N.shortest_paths(edges, request).first().cost == (16887 // 200) + 16887 % 200


def test_sidewalks_of_the_prototype(spark):
    near = {1: [2, 4], 2: [1, 3, 5], 3: [2, 5, 6], 4: [1, 5, 7], 5: [2, 3, 4, 6, 8, 9], 6: [3, 5, 9, 10], 7: [4, 8], 8: [5, 7, 9], 9: [5, 6, 8], 10: [6]}
    at = {1: (0, 0), 2: (0, 10), 3: (0, 20), 4: (-10, 0), 5: (-10, 10), 6: (-10, 20), 7: (-20, 0), 8: (-20, 10), 9: (-20, 20), 10: (-10, 30)}
    vertices = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in at.items()], "id long, lat double, lng double")
    edges = spark.createDataFrame([(a, b) for a, x in near.items() for b in x], "vertexStartId long, vertexEndId long")
    corners, walks, crosses = sidewalks.build(vertices, edges, 1.0)
    assert (corners.count(), walks.count(), crosses.count()) == (31, 30, 28)


@pytest.mark.parametrize("mode", ["planar", "haversine"])
def test_distance_join_against_all_pairs(spark, mode):
    points = spark.range(300).select("id", (F.sin(F.col("id") * 12.9) * 0.02 - 34.6).alias("lat"), (F.cos(F.col("id") * 7.3) * 0.02 - 58.4).alias("lng"))
    d = G.haversine_km if mode == "haversine" else (lambda *a: G.planar_radians(*a) * G.EARTH_KM)
    pairs = points.alias("l").join(points.alias("r"), d("l.lat", "l.lng", "r.lat", "r.lng") <= 0.7, "cross")
    found = spatial.within_distance(points, points, 0.7, mode)
    as_set = lambda df: {(r[0], r[1]) for r in df.select("l.id", "r.id").collect()}
    assert as_set(found) == as_set(pairs) and found.count() == len(as_set(pairs))


def test_walking_routes_run_over_every_leg(spark):
    from conftest import DATA
    from kerbline.operators.walk import walk_routes
    from kerbline.plans import registry
    from kerbline.plans.base import Tables
    from kerbline.plans.network import _costed

    t = Tables(spark, DATA)
    legs = t("leg").withColumnRenamed("id", "request")
    every = {r.request for r in walk_routes(legs, t("street_vertex"), _costed(t)).collect()}
    assert any(x % 20 for x in every)
    for name in ("rte-02", "rte-03"):
        assert {r.request for r in registry.queries()[name](spark, DATA).collect()} == every
