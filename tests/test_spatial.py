"""Joins and nearest places anywhere on the globe, against all pairs."""

import math
import random

import pytest

from kerbline.operators import spatial as S


def _km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) * 6371.0


def _globe(n, seed):
    rng = random.Random(seed)
    at = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    at += [(rng.uniform(-0.01, 0.01) + a, b + rng.uniform(-0.01, 0.01)) for a, b in ((0, 179.999), (0, -179.999), (89.99, 10), (-89.995, -170), (60, 180), (-34.6, -58.4)) for _ in range(n // 10)]
    return [(max(-90.0, min(90.0, a)), b) for a, b in at] + [(90.0, 0.0), (90.0, 123.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0), (89.9999, 170.0), (89.9999, -10.0)]


def _frame(spark, at, first=0):
    return spark.createDataFrame([(first + i, *p) for i, p in enumerate(at)], "id long, lat double, lng double")


@pytest.mark.parametrize("km", [0.5, 40.0, 1500.0, 9000.0, 25000.0])
def test_pairs_within_a_distance_on_the_whole_globe(spark, km):
    at = _globe(120, int(km))
    points = _frame(spark, at)
    found = [(r[0], r[1]) for r in S.within_distance(points, points, km, "haversine").select("l.id", "r.id").collect()]
    want = {(i, j) for i, a in enumerate(at) for j, b in enumerate(at) if _km(a, b) <= km}
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("mode", ["planar", "haversine"])
def test_a_distance_join_is_never_broadcast(spark, mode):
    """What Spark takes for a small side has nine rows for each of its own, in the driver if it were broadcast."""
    from kerbline.operators.transit import context

    points = spark.createDataFrame([(i, 0.0, i * 0.001, 1, i, True) for i in range(20)], "id long, lat double, lng double, travelInfoId long, sequence long, isAccessible boolean")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(S.within_distance(points, points, 0.5, mode))
    changes = points.selectExpr("id as fromStopId", "travelInfoId as fromTravelInfoId", "id as toStopId", "travelInfoId as toTravelInfoId")
    joins = plan(context(points, points, changes, [(0.0, 0.0)]))
    assert joins.count("SortMergeJoin") >= 2 and "fromStopId" not in "".join(x for x in joins.splitlines() if "BroadcastHashJoin" in x)


@pytest.mark.parametrize("held, n", [(4, 150), (64, 150), (64, 3)])
def test_nearest_of_all_however_far(spark, monkeypatch, held, n):
    monkeypatch.setattr(S, "HELD", held)
    crowd = [(-34.6 + i * 1e-5, -58.4) for i in range(60)]
    targets, points = _globe(n, 5)[: n + 20] + (crowd if n > 10 else []), _globe(60, 6) + [(10.0, 20.0)] * 3
    got = {r.id: (r.nearest, round(r.distance, 6)) for r in S.nearest_each(_frame(spark, points), _frame(spark, targets, 500)).collect()}
    for i, p in enumerate(points):
        d, j = min((round(_km(p, t), 9), j) for j, t in enumerate(targets))
        assert got[i][1] == pytest.approx(d, abs=2e-6) and (got[i][0] == j + 500 or abs(_km(p, targets[got[i][0] - 500]) - d) < 2e-9)


def test_nearest_of_nothing(spark):
    points, none = _frame(spark, [(1.0, 2.0)]), spark.createDataFrame([], "id long, lat double, lng double")
    assert S.nearest_each(points, none).count() == 0 and S.nearest_each(none, points).count() == 0
    odd = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0), (2, 1.0, 2.0), (None, 0.0, 0.0)], "id long, lat double, lng double")
    assert [tuple(r) for r in S.nearest_each(odd, odd).collect()] == [(2, 2, 0.0)]


def test_followed_links(spark):
    from kerbline.operators.transit import followed

    links = {1: 2, 2: 3, 3: 4, 4: None, 5: 6, 6: 7, 7: 5, 8: 8, 9: 99, 10: 1, **{i: i + 1 for i in range(100, 140)}, 140: None}
    asked = [(1, 1, 3), (2, 1, None), (3, 5, 7), (4, 5, 1), (5, 8, 8), (6, 8, 1), (7, 9, 1), (8, 10, 4), (9, 50, 1), (10, 100, 140), (11, 101, 7), (12, 4, 4)]

    def plain(at, last):
        path = [at]
        while path[-1] != last and links[path[-1]] in links and links[path[-1]] not in path:
            path.append(links[path[-1]])
        return path, path[-1] == last

    got = followed(spark.createDataFrame(list(links.items()), "id long, nextStopId long"), spark.createDataFrame(asked, "request long, first long, last long"))
    assert {r.request: (r.path, r.reached) for r in got.collect()} == {i: plain(a, b) for i, a, b in asked if a in links}
