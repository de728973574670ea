import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbline.functions import geo as G


def test_known_distance(spark):
    km = spark.range(1).select(G.haversine_km(-34.615478, -58.399380, -34.574790, -58.493783)).first()[0]
    assert km == pytest.approx(9.753846675336623, abs=1e-10)


@pytest.mark.parametrize("exact", [True, False])
def test_eight_angles(spark, exact):
    ends = [(0, 0), (-3, 0), (-3, -3), (3, -3), (0, 3), (0, -3), (3, 3), (3, 0)]
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ends)], "i int, lat double, lng double")
    got = [r[0] for r in rows.orderBy("i").select(F.degrees(G.angle_to(0.0, 0.0, "lat", "lng", exact))).collect()]
    assert got == pytest.approx([0, 270, 225, 135, 0, 180, 45, 90])


def test_lines(spark):
    v = ("x1", "y1", "x2", "y2")
    row = spark.range(1).select(*[F.lit(float(x)).alias(c) for c, x in zip(v, (0, 0, 1, 1), strict=True)])
    line = G.line(*v)
    p = row.select(G.perpendicular(line, 2.0).alias("p"), G.moved_line(line, 1.0, True).alias("u"), G.moved_line(line, 1.0, False).alias("d"), G.point_along(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), 2.0).alias("q"), G.compare_parallels(G.moved_line(line, 1.0, True), G.moved_line(line, 1.0, False)).alias("c")).first()
    assert (p.p.slope, p.p.intercept, p.u.intercept, p.d.intercept, p.q.x, p.q.y, p.c) == (-1, 4, 1, -1, 2, 0, 1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-5000, 5000)] * 2), min_size=1, max_size=30))
def test_parallel_vectors_keep_slope_and_distance(spark, ends):
    ends = [(x, y) for x, y in ends if math.hypot(x, y) > 1e-3]
    if not ends:
        return
    rows = spark.createDataFrame(ends, "x double, y double")
    got = rows.select("x", "y", G.parallel_vector(0.0, 0.0, "x", "y", 1.0, True).alias("p")).collect()
    for r in got:
        assert math.hypot(r.p.x1, r.p.y1) == pytest.approx(1)
        assert (r.p.x2 - r.p.x1, r.p.y2 - r.p.y1) == pytest.approx((r.x, r.y), abs=1e-6)
        assert r.x * r.p.y1 - r.y * r.p.x1 > 0  # to the left


@pytest.mark.parametrize("lat,lng,km,crosses", [(0.0, 179.9, 50.0, True), (0.0, 0.0, 50.0, False), (89.9, 10.0, 50.0, False)])
def test_boxes(spark, lat, lng, km, crosses):
    box = spark.range(1).select(G.bounding_box(lat, lng, km).alias("b")).first().b
    assert tuple(box) == pytest.approx(G.box_of(lat, lng, km)) and box.crosses == crosses
    with pytest.raises(ValueError):
        G.box_of(lat, lng, -1)


def test_radius_is_checked():
    import pytest

    from kerbline.operators.spatial import checked_radius

    assert checked_radius(0.5, 1.0) == 0.5
    for bad in (-0.1, 1.5):
        with pytest.raises(ValueError):
            checked_radius(bad, 1.0)
