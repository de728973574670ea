from kerbline.operators.tables import dense_ids, upsert
from kerbline.sources import osm, ramps
from kerbline.sources.snapshots import Snapshots
from kerbline.streaming.updates import follow

XML = """<osm><node id="1" lat="-34.6" lon="-58.4" uid="1" user="a" timestamp="2016-01-01T00:00:00Z" changeset="1" version="1" visible="true"><tag k="highway" v="bus_stop"/></node>
<node id="2" lat="-34.61" lon="-58.4" visible="true"/><node id="3" lat="-34.62" lon="-58.4"/><node id="4" lat="-34.61" lon="-58.41"/>
<way id="10" visible="true"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/></way>
<way id="11"><nd ref="2"/><nd ref="4"/><tag k="highway" v="residential"/><tag k="oneway" v="yes"/><tag k="foot" v="no"/></way>
<way id="12"><nd ref="2"/><nd ref="9"/><tag k="highway" v="residential"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><tag k="type" v="multipolygon"/><tag k="highway" v="x"/></relation></osm>"""


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    path = str(tmp_path / "a.osm")
    assert {r.id: (r.visible, r.tags) for r in osm.nodes(spark, path).collect()}[1] == (True, {"highway": "bus_stop"})
    assert {r.id: r.nodeIds for r in osm.ways(spark, path).collect()} == {10: [1, 2, 3], 11: [2, 4], 12: [2, 9]}
    assert osm.chosen_relations(osm.relations(spark, path)).collect() == [(20, 10, "outer")]
    vertices, edges = osm.street_graph(spark, path)
    assert {(r.vertexStartId, r.vertexEndId) for r in edges.collect()} == {(1, 2), (2, 1), (2, 3), (3, 2), (2, 4)}
    assert {r.id for r in vertices.collect()} == {1, 2, 3, 4}


def test_areas_cut_the_streets_through_their_rings(spark, tmp_path):
    ring = '<way id="40"><nd ref="2"/><nd ref="5"/><nd ref="6"/><nd ref="2"/><tag k="amenity" v="parking"/><tag k="park_ride" v="yes"/></way>'
    long_ = '<osm>' + "".join(f'<node id="{i}" lat="{i}" lon="{i}"/>' for i in range(1, 7)) + '<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/></way>%s</osm>'
    for extra, expected in (("", {(1, 3), (3, 1)}), (ring, {(1, 2), (2, 1), (2, 3), (3, 2)})):
        (tmp_path / f"{len(extra)}.osm").write_text(long_ % extra)
        _, edges = osm.street_graph(spark, str(tmp_path / f"{len(extra)}.osm"))
        assert {(r.vertexStartId, r.vertexEndId) for r in edges.collect()} == expected


def test_streets_take_tags_and_rings_of_areas(spark, tmp_path):
    """Outermost rings alone cut streets, nodes and relations of a way's number are no ways, parking ways take a highway, nodes at one place are one."""
    at = {1: (0, 0), 2: (0, 1), 3: (0, 2), 4: (0, 3), 5: (0, 4), 21: (-9, 1), 22: (9, 1), 23: (9, 30), 24: (-9, 30), 31: (0, 2), 32: (-1, 3), 33: (1, 4), 41: (50, 50), 42: (50, 51)}
    xml = "".join(f'<node id="{i}" lat="{a}" lon="{b}"/>' for i, (a, b) in at.items())
    way = lambda i, refs, **tags: f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in tags.items()) + "</way>"
    # 10 is a street past the big ring 50 (which shares node 2) and the ring 51 in it (which shares node 4); node 31 lies where node 3 does
    xml += way(10, [1, 2, 3, 31, 4, 5], highway="residential") + way(50, [2, 21, 24, 23, 22, 2]) + way(51, [4, 32, 33, 4]) + way(60, [41, 42], park_ride="yes", amenity="parking")
    member = lambda kind, ref, role: f'<member type="{kind}" ref="{ref}" role="{role}"/>'
    area = '<tag k="type" v="multipolygon"/><tag k="highway" v="pedestrian"/></relation>'
    xml += f'<relation id="70">{member("way", 50, "outer")}{member("way", 51, "outer")}{member("node", 10, "outer")}{area}<relation id="71">{member("way", 60, "outer")}{area}'
    (tmp_path / "a.osm").write_text(f"<osm>{xml}</osm>")
    vertices, edges = osm.street_graph(spark, str(tmp_path / "a.osm"))
    both = lambda *pairs: {x for a, b in pairs for x in ((a, b), (b, a))}
    assert {(r.vertexStartId, r.vertexEndId) for r in edges.collect()} == both((1, 2), (2, 5), (41, 42))
    assert {r.id for r in vertices.collect()} == {1, 2, 5, 41, 42}


def test_graph_file(spark, tmp_path):
    from kerbline.sources import graph_json

    edge = '{"id": 5, "name": "A", "distance": 12.5, "stairs": false, "wheelchairAccessible": true, "startOsmNodeId": %d, "endOsmNodeId": %d, "trip": null}'
    (tmp_path / "g.json").write_text('[{"index": 0, "label": "v", "x": -58.4, "y": -34.6, "nodeId": 7, "outgoingStreetEdges": [%s], "incomingStreetEdges": []},\n {"index": 1, "nodeId": 8, "x": 1, "y": 2, "outgoingStreetEdges": [%s, %s]}]' % (edge % (7, 8), edge % (8, 7), edge % (8, 9)))
    found = graph_json.vertices(spark, str(tmp_path / "g.json"))
    assert {(r.vertexStartId, r.vertexEndId, r.distance) for r in graph_json.edges(found).collect()} == {(7, 8, 12.5), (8, 7, 12.5), (8, 9, 12.5)}
    assert {tuple(r) for r in graph_json.places(found).collect()} == {(7, -34.6, -58.4), (8, 2.0, 1.0)}


def test_jobs_save_the_largest_part(spark, tmp_path):
    from kerbline.sources import jobs

    more = XML.replace("</osm>", '<node id="5" lat="-34.7" lon="-58.5"/><node id="6" lat="-34.71" lon="-58.5"/><way id="30"><nd ref="5"/><nd ref="6"/><tag k="highway" v="residential"/></way></osm>')
    (tmp_path / "a.osm").write_text(more)
    built = jobs.build_streets(spark, str(tmp_path / "a.osm"), str(tmp_path / "streets"))
    assert {(r.vertexStartId, r.vertexEndId) for r in built["edge"].collect()} == {(1, 2), (2, 1), (2, 3), (3, 2), (2, 4)} and {r.id for r in built["vertex"].collect()} == {1, 2, 3, 4}
    assert spark.read.parquet(str(tmp_path / "streets/edge")).count() == 5
    near = {1: [2, 4], 2: [1, 3, 5], 3: [2, 5, 6], 4: [1, 5, 7], 5: [2, 3, 4, 6, 8, 9], 6: [3, 5, 9, 10], 7: [4, 8], 8: [5, 7, 9], 9: [5, 6, 8], 10: [6], 11: [12], 12: [11, 13], 13: [12]}
    at = {1: (0, 0), 2: (0, 10), 3: (0, 20), 4: (-10, 0), 5: (-10, 10), 6: (-10, 20), 7: (-20, 0), 8: (-20, 10), 9: (-20, 20), 10: (-10, 30), 11: (-50, 40), 12: (-50, 50), 13: (-50, 60)}
    vertices = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in at.items()], "id long, lat double, lng double")
    edges = spark.createDataFrame([(a, b) for a, x in near.items() for b in x], "vertexStartId long, vertexEndId long")
    walks = jobs.build_sidewalks(spark, vertices, edges, 1.0)
    assert (walks["sidewalk"].count(), walks["crossing"].count()) == (30, 28)  # fixed values of the prototype after purging


def test_ramps_are_loaded_and_moved(spark, tmp_path):
    from kerbline.sources import jobs

    (tmp_path / "a.csv").write_text("geo;a;b;c;d;street\nPOINT (-58.4 -34.6);1;2;3;4;Rivadavia\n")
    (tmp_path / "b.csv").write_text("lng;lat;street\n-58.5;-34.7;Callao\n")
    loaded = jobs.load_ramps(spark, [str(tmp_path / "a.csv")], [str(tmp_path / "b.csv")])
    assert {(r.id, r.address) for r in loaded.collect()} == {(1, "Callao"), (2, "Rivadavia")}
    crossings = spark.createDataFrame([(1, 1, 2, None, None), (2, 1, 3, None, None)], "id long, vertexStartId long, vertexEndId long, rampStartId long, rampEndId long")
    vertices = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 10.0), (3, 10.0, 0.0)], "id long, lat double, lng double")
    lines = spark.createDataFrame([(0, 2, 1, 1)], "line long, rampId long, vertexId long, crossingId long")
    done = jobs.associate_and_move(spark, crossings, vertices, lines)
    assert {(r.id, r.rampStartId) for r in done["crossing"].collect()} == {(1, 2), (2, None)} and [r.id for r in done["ramp"].collect()] == [2]


def test_reload_tries_again(spark, tmp_path):
    shot, calls = Snapshots(spark, str(tmp_path / "s")), []

    def build():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not there yet")
        return spark.range(4)

    assert shot.reload(build, attempts=3, wait=0.0) == 1 and len(calls) == 3 and shot.read().count() == 4
    calls.clear()
    try:
        Snapshots(spark, str(tmp_path / "t")).reload(build, attempts=2, wait=0.0)
    except OSError:
        assert len(calls) == 2
    else:
        raise AssertionError("no failure was passed on")


def test_rings_of_relations(spark):
    member = spark.createDataFrame([(1, 10, "outer"), (1, 11, "inner"), (2, 10, "outer"), (2, 99, "outer")], "id long, wayId long, role string")
    way = spark.createDataFrame([(10, [1, 2, 3, 1]), (11, [1, 2])], "id long, nodeIds array<long>")
    node = spark.createDataFrame([(i, float(i), -float(i)) for i in (1, 2, 3)], "id long, lat double, lng double")
    assert {(r.id, r.wayId) for r in osm.resolved(member, way).collect()} == {(1, 10), (1, 11)}
    (ring,) = osm.rings(member, way, node).collect()
    assert (ring.id, ring.wayId, [tuple(p) for p in ring.ring]) == (1, 10, [(1.0, -1.0), (2.0, -2.0), (3.0, -3.0), (1.0, -1.0)])


def test_ramp_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("geo;a;b;c;d;street\nPOINT (-58.4 -34.6);1;2;3;4;Rivadavia\n")
    (tmp_path / "b.csv").write_text("lng;lat;street\n-58.5;-34.7;Callao\n")
    (tmp_path / "c.txt").write_text("1,2,3\n4,5,6\n")
    both = ramps.concat([ramps.read_points(spark, str(tmp_path / "a.csv")), ramps.read_plain(spark, str(tmp_path / "b.csv"))])
    assert {tuple(r) for r in both.collect()} == {(-34.6, -58.4, "Rivadavia"), (-34.7, -58.5, "Callao")}
    assert ramps.read_associations(spark, str(tmp_path / "c.txt")).count() == 2


def test_snapshots_and_updates(spark, tmp_path):
    shot = Snapshots(spark, str(tmp_path / "s"))
    stops = spark.createDataFrame([(i, True) for i in range(10)], "id long, isAccessible boolean")
    assert shot.save(stops) == 1 and shot.is_fresh(60)
    try:
        shot.save(stops.limit(3))
    except ValueError:
        pass
    else:
        raise AssertionError("a shrunken version was taken")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":3,"isAccessible":false,"at":"2020-01-01T00:00:00"}\n{"id":4,"isAccessible":true,"at":"2020-01-01T00:00:00"}\n')
    follow(spark, str(tmp_path / "in"), shot, str(tmp_path / "c")).awaitTermination(120)
    assert [r.id for r in shot.read().where("not isAccessible").collect()] == [3]


def test_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    changed = upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), ["id"])
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    ids = dense_ids(spark.range(1000).withColumnRenamed("id", "k"), ["k"])
    assert ids.where("id = k + 1").count() == 1000
