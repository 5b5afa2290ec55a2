import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from meridian.functions import instructions
from meridian.operators import bundles, tiles, trips
from meridian.sources import geojson, osm, pbf
from meridian.streaming.off_route import off_route_stream

XML = """<osm>
<node id="1" lat="51.0" lon="-114.0"><tag k="name" v="A &amp; B"/><tag k="place" v="town"/></node>
<node id="2" lat="51.1" lon="-114.1"/><node id="3" lat="95" lon="0"/>
<way id="9"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way>
<way id="9"><nd ref="1"/><tag k="highway" v="primary"/></way><way id="8"><nd ref="1"/><nd ref="2"/></way>
</osm>"""


def test_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    nodes = {r["id"]: r["tags"] for r in osm.xml_nodes(spark, str(tmp_path / "a.osm")).collect()}
    assert nodes == {1: {"name": "A & B", "place": "town"}, 2: {}}
    assert [(r["id"], r["refs"], r["tags"]) for r in osm.xml_ways(spark, str(tmp_path / "a.osm")).collect()] == [(9, [1, 2], {"highway": "primary"})]


def test_xml_last_node_counts_and_relations(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="1" lon="1"/><node id="1" lat="2" lon="2"/><relation id="5"><member type="way" ref="9" role="outer"/><member type="node" ref="1" role=""/><tag k="type" v="multipolygon"/></relation></osm>')
    assert [(r["id"], r["lat"]) for r in osm.xml_nodes(spark, str(tmp_path / "a.osm")).collect()] == [(1, 2.0)]
    rel = osm.xml_relations(spark, str(tmp_path / "a.osm"))
    assert [tuple(m) for m in rel.collect()[0]["members"]] == [("way", 9, "outer"), ("node", 1, "")]
    assert [tuple(r) for r in osm.way_members(rel).collect()] == [(5, 0, 9, "outer")]


ENTRY = {"id": "node/-1", "name": "X", "type": "poi", "osm": "amenity/cafe", "lat": 1.0, "lon": 2.0, "importance": 0.25, "alt": []}


def test_gazetteer_first_line_wins(spark, tmp_path):
    lines = [ENTRY, {**ENTRY, "name": "Y"}, {**ENTRY, "id": "way/2", "type": "house", "house": "7b"}]
    (tmp_path / "g.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    got = osm.read_gazetteer(spark, str(tmp_path / "g.jsonl"))
    assert sorted((r["name"], r["cat"], r["rank"]) for r in got.collect()) == [("X", "address", 25.0), ("X", "cafe", 25.0)]
    osm.write_gazetteer(got.drop("cat", "rank"), str(tmp_path / "out"))
    assert osm.read_gazetteer(spark, str(tmp_path / "out")).count() == 2


def test_gazetteer_refuses_bad_lines(spark, tmp_path):
    bad = [{**ENTRY, "id": "bad"}, {**ENTRY, "lat": 91}, {**ENTRY, "importance": 2}, {k: v for k, v in ENTRY.items() if k != "alt"}, {**ENTRY, "city": ["no text"]}, "no json"]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, [ENTRY, *bad])))
    assert osm.rejected_entries(spark, str(tmp_path / "g.jsonl")).count() >= len(bad) - 1
    with pytest.raises(Exception, match="Invalid gazetteer entry"):
        osm.read_gazetteer(spark, str(tmp_path / "g.jsonl")).collect()


# --- PBF, by an encoder of its own ---


def number(n):
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def zig(n):
    return (n << 1) ^ (n >> 63)


def field(k, v):
    return number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v


def deltas(values):
    return b"".join(number(zig(b - a)) for a, b in zip([0, *values], values))


def pbf_file(nodes, ways, relations, dense, compress):
    words = [""]

    def word(s):
        if s not in words:
            words.append(s)
        return words.index(s)

    tags = lambda t: field(2, b"".join(number(word(k)) for k in t)) + field(3, b"".join(number(word(v)) for v in t.values()))
    at = lambda d: round(d * 1e7)
    body = b""
    if dense:
        keys = b"".join(b"".join(number(word(k)) + number(word(v)) for k, v in t.items()) + number(0) for *_, t in nodes)
        body += field(2, field(1, deltas([n[0] for n in nodes])) + field(8, deltas([at(n[1]) for n in nodes])) + field(9, deltas([at(n[2]) for n in nodes])) + field(10, keys))
    else:
        body += b"".join(field(1, field(1, zig(i)) + tags(t) + field(8, zig(at(lat))) + field(9, zig(at(lon)))) for i, lat, lon, t in nodes)
    body += b"".join(field(3, field(1, i) + tags(t) + field(8, deltas(refs))) for i, refs, t in ways)
    kind = ("node", "way", "relation").index
    body += b"".join(field(4, field(1, i) + tags(t) + field(8, b"".join(number(word(r)) for *_, r in m)) + field(9, deltas([ref for _, ref, _ in m])) + field(10, b"".join(number(kind(k)) for k, *_ in m))) for i, m, t in relations)
    data = field(1, b"".join(field(1, w.encode()) for w in words)) + field(2, body)

    def blob(name, content):
        made = field(3, zlib.compress(content)) + field(2, len(content)) if compress else field(1, content)
        head = field(1, name.encode()) + field(3, len(made))
        return struct.pack(">I", len(head)) + head + made

    return blob("OSMHeader", field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes")) + blob("OSMData", data)


def test_pbf_equals_xml(spark, tmp_path):
    nodes = [(1, 51.0, -114.0, {"name": "A & B", "place": "town"}), (-2, 51.1, -114.1, {}), (3, 95.0, 0.0, {}), (1, 51.5, -114.5, {"name": "C"})]
    ways = [(9, [1, -2], {"highway": "primary"}), (9, [1], {"highway": "primary"}), (8, [1, -2], {})]
    relations = [(5, [("way", 9, "outer"), ("node", 1, ""), ("way", 8, "inner")], {"type": "multipolygon"})]
    esc = lambda s: s.replace("&", "&amp;")
    tag = lambda t: "".join(f'<tag k="{k}" v="{esc(v)}"/>' for k, v in t.items())
    xml = "".join(f'<node id="{i}" lat="{a}" lon="{o}">{tag(t)}</node>' for i, a, o, t in nodes) + "".join(f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + tag(t) + "</way>" for i, refs, t in ways)
    xml += "".join(f'<relation id="{i}">' + "".join(f'<member type="{k}" ref="{r}" role="{o}"/>' for k, r, o in m) + tag(t) + "</relation>" for i, m, t in relations)
    (tmp_path / "a.osm").write_text(f"<osm>{xml}</osm>")
    plain = lambda df: sorted(map(str, (r.asDict(True) for r in df.collect())))
    for dense, compress in ((True, True), (False, False)):
        path = tmp_path / f"a{dense}.pbf"
        path.write_bytes(pbf_file(nodes, ways, relations, dense, compress))
        found = pbf.whole_files(spark, str(path), 2)
        assert plain(found.drop("file")) == plain(pbf.elements(spark, str(path)).drop("file"))
        for read, make in ((osm.xml_nodes, pbf.nodes), (osm.xml_ways, pbf.ways), (osm.xml_relations, pbf.relations)):
            assert plain(make(found)) == plain(read(spark, str(tmp_path / "a.osm")))
    (tmp_path / "cut.pbf").write_bytes(path.read_bytes()[:-3])
    with pytest.raises(Exception, match="truncated"):
        pbf.elements(spark, str(tmp_path / "cut.pbf")).count()
    with pytest.raises(Exception, match="truncated"):
        pbf.whole_files(spark, str(tmp_path / "cut.pbf")).count()


def test_pbf_by_ranges_and_boxes(spark, tmp_path):
    """Many blobs in small ranges; filters reach the decoder and change no answer."""
    r = random.Random(8)
    nodes = [(k, round(r.uniform(50, 52), 7), round(r.uniform(-115, -113), 7), {"name": f"n{k}"} if k % 3 == 0 else {}) for k in range(3000)]
    whole = b""
    for lo in range(0, 3000, 150):
        one = pbf_file(nodes[lo : lo + 150], [(lo, [lo, lo + 1], {"highway": "x"})], [], True, True)
        whole += one
    for name in ("a.pbf", "b.pbf", "c.txt"):
        (tmp_path / name).write_bytes(whole)
    found = pbf.elements(spark, f"file://{tmp_path}", 4000)
    assert found.rdd.getNumPartitions() > 10 and found.count() == 2 * 3020 and found.select("file").distinct().count() == 2
    one = pbf.elements(spark, str(tmp_path / "a.pbf"), 4000)
    assert {(x["id"], x["lat"], x["lon"], tuple(x["tags"].items())) for x in one.filter("kind = 'n'").collect()} == {(i, a, o, tuple(t.items())) for i, a, o, t in nodes}
    inside = one.filter("kind IN ('n', 'w') AND lon BETWEEN -114.5 AND -114.0 AND lat > 51.0")
    assert inside.count() == sum(-114.5 <= o <= -114.0 and a > 51.0 for _, a, o, _ in nodes) and one.filter("kind = 'w'").count() == 20 and one.filter("kind = 'x'").count() == 0
    reader = pbf.PbfReader({"path": str(tmp_path / "a.pbf"), "range": "4000"})
    filters = [pbf.In(("kind",), ("n", "w")), pbf.GreaterThanOrEqual(("lon",), -114.5), pbf.LessThanOrEqual(("lon",), -114.0), pbf.GreaterThan(("lat",), 51.0)]
    assert list(reader.pushFilters(filters)) == filters and reader.kinds == "n" and reader.box == [-114.5, 51.0, -114.0, float("inf")]
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == inside.count()
    assert max(p.end - p.start for p in reader.partitions()) < 4000 + max(map(len, (whole[: len(whole) // 20 * 2],)))


def test_odd_blocks():
    """Fields in several parts or unpacked, elements of a history that were deleted."""
    words = field(1, b"".join(field(1, w) for w in (b"", b"k", b"v")))
    info = lambda seen: field(4, number(6 << 3) + number(seen))
    split = number(1 << 3) + number(7) + field(2, number(1)) + field(3, number(2)) + field(8, deltas([5, 9])) + number(8 << 3) + number(zig(-3)) + field(8, number(zig(4)))
    ways = field(3, split + info(1)) + field(3, number(1 << 3) + number(8) + field(8, deltas([1, 2])) + info(0))
    seen = field(5, field(6, bytes([1, 0, 1])))
    dense = field(2, field(1, deltas([1, 2, 3])) + field(8, deltas([10, 20, 30])) + field(9, deltas([1, 2, 3])) + field(10, bytes([1, 2, 0, 1, 2, 0, 0])) + seen)
    single = field(1, number(1 << 3) + number(zig(4)) + number(8 << 3) + number(zig(1)) + number(9 << 3) + number(zig(1)) + info(0))
    got = list(pbf.block(memoryview(words + field(2, dense + single + ways))))
    assert [(e[0], e[1], e[4], e[7]) for e in got] == [("n", 1, None, [("k", "v")]), ("n", 3, None, []), ("w", 7, [5, 9, 6, 10], [("k", "v")])]


def test_blobs_are_bounded(monkeypatch):
    inner = lambda b: memoryview(b)
    assert bytes(pbf.inflated(inner(field(3, zlib.compress(b"abc"))))) == b"abc"
    for k, name in ((4, "lzma"), (6, "lz4"), (7, "zstd")):
        with pytest.raises(ValueError, match=name):
            pbf.inflated(inner(field(k, b"x")))
    with pytest.raises(ValueError, match="truncated"):
        pbf.inflated(inner(field(3, zlib.compress(b"abc" * 100)[:-6])))
    monkeypatch.setattr(pbf, "BLOB_MOST", 1000)
    for bomb in (number(2 << 3) + number(3) + field(3, zlib.compress(bytes(10**6))), number(2 << 3) + number(5000) + field(3, zlib.compress(b"a"))):
        with pytest.raises(ValueError, match="too large"):
            pbf.inflated(inner(bomb))


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1]
    assert pbf.packed(memoryview(b"".join(map(number, values)))).tolist() == values
    assert pbf.signed(pbf.packed(memoryview(b"".join(number(zig(n)) for n in (0, -1, 5, -(2**40)))))).tolist() == [0, -1, 5, -(2**40)]


# --- GeoJSON, bundles, answers of a routing engine ---


def test_geojson(spark, tmp_path):
    rows = spark.createDataFrame([(1, "primary", [(0.0, 1.0), (2.0, 3.0)]), (2, "service", [(0.0, 0.0), (1.0, 1.0)]), (3, "odd", [(0.0, 0.0), (1.0, 1.0)])], "way long, class string, points array<struct<lon:double,lat:double>>")
    got = {r["way"]: json.loads(r["feature"]) for r in geojson.roads(rows, 9).collect()}
    assert set(got) == {1, 3} and got[1] == {"type": "Feature", "properties": {"class": "primary"}, "geometry": {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]}}
    geojson.write(geojson.roads(rows, 20), str(tmp_path / "one"), collection=True)
    whole = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "one")).collect()))
    assert whole["type"] == "FeatureCollection" and [f["properties"]["class"] for f in whole["features"]] == ["primary", "service", "odd"]


FORMATS = {"r.tar": ("routing", "tar/1"), "s.gz": ("search", "lines/1"), "m.tiles": ("basemap", "tiles/3")}


def test_manifests(spark):
    good = {
        "format": "bundle/1", "build": {"id": "b-1", "created": "2026-01-02T03:04:05Z", "packserver": "1", "valhalla": "3"},
        "region": {"name": "R", "bbox": [-1, -2, 3, 4], "counts": {"nodes": 1, "ways": 2, "routable": 0}},
        "inputs": [{"filename": "a", "bytes": 5, "sha256": "a" * 64, "sorted": True, "resorted": False}],
        "artifacts": [{"name": n, "role": r, "format": f, "bytes": 7, "sha256": "b" * 64} for n, (r, f) in FORMATS.items()],
    }
    wrong = [{**good, "format": "x"}, {**good, "region": {**good["region"], "bbox": [3, -2, 1, 4]}}, {**good, "build": {**good["build"], "created": "soon"}}, {**good, "inputs": []}, {**good, "artifacts": good["artifacts"][:2]}, {**good, "artifacts": [*good["artifacts"][:2], {**good["artifacts"][2], "bytes": 0}]}, None]
    rows = spark.createDataFrame([(k, m and json.dumps(m)) for k, m in enumerate([good, *wrong])], "k int, t string")
    got = [r["p"] for r in rows.select("k", bundles.problem(bundles.parsed(F.col("t")), "bundle/1", FORMATS).alias("p")).orderBy("k").collect()]
    assert got == [None, "unsupported or invalid manifest", "invalid region", "invalid build provenance", "invalid input provenance", "artifacts missing", "invalid artifact", "no manifest"]
    listed = spark.createDataFrame([("b", "x", 1, "h"), ("b", "y", 1, "h"), ("b", "z", 1, "h"), ("b", "w", 1, "h"), ("b", "v", 1, "h")], "bundle string, name string, bytes long, sha256 string")
    has = spark.createDataFrame([("b", "x", 1, "h"), ("b", "y", 2, "h"), ("b", "z", 1, "g"), ("b", "u", 1, "h"), ("b", "v", 1, "h"), ("b", "v", 1, "h")], listed.schema)
    assert {(r["name"], r["problem"]) for r in bundles.mismatches(listed, has).collect()} == {("y", "size"), ("z", "checksum"), ("w", "missing"), ("u", "unexpected"), ("v", "twice")}
    regions = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "id string, bytes long")
    assert [r["id"] for r in bundles.victims(regions, 40, 100).collect()] == ["a"] and bundles.victims(regions, 0, 100).count() == 0


def test_trip_answers(spark):
    leg = lambda pts: {"shape": tiles.encode_polyline(pts), "summary": {"length": 2.0, "time": 60.0}, "maneuvers": [{"type": 15, "instruction": " Turn  left. ", "length": 1.5, "begin_shape_index": 1, "sign": {"exit_number_elements": [{"text": "12"}, {"text": "A"}]}}]}
    trip = {"trip": {"units": "kilometers", "summary": {"length": 3.0, "time": 100.0}, "legs": [leg([(0.0, 0.0), (0.1, 0.1)]), leg([(0.1, 0.1), (0.2, 0.3)])]}, "alternatives": [{"trip": {"legs": []}}, {"trip": {"legs": [leg([(0.0, 0.0), (1.0, 1.0)])]}}]}
    found = instructions.trips(spark.createDataFrame([(1, json.dumps(trip)), (2, "{}"), (3, None)], "id int, json string"))
    assert sorted((r["alternate"], r["metres"], r["seconds"], r["units"]) for r in found.collect()) == [(0, 3000.0, 100.0, "km"), (2, 2000.0, 60.0, "km")]
    line = instructions.geometry(found).filter("route.alternate = 0").orderBy("pos").collect()
    assert [(r["lon"], r["lat"]) for r in line] == [(0.0, 0.0), (0.1, 0.1), (0.2, 0.3)]
    step = instructions.steps(found).filter("alternate = 0").first()
    assert (step["icon"], step["major"], step["title"], step["metres"], step["shield"]) == ("left", False, "Turn left.", 1500.0, "12A")
    says = spark.createDataFrame([(400, 154, ""), (429, None, "x"), (400, None, "No path found"), (500, None, "?")], "s int, c int, r string")
    got = [r[0] for r in says.select(instructions.failure_message(F.col("s"), F.col("c"), F.col("r"))).collect()]
    assert got[0] == instructions.LONG_TRIP and got[1] == instructions.BUSY and got[2] == instructions.NO_ROUTE and "HTTP 500" in got[3]
    routes = spark.createDataFrame([(1, 0, 100.0, True), (1, 1, 200.0, False), (2, 0, 100.0, True), (2, 1, 100.0, True), (3, 0, 90.0, True), (3, 1, 60.0, False)], "trip int, k int, seconds double, same boolean")
    assert sorted((r["trip"], r["fastest"], r["slowest"], r["saved"], r["confidence"]) for r in instructions.compared(routes).collect()) == [(1, 0, 1, 100.0, "live"), (2, 0, 0, 0.0, "none"), (3, 1, 0, 30.0, "estimated")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(t, 1000 * k, 80.0 if (k // 5 + t) % 2 else 10.0) for t in range(4) for k in range(30)]
    df = spark.createDataFrame(rows, "trip long, ms long, distance double")
    for part in range(3):
        df.filter(F.floor(F.col("ms") / 10000) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = off_route_stream(stream, 45.0, 3000).writeStream.format("memory").queryName("off_route").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = trips.off_route(df, F.lit(45.0), 3000).select("trip", "ms", "state")
    assert sorted(map(tuple, spark.table("off_route").collect())) == sorted(map(tuple, want.collect()))
