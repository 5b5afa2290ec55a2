"""Routes between nodes, lines, and policies over streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import geo, tags
from meridian.operators import lines, roads, trips
from meridian.streaming import policies


def test_paths_are_cheapest(spark):
    import heapq

    r = random.Random(3)
    edges = [(a, b, float(r.randrange(1, 9))) for a in range(40) for b in r.sample(range(40), 3) if a != b and a < 38] + [(38, 39, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, cost double")
    sources = spark.createDataFrame([(0,), (5,)], "node long")
    tree = roads.shortest_tree(df, roads.shortest_costs(df, sources))
    asked = [(k, s, g) for k, (s, g) in enumerate([(0, 7), (0, 23), (5, 30), (5, 5), (0, 38)])]
    got = {}
    for x in roads.paths(tree, spark.createDataFrame(asked, "route long, source long, goal long")).orderBy("route", "pos").collect():
        got.setdefault(x["route"], []).append((x["node"], x["cost"]))
    links = {}
    for a, b, w in edges:
        links.setdefault(a, {})[b] = min(w, links.get(a, {}).get(b, math.inf))

    def cheapest(s, g):
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            c, a = heapq.heappop(heap)
            for b, w in links.get(a, {}).items():
                if c + w < best.get(b, math.inf):
                    best[b] = c + w
                    heapq.heappush(heap, (c + w, b))
        return best.get(g)

    for k, s, g in asked:
        want = cheapest(s, g)
        if want is None:
            assert k not in got
            continue
        path = got[k]
        assert path[0] == (s, 0.0) and path[-1] == (g, want)
        assert all(links[a][b] == d - c for (a, c), (b, d) in zip(path, path[1:]))
    nodes = spark.createDataFrame([(n, n * 0.01, 0.0) for n in range(40)], "node long, lon double, lat double")
    sums = {x["route"]: x for x in roads.route_summaries(roads.paths(tree, spark.createDataFrame(asked, "route long, source long, goal long")), nodes).collect()}
    assert (sums[3]["metres"], sums[3]["seconds"], sums[3]["points"]) == (0.0, 0.0, 2)


def test_merge_keeps_own_parallels(spark):
    rows = [(0, 1, 1, 2, 1.0, 1), (0, 2, 1, 2, 1.0, 2), (1, 1, 1, 2, 1.0, 2), (1, 1, 3, 4, 1.0, 1)]
    got = roads.merge(spark.createDataFrame(rows, "region int, ord long, src long, dst long, cost double, flags int")).collect()
    assert sorted((x["src"], x["ord"], x["flags"]) for x in got) == [(1, 1, 3), (1, 2, 2), (3, 1, 1)]
    alone = roads.merge(spark.createDataFrame(rows[:2], "region int, ord long, src long, dst long, cost double, flags int")).collect()
    assert sorted((x["ord"], x["flags"]) for x in alone) == [(1, 1), (2, 2)]


def test_traffic_tail_reaches_back(spark):
    line = spark.createDataFrame([(1, p) for p in range(12)] + [(2, p) for p in range(17)] + [(3, p) for p in range(3)] + [(4, 0)], "route long, pos int")
    got = sorted((x["route"], x["first_pos"], x["last_pos"]) for x in trips.bins(line).collect())
    assert got == [(1, 0, 8), (1, 3, 11), (2, 0, 8), (2, 8, 16), (3, 0, 2)]


def test_about_turns_keep_their_side(spark):
    df = spark.createDataFrame([(0.0, 180.0), (0.0, -180.0), (170.0, -170.0), (-170.0, 170.0)], "a double, b double")
    assert [x[0] for x in df.select(geo.signed_turn(F.col("a"), F.col("b"))).collect()] == [180.0, -180.0, 20.0, -20.0]
    assert df.select(geo.distance_bias(F.lit(None).cast("double"))).first()[0] is None


def test_damping(spark):
    df = spark.createDataFrame([(0.0, 90.0, 450.0), (350.0, 10.0, 100.0), (10.0, 20.0, 0.0), (0.0, 180.0, 1000.0)], "a double, b double, ms double")
    got = [x[0] for x in df.select(geo.damp_angle(F.col("a"), F.col("b"), F.col("ms"))).collect()]
    assert got[0] == 45 * 0.45 and abs(got[1] - (350 + 20 * (1 - math.exp(-100 / 450)))) < 1e-9 and got[2] == 10.0 and got[3] == 45.0


@pytest.fixture(scope="module")
def bent(spark):
    """East for about 1.1 km, then north."""
    pts = [(0, 0.0, 0.0), (1, 0.005, 0.0), (2, 0.01, 0.0), (3, 0.01, 0.005), (4, 0.01, 0.01)]
    return spark.createDataFrame([(1, *p) for p in pts] + [(2, 0, 5.0, 5.0)], "route long, pos int, lon double, lat double")


def test_headings_and_vertices(spark, bent):
    asked = spark.createDataFrame([(0, 1, -50.0), (1, 1, 300.0), (2, 1, 1111.95), (3, 1, 9000.0), (4, 2, 1.0)], "id long, route long, metres double")
    got = {x["id"]: x["heading"] for x in lines.heading_along(bent, asked).collect()}
    assert abs(got[0] - 90) < 1e-6 and abs(got[1] - 90) < 1e-6 and abs(got[2] - 45) < 0.5 and abs(got[3]) < 1e-6 and got[4] == 0
    got = {x["id"]: x["pos"] for x in lines.vertex_at(bent, asked).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 4, 4: 0}


def test_simplified_lines_equal_recursion(spark):
    def plain(p, tol):
        if len(p) < 3:
            return p
        a, b = np.array(p[0][1:]), np.array(p[-1][1:])
        d = b - a
        far = []
        for _, *q in p[1:-1]:
            t = min(1, max(0, (np.array(q) - a) @ d / (d @ d))) if d @ d else 0
            far.append(math.hypot(*(np.array(q) - a - t * d)))
        k = int(np.argmax(far)) + 1
        return plain(p[: k + 1], tol)[:-1] + plain(p[k:], tol) if far[k - 1] > tol else [p[0], p[-1]]

    r, rows = random.Random(9), []
    for route in range(6):
        x = y = 0.0
        for pos in range(80 if route else 1):
            rows.append((route, pos, x, y))
            x, y = x + r.random() * 1e-4, y + r.gauss(0, 4e-5)
    df = spark.createDataFrame(rows, "route long, pos int, lon double, lat double")
    want = {(k, p[0]) for k in range(6) for p in plain([x[1:] for x in rows if x[0] == k], 4 / geo.M_PER_DEG)}
    assert {(x["route"], x["pos"]) for x in lines.simplified(df, 4.0).collect()} == want
    same = lines.same_lines(df, df.withColumn("lon", F.when(F.col("route") == 2, F.col("lon") + 1e-4).otherwise(F.col("lon"))).filter("NOT (route = 3 AND pos = 79)"))
    assert {x["route"]: x["same"] for x in same.collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_clipping(spark):
    line = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(-5, 5), (5, 5), (5, 15), (8, 15), (8, 2), (20, 2)])] + [(2, 0, 20.0, 20.0), (2, 1, 30.0, 20.0)], "route long, pos int, x double, y double")
    got = {}
    for x in lines.clipped(line, 0, 0, 10, 10).orderBy("route", "part", "pos").collect():
        got.setdefault((x["route"], x["part"]), []).append((x["x"], x["y"]))
    assert got == {(1, 0): [(0, 5), (5, 5), (5, 10)], (1, 1): [(8, 10), (8, 2), (10, 2)]}
    ring = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(-5, -5), (5, -5), (5, 5), (-5, 5)])], "route long, pos int, x double, y double")
    assert {(x["x"], x["y"]) for x in lines.clipped_rings(ring, 0, 0, 10, 10).collect()} == {(0, 0), (5, 0), (5, 5), (0, 5)}
    assert lines.clipped_rings(ring, 20, 20, 30, 30).count() == 0


def test_winding(spark):
    ring = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    rows = [(1, k, x, y, True) for k, (x, y) in enumerate(ring)] + [(2, k, x, y, True) for k, (x, y) in enumerate(ring[::-1])] + [(3, k, x, y, False) for k, (x, y) in enumerate(ring)] + [(4, k, x, y, True) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1)])]
    got = {}
    for x in lines.wound(spark.createDataFrame(rows, "route long, pos int, x long, y long, outer boolean")).orderBy("route", "pos").collect():
        got.setdefault(x["route"], []).append((x["x"], x["y"]))
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))
    assert set(got) == {1, 2, 3} and [area(got[k]) for k in (1, 2, 3)] == [32, 32, -32] and all(len(v) == 4 for v in got.values())


def test_regions_and_plans(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 1.1, 0.0, 2.0, 1.0), ("c", 0.0, 0.0, 3.0, 3.0), ("d", 9.0, 9.0, 9.5, 9.5)], "region string, west double, south double, east double, north double")
    asked = spark.createDataFrame([(1, 0.5, 0.5, 0.6, 0.6), (2, 0.5, 0.5, 1.5, 0.5), (3, 0.5, 0.5, 9.2, 9.2), (4, 0.5, 0.5, 7.0, 7.0)], "trip long, from_lon double, from_lat double, to_lon double, to_lat double")
    got = {x["trip"]: (x["plan"], x["regions"]) for x in roads.region_plans(asked, boxes).collect()}
    assert got == {1: ("single", ["a"]), 2: ("single", ["c"]), 3: ("merged", ["a", "c", "d"]), 4: (None, None)}
    assert {tuple(x) for x in roads.adjacent(boxes, 0.2).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    lists = spark.createDataFrame([(["x"], ["l", "x", "r"], ["r"])], "h array<string>, t array<string>, b array<string>")
    assert lists.select(roads.plan_list(F.col("h"), F.col("t"), F.col("b"))).first()[0] == ["x", "l"]


def test_labels_and_alternates(spark):
    df = spark.createDataFrame([("town", "place/town", None), ("poi", "amenity/fast_food", "R"), ("cafe", None, "R"), ("house", None, None)], "kind string, osm string, region string")
    got = [(x["t"]["label"], x["t"]["icon"], x["c"]) for x in df.withColumn("t", tags.search_type(F.col("kind"), F.col("osm"))).withColumn("c", tags.search_context(F.col("t.label"), F.lit("X"), F.lit("X"), F.lit(None).cast("string"), F.col("region"))).collect()]
    assert got == [("Town", "city", "Town · X"), ("Fast food", "poi", "Fast food · X"), ("Cafe", "poi", "Cafe · X"), ("Address", "address", "Address · X")]
    t = spark.createDataFrame([({"name": "A", "name:fr": "B;A", "ref": "7", "alt_name": "B", "note": "z"},)], "t map<string,string>")
    assert t.select(tags.alternates(F.col("t"), F.lit("A")), F.map_keys(tags.node_tags(F.col("t"))), tags.interesting(F.col("t"))).first()[:] == (["7", "B"], ["name"], True)


def streamed(spark, df, make, tmp_path, name):
    for part in range(2):
        df.filter(F.col("ms") % 2 == F.col("ms") % 2).filter((F.col("ms") >= 500) == bool(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(t, 10 * k + t, r.choice([10.0, 90.0]), float(r.randrange(1000)), r.choice(["left", "right"])) for t in range(3) for k in range(100)]
    df = spark.createDataFrame(rows, "trip long, ms long, distance double, along double, instruction string")
    got = streamed(spark, df, lambda s: policies.progress(s, 45.0), tmp_path / "a", "progress_rows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trips.progress(df, F.lit(45.0)).select("trip", "ms", "placed").collect()))
    spoken = df.withColumnRenamed("along", "metres")
    got = streamed(spark, spoken, policies.announcements, tmp_path / "b", "spoken_rows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trips.announcements(spoken).select("trip", "ms", "instruction", "band").collect()))


def test_late_answers_are_dropped(spark, tmp_path):
    rows = [(1, 1, "begin", None), (1, 2, "answer", 1), (1, 3, "begin", None), (1, 4, "answer", 1), (1, 600, "answer", 2), (1, 601, "cancel", None), (1, 602, "answer", 2)]
    got = streamed(spark, spark.createDataFrame(rows, "key long, ms long, kind string, token long"), policies.live_answers, tmp_path, "live_rows")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1), (1, 600, 2)]


def test_reroute_policy():
    from types import SimpleNamespace

    state, nan = (False, 0, -1, float("nan"), float("nan"), ""), float("nan")
    said = []
    for ms, kind, on, x, reason in [
        (0, "fix", "on", 0.0, None), (1000, "fix", "suspect", 0.0, None), (2000, "fix", "off", 0.0, None), (2001, "begin", None, nan, None), (3000, "fix", "off", 5.0, None),
        (4000, "failed", None, nan, "busy"), (5000, "fix", "off", 50.0, None), (6000, "fix", "suspect", 50.0, None), (34000, "fix", "off", 60.0, None), (34001, "begin", None, nan, None), (35000, "failed", None, nan, None),
        (94000, "fix", "off", 60.0, None), (95000, "fix", "off", 60.0, None), (95001, "begin", None, nan, None), (96000, "done", None, 60.0, None), (99000, "fix", "off", 65.0, None), (100000, "fix", "off", 90.0, None), (126000, "fix", "off", 90.0, None),
    ]:
        state, row = policies.reroute_step(state, SimpleNamespace(trip=1, ms=ms, kind=kind, state=on, x=x, y=0.0 if x == x else nan, reason=reason))
        said.append(row[2:])
    assert [s[0] for s in said] == ["idle", "suspect", "rerouting", "rerouting", "rerouting", "failed", "failed", "suspect", "rerouting", "rerouting", "failed", "failed", "rerouting", "rerouting", "idle", "suspect", "suspect", "rerouting"]
    assert [k for k, s in enumerate(said) if s[1]] == [2, 8, 12, 17] and said[6][2] == "busy" and said[7][2] == "busy" and said[15][2] == "waiting for a position update" and said[16][2] == "settling"


def test_reroutes_as_a_stream(spark, tmp_path):
    rows = [(1, 0, "fix", "off", 0.0, 0.0, None), (1, 1, "begin", None, None, None, None), (1, 600, "failed", None, None, None, "no road"), (1, 700, "fix", "off", 100.0, 0.0, None)]
    got = streamed(spark, spark.createDataFrame(rows, "trip long, ms long, kind string, state string, x double, y double, reason string"), policies.reroutes, tmp_path, "reroute_rows")
    assert [tuple(x)[1:] for x in sorted(got.collect(), key=lambda x: x["ms"])] == [(0, "rerouting", True, None), (1, "rerouting", False, None), (600, "failed", False, "no road"), (700, "failed", False, "no road")]


def decoded(data):
    """{layer: (extent, [(polygon, class, name, paths)])} of a vector tile, by the format's own rules."""
    from meridian.sources.pbf import fields, packed

    found = {}
    for k, layer in fields(memoryview(data)):
        parts = [(n, v) for n, v in fields(layer)]
        keys = [bytes(v).decode() for n, v in parts if n == 3]
        values = [bytes(dict(fields(v))[1]).decode() for n, v in parts if n == 4]
        assert dict(parts)[15] == 2
        features = []
        for n, v in parts:
            if n != 2:
                continue
            f = dict(fields(v))
            tags = packed(f[2]).tolist()
            said = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}
            nums, at, x, y, paths = packed(f[4]).tolist(), 0, 0, 0, []
            while at < len(nums):
                kind, count = nums[at] & 7, nums[at] >> 3
                at += 1
                if kind == 7:
                    continue
                for _ in range(count):
                    dx, dy = ((w >> 1) ^ -(w & 1) for w in nums[at : at + 2])
                    x, y, at = x + dx, y + dy, at + 2
                    paths.append([(x, y)]) if kind == 1 else paths[-1].append((x, y))
            features.append((f[3] == 3, said.get("class"), said.get("name"), paths))
        found[bytes(dict(parts)[1]).decode()] = (dict(parts)[5], features)
    return found


def test_vector_tiles_read_back(spark):
    from meridian.operators import tiles

    outer, hole, line = [(0, 0), (40, 0), (40, 40)], [(20, 5), (30, 15), (30, 5)], [(-3, 7), (5000, 9), (1, 1)]
    rows = [(7, "roads", 2, "primary", "Main", [line], False), (7, "roads", 1, "service", None, [line[:2], line[1:], line[:1]], False), (7, "green", 1, "park", "", [outer, hole], True), (9, "green", 1, "park", "primary", [outer], True)]
    df = spark.createDataFrame(rows, "tile_id long, layer string, seq long, class string, name string, paths array<array<struct<x:int,y:int>>>, polygon boolean")
    got = {r["tile_id"]: decoded(bytes(r["data"])) for r in tiles.encode_tiles(df).collect()}
    assert got == {
        7: {"green": (4096, [(True, "park", None, [outer, hole])]), "roads": (4096, [(False, "service", None, [line[:2], line[1:]]), (False, "primary", "Main", [line])])},
        9: {"green": (4096, [(True, "park", "primary", [outer])])},
    }


def test_vertices_are_asked_by_stretch(spark):
    line = spark.createDataFrame([(1, k, k * 0.001, 0.0) for k in range(400)], "route long, pos int, lon double, lat double")
    asked = spark.createDataFrame([(k, 1, k * 50.0) for k in range(1000)], "id long, route long, metres double")
    found = lines.vertex_at(line, asked)
    assert "stretch" in found._jdf.queryExecution().optimizedPlan().toString()
    step = geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0))
    metres = spark.range(1).select(step).first()[0]
    assert all(r["pos"] == min(399, int(r["id"] * 50.0 / metres + 0.5)) for r in found.collect())


def test_tree_summaries_equal_those_of_paths(spark):
    r = random.Random(5)
    edges = spark.createDataFrame([(a, b, float(r.randrange(1, 9))) for a in range(60) for b in (a + 1, r.randrange(60)) if a != b and b < 58], "src long, dst long, cost double")
    tree = roads.shortest_tree(edges, roads.shortest_costs(edges, spark.createDataFrame([(0,), (9,)], "node long")))
    asked = spark.createDataFrame([(k, s, g) for k, (s, g) in enumerate([(0, 0), (0, 57), (0, 31), (9, 9), (9, 12), (9, 40), (0, 59)])], "route long, source long, goal long")
    nodes = spark.createDataFrame([(n, n * 0.01, n % 7 * 0.01) for n in range(60)], "node long, lon double, lat double")
    show = lambda df: sorted((x["route"], round(x["metres"], 6), x["seconds"], x["points"]) for x in df.collect())
    got = show(roads.tree_summaries(tree, asked, nodes))
    assert got == show(roads.route_summaries(roads.paths(tree, asked), nodes)) and len(got) == 6
