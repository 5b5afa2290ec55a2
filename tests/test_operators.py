import math
import random

import pytest
from pyspark.sql import functions as F

from meridian.functions import geo, tags, text
from meridian.operators import admission, roads, search, tiles, trips


def test_formats(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (1250.0,), (9999.0,), (250000.0,), (float("nan"),)], "m double")
    got = [tuple(r) for r in df.select(geo.format_distance(F.col("m")), geo.format_distance(F.col("m"), "imperial"), geo.format_duration(F.col("m"))).collect()]
    assert got[0] == ("0 m", "0 ft", "<1 min") and got[1][0] == "5 m" and got[2][0] == "1.3 km" and got[5] == ("—", "—", "—")
    assert got[4] == ("250 km", "155 mi", "69 hr 27 min")


def test_angles(spark):
    df = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (0.0, 180.0)], "a double, b double")
    assert [r[0] for r in df.select(geo.angle_delta(F.col("a"), F.col("b"))).collect()] == [20.0, -20.0, 180.0]
    kinds = spark.createDataFrame([(d,) for d in (10.0, -20.0, 50.0, -120.0, 170.0)], "d double").select(geo.turn_kind(F.col("d")))
    assert [r[0] for r in kinds.collect()] == [None, "slight-left", "right", "sharp-left", "uturn-right"]


def test_box_crosses_antimeridian(spark):
    df = spark.createDataFrame([(179.5, 0.0), (-179.5, 0.0), (0.0, 0.0)], "lon double, lat double")
    assert [r[0] for r in df.select(geo.in_box(F.col("lon"), F.col("lat"), 179.0, -1.0, -179.0, 1.0)).collect()] == [True, True, False]


def test_speed_and_flags(spark):
    rows = [({"highway": "motorway", "maxspeed": "80 mph", "oneway": "-1"},), ({"highway": "primary", "access": "private"},), ({"highway": "footway"},), ({},)]
    df = spark.createDataFrame(rows, "tags map<string,string>").select(tags.speed(F.col("tags")), tags.oneway_flags(F.col("tags")))
    assert [tuple(r) for r in df.collect()] == [(80, 2), (0, 3), (0, 3), (0, 3)]


def test_edit_distance_counts_swaps():
    assert text.edit_distance("musuem", "museum") == 1 and text.edit_distance("ca", "abc") == 3 and text.edit_distance("abcdef", "z", 2) == 3


def test_scores():
    assert text.score_name("main street", "main street") == 1000
    assert text.score_name("main", "main street") == 793
    assert text.score_name("street main", "main street") == 620 - 0 - 0
    assert text.score_name("zzz", "main") is None


def test_fold(spark):
    df = spark.createDataFrame([("Café d'Été & Co.",), ("  A--B  ",), (None,)], "t string").select(text.fold(F.col("t")))
    assert [r[0] for r in df.collect()] == ["cafe dete and co", "a b", None]


def test_index_equals_scan(spark):
    r = random.Random(42)
    words = ["north", "lake", "main", "street", "st", "albert", "museum", "park", "12", "avenue"]
    names = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 3))), 0.0, 0.0, 0.0) for i in range(200)]
    gaz = spark.createDataFrame(names, "id long, name string, rank double, lon double, lat double")
    asked = ["musuem", "lake st", "st albert", "main 12", "par"]
    got = search.search(gaz, spark.createDataFrame([(q,) for q in asked], "q string"), 500).select("q", "id", "score").collect()
    want = {(q, i, s) for q in asked for i, n, *_ in names if (s := text.score_name(q, n)) is not None}
    assert {tuple(x) for x in got} == want


def test_suggest(spark):
    names = spark.createDataFrame([("Edmonton", 5.0), ("Calgary", 9.0)], "name string, rank double")
    got = search.suggest(names, spark.createDataFrame([("calgray",), ("edmnton",), ("xx",)], "q string")).collect()
    assert {tuple(x) for x in got} == {("calgray", "Calgary", 1), ("edmnton", "Edmonton", 1), ("xx", None, None)}
    ties = spark.createDataFrame([("Calgary", 9.0, 1.0, 1.0), ("Calgari", 9.0, 0.0, 0.0)], "name string, rank double, lon double, lat double")
    got = search.suggest(ties, spark.createDataFrame([("calgarx",), ("ca",)], "q string"), near=(0.0, 0.0)).collect()
    assert {tuple(x) for x in got} == {("calgarx", "Calgari", 1), ("ca", None, None)}


def test_search_by_alternates_houses_and_importance(spark):
    rows = [(1, "Main Street 123", 5.0, None, None, 0.5, "Main Street", "123"), (2, "Main Street", 5.0, ["Rue Principale"], None, None, None, None), (3, "Oak Street 123", 5.0, None, None, 2.0, "Oak Street", "123"), (4, "Principal Road", 1.0, [], None, None, None, None)]
    gaz = spark.createDataFrame(rows, "id long, name string, rank double, alt array<string>, lon double, importance double, street string, house string").withColumn("lat", F.lit(None).cast("double"))
    got = search.search(gaz, spark.createDataFrame([("123 main",), ("123",), ("rue principale",), ("principal",)], "q string"), near=(0.0, 0.0)).collect()
    best = {(r["q"], r["place"]): (r["id"], r["score"]) for r in got}
    assert best["123 main", 1] == (1, 930.0 - 2 * 0 + 50)
    assert best["123", 1] == (3, 1000.0) and best["123", 2] == (1, 950.0)
    assert best["rue principale", 1] == (2, 1005.0) and best["principal", 1] == (4, 796.0)


def test_vocabulary_matches_equal_every_pair(spark):
    import random

    from meridian.functions.text import match

    r = random.Random(5)
    words = ["street", "st", "saint", "a", "ab", "north", "n", "12", "x" * 30, "x" * 28 + "yx"] + ["".join(r.choices("abcs", k=r.randrange(1, 9))) for _ in range(250)]
    asked = words[::3] + ["stret", "sr", "nroth"]
    frame = lambda c, ws: spark.createDataFrame([(w,) for w in ws], f"{c} string")
    got = {tuple(x) for x in search.vocabulary_matches(frame("token", words), frame("qtok", asked)).collect()}
    assert got == {(q, t) for q in asked for t in words if match(q, t)}


def test_highlights(spark):
    rows = [("Main Street", "st"), ("Saint Mary", "st mar"), ("Restaurant", "st"), ("Calgary", "calgry"), ("Élan Café", "cafe"), ("A b", "a")]
    got = [[tuple(x) for x in r["ranges"]] for r in search.highlights(spark.createDataFrame(rows, "label string, q string")).collect()]
    assert got == [[(5, 11)], [(0, 5), (6, 9)], [], [(0, 4)], [(5, 8)], []]


def test_runs_split_at_missing_nodes(spark):
    refs = spark.createDataFrame([(1, p, n) for p, n in enumerate([1, 2, 999, 3, 4, 999, 5])], "way long, pos int, node long")
    nodes = spark.createDataFrame([(n, n / 100, 51.0) for n in range(1, 6)], "node long, lon double, lat double")
    points = roads.runs(refs, nodes)
    assert sorted((r["run"], r["node"]) for r in points.collect()) == [(0, 1), (0, 2), (1, 3), (1, 4)]
    assert roads.segments(points).count() == 2


def test_components_and_costs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node long")
    links = spark.createDataFrame([(1, 0), (2, 1), (5, 4), (4, 6)], "src long, dst long")
    assert {tuple(r) for r in roads.components(nodes, links).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4), (6, 4), (7, 7)}
    edges = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.5), (1, 0, 1.0)], "src long, dst long, cost float")
    got = roads.shortest_costs(edges, spark.createDataFrame([(0,)], "node long")).collect()
    assert {(r["node"], r["cost"]) for r in got} == {(0, 0.0), (1, 2.5), (2, 1.0)}


def test_off_route_equals_state_machine(spark):
    r = random.Random(5)
    fixes, want = [], []
    for trip in range(30):
        since, ms = None, 0
        for _ in range(40):
            ms += r.randint(500, 4000)
            d = r.choice([10.0, 80.0])
            since = (since if since is not None else ms) if d > 45 else None
            fixes.append((trip, ms, d))
            want.append((trip, ms, "on" if since is None else "off" if ms - since >= 6000 else "suspect"))
    df = spark.createDataFrame(fixes, "trip long, ms long, distance double")
    got = trips.off_route(df, trips.threshold(F.lit(10.0)), 6000).select("trip", "ms", "state")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_admission_counts_only_admitted(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 20, 3), (1, 100, 4), (1, 105, 5), (1, 111, 6)], "key long, ms long, id long")
    assert [r["admitted"] for r in admission.admit(df, 2, 100).orderBy("id").collect()] == [True, True, False, True, False, True]


def test_polyline_round_trip():
    line = [(-114.0 + i * 0.0137, 51.0 - i * 0.0029) for i in range(50)]
    assert all(math.isclose(a, b, abs_tol=1e-6) for p, q in zip(line, tiles.decode_polyline(tiles.encode_polyline(line))) for a, b in zip(p, q))
    with pytest.raises(ValueError):
        tiles.decode_polyline(tiles.encode_polyline(line)[:-1])


def test_runs_of_equal_tiles_cross_blocks(spark):
    df = spark.createDataFrame([(i, b"a") for i in range(4090, 8200)] + [(9000, b"a"), (9001, b"b")], "tile_id long, data binary")
    assert sorted((r[0], r[1]) for r in tiles.dedup_runs(df).collect()) == [(4090, 4110), (9000, 1), (9001, 1)]


def test_fold_equals_decomposition(spark):
    import re
    import unicodedata

    texts = [chr(c) + "a" for c in [*range(1, 0x250), *range(0x2010, 0x2028), 0x300, 0x1E9E, 0x4E00, 0xFB01, 0x1F600]] + ["Élan & Café’s — ﬁn", "ĳ ß Ø œ", ""]
    got = [r["f"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.fold(F.col("t")).alias("f")).orderBy("k").collect()]
    plain = spark.createDataFrame([(k, re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", t))) for k, t in enumerate(texts)], "k int, t string")
    low = F.regexp_replace(F.lower("t"), "['’ʼ]", "")
    want = plain.select("k", F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " ")).alias("f")).orderBy("k").collect()
    assert got == [r["f"] for r in want]


def test_shortest_costs_over_blocks(spark, monkeypatch):
    """Paths that leave blocks and come back, many sources in several bunches, ids with gaps, against a plain search."""
    import heapq
    import random

    monkeypatch.setattr(roads, "BLOCK_NODES", 7)
    monkeypatch.setattr(roads, "TOGETHER", 2)
    r = random.Random(6)
    ids = r.sample(range(10**9), 60)
    links = [(a, b, float(r.choice([0, 1, 1, 2, 5, 9]))) for a in ids for b in r.sample(ids, 2)] + [(ids[0], ids[1], 4.0), (ids[0], ids[1], 3.0)]
    starts = [*ids[:5], 5]
    want = set()
    for s in starts:
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            c, u = heapq.heappop(heap)
            for a, b, w in links:
                if a == u and c <= best[u] and c + w < best.get(b, 1e9):
                    best[b] = c + w
                    heapq.heappush(heap, (c + w, b))
        want |= {(s, n, c) for n, c in best.items()}
    edges = spark.createDataFrame(links, "src long, dst long, cost float")
    got = roads.shortest_costs(edges, spark.createDataFrame([(s,) for s in starts + starts[:1]], "node long"))
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_a_road_graph_of_tags(spark):
    tags = lambda **t: t
    ways = spark.createDataFrame([(9, [1, 2, 3, 4, 5], tags(highway="residential", oneway="-1", ref="R1")), (9, [1, 5], tags(highway="primary", access="no")), (8, [5, 99, 1, 2], tags(highway="primary", maxspeed="30 mph", name="A"))], "way long, refs array<long>, tags map<string,string>")
    spots = spark.createDataFrame([(k, 0.001 * k, 0.0, tags(highway="traffic_signals") if k == 3 else tags(barrier="gate")) for k in range(1, 6)], "node long, lon double, lat double, tags map<string,string>")
    got = sorted((x["id"], x["src"], x["dst"], round(x["cost"] - x["metres"] / ((25 if x["id"] == 9 else 30) * 0.27778), 3), x["name"]) for x in roads.road_graph(ways, spots).collect())
    # one-way back; the second and third stretch end at the signals, gates alone do not count
    assert got == [(8, 1, 2, 0.0, "A"), (8, 2, 1, 0.0, "A"), *((9, k + 1, k, 0.0, "R1") for k in (1, 2, 3, 4))]
    long = spark.createDataFrame([(7, list(range(1, 6)), tags(highway="service"))], "way long, refs array<long>, tags map<string,string>")
    plain = roads.road_graph(long, spots.withColumn("tags", F.create_map().cast("map<string,string>"))).filter("src < dst").orderBy("src").collect()
    assert [round(x["cost"] - x["metres"] / (15 * 0.27778), 3) for x in plain] == [0.0, 6.0, 6.0, 0.0]


def test_an_empty_street_falls_back_to_the_name():
    assert search.house_boost("12 oak", "12", "", "oak street") == search.house_boost("12 oak", "12", None, "oak street") is not None


def test_nearest_sends_no_queries_through_the_driver(spark):
    rows = [(k, (k * 37 % 100) * 0.0031, (k % 17) * 0.0019) for k in range(300)]
    nodes = [(k, (k % 20) * 0.004, (k // 20) * 0.0023) for k in range(400)]
    found = roads.nearest(spark.createDataFrame(rows, "query long, lon double, lat double"), spark.createDataFrame(nodes, "node long, lon double, lat double"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    at = lambda c: math.floor(c / 0.002)
    near = {q: {n for n, a, b in nodes if abs(at(a) - at(x)) <= 6 and abs(at(b) - at(y)) <= 6} for q, x, y in rows}
    got = {r["query"]: r["node"] for r in found.collect()}
    assert set(got) == {q for q, n in near.items() if n} and all(n in near[q] for q, n in got.items())


def test_one_digit_is_rounded_by_the_exact_value(spark):
    ms = [1000 + 50.0 * k for k in range(180)]
    got = spark.createDataFrame([(m,) for m in ms], "m double").select("m", geo.format_distance(F.col("m"), even=True)).collect()
    assert [(m, t) for m, t in got if t != f"{m / 1000:.1f} km"] == []
    assert spark.createDataFrame([(1150.0,), (1250.0,)], "m double").select(geo.format_distance(F.col("m"))).collect() == [("1.1 km",), ("1.3 km",)]


def test_polylines_of_columns(spark):
    line = [(-114.0 + 0.01 * k, 51.0 - 0.003 * k) for k in range(50)]
    df = spark.createDataFrame([(1, line), (2, None), (3, []), (4, line[:1])], "k long, p array<struct<lon:double,lat:double>>")
    got = {r["k"]: (r["t"], r["p"]) for r in df.coalesce(1).select("k", tiles.polyline("p").alias("t")).select("k", "t", tiles.from_polyline("t").alias("p")).collect()}
    assert got[1][0] == tiles.encode_polyline(line) and [tuple(p) for p in got[1][1]] == tiles.decode_polyline(got[1][0])
    assert got[2] == (None, None) and got[3] == ("", []) and len(got[4][1]) == 1
    assert tiles.polyline.evalType == tiles._joined.evalType  # Arrow's columns, no object for each point
