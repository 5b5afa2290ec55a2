import math
import random

import pytest
from pyspark.sql import functions as F

from meridian.functions import geo, tags
from meridian.operators import admission, areas, lines, search
from meridian.sources.sniff import file_format
from meridian.storage import stage


@pytest.fixture
def line(spark):
    """Three vertices on a parallel, about 70 m apart, and a fourth 700 m on."""
    points = [(1, 0, 0.0, 51.0), (1, 1, 0.001, 51.0), (1, 2, 0.002, 51.0), (1, 3, 0.012, 51.0)]
    return spark.createDataFrame(points, "route long, pos int, lon double, lat double")


def test_lengths_start_at_zero(line):
    got = lines.measured(line).orderBy("pos").collect()
    assert got[0]["metres"] == 0 and got[0]["along"] == 0
    assert got[1]["metres"] == pytest.approx(69.98, abs=0.05) and got[3]["along"] == pytest.approx(12 * got[1]["metres"], rel=1e-6)


def test_haversine_of_null_is_null(spark):
    assert spark.range(1).select(geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()[0] is None


def test_snap_takes_the_first_of_equals(spark, line):
    fix = spark.createDataFrame([(1, 1, 0.001, 51.0), (2, 1, 0.0015, 51.0002), (3, 1, -1.0, 51.0), (4, 9, 0.0, 51.0)], "id long, route long, lon double, lat double")
    got = {r["id"]: r for r in lines.snap(fix, line).collect()}
    assert set(got) == {1, 2, 3} and got[1]["pos"] == 0 and got[1]["distance"] == 0 and got[3]["along"] == 0
    assert got[2]["pos"] == 1 and got[2]["along"] == pytest.approx(105, abs=0.3) and got[2]["distance"] == pytest.approx(22.2, abs=0.2)


def test_places_are_bounded_by_the_ends(spark, line):
    asked = spark.createDataFrame([(1, 1, -5.0), (2, 1, 35.0), (3, 1, 1e9)], "id long, route long, metres double")
    got = {r["id"]: r["lon"] for r in lines.place_at(line, asked).collect()}
    assert got[1] == 0 and got[2] == pytest.approx(0.0005, abs=1e-5) and got[3] == pytest.approx(0.012)


def test_ahead_stops_beyond_the_limit(line):
    got = [r["ahead"] for r in lines.ahead(line).orderBy("pos").collect()]
    assert got == pytest.approx([839.7, 769.7, 699.8, 0.0], abs=1)
    near = [r["ahead"] for r in lines.ahead(line, 60).orderBy("pos").collect()]
    assert near == pytest.approx([70, 70, 699.8, 0.0], abs=0.5)


def test_remaining_is_at_least_a_metre(spark):
    df = spark.createDataFrame([(100.0, 99.7), (100.0, 100.0), (100.0, 120.0), (100.0, -3.0)], "t double, a double")
    assert [r[0] for r in df.select(lines.remaining(F.col("t"), F.col("a"))).collect()] == [1.0, 0.0, 0.0, 100.0]


def test_thinning_keeps_the_last(spark):
    line = spark.range(10).select(F.lit(1).alias("route"), F.col("id").cast("int").alias("pos"))
    assert [r["pos"] for r in lines.thin(line, 4).orderBy("pos").collect()] == [0, 3, 6, 9]
    assert [r["pos"] for r in lines.thin(line, 3).orderBy("pos").collect()] == [0, 4, 8, 9]
    assert lines.thin(line, 10).count() == 10


def test_legs_lose_repeated_joints_only(spark):
    legs = [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 1.0, 0.0), (1, 0, 2, 1.0, 0.0), (1, 1, 0, 1.0, 0.0), (1, 1, 1, 2.0, 0.0), (1, 2, 0, 2.1, 0.0)]
    got = lines.joined_legs(spark.createDataFrame(legs, "route long, leg int, pos int, lon double, lat double")).orderBy("pos")
    assert [r["lon"] for r in got.collect()] == [0.0, 1.0, 1.0, 2.0, 2.1]


def test_ring_area_sign_and_centroid(spark):
    square, flat = [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (1, 0), (2, 0)]
    rows = [(r, p, *xy) for r, ring in enumerate([square, square[::-1], square + square[:1], flat]) for p, xy in enumerate(ring)]
    got = {r["route"]: (r["area2"], r["cx"], r["cy"]) for r in lines.ring_areas(spark.createDataFrame(rows, "route long, pos int, x long, y long")).collect()}
    assert got == {0: (32, 2.0, 2.0), 1: (-32, 2.0, 2.0), 2: (32, 2.0, 2.0)}


def test_addresses_count_across_segments(line):
    got = lines.addresses(line).orderBy("house").collect()
    assert [r["house"] for r in got] == [12, 24, 36, 48, 60]  # 3 + 3 + 28 steps
    assert got[0]["lon"] == pytest.approx(0.002)


def test_streets_merge_by_name_and_context(spark):
    runs = [(1, 0, 0, "Main St", "A", 0.0, 51.0), (1, 0, 1, "Main St", "A", 0.001, 51.0), (2, 0, 0, "MAIN ST", "A", 0.005, 51.0), (2, 0, 1, "MAIN ST", "A", 0.008, 51.0), (3, 0, 0, "Main St", None, 0.0, 51.0), (3, 0, 1, "Main St", None, 0.0, 51.0)]
    got = {r["context"]: r for r in lines.merge_streets(spark.createDataFrame(runs, "way long, run int, pos int, name string, context string, lon double, lat double")).collect()}
    assert got["A"]["ways"] == 2 and got["A"]["name"] == "Main St" and got["A"]["lon"] == pytest.approx(0.006)
    assert got[None]["metres"] == 0 and got[None]["lon"] == 0


def test_entry_priority(spark):
    cases = [({"name": "A", "place": "town", "highway": "primary"}, ("town", "place/town", "A")), ({"addr:housenumber": "12A", "addr:street": "Elm", "name": "B"}, ("house", "addr:housenumber/12A", "12A Elm")),
             ({"name": "C", "boundary": "administrative", "admin_level": "4"}, ("state", "boundary/administrative", "C")), ({"name": "D", "shop": "bakery", "amenity": "cafe"}, ("poi", "amenity/cafe", "D")), ({"name": "E", "landuse": "forest"}, ("area", "landuse/forest", "E")),
             ({"name": "F"}, ("area", "name/F", "F")), ({"name": "G", "natural": "water"}, ("water", "natural/water", "G")), ({"amenity": "cafe"}, None), ({"addr:housenumber": "7"}, ("house", "addr:housenumber/7", "7"))]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t map<string,string>").select(tags.entry(F.col("t")))
    assert [r[0] and tuple(r[0]) for r in df.collect()] == [w for _, w in cases]


def test_junctions_areas_and_numbers(spark):
    t = [{"highway": "traffic_signals"}, {"barrier": "no"}, {"barrier": "gate"}, {"railway": "crossing", "highway": "primary"}, {"railway": "crossing"}, {}]
    df = spark.createDataFrame([(x,) for x in t], "t map<string,string>")
    assert [r[0] for r in df.select(tags.is_junction(F.col("t"))).collect()] == [True, False, True, False, True, False]
    areas = spark.createDataFrame([({"natural": "water"},), ({"leisure": "park"},), ({"landuse": "farm"},)], "t map<string,string>")
    assert [r[0] for r in areas.select(tags.area_layer(F.col("t"))).collect()] == ["water", "green", None]
    numbers = spark.createDataFrame([("12A",), ("A12",), (None,), (" 7",)], "h string")
    assert [r[0] for r in numbers.select(tags.house_number(F.col("h"))).collect()] == [12, None, None, 7]


def test_overlap_share(spark):
    boxes = [((0, 0, 1, 1), (-1, -1, 2, 2), 1.0), ((-1, -1, 1, 1), (0, 0, 0.5, 0.5), 0.0625), ((0, 0, 1, 1), (1, 0, 2, 1), 0.0), ((0, 0, 0, 1), (0, 0, 1, 1), 0.0), ((1, 1, 0, 0), (0, 0, 2, 2), 0.0)]
    for inner, outer, want in boxes:
        assert spark.range(1).select(geo.overlap_share([F.lit(float(v)) for v in inner], [F.lit(float(v)) for v in outer])).first()[0] == want


def test_formats_of_files_and_sizes(spark):
    heads = [(b"\xef\xbb\xbf \n<?xml version", "xml"), (b"<!DOCTYPE html>", "html"), (b"\x00\x00\x00\x0d\x0a\tOSMHeader", "pbf"), (b"  \n", "unknown"), (b"", "unknown"), (b"<thing>", "unknown"), (None, "unknown")]
    got = spark.createDataFrame([(bytearray(h) if h is not None else None,) for h, _ in heads], "c binary").select(file_format(F.col("c")))
    assert [r[0] for r in got.collect()] == [w for _, w in heads]
    sizes = spark.createDataFrame([(0.0,), (1023.0,), (1536.0,), (439552.0,), (5.0 * 1048576,), (150.0 * 1048576,), (2.0**31,), (-1.0,), (float("nan"),)], "n double").select(geo.format_bytes(F.col("n")))
    assert [r[0] for r in sizes.collect()] == ["0 B", "1023 B", "1.5 KB", "429.3 KB", "5.0 MB", "150 MB", "2.0 GB", "unknown size", "unknown size"]


def test_requests(spark):
    r = spark.createDataFrame([(1, 0, 1, "a"), (1, 100, 2, "ab"), (1, 200, 3, "abc"), (1, 5000, 4, " x ")], "key long, ms long, id long, text string")
    assert [x["start_ms"] for x in admission.throttle(r, 1100).orderBy("id").collect()] == [0, 1100, 2200, 5000]
    assert [x["id"] for x in admission.debounce(r, 250).collect()] == [3]
    calls = spark.createDataFrame([(1, i, i, ok) for i, ok in enumerate([False, None, True, False, False, False, True])], "key long, ms long, id long, ok boolean")
    assert [x["dead"] for x in admission.latched(calls).orderBy("id").collect()] == [False] * 5 + [True] * 2
    assert [x["id"] for x in admission.expired(r, spark.createDataFrame([(2,)], "id long"), 1000, 900).collect()] == [1]


def test_scores_and_caps(spark):
    row = spark.range(1).select(search.online_score(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.0)), search.saved_score(F.lit(None).cast("double"), F.lit(0.0)), search.saved_score(F.lit(500.0), F.lit(5000.0))).first()
    assert tuple(row) == (510.0, None, 740.0)
    g = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 1.0)], "id long, rank double")
    assert [r["id"] for r in search.capped(g, 2).collect()] == [1, 2]


def test_snapping_by_cells_equals_every_pair(spark):
    r = random.Random(9)
    routes = [(k, p, -114 + 0.002 * p * (k + 1) + r.uniform(0, 0.004), 51 + r.uniform(0, 0.02) + (p % 7 == 0) * 0.3 * (k == 2)) for k in range(3) for p in range(120)] + [(3, 0, 0.0, 0.0)]
    spots = [(i, r.randrange(4), -114 + r.uniform(-0.1, 0.9), 51 + r.choice([r.uniform(0, 0.02), r.uniform(-0.3, 0.3), r.uniform(-40, 38.9)])) for i in range(300)] + [(300, 0, 150.0, -30.0)]
    line = spark.createDataFrame(routes, "route long, pos long, lon double, lat double")
    fixes = spark.createDataFrame(spots, "id long, route long, lon double, lat double")
    got = {tuple(x) for x in lines.snap(fixes, line).collect()}
    assert got == {tuple(x) for x in lines._nearest(fixes.join(lines.pieces(line), "route")).drop("fix").collect()} and len(got) == sum(s[1] < 3 for s in spots)


def test_a_fix_on_a_long_route_meets_few_segments(spark):
    line = spark.range(100_000).select(F.lit(1).alias("route"), F.col("id").alias("pos"), (F.col("id") * 0.001).alias("lon"), (51 + F.sin("id") * 0.0005).alias("lat"))
    fixes = spark.range(0, 100_000, 97).select("id", F.lit(1).alias("route"), (F.col("id") * 0.001 + 0.0003).alias("lon"), F.lit(51.001).alias("lat"))
    met = lines._in_cells(fixes, lines.pieces(line), lines.CELL).groupBy("id").count().agg(F.max("count"), F.count("*")).first()
    assert met[0] <= 60 and met[1] == fixes.count()
    got = lines.snap(fixes, line).agg(F.count("*"), F.max("distance")).first()
    assert got[0] == fixes.count() and got[1] < 200


def test_a_ring_of_many_edges_is_cut_into_many_bands(spark):
    n = 100_000
    turn = lambda k: 2 * math.pi * k / n
    e = spark.range(n).select(F.lit(1).alias("area"), *(f(c).alias(a) for a, f, c in (("ax", F.cos, turn(F.col("id"))), ("ay", F.sin, turn(F.col("id"))), ("bx", F.cos, turn(F.col("id") + 1)), ("by", F.sin, turn(F.col("id") + 1)))))
    comb = spark.range(2000).select(F.lit(2).alias("area"), (F.col("id") * 0.001).alias("ax"), (F.col("id") % 2).cast("double").alias("ay"), ((F.col("id") + 1) * 0.001).alias("bx"), ((F.col("id") + 1) % 2).cast("double").alias("by"))
    points = spark.range(5000).select(F.col("id").alias("point"), (F.rand(1) * 3 - 1.5).alias("lon"), (F.rand(2) * 3 - 1.5).alias("lat"))
    points = stage(points, "points")
    got = {x["point"] for x in areas.contains(points, e.unionByName(comb), 0.5).filter("area = 1").collect()}
    assert got == {x["point"] for x in points.filter("lon * lon + lat * lat < 1").collect()}


def test_middle_runs_need_no_window_over_a_street(spark, monkeypatch):
    monkeypatch.setattr(lines, "ROWS", 7)
    r = random.Random(2)
    rows = [(w, k, float(r.randrange(0, 5)), r.choice("ab"), r.choice([None, "x"])) for w in range(60) for k in range(2)]
    sums = lines.stage(spark.createDataFrame(rows, "way long, run int, length double, key string, context string"), "sums")
    got = {(x["key"], x["context"]): (x["way"], x["run"], x["before"], x["half"]) for x in lines.middle_runs(sums, ["key", "context"]).collect()}
    want = {}
    for street in {x[3:] for x in rows}:
        own, before = sorted(x for x in rows if x[3:] == street), 0.0
        half = sum(x[2] for x in own) / 2
        for w, k, size, *_ in own:
            if before + size >= half:
                want[street] = (w, k, before, half)
                break
            before += size
    assert got == want and len(got) == 4


def test_snapping_sorts_no_pairs(spark):
    """Every segment of a cell is as far from its fixes as the next; pairs number a hundred times the fixes."""
    line = spark.range(3000).select(F.lit(1).alias("route"), F.col("id").alias("pos"), (F.col("id") % 100 * 1e-5).alias("lon"), (51 + F.col("id") / 3e3).alias("lat"))
    fixes = spark.range(3000).select("id", F.lit(1).alias("route"), (F.col("id") % 7 * 1e-5).alias("lon"), (51.0001 + F.col("id") / 3e3).alias("lat"))
    asked, part = lines._cells(fixes, lines.pieces(line), lines.CELL)
    asked, part = stage(asked, "asked"), stage(part, "part")
    found = lines._nearest_of(asked, part, ["route", "cx", "cy"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "min(distance" in plan  # a number first, the structs of what is as near after
    met = lines._in_cells(fixes, lines.pieces(line), lines.CELL).count()
    kept = lines._about_nearest(asked, part, ["route", "cx", "cy"]).count()
    assert met > 30 * 3000 and kept < 4 * 3000
    assert sorted(found.collect()) == sorted(lines._nearest(asked.join(part, ["route", "cx", "cy"])).collect())


def test_fixes_beside_the_180th_meridian_meet_cells(spark):
    line = spark.createDataFrame([(1, p, 179.9 + 0.001 * p, 10.0) for p in range(300)], "route long, pos long, lon double, lat double")
    fixes = spark.createDataFrame([(k, 1, lon, 10.0003) for k, lon in enumerate((179.95, -179.95, 180.0, -180.0, 180.0503))], "id long, route long, lon double, lat double")
    met = lines._in_cells(fixes, lines.pieces(line), lines.CELL).groupBy("id").count().agg(F.max("count"), F.count("*")).first()
    assert met[0] <= 60 and met[1] == 5
    got = {tuple(x) for x in lines.snap(fixes, line).collect()}
    assert got == {tuple(x) for x in lines._nearest(fixes.join(lines.pieces(line), "route")).drop("fix").collect()} and len(got) == 5
