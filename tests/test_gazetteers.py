import json
import random
import re

import pytest
from pyspark.sql import functions as F

from meridian.operators import areas, gazetteers, roads
from meridian.plans import journeys

from .conftest import SF


def ways_of(spark, rows):
    return spark.createDataFrame([(w, refs, tags) for w, refs, tags in rows], "way long, refs array<long>, tags map<string,string>")


def square(k, west, south, size):
    """Nodes k to k + 3 and the ring around them."""
    return [(k, west, south), (k + 1, west + size, south), (k + 2, west + size, south + size), (k + 3, west, south + size)], [k, k + 1, k + 2, k + 3, k]


@pytest.fixture(scope="module")
def world(spark):
    big, ring = square(1, 0.0, 0.0, 1.0)
    hole, hole_ring = square(11, 0.4, 0.4, 0.2)
    town, town_ring = square(21, 0.1, 0.1, 0.2)
    road = [(31, 0.05, 0.2), (32, 0.15, 0.2), (33, 0.25, 0.2), (34, 0.55, 0.5), (35, 0.6, 0.55)]
    nodes = spark.createDataFrame([*big, *hole, *town, *road], "node long, lon double, lat double")
    ways = ways_of(spark, [
        (100, [1, 2, 3], {}), (101, [1, 4, 3], {}), (102, hole_ring, {}),
        (103, town_ring, {"boundary": "administrative", "name": "Town", "admin_level": "8"}),
        (104, [31, 32, 33], {"highway": "primary", "name": "Main Street", "alt_name": "High Road;Main Street"}),
        (105, [33, 99, 34, 35], {"highway": "primary", "name": "main street", "name:fr": "Grand Rue"}),
        (106, [34, 35], {"addr:housenumber": "7b", "addr:street": "Oak"}), (107, [21, 22, 23, 24, 21], {"leisure": "park", "name": "Green"}),
        (108, [31, 98, 32], {"building": "yes", "name": "Hut"}),
    ])
    relations = spark.createDataFrame([(1, {"boundary": "administrative", "name": "State", "admin_level": "4", "type": "boundary"}), (2, {"name": "Lost"})], "relation long, tags map<string,string>")
    members = spark.createDataFrame([(1, 0, 100, "outer"), (1, 1, 101, "outer"), (1, 2, 102, "inner"), (2, 0, 104, "outer")], "relation long, idx int, way long, role string")
    places = spark.createDataFrame([(7, 0.15, 0.15, {"name": "Shop", "shop": "bakery", "addr:city": "Elsewhere"}), (8, 0.5, 0.5, {"place": "town", "name": "Hollow", "population": "10,000"}), (9, 5.0, 5.0, {"amenity": "cafe"})], "id long, lon double, lat double, tags map<string,string>")
    return places, ways, nodes, relations, members


def test_rings_close_and_keep_holes(spark, world):
    _, ways, nodes, _, members = world
    rings = areas.rings(members, ways, nodes)
    got = {(r["relation"], r["inner"]): (round(abs(r["area2"]), 9), r["points"]) for r in areas.measures(rings, ["relation", "inner", "ring"]).collect()}
    assert got == {(1, False): (2.0, 5), (1, True): (0.08, 5)}
    spots = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.3, 0.5), (3, 1.5, 0.5)], "point long, lon double, lat double")
    assert [r["point"] for r in areas.contains(spots, areas.area_edges(rings).withColumnRenamed("relation", "area")).collect()] == [2]
    broken = areas.rings(members, ways, nodes.filter("node <> 4"))
    assert {(r["relation"], r["inner"]) for r in broken.collect()} == {(1, True)}


def test_server_gazetteer(world):
    places, ways, nodes, relations, members = world
    got = {r["id"]: r for r in gazetteers.server_gazetteer(*world).collect()}
    assert set(got) == {"node/7", "node/8", "way/103", "way/104", "way/105", "way/106", "way/107", "way/108", "relation/1"}
    assert (got["node/7"]["city"], got["node/7"]["state"]) == ("Town", "State")
    assert got["node/8"]["state"] is None and abs(got["node/8"]["importance"] - (0.45 + 0.1)) < 1e-9  # in the state's hole
    assert got["way/104"]["alt"] == ["High Road"] and got["way/104"]["kind"] == "street" and abs(got["way/104"]["lon"] - 0.15) < 1e-9
    assert got["way/105"]["alt"] == ["Grand Rue"] and got["way/105"]["name"] == "main street"
    assert (got["way/106"]["name"], got["way/106"]["house"]) == ("7b Oak", "7b") and abs(got["way/107"]["lon"] - 0.2) < 1e-9
    assert abs(got["relation/1"]["lon"] - 0.5) < 1e-9
    order = [(r["importance"], r["id"]) for r in gazetteers.server_gazetteer(*world, cap=3).collect()]
    assert order == sorted(((r["importance"], i) for i, r in got.items()), key=lambda x: (-x[0], x[1]))[:3]


def test_client_gazetteer(world):
    places, ways, nodes, _, _ = world
    got = sorted((r["cat"], r["name"], r["rank"]) for r in gazetteers.client_gazetteer(places, ways, nodes).collect() if r["rank"] != 20)
    assert got == [("address", "Oak 7", 40), ("bakery", "Shop", 50), ("park", "Green", 65), ("street", "Main Street", 30), ("street", "main street", 30), ("town", "Hollow", 100)]
    made = gazetteers.client_gazetteer(places, ways, nodes).filter("rank = 20")
    assert made.count() > 100 and made.filter("house % 12 <> 0").count() == 0


def test_ways_of_one_id_are_ways_of_their_own(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 1.0, 0.0), (4, 1.001, 0.0)], "node long, lon double, lat double")
    ways = ways_of(spark, [(9, [1, 2], {"highway": "primary", "name": "A"}), (9, [3, 4], {"highway": "primary", "name": "B"})])
    rows = roads.way_rows(ways)
    found = roads.segments(roads.runs(rows.select("way", F.posexplode("refs").alias("pos", "node")), nodes)).collect()
    assert {(r["src"], r["dst"]) for r in found} == {(1, 2), (3, 4)} and max(r["metres"] for r in found) < 120
    places = spark.createDataFrame([], "id long, lon double, lat double, tags map<string,string>")
    got = gazetteers.client_gazetteer(places, ways, nodes).collect()
    assert {(r["name"], r["lon"]) for r in got if r["cat"] == "street"} == {("A", 0.0), ("B", 1.0)} and len(got) == 2


def test_a_named_building_has_no_address_row(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0)], "node long, lon double, lat double")
    number = {"addr:housenumber": "5", "addr:street": "Oak"}
    ways = ways_of(spark, [(k, [1, 2], {**number, **own}) for k, own in enumerate([{"name": "Hall", "building": "yes"}, {"name": "Lot"}, {"building": "yes"}, {"name": "Park", "leisure": "park"}, {"name": "Way", "highway": "service"}])])
    places = spark.createDataFrame([], "id long, lon double, lat double, tags map<string,string>")
    got = gazetteers.client_gazetteer(places, ways, nodes).collect()
    assert sorted(r["name"] for r in got) == ["Oak 5", "Oak 5", "Oak 5", "Park", "Way"]


def test_made_up_houses_are_not_joined_again(spark, world):
    places, ways, nodes, _, _ = world
    plan = gazetteers.client_gazetteer(places, ways, nodes)._jdf.queryExecution().optimizedPlan().toString()
    above, found, _ = plan.rpartition("Generate explode(")
    assert found and not any("Join" in x for x in above.splitlines()[-4:])


def test_houses_of_a_name_are_summed_without_making_them(spark, world):
    places, ways, nodes, _, _ = world
    r = random.Random(7)
    spots = [(100 + i, r.uniform(-1, 1), r.uniform(50, 51)) for i in range(40)] + [(200, 0.0, 60.0), (201, 0.0, 60.0), (202, 0.0001, 60.0)]
    more = [(50 + i, r.choices([s[0] for s in spots] + [999], k=r.randrange(1, 7)), {"highway": "primary", "name": r.choice(["Long", "Wide 12", "Long 24"])}) for i in range(30)]
    more += [(90, [200, 201, 202, 201], {"highway": "primary", "name": "Short"}), (91, [100, 101], {"landuse": "address", "name": "Long 24 36"})]
    ways, nodes = ways.unionByName(ways_of(spark, more)), nodes.unionByName(spark.createDataFrame(spots, nodes.schema))
    rows = gazetteers.client_gazetteer(places, ways, nodes).groupBy("cat", "rank", "name").agg(F.count("*").alias("entries"), F.coalesce(F.sum("house"), F.lit(0)).alias("houses"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    names = gazetteers.client_names(places, ways, nodes)
    assert names.columns == rows.columns
    told = lambda df: {(x["cat"], x["rank"], x["name"], x["entries"], x["houses"]): (x["lon"], x["lat"]) for x in df.collect()}
    got, want = told(names), told(rows)
    assert got.keys() == want.keys() and max(x[3] for x in want) > 5 and len(want) > 2000
    assert all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k]))


def test_the_query_of_names_makes_no_houses(spark):
    plan = journeys.client_gazetteer(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("steps" in x or "metres" in x for x in plan.splitlines() if "Generate explode(" in x and "sequence(" in x)
    assert "sequence(m#" in plan


def test_a_way_that_begins_two_streets_keeps_both(spark):
    spots = [(1, 0.2, 0.5), (2, 0.4, 0.5), (3, 2.0, 0.5), (4, 2.4, 0.5), (11, 0.0, 0.0), (12, 1.0, 0.0), (13, 1.0, 1.0), (14, 0.0, 1.0)]
    nodes = spark.createDataFrame(spots, "node long, lon double, lat double")
    border = {"boundary": "administrative", "admin_level": "4", "name": "State"}
    ways = ways_of(spark, [(1, [1, 2, 99, 3, 4], {"highway": "primary", "name": "Main", "name:fr": "Grand"}), (2, [11, 12, 13, 14, 11], border)])
    empty = lambda columns: spark.createDataFrame([], columns)
    tags_ = "tags map<string,string>"
    got = gazetteers.server_gazetteer(empty("id long, lon double, lat double, " + tags_), ways, nodes, empty("relation long, " + tags_), empty("relation long, idx int, way long, role string")).collect()
    streets = sorted((round(r["lon"], 9), r["state"]) for r in got if r["kind"] == "street")
    assert streets == [(0.3, "State"), (2.2, None)] and {r["id"] for r in got} == {"way/1", "way/2"}


def test_no_window_orders_the_runs_of_a_street(spark):
    points = spark.createDataFrame([(w, 0, p, w * 0.1 + p * 0.05, 0.0) for w in range(9) for p in range(2)], "way long, run int, pos int, lon double, lat double")
    tagged = ways_of(spark, [(w, [], {"name": "Main"}) for w in range(9)])
    context = points.select("way", "run", *(F.lit(None).cast("string").alias(c) for c in ("city", "state", "country"))).distinct()
    found = gazetteers.merged_streets(points, tagged, context)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "country#" in plan and not re.search(r"windowspecdefinition\(key#\d+,[^)]* way#", plan)
    assert [(r["id"], round(r["lon"], 6)) for r in found.collect()] == [("way/0", 0.425)]
