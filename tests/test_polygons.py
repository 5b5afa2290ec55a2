"""Pieces of polygons in tiles: areas add up, parts and holes are kept, points are where they were."""

import math
import random

import numpy as np
import pytest

from meridian.operators import polygons as P


def star(r, cx, cy, size, n):
    angles = sorted(r.random() * 2 * math.pi for _ in range(n))
    return np.array([(cx + size * (s := 0.3 + 0.7 * r.random()) * math.cos(a), cy + size * s * math.sin(a)) for a in angles])


def size(p):
    return abs(P.area2(p[0])) / 2 - sum(abs(P.area2(h)) for h in p[1:]) / 2


C = np.array([(0.1, 0.1), (0.6, 0.1), (0.6, 0.2), (0.2, 0.2), (0.2, 0.5), (0.6, 0.5), (0.6, 0.6), (0.1, 0.6)])


def test_a_ring_that_comes_back_gives_two_parts():
    found = P.cut([C], 0.4, 0.0, 1.0, 1.0)
    assert sorted(round(size(p), 9) for p in found) == [0.02, 0.02] and all(len(p) == 1 for p in found)
    assert [round(size(p), 9) for p in P.cut([C], 0.0, 0.0, 0.15, 1.0)] == [0.025]


def test_holes_stay_open_or_go_to_their_part():
    box = np.array([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    hole = lambda x, y: np.array([(x, y), (x, y + 0.1), (x + 0.1, y + 0.1), (x + 0.1, y)])
    ((whole,),) = ([p for p in P.cut([box, hole(0.45, 0.2)], 0.5, 0.0, 1.0, 1.0)],)
    assert len(whole) == 1 and size(whole) == pytest.approx(0.495)
    parts = P.cut([C, hole(0.3, 0.12)[:, :] * [1, 0.5] + [0, 0.05], hole(0.45, 0.52)[:, :] * [1, 0.5] + [0, 0.27]], 0.25, 0.0, 1.0, 1.0)
    assert [len(p) for p in parts] == [2, 2] and all(P.inside(p[0], p[1][0]) for p in parts)


def test_vertices_on_the_border():
    diamond = np.array([(0.5, 0.25), (0.75, 0.5), (0.5, 0.75), (0.25, 0.5)])
    for box in ((0.5, 0.0, 1.0, 1.0), (0.0, 0.0, 0.5, 1.0), (0.0, 0.5, 1.0, 1.0), (0.25, 0.25, 0.5, 0.75)):
        assert sum(size(p) for p in P.cut([diamond], *box)) == pytest.approx(0.0625)
    assert P.cut([diamond], 0.75, 0.0, 1.0, 1.0) == []


def test_pieces_add_up_and_hold_the_same_points():
    r = random.Random(3)
    for _ in range(40):
        outer = star(r, r.uniform(0.3, 0.7), r.uniform(0.3, 0.7), 0.3, r.choice([3, 8, 40]))
        centre = outer.mean(0)
        own = [outer] + ([centre + 0.2 * (outer - centre)] if P.inside(outer, centre) and all(P.inside(outer, p) for p in centre + 0.2 * (outer - centre)) and r.random() < 0.5 else [])
        tiles = list(P.pieces(own, 0, 0, 0, 4, 0.0))
        for zoom in range(5):
            assert sum(size(p) for z, _, _, p in tiles if z == zoom) == pytest.approx(size(own), rel=1e-9)
        deep = [(x, y, p) for z, x, y, p in tiles if z == 4]
        for _ in range(60):
            spot = np.array([r.random(), r.random()])
            holds = lambda p: P.inside(p[0], spot) and not any(P.inside(h, spot) for h in p[1:])
            mine = [p for x, y, p in deep if (x, y) == (int(spot[0] * 16), int(spot[1] * 16))]
            assert any(map(holds, mine)) == holds(own)


def test_tiles_of_a_frame(spark):
    rows = [(1, [C.ravel().tolist()]), (2, [[0.1, 0.1, 0.2, 0.2]]), (3, [])]
    df = spark.createDataFrame(rows, f"id long, rings {P.RINGS}")
    got = P.to_tiles(df, 6)
    by = {r["zoom"]: r["a"] for r in P.areas(got).groupBy("zoom").sum("area").withColumnRenamed("sum(area)", "a").collect()}
    assert sorted(by) == list(range(7)) and all(a == pytest.approx(size([C])) for a in by.values()) and {r[0] for r in got.select("id").distinct().collect()} == {1}
    spots = P.points(got).filter("zoom = 1 AND x = 1 AND y = 0").collect()
    assert {r["part"] for r in spots} == {0} and {(round(r["px"], 6), round(r["py"], 6)) for r in spots} == {(0.5, 0.1), (0.6, 0.1), (0.6, 0.2), (0.5, 0.2)}
    wide = P.to_tiles(df, 3, 0.08)
    assert {r["zoom"] for r in wide.select("zoom").distinct().collect()} == {0, 1, 2, 3} and P.to_tiles(df.limit(0), 2).count() == 0
