"""Polygons cut to the tiles of a pyramid: exact pieces, several of a tile where a ring comes back, holes kept.

A polygon is its rings, the outer one first, each a flat array x0, y0, x1, y1, ... without the repeat of its first point, in
units of the whole map (Mercator, 0 to 1, y down). A zoom level cuts its parent's pieces, so that a piece is no larger than
the tile above and work follows the outline.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stage

Polygon = list[np.ndarray]  # rings as (n, 2) arrays, the outer one first

#: Zooms of a step, after which pieces are dealt out anew: at most 4 to that power tiles come of a row.
LEVELS = 4
RINGS = "array<array<double>>"


def area2(ring: np.ndarray) -> float:
    """Twice the signed area, taken about the first point, as rings are small beside their distance from the origin."""
    x, y = (ring - ring[0]).T
    return float(x @ np.roll(y, -1) - np.roll(x, -1) @ y)


def inside(ring: np.ndarray, p: np.ndarray) -> bool:
    """Whether a point lies in a ring, by the crossings of the ray to its right."""
    a, b = ring, np.roll(ring, -1, axis=0)
    cross = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[cross], b[cross]
    return bool(np.count_nonzero(p[0] < a[:, 0] + (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])) % 2)


def half(polygon: Polygon, axis: int, bound: float, sign: int) -> list[Polygon]:
    """The parts of a polygon where sign * (coordinate - bound) >= 0.

    Rings are cut into the chains that lie there. Along the border the ends of chains bound the polygon's inside by turns, so
    the first is joined with the second, the third with the fourth, and so on; chains and joins close to outer rings, and
    holes that were not cut go to the one around them.
    """
    chains, whole = [], []
    for k, ring in enumerate(polygon):
        far = sign * (ring[:, axis] - bound)
        keep = far >= 0
        if keep.all():
            whole.append((k, ring))
            continue
        if not keep.any():
            if k == 0:
                return []
            continue
        nxt = np.roll(np.arange(len(ring)), -1)
        turns = np.flatnonzero(keep != keep[nxt])
        a, b = ring[turns], ring[nxt[turns]]
        t = far[turns] / (far[turns] - far[nxt[turns]])
        spots = a + t[:, None] * (b - a)
        spots[:, axis] = bound
        enters = np.flatnonzero(keep[nxt[turns]])
        for e in enters:
            leaves = (e + 1) % len(turns)
            first, last = nxt[turns[e]], turns[leaves]
            body = ring[first : last + 1] if first <= last else np.concatenate((ring[first:], ring[: last + 1]))
            chains.append(np.concatenate((spots[e : e + 1], body, spots[leaves : leaves + 1])))
    if not chains:
        return [[r for _, r in whole]]
    ends = sorted((float(c[at, 1 - axis]), k, at) for k, c in enumerate(chains) for at in (0, -1))
    other = {}
    for p, q in zip(ends[::2], ends[1::2]):
        other[p[1:]], other[q[1:]] = q[1:], p[1:]
    outers, seen = [], set()
    for k in range(len(chains)):
        parts, at = [], (k, 0)
        while at[0] not in seen:
            seen.add(at[0])
            parts.append(chains[at[0]] if at[1] == 0 else chains[at[0]][::-1])
            at = other[at[0], -1 - at[1]]
        if parts:
            ring = np.concatenate(parts)
            ring = ring[(ring != np.roll(ring, 1, axis=0)).any(1)]
            if len(ring) >= 3 and area2(ring) != 0:
                outers.append([ring])
    if whole and whole[0][0] == 0:
        outers.append([whole[0][1]])
    for k, hole in whole:
        if k:
            owner = next((o for o in outers if inside(o[0], hole[0])), outers[0] if outers else None)
            if owner is not None:
                owner.append(hole)
    return outers


def cut(polygon: Polygon, west: float, north: float, east: float, south: float) -> list[Polygon]:
    """The parts of a polygon in a rectangle, west < east and north < south."""
    low, high = polygon[0].min(0), polygon[0].max(0)
    if low[0] >= east or high[0] <= west or low[1] >= south or high[1] <= north:
        return []
    parts = [polygon]
    for axis, bound, sign, needed in ((0, west, 1, low[0] < west), (0, east, -1, high[0] > east), (1, north, 1, low[1] < north), (1, south, -1, high[1] > south)):
        if needed:
            parts = [p for whole in parts for p in half(whole, axis, bound, sign)]
    return parts


def _rings(flat: list[list[float]]) -> Polygon:
    return [np.array(r).reshape(-1, 2) for r in flat]


def pieces(polygon: Polygon, zoom: int, x: int, y: int, last: int, buffer: float) -> Iterator[tuple[int, int, int, Polygon]]:
    """(zoom, x, y, polygon) of a tile and of all tiles below it down to a zoom, each from the pieces of its parent."""
    n = 1 << zoom
    for part in cut(polygon, (x - buffer) / n, (y - buffer) / n, (x + 1 + buffer) / n, (y + 1 + buffer) / n):
        yield zoom, x, y, part
        if zoom < last:
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                yield from pieces(part, zoom + 1, 2 * x + i, 2 * y + j, last, buffer)


def _below(last: int, buffer: float):
    """Arrow function: the pieces of a tile's part down to a zoom."""

    def run(zoom: pa.Array, x: pa.Array, y: pa.Array, rings: pa.Array) -> pa.Array:
        out = []
        for z, tx, ty, flat in zip(*(c.to_pylist() for c in (zoom, x, y, rings))):
            found = pieces(_rings(flat), z, tx, ty, last, buffer)
            out.append([dict(zip(("zoom", "x", "y", "rings"), (a, b, c, [r.ravel() for r in p]))) for a, b, c, p in found])
        return pa.array(out, pa.list_(pa.struct([("zoom", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("rings", pa.list_(pa.list_(pa.float64())))])))

    run.__annotations__ = {"zoom": pa.Array, "x": pa.Array, "y": pa.Array, "rings": pa.Array, "return": pa.Array}
    return F.arrow_udf(f"array<struct<zoom:int,x:bigint,y:bigint,rings:{RINGS}>>")(run)


def to_tiles(polygons: DataFrame, last: int, buffer: float = 0.0) -> DataFrame:
    """polygons (id, rings) cut to the tiles of zooms 0 to last: (id, zoom, x, y, rings), a row for each part.

    Tiles are widened by buffer of their size on each side; a child's lie within its parent's. LEVELS zooms are one stored
    step, whose last zoom's pieces are dealt out by tile for the next, so a large polygon does not stay in one task. Rings
    with fewer than three points, and parts without area, have no rows. Holes must lie within the outer ring.
    """
    usable = F.filter("rings", lambda r: F.size(r) >= 6)
    rows = polygons.select("id", usable.alias("rings")).filter("size(rings) > 0")
    rows = rows.select("id", F.lit(0).cast("int").alias("zoom"), *(F.lit(0).cast("long").alias(c) for c in ("x", "y")), "rings")
    steps, at = [], 0
    while True:
        to = min(at + LEVELS, last)
        cut_ = rows.select("id", F.explode(_below(to, buffer)("zoom", "x", "y", "rings")).alias("p")).select("id", "p.*")
        # a step starts from the pieces that the one before ended with
        steps.append(stage(cut_ if not at else cut_.filter(F.col("zoom") > at), "pieces"))
        if to == last:
            return reduce(DataFrame.unionByName, steps)
        rows, at = steps[-1].filter(F.col("zoom") == to).repartition("id", "x", "y"), to


def points(pieces: DataFrame) -> DataFrame:
    """pieces as rows (id, zoom, x, y, part, ring, pos, px, py); parts of a tile are numbered in the order of their outlines."""
    part = F.row_number().over(Window.partitionBy("id", "zoom", "x", "y").orderBy("rings")) - 1
    rings = pieces.withColumn("part", part).select("id", "zoom", "x", "y", "part", F.posexplode("rings").alias("ring", "flat"))
    spots = F.transform(F.sequence(F.lit(0), (F.size("flat") / 2 - 1).cast("int")), lambda i: F.struct(F.get("flat", (2 * i).cast("int")).alias("px"), F.get("flat", (2 * i + 1).cast("int")).alias("py")))
    return rings.select("id", "zoom", "x", "y", "part", "ring", F.posexplode(spots).alias("pos", "p")).select("id", "zoom", "x", "y", "part", "ring", "pos", "p.px", "p.py")


def areas(pieces: DataFrame) -> DataFrame:
    """pieces with area: that of the outer ring less those of its holes, by array functions alone."""

    def of(flat):
        n = (F.size(flat) / 2).cast("int")
        at = lambda k, c: F.get(flat, ((k % n) * 2 + c).cast("int")) - F.get(flat, F.lit(c))
        return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + at(k, 0) * at(k + 1, 1) - at(k + 1, 0) * at(k, 1))) / 2

    each = F.transform("rings", of)
    return pieces.withColumn("area", 2 * F.get(each, F.lit(0)) - F.aggregate(each, F.lit(0.0), lambda s, a: s + a))
