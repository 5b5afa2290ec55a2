"""Polylines as rows (route, pos, lon, lat), pos from 0 without gaps: lengths, places, snapping, thinning, areas.

A route is read in its own order by a window, so its rows stream through one task; what joins lines with other rows
is an equi-join on the route followed by an aggregate that combines before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import M_PER_DEG, bearing, half_up, haversine, mercator, normalise_bearing, project
from ..storage import stage, unstage
from .order import ROWS, numbered


def measured(line: DataFrame) -> DataFrame:
    """line with metres, from the vertex before, and along, from the start."""
    order = Window.partitionBy("route").orderBy("pos")
    step = haversine(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("metres", F.coalesce(step, F.lit(0.0))).withColumn("along", F.sum("metres").over(upto))


def pieces(line: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(route, pos, ax, ay, bx, by, start, metres): the segment from each vertex to the next, with more of the line's columns
    if asked for."""
    to = F.lead(F.struct("lon", "lat", "metres")).over(Window.partitionBy("route").orderBy("pos"))
    cut = measured(line).withColumn("to", to).filter("to IS NOT NULL")
    return cut.select("route", "pos", F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.col("to.lon").alias("bx"), F.col("to.lat").alias("by"), F.col("along").alias("start"), F.col("to.metres").alias("metres"), *more)


#: Degrees of the cells in which fixes first look for segments, by how much each further round's are wider, and how many
#: rounds look at cells before the rest meets whole routes. All of them divide 360 degrees.
CELL, WIDER, ROUNDS = 0.01, 10, 4
#: The share of a cell's width by which segments are dealt beyond the cells they lie in.
REACH = 0.25


def snap(fixes: DataFrame, line: DataFrame) -> DataFrame:
    """fixes (id, route, lon, lat) at the nearest place of their route: (id, distance, pos, along, lon, lat). The first of
    equally near segments wins; fixes of routes with fewer than two vertices have no row.

    A fix meets the segments that lie in its own cell or near it. What it finds there is the nearest of all if it is no
    farther than that margin is wide; the fixes for which it is not look again in wider cells, and only what still has no
    answer, far away from its route, meets all of that. So do fixes near the poles, where cells are narrow.
    """
    cut, left = stage(pieces(line).drop("metres"), "segments"), stage(fixes.select("id", "route", "lon", "lat"), "fixes")
    found = []
    for k in range(ROUNDS):
        size = CELL * WIDER**k
        best = stage(_nearest_of(*_cells(left, cut, size), ["route", "cx", "cy"]), "near")
        reach = REACH * size
        wide = 0.99 * M_PER_DEG * reach * F.cos(F.radians(F.least(F.lit(90.0), F.abs("fix.lat") + reach)))
        sure = best.filter(F.col("distance") <= wide).drop("fix")
        found.append(sure)
        rest = stage(left.join(sure.select("id"), "id", "left_anti"), "fixes")
        unstage(left)
        left = rest
        if left.isEmpty():
            break
    else:
        found.append(_nearest_of(left, cut, ["route"]).drop("fix"))
    return reduce(DataFrame.unionByName, found)


def _cells(fixes: DataFrame, cut: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """fixes with their cell (cx, cy), and the segments of their routes in each cell that they come near to, perhaps several
    times. Cells go around the globe, so those on both sides of the 180th meridian are neighbours."""
    at, turn, reach = lambda c: F.floor(c / size).cast("int"), round(360 / size), REACH * size
    asked = fixes.select("id", "route", "lon", "lat", F.pmod(at(F.col("lon")), F.lit(turn)).alias("cx"), at(F.col("lat")).alias("cy"))
    # long segments are dealt by their pieces of a cell's length, not by the box around them
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / size)).cast("int")
    part = cut.join(fixes.select("route").distinct(), "route", "left_semi").withColumns({"n": n}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spot = lambda c, k: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * k / F.col("n")
    cells = lambda c: F.sequence(at(F.least(spot(c, F.col("k")), spot(c, F.col("k") + 1)) - reach), at(F.greatest(spot(c, F.col("k")), spot(c, F.col("k") + 1)) + reach))
    part = part.withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y"))).withColumn("cx", F.pmod("cx", F.lit(turn)))
    return asked, part.select("route", "cx", "cy", "pos", "ax", "ay", "bx", "by", "start")


def _in_cells(fixes: DataFrame, cut: DataFrame, size: float) -> DataFrame:
    """fixes with the segments of their route that reach into their cell or near it, a segment perhaps several times."""
    asked, part = _cells(fixes, cut, size)
    return asked.join(part, ["route", "cx", "cy"])


def _beside(near: DataFrame) -> DataFrame:
    """Fixes beside segments with p, the nearest place of the segment, and the distance to it."""
    near = near.withColumn("p", project(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return near.withColumn("distance", haversine(F.col("lon"), F.col("lat"), F.col("p.lon"), F.col("p.lat")))


def _nearest(near: DataFrame) -> DataFrame:
    """(id, distance, pos, along, lon, lat, fix: where it is) of fixes beside segments."""
    along = F.col("start") + haversine(F.col("ax"), F.col("ay"), F.col("p.lon"), F.col("p.lat"))
    best = F.min(F.struct("distance", "pos", along.alias("along"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")))
    return _beside(near).groupBy("id").agg(best.alias("best"), F.first(F.struct("lon", "lat")).alias("fix")).select("id", "best.*", "fix")


def _about_nearest(fixes: DataFrame, cut: DataFrame, on: list[str]) -> DataFrame:
    """fixes joined with those segments of cut, of the same values of these columns, that are as near as any or a thousandth of
    a millimetre farther. All pairs pass through a hash table of least distances by fix; a sort would write them down."""
    pairs = _beside(fixes.join(cut, on))
    least = pairs.groupBy("id", "lon", "lat", *on).agg(F.min("distance").alias("least"))
    near = _beside(least.join(cut, on)).drop("p")
    # exploded, since Spark would move a filter to where it computes each part of the distance many times over
    kept = F.when(F.col("distance") > F.col("least") + 1e-6, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return near.select("*", F.explode(kept).alias("kept")).drop("distance", "least", "kept")


def _nearest_of(fixes: DataFrame, cut: DataFrame, on: list[str]) -> DataFrame:
    """_nearest() of fixes joined with the segments of cut on these columns, without an order of all pairs."""
    return _nearest(_about_nearest(fixes, cut, on))


#: Metres of a stretch of a route: what asks for a place meets the segments of its stretch alone.
STRETCH = 2000.0


def _on_stretches(line: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, route, metres) with at, metres within its route, beside the segments (pos, ax, ay, bx, by, start, size) that
    reach into its stretch. Segments follow each other without gaps, so one of them holds at."""
    cut = pieces(line).withColumnRenamed("metres", "size")
    total = cut.groupBy("route").agg(F.max(F.col("start") + F.col("size")).alias("total"))
    stretch = lambda m: F.floor(m / STRETCH)
    dealt = cut.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("size")))))
    at = F.greatest(F.lit(0.0), F.least("metres", "total"))
    return asked.join(total, "route").withColumn("at", at).withColumn("stretch", stretch(F.col("at"))).join(dealt, ["route", "stretch"])


def place_at(line: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, route, metres): (id, pos, lon, lat) that far along the route, which its ends bound."""
    hits = _on_stretches(line, asked).filter((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("start") + F.col("size")))
    t = F.when(F.col("size") > 0, (F.col("at") - F.col("start")) / F.col("size")).otherwise(0.0)
    spot = F.struct("pos", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("lon"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("lat"))
    return hits.groupBy("id").agg(F.min(spot).alias("spot")).select("id", "spot.*")


def remaining(total: Column, along: Column) -> Column:
    """Metres left, never under one unless none are."""
    left = total - F.greatest(F.lit(0.0), F.least(along, total))
    return F.when(left == 0, 0.0).otherwise(F.greatest(F.lit(1.0), left))


def ahead(line: DataFrame, limit: int = 500) -> DataFrame:
    """line with ahead: metres to the end of the route or to the first vertex that is more than limit further on."""
    cut = measured(line)
    rows = cut.select("route", F.struct("pos", "along").alias("v"))
    # the window's frame is by distance, so each vertex looks no further than the limit and one vertex beyond
    order = Window.partitionBy("route").orderBy("along")
    within = F.max("pos").over(order.rangeBetween(0, limit))
    far = cut.withColumn("beyond", within + 1)
    ends = rows.select("route", F.col("v.pos").alias("beyond"), F.col("v.along").alias("to"))
    last = F.max("along").over(Window.partitionBy("route"))
    return far.withColumn("last", last).join(ends, ["route", "beyond"], "left").withColumn("ahead", F.coalesce("to", "last") - F.col("along")).select(*line.columns, "ahead")


def thin(line: DataFrame, most: int = 4000) -> DataFrame:
    """Every n-th vertex of routes with more than most, and always the last."""
    n = F.count("*").over(Window.partitionBy("route"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return line.withColumn("n", n).filter((F.col("pos") % stride == 0) | (F.col("pos") == F.col("n") - 1)).drop("n")


def joined_legs(legs: DataFrame) -> DataFrame:
    """legs (route, leg, pos, lon, lat) as lines: a leg's first point goes where it repeats the end of the leg before."""
    order = Window.partitionBy("route").orderBy("leg", "pos")
    at = legs.withColumn("before", F.lag(F.struct("leg", "lon", "lat")).over(order))
    same = (F.col("before.leg") != F.col("leg")) & (F.abs(F.col("before.lon") - F.col("lon")) < 1e-9) & (F.abs(F.col("before.lat") - F.col("lat")) < 1e-9)
    kept = at.filter(~F.coalesce(same, F.lit(False)))
    return kept.select("route", (F.row_number().over(order) - 1).alias("pos"), "lon", "lat")


def quantised(line: DataFrame, zoom: int, extent: int = 4096) -> DataFrame:
    """(route, pos, x, y) on the zoom's grid of extent steps a tile, without repeats of the point before."""
    m = mercator(F.col("lon"), F.col("lat"))
    grid = line.select("route", "pos", *(half_up(m[c] * (extent << zoom)).cast("long").alias(c) for c in ("x", "y")))
    last = F.lag(F.struct("x", "y")).over(Window.partitionBy("route").orderBy("pos"))
    return grid.withColumn("last", last).filter(~F.col("last").eqNullSafe(F.struct("x", "y"))).drop("last")


def ring_areas(ring: DataFrame, least: int = 8) -> DataFrame:
    """ring (route, pos, x, y), open or closed: (route, area2, cx, cy), twice the signed area and the centroid; rings under
    least go."""
    order = Window.partitionBy("route").orderBy("pos")
    p = F.struct("x", "y")
    to = F.coalesce(F.lead(p).over(order), F.first(p).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = ring.withColumn("to", to).withColumn("cross", F.col("x") * F.col("to.y") - F.col("to.x") * F.col("y"))
    sums = cut.groupBy("route").agg(F.sum("cross").alias("area2"), *(F.sum((F.col(c) + F.col(f"to.{c}")).cast("double") * F.col("cross")).alias(f"s{c}") for c in ("x", "y")))
    return sums.filter(F.abs("area2") >= least).select("route", "area2", *((F.col(f"s{c}") / (3.0 * F.col("area2"))).alias(f"c{c}") for c in ("x", "y")))


def address_series(streets: DataFrame, spacing: float = 25.0, every: int = 6, more: tuple[str, ...] = ()) -> DataFrame:
    """(route, before, first, steps, ax, ay, bx, by): the houses that addresses() makes up, as one row for each segment that has
    any: of its steps those numbered first, first + every ..., with before the steps of the street up to it."""
    cut = pieces(streets, more).withColumn("steps", F.greatest(F.lit(1), half_up(F.col("metres") / spacing)).cast("long"))
    before = F.sum("steps").over(Window.partitionBy("route").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("steps")
    cut = cut.withColumn("before", before).withColumn("first", every - F.col("before") % every)
    return cut.filter("first <= steps").select("route", "before", "first", "steps", "ax", "ay", "bx", "by", *more)


def addresses(streets: DataFrame, spacing: float = 25.0, every: int = 6, more: tuple[str, ...] = ()) -> DataFrame:
    """(route, house, lon, lat): made-up even numbers, a step for each spacing metres of a street and one kept of every; with
    more of the streets' columns if asked for, as houses are many times the streets' points and hard to join later."""
    return series_houses(address_series(streets, spacing, every, more), every, more)


def series_houses(series: DataFrame, every: int = 6, more: tuple[str, ...] = ()) -> DataFrame:
    """The houses of address_series()."""
    k = series.withColumn("k", F.explode(F.sequence("first", "steps", F.lit(every).cast("long"))))
    t = F.col("k") / F.col("steps")
    return k.select("route", (2 * (F.col("before") + F.col("k"))).alias("house"), (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("lon"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("lat"), *more)


def series_sums(series: DataFrame, by: str, every: int = 6) -> DataFrame:
    """(by, house, entries, lons, lon, lats, lat): how many of address_series()'s houses have one by and number, and the counts
    and sums of their coordinates, in work that grows with the segments and the numbers, not with the houses.

    Along a segment places are a line over the numbers: it joins its street's running sums at its first house and leaves
    them after its last. The sums are decimal, so what leaves takes away exactly what joined. A window has a row for each
    number at which any segment of a by begins or ends, however many there are.
    """
    made = series.withColumn("low", ((F.col("before") + F.col("first")) / every).cast("long"))
    made = made.withColumn("end", F.col("low") + F.floor((F.col("steps") - F.col("first")) / every) + 1)
    exact = lambda c: c.cast("decimal(22,18)")
    sums = ["entries"]
    for name, p, q in (("lon", "ax", "bx"), ("lat", "ay", "by")):
        size = F.col(q) - F.col(p)
        made = made.withColumn("step", exact(size * every / F.col("steps")))
        made = made.withColumns({f"{name}_base": exact(F.col(p) + size * (F.col("first") / F.col("steps"))) - F.col("step") * F.col("low").cast("decimal(13,0)"), f"{name}_step": F.col("step")})
        made = made.withColumn(f"{name}s", F.col(f"{name}_base").isNotNull().cast("long"))
        sums += [f"{name}s", f"{name}_base", f"{name}_step"]
    made = made.withColumn("entries", F.lit(1).cast("long"))
    ends = made.withColumn("e", F.explode(F.array(F.struct(F.col("low").alias("m"), F.lit(True).alias("joins")), F.struct(F.col("end").alias("m"), F.lit(False).alias("joins")))))
    steps = ends.groupBy(by, "e.m").agg(*(F.sum(F.when(F.col("e.joins"), F.col(c)).otherwise(-F.col(c))).alias(c) for c in sums))
    order = Window.partitionBy(by).orderBy("m")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    held = steps.select(by, "m", F.lead("m").over(order).alias("next"), *(F.sum(c).over(upto).alias(c) for c in sums)).filter("entries > 0")
    each = held.withColumn("m", F.explode(F.sequence("m", F.col("next") - 1)))
    total = lambda name: (F.col(f"{name}_base").cast("double") + F.col(f"{name}_step").cast("double") * F.col("m")).alias(name)
    return each.select(by, (2 * every * F.col("m")).alias("house"), "entries", "lons", total("lon"), "lats", total("lat"))


def middle_runs(sums: DataFrame, street: list[str]) -> DataFrame:
    """(*street, way, run, before, half): of the runs (way, run, length, *street) of each street, laid end to end by way and
    run, the one that half its length lies in, with the length before it and that half. sums must be stored.

    Runs are numbered in this order and cut into blocks; windows run over the sums of a street's blocks and inside the one
    block that holds the middle, so a street with a large share of all runs is many small tasks.
    """
    rows = numbered(sums.select(*street, "way", "run", "length"), *street, "way", "run").withColumn("block", F.floor(F.col("number") / ROWS))
    by = Window.partitionBy(*street)
    base = F.coalesce(F.sum("size").over(by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    blocks = rows.groupBy(*street, "block").agg(F.sum("length").alias("size"), F.min("number").alias("low"), F.max("number").alias("high"))
    blocks = blocks.withColumns({"base": base, "half": F.sum("size").over(by) / 2})
    # of the blocks, and then of the runs, that reach the middle the first has it; the last may miss it by a rounding
    at = F.struct("block", "low", "high", "base", "half")
    held = F.coalesce(F.min(F.when(F.col("base") + F.col("size") >= F.col("half"), at)), F.max(at))
    held = blocks.groupBy(*street).agg(held.alias("b")).select("b.*")
    inside = Window.partitionBy("low").orderBy("number")
    before = F.col("base") + F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    near = rows.join(held, "block").filter("number BETWEEN low AND high").withColumn("before", before)
    reaches = (F.col("before") + F.col("length") >= F.col("half")) | F.lead("number").over(inside).isNull()
    found = near.withColumn("reaches", reaches).filter("reaches").withColumn("n", F.row_number().over(inside)).filter("n = 1")
    return found.select(*street, "way", "run", "before", "half")


def merge_streets(runs: DataFrame) -> DataFrame:
    """runs (way, run, pos, name, context, lon, lat) as streets: one row for each lower-cased name and context.

    (key, context, name, ways, metres, lon, lat): the runs are laid end to end by way, run and position, the point lies
    half way along them, gaps between runs not counted; the name is the first run's. A null context is one of its own.
    Points are only ordered within their run; the sums of runs are ordered by ranges (middle_runs).
    """
    street, inside = ["key", "context"], Window.partitionBy("way", "run").orderBy("pos")
    to = F.lead(F.struct("lon", "lat")).over(inside)
    cut = runs.withColumn("to", to).withColumn("size", F.coalesce(haversine(F.col("lon"), F.col("lat"), F.col("to.lon"), F.col("to.lat")), F.lit(0.0)))
    cut = cut.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = cut.groupBy("way", "run").agg(F.sum("size").alias("length"), F.min_by(F.struct("name", "context"), "pos").alias("n"), F.count("*").alias("points"))
    sums = sums.select("way", "run", "length", "points", F.lower("n.name").alias("key"), F.col("n.context").alias("context"), F.col("n.name").alias("name"))
    sums = stage(sums, "runs")
    holds = middle_runs(sums.filter("points > 1"), street)
    end = F.col("before") + F.col("upto")
    t = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("half") - end + F.col("size")) / F.col("size")))).otherwise(0.0)
    spot = F.struct("pos", (F.col("lon") + t * (F.col("to.lon") - F.col("lon"))).alias("lon"), (F.col("lat") + t * (F.col("to.lat") - F.col("lat"))).alias("lat"))
    last = F.lead("to.lon").over(inside).isNull()
    mids = holds.join(cut.withColumn("last", last).filter("to IS NOT NULL").select("way", "run", "pos", "lon", "lat", "to", "size", "upto", "last"), ["way", "run"])
    mids = mids.filter((end >= F.col("half")) | F.col("last")).groupBy(*street).agg(F.min(spot).alias("spot")).select(F.col("key").alias("_key"), F.col("context").alias("_context"), "spot")
    found = sums.groupBy(*street).agg(F.min(F.struct("way", "run", "name")).alias("first"), F.countDistinct("way").alias("ways"), F.sum("length").alias("metres"))
    same = (F.col("key") == F.col("_key")) & F.col("context").eqNullSafe(F.col("_context"))
    return found.join(mids, same, "left").select(*street, F.col("first.name").alias("name"), "ways", "metres", "spot.lon", "spot.lat")


def vertex_at(line: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, route, metres): (id, pos) of the vertex nearest to that distance along the route; of two equally near the
    later. Routes of one vertex answer it. What asks meets the segments of its stretch alone."""
    hits = _on_stretches(line, asked).filter(F.col("start") + F.col("size") >= F.col("at"))
    first = hits.groupBy("id").agg(F.min(F.struct("pos", (F.col("at") - F.col("start")).alias("into"), "size")).alias("s"))
    found = first.select("id", (F.col("s.pos") + F.when(F.col("s.into") < F.col("s.size") - F.col("s.into"), 0).otherwise(1)).alias("pos"))
    return asked.select("id").join(found, "id", "left").select("id", F.coalesce("pos", F.lit(0)).alias("pos"))


def heading_along(line: DataFrame, asked: DataFrame, window: float = 45.0, ends: float = 5.0) -> DataFrame:
    """asked (id, route, metres): (id, heading) from 0 to 360 of the chord window metres to both sides of that place. Within
    ends metres of either end it is that of the first or last ends metres, of its segment if that is shorter."""
    rows = Window.partitionBy("route")
    cut = pieces(line).withColumn("total", F.max(F.col("start") + F.col("metres")).over(rows))
    size = cut.groupBy("route").agg(F.max("total").alias("total"), F.min_by("metres", "pos").alias("head"), F.max_by("metres", "pos").alias("tail"))
    at = F.greatest(F.lit(0.0), F.least("metres", "total"))
    edge = lambda seg: F.least(F.lit(ends), F.when(F.col(seg) > 0, F.col(seg)).otherwise(F.lit(ends)), "total")
    low = F.when(F.col("at") <= ends, 0.0).when(F.col("total") - F.col("at") <= ends, F.col("total") - edge("tail")).otherwise(F.greatest(F.lit(0.0), F.col("at") - window))
    high = F.when(F.col("at") <= ends, edge("head")).when(F.col("total") - F.col("at") <= ends, F.col("total")).otherwise(F.least("total", F.col("at") + window))
    spans = asked.join(size.filter("total > 0"), "route").withColumn("at", at)
    places = spans.select("id", "route", F.explode(F.array(F.struct(F.lit(0).alias("end"), low.alias("metres")), F.struct(F.lit(1).alias("end"), high.alias("metres")))).alias("p"))
    places = place_at(line, places.select(F.struct("id", "p.end").alias("id"), "route", "p.metres"))
    both = places.groupBy(F.col("id.id").alias("id")).agg(*(F.max(F.when(F.col("id.end") == e, F.struct("lon", "lat"))).alias(n) for e, n in ((0, "a"), (1, "b"))))
    turn = normalise_bearing(bearing(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")))
    return asked.select("id").join(both, "id", "left").select("id", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce(turn, F.lit(0.0))).alias("heading"))


def kept_vertices(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether each vertex stays: a stretch keeps its farthest vertex while that lies beyond the tolerance of its chord."""
    keep, stack = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
    keep[[0, -1]] = True
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d, p = xy[i], xy[j] - xy[i], xy[i + 1 : j] - xy[i]
        size = d @ d
        t = np.clip(p @ d / size, 0, 1) if size else np.zeros(len(p))
        far = np.hypot(*(p - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplified(line: DataFrame, metres: float) -> DataFrame:
    """The vertices of line (route, pos, lon, lat) that Douglas and Peucker's method keeps, distances taken in degrees.

    A route is simplified as a whole in one task, in 24 bytes a vertex.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        return group[kept_vertices(group[["lon", "lat"]].to_numpy(float), metres / M_PER_DEG)]

    rows = line.select("route", "pos", "lon", "lat")
    return rows.groupBy("route").applyInPandas(run, rows.schema)


def same_lines(a: DataFrame, b: DataFrame, within: float = 1e-5, samples: int = 20) -> DataFrame:
    """(route, same): whether the lines of a route in a and b have as many vertices and agree at about samples of them."""
    n = F.count("*").over(Window.partitionBy("route"))
    left, right = (df.select("route", "pos", F.col("lon").alias(f"{k}x"), F.col("lat").alias(f"{k}y"), n.alias(f"{k}n")) for df, k in ((a, "a"), (b, "b")))
    both = left.join(right, ["route", "pos"], "full")
    near = (F.abs(F.col("ax") - F.col("bx")) <= within) & (F.abs(F.col("ay") - F.col("by")) <= within)
    asked = F.col("pos") % F.greatest(F.lit(1), F.floor(F.coalesce("an", "bn") / samples)) == 0
    return both.groupBy("route").agg((F.every(F.coalesce(F.col("an") == F.col("bn"), F.lit(False))) & F.every(~asked | F.coalesce(near, F.lit(False)))).alias("same"))


def clipped(line: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """line (route, pos, x, y) inside a rectangle: (route, part, pos, x, y). A segment is cut where it crosses the border
    (Liang and Barsky's bounds, all in columns); a part ends where the line leaves the rectangle."""
    order = Window.partitionBy("route").orderBy("pos")
    cut = line.select("route", "pos", F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay")).withColumns({"bx": F.lead("ax").over(order), "by": F.lead("ay").over(order)}).filter("bx IS NOT NULL")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    sides = [(-dx, F.col("ax") - west), (dx, east - F.col("ax")), (-dy, F.col("ay") - south), (dy, north - F.col("ay"))]
    enter = F.greatest(F.lit(0.0), *(F.when(p < 0, q / F.nullif(p, F.lit(0.0))) for p, q in sides))
    leave = F.least(F.lit(1.0), *(F.when(p > 0, q / F.nullif(p, F.lit(0.0))) for p, q in sides))
    outside = F.greatest(*(F.when((p == 0) & (q < 0), 1).otherwise(0) for p, q in sides)) == 1
    cut = cut.withColumns({"t": enter, "u": leave}).filter(~outside & (F.col("t") <= F.col("u")) & ((F.col("t") < F.col("u")) | ((dx == 0) & (dy == 0))))
    new = ~F.coalesce((F.col("t") == 0) & (F.lag("u").over(order) == 1) & (F.lag("pos").over(order) == F.col("pos") - 1), F.lit(False))
    cut = cut.withColumn("part", F.sum(new.cast("int")).over(order) - 1).withColumn("new", new)
    at = lambda t: F.struct((F.col("ax") + t * dx).alias("x"), (F.col("ay") + t * dy).alias("y"))
    ends = F.when(F.col("new"), F.array(at(F.col("t")), at(F.col("u")))).otherwise(F.array(at(F.col("u"))))
    points = cut.select("route", "part", "pos", F.posexplode(ends).alias("k", "p"))
    return points.select("route", "part", (F.row_number().over(Window.partitionBy("route", "part").orderBy("pos", "k")) - 1).alias("pos"), "p.x", "p.y")


def clip_ring(ring: list[tuple[float, float]], west: float, south: float, east: float, north: float) -> list[tuple[float, float]]:
    """An open ring inside a rectangle, cut side by side; parts of a ring that leaves and comes back are joined along the
    border, which has no area."""
    for axis, bound, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out = []
        for k, b in enumerate(ring):
            a = ring[k - 1]
            inside = [sign * (p[axis] - bound) >= 0 for p in (a, b)]
            if inside[0] != inside[1]:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if inside[1]:
                out.append(b)
        ring = out
    return ring


def clipped_rings(ring: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """ring (route, pos, x, y), open: its part inside a rectangle, in the same columns; rings outside have no rows."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        found = clip_ring(list(zip(group["x"], group["y"])), west, south, east, north)
        return pd.DataFrame({"route": group["route"].iloc[0], "pos": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    rows = ring.select("route", F.col("pos").cast("int").alias("pos"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.groupBy("route").applyInPandas(run, rows.schema)


def wound(ring: DataFrame) -> DataFrame:
    """ring (route, pos, x, y, outer), open or closed, as map tiles want it: open, outer rings with a positive area on a grid
    whose y goes down, holes with a negative one; rings with an area under 4 have no rows."""
    rows = Window.partitionBy("route")
    order = rows.orderBy("pos")
    first, last = F.first(F.struct("x", "y")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.max("pos").over(rows)
    opened = ring.withColumns({"first": first, "last": last}).filter((F.col("pos") < F.col("last")) | (F.col("first") != F.struct("x", "y")) | (F.col("last") == 0))
    areas = ring_areas(opened.select("route", "pos", "x", "y")).select("route", "area2")
    turned = opened.join(areas, "route").withColumn("place", F.when((F.col("area2") > 0) == F.col("outer"), F.col("pos")).otherwise(-F.col("pos")))
    return turned.select("route", (F.row_number().over(rows.orderBy("place")) - 1).alias("pos"), "x", "y", "outer")
