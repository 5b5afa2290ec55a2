"""Areas from relations: rings from member ways, holes, containment, administrative context, centroids.

members (relation, idx, way, role), ways (way, refs array), nodes (node, lon, lat). Rings are rows (relation, inner, ring,
pos, node, lon, lat), closed: the last point repeats the first. Edges of areas are rows (area, ax, ay, bx, by).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stage

#: Edges wanted in a band of latitude, into which an area's edges are dealt so that a point meets only those beside it, and
#: the most bands that an edge of an area lies in on average.
BAND_EDGES, SPREAD = 4, 4


def kept_ways(ways: DataFrame, members: DataFrame, own: Column) -> DataFrame:
    """Ways that are of interest themselves or are members of a relation; each way once."""
    wanted = members.select("way").distinct().withColumn("member", F.lit(True))
    return ways.join(wanted, "way", "left").filter(own | F.col("member")).drop("member")


def kept_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """The nodes that ways refer to."""
    return nodes.join(ways.select(F.explode("refs").alias("node")), "node", "left_semi")


def free_ways(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Ways that no drawn relation has as a member, as those are drawn with it."""
    return ways.join(members.select("way"), "way", "left_anti")


def ring_order(members: DataFrame, ways: DataFrame) -> DataFrame:
    """(relation, inner, ring, place, way, backwards): how member ways follow each other around closed rings.

    Ways join where they share an end node. Only their ends are gathered by relation, not their points; ways of a chain
    that does not close are in no ring.
    """
    ends = members.join(ways.select("way", F.element_at("refs", 1).alias("first"), F.element_at("refs", -1).alias("last"), F.size("refs").alias("n")).filter("n > 0"), "way")
    ends = ends.select("relation", F.coalesce(F.col("role") == "inner", F.lit(False)).alias("inner"), "idx", "way", "first", "last", "n")

    schema = pa.schema([("relation", pa.int64()), ("inner", pa.bool_()), ("ring", pa.int32()), ("place", pa.int32()), ("way", pa.int64()), ("backwards", pa.bool_())])

    def walk(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("idx", "way", "first", "last", "n"))), key=lambda r: (r[0] is None, r[0] or 0))
        _, way, first, last, size = zip(*rows)
        at, free, rings, out = {}, set(range(len(way))), 0, []
        for k in free:
            for node in {first[k], last[k]}:
                at.setdefault(node, []).append(k)
        for k in range(len(way) - 1, -1, -1):
            if k not in free:
                continue
            free.discard(k)
            chain, end = [(way[k], False)], last[k]
            count = size[k]
            while end != first[k]:
                found = next((j for j in at[end] if j in free), None)
                if found is None:
                    break
                free.discard(found)
                back = last[found] == end
                chain.append((way[found], back))
                end, count = (first if back else last)[found], count + size[found] - 1
            if end == first[k] and count >= 4:
                out += [(rings, place, w, back) for place, (w, back) in enumerate(chain)]
                rings += 1
        whose = group.column("relation")[0].as_py(), group.column("inner")[0].as_py()
        return pa.table([pa.array([(*whose, *r)[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    ends = ends.withColumn("relation", F.col("relation").cast("long"))
    return ends.groupBy("relation", "inner").applyInArrow(walk, "relation long, inner boolean, ring int, place int, way long, backwards boolean")


def rings(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation, inner, ring, pos, node, lon, lat) of rings all of whose nodes are known."""
    order = ring_order(members, ways).join(ways.select("way", "refs"), "way")
    refs = F.when(F.col("backwards"), F.reverse("refs")).otherwise(F.col("refs"))
    points = order.withColumn("refs", refs).select("relation", "inner", "ring", "place", F.posexplode("refs").alias("at", "node")).filter("at > 0 OR place = 0")
    by = ["relation", "inner", "ring"]
    found = points.join(nodes.select("node", "lon", "lat"), "node", "left")
    found = found.withColumn("lost", F.max(F.col("lon").isNull()).over(Window.partitionBy(*by))).filter("NOT lost")
    pos = F.row_number().over(Window.partitionBy(*by).orderBy("place", "at")) - 1
    return found.select(*by, pos.alias("pos"), "node", "lon", "lat")


def ring_edges(points: DataFrame, by: list[str]) -> DataFrame:
    """(*by, ax, ay, bx, by_): the edges of closed rings."""
    to = F.lead(F.struct("lon", "lat")).over(Window.partitionBy(*by).orderBy("pos"))
    cut = points.withColumn("to", to).filter("to IS NOT NULL")
    return cut.select(*by, F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.col("to.lon").alias("bx"), F.col("to.lat").alias("by"))


def measures(points: DataFrame, by: list[str]) -> DataFrame:
    """(*by, area2, cx, cy, points): twice the signed area in square degrees and the centroid of closed rings."""
    x0, y0 = F.col("x0"), F.col("y0")
    first = F.first(F.struct("lon", "lat")).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    to = F.lead(F.struct("lon", "lat")).over(Window.partitionBy(*by).orderBy("pos"))
    cut = points.withColumns({"first": first, "to": to}).withColumns({"x0": F.col("first.lon"), "y0": F.col("first.lat")})
    # from the first point, so that small rings far from the origin keep their digits
    ax, ay, bx, by_ = F.col("lon") - x0, F.col("lat") - y0, F.col("to.lon") - x0, F.col("to.lat") - y0
    cross = ax * by_ - bx * ay
    sums = cut.groupBy(*by).agg(F.sum(cross).alias("area2"), F.sum((ax + bx) * cross).alias("sx"), F.sum((ay + by_) * cross).alias("sy"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.count("*").alias("points"))
    return sums.select(*by, "area2", *((F.col(c) + F.when(F.col("area2") != 0, F.col(s) / (3 * F.col("area2"))).otherwise(0.0)).alias(n) for c, s, n in (("x0", "sx", "cx"), ("y0", "sy", "cy"))), "points")


def mean_centres(points: DataFrame, by: str = "way") -> DataFrame:
    """(by, lon, lat): the mean of a line's points; a closing point counts twice."""
    return points.groupBy(by).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """points (lon, lat, ...) joined with the boxes (west, south, east, north, ...) that hold them, bounds included.

    A box is dealt to at most a few cells whatever its extent: larger boxes use cells of twice, four times ... the size.
    Levels number a few tens at most; points are dealt once for each level that a box has.
    """
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent / (3 * cell), F.lit(1e-9))))).cast("int")
    at = lambda c: F.floor(F.col(c) / (F.pow(F.lit(2.0), F.col("_level")) * cell)).cast("long")
    dealt = boxes.withColumn("_level", level).withColumn("_cx", F.explode(F.sequence(at("west"), at("east")))).withColumn("_cy", F.explode(F.sequence(at("south"), at("north"))))
    levels = [r[0] for r in boxes.select(level.alias("l")).distinct().collect()]
    spread = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumns({"_cx": at("lon"), "_cy": at("lat")})
    inside = (F.col("lon") >= F.col("west")) & (F.col("lon") <= F.col("east")) & (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north"))
    return spread.join(dealt, ["_level", "_cx", "_cy"]).filter(inside).drop("_level", "_cx", "_cy")


def contains(points: DataFrame, edges: DataFrame, cell: float = 0.05) -> DataFrame:
    """(point, area) of the points (point, lon, lat) inside areas: an odd number of edges lies east of them.

    edges are those of an area's outer rings and holes. Boxes are joined first; then a point meets only the edges of its
    band of latitude. An area has as many bands as its edges ask for, fewer where long edges would lie in most of them.
    Points on an edge may fall on either side.
    """
    edges = stage(edges.select("area", "ax", "ay", "bx", "by"), "edges")
    box = edges.groupBy("area").agg(F.min("ax").alias("west"), F.min("ay").alias("south"), F.max("ax").alias("east"), F.max("ay").alias("north"), F.count("*").alias("n"), F.sum(F.abs(F.col("ay") - F.col("by"))).alias("steep"))
    tall = F.col("north") - F.col("south")
    bands = F.least(F.col("n") / BAND_EDGES, F.coalesce(SPREAD * F.col("n") * tall / F.nullif("steep", F.lit(0.0)), F.lit(1.0)))
    box = stage(box.withColumn("bands", F.greatest(F.lit(1), F.floor(bands)).cast("int")).drop("n", "steep"), "boxes")
    high = F.greatest((F.col("north") - F.col("south")) / F.col("bands"), F.lit(1e-12))
    band = lambda y: F.least(F.col("bands"), F.greatest(F.lit(0), F.floor((y - F.col("south")) / high))).cast("int")
    near = in_boxes(points.select("point", "lon", "lat"), box, cell).withColumn("band", band(F.col("lat"))).select("point", "lon", "lat", "area", "band")
    cut = edges.join(box, "area").withColumn("band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by"))))).select("area", "band", "ax", "ay", "bx", "by")
    lon, lat = F.col("lon"), F.col("lat")
    east = ((F.col("ay") > lat) != (F.col("by") > lat)) & (lon < (F.col("bx") - F.col("ax")) * (lat - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax"))
    return near.join(cut, ["area", "band"]).groupBy("point", "area").agg(F.count_if(east).alias("n")).filter("n % 2 = 1").select("point", "area")


def hole_owners(points: DataFrame) -> DataFrame:
    """(relation, ring, hole): for each outer ring the inner rings of its relation whose first point lies inside it."""
    outer = points.filter("NOT inner")
    edges = ring_edges(outer, ["relation", "ring"]).withColumn("area", F.struct("relation", "ring")).drop("relation", "ring")
    starts = points.filter("inner AND pos = 0").select(F.struct("relation", "ring").alias("point"), "lon", "lat")
    found = contains(starts, edges).filter("point.relation = area.relation")
    return found.select("area.relation", F.col("area.ring").alias("ring"), F.col("point.ring").alias("hole"))


def area_edges(points: DataFrame) -> DataFrame:
    """(relation, ring, ax, ay, bx, by): the edges of each outer ring and of its holes."""
    own = ring_edges(points.filter("NOT inner"), ["relation", "ring"])
    holes = ring_edges(points.filter("inner"), ["relation", "ring"]).withColumnRenamed("ring", "hole")
    return own.unionByName(holes.join(hole_owners(points), ["relation", "hole"]).drop("hole"))


def admin_context(points: DataFrame, areas: DataFrame, edges: DataFrame, cell: float = 0.05) -> DataFrame:
    """(point, city, state, country) of points inside areas (area, level, name, size): for each slot the name of the highest
    level, then the smallest area, then the last name. Levels 2, 3 to 4 and 6 to 8 have slots; points in none have no row."""
    slot = F.when(F.col("level") == 2, "country").when(F.col("level").isin(3, 4), "state").when(F.col("level").between(6, 8), "city")
    hits = contains(points, edges, cell).join(areas, "area").withColumn("slot", slot).filter("slot IS NOT NULL")
    last = lambda s: F.max(F.when(F.col("slot") == s, F.struct("level", (-F.col("size")).alias("size"), "name")))["name"].alias(s)
    return hits.groupBy("point").agg(*map(last, ("city", "state", "country")))
