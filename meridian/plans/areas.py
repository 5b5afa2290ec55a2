"""Queries over areas: rectangles with holes, cut into member ways that lie in any direction and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas
from ..storage import stage
from .catalog import GRID, WAYS, grid, query, read, way_points

# corners of relation k's rectangle and, for every third relation, of its hole; off the grid that points lie on
AREA = """b AS (SELECT s_suppkey AS k, -114.00037::DOUBLE + (s_suppkey % 50) * 0.02::DOUBLE AS west, 50.99941::DOUBLE + (s_suppkey // 50) * 0.02::DOUBLE AS south, 0.015::DOUBLE + (s_suppkey % 7) * 0.002::DOUBLE AS wide, 0.012::DOUBLE + (s_suppkey % 5) * 0.002::DOUBLE AS high, s_suppkey % 3 = 0 AS hole, s_suppkey % 11 <> 5 AS whole FROM supplier)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("k"), (-114.00037 + (k % 50) * 0.02).alias("west"), (50.99941 + F.floor(k / 50) * 0.02).alias("south"), (0.015 + (k % 7) * 0.002).alias("wide"), (0.012 + (k % 5) * 0.002).alias("high"))


def relation_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes 0 to 7 around a rectangle, 8 to 11 around its hole; a node is missing where 11 leaves 5."""
    spots = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1), (0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
    spot = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x / 2).alias("x"), F.lit(y / 2).alias("y")) for i, (x, y) in enumerate(spots)))
    at = boxes(spark, d).withColumn("s", F.explode(spot)).filter("NOT (k % 11 = 5 AND s.i = 4)")
    return at.select((F.col("k") * 100 + F.col("s.i")).alias("node"), (F.col("west") + F.col("wide") * F.col("s.x")).alias("lon"), (F.col("south") + F.col("high") * F.col("s.y")).alias("lat"))


def relation_ways(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(members, ways): three ways around a rectangle, one of them backwards, and two around a hole."""
    parts = [("outer", [0, 1, 2, 3]), ("outer", [5, 4, 3]), ("outer", [5, 6, 7, 0]), ("inner", [8, 9, 10]), ("inner", [8, 11, 10])]
    part = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(role).alias("role"), F.array(*map(F.lit, refs)).alias("refs")) for i, (role, refs) in enumerate(parts)))
    cut = boxes(spark, d).select("k", F.explode(part).alias("p")).filter("p.role = 'outer' OR k % 3 = 0")
    way = (F.col("k") * 100 + F.col("p.i")).alias("way")
    members = cut.select(F.col("k").alias("relation"), ((F.col("p.i") * 2 + F.col("k")) % 5).cast("int").alias("idx"), way, F.col("p.role").alias("role"))
    return members, cut.select(way, F.transform("p.refs", lambda i: F.col("k") * 100 + i).alias("refs"))


def relation_rings(spark: SparkSession, d: str) -> DataFrame:
    members, ways = relation_ways(spark, d)
    return stage(areas.rings(members, ways, relation_nodes(spark, d)), "rings")


@query(f"""WITH {AREA} SELECT k AS relation, inner_ AS "inner", points, round(area2, 9) AS area2, round(west + wide / 2, 6) AS cx, round(south + high / 2, 6) AS cy FROM (SELECT *, FALSE AS inner_, 9::BIGINT AS points, 2 * wide * high AS area2 FROM b WHERE whole UNION ALL SELECT *, TRUE, 5, wide * high / 2 FROM b WHERE hole)""")
def ring_assembly(spark, d):
    m = areas.measures(relation_rings(spark, d), ["relation", "inner", "ring"])
    return m.select("relation", "inner", "points", F.round(F.abs("area2"), 9).alias("area2"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"WITH {AREA} SELECT k AS relation, 1::BIGINT AS holes FROM b WHERE hole AND whole")
def hole_owners(spark, d):
    return areas.hole_owners(relation_rings(spark, d)).groupBy("relation").agg(F.count("*").alias("holes"))


@query("WITH b AS (SELECT s_suppkey AS k FROM supplier) SELECT k * 100 + unnest(CASE WHEN k % 3 = 0 THEN generate_series(0, 11) ELSE generate_series(0, 7) END) AS node FROM b EXCEPT SELECT k * 100 + 4 FROM b WHERE k % 11 = 5")
def member_nodes(spark, d):
    members, ways = relation_ways(spark, d)
    return areas.kept_nodes(relation_nodes(spark, d), areas.kept_ways(ways, members, F.lit(False))).select("node")


INSIDE = f"""{GRID}, {AREA}, h AS (SELECT node AS point, k AS relation, wide, high FROM g JOIN b ON whole AND lon > west AND lon < west + wide AND lat > south AND lat < south + high
 AND NOT (hole AND lon > west + wide / 4 AND lon < west + wide * 3 / 4 AND lat > south + high / 4 AND lat < south + high * 3 / 4))"""


def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    return areas.area_edges(relation_rings(spark, d)).withColumnRenamed("relation", "area").drop("ring")


@query(f"WITH {INSIDE} SELECT point, relation FROM h")
def area_contains(spark, d):
    points = grid(spark, d).select(F.col("node").alias("point"), "lon", "lat")
    return areas.contains(points, relation_edges(spark, d)).withColumnRenamed("area", "relation")


@query(f"""WITH {INSIDE}, s AS (SELECT *, CASE relation % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 6 END AS level FROM h), r AS (SELECT *, 'area ' || relation AS name, CASE level WHEN 2 THEN 'country' WHEN 4 THEN 'state' ELSE 'city' END AS slot,
  row_number() OVER (PARTITION BY point, CASE level WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 8 END ORDER BY level DESC, round(wide * high, 9), 'area ' || relation DESC) AS rn FROM s)
SELECT point, max(CASE WHEN slot = 'city' THEN name END) AS city, max(CASE WHEN slot = 'state' THEN name END) AS state, max(CASE WHEN slot = 'country' THEN name END) AS country FROM r WHERE rn = 1 GROUP BY point""")
def admin_slots(spark, d):
    k = F.col("k")
    level = F.when(k % 4 == 0, 2).when(k % 4 == 1, 4).when(k % 4 == 2, 8).otherwise(6)
    named = boxes(spark, d).select(k.alias("area"), level.alias("level"), F.concat(F.lit("area "), k.cast("string")).alias("name"), F.round(F.col("wide") * F.col("high"), 9).alias("size"))
    points = grid(spark, d).select(F.col("node").alias("point"), "lon", "lat")
    return areas.admin_context(points, named, relation_edges(spark, d))


@query(f"WITH {WAYS} SELECT way, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM r GROUP BY way")
def mean_centres(spark, d):
    return areas.mean_centres(way_points(spark, d)).select("way", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("WITH b AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS hole FROM supplier) SELECT k * 100 + unnest(CASE WHEN hole THEN generate_series(0, 4) ELSE generate_series(0, 2) END) AS way FROM b WHERE k % 2 = 1")
def free_ways(spark, d):
    """The ways of every other relation, whose members they no longer are."""
    members, ways = relation_ways(spark, d)
    return areas.free_ways(ways, members.filter("relation % 2 = 0")).select("way")


@query("WITH b AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS hole FROM supplier), w AS (SELECT k, k * 100 + unnest(CASE WHEN hole THEN generate_series(0, 4) ELSE generate_series(0, 2) END) AS way FROM b) SELECT way FROM w WHERE k % 2 = 0 OR way % 4 = 1")
def kept_ways(spark, d):
    """Ways of interest themselves or as members."""
    members, ways = relation_ways(spark, d)
    return areas.kept_ways(ways, members.filter("relation % 2 = 0"), F.col("way") % 4 == 1).select("way")
