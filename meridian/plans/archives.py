"""Queries over archives and over orders of whole files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import order, polygons, roads
from ..sources import pmtiles
from ..storage import shared_dir
from .areas import AREA, boxes
from .catalog import query, read

#: Contents of the tiles that stand for an archive's: a third of them share one, runs are broken every fifty tiles.
CONTENT = "repeat('x', (c_custkey // 7 % 30)::INT) || CASE WHEN c_custkey % 3 = 0 THEN 'sea' ELSE (c_custkey // 7 % 30)::VARCHAR END"


@query(f"""WITH t AS (SELECT c_custkey + c_custkey // 50 AS tile_id, CASE WHEN c_custkey // 9 % 3 = 0 THEN 'sea' ELSE {CONTENT} END AS data FROM customer),
c AS (SELECT data, min(tile_id) AS tile_id, octet_length(encode(any_value(data))) AS length FROM t GROUP BY data), o AS (SELECT data, length, coalesce(sum(length) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c),
g AS (SELECT *, tile_id - row_number() OVER (PARTITION BY data ORDER BY tile_id) AS grp FROM t)
SELECT min(tile_id) AS first_id, count(*) AS run_length, any_value(length)::BIGINT AS length, any_value("offset") AS "offset" FROM g JOIN o USING (data) GROUP BY data, grp""")
def tile_archive(spark, d):
    """The entries of an archive of customers' tiles, read back from its directories."""
    k = F.col("c_custkey")
    step = F.floor(k / 7) % 30
    content = F.concat(F.expr("repeat('x', CAST(floor(c_custkey / 7) % 30 AS INT))"), F.when(k % 3 == 0, "sea").otherwise(step.cast("string")))
    tiles = read(spark, d, "customer").select((k + F.floor(k / 50)).alias("tile_id"), F.when(F.floor(k / 9) % 3 == 0, "sea").otherwise(content).cast("binary").alias("data"))
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    pmtiles.write(tiles, path, (0, 14), (-114.0, 51.0, -113.7, 54.0), {"name": "customers"}, "none", small=0)
    return pmtiles.entries(pmtiles.pieces(spark, path))


@query("""WITH n AS (SELECT c_custkey AS node, row_number() OVER (ORDER BY c_custkey) - 1 AS slot FROM customer WHERE c_acctbal > 0)
SELECT a.slot AS src, b.slot AS dst FROM (SELECT c_custkey AS s, c_custkey + 1 AS t FROM customer UNION ALL SELECT c_custkey + 100, c_custkey FROM customer) JOIN n a ON a.node = s JOIN n b ON b.node = t""")
def dense_slots(spark, d):
    """Edges over the slots of the nodes that are kept."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    edges = c.select(k.alias("src"), (k + 1).alias("dst")).unionByName(c.select((k + 100).alias("src"), k.alias("dst")))
    return roads.slotted(edges, roads.slots(c.filter("c_acctbal > 0").select(k.alias("node"))))


@query("""WITH f AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS place, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_linenumber // 3 END AS kind, l_partkey AS id FROM lineitem),
g AS (SELECT *, lag(kind) OVER (ORDER BY place) AS kind_before, lag(id) OVER (ORDER BY place) AS id_before FROM f)
SELECT place, kind::INT AS kind, id, kind_before::INT AS kind_before, id_before FROM g WHERE place > 0 AND (kind_before, id_before) > (kind, id)""")
def file_disorder(spark, d):
    """Where elements of a file come after others of a later kind, or of theirs and a larger id."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    kind = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.floor(F.col("l_linenumber") / 3)).cast("int")
    rows = order.numbered(read(spark, d, "lineitem").select(*names), *names, name="place").select("place", kind.alias("kind"), F.col("l_partkey").alias("id"))
    return order.disorder(rows, "place", "kind", "id").select("place", "kind", "id", F.col("previous.kind").alias("kind_before"), F.col("previous.id").alias("id_before"))


MERCATOR = "((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2)"
TALL = f"({MERCATOR.format('lo')} - {MERCATOR.format('hi')})"


@query(f"""WITH {AREA}, p AS (SELECT k, hole, wide, south AS lo, south + high AS hi FROM b), a AS (SELECT k, wide / 360 * {TALL} AS area FROM p),
h AS (SELECT k, wide / 2 / 360 * {TALL} AS area FROM (SELECT k, wide, lo + (hi - lo) / 4 AS lo, lo + (hi - lo) * 3 / 4 AS hi FROM p WHERE hole))
SELECT k AS id, unnest(generate_series(0, 14))::INT AS zoom, round((a.area - coalesce(h.area, 0)) * 1e12, 2) AS area FROM a LEFT JOIN h USING (k)""")
def pyramid_areas(spark, d):
    """Rectangles, every third with a hole, cut to the tiles of 15 zooms: what a zoom's pieces add up to."""
    at = boxes(spark, d)

    def ring(low, high):
        corners = [(low, low), (high, low), (high, high), (low, high)]
        spots = [geo.mercator(F.col("west") + F.col("wide") * x, F.col("south") + F.col("high") * y) for x, y in corners]
        return F.array(*(s[c] for s in spots for c in ("x", "y")))

    rings = F.when(F.col("k") % 3 == 0, F.array(ring(0.0, 1.0), ring(0.25, 0.75))).otherwise(F.array(ring(0.0, 1.0)))
    pieces = polygons.areas(polygons.to_tiles(at.select(F.col("k").alias("id"), rings.alias("rings")), 14))
    return pieces.groupBy("id", "zoom").agg(F.round(F.sum("area") * 1e12, 2).alias("area"))
