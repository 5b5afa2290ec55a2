"""Registry of the engine's queries over the driver's tables, with DuckDB SQL that says the same.

The tables hold no geography, so coordinates come from integer keys: key k lies at (-114 + (k mod 100) * 0.003,
51 + (k div 100) * 0.002). A way is an order, its points are the order's lines in a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, tags, text
from ..operators import admission, lines as polylines, roads, search, tiles, trips
from ..operators.order import dealt

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from . import archives, areas, journeys  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lon(k: Column) -> Column:
    return -114.0 + (k % 100) * 0.003


def lat(k: Column) -> Column:
    return 51.0 + F.floor(k / 100) * 0.002


def grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("node"), lon(k).alias("lon"), lat(k).alias("lat"), "c_mktsegment", "c_acctbal", "c_nationkey", "c_name")


GRID = "g AS (SELECT c_custkey AS node, -114.0 + (c_custkey % 100) * 0.003::DOUBLE AS lon, 51.0 + (c_custkey // 100) * 0.002::DOUBLE AS lat, c_mktsegment, c_acctbal, c_nationkey, c_name FROM customer)"
HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"


def hav(a: str, b: str, c: str, d: str) -> str:
    return HAV.format(a=f"({a})", b=f"({b})", c=f"({c})", d=f"({d})")


# --- scalars ---


@query(f"WITH {GRID} SELECT node, round({hav('-114.0', '51.0', 'lon', 'lat')}, 3) AS metres FROM g")
def geo_haversine(spark, d):
    g = grid(spark, d)
    return g.select("node", F.round(geo.haversine(F.lit(-114.0), F.lit(51.0), F.col("lon"), F.col("lat")), 3).alias("metres"))


@query(f"""WITH {GRID} SELECT node, round(degrees(atan2(sin(radians(lon + 114.1)) * cos(radians(lat)), cos(radians(50.9)) * sin(radians(lat)) - sin(radians(50.9)) * cos(radians(lat)) * cos(radians(lon + 114.1)))), 4) AS bearing FROM g""")
def geo_bearing(spark, d):
    g = grid(spark, d)
    return g.select("node", F.round(geo.bearing(F.lit(-114.1), F.lit(50.9), F.col("lon"), F.col("lat")), 4).alias("bearing"))


@query("SELECT o_orderkey, round(least(120.0, o_totalprice * 3 / 500) + least(350.0, greatest(0.0, o_totalprice * 3 - 200000) / 3000), 4) AS bias FROM orders")
def geo_bias(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(geo.distance_bias(F.col("o_totalprice") * 3), 4).alias("bias"))


@query("""SELECT o_orderkey, CASE WHEN m < 20 THEN (CASE WHEN m > 0 AND floor(m / 5 + 0.5) * 5 = 0 THEN 5 ELSE floor(m / 5 + 0.5) * 5 END)::BIGINT || ' m' WHEN m < 1000 THEN (CASE WHEN floor(m / 10 + 0.5) * 10 = 0 THEN 10 ELSE floor(m / 10 + 0.5) * 10 END)::BIGINT || ' m'
  WHEN m / 1000 < 10 THEN printf('%.1f', m / 1000) || ' km' ELSE floor(m / 1000 + 0.5)::BIGINT || ' km' END AS metric,
  CASE WHEN m / 1609.344 < 0.1 THEN (CASE WHEN m > 0 AND floor(m * 3.28084 / 50 + 0.5) * 50 = 0 THEN 50 ELSE floor(m * 3.28084 / 50 + 0.5) * 50 END)::BIGINT || ' ft' WHEN m / 1609.344 < 10 THEN printf('%.1f', m / 1609.344) || ' mi' ELSE floor(m / 1609.344 + 0.5)::BIGINT || ' mi' END AS imperial
  FROM (SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1000 ELSE o_totalprice END)::DOUBLE AS m FROM orders)""")
def fmt_distance(spark, d):
    m = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice"))
    return read(spark, d, "orders").select("o_orderkey", geo.format_distance(m, even=True).alias("metric"), geo.format_distance(m, "imperial", even=True).alias("imperial"))


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN '<1 min' WHEN h = 0 THEN (t % 60) || ' min' WHEN h = 1 AND t % 60 = 0 THEN '1 hr' ELSE h || ' hr ' || (t % 60) || ' min' END AS duration
  FROM (SELECT *, t // 60 AS h FROM (SELECT o_orderkey, o_totalprice / 30 AS s, floor(o_totalprice / 30 / 60 + 0.5)::BIGINT AS t FROM orders))""")
def fmt_duration(spark, d):
    return read(spark, d, "orders").select("o_orderkey", geo.format_duration(F.col("o_totalprice") / 30).alias("duration"))


@query(f"""SELECT event_id, CASE WHEN m <= 0 THEN 0 {' '.join(f'WHEN m <= {r} THEN {r}' for r in geo.RUNGS_METRIC)} ELSE ceil(m / 10000) * 10000 END::BIGINT AS metric,
  CASE WHEN m <= 0 THEN 0 {' '.join(f'WHEN m <= {r} THEN {r}' for r in geo.RUNGS_IMPERIAL)} ELSE ceil(m / 16093) * 16093 END::BIGINT AS imperial FROM (SELECT event_id, value * 700 AS m FROM events)""")
def voice_band(spark, d):
    m = F.col("value") * 700
    return read(spark, d, "events").select("event_id", geo.announce_band(m).alias("metric"), geo.announce_band(m, "imperial").alias("imperial"))


@query("SELECT s_suppkey, round(least(1.0, CASE s_nationkey % 9 WHEN 0 THEN 0.75 WHEN 1 THEN 0.65 WHEN 2 THEN 0.55 WHEN 3 THEN 0.45 WHEN 4 THEN 0.38 WHEN 5 THEN 0.32 WHEN 6 THEN 0.25 WHEN 7 THEN 0.12 ELSE 0.2 END + log10(greatest(1.0, s_acctbal * 100)) * 0.025 + greatest(0.0, 12.0 - s_nationkey) * 0.008), 6) AS importance FROM supplier")
def importance(spark, d):
    kinds = F.array(*map(F.lit, [*tags.IMPORTANCE, "poi"]))
    kind = F.element_at(kinds, F.col("s_nationkey") % 9 + 1)
    return read(spark, d, "supplier").select("s_suppkey", F.round(tags.importance(kind, F.col("s_acctbal") * 100, F.col("s_nationkey")), 6).alias("importance"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- classification: the tags of a part come from its key ---

CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "track", "footway")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    pairs = [("highway", F.when(k % 2 == 0, pick(CLASSES, k))), ("maxspeed", F.when(k % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" km/h")))), ("access", F.when(k % 11 == 0, "private")), ("oneway", F.when(k % 7 == 0, "yes").when(k % 7 == 1, "-1")),
             ("waterway", F.when(k % 13 == 1, "river")), ("natural", F.when(k % 17 == 3, "water").when(k % 17 == 5, "wood")), ("leisure", F.when(k % 3 == 1, "park"))]
    made = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(a), b) for a, b in pairs)), lambda e: e["col2"].isNotNull()))
    return read(spark, d, "part").select(k.alias("id"), made.alias("tags"))


TAGGED = f"""t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN list_value({', '.join(f"'{c}'" for c in CLASSES)})[p_partkey % 9 + 1] END AS highway, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS maxspeed, p_partkey % 11 = 0 AS private,
  CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 7 = 1 THEN 2 ELSE 3 END AS flags, CASE WHEN p_partkey % 13 = 1 THEN 'river' END AS waterway, CASE WHEN p_partkey % 17 = 3 THEN 'water' WHEN p_partkey % 17 = 5 THEN 'wood' END AS nat, CASE WHEN p_partkey % 3 = 1 THEN 'park' END AS leisure FROM part),
z(c, zoom, kmh) AS (VALUES {', '.join(f"('{c}', {tags.MIN_ZOOM.get(c, 'NULL')}, {tags.SPEED.get(c, 0)})" for c in CLASSES)}),
f AS (SELECT id, CASE WHEN highway IS NOT NULL THEN CASE WHEN zoom IS NOT NULL THEN 'roads' END WHEN waterway IS NOT NULL OR nat = 'water' THEN 'water' WHEN leisure IS NOT NULL OR nat = 'wood' THEN 'green' END AS layer,
  CASE WHEN highway IS NOT NULL THEN highway WHEN waterway IS NOT NULL THEN waterway WHEN nat = 'water' THEN 'water' WHEN leisure IS NOT NULL THEN leisure ELSE nat END AS class,
  highway IS NULL AND waterway IS NULL AS polygon, CASE WHEN highway IS NOT NULL THEN zoom ELSE 5 END::INT AS min_zoom FROM t LEFT JOIN z ON highway = c)"""


@query(f"WITH {TAGGED} SELECT id, layer, class, polygon, min_zoom FROM f WHERE layer IS NOT NULL")
def classify_feature(spark, d):
    return tagged(spark, d).withColumn("f", tags.feature(F.col("tags"))).filter("f IS NOT NULL").select("id", "f.*")


@query(f"WITH {TAGGED} SELECT class, count(*) AS features FROM f WHERE layer IS NOT NULL AND min_zoom <= 12 GROUP BY class")
def zoom_filter(spark, d):
    return classify_feature(spark, d).filter("min_zoom <= 12").groupBy("class").agg(F.count("*").alias("features"))


@query(f"WITH {TAGGED} SELECT id, CASE WHEN highway IS NULL OR private THEN 0 ELSE least(kmh, coalesce(maxspeed, kmh)) END::INT AS speed, flags::INT AS flags FROM t LEFT JOIN z ON highway = c")
def speed_table(spark, d):
    return tagged(spark, d).select("id", tags.speed(F.col("tags")).alias("speed"), tags.oneway_flags(F.col("tags")).cast("int").alias("flags"))


# --- ways, graph ---


def way_refs(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    refs = path_rows(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return refs.select(F.col("l_orderkey").alias("way"), (F.row_number().over(order) - 1).alias("pos"), known(F.col("l_partkey")).alias("node"))


def way_lists(spark: SparkSession, d: str) -> DataFrame:
    """(way, refs): way_refs() as one row for each way; the lines of an order are sorted in its own array alone."""
    rows = path_rows(spark, d).withColumn("node", known(F.col("l_partkey")))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "node")
    return rows.groupBy(F.col("l_orderkey").alias("way")).agg(F.sort_array(F.collect_list(line))["node"].alias("refs"))


def path_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines of orders, those of an order in one task."""
    lines = read(spark, d, "lineitem")
    return dealt(lines, lines.count(), "l_orderkey")


def known(k: Column) -> Column:
    """References to parts that 7 divides point nowhere: they are negated."""
    return F.when(k % 7 == 0, -k).otherwise(k)


def way_nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("node"), lon(k).alias("lon"), lat(k).alias("lat"))


WAYS = """refs AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos, CASE WHEN l_partkey % 7 = 0 THEN -l_partkey ELSE l_partkey END AS node FROM lineitem),
n AS (SELECT p_partkey AS node, -114.0 + (p_partkey % 100) * 0.003::DOUBLE AS lon, 51.0 + (p_partkey // 100) * 0.002::DOUBLE AS lat FROM part),
j AS (SELECT way, pos, refs.node, lon, lat, sum(CASE WHEN lon IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY pos) AS run FROM refs LEFT JOIN n USING (node)),
r AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY way, run) AS k FROM j WHERE lon IS NOT NULL) WHERE k >= 2),
""" + f"""s AS (SELECT way, run, pos, node AS src, nn AS dst, {hav('lon', 'lat', 'nlon', 'nlat')} AS metres FROM (SELECT *, lead(node) OVER w AS nn, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM r WINDOW w AS (PARTITION BY way, run ORDER BY pos)) WHERE nn IS NOT NULL),
e AS (SELECT src, dst, ((metres / (40 * 0.27778) + 6)::FLOAT)::DOUBLE AS cost, fl FROM (SELECT *, CASE way % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS fl FROM s WHERE metres <= 20000))"""


def way_points(spark, d):
    return roads.runs(way_refs(spark, d), way_nodes(spark, d), rows=read(spark, d, "lineitem").count())


def way_edges(spark, d):
    flags = F.when(F.col("way") % 3 == 0, 1).when(F.col("way") % 3 == 1, 2).otherwise(3)
    return roads.edges(roads.segments(way_points(spark, d)), F.lit(40), F.lit(6), flags)


@query(f"WITH {WAYS} SELECT way, run::BIGINT AS run, count(*) AS points, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM r GROUP BY way, run")
def way_runs(spark, d):
    return way_points(spark, d).groupBy("way", "run").agg(F.count("*").alias("points"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"WITH {WAYS} SELECT way, pos::INT AS pos, src, dst, round(metres, 3) AS metres FROM s")
def way_segments(spark, d):
    return roads.segments(way_points(spark, d)).select("way", "pos", "src", "dst", F.round("metres", 3).alias("metres"))


@query(f"WITH {WAYS}, b AS (SELECT src, dst, cost FROM e WHERE fl IN (1, 3) UNION ALL SELECT dst, src, cost FROM e WHERE fl IN (2, 3)) SELECT src, dst, count(*) AS records, round(min(cost), 3) AS cost FROM b GROUP BY src, dst")
def edge_cost(spark, d):
    return way_edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("records"), F.round(F.min(F.col("cost").cast("double")), 3).alias("cost"))


@query(f"WITH {WAYS} SELECT node FROM n WHERE node IN (SELECT src FROM e UNION SELECT dst FROM e)")
def prune_isolated(spark, d):
    return roads.connected_nodes(way_nodes(spark, d), way_edges(spark, d)).select("node")


@query("WITH w AS (SELECT l_orderkey AS way, l_partkey AS node FROM lineitem), k AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 100 BETWEEN 20 AND 60 AND p_partkey // 100 BETWEEN 2 AND 8) SELECT DISTINCT way FROM w WHERE node IN (SELECT node FROM k)")
def crop_ways_semi(spark, d):
    inside = geo.in_box(F.col("lon"), F.col("lat"), -113.94, 51.004, -113.82, 51.016, 1e-9)
    k = F.col("p_partkey")
    nodes = read(spark, d, "part").select(k.alias("node"), lon(k).alias("lon"), lat(k).alias("lat")).filter(inside)
    refs = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("node"))
    return refs.join(nodes, "node", "left_semi").select("way").distinct()


@query(f"WITH {GRID} SELECT node FROM g WHERE lat >= 51.003 - 0.005 AND lat <= 51.02 + 0.005 AND lon >= -113.9 - 0.005 AND lon <= -113.8 + 0.005")
def bbox_crop(spark, d):
    return grid(spark, d).filter(geo.in_box(F.col("lon"), F.col("lat"), -113.9, 51.003, -113.8, 51.02)).select("node")


def extracts(spark, d):
    """Lines of even and odd orders as two extracts of one road graph over suppliers and customers' nations."""
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") % 2).cast("int").alias("region"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("ord"), (F.col("l_suppkey") % 40).alias("src"), (F.col("l_partkey") % 40).alias("dst"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("flags"))
    return li.withColumn("cost", F.lit(1.0).cast("float"))


EXTRACTS = "x AS (SELECT (l_orderkey % 2)::INT AS region, l_orderkey * 100000 + l_linenumber * 1000 + l_partkey % 1000 AS ord, l_suppkey % 40 AS src, l_partkey % 40 AS dst, (l_linenumber % 3 + 1)::INT AS flags FROM lineitem)"


@query(f"""WITH {EXTRACTS}, f AS (SELECT src, dst, min(region) AS fr FROM x WHERE src <> dst GROUP BY src, dst),
o AS (SELECT src, dst, bit_or(flags) AS others FROM x JOIN f USING (src, dst) WHERE region <> fr GROUP BY src, dst),
m AS (SELECT x.*, others, row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS rn FROM x JOIN f USING (src, dst) LEFT JOIN o USING (src, dst) WHERE region = fr)
SELECT src, dst, count(*) AS records, max(CASE WHEN rn = 1 THEN flags | coalesce(others, 0) END) AS first_flags, sum(CASE WHEN rn > 1 THEN flags ELSE 0 END)::BIGINT AS other_flags FROM m GROUP BY src, dst""")
def graph_merge(spark, d):
    first = Window.partitionBy("src", "dst").orderBy("region", "ord")
    m = roads.merge(extracts(spark, d)).withColumn("rn", F.row_number().over(first))
    return m.groupBy("src", "dst").agg(F.count("*").alias("records"), F.max(F.when(F.col("rn") == 1, F.col("flags"))).alias("first_flags"), F.sum(F.when(F.col("rn") > 1, F.col("flags")).otherwise(0)).alias("other_flags"))


@query(f"WITH {EXTRACTS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT region) AS regions FROM x GROUP BY ALL HAVING count(DISTINCT region) > 1")
def shared_edges(spark, d):
    return roads.shared_edges(extracts(spark, d))


def supplier_links(spark, d):
    s = read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("node")), s.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") - 1).alias("dst"))


@query("SELECT s_suppkey AS node, max(CASE WHEN s_suppkey % 5 = 0 OR s_suppkey = m THEN s_suppkey END) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS component FROM (SELECT *, min(s_suppkey) OVER () AS m FROM supplier)")
def components(spark, d):
    nodes, links = supplier_links(spark, d)
    ends = links.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    return roads.components(nodes, ends)


def grid_edges(spark, d):
    """Four-neighbour roads of all grid points (rows of 100), slower on every third row."""
    k = F.col("c_custkey")
    p = read(spark, d, "customer").select(k.alias("k"), (k % 100).alias("x"), F.floor(k / 100).alias("y"))
    right = p.filter("x < 99").select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst"), F.when(F.col("y") % 3 == 0, 3.5).otherwise(1.25).alias("w"))
    up = p.select(F.col("k").alias("src"), (F.col("k") + 100).alias("dst"), F.lit(2.0).alias("w"))
    top = p.agg(F.max("k").alias("top"))
    one = right.unionByName(up).crossJoin(F.broadcast(top)).filter("dst <= top").drop("top")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).select("src", "dst", F.col("w").cast("float").alias("cost"))


COSTS = """WITH RECURSIVE p AS (SELECT c_custkey AS k, c_custkey % 100 AS x, c_custkey // 100 AS y FROM customer),
o AS (SELECT k AS a, k + 1 AS b, CASE WHEN y % 3 = 0 THEN 3.5::DOUBLE ELSE 1.25 END AS w FROM p WHERE x < 99 UNION ALL SELECT k, k + 100, 2.0::DOUBLE FROM p),
e AS (SELECT a, b, w FROM o WHERE b <= (SELECT max(k) FROM p) UNION ALL SELECT b, a, w FROM o WHERE b <= (SELECT max(k) FROM p)),
r(source, node, cost) USING KEY (source, node) AS (SELECT k, k, 0.0::DOUBLE FROM p WHERE k IN (0, 7)
 UNION SELECT r.source, e.b, min(r.cost + e.w) FROM r JOIN e ON e.a = r.node LEFT JOIN recurring.r AS old ON old.source = r.source AND old.node = e.b WHERE old.cost IS NULL OR r.cost + e.w < old.cost GROUP BY r.source, e.b)"""


@query(f"{COSTS} SELECT source, node, cost FROM r")
def shortest_path_cost(spark, d):
    sources = read(spark, d, "customer").filter("c_custkey IN (0, 7)").select(F.col("c_custkey").alias("node"))
    return roads.shortest_costs(grid_edges(spark, d), sources)


@query(f"{COSTS} SELECT r.source, r.node, r.cost, coalesce(min(b.node), -1) AS before FROM r LEFT JOIN e ON e.b = r.node AND r.node <> r.source LEFT JOIN r AS b ON b.source = r.source AND b.node = e.a AND b.cost + e.w = r.cost GROUP BY r.source, r.node, r.cost")
def shortest_path_tree(spark, d):
    edges = grid_edges(spark, d)
    return roads.shortest_tree(edges, shortest_path_cost(spark, d)).withColumn("before", F.coalesce("before", F.lit(-1)))


@query("""WITH p AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos, l_returnflag AS name, l_quantity AS metres FROM lineitem),
c AS (SELECT *, CASE WHEN pos > 0 AND name = lag(name) OVER (PARTITION BY route ORDER BY pos) THEN 0 ELSE 1 END AS ch FROM p), s AS (SELECT *, sum(ch) OVER (PARTITION BY route ORDER BY pos) AS step FROM c)
SELECT route, step::BIGINT AS step, name, round(sum(metres), 2) AS metres, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM s GROUP BY route, step, name""")
def route_steps(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    path = path_rows(spark, d).select(F.col("l_orderkey").alias("route"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("metres"), F.col("l_quantity").alias("seconds"))
    return roads.steps(path).select("route", "step", "name", F.round("metres", 2).alias("metres"), "first_pos", "last_pos")


@query(f"""WITH {GRID}, q AS (SELECT s_suppkey AS query, -114.0 + (s_suppkey * 37 % 100) * 0.003 + 0.0011 AS lon, 51.0 + (s_suppkey % 15) * 0.002 + 0.0007 AS lat FROM supplier),
m AS (SELECT query, node, {hav('q.lon', 'q.lat', 'g.lon', 'g.lat')} AS metres FROM q JOIN g ON abs(floor(g.lon / 0.002) - floor(q.lon / 0.002)) <= 6 AND abs(floor(g.lat / 0.002) - floor(q.lat / 0.002)) <= 6)
SELECT query, arg_min(node, metres) AS node, round(min(metres), 3) AS metres FROM m GROUP BY query""")
def nearest_node(spark, d):
    k = F.col("s_suppkey")
    q = read(spark, d, "supplier").select(k.alias("query"), (-114.0 + (k * 37 % 100) * 0.003 + 0.0011).alias("lon"), (51.0 + (k % 15) * 0.002 + 0.0007).alias("lat"))
    return roads.nearest(q, grid(spark, d)).select("query", "node", F.round("metres", 3).alias("metres"))


# --- search ---


def gazetteer(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("id"), F.concat_ws(" ", F.col("p_name"), F.col("p_brand")).alias("name"), (F.col("p_size") % 100).cast("double").alias("rank"), lon(k).alias("lon"), lat(k).alias("lat"), (k % 5).alias("region"))


def some_queries(spark, d):
    """The name of every part whose key 20 divides, with a typo (two letters swapped) and a prefix of each, and a miss."""
    n = F.col("p_name")
    typo = F.when(F.length(n) > 5, F.concat(F.substring(n, 1, 1), F.substring(n, 3, 1), F.substring(n, 2, 1), n.substr(F.lit(4), F.length(n))))
    words = read(spark, d, "part").filter("p_partkey % 20 = 0").select(F.explode(F.array(n, typo, F.substring(n, 1, 3))).alias("q"))
    return words.unionByName(spark.range(1).select(F.lit("zzqqxx").alias("q"))).filter("q IS NOT NULL").distinct()


@query()
def search_topk(spark, d):
    return search.search(gazetteer(spark, d), some_queries(spark, d), 12, near=(-113.9, 51.01))


@query()
def search_multi_region(spark, d):
    per = search.search(gazetteer(spark, d), some_queries(spark, d), 20, by=["region"])
    order = Window.partitionBy("q").orderBy(F.desc("score"), "region", "name", "id")
    return per.withColumn("place", F.row_number().over(order)).filter("place <= 20")


@query()
def merge_hits(spark, d):
    hits = search.search(gazetteer(spark, d), some_queries(spark, d), 20, by=["region"]).join(gazetteer(spark, d).select("id", "lon", "lat"), "id")
    return search.merge_hits(hits.select("q", F.col("region").cast("string").alias("source"), F.col("id").cast("string").alias("identity"), F.col("name").alias("label"), "score", "lon", "lat"))


@query()
def suggest_name(spark, d):
    return search.suggest(gazetteer(spark, d).select("name", "rank"), some_queries(spark, d).select(F.concat(F.col("q"), F.lit(" Brand#11")).alias("q")))


FOLDED = r"trim(regexp_replace(replace(regexp_replace(lower(strip_accents({c})), '[''’ʼ]', '', 'g'), '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({FOLDED.format(c='text')}) AS folded, len(list_filter(string_split({FOLDED.format(c='text')}, ' '), lambda t: t <> ''))::INT AS words FROM documents")
def fold_tokens(spark, d):
    f = text.fold(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(f).alias("folded"), F.size(text.tokens(f)).alias("words"))


@query(f"WITH f AS (SELECT c_custkey, {FOLDED.format(c='''c_name || ' St & ' || c_mktsegment''')} AS t FROM customer) SELECT c_custkey, replace(t, ' st ', ' street ') AS label FROM f")
def label_key(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", text.label_key(text.fold(F.concat(F.col("c_name"), F.lit(" St & "), F.col("c_mktsegment")))).alias("label"))


@query(f"SELECT token, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(string_split({FOLDED.format(c='text')}, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token")
def posting_index(spark, d):
    return search.postings(read(spark, d, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("docs"))


@query(f"SELECT doc_id AS id FROM (SELECT doc_id, unnest(string_split({FOLDED.format(c='text')}, ' ')) AS token FROM documents) WHERE token IN ('the', 'and', 'with') GROUP BY doc_id HAVING count(DISTINCT token) = 3")
def token_and(spark, d):
    return search.token_and(search.postings(read(spark, d, "documents"), "doc_id", "text"), ["the", "and", "with"])


@query(f"WITH {GRID} SELECT node AS id, round({hav('-113.9', '51.01', 'lon', 'lat')}, 3) AS metres FROM g WHERE c_mktsegment = 'BUILDING' ORDER BY metres, id LIMIT 20")
def category_nearest(spark, d):
    g = grid(spark, d).select(F.col("node").alias("id"), F.col("c_mktsegment").alias("cat"), "lon", "lat")
    return search.category_nearest(g, "BUILDING", -113.9, 51.01).select("id", "metres")


NATION_BOX = "nation_box AS (SELECT n_nationkey AS box, -114.0 + (n_nationkey % 5) * 0.06 AS west, 51.0 + (n_nationkey // 5) * 0.006 AS south, -114.0 + (n_nationkey % 5) * 0.06 + 0.05 + n_nationkey * 0.0013 AS east, 51.0 + (n_nationkey // 5) * 0.006 + 0.005 + n_nationkey * 0.00013 AS north FROM nation)"


@query(f"WITH {GRID}, {NATION_BOX}, h AS (SELECT node AS point, box, row_number() OVER (PARTITION BY node ORDER BY (east - west) * (north - south), box) AS rn FROM g JOIN nation_box ON lon BETWEEN west AND east AND lat BETWEEN south AND north) SELECT point, box FROM h WHERE rn = 1")
def admin_context(spark, d):
    return search.covering(grid(spark, d).select(F.col("node").alias("point"), "lon", "lat"), nation_boxes(spark, d), 0.02)


# --- scans ---


@query(f"WITH {GRID} SELECT count(*) AS nodes, count(*) FILTER (WHERE c_acctbal > 0) AS routable, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM g")
def scan_stats(spark, d):
    g = grid(spark, d)
    return g.agg(F.count("*").alias("nodes"), F.count_if(F.col("c_acctbal") > 0).alias("routable"), F.round(F.min("lon"), 6).alias("west"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lon"), 6).alias("east"), F.round(F.max("lat"), 6).alias("north"))


@query(f"WITH {WAYS} SELECT way AS l_orderkey, count(*) AS violations FROM (SELECT way, node, lag(node) OVER (PARTITION BY way ORDER BY pos) AS before FROM refs) WHERE before > node GROUP BY way")
def sorted_check(spark, d):
    order = Window.partitionBy("way").orderBy("pos")
    return way_refs(spark, d).withColumn("before", F.lag("node").over(order)).filter("before > node").groupBy(F.col("way").alias("l_orderkey")).agg(F.count("*").alias("violations"))


@query("WITH u AS (SELECT c_custkey * 2 AS id, c_acctbal AS v, 0 AS input FROM customer UNION ALL SELECT c_custkey * 3, -c_acctbal, 1 FROM customer) SELECT id, arg_min(v, input) AS v, min(input)::INT AS input FROM u GROUP BY id")
def union_dedup(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    both = c.withColumns({"id": F.col("id") * 2, "input": F.lit(0)}).unionByName(c.withColumns({"id": F.col("id") * 3, "v": -F.col("v"), "input": F.lit(1)}))
    return both.groupBy("id").agg(F.min_by("v", "input").alias("v"), F.min("input").alias("input"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def equal_contents(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    twice = docs.groupBy("sha256").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return docs.join(twice, "sha256", "left_semi").select("doc_id", "sha256", "bytes")


# --- trips: events by user in time ---


def fixes(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("event_id", F.col("user_id").alias("trip"), ms.alias("ms"), F.col("value").alias("distance"), (F.col("value") * 10).alias("along"), F.col("event_type").alias("instruction"))


FIXES = "f AS (SELECT event_id, user_id AS trip, epoch_us(ts) // 1000 AS ms, value AS distance, value * 10 AS along, event_type AS instruction FROM events)"


@query(f"""WITH {FIXES}, o AS (SELECT *, distance > 25 + least(65.0, 2 * 10.0) AS over FROM f), i AS (SELECT *, sum(CASE WHEN over THEN 0 ELSE 1 END) OVER (PARTITION BY trip ORDER BY ms) AS island FROM o)
SELECT event_id, CASE WHEN NOT over THEN 'on' WHEN ms - min(CASE WHEN over THEN ms END) OVER (PARTITION BY trip, island) >= {6 * HOUR} THEN 'off' ELSE 'suspect' END AS state FROM i""")
def off_route_state(spark, d):
    return trips.off_route(fixes(spark, d), trips.threshold(F.lit(10.0)), 6 * HOUR).select("event_id", "state")


@query(f"WITH {FIXES} SELECT event_id, round(coalesce(max(CASE WHEN distance <= 45 THEN along END) OVER (PARTITION BY trip ORDER BY ms ROWS UNBOUNDED PRECEDING), 0.0), 4) AS placed FROM f")
def route_progress(spark, d):
    return trips.progress(fixes(spark, d), F.lit(45.0)).select("event_id", F.round("placed", 4).alias("placed"))


@query(f"WITH {FIXES} SELECT event_id, gap_ms FROM (SELECT event_id, lead(ms) OVER (PARTITION BY trip ORDER BY ms) - ms AS gap_ms FROM f) WHERE gap_ms > {20 * HOUR}")
def stale_gaps(spark, d):
    return trips.stale(fixes(spark, d), 20 * HOUR).select("event_id", "gap_ms")


@query(f"""WITH {FIXES}, b AS (SELECT event_id, trip, ms, instruction, CASE WHEN distance <= 0 THEN 0 {' '.join(f'WHEN distance <= {r} THEN {r}' for r in geo.RUNGS_METRIC)} ELSE ceil(distance / 10000) * 10000 END::BIGINT AS band FROM f),
k AS (SELECT *, lag(instruction || '@' || band) OVER (PARTITION BY trip ORDER BY ms) AS last FROM b) SELECT event_id, instruction, band FROM k WHERE last IS NULL OR last <> instruction || '@' || band""")
def announce_dedup(spark, d):
    rows = fixes(spark, d).withColumnRenamed("distance", "metres")
    return trips.announcements(rows).select("event_id", "instruction", "band")


def lines(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts")
    e = read(spark, d, "events").select(F.col("user_id").alias("route"), (F.row_number().over(order) - 1).alias("pos"), (F.col("event_id") * 37 % 1000).alias("k"))
    return e.select("route", "pos", (-114.0 + F.col("pos") * 0.001 + F.col("k") * 0.00001).alias("lon"), (51.0 + (F.col("k") % 71) * 0.0002).alias("lat"))


LINES = "l AS (SELECT route, pos, -114.0::DOUBLE + pos * 0.001::DOUBLE + k * 0.00001::DOUBLE AS lon, 51.0::DOUBLE + (k % 71) * 0.0002::DOUBLE AS lat FROM (SELECT user_id AS route, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos, event_id * 37 % 1000 AS k FROM events))"


def brg(a: str, b: str, c: str, e: str) -> str:
    return f"degrees(atan2(sin(radians({c} - {a})) * cos(radians({e})), cos(radians({b})) * sin(radians({e})) - sin(radians({b})) * cos(radians({e})) * cos(radians({c} - {a}))))"


@query(f"""WITH {LINES}, w AS (SELECT *, lag(lon, 8) OVER o AS blon, lag(lat, 8) OVER o AS blat, lead(lon, 8) OVER o AS alon, lead(lat, 8) OVER o AS alat, count(*) OVER (PARTITION BY route) AS n FROM l WINDOW o AS (PARTITION BY route ORDER BY pos)),
t AS (SELECT route, pos, {brg('lon', 'lat', 'alon', 'alat')} - {brg('blon', 'blat', 'lon', 'lat')} AS raw FROM w WHERE pos % 8 = 0 AND pos >= 8 AND pos < n - 8 AND n > 16),
u AS (SELECT route, pos, CASE WHEN raw < -180 THEN raw + 360 WHEN raw > 180 THEN raw - 360 ELSE raw END AS delta FROM t)
SELECT route, pos::INT AS pos, round(delta, 4) AS delta, CASE WHEN abs(delta) >= 150 THEN 'uturn-' WHEN abs(delta) >= 115 THEN 'sharp-' WHEN abs(delta) >= 45 THEN '' ELSE 'slight-' END || CASE WHEN delta > 0 THEN 'right' ELSE 'left' END AS kind FROM u WHERE abs(delta) >= 18""")
def turn_inference(spark, d):
    return trips.turns(lines(spark, d)).select("route", "pos", F.round("delta", 4).alias("delta"), "kind")


@query(f"WITH {LINES}, m AS (SELECT route, max(pos) AS last FROM l GROUP BY route) SELECT route, b AS bin, CASE WHEN b * 8 + 8 > last THEN greatest(0, last - 8) ELSE b * 8 END AS first_pos, least(last, b * 8 + 8) AS last_pos FROM (SELECT route, last, unnest(generate_series(0, (last - 1) // 8)) AS b FROM m WHERE last > 0)")
def traffic_bins(spark, d):
    return trips.bins(lines(spark, d))


def admitted_sql(limit: int, window_ms: int, running: int, hold: str) -> str:
    """Requests one after the other: the times of those admitted in the window and the ends of those that run go along."""
    return f"""WITH RECURSIVE {FIXES}, n AS (SELECT trip AS key, ms, event_id AS id, {hold} AS hold, row_number() OVER (PARTITION BY trip ORDER BY ms, event_id) AS rn FROM f),
w AS (SELECT key, rn, id, ms, true AS admitted, [ms] AS times, [ms + hold] AS ends FROM n WHERE rn = 1
UNION ALL SELECT key, rn, id, ms, fine, CASE WHEN fine THEN list_append(t, ms) ELSE t END, CASE WHEN fine THEN list_append(e, ms + hold) ELSE e END
FROM (SELECT *, len(t) < {limit} AND len(e) < {running} AS fine FROM (SELECT n.*, list_filter(w.times, lambda x: x > n.ms - {window_ms}) AS t, list_filter(w.ends, lambda x: x > n.ms) AS e FROM w JOIN n ON n.key = w.key AND n.rn = w.rn + 1)))
SELECT key, ms, id, admitted FROM w"""


@query(admitted_sql(2, 24 * HOUR, 1 << 30, "0"))
def rate_limit(spark, d):
    f = fixes(spark, d).select(F.col("trip").alias("key"), "ms", F.col("event_id").alias("id"))
    return admission.admit(f, 2, 24 * HOUR)


@query(admitted_sql(4, 24 * HOUR, 2, f"event_id % 7 * {5 * HOUR}"))
def leased_admission(spark, d):
    """Requests that hold a place for a while: four in a day, two at a time."""
    f = fixes(spark, d).select(F.col("trip").alias("key"), "ms", F.col("event_id").alias("id"), (F.col("event_id") % 7 * (5 * HOUR)).alias("hold_ms"))
    return admission.admit(f, 4, 24 * HOUR, 2)


# --- tiles ---

MERC = "((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2)"


@query(f"WITH {GRID} SELECT node, round((lon + 180) / 360, 9) AS x, round({MERC}, 9) AS y FROM g")
def mercator(spark, d):
    g = grid(spark, d).withColumn("m", geo.mercator(F.col("lon"), F.col("lat")))
    return g.select("node", F.round("m.x", 9).alias("x"), F.round("m.y", 9).alias("y"))


@query(f"""WITH RECURSIVE {GRID}, t AS (SELECT node, floor((lon + 180) / 360 * 4096)::BIGINT AS x, floor({MERC} * 4096)::BIGINT AS y FROM g),
h AS (SELECT node, x AS ox, y AS oy, x, y, 2048::BIGINT AS s, 0::BIGINT AS d FROM t
 UNION ALL SELECT node, ox, oy, CASE WHEN y & s = 0 THEN CASE WHEN x & s > 0 THEN s - 1 - (y & (s - 1)) ELSE y END ELSE x END, CASE WHEN y & s = 0 THEN CASE WHEN x & s > 0 THEN s - 1 - (x & (s - 1)) ELSE x END ELSE y END, s // 2,
  d + s * s * (CASE WHEN x & s > 0 THEN CASE WHEN y & s > 0 THEN 2 ELSE 3 END ELSE CASE WHEN y & s > 0 THEN 1 ELSE 0 END END) FROM h WHERE s > 0)
SELECT node, ox::INT AS x, oy::INT AS y, d + ((1::BIGINT << 24) - 1) // 3 AS tile_id FROM h WHERE s = 0""")
def hilbert_id(spark, d):
    return tiles.points_to_tiles(grid(spark, d), 12).select("node", "x", "y", "tile_id")


@query(f"""WITH {NATION_BOX}, m AS (SELECT box AS id, greatest(0, least(16383, floor((west + 180) / 360 * 16384 - 0.08))) AS x0, greatest(0, least(16383, floor((east + 180) / 360 * 16384 + 0.08))) AS x1,
  greatest(0, least(16383, floor(((1 - ln(tan(radians(north)) + 1 / cos(radians(north))) / pi()) / 2) * 16384 - 0.08))) AS y0, greatest(0, least(16383, floor(((1 - ln(tan(radians(south)) + 1 / cos(radians(south))) / pi()) / 2) * 16384 + 0.08))) AS y1 FROM nation_box),
a AS (SELECT *, unnest(generate_series(x0::BIGINT, x1::BIGINT)) AS x FROM m) SELECT id, x::INT AS x, unnest(generate_series(y0::BIGINT, y1::BIGINT))::INT AS y FROM a""")
def tile_cover(spark, d):
    k = F.col("n_nationkey")
    west, south = -114.0 + (k % 5) * 0.06, 51.0 + F.floor(k / 5) * 0.006
    boxes = read(spark, d, "nation").select(k.alias("id"), west.alias("west"), south.alias("south"), (west + 0.05 + k * 0.0013).alias("east"), (south + 0.005 + k * 0.00013).alias("north"))
    return tiles.cover(boxes, 14)


@query("WITH t AS (SELECT c_custkey + c_custkey // 50 AS tile_id, sha256((c_custkey // 7 % 3)::VARCHAR) AS h FROM customer), g AS (SELECT *, tile_id - row_number() OVER (PARTITION BY h ORDER BY tile_id) AS grp FROM t) SELECT min(tile_id) AS first_id, count(*) AS run_length, h AS hash FROM g GROUP BY h, grp")
def tile_dedup_rle(spark, d):
    k = F.col("c_custkey")
    t = read(spark, d, "customer").select((k + F.floor(k / 50)).alias("tile_id"), (F.floor(k / 7) % 3).cast("string").cast("binary").alias("data"))
    return tiles.dedup_runs(t)


@query(f"WITH {LINES} SELECT route, pos::INT AS pos, round(lon, 6) AS lon, round(lat, 6) AS lat FROM l")
def polyline_roundtrip(spark, d):
    """The points of lines as their polylines say."""
    g = lines(spark, d).groupBy("route").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    pts = F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return g.select("route", tiles.polyline(pts).alias("line")).select("route", F.posexplode(tiles.from_polyline("line")).alias("pos", "p")).select("route", "pos", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query()
def mvt_encode(spark, d):
    at = tiles.points_to_tiles(grid(spark, d), 12)
    spot = lambda a, b: F.struct((F.col("node") % 4000 + a).cast("int").alias("x"), (F.col("node") % 3000 + b).cast("int").alias("y"))
    ring, hole = F.array(spot(0, 0), spot(40, 0), spot(40, 40)), F.array(spot(20, 5), spot(30, 15), spot(30, 5))
    paths = F.when(F.col("node") % 2 == 0, F.array(ring, hole)).otherwise(F.array(ring))
    f = at.select("tile_id", F.lit("green").alias("layer"), F.col("node").alias("seq"), F.col("c_mktsegment").alias("class"), F.when(F.col("node") % 3 == 0, F.col("c_name")).alias("name"), paths.alias("paths"), (F.col("node") % 2 == 0).alias("polygon"))
    return tiles.encode_tiles(f).select("tile_id", F.length("data").alias("bytes"), F.md5("data").alias("digest"))


# --- what Spark has beside ---


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    e = read(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return e.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, count(*) AS events, min(epoch_us(ts) // 1000) AS first_ms FROM s GROUP BY user_id, n")
def session_windows(spark, d):
    e = read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "2 hours")).agg(F.count("*").alias("events"), F.min(F.unix_millis("t")).alias("first_ms")).select("user_id", "events", "first_ms")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# --- polylines: the events' routes ---

MEASURED = f"""{LINES}, m0 AS (SELECT *, CASE WHEN row_number() OVER o > 1 THEN {hav('lag(lon) OVER o', 'lag(lat) OVER o', 'lon', 'lat')} END AS step FROM l WINDOW o AS (PARTITION BY route ORDER BY pos)),
m AS (SELECT route, pos, lon, lat, coalesce(step, 0.0) AS metres, sum(coalesce(step, 0.0)) OVER (PARTITION BY route ORDER BY pos ROWS UNBOUNDED PRECEDING) AS along FROM m0),
pc AS (SELECT * FROM (SELECT route, pos, lon AS ax, lat AS ay, lead(lon) OVER o AS bx, lead(lat) OVER o AS by_, along AS start, lead(metres) OVER o AS metres FROM m WINDOW o AS (PARTITION BY route ORDER BY pos)) WHERE bx IS NOT NULL)"""


@query(f"WITH {MEASURED} SELECT route, pos::INT AS pos, round(metres, 3) AS metres, round(along, 3) AS along FROM m")
def line_length(spark, d):
    return polylines.measured(lines(spark, d)).select("route", "pos", F.round("metres", 3).alias("metres"), F.round("along", 3).alias("along"))


@query(f"""WITH {MEASURED}, f AS (SELECT route * 1000000 + pos AS id, route, lon + 0.00041 AS px, lat + 0.00033 AS py FROM l),
k AS (SELECT *, cos(radians(ay)) * 111320 AS kx FROM f JOIN pc USING (route)),
q AS (SELECT *, ((bx - ax) * kx) ** 2 + ((by_ - ay) * 111320) ** 2 AS size, (px - ax) * kx * (bx - ax) * kx + (py - ay) * 111320 * (by_ - ay) * 111320 AS dot FROM k),
t AS (SELECT *, CASE WHEN size = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, dot / size)) END AS t FROM q),
n AS (SELECT id, pos, start, ax, ay, px, py, ax + t * (bx - ax) AS sx, ay + t * (by_ - ay) AS sy FROM t),
b AS (SELECT id, pos, start + {hav('ax', 'ay', 'sx', 'sy')} AS along, {hav('px', 'py', 'sx', 'sy')} AS distance FROM n)
SELECT id, round(distance, 3) AS distance, round(along, 3) AS along FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, pos) AS rn FROM b) WHERE rn = 1""")
def snap_to_line(spark, d):
    line = lines(spark, d)
    fix = line.select((F.col("route") * 1000000 + F.col("pos")).alias("id"), "route", (F.col("lon") + 0.00041).alias("lon"), (F.col("lat") + 0.00033).alias("lat"))
    return polylines.snap(fix, line).select("id", F.round("distance", 3).alias("distance"), F.round("along", 3).alias("along"))


@query(f"""WITH {MEASURED}, a AS (SELECT event_id AS id, user_id AS route, value * 100 AS asked FROM events), tot AS (SELECT route, max(start + metres) AS total FROM pc GROUP BY route),
h AS (SELECT id, pos, ax, ay, bx, by_, metres, start, greatest(0.0, least(asked, total)) AS at_ FROM a JOIN tot USING (route) JOIN pc USING (route)),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn, CASE WHEN metres > 0 THEN (at_ - start) / metres ELSE 0.0 END AS t FROM h WHERE at_ >= start AND at_ <= start + metres)
SELECT id, pos::INT AS pos, round(ax + t * (bx - ax), 6) AS lon, round(ay + t * (by_ - ay), 6) AS lat FROM s WHERE rn = 1""")
def place_on_line(spark, d):
    asked = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("route"), (F.col("value") * 100).alias("metres"))
    return polylines.place_at(lines(spark, d), asked).select("id", "pos", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"WITH {MEASURED}, t AS (SELECT *, max(along) OVER (PARTITION BY route) AS total FROM m) SELECT route, pos::INT AS pos, round(CASE WHEN total - along = 0 THEN 0.0 ELSE greatest(1.0, total - along) END, 2) AS remaining FROM t")
def remaining_distance(spark, d):
    m = polylines.measured(lines(spark, d)).withColumn("total", F.max("along").over(Window.partitionBy("route")))
    return m.select("route", "pos", F.round(polylines.remaining(F.col("total"), F.col("along")), 2).alias("remaining"))


@query(f"""WITH {MEASURED}, b AS (SELECT a.route, a.pos, a.along, max(CASE WHEN z.along <= a.along + 500 THEN z.pos END) + 1 AS beyond, max(z.along) AS last FROM m a JOIN m z ON z.route = a.route AND z.pos >= a.pos GROUP BY a.route, a.pos, a.along)
SELECT b.route, b.pos::INT AS pos, round(coalesce(e.along, last) - b.along, 3) AS ahead FROM b LEFT JOIN m e ON e.route = b.route AND e.pos = beyond""")
def distance_ahead(spark, d):
    return polylines.ahead(lines(spark, d)).select("route", "pos", F.round("ahead", 3).alias("ahead"))


@query(f"WITH {LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY route) AS n FROM l) SELECT route, pos::INT AS pos FROM n WHERE pos % greatest(1, ceil(n / 20.0)) = 0 OR pos = n - 1")
def thin_line(spark, d):
    return polylines.thin(lines(spark, d), 20).select("route", "pos")


@query(f"WITH {LINES} SELECT route, (row_number() OVER (PARTITION BY route ORDER BY leg, pos) - 1)::INT AS pos, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT route, pos // 5 AS leg, pos, lon, lat FROM l)")
def join_legs(spark, d):
    """Legs of five vertices that each also hold the end of the leg before."""
    leg = lines(spark, d).withColumn("leg", F.floor(F.col("pos") / 5))
    again = leg.filter("pos % 5 = 4").select("route", (F.col("leg") + 1).alias("leg"), "pos", "lon", "lat")
    whole = leg.unionByName(again.join(leg.select("route", "leg").distinct(), ["route", "leg"], "left_semi"))
    return polylines.joined_legs(whole).select("route", "pos", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


QUANT = f"""q0 AS (SELECT route, pos, floor((lon + 180) / 360 * 16777216 + 0.5)::BIGINT AS x, floor({MERC} * 16777216 + 0.5)::BIGINT AS y FROM l),
q AS (SELECT route, pos, x, y FROM (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py FROM q0 WINDOW o AS (PARTITION BY route ORDER BY pos)) WHERE px IS NULL OR px <> x OR py <> y)"""


@query(f"WITH {LINES}, {QUANT} SELECT route, pos::INT AS pos, x, y FROM q")
def quantised_line(spark, d):
    return polylines.quantised(lines(spark, d), 12)


@query(f"""WITH {LINES}, {QUANT}, w AS (SELECT route, x, y, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM q WINDOW o AS (PARTITION BY route ORDER BY pos)),
s AS (SELECT route, sum(x * ny - nx * y)::BIGINT AS area2 FROM w GROUP BY route) SELECT route, area2 FROM s WHERE abs(area2) >= 8""")
def ring_area(spark, d):
    return polylines.ring_areas(polylines.quantised(lines(spark, d), 12)).select("route", "area2")


@query(f"""WITH {MEASURED}, s AS (SELECT *, greatest(1, floor(metres / 25 + 0.5)::BIGINT) AS steps FROM pc), b AS (SELECT *, (sum(steps) OVER (PARTITION BY route ORDER BY pos ROWS UNBOUNDED PRECEDING) - steps)::BIGINT AS before FROM s),
k AS (SELECT *, unnest(generate_series(1, steps)) AS k FROM b) SELECT route, 2 * (before + k) AS house, floor((ax + (bx - ax) * (k / steps)) * 1e6 + 0.3711)::BIGINT AS lon_e6, floor((ay + (by_ - ay) * (k / steps)) * 1e6 + 0.3711)::BIGINT AS lat_e6 FROM k WHERE (before + k) % 6 = 0""")
def address_points(spark, d):
    """Coordinates in millionths of a degree; the offset keeps the cuts off the fractions that steps of a segment make."""
    e6 = lambda c: F.floor(F.col(c) * 1e6 + 0.3711).alias(f"{c}_e6")
    return polylines.addresses(lines(spark, d)).select("route", "house", e6("lon"), e6("lat"))


@query(f"""WITH {WAYS}, v AS (SELECT r.way, r.run, r.pos, r.lon, r.lat, o.o_orderpriority AS name, CASE WHEN o.o_custkey % 5 > 0 THEN (o.o_custkey % 5)::VARCHAR END AS context FROM r JOIN orders o ON o.o_orderkey = r.way),
u AS (SELECT *, CASE WHEN row_number() OVER i > 1 THEN {hav('lag(lon) OVER i', 'lag(lat) OVER i', 'lon', 'lat')} ELSE 0.0 END AS metres FROM v WINDOW i AS (PARTITION BY way, run ORDER BY pos))
SELECT lower(name) AS key, context, arg_min(name, (way, run, pos)) AS name, count(DISTINCT way) AS ways, round(sum(metres), 1) AS metres FROM u GROUP BY lower(name), context""")
def street_merge(spark, d):
    points = way_points(spark, d)
    names = read(spark, d, "orders").select(F.col("o_orderkey").alias("way"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_custkey") % 5 > 0, (F.col("o_custkey") % 5).cast("string")).alias("context"))
    return polylines.merge_streets(points.join(names, "way")).select("key", "context", "name", "ways", F.round("metres", 1).alias("metres"))


# --- places and boxes ---


@query(f"WITH {GRID}, {NATION_BOX}, h AS (SELECT node AS point, box, row_number() OVER (PARTITION BY node ORDER BY box * 7 % 25, box) AS rn FROM g JOIN nation_box ON lon BETWEEN west AND east AND lat BETWEEN south AND north) SELECT point, box FROM h WHERE rn = 1")
def first_covering(spark, d):
    """The first box of a list that holds a point; the list's order is the nation's key times 7."""
    return search.covering(grid(spark, d).select(F.col("node").alias("point"), "lon", "lat"), nation_boxes(spark, d), 0.02, by=F.col("box") * 7 % 25)


def nation_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    west, south = -114.0 + (k % 5) * 0.06, 51.0 + F.floor(k / 5) * 0.006
    return read(spark, d, "nation").select(k.alias("box"), west.alias("west"), south.alias("south"), (west + 0.05 + k * 0.0013).alias("east"), (south + 0.005 + k * 0.00013).alias("north"))


@query(f"""WITH {NATION_BOX}, p AS (SELECT a.box AS a, b.box AS b, least(a.east, b.east) - greatest(a.west, b.west) AS w, least(a.north, b.north) - greatest(a.south, b.south) AS h, (a.east - a.west) * (a.north - a.south) AS area FROM nation_box a JOIN nation_box b ON a.box <> b.box)
SELECT a, b, round(w * h / area, 6) AS share FROM p WHERE w > 0 AND h > 0""")
def box_overlap(spark, d):
    """The share of each box that another covers, of all pairs that overlap."""
    names = ("west", "south", "east", "north")
    boxes = nation_boxes(spark, d)
    near = roads.adjacent(boxes.withColumnRenamed("box", "region"), 0.0)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = both.join(boxes.withColumnRenamed("box", "a"), "a").join(boxes.select(F.col("box").alias("b"), *(F.col(c).alias(f"o_{c}") for c in names)), "b")
    share = geo.overlap_share([F.col(c) for c in names], [F.col(f"o_{c}") for c in names])
    return pairs.select("a", "b", F.round(share, 6).alias("share")).filter(share > 0)


@query("""WITH t AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN p_size || 'A' END AS house, CASE WHEN p_partkey % 4 = 1 THEN 'town' END AS place, CASE WHEN p_partkey % 5 = 2 THEN 'primary' END AS highway,
  CASE WHEN p_partkey % 7 = 3 THEN 'administrative' END AS boundary, (p_partkey % 10)::VARCHAR AS level, CASE WHEN p_partkey % 3 = 0 THEN 'bakery' END AS shop FROM part),
e AS (SELECT *, CASE WHEN house IS NOT NULL THEN 'house' WHEN place IS NOT NULL THEN place WHEN highway IS NOT NULL THEN 'street' WHEN boundary IS NOT NULL THEN CASE WHEN level = '2' THEN 'country' WHEN level IN ('3', '4') THEN 'state' WHEN level = '8' THEN 'city' ELSE 'area' END WHEN shop IS NOT NULL THEN 'poi' ELSE 'area' END AS kind,
  CASE WHEN house IS NOT NULL THEN 'addr:housenumber/' || house WHEN place IS NOT NULL THEN 'place/town' WHEN highway IS NOT NULL THEN 'highway/primary' WHEN boundary IS NOT NULL THEN 'boundary/administrative' WHEN shop IS NOT NULL THEN 'shop/bakery' ELSE 'name/' || name END AS osm FROM t)
SELECT k AS id, kind, osm, CASE WHEN house IS NOT NULL THEN house || ' Main St' ELSE name END AS name, CASE WHEN place IS NOT NULL THEN 100 ELSE 50 END AS rank, coalesce(TRY_CAST(regexp_extract(house, '^([0-9]+)', 1) AS BIGINT), 0) AS house FROM e""")
def gazetteer_entry(spark, d):
    k = F.col("p_partkey")
    pairs = [("name", F.col("p_name")), ("addr:housenumber", F.when(k % 9 == 0, F.concat(F.col("p_size").cast("string"), F.lit("A")))), ("addr:street", F.when(k % 9 == 0, "Main St")), ("place", F.when(k % 4 == 1, "town")), ("highway", F.when(k % 5 == 2, "primary")),
             ("boundary", F.when(k % 7 == 3, "administrative")), ("admin_level", (k % 10).cast("string")), ("shop", F.when(k % 3 == 0, "bakery"))]
    made = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(a).alias("col1"), b.alias("col2")) for a, b in pairs)), lambda e: e["col2"].isNotNull()))
    t = read(spark, d, "part").select(k.alias("id"), made.alias("t"))
    return t.select("id", tags.entry(F.col("t")).alias("e"), tags.place_rank(F.col("t")).alias("rank"), F.coalesce(tags.house_number(F.col("t")["addr:housenumber"]), F.lit(0)).alias("house")).select("id", "e.*", "rank", "house")


@query("SELECT p_partkey AS id, p_retailprice AS rank FROM part ORDER BY rank DESC, id LIMIT 100")
def gazetteer_cap(spark, d):
    return search.capped(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("rank")), 100)


@query("SELECT event_id, round(coalesce(s, 480.0) + least(120.0, coalesce(i, 0.25) * 120) - b, 4) AS online, round(s + 250 - b, 4) AS saved FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value * 7 END AS s, CASE WHEN event_id % 4 > 0 THEN value / 90 END AS i, least(120.0, value * 4000 / 500) + least(350.0, greatest(0.0, value * 4000 - 200000) / 3000) AS b FROM events)")
def hit_scores(spark, d):
    k, v = F.col("event_id"), F.col("value")
    s, i, m = F.when(k % 3 > 0, v * 7), F.when(k % 4 > 0, v / 90), v * 4000
    return read(spark, d, "events").select("event_id", F.round(search.online_score(s, i, m), 4).alias("online"), F.round(search.saved_score(s, m), 4).alias("saved"))


@query("""SELECT o_orderkey, CASE WHEN n < 0 THEN 'unknown size' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) WHEN n < 104857600 THEN printf('%.1f MB', floor(n / 1048576 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN floor(n / 1048576 + 0.5)::BIGINT || ' MB' ELSE printf('%.1f GB', floor(n / 1073741824 * 10 + 0.5) / 10) END AS size
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN -1 WHEN 1 THEN o_orderkey % 1024 WHEN 2 THEN o_orderkey * 101 WHEN 3 THEN o_orderkey * 40009 ELSE o_orderkey * 400009 END::BIGINT AS n FROM orders)""")
def fmt_bytes(spark, d):
    k = F.col("o_orderkey")
    n = F.when(k % 5 == 0, -1).when(k % 5 == 1, k % 1024).when(k % 5 == 2, k * 101).when(k % 5 == 3, k * 40009).otherwise(k * 400009)
    return read(spark, d, "orders").select("o_orderkey", geo.format_bytes(n).alias("size"))


# --- requests: events by user in time ---


def requests(spark, d):
    return fixes(spark, d).select(F.col("trip").alias("key"), "ms", F.col("event_id").alias("id"), "distance", F.col("instruction").alias("text"))


@query(f"WITH {FIXES}, n AS (SELECT *, (row_number() OVER (PARTITION BY trip ORDER BY ms, event_id) - 1) * {4 * HOUR} AS n FROM f) SELECT event_id AS id, (max(ms - n) OVER (PARTITION BY trip ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) + n)::BIGINT AS start_ms FROM n")
def throttle_starts(spark, d):
    return admission.throttle(requests(spark, d), 4 * HOUR).select("id", "start_ms")


@query(f"WITH {FIXES}, n AS (SELECT *, lead(ms) OVER (PARTITION BY trip ORDER BY ms, event_id) AS nx FROM f) SELECT event_id AS id FROM n WHERE (nx IS NULL OR nx - ms >= {5 * HOUR}) AND length(trim(instruction)) >= 5")
def debounced(spark, d):
    return admission.debounce(requests(spark, d), 5 * HOUR, 5).select("id")


@query(f"WITH {FIXES}, z AS (SELECT max(ms) AS top FROM f) SELECT event_id AS id FROM f, z WHERE ms + {240 * HOUR} <= top AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def expired_builds(spark, d):
    r = requests(spark, d).select("id", "ms")
    top = r.agg(F.max("ms")).first()[0] or 0
    return admission.expired(r, read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), top, 240 * HOUR).select("id")


@query(f"""WITH {FIXES}, b AS (SELECT *, sum(CASE WHEN distance < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY trip ORDER BY ms, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS bad FROM f)
SELECT event_id AS id, bool_or(bad) OVER (PARTITION BY trip ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS dead FROM b""")
def failure_latch(spark, d):
    return admission.latched(requests(spark, d).withColumn("ok", F.col("distance") < 60)).select("id", "dead")
