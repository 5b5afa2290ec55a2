"""Gazetteers from tagged elements: a client's union of five branches and a service's of four.

places (id, lon, lat, tags), ways (way, refs, tags), nodes (node, lon, lat), members (relation, idx, way, role), relations
(relation, tags); tags are maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tags as T
from ..storage import stage
from . import areas, lines, roads

# Results must equal published ones.
CLIENT_CATS = ("place", "amenity", "shop", "tourism", "leisure", "historic", "railway", "natural")
AREA_CATS = ("amenity", "shop", "tourism", "leisure", "landuse", "natural", "historic", "building", "office", "craft", "healthcare")
PLACE_CATS = (
    "place", "amenity", "shop", "tourism", "leisure", "office", "craft", "healthcare", "historic", "natural", "aeroway",
    "railway", "building", "landuse", "man_made",
)


def _refs(ways: DataFrame) -> DataFrame:
    return ways.select("way", F.posexplode("refs").alias("pos", "node"))


def bridged(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, pos, node, lon, lat): ways over the nodes that are known; gaps are bridged."""
    found = _refs(ways).join(nodes.select("node", "lon", "lat"), "node")
    return found.select("way", (F.row_number().over(Window.partitionBy("way").orderBy("pos")) - 1).alias("pos"), "node", "lon", "lat")


def client_gazetteer(places: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, lon, lat, cat, rank, street, house): named places, a row for each named street way, named areas that are no
    buildings, house numbers, and addresses made up along streets. Ways of one id are ways of their own. A named way that is
    no street has a house number only if it is listed as an area itself."""
    found, series = _client_parts(places, ways, nodes)
    made = lines.series_houses(series, more=("street",))
    made = made.select(_made_name().alias("name"), "lon", "lat", F.lit("address").alias("cat"), F.lit(20).alias("rank"), "street", "house")
    return found.unionByName(made)


def client_names(places: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cat, rank, name, entries, houses, lon, lat): client_gazetteer()'s rows by category, rank and name: how many, the sum of
    their house numbers (0 for none) and their mean place. Made-up houses, hundreds a way and more the longer it is, are
    summed by number along the streets (lines.series_sums) and not made one by one."""
    found, series = _client_parts(places, ways, nodes)
    key = ["cat", "rank", "name"]
    counted = [F.count("*").alias("entries"), F.sum("house").alias("houses"), F.count("lon").alias("lons"), F.sum("lon").alias("lon"), F.count("lat").alias("lats"), F.sum("lat").alias("lat")]
    own = found.groupBy(*key).agg(*counted)
    made = lines.series_sums(series, "street")
    made = made.select(F.lit("address").alias("cat"), F.lit(20).alias("rank"), _made_name().alias("name"), "entries", (F.col("house") * F.col("entries")).alias("houses"), "lons", "lon", "lats", "lat")
    every = own.unionByName(made).groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("entries", "houses", "lons", "lon", "lats", "lat")))
    return every.select(*key, "entries", F.coalesce("houses", F.lit(0)).alias("houses"), *(F.when(F.col(f"{c}s") > 0, F.col(c) / F.col(f"{c}s")).alias(c) for c in ("lon", "lat")))


def _made_name() -> Column:
    return F.concat_ws(" ", "street", F.col("house").cast("string"))


def _client_parts(places: DataFrame, ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """client_gazetteer()'s rows without the made-up houses, and these as series (lines.address_series) with their street."""
    ways = roads.way_rows(ways).drop("id")
    t = F.col("tags")
    none = F.lit(None)
    pick = lambda name, lon, lat, cat, rank, street=none, house=none: [c.alias(n) for c, n in zip((name, lon, lat, cat, F.lit(rank) if isinstance(rank, int) else rank, street.cast("string"), house.cast("long")), ("name", "lon", "lat", "cat", "rank", "street", "house"))]
    lon, lat = F.col("lon"), F.col("lat")
    rank = F.when(T.place_rank(t) > 50, T.place_rank(t)).when(t["amenity"].isin(*PLACE_CATS), 70).otherwise(50)
    named = places.filter(t["name"].isNotNull()).select(*pick(t["name"], lon, lat, F.coalesce(*(t[k] for k in CLIENT_CATS), F.lit("place")), rank))
    line = stage(bridged(ways, nodes), "lines")
    first = line.filter("pos = 0").select("way", "lon", "lat")
    kept = ways.select("way", "tags", F.element_at("refs", 1).alias("node"))
    roads_ = kept.filter(t["highway"].isNotNull() & t["name"].isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    streets = roads_.join(first, "way", "left").select(*pick(t["name"], zero(lon), zero(lat), F.lit("street"), 30, t["name"]))
    cat = F.coalesce(*(t[k] for k in AREA_CATS))
    areas_ = kept.filter(t["name"].isNotNull() & t["highway"].isNull() & t["building"].isNull() & cat.isNotNull())
    low = F.when(t["landuse"].isNotNull() | t["natural"].isNotNull(), 20).otherwise(65)
    named_areas = areas_.join(areas.mean_centres(line), "way").select(*pick(t["name"], lon, lat, cat, low))
    number, street = T.house_number(t["addr:housenumber"]), t["addr:street"]
    listed = t["name"].isNull() | t["highway"].isNotNull() | (t["building"].isNull() & cat.isNotNull())
    houses = kept.filter(number.isNotNull() & street.isNotNull() & listed).join(nodes.select("node", "lon", "lat"), "node")
    houses = houses.select(*pick(F.concat_ws(" ", street, number.cast("string")), lon, lat, F.lit("address"), 40, street, number))
    # names go to the points, as the houses between them may be hundreds of times as many
    named_lines = line.withColumnRenamed("way", "route").join(roads_.select(F.col("way").alias("route"), t["name"].alias("street")), "route")
    return named.unionByName(streets).unionByName(named_areas).unionByName(houses), lines.address_series(named_lines, more=("street",))


def closed_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, pos, node, lon, lat) of ways that are rings all of whose nodes are known."""
    rings = ways.filter((F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1)))
    found = _refs(rings).join(nodes.select("node", "lon", "lat"), "node", "left")
    return found.withColumn("lost", F.max(F.col("lon").isNull()).over(Window.partitionBy("way"))).filter("NOT lost").select("way", "pos", "node", "lon", "lat")


def admin_areas(ways: DataFrame, nodes: DataFrame, relations: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(areas, edges) of administrative relations and closed ways that have a name and a whole number of a level."""
    t = F.col("tags")
    level = t["admin_level"].try_cast("int")
    own = (t["boundary"] == "administrative") & t["name"].isNotNull() & level.isNotNull()
    of_rel = relations.filter(own).select("relation", level.alias("level"), t["name"].alias("name"))
    area = F.concat(F.lit("relation "), F.col("relation"), F.lit("/"), F.col("ring"))
    mine = rings.join(of_rel.select("relation"), "relation", "left_semi")
    edges = areas.area_edges(mine).select(area.alias("area"), "ax", "ay", "bx", "by")
    sizes = areas.measures(mine.filter("NOT inner"), ["relation", "ring"])
    holes = areas.hole_owners(mine).join(areas.measures(mine.filter("inner"), ["relation", "ring"]).select("relation", F.col("ring").alias("hole"), F.abs("area2").alias("out")), ["relation", "hole"])
    holes = holes.groupBy("relation", "ring").agg(F.sum("out").alias("out"))
    found = sizes.join(holes, ["relation", "ring"], "left").join(of_rel, "relation").select(area.alias("area"), "level", "name", (F.abs("area2") - F.coalesce("out", F.lit(0.0))).alias("size"))
    of_way = ways.filter(own).select("way", "refs", level.alias("level"), t["name"].alias("name"))
    ring = closed_ways(of_way, nodes)
    area = F.concat(F.lit("way "), F.col("way"))
    edges = edges.unionByName(areas.ring_edges(ring, ["way"]).select(area.alias("area"), "ax", "ay", "bx", "by"))
    found = found.unionByName(areas.measures(ring, ["way"]).join(of_way.drop("refs"), "way").select(area.alias("area"), "level", "name", F.abs("area2").alias("size")))
    return found, edges


def _entries(df: DataFrame, *more: str) -> DataFrame:
    """df (id, lon, lat, tags) as entries, with more of its columns if asked for; elements without a name or house number are
    none."""
    t = F.col("tags")
    people = F.regexp_replace(t["population"], "[, ]", "").try_cast("double")
    made = df.withColumn("e", T.entry(t)).filter("e IS NOT NULL")
    weight = T.importance(F.col("e.kind"), people, t["admin_level"].try_cast("double"))
    return made.select("id", "e.name", "e.kind", "e.osm", "lon", "lat", weight.alias("importance"), t["addr:city"].alias("city"), t["addr:state"].alias("state"), t["addr:country"].alias("country"), T.alternates(t, F.col("e.name")).alias("alt"), t["addr:street"].alias("street"), t["addr:housenumber"].alias("house"), *more)


def merged_streets(points: DataFrame, tagged: DataFrame, context: DataFrame) -> DataFrame:
    """(id, lon, lat, tags, more): one row for the runs (way, run, pos, lon, lat) of a lower-cased name and context.

    The point lies half way along all runs in the order of their ways, lengths taken flat; tags are the first way's, more
    the alternate names of all. Points are only ordered within their run; the sums of runs are ordered by ranges
    (lines.middle_runs), so a street of any length is many small tasks.
    """
    middle = Window.partitionBy("way", "run").orderBy("pos")
    nxt = F.lead(F.struct("lon", "lat")).over(middle)
    cut = points.withColumn("to", nxt)
    size = F.hypot((F.col("lon") - F.col("to.lon")) * F.cos(F.radians("lat")), F.col("lat") - F.col("to.lat"))
    cut = cut.withColumn("size", F.coalesce(size, F.lit(0.0))).withColumns({"upto": F.sum("size").over(middle.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("to.lon").over(middle).isNull()})
    cut = stage(cut.select("way", "run", "pos", "lon", "lat", "to", "size", "upto", "last"), "stretches")
    sums = cut.groupBy("way", "run").agg(F.sum("size").alias("length"), F.min_by(F.struct("lon", "lat"), "pos").alias("start"))
    sums = stage(sums.join(tagged.select("way", F.lower(F.col("tags")["name"]).alias("key")), "way").join(context, ["way", "run"], "left"), "runs")
    street = ["key", "city", "state", "country"]
    holds = lines.middle_runs(sums.filter("length > 0"), street)
    left = F.col("half") - F.col("before") - (F.col("upto") - F.col("size"))
    t = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col("size")))).otherwise(0.0)
    spot = F.struct("pos", (F.col("lon") + (F.col("to.lon") - F.col("lon")) * t).alias("lon"), (F.col("lat") + (F.col("to.lat") - F.col("lat")) * t).alias("lat"))
    # the last stretch is open to the rounding of its sums
    reached = (F.col("before") + F.col("upto") >= F.col("half")) | F.col("last")
    mids = holds.join(cut.filter("to IS NOT NULL"), ["way", "run"]).filter(reached).groupBy(*street).agg(F.min(spot).alias("spot"))
    same = lambda a, b: a.join(b.select(*(F.col(c).alias(f"_{c}") for c in street), *[c for c in b.columns if c not in street]), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in street], "left").drop(*(f"_{c}" for c in street))
    one = sums.groupBy(*street).agg(F.min(F.struct("way", "run", "start")).alias("first")).select(*street, "first.way", F.col("first.start").alias("origin"))
    alt = tagged.select("way", F.explode(T.alternates(F.col("tags"), F.col("tags")["name"])).alias("alt"))
    more = sums.select("way", *street).join(alt, "way").groupBy(*street).agg(F.collect_set("alt").alias("more"))
    found = same(same(one, mids), more).join(tagged.select("way", "tags"), "way")
    return found.select(F.concat(F.lit("way/"), F.col("way").cast("string")).alias("id"), F.coalesce("spot.lon", "origin.lon").alias("lon"), F.coalesce("spot.lat", "origin.lat").alias("lat"), "tags", F.coalesce("more", F.array().cast("array<string>")).alias("more"))


def server_gazetteer(places: DataFrame, ways: DataFrame, nodes: DataFrame, relations: DataFrame, members: DataFrame, cap: int = 0) -> DataFrame:
    """Tagged nodes, ways that are no streets, streets merged by name and context, and relations with a ring; the areas
    around an entry override what its tags say. By importance, then id; cap 0 keeps all."""
    t = F.col("tags")
    ways = stage(ways, "ways")
    rings = stage(areas.rings(members, ways, nodes), "rings")
    found, edges = admin_areas(ways, nodes, relations, rings)
    found, edges = stage(found, "areas"), stage(edges, "edges")
    street = F.coalesce(t["highway"].isNotNull() & t["name"].isNotNull() & t["addr:housenumber"].isNull(), F.lit(False))
    points = stage(roads.runs(_refs(ways.filter(street)), nodes).select("way", "run", "pos", "lon", "lat"), "points")
    rank = F.row_number().over(Window.partitionBy("way", "run").orderBy("pos")) - 1
    middle = points.withColumns({"at": rank, "n": F.count("*").over(Window.partitionBy("way", "run"))}).filter(F.col("at") == F.floor(F.col("n") / 2))
    context = areas.admin_context(middle.select(F.struct("way", "run").alias("point"), "lon", "lat"), found, edges).select("point.way", "point.run", "city", "state", "country")
    streets = merged_streets(points, ways.filter(street), context)
    more = F.array_sort(F.array_distinct(F.concat("alt", "more")))
    street_rows = _entries(streets, "more").withColumn("alt", more).drop("more")
    others = ways.filter(~street)
    line = bridged(others, nodes)
    mid = line.withColumn("n", F.count("*").over(Window.partitionBy("way"))).filter(F.col("pos") == F.floor(F.col("n") / 2)).select("way", "lon", "lat")
    centre = areas.measures(closed_ways(others, nodes), ["way"]).select("way", "cx", "cy")
    spots = others.join(mid, "way").join(centre, "way", "left").select(F.concat(F.lit("way/"), F.col("way").cast("string")).alias("id"), F.coalesce("cx", "lon").alias("lon"), F.coalesce("cy", "lat").alias("lat"), "tags")
    whole = areas.measures(rings.filter("NOT inner AND ring = 0"), ["relation", "ring"]).join(relations, "relation")
    whole = whole.select(F.concat(F.lit("relation/"), F.col("relation").cast("string")).alias("id"), F.col("cx").alias("lon"), F.col("cy").alias("lat"), "tags")
    nodes_ = places.select(F.concat(F.lit("node/"), F.col("id").cast("string")).alias("id"), "lon", "lat", "tags")
    # a way that is the first of several streets gives all of them its id, so entries are told apart by a number
    every = stage(_entries(nodes_.unionByName(spots).unionByName(whole)).unionByName(street_rows).withColumn("point", F.monotonically_increasing_id()), "entries")
    around = areas.admin_context(every.select("point", "lon", "lat"), found, edges).select("point", *(F.col(c).alias(f"in_{c}") for c in ("city", "state", "country")))
    out = every.join(around, "point", "left").withColumns({c: F.coalesce(f"in_{c}", c) for c in ("city", "state", "country")}).drop("point", "in_city", "in_state", "in_country")
    return capped_by_importance(out, cap)


def capped_by_importance(entries: DataFrame, cap: int) -> DataFrame:
    """The cap most important entries, those of one importance by id; all for 0."""
    ordered = entries.orderBy(F.desc("importance"), "id")
    return ordered.limit(cap) if cap > 0 else ordered
