"""Classification of tagged map elements; tags is a map<string,string> column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must equal published ones.
SPEED = {
    "motorway": 105, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 65, "primary_link": 40,
    "secondary": 55, "secondary_link": 35, "tertiary": 45, "tertiary_link": 30, "unclassified": 25, "residential": 25,
    "living_street": 10, "service": 15, "road": 25, "track": 10,
}
MIN_ZOOM = {"motorway": 0, "trunk": 0, "primary": 8, "secondary": 10, "tertiary": 12, "unclassified": 13, "residential": 13, "living_street": 14, "service": 15, "road": 13, "track": 15}
GREEN = ("forest", "wood", "grass", "meadow", "park", "garden", "recreation_ground", "grassland", "scrub", "heath", "nature_reserve")
IMPORTANCE = {"country": 0.75, "state": 0.65, "city": 0.55, "town": 0.45, "village": 0.38, "suburb": 0.32, "street": 0.25, "house": 0.12}
NODE_KEYS = (
    "name", "place", "amenity", "shop", "tourism", "leisure", "highway", "railway", "landuse", "natural", "waterway", "building",
    "office", "craft", "healthcare", "aeroway", "historic", "man_made", "addr:housenumber", "addr:street",
)
DRAWN_KEYS = ("name", "addr:housenumber", "highway", "waterway", "water", "landuse", "leisure", "natural", "boundary")
ALTERNATE_KEYS = ("alt_name", "official_name", "ref", "short_name")
FORWARD, BACKWARD = 1, 2


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def speed(tags: Column) -> Column:
    """km/h, 0 where cars may not go; the first whole number of maxspeed caps it."""
    shut = F.coalesce(tags["access"].isin("private", "no"), F.lit(False)) | F.coalesce(tags["motor_vehicle"] == "no", F.lit(False)) | F.coalesce(tags["motorcar"] == "no", F.lit(False))
    cap = F.regexp_extract(tags["maxspeed"], r"(\d+)", 1).try_cast("int")
    own = F.coalesce(lookup(SPEED, tags["highway"]), F.lit(0))
    return F.when(tags["highway"].isNull() | shut, 0).otherwise(F.least(own, F.coalesce(cap, own)))


def oneway_flags(tags: Column) -> Column:
    v = F.coalesce(tags["oneway"], F.lit(""))
    return F.when(v.isin("yes", "true", "1"), FORWARD).when(v.isin("-1", "reverse"), BACKWARD).otherwise(FORWARD | BACKWARD).cast("tinyint")


def feature(tags: Column) -> Column:
    """Struct (layer, class, polygon, min_zoom), null for what is not drawn: road, waterway, water, then green areas."""
    zoom = lookup(MIN_ZOOM, tags["highway"])
    make = lambda layer, kind, polygon, z: F.struct(F.lit(layer).alias("layer"), kind.alias("class"), F.lit(polygon).alias("polygon"), z.cast("int").alias("min_zoom"))
    none = F.lit(None)
    road = F.when(zoom.isNotNull(), make("roads", tags["highway"], False, zoom))
    greens = [F.when(tags[k].isin(*GREEN), make("green", tags[k], True, F.lit(5))) for k in ("landuse", "leisure", "natural")]
    water = (tags["natural"] == "water") | tags["water"].isNotNull()
    rest = F.when(tags["waterway"].isNotNull(), make("water", tags["waterway"], False, F.lit(5))).when(water, make("water", F.lit("water"), True, F.lit(5))).otherwise(F.coalesce(*greens))
    return F.when(tags["highway"].isNotNull(), F.coalesce(road, none)).otherwise(rest)


def importance(kind: Column, population: Column, admin_level: Column) -> Column:
    base = F.coalesce(lookup(IMPORTANCE, kind), F.lit(0.2))
    admin = F.coalesce(F.greatest(F.lit(0.0), 12.0 - admin_level) * 0.008, F.lit(0.0))
    people = F.greatest(F.lit(1.0), F.coalesce(population, F.lit(0.0)))
    return F.least(F.lit(1.0), base + F.log10(people) * 0.025 + admin)


def keep_keys(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(*keys))


def any_key(tags: Column, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (tags[k].isNotNull() for k in keys))


def _first_of(tags: Column, keys: tuple[str, ...]) -> Column:
    """key/value of the first key present."""
    return F.coalesce(*(F.concat(F.lit(k + "/"), tags[k]) for k in keys))


def entry(tags: Column) -> Column:
    """Struct (kind, osm, name) of a gazetteer entry, null without a name or house number; the first that fits of house,
    place, street, water, administrative area, point of interest and area."""
    house, place = tags["addr:housenumber"], tags["place"]
    make = lambda kind, osm: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), osm.alias("osm"))
    name = F.when(house.isNotNull(), F.trim(F.concat_ws(" ", house, tags["addr:street"]))).otherwise(tags["name"])
    level = tags["admin_level"]
    admin = F.when(level == "2", "country").when(level.isin("3", "4"), "state").when(level == "8", "city").otherwise("area")
    poi = _first_of(tags, ("amenity", "shop", "tourism", "leisure", "office", "historic"))
    chosen = (
        F.when(house.isNotNull(), make("house", F.concat(F.lit("addr:housenumber/"), house)))
        .when(place.isNotNull(), make(place, F.concat(F.lit("place/"), place)))
        .when(tags["highway"].isNotNull(), make("street", _first_of(tags, ("highway",))))
        .when(tags["waterway"].isNotNull(), make("water", _first_of(tags, ("waterway",))))
        .when(tags["natural"] == "water", make("water", F.lit("natural/water")))
        .when(tags["water"].isNotNull(), make("water", _first_of(tags, ("water",))))
        .when(tags["boundary"] == "administrative", make(admin, F.lit("boundary/administrative")))
        .when(poi.isNotNull(), make("poi", poi))
        .otherwise(make("area", _first_of(tags, ("natural", "landuse", "building", "type", "name"))))
    )
    return F.when(name.isNotNull(), F.struct(chosen["kind"].alias("kind"), chosen["osm"].alias("osm"), name.alias("name")))


def place_rank(tags: Column) -> Column:
    """Rank of a named node by its kind of place."""
    return F.when(tags["place"].isin("city", "town"), 100).when(tags["place"] == "village", 90).when(tags["place"].isin("suburb", "neighbourhood"), 60).otherwise(50)


def is_junction(tags: Column) -> Column:
    """Nodes that need not slow a car down twice: signals, turning circles, junctions, barriers, crossings of rails."""
    truth = lambda c: F.coalesce(c, F.lit(False))
    rails = tags["railway"].isNotNull() & lookup(SPEED, tags["highway"]).isNull()
    return truth(tags["highway"].isin("traffic_signals", "turning_circle")) | truth(tags["junction"] != "") | truth(~tags["barrier"].isin("", "no")) | truth(rails)


def area_layer(tags: Column) -> Column:
    """water, green or null: the layers of areas on a client's own map."""
    water = tags["waterway"].isNotNull() | tags["water"].isNotNull() | F.coalesce(tags["natural"] == "water", F.lit(False))
    green = tags["natural"].isin("wood", "grassland", "scrub"), tags["landuse"].isin("forest", "grass", "meadow", "recreation_ground"), tags["leisure"].isin("park", "garden")
    return F.when(water, "water").when(reduce(lambda a, b: a | b, (F.coalesce(g, F.lit(False)) for g in green)), "green")


def house_number(text: Column) -> Column:
    """The whole number that a house number starts with, null if none."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")


def node_tags(tags: Column) -> Column:
    """The tags worth keeping on a node."""
    return keep_keys(tags, NODE_KEYS)


def interesting(tags: Column) -> Column:
    """Whether an element is drawn or searched for; false for null."""
    return F.coalesce(any_key(tags, DRAWN_KEYS), F.lit(False))


def alternates(tags: Column, name: Column) -> Column:
    """Other names, each once and in order: names in languages, official, short and alternative ones, references."""
    other = F.map_filter(tags, lambda k, v: F.startswith(k, F.lit("name:")) | k.isin(*ALTERNATE_KEYS))
    found = F.flatten(F.transform(F.map_values(other), lambda v: F.split(v, ";")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: v != name)))


def routable(tags: Column, served: bool) -> Column:
    """Whether a way counts as routable: for the service any highway, for a client one that cars may use."""
    return F.coalesce(tags["highway"].isNotNull() if served else speed(tags) > 0, F.lit(False))


PLACES = ("city", "town", "village", "suburb", "neighbourhood", "hamlet", "country", "state")


def search_type(kind: Column, osm: Column) -> Column:
    """Struct (label, icon) of a hit by its kind, a point of interest's by the value after the slash of its tag."""
    start = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))
    make = lambda label, icon: F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(icon).alias("icon"))
    rest = F.replace(F.coalesce(F.get(F.split(osm, "/"), 1), kind, F.lit("Place")), F.lit("_"), F.lit(" "))
    fixed = F.when(kind.isin(*PLACES), make(start(kind), "city")).when(kind == "street", make("Street", "street")).when(kind.isin("house", "address"), make("Address", "address"))
    return fixed.when(kind == "water", make("Water", "water")).when(kind == "area", make("Area", "area")).otherwise(make(start(rest), "poi"))


def search_context(label: Column, city: Column, state: Column, country: Column, region: Column) -> Column:
    """The line under a hit: its label, then where it lies, each name once; the region's name if nothing else is known."""
    where = F.array_distinct(F.filter(F.array(city, state, country), lambda c: c.isNotNull() & (c != "")))
    lies = F.when(F.size(where) > 0, where).otherwise(F.filter(F.array(region), lambda c: c.isNotNull() & (c != "")))
    return F.array_join(F.concat(F.array(label), lies), " · ")
