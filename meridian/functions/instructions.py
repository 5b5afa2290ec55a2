"""Route answers of a hosted engine: icons, shields, messages, and trips as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lines import joined_legs
from ..operators.tiles import from_polyline
from .tags import lookup

# Results must equal published ones.
ICONS = {
    0: "continue", 1: "start", 2: "start-right", 3: "start-left", 4: "destination", 5: "destination-right", 6: "destination-left",
    7: "continue", 8: "continue", 9: "slight-right", 10: "right", 11: "sharp-right", 12: "uturn-right", 13: "uturn-left",
    14: "sharp-left", 15: "left", 16: "slight-left", 17: "ramp-straight", 18: "ramp-right", 19: "ramp-left", 20: "exit-right",
    21: "exit-left", 22: "continue", 23: "fork-right", 24: "fork-left", 25: "merge-right", 26: "roundabout-enter",
    27: "roundabout-exit", 28: "ferry", 29: "ferry", 30: "continue", 36: "merge-right", 37: "merge-left", 38: "continue",
    39: "continue", 40: "continue",
}
MAJOR = (11, 12, 14, 17, 18, 19, 25, 36, 37)
LONG_TRIP = "That trip is longer than the routing server will plan. Pick a closer destination, or use the offline map."
NO_ROUTE = "No route found between those points on this server. Try another engine, or use the offline map."
CODES = {
    100: "The routing server rejected the request as malformed.", 101: "The routing server could not read the request.",
    110: "The routing server rejected the request URL.", 125: "The routing server could not read the request body.",
    154: LONG_TRIP, 155: "The routing server cannot plan a route with no start or destination.", 156: LONG_TRIP,
    157: "That route has more turns than the routing server will plan. Split the trip into shorter legs.",
    160: "The routing server could not plan that route.", 161: "The routing server could not find a path between those points.",
    171: NO_ROUTE, 172: "The routing server found no alternative routes.",
    442: "The routing server could not find a road to snap the start or destination to.",
    443: "The destination is too close to the start to route.",
}
BUSY = "The routing server is busy and is limiting requests. Try again in a moment, or use the offline map."
PHRASES = (
    ("max distance|exceeds the max", "That trip is too long for the routing server to plan. Pick a closer destination, or use the offline map."),
    ("no path|no route|no edges|not connected|cannot find", NO_ROUTE),
    ("origin|destination|snap", "The routing server could not match the start or destination to a road."),
    ("maneuver|turn limit", "That route has too many turns to plan. Split the trip into shorter legs."),
)


def icon(kind: Column) -> Column:
    return F.coalesce(lookup(ICONS, kind), F.lit("continue"))


def is_major(kind: Column) -> Column:
    return F.coalesce(kind.isin(*MAJOR), F.lit(False))


def short_text(instruction: Column) -> Column:
    return F.trim(F.regexp_replace(instruction, r"\s+", " "))


def shield(texts: Column) -> Column:
    """Exit numbers as one text, null without any."""
    return F.nullif(F.trim(F.array_join(texts, "")), F.lit(""))


def failure_message(status: Column, code: Column, raw: Column) -> Column:
    """What to tell a user: by the engine's code, the status, a phrase of the answer, or the status alone."""
    low = F.lower(raw)
    said = F.when(status == 429, BUSY)
    for phrase, text in PHRASES:
        said = said.when(low.rlike(phrase), text)
    other = F.concat(F.lit("The routing server refused this route (HTTP "), F.coalesce(status.cast("string"), F.lit("?")), F.lit("). Try another engine, or use the offline map."))
    return F.coalesce(lookup(CODES, code), said, other)


MANEUVER = "STRUCT<type: INT, instruction: STRING, length: DOUBLE, time: DOUBLE, begin_shape_index: INT, sign: STRUCT<exit_number_elements: ARRAY<STRUCT<text: STRING>>>>"
SUMMARY = "STRUCT<length: DOUBLE, time: DOUBLE>"
TRIP = f"STRUCT<units: STRING, summary: {SUMMARY}, legs: ARRAY<STRUCT<shape: STRING, summary: {SUMMARY}, maneuvers: ARRAY<{MANEUVER}>>>>"


def trips(answers: DataFrame, units: str = "km") -> DataFrame:
    """answers (id, json) as rows (id, alternate, units, metres, seconds, legs): the trip, alternate 0, and its alternatives.

    Lengths are in metres. Answers without a leg or a summary have no row; nor have alternatives without a leg.
    """
    doc = F.from_json("json", f"trip {TRIP}, alternatives ARRAY<STRUCT<trip: {TRIP}>>")
    every = F.concat(F.array("d.trip"), F.coalesce(F.transform("d.alternatives", lambda a: a["trip"]), F.array().cast(f"array<{TRIP}>")))
    rows = answers.withColumn("d", doc).select("id", F.posexplode(every).alias("alternate", "t")).filter("size(t.legs) > 0")
    said = F.when(F.col("t.units") == "miles", "miles").when(F.col("t.units").isin("kilometers", "km"), "km").otherwise(units)
    total = F.coalesce("t.summary", F.get("t.legs", 0)["summary"])
    metres = total["length"] * (1609.344 if units == "miles" else 1000.0)
    return rows.select("id", "alternate", said.alias("units"), metres.alias("metres"), total["time"].alias("seconds"), F.col("t.legs").alias("legs")).filter("metres IS NOT NULL AND seconds IS NOT NULL")


def geometry(found: DataFrame) -> DataFrame:
    """(route struct<id, alternate>, pos, lon, lat): the legs of trips() as one line, without the repeats where legs meet."""
    legs = found.select(F.struct("id", "alternate").alias("route"), F.posexplode("legs").alias("leg", "l"))
    points = legs.select("route", "leg", F.posexplode(from_polyline(F.col("l.shape"))).alias("pos", "p")).select("route", "leg", "pos", "p.lon", "p.lat")
    return joined_legs(points)


def steps(found: DataFrame) -> DataFrame:
    """(id, alternate, step, icon, major, title, metres, shape_index, shield) of a trip's first leg."""
    each = found.select("id", "alternate", "units", F.posexplode(F.get("legs", 0)["maneuvers"]).alias("step", "m"))
    metres = F.col("m.length") * F.when(F.col("units") == "miles", 1609.344).otherwise(1000.0)
    exits = F.transform("m.sign.exit_number_elements", lambda e: e["text"])
    return each.select("id", "alternate", "step", icon(F.col("m.type")).alias("icon"), is_major(F.col("m.type")).alias("major"), short_text(F.col("m.instruction")).alias("title"), metres.alias("metres"), F.col("m.begin_shape_index").alias("shape_index"), shield(exits).alias("shield"))


def compared(routes: DataFrame) -> DataFrame:
    """routes (trip, k, seconds, same: whether its line is the first's) by trip: the fastest and slowest of equals the first,
    seconds saved, confidence none, estimated or live, and a note."""
    saved = F.greatest(F.lit(0.0), F.max("seconds") - F.min("seconds"))
    found = routes.groupBy("trip").agg(F.min_by("k", F.struct("seconds", "k")).alias("fastest"), F.min_by("k", F.struct(-F.col("seconds"), "k")).alias("slowest"), saved.alias("saved"), F.count_if((F.col("k") == 0) | ~F.col("same")).alias("distinct"))
    sure = F.when(F.col("distinct") == 1, "none").when(F.col("saved") > 60, "live").otherwise("estimated")
    note = F.when(F.col("confidence") == "live", F.concat(F.lit("Avoiding congestion, saving about "), F.floor(F.col("saved") / 60 + 0.5).cast("string"), F.lit(" min"))).when(F.col("confidence") == "estimated", "Slightly faster route selected")
    return found.withColumn("confidence", sure).withColumn("note", note).drop("distinct")
