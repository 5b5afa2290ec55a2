"""Position streams in batch: off-route confirmation, progress, staleness, turns, traffic bins, announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import announce_band, bearing, signed_turn, turn_kind


def threshold(speed: Column) -> Column:
    """Metres off the route that a fix may lie, by its speed in m/s; null for null."""
    return F.when(speed.isNotNull(), 25 + F.least(F.lit(65.0), 2 * speed))


def off_route(fixes: DataFrame, limit: Column, hold_ms: int) -> DataFrame:
    """fixes (trip, ms, distance) with state on, suspect or off: beyond the limit for hold_ms since the first such fix."""
    order = Window.partitionBy("trip").orderBy("ms")
    marked = fixes.withColumn("over", F.coalesce(F.col("distance") > limit, F.lit(False))).withColumn("island", F.sum((~F.col("over")).cast("int")).over(order))
    since = F.min(F.when(F.col("over"), F.col("ms"))).over(Window.partitionBy("trip", "island"))
    return marked.withColumn("state", F.when(~F.col("over"), "on").when(F.col("ms") - since >= hold_ms, "off").otherwise("suspect")).drop("island", "over")


def progress(fixes: DataFrame, limit: Column) -> DataFrame:
    """Distance along the route: it never falls, and stands still while off the route."""
    order = Window.partitionBy("trip").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    return fixes.withColumn("placed", F.coalesce(F.max(F.when(F.col("distance") <= limit, F.col("along"))).over(order), F.lit(0.0)))


def stale(fixes: DataFrame, limit_ms: int) -> DataFrame:
    """The gaps of a trip that are longer than the limit."""
    order = Window.partitionBy("trip").orderBy("ms")
    return fixes.withColumn("gap_ms", F.lead("ms").over(order) - F.col("ms")).filter(F.col("gap_ms") > limit_ms)


def turns(line: DataFrame, stride: int = 8) -> DataFrame:
    """line (route, pos, lon, lat): the turn at each stride-th vertex with a whole stride before and after it."""
    order, rows = Window.partitionBy("route").orderBy("pos"), Window.partitionBy("route")
    p = F.struct("lon", "lat")
    at = line.withColumns({"back": F.lag(p, stride).over(order), "ahead": F.lead(p, stride).over(order), "n": F.count("*").over(rows)})
    at = at.filter((F.col("pos") % stride == 0) & (F.col("pos") >= stride) & (F.col("pos") < F.col("n") - stride) & (F.col("n") > 2 * stride))
    into = bearing(F.col("back.lon"), F.col("back.lat"), F.col("lon"), F.col("lat"))
    out = bearing(F.col("lon"), F.col("lat"), F.col("ahead.lon"), F.col("ahead.lat"))
    return at.withColumn("delta", signed_turn(into, out)).withColumn("kind", turn_kind(F.col("delta"))).filter("kind IS NOT NULL").select("route", "pos", "delta", "kind")


def bins(line: DataFrame, stride: int = 8) -> DataFrame:
    """Chunks of stride vertices that share their ends: (route, bin, first_pos, last_pos). What is left at the end is a
    chunk of the last stride vertices, so it reaches back into the one before."""
    last = line.groupBy("route").agg(F.max("pos").cast("long").alias("last"))
    cut = last.filter("last > 0").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / stride))))
    start = F.when((F.col("bin") + 1) * stride > F.col("last"), F.greatest(F.lit(0).cast("long"), F.col("last") - stride)).otherwise(F.col("bin") * stride)
    return cut.select("route", "bin", start.alias("first_pos"), F.least(F.col("last"), (F.col("bin") + 1) * stride).alias("last_pos"))


def announcements(rows: DataFrame, units: str = "metric") -> DataFrame:
    """rows (trip, ms, instruction, metres) at which the pair of instruction and distance band changes."""
    order = Window.partitionBy("trip").orderBy("ms")
    keyed = rows.withColumn("band", announce_band(F.col("metres"), units)).withColumn("key", F.struct("instruction", "band"))
    return keyed.withColumn("last", F.lag("key").over(order)).filter("last IS NULL OR NOT key <=> last").drop("key", "last")
