"""GeoJSON: a line of JSON for each feature, as tools that stream features read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tags import MIN_ZOOM, lookup


def _pair(p: Column) -> Column:
    return F.array(p["lon"], p["lat"])


def feature(kind: str, coordinates: Column, properties: Column) -> Column:
    """A feature as JSON text; kind is Point, LineString or Polygon."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def roads(lines: DataFrame, zoom: int) -> DataFrame:
    """lines (way, class, points array<struct<lon, lat>>) drawn at a zoom, as (way, feature); unknown classes are drawn."""
    least = lookup(MIN_ZOOM, F.col("class"))
    shown = lines.filter(least.isNull() | (least <= zoom))
    return shown.select("way", feature("LineString", F.transform("points", _pair), F.struct("class")).alias("feature"))


def areas(rings: DataFrame) -> DataFrame:
    """rings (area, class, rings array<array<struct<lon, lat>>>) as (area, feature), the outer ring first."""
    return rings.select("area", feature("Polygon", F.transform("rings", lambda r: F.transform(r, _pair)), F.struct("class")).alias("feature"))


def points(rows: DataFrame, id_col: str, properties: list[str]) -> DataFrame:
    return rows.select(id_col, feature("Point", _pair(F.struct("lon", "lat")), F.struct(*properties)).alias("feature"))


def line_points(points: DataFrame, by: str) -> DataFrame:
    """(by, points) of rows (by, pos, lon, lat): a feature's points in order; a feature is one row, so it must fit one."""
    return points.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def write(features: DataFrame, path: str, collection: bool = False) -> None:
    """Features as lines; as one collection only if asked for, which takes one task that streams them in the order of the
    first column."""
    key, text = features.columns[0], F.col("feature")
    if not collection:
        return features.select(text.alias("value")).write.text(path)
    ranked = features.withColumn("n", F.row_number().over(Window.orderBy(key)))
    lead = F.when(F.col("n") == 1, F.lit('{"type":"FeatureCollection","features":[')).otherwise(F.lit(","))
    lines = ranked.select("n", F.concat(lead, text).alias("value")).unionByName(features.sparkSession.range(1).select(F.lit(2**31 - 1).alias("n"), F.when(F.lit(features.isEmpty()), '{"type":"FeatureCollection","features":[]}').otherwise("]}").alias("value")))
    lines.coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
