"""Map extracts and gazetteers as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "ARRAY<STRUCT<_k: STRING, _v: STRING>>"
NODE = f"_id BIGINT, _lat DOUBLE, _lon DOUBLE, tag {TAG}"
WAY = f"_id BIGINT, nd ARRAY<STRUCT<_ref: BIGINT>>, tag {TAG}"


def _tags():
    """Later tags of a key win, as in the file's order."""
    kept = F.filter(F.coalesce("tag", F.array().cast(TAG)), lambda t: t["_k"].isNotNull())
    return F.aggregate(kept, F.create_map().cast("map<string,string>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != t["_k"]), F.create_map(t["_k"], t["_v"])))


def xml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat, lon, tags) of nodes with coordinates in range; the XML source splits at elements. Of nodes with one id the
    last in the files counts."""
    raw = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path).withColumns({"file": F.col("_metadata.file_path"), "line": F.monotonically_increasing_id()})
    ok = F.col("_lat").between(-90, 90) & F.col("_lon").between(-180, 180) & ~F.isnan("_lat") & ~F.isnan("_lon")
    rows = raw.filter(ok).select(F.col("_id").alias("id"), F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags().alias("tags")).alias("v"), F.struct("file", "line").alias("at"))
    return rows.groupBy("id").agg(F.max_by("v", "at").alias("v")).select("id", "v.*")


def xml_ways(spark: SparkSession, path: str) -> DataFrame:
    """(id, refs, tags) of ways with a tag and two references; ids need not be unique."""
    raw = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path)
    return raw.filter((F.size("nd") >= 2) & (F.size("tag") >= 1)).select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _tags().alias("tags"))


RELATION = f"_id BIGINT, member ARRAY<STRUCT<_type: STRING, _ref: BIGINT, _role: STRING>>, tag {TAG}"


def xml_relations(spark: SparkSession, path: str) -> DataFrame:
    """(id, members array<struct<type, ref, role>>, tags) of relations."""
    raw = spark.read.format("xml").option("rowTag", "relation").schema(RELATION).load(path)
    members = F.transform(F.coalesce("member", F.array().cast("array<struct<_type:string,_ref:bigint,_role:string>>")), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role")))
    return raw.filter("_id IS NOT NULL").select(F.col("_id").alias("id"), members.alias("members"), _tags().alias("tags"))


def way_members(relations: DataFrame) -> DataFrame:
    """(relation, idx, way, role): the ways among relations' members, idx their place among all members."""
    each = relations.select(F.col("id").alias("relation"), F.posexplode("members").alias("idx", "m")).filter("m.type = 'way'")
    return each.select("relation", "idx", F.col("m.ref").alias("way"), F.col("m.role").alias("role"))


GAZETTEER = "id STRING, name STRING, type STRING, osm STRING, lat DOUBLE, lon DOUBLE, importance DOUBLE, city STRING, state STRING, country STRING, alt ARRAY<STRING>, street STRING, house STRING"


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines, the first of an id, with cat and rank, a hundred times the importance. A line that is no entry
    fails the job with the line in the message; empty lines are passed over. rejected_entries() lists such lines."""
    rows = _checked(spark, path)
    held = F.when(F.col("ok"), F.col("e")).otherwise(F.raise_error(F.concat(F.lit("Invalid gazetteer entry: "), F.col("value"))).cast(rows.schema["e"].dataType))
    first = rows.select(held.alias("e"), "at").filter("e IS NOT NULL").groupBy("e.id").agg(F.min_by("e", "at").alias("e")).select("e.*")
    cat = F.when(F.col("type") == "poi", F.get(F.split("osm", "/"), 1)).when(F.col("type") == "house", "address").otherwise(F.col("type"))
    return first.withColumns({"cat": cat, "rank": F.col("importance") * 100})


def rejected_entries(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that read_gazetteer() would fail at."""
    return _checked(spark, path).filter("NOT ok").select("value")


def _checked(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).filter(F.trim("value") != "").select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("at"))
    e = F.from_json("value", GAZETTEER, {"mode": "PERMISSIVE"})
    loose = F.from_json("value", "map<string,string>")
    ok = F.col("e.id").rlike(r"^(node|way|relation)/-?[0-9]+$") & F.col("e.name").isNotNull() & F.col("e.type").isNotNull() & F.col("e.osm").isNotNull()
    ok &= F.col("e.lat").between(-90, 90) & F.col("e.lon").between(-180, 180) & F.col("e.importance").between(0, 1) & F.col("e.alt").isNotNull() & ~F.exists("e.alt", lambda a: a.isNull())
    # a field that is there but has another type came out null
    for name in ("city", "state", "country", "street", "house"):
        ok &= F.col(f"e.{name}").isNotNull() | F.col("m")[name].isNull()
    return raw.select("value", "at", e.alias("e"), loose.alias("m")).withColumn("ok", F.coalesce(ok, F.lit(False))).drop("m")


def write_gazetteer(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines without null fields."""
    df.write.option("compression", "gzip").option("ignoreNullFields", "true").json(path)
