"""Bundles: manifests checked against their rules and against what an archive holds, storage totals and what to drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .order import sums_before

#: Largest whole number that a double holds exactly, as clients read sizes.
MOST = 2**53 - 1

SCHEMA = """format STRING, build STRUCT<id: STRING, created: STRING, packserver: STRING, valhalla: STRING>,
 region STRUCT<name: STRING, bbox: ARRAY<DOUBLE>, counts: STRUCT<nodes: BIGINT, ways: BIGINT, routable: BIGINT>>,
 inputs ARRAY<STRUCT<filename: STRING, bytes: BIGINT, sha256: STRING, sorted: BOOLEAN, resorted: BOOLEAN>>,
 artifacts ARRAY<STRUCT<name: STRING, role: STRING, format: STRING, bytes: BIGINT, sha256: STRING>>"""


def parsed(text: Column) -> Column:
    return F.from_json(text, SCHEMA)


def problem(m: Column, form: str, formats: dict[str, tuple[str, str]]) -> Column:
    """What is wrong first with a manifest, null if nothing is. form is the manifest's own format, formats the role and format
    of each artifact by its name; all of them are needed."""
    hex64 = r"^[a-f0-9]{64}$"
    size = lambda n: n.isNotNull() & n.between(0, MOST)
    box, counts = m["region"]["bbox"], m["region"]["counts"]
    four = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    head = (m["format"] == form) & m["build"]["id"].rlike("^[a-zA-Z0-9_-]{1,128}$") & m["region"]["name"].isNotNull() & four
    w, s, e, n = (F.get(box, k) for k in range(4))
    region = (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90) & (w <= e) & (s <= n) & size(counts["nodes"]) & size(counts["ways"]) & size(counts["routable"])
    build = F.try_to_timestamp(m["build"]["created"]).isNotNull() & m["build"]["valhalla"].isNotNull() & m["build"]["packserver"].isNotNull()
    source = lambda i: i["sha256"].rlike(hex64) & i["filename"].isNotNull() & size(i["bytes"]) & i["sorted"].isNotNull() & i["resorted"].isNotNull()
    inputs = (F.size(m["inputs"]) > 0) & F.forall(m["inputs"], lambda i: F.coalesce(source(i), F.lit(False)))
    known = lambda a: reduce(lambda x, y: x | y, ((a["name"] == k) & (a["role"] == r) & (a["format"] == f) for k, (r, f) in formats.items()))
    artifact = lambda a: known(a) & size(a["bytes"]) & (a["bytes"] > 0) & a["sha256"].rlike(hex64)
    three = (F.size(m["artifacts"]) == len(formats)) & (F.size(F.array_distinct(F.transform(m["artifacts"], lambda a: a["name"]))) == len(formats))
    total = F.aggregate(m["artifacts"], F.lit(0.0), lambda t, a: t + a["bytes"]) <= MOST
    rules = [
        (m.isNotNull(), "no manifest"), (head, "unsupported or invalid manifest"), (region, "invalid region"), (build, "invalid build provenance"),
        (inputs, "invalid input provenance"), (three, "artifacts missing"), (F.forall(m["artifacts"], lambda a: F.coalesce(artifact(a), F.lit(False))), "invalid artifact"), (total, "invalid size"),
    ]
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for ok, what in rules))


def manifest(form: str, build: Column, region: Column, inputs: Column, artifacts: Column) -> Column:
    """A manifest as JSON text."""
    return F.to_json(F.struct(F.lit(form).alias("format"), build.alias("build"), region.alias("region"), inputs.alias("inputs"), artifacts.alias("artifacts")))


def mismatches(listed: DataFrame, entries: DataFrame) -> DataFrame:
    """(bundle, name, problem) where a manifest's artifacts (bundle, name, bytes, sha256) and an archive's entries (same
    columns) differ: one is missing, sizes or hashes are not the same, or a name comes twice in the archive."""
    own = entries.groupBy("bundle", "name").agg(F.count("*").alias("n"), F.first("bytes").alias("has_bytes"), F.first("sha256").alias("has_hash"))
    both = listed.select("bundle", "name", "bytes", "sha256", F.lit(True).alias("listed")).join(own, ["bundle", "name"], "full")
    what = F.when(F.col("listed").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice").when(~F.col("bytes").eqNullSafe(F.col("has_bytes")), "size").when(~F.col("sha256").eqNullSafe(F.col("has_hash")), "checksum")
    return both.select("bundle", "name", what.alias("problem")).filter("problem IS NOT NULL")


def victims(regions: DataFrame, needed: int, quota: int) -> DataFrame:
    """regions (id, bytes) to drop, the largest first, until needed bytes fit the quota beside the rest; ties by id."""
    rows = stage(regions.select("id", "bytes"), "regions")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return sums_before(rows, "bytes", F.desc("bytes"), "id", name="freed").filter(total - F.col("freed") + needed > quota).select("id", "bytes")


def folded(scans: DataFrame) -> DataFrame:
    """One row of the counts and boxes of several inputs (nodes, ways, routable, west, south, east, north)."""
    return scans.agg(*(F.sum(c).alias(c) for c in ("nodes", "ways", "routable")), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
