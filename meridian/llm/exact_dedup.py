"""Exact dedup over a persistent digest index: a Parquet table bucketed and sorted by the digest.

A batch is aggregated by digest, a sort-merge anti-join against the index leaves the digests it has not seen, and
those are appended in the index's own buckets, so neither side of the anti-join moves the index. Everything here
is DataFrame and SQL work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, attach, delete, one_of_each, row_key, shared_dir, stage, table

#: Batches, in the order of ids, in which a whole table is taken in.
BATCHES = 4


def normalised(text: str | Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), WS, " ")


def digest(text: str | Column) -> Column:
    return F.sha2(normalised(text), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Staged (id, digest, row): 32 bytes of digest and a number for each row; more names further columns."""
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(digest(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row"), *(c.alias(n) for n, c in more.items()))
    return stage(found, "digests")


class DigestIndex:
    """A digest index at a path; opening a path that has one goes on from its contents.

    Rows: digest (32 bytes), keep_id (id that stays, null if every copy had a null id), batch (the name of the batch that
    brought it).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Append the digests of rows (id, digest) that the index lacks, each with its smallest id; null ids come last.

        A batch that is added again, in whole or after an append that was cut short, adds what is still missing.
        """
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
        found = rows.groupBy("digest").agg(first).select("digest", F.col("first.id").alias("keep_id"))
        placed = found.repartition(self.buckets, "digest").sortWithinPartitions("digest").hint("merge")
        fresh = placed.join(self.rows().select("digest"), "digest", "left_anti")
        fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.name)

    def look_up(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        """rows (id, digest, row, ...) with keep_id, group_size and kept. group_size counts the copies in rows; kept marks
        one row of a digest that one of these batches brought: the first with the id that stays."""
        best = F.struct(F.col("id").isNull().alias("none"), "id", "row")
        groups = rows.groupBy("digest").agg(F.min(best).alias("first"), F.count("*").alias("group_size"))
        known = groups.repartition(self.buckets, "digest").hint("merge").join(self.rows().withColumnRenamed("batch", "by"), "digest")
        mine = F.col("by").isin(batches) & F.col("first.id").eqNullSafe(F.col("keep_id"))
        known = stage(known.select("digest", "keep_id", "group_size", F.when(mine, F.col("first.row")).alias("first_row")), "known")
        out = attach(rows, known, "digest", "group_size", rows.count())
        return out.withColumn("kept", F.coalesce(F.col("row") == F.col("first_row"), F.lit(False))).drop("first_row", "row")

    def ingest(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; return (id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

        batch names it: a job that died after the append is started again under the same name, finds its own digests in
        the index and returns what it would have returned. keep_id is the id that an earlier batch kept, else the batch's
        smallest; group_size counts the batch's copies. Of rows with the same id and text one is kept. Null ids sort after
        all others; a null text is empty; very long texts are hashed whole; other columns of docs are not read.
        """
        rows = digests(docs, id_col, text_col)
        self.add(rows, batch)
        return self.look_up(rows, [batch]).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self, path: str) -> "DigestIndex":
        """A copy with one sorted file for each bucket, for an index that many appends have split."""
        other = DigestIndex(self.spark, path, self.buckets)
        self.rows().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(other.name)
        return other

    def drop(self) -> None:
        """Take the table out of the catalog and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def production_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder; buckets follow the session's shuffle partitions."""
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def in_batches(docs: DataFrame, **more: Column) -> DataFrame:
    """(id, digest, keep_id, group_size, kept, ...) for each row of docs: the table goes through a new index in batches by
    id, so that the anti-join drops what an earlier batch has. The index is dropped once its answers are stored."""
    rows = digests(docs, **more)
    cuts = rows.approxQuantile("id", [k / BATCHES for k in range(1, BATCHES)], 0.01)
    edges = [None, *sorted({int(c) for c in cuts}), None]
    index, names = production_index(docs.sparkSession), []
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        part = rows if low is None else rows.filter(F.col("id").isNull() | (F.col("id") > low)) if high is None else rows.filter(F.col("id") > low)
        names.append(f"part {k}")
        index.add(part if high is None else part.filter(F.col("id") <= high), names[-1])
    out = index.look_up(rows, names)
    index.drop()
    return out


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = in_batches(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact dedup keeps, all columns; repeated rows of one id and text leave one row.

    A null text is empty, a null id comes after all others; columns of any name pass through; no rows give none.
    """
    return one_of_each(docs, in_batches(docs, key=row_key()).filter("kept"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
