"""Joins that no key can skew, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage, unstage

#: A key is hot when it holds more than one row in this many; at most this many keys can be hot.
HOT_SHARE = 1000


def attach(rows: DataFrame, found: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with found (one row for each key) that no key can skew.

    weight is found's count of rows by key, total their sum. Keys with more than total / HOT_SHARE rows number
    fewer than HOT_SHARE, so they are broadcast; what is left has no group larger than that share.
    """
    spark, most = rows.sparkSession, max(50, total // HOT_SHARE)
    hot = found.filter(F.col(weight) > most).collect()
    if not hot:
        return rows.join(found, key)
    few = spark.createDataFrame(hot, found.schema)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(found.filter(F.col(weight) <= most), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def linked(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that links reach.

    Alternating large-star and small-star steps; each ends in the shared folder and deletes the one before. A self-loop
    only adds its node.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    links = stage(_ordered(edges.filter("a <> b"), "a", "b"), "links")
    last = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.max("d")).first()
        if last == (now[0], now[1]) and (now[2] or 0) == 0:
            break
        last = (now[0], now[1])
        for large in (True, False):
            grown, least = _star(links, large)
            unstage(links, least)
            links = grown
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        nodes.distinct().join(links.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root"))
    )


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Each link once, its larger end first; d tells whether the smaller end has a link downwards (unknown: 1)."""
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().withColumn("d", F.lit(1))


def _star(links: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """The links after a step, and the staged frame that it used."""
    if large:
        seen = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = links.select("u", "v")
    least = stage(seen.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "least")
    total = (2 if large else 1) * links.count()
    joined = attach(seen, least, "u", "n", total)
    if large:
        made = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        made = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b")
    return stage(_ordered(made, "a", "b").withColumn("d", F.lit(0)), "links"), least
