"""Helpers that the text and vector operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import attach, linked as components
from ..storage import delete, shared_dir, stage, unstage

__all__ = ["WS", "attach", "components", "delete", "first_row", "free_name", "one_of_each", "topped", "row_key", "shared_dir", "sheltered", "stage", "table", "unstage"]

#: ASCII white space, as Java's and Python's regular expressions write it.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores before it that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def sheltered(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of these names renamed to free ones, and {new name: old name} to undo it."""
    back = {}
    for c in [c for c in df.columns if c.lower() in names]:
        new = free_name(df, "own_" + c)
        df, back[new] = df.withColumnRenamed(c, new), c
    return df, back


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits that tell rows of different ids or texts apart, hexadecimal; a null text is an empty one."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("~")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))))


def one_of_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose row_key() is in keys (key), one of each key; columns as in docs."""
    own = free_name(docs, "key")
    rows = docs.withColumn(own, row_key())
    return rows.join(keys.select(F.col("key").alias(own)), own, "left_semi").dropDuplicates([own]).select(*(F.col(f"`{c}`") for c in docs.columns))


def first_row() -> Column:
    """Aggregate: the struct (none, id, key) of the row with the smallest id, null ids last, then the smallest key."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))


def topped(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Staged classes (cid, first, ...) with top, the least first among the classes that edges (a, b) of cids reach. Staged
    files that edges are read from are deleted."""
    found = components(edges)
    inside = stage(classes.join(found.withColumnRenamed("node", "cid"), "cid"), "inside")
    tops = stage(inside.groupBy("root").agg(F.min("first").alias("top"), F.count("*").alias("m")), "tops")
    linked = attach(inside, tops, "root", "m", inside.count()).select(*classes.columns, "top")
    alone = classes.join(inside.select("cid"), "cid", "left_anti").withColumn("top", F.col("first"))
    out = stage(linked.unionByName(alone), "named")
    unstage(found, inside, tops)
    return out
