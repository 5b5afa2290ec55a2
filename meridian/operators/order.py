"""Global orders without a global window: gapless numbers, running values of long groups, order checks over seams."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stage

#: Rows of a group whose running values one window takes.
BLOCK = 1024


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """df with a number from 0 without gaps in this order, equal rows in any.

    Rows are dealt out by ranges of the order and sorted there; a range's rows count from its place, and only the ranges'
    sizes (one for each partition) are added up. A group of any size lies in as many ranges as it needs. df is read
    twice, the first time for the ranges' bounds.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed, "ordered")
    part = F.shiftright("_at", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("_part")).count().collect()))
    before = df.sparkSession.createDataFrame([(p, b - n) for (p, n), b in zip(sizes, accumulate(n for _, n in sizes))], "_part long, _before long")
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part.cast("long")).join(F.broadcast(before), "_part").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + within).alias(name))


def running(df: DataFrame, key: str, at: Column, values: dict[str, Callable], combine: Callable, none: int = 0) -> DataFrame:
    """df with each column of values replaced by its running value along at (whole numbers, one for each row of a key).

    values maps columns to their aggregate, combine joins two of its results and none is that of no rows. A key is cut into
    blocks of at: windows run within a block and over the blocks' totals, so a key of any length is many small tasks. df
    must be stored, it is read twice.
    """
    own = [c for c in df.columns if c not in values]
    rows = df.withColumns({"_at": at, "_block": F.floor(at / BLOCK)})
    totals = rows.groupBy(key, "_block").agg(*(f(c).alias(f"_{c}") for c, f in values.items()))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(key, "_block", F.row_number().over(Window.partitionBy(key).orderBy("_block")).alias("_n"), *(f(f"_{c}").over(before).alias(f"_{c}") for c, f in values.items())).filter("_n > 1").drop("_n")
    inside = Window.partitionBy(key, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({c: f(c).over(inside) for c, f in values.items()}).join(bases, [key, "_block"], "left")
    return found.select(*own, *(combine(F.col(c), F.coalesce(f"_{c}", F.lit(none))).alias(c) for c in values))


#: Rows that one task sorts, about.
SORTED = 1 << 20


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """df, which has so many rows, dealt out by key to a partition for each SORTED of them where Spark's own number of
    partitions would give a task more: that number is fixed, and what a task sorts would grow with the table."""
    n = -(-rows // SORTED)
    return df.repartition(n, *key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: Rows of a block of numbered rows; what blocks add up to is one row each.
ROWS = 1 << 16


def sums_before(df: DataFrame, value: str, *order: Column | str, name: str = "before") -> DataFrame:
    """df with the sum of value over the rows before it in this order, which no two rows may share. A block of ROWS rows is
    one window, and the sums of blocks, 16 bytes each, are added up in the driver."""
    rows = numbered(df, *order, name="_number").withColumn("_block", F.floor(F.col("_number") / ROWS))
    sums = sorted(map(tuple, rows.groupBy("_block").agg(F.sum(value)).collect()))
    before = df.sparkSession.createDataFrame([(b, t - (n or 0)) for (b, n), t in zip(sums, accumulate(n or 0 for _, n in sums))], "_block long, _before long")
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "_block").select(*df.columns, (F.col(name) + F.col("_before")).alias(name))


def with_previous(df: DataFrame, number: str, value: Column, name: str = "previous") -> DataFrame:
    """df with the value of the row whose number is one less, null for the first. Numbers have no gaps. Blocks of ROWS rows
    look back on their own; only the last row of each is handed to the next, where the first row takes it."""
    rows = df.withColumns({"_block": F.floor(F.col(number) / ROWS), name: value})
    lasts = rows.groupBy((F.col("_block") + 1).alias("_block")).agg(F.max_by(name, number).alias("_seam"))
    inside = F.lag(name).over(Window.partitionBy("_block").orderBy(number))
    found = rows.join(lasts, "_block", "left").withColumn("_inside", inside)
    return found.withColumn(name, F.when(F.col(number) % ROWS == 0, F.col("_seam")).otherwise(F.col("_inside"))).select(*df.columns, name)


def disorder(df: DataFrame, number: str, *key: str) -> DataFrame:
    """The rows of df, numbered in the order they are stored in, whose key is less than that of the row before (previous)."""
    return with_previous(df, number, F.struct(*key)).filter(F.col("previous") > F.struct(*key))
