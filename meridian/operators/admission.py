"""Which requests run, and when: sliding-window admission, throttling, debouncing, expiry and the failure latch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admit(requests: DataFrame, limit: int, window_ms: int, running: int | None = None) -> DataFrame:
    """requests (key, ms, id) with admitted: fewer than limit admitted ones of the key in the window before and, if running
    is given, fewer than running of them not yet ended, hold_ms (a column, null: 0) after they began. The state is the times
    of the admitted ones that count, so a key's requests stream through in batches."""
    from collections import deque
    from heapq import heappop, heappush

    schema = "key long, ms long, id long, admitted boolean"

    def run(frames):
        key, times, ends = None, deque(), []
        for f in frames:
            out = []
            for k, ms, hold in zip(f["key"], f["ms"], f["hold"]):
                if k != key:
                    key, times, ends = k, deque(), []
                while times and times[0] <= ms - window_ms:
                    times.popleft()
                while ends and ends[0] <= ms:
                    heappop(ends)
                out.append(len(times) < limit and (running is None or len(ends) < running))
                if out[-1]:
                    times.append(ms)
                    if running is not None:
                        heappush(ends, ms + hold)
            yield pd.DataFrame({"key": f["key"], "ms": f["ms"], "id": f["id"], "admitted": out})

    hold = F.lit(0) if running is None else F.coalesce("hold_ms", F.lit(0))
    return requests.select("key", "ms", "id", hold.cast("long").alias("hold")).repartition("key").sortWithinPartitions("key", "ms", "id").mapInPandas(run, schema)


def throttle(requests: DataFrame, gap_ms: int) -> DataFrame:
    """requests (key, ms, id) with start_ms: first come, first served, starts at least gap_ms apart.

    The start of the n-th request is n gaps after the latest of (arrival - its own number of gaps) so far.
    """
    order = Window.partitionBy("key").orderBy("ms", "id")
    n = requests.withColumn("n", (F.row_number().over(order) - 1) * F.lit(gap_ms).cast("long"))
    return n.withColumn("start_ms", F.max(F.col("ms") - F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n")).drop("n")


def debounce(requests: DataFrame, quiet_ms: int, least: int = 2) -> DataFrame:
    """requests (key, ms, id, text): the last of each burst, if its trimmed text has at least so many characters."""
    order = Window.partitionBy("key").orderBy("ms", "id")
    last = F.lead("ms").over(order)
    return requests.withColumn("next", last).filter((F.col("next").isNull() | (F.col("next") - F.col("ms") >= quiet_ms)) & (F.length(F.trim("text")) >= least)).drop("next")


def expired(builds: DataFrame, leases: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    """builds (id, ms) older than keep_ms that no lease (id) holds."""
    return builds.filter(F.col("ms") + keep_ms <= now_ms).join(leases.select("id"), "id", "left_anti")


def latched(calls: DataFrame, limit: int = 3) -> DataFrame:
    """calls (key, ms, id, ok) with dead: whether limit calls in a row have failed by then; it stays so. Null is a failure."""
    order = Window.partitionBy("key").orderBy("ms", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fine = F.coalesce(F.col("ok"), F.lit(False))
    lately = F.sum((~fine).cast("int")).over(order.rowsBetween(1 - limit, 0))  # fewer rows than limit cannot reach it
    return calls.withColumn("bad", lately >= limit).withColumn("dead", F.max("bad").over(upto)).drop("bad")
