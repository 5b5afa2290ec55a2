import random
import time

import pytest
from pyspark.sql import functions as F

from meridian.operators import admission
from meridian.streaming import timers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def played(spark, tmp_path):
    """Plays rows as a stream, a file a batch, and gives what an operator puts out; the last file moves the watermark on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    count = iter(range(100))

    def play(batches, schema, operator):
        n = next(count)
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
            time.sleep(0.02 * (k + 1 < len(batches)))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{n}"))
        q = operator(stream).writeStream.format("memory").queryName(f"timers{n}").option("checkpointLocation", str(tmp_path / f"cp{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
        kept = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
        return sorted(map(tuple, spark.table(f"timers{n}").collect())), kept

    yield play
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


END = 10**9  # a key of its own far ahead, which only moves the watermark


def shuffled(rows, end):
    """Rows in two batches, each in any order, and a row far ahead."""
    rows = sorted(rows, key=lambda r: r[1])
    half = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    for h in half:
        random.Random(3).shuffle(h)
    return [*half, [end]]


def test_throttle_and_debounce_equal_batch(spark, played):
    r = random.Random(1)
    rows = [(r.randrange(3), r.randrange(1, 60_000), i, r.choice(["ab", " a ", None, "abc"])) for i in range(120)]
    schema = "key long, ms long, id long, text string"
    df = spark.createDataFrame(rows, schema)
    got, _ = played(shuffled(rows, (-1, END, -1, "xx")), schema, lambda s: timers.throttle(s, 1100))
    assert got == sorted(map(tuple, admission.throttle(df.select("key", "ms", "id"), 1100).select("key", "ms", "id", "start_ms").collect()))
    got, kept = played(shuffled(rows, (-1, END, -1, "xx")), schema, lambda s: timers.debounce(s, 900))
    assert got == sorted(map(tuple, admission.debounce(df, 900).select("key", "ms", "id", "text").collect())) and got


def test_latch_equals_batch(spark, played):
    r = random.Random(2)
    rows = [(r.randrange(4), r.randrange(1, 60_000), i, r.choice([True, True, False, None])) for i in range(120)]
    schema = "key long, ms long, id long, ok boolean"
    got, _ = played(shuffled(rows, (-1, END, -1, True)), schema, timers.latched)
    assert got == sorted(map(tuple, admission.latched(spark.createDataFrame(rows, schema)).select("key", "ms", "id", "dead").collect()))
    assert {d for *_, d in got} == {True, False}


def test_admission_with_leases(spark, played):
    r = random.Random(4)
    rows = [(r.randrange(2), r.randrange(1, 60_000), i, r.choice([None, 0, 3_000, 20_000])) for i in range(100)]
    schema = "key long, ms long, id long, hold_ms long"
    want, times, ends = [], {}, {}
    for key, ms, i, hold in sorted(rows, key=lambda x: (x[1], x[2])):
        recent = [t for t in times.get(key, []) if t > ms - 10_000]
        busy = [e for e in ends.get(key, []) if e > ms]
        fine = len(recent) < 4 and len(busy) < 2
        if fine:
            times.setdefault(key, []).append(ms)
            ends.setdefault(key, []).append(ms + (hold or 0))
        want.append((key, ms, i, fine))
    got, _ = played(shuffled(rows, (-1, END, -1, None)), schema, lambda s: timers.admit(s, 4, 10_000, 2))
    assert got == sorted(want)
    batch = admission.admit(spark.createDataFrame(rows, schema), 4, 10_000, 2)
    assert sorted(map(tuple, batch.select("key", "ms", "id", "admitted").collect())) == sorted(want)
    assert not all(f for *_, f in want)


def test_a_quiet_trip_is_stale_and_ended_trips_leave_nothing(played):
    schema = "key long, ms long, id long, kind string"
    rows = [[(1, 1, 1, "start"), (1, 1_000, 2, "fix"), (1, 21_000, 3, "fix"), (2, 1, 4, "start"), (3, 500, 5, "fix"), (3, 900, 6, "end"), (None, 5, 7, "fix"), (4, None, 8, "fix")],
            [(1, 41_001, 9, "fix"), (5, 60_000, 10, "fix")], [(5, 1_000, 11, "fix"), (9, 200_000, 12, "end")], [(9, 200_001, 13, "end")]]
    got, kept = played(rows, schema, timers.stale)
    assert got == [(1, 1_000, "live"), (1, 41_001, "live"), (1, 41_001, "stale"), (1, 61_002, "stale"), (2, 6_001, "waiting"), (3, 500, "live"), (5, 60_000, "live"), (5, 80_001, "stale")]
    assert kept == 1  # the last trip waits for the watermark; the others are forgotten


def test_leased_builds_go_at_their_release(played):
    schema = "key long, ms long, id long, kind string"
    rows = [[(1, 1, 1, "build"), (2, 1, 2, "build"), (2, 10, 3, "lease"), (3, 1, 4, "build"), (3, 900, 5, "use")], [(2, 5_000, 6, "release")], [(9, END, 7, "release")]]
    got, _ = played(rows, schema, lambda s: timers.expired(s, 1_000))
    assert [g for g in got if g[0] != 9] == [(1, 1_001), (2, 5_000), (3, 1_900)]


def test_silence_by_the_clock(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    df = spark.createDataFrame([(1, 5), (1, 9), (2, 7)], "key long, ms long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = timers.silent(stream, 500).writeStream.format("memory").queryName("silence").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("silence").count() < 4:
            time.sleep(0.3)
        assert sorted(map(tuple, spark.table("silence").collect())) == [(1, 9, "live"), (1, 9, "stale"), (2, 7, "live"), (2, 7, "stale")]
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
