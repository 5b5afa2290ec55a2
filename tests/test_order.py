"""Numbers and running values without global windows."""

import random

from pyspark.sql import functions as F

from meridian.operators import order
from meridian.storage import stage


def test_numbers_have_no_gaps_and_need_no_single_partition(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 5, r.randrange(1000)]), k) for k in range(3000)]
    df = stage(spark.createDataFrame(rows, "id long, k long").repartition(7), "rows")
    got = order.numbered(df, F.asc_nulls_last("id"), F.desc("k"), name="slot")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, -x[1]))
    assert [(x["id"], x["k"]) for x in sorted(got.collect(), key=lambda x: x["slot"])] == want
    assert sorted(x["slot"] for x in got.collect()) == list(range(3000))
    assert order.numbered(df.limit(0), "id").count() == 0


def test_running_values_of_long_groups(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 16)
    r = random.Random(2)
    rows = [(k % 3 if k < 300 else None, k - 150, r.randrange(100)) for k in range(900)]
    df = stage(spark.createDataFrame(rows, "g long, at long, v long").filter("g IS NOT NULL"), "rows")
    up = {tuple(x) for x in order.running(df, "g", F.col("at"), {"v": F.sum}, lambda a, b: a + b).collect()}
    down = {tuple(x) for x in order.running(df, "g", -F.col("at"), {"v": F.bit_xor}, lambda a, b: a.bitwiseXOR(b)).collect()}
    want_up, want_down = set(), set()
    for g in range(3):
        own = sorted(x[1:] for x in rows if x[0] == g)
        total = 0
        for at, v in own:
            total += v
            want_up.add((g, at, total))
        total = 0
        for at, v in reversed(own):
            total ^= v
            want_down.add((g, at, total))
    assert up == want_up and down == want_down


def test_sums_and_previous_rows_over_block_seams(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS", 64)
    r = random.Random(3)
    rows = [(k, r.randrange(100)) for k in r.sample(range(10**6), 1000)]
    df = stage(spark.createDataFrame(rows, "k long, v long").repartition(5), "rows")
    total, want = 0, {}
    for k, v in sorted(rows):
        want[k], total = total, total + v
    assert {x["k"]: x["before"] for x in order.sums_before(df, "v", "k").collect()} == want
    placed = order.numbered(df, "k", name="place")
    values = [v for _, v in sorted(rows)]
    got = {x["place"]: x["previous"] for x in order.with_previous(placed, "place", F.col("v")).collect()}
    assert got == {k: values[k - 1] if k else None for k in range(1000)}
    found = order.disorder(placed, "place", "v")
    assert {x["place"] for x in found.collect()} == {k for k in range(1, 1000) if values[k - 1] > values[k]}
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_dealt_to_more_partitions(spark, monkeypatch):
    from meridian.operators import order, roads

    monkeypatch.setattr(order, "SORTED", 100)
    refs = spark.range(1000).selectExpr("id div 10 AS way", "id % 10 AS pos", "CASE WHEN id % 4 = 3 THEN -1 ELSE id % 50 END AS node")
    nodes = spark.range(50).selectExpr("id AS node", "id * 0.01D AS lon", "0.0D AS lat")
    assert order.dealt(refs, 1000, "way").rdd.getNumPartitions() == 10 and order.dealt(refs, 100, "way") is refs
    runs = roads.runs(refs, nodes, rows=1000)
    plan = roads.segments(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "hashpartitioning(way" in plan
    want, row = set(), {(r["way"], r["pos"]): r["node"] for r in refs.collect()}
    for (w, p), n in row.items():
        if n >= 0 and row.get((w, p + 1), -1) >= 0:
            want |= {(w, p, n, row[w, p + 1])}
    assert {(r["way"], r["pos"], r["src"], r["dst"]) for r in roads.segments(runs).collect()} == want
    assert {(r["way"], r["pos"]) for r in runs.collect()} == {(w, p) for w, p, *_ in want} | {(w, p + 1) for w, p, *_ in want}
