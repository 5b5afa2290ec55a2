import math

import pytest

from meridian.plans import catalog

from .conftest import SF

NAMES = list(catalog.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.oracle_sql()])
def test_query_equals_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalog.oracle_sql()])
def test_query_runs(name, spark):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_plans_push_filters_and_prune(spark):
    plan = catalog.queries()["category_nearest"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(NAMES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def alignment(a, b):
    """Optimal string alignment by its definition."""
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        ways = [d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1])]
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            ways.append(d(i - 2, j - 2) + 1)
        return min(ways)

    return d(len(a), len(b))


def twin_score(query, name, expansions):
    """The score of a folded name for a folded query, written from the rules alone."""
    if query == name:
        return 1000.0
    if name.startswith(query):
        return 800.0 - len(name) + len(query)
    spelled = lambda t: [t, *expansions.get(t, ())]

    def pair(q, n):
        if n.startswith(q) or (len(n) > 1 and q.startswith(n)):
            return abs(len(q) - len(n)), 0, 0
        if len(q) > 1 and q in n:
            return len(n) - len(q), 1, 0
        free = 0 if len(q) < 4 else 1 if len(q) < 6 else 2
        off = alignment(q, n) if abs(len(q) - len(n)) <= free else 9
        return (10 + off, 2, off) if 0 < off <= free else None

    matched, dropped, asked = [], 0, query.split()
    for token in asked:
        options = [(p[0], at, p[1], p[2]) for at, n in enumerate(name.split()) if (p := min(filter(None, (pair(x, y) for x in spelled(token) for y in spelled(n))), default=None))]
        if options:
            matched.append(min(options, key=lambda o: (o[0], o[1])))
        elif token.isdigit() and len(asked) > 1:
            dropped += 60
        else:
            return None
    if not matched:
        return None
    cost, places, kinds = sum(m[0] for m in matched), [m[1] for m in matched], {m[2] for m in matched}
    span = max(places) - min(places) - len(matched) + 1
    gaps = 15 * (min(places) + span)
    if kinds == {0} and span == 0 and places == sorted(set(places)) and (len(matched) > 1 or places == [0]):
        return 700.0 - 3 * cost - 10 * min(places) - dropped
    if kinds == {0}:
        return 620.0 - 4 * cost - gaps - dropped
    if 2 not in kinds:
        return 500.0 - 3 * cost - gaps - dropped
    return 440.0 - 25 * sum(m[3] for m in matched) - 3 * cost - gaps - dropped


def test_search_topk_equals_a_twin_in_scores_and_order(spark):
    import re

    from meridian.functions.text import EXPANSIONS

    fold = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    parts = [(r["p_partkey"], f"{r['p_name']} {r['p_brand']}", r["p_size"] % 100) for r in spark.read.parquet(f"{SF}/part.parquet").collect()]

    def bias(i):
        x, y = -114.0 + i % 100 * 0.003, 51.0 + i // 100 * 0.002
        a, b = math.radians(51.01), math.radians(y)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(x + 113.9) / 2) ** 2
        m = 2 * 6371008.8 * math.asin(math.sqrt(h))
        return min(120.0, m / 500) + min(350.0, max(0.0, m - 200000) / 3000)

    got = {}
    for r in sorted(catalog.search_topk(spark, SF).collect(), key=lambda r: (r["q"], r["place"])):
        got.setdefault(r["q"], []).append((r["id"], r["score"]))
    for (q,) in catalog.some_queries(spark, SF).collect():
        hits = [(-round(s + rank - bias(i), 4), name, i) for i, name, rank in parts if (s := twin_score(fold(q), fold(name), EXPANSIONS)) is not None]
        want = sorted(hits)[:12]
        assert [i for i, _ in got.get(q, [])] == [h[2] for h in want], q
        assert [s for _, s in got.get(q, [])] == pytest.approx([-h[0] for h in want], abs=2e-4)


def test_search_queries_equal_brute_force(spark):
    import re

    from meridian.functions import text

    text_key = lambda s: " ".join(text.EXPANSIONS.get(t, (t,))[0] for t in fold(s).split())
    fold = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    names = {r["p_name"] for r in parts if r["p_partkey"] % 20 == 0}
    asked = {*names, *(n[:3] for n in names), *(n[0] + n[2] + n[1] + n[3:] for n in names if len(n) > 5), "zzqqxx"}
    assert {r["q"] for r in catalog.some_queries(spark, SF).collect()} == asked
    hits = {}
    for q in asked:
        for r in parts:
            name = f"{r['p_name']} {r['p_brand']}"
            if (s := text.score_name(fold(q), fold(name))) is not None:
                hits.setdefault(q, []).append((-round(s + r["p_size"] % 100, 4), r["p_partkey"] % 5, name, r["p_partkey"]))
    best = {(q, h[3]) for q, found in hits.items() for h in sorted(found)[:20]}
    assert {(r["q"], r["id"]) for r in catalog.search_multi_region(spark, SF).collect()} == best
    got = {(r["q"], r["id"]) for r in catalog.search_topk(spark, SF).collect()}
    assert got <= {(q, h[3]) for q, found in hits.items() for h in found}
    assert all(sum(q == g for g, _ in got) == min(12, len(found)) for q, found in hits.items())
    places = {r["p_partkey"]: (f"{r['p_name']} {r['p_brand']}", -114.0 + r["p_partkey"] % 100 * 0.003, 51.0 + r["p_partkey"] // 100 * 0.002) for r in parts}

    def gap(a, b):
        (_, x, y), (_, u, v) = places[a], places[b]
        h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
        return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))

    want = set()
    for q, found in hits.items():
        by_region = {}
        for h in sorted(found):
            by_region.setdefault(h[1], []).append(h)
        kept, key = [], lambda i: text_key(places[i][0])
        for score, region, _, i in sorted((h for own in by_region.values() for h in own[:20]), key=lambda h: (h[0], str(h[1]), str(h[3]))):
            shadow = lambda o: o[0] != region and gap(o[1], i) <= 120 and (key(o[1]) == key(i) or key(o[1]).startswith(key(i) + " ") or key(i).startswith(key(o[1]) + " "))  # noqa: B023, E731
            if not any(map(shadow, kept)):
                kept.append((region, i))
        want |= {(q, str(i)) for _, i in kept}
    assert {(r["q"], r["identity"]) for r in catalog.merge_hits(spark, SF).collect()} == want
    near = lambda a, b: (d := text.edit_distance(a, b, most := text.tolerance(len(a)) + (len(a) >= 8))) <= most and d
    want = {}
    for q in asked:
        wide = fold(q + " Brand#11")
        found = [(d, -(r["p_size"] % 100), n) for r in parts if abs(len(wide) - len(fold(n := f"{r['p_name']} {r['p_brand']}"))) <= 3 and (d := near(wide, fold(n))) is not False]
        want[q + " Brand#11"] = (min(found)[2], min(found)[0]) if found else (None, None)
    assert {r["q"]: (r["name"], r["edits"]) for r in catalog.suggest_name(spark, SF).collect()} == want
