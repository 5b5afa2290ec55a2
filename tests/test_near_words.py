import random

from meridian.functions.text import edit_distance
from meridian.operators.near_words import near_words, walk


def brute(words, queries, most):
    return {(q, w, d) for q, m in zip(queries, most) for w in words if (d := edit_distance(q, w, m)) <= m}


def test_walk_equals_every_pair():
    r = random.Random(7)
    words = sorted({"", "a", "é", "𝛼βγ", "x" * 40, "x" * 20 + "yx" + "x" * 18} | {"".join(r.choices("abé𝛼", k=r.randrange(0, 10))) for _ in range(400)})
    queries = [*words[::5], "ab", "ba", "", "zz", "x" * 41, "y" * 300]
    most = [r.randrange(4) for _ in queries]
    assert {(queries[q], words[w], d) for w, q, d in walk(words, queries, most)} == brute(words, queries, most)
    shuffled = words[:]
    r.shuffle(shuffled)
    assert {(queries[q], shuffled[w], d) for w, q, d in walk(shuffled, queries, most)} == brute(words, queries, most)
    assert list(walk([], queries, most)) == [] == list(walk(words, [], []))


def test_walk_leaves_what_no_query_can_follow():
    r = random.Random(8)
    words = sorted({"".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(5000)})
    queries, steps = [w[:4] + w[5] + w[4] + w[6:] for w in words[::100]], []
    found = {(queries[q], words[w]) for w, q, _ in walk(words, queries, [2] * len(queries), steps)}
    assert all((q, w) in found for q, w in zip(queries, words[::100]))
    # every pair would be nine letters each; most pairs are left within the first three or four
    assert sum(steps) < len(words) * len(queries) * 9 / 3


def test_near_words_nulls_repeats_and_no_rows(spark):
    words = spark.createDataFrame([("main",), ("main",), ("mian",), ("",), (None,), ("street",)], "word string")
    asked = spark.createDataFrame([("main", 0), ("main", 1), ("m", 1), ("stret", 1), (None, 2), ("main", None), ("tsreet", 0)], "query string, most int")
    got = sorted(map(tuple, near_words(words, asked).collect()))
    assert got == [("m", "", 1), ("main", "main", 0), ("main", "mian", 1), ("stret", "street", 1)]
    assert near_words(words.limit(0), asked).count() == 0 == near_words(words, asked.limit(0)).count()


def test_near_words_over_slices_and_blocks(spark, monkeypatch):
    from meridian.operators import near_words as module

    monkeypatch.setattr(module, "SLICE", 50)
    monkeypatch.setattr(module, "BLOCK", 30)
    r = random.Random(9)
    words = sorted({"".join(r.choices("abc", k=r.randrange(1, 8))) for _ in range(300)})
    queries = words[::3]
    got = module.near_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(q, 1) for q in queries], "query string, most int"))
    assert {tuple(x) for x in got.collect()} == brute(words, queries, [1] * len(queries))
