"""Odd digits, extreme norms, long words, names in other cases, ties of rules."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from meridian.llm import embedding_dedup, mixing, packing, pii, toxicity, url_filter

from .test_corpus import clashing, odd


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_digits_of_every_kind_crash_nothing(field):
    kinds = [c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and len({c.isdigit(), c.isdecimal(), c.isalnum()}) > 1 and not c.isalpha()]
    assert "²" in kinds and "①" in kinds
    for c in kinds:
        for text in (f"version 1{c}.2.3.4 released", f"ver {c}.2.3.4", f"call +1 {c}69 555-3296", f"a{c} at b dot c"):
            pii.find(text, field)
    base, spans = pii.find("① 10.2.3.4 and 1².2.3.4", field)
    assert ("ip", 2, 10) in base


def test_random_unicode_crashes_nothing(field):
    r = random.Random(5)
    pool = "0123456789.@+-() at dot²①٣५Ⅷ½​\n" + "".join(chr(r.randrange(0x20, 0x2FFF)) for _ in range(200))
    for _ in range(10000):
        pii.find("".join(r.choices(pool, k=30)), field)


def test_extreme_norms_link(spark):
    rows = [(1, [1e-151, 0.0]), (2, [1e-151, 0.0]), (3, [5e-324, 0.0]), (4, [1e200, 1e199]), (5, [1e308, 0.0]), (6, [0.0, 1e-200]), (7, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (1, 6), 7: (1, 6)}


def test_long_words_are_not_remembered():
    words = packing.tokenizer(packing.default_tokenizer())
    text = "short " + "y" * 100_000
    assert words.encode(text) == words.encode(text) and max(map(len, words.known)) <= packing.LETTERS
    toxicity.features(text, 18)
    assert max(map(len, toxicity._codes)) <= 64


def test_mix_takes_names_in_any_case(spark):
    docs = clashing(spark).drop("domain", "epoch").withColumns({"Domain": F.lit("x"), "EPOCH": F.lit("y"), "_row": F.lit("r"), "taken": F.lit("t"), "_taken": F.lit("u")})
    args = mixing.domain(), F.sum("tokens"), mixing.weights(), 2
    got, plain = mixing.mix(docs, *args), mixing.mix(odd(spark), *args)
    assert {"_row", "row", "taken", "_taken", "domain", "tokens", "epoch"} <= set(got.columns) and "Domain" not in got.columns
    slim = lambda df: sorted(map(str, df.select("doc_id", "text", "domain", "epoch").collect()))
    assert slim(got) == slim(plain) and {r[0] for r in got.select("taken").collect()} == {"t"}


def test_of_rules_of_one_length_the_first_wins(spark):
    rules = (("allow", "b.org", "/"), ("block", "org", "/ab"), ("block", "b.org", "/"))
    got = spark.range(1).select(url_filter.rule(F.lit("a.b.org"), F.lit("/abc"), rules).alias("r")).first()["r"]
    assert tuple(got) == ("b.org/", "allow")
