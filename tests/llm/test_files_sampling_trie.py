"""Operators 11 to 13: round trips, brute force, awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.llm import importance, packing, prefix_trie, token_files

from ..conftest import SF
from .test_corpus import ODD, clashing, none

# --- 11 ---


@pytest.mark.parametrize("count", [0, 1, 3, 4, 5, 1000])
def test_codes_round_trip(count):
    rng = np.random.default_rng(count)
    ranks = (rng.integers(0, 2**32, count, dtype=np.uint64) >> rng.choice([0, 8, 16, 24, 31], count).astype(np.uint64)).astype("<u4")
    ranks[: min(count, 5)] = [255, 256, 65535, 65536, 2**32 - 1][:count]
    controls, data = token_files.encode(ranks)
    assert len(controls) == -(-count // 4) and len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
    assert (token_files.decode(controls, data, count) == ranks).all()


def test_codes_that_do_not_add_up_are_refused():
    controls, data = token_files.encode(np.arange(300))
    for bad in ((controls[:-1], data, 300), (controls, data[:-1], 300), (controls, data, 292)):
        with pytest.raises(ValueError):
            token_files.decode(*bad)


def brute_files(rows):
    from tokenizers import Tokenizer

    t, at, found = Tokenizer.from_file(packing.default_tokenizer()), 0, []
    ids = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in rows]
    for i, x in sorted(ids, key=lambda p: (p[0] is None, p[0] or 0, len(p[1]), zlib.crc32(p[1].tobytes()))):
        found.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    return sorted(found, key=lambda r: r[1])


def test_files_hold_the_tokenizers_ids(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in token_files.op11_token_files(spark, SF).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute_files(zip(docs["doc_id"], docs["text"]))


def test_files_of_odd_rows(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_ids(clashing(spark), path)
    got = token_files.read_ids(spark, path).collect()
    assert sorted([tuple(r)[:4] for r in got], key=lambda r: r[1]) == brute_files((r[0], r[1]) for r in ODD)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    ids = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()[0], "<u4")
    every = np.bincount(np.concatenate([r["ids"] for r in got]))
    assert sorted(ids) == sorted(np.nonzero(every)[0]) and (np.diff(every[ids]) <= 0).all()
    token_files.write_ids(none(spark), f"{path}-none")
    assert token_files.read_ids(spark, f"{path}-none").count() == 0


# --- 12 ---


def brute_sample(docs, target):
    def runs(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    own, want = [(i, *runs(t)) for i, t in docs], np.bincount([b for t in target for b in runs(t)[1]], minlength=10000)
    have = np.bincount([b for _, _, r in own for b in r], minlength=10000)
    s, t = float(have.sum()), float(want.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * (s + 10000) / ((int(a) + 1) * (t + 10000)))) for a, b in zip(have, want)]
    rows = []
    for i, n, r in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in r)
        rows.append((n, i, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[3], r[2]))
    drawn = [(*r[1:], k + 1) for k, r in enumerate(able[: 5 * len(able) // 100])]
    return sorted(drawn + [(*r[1:], None) for r in able[5 * len(able) // 100 :]] + [(*r[1:], None) for r in rows if r[0] < 20], key=repr)


def test_sample_equals_brute_force(spark):
    docs, target = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in importance.op12_importance(spark, SF).collect()), key=repr)
    assert got == brute_sample(list(zip(docs["doc_id"].tolist(), docs["text"])), list(target["text"]))


def test_sample_of_odd_rows(spark):
    texts = [*((r[0], r[1]) for r in ODD), (9, "one two THREE three\x7ffour 5five Über\x00end"), *((k, f"w{k} " * 25) for k in (20, 20, 21, 22, 23, 24, 25, 26, 27, 28, None)), *((k, "plain words only") for k in range(30, 60))]
    texts += [(None, "x " * 40)] * 9 + [(k, "y " * 30) for k in range(60, 80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("buckets", "n_words", "id", "score", "rank", "number", "words_of_text")))
    got = sorted((tuple(r) for r in importance.resample(docs, docs.limit(0)).collect()), key=repr)
    assert got == brute_sample(texts, []) and sum(r[4] is not None for r in got) == 2
    assert importance.resample(none(spark), none(spark)).count() == 0


def test_scoring_explodes_and_shuffles_nothing(spark):
    plan = importance.scored(spark.read.parquet(f"{SF}/documents.parquet"), [1] * 10000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan


# --- 13 ---

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(paths):
    """paths: {conv_id: [(role, text)]}."""
    members, below = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = below.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        own = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * own + sum(saved[k] for k in kids)
    ends = {node: ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(node)) for node, m in members.items()}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()
    )


def ordered(rows):
    """{conv_id: turns} as the operator orders them."""
    found = {}
    item = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, item(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(own)] for c, own in found.items()}


def rebuilt(found):
    out = {}
    for c, own in found.items():
        h, lead = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        out[c] = found.get(lead, [])[:h] + own[h:]
    return out


def of(df):
    return sorted(tuple(r) for r in df.collect())


def test_trie_of_odd_rows(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["hello  world", "", None, " a\tb c ", "日本語"])) for c in [*range(-45, 90), 2**40] for t in range(r.choice([1, 1, 2, 5]))]
    rows += [(5, None, "user", "x"), (5, None, "user", "y"), (5, 0, "user", "z"), (5, 0, "user", "z"), (None, 1, "user", "lost"), (7, 1, "user", "word " * 50000)]
    df = spark.createDataFrame(rows, TURNS).select("*", *(F.lit("x").alias(c) for c in ("item", "words", "number", "depth", "size", "node", "up", "n", "h")))
    assert of(prefix_trie.trie(*prefix_trie.with_shared_openings(prefix_trie.turns(df)))) == brute_trie(rebuilt(ordered(rows)))
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(*prefix_trie.with_shared_openings(prefix_trie.turns(empty))).count() == 0


def test_trie_of_long_and_nested_conversations(spark):
    """A conversation that blocks cut, its snapshots after every few turns, and many copies of one."""
    long = [("user", f"t{k}") for k in range(2300)]
    paths = {0: long, **{k: long[: k * 40] for k in range(1, 50)}, **{100 + k: [*long[: 20 * k], ("assistant", "left here")] for k in range(30)}, **{k: long[:3] for k in range(1000, 1400)}, 2000: []}
    turns = [(c, d + 1, hashlib.sha256(repr(t).encode()).digest(), len(t[1].split())) for c, p in paths.items() for d, t in enumerate(p)]
    found = prefix_trie.trie(spark.createDataFrame(turns, "conv_id long, depth long, item binary, words long"), spark.createDataFrame([(c,) for c in paths], "conv_id long"))
    assert of(found) == brute_trie(paths)


def test_texts_taken_together_look_each_word_up_once(monkeypatch):
    words, r, calls = packing.WordTokenizer(packing.default_tokenizer()), random.Random(5), []
    plain = words._word
    monkeypatch.setattr(words, "_word", lambda w: calls.append(w) or plain(w))
    monkeypatch.setattr(packing, "CHARS", 1 << 15)
    made = ["".join(r.choice("abé") for _ in range(8)) + r.choice(["", ",", "'s", "_x!", "²"]) for _ in range(500)]
    texts = ["", " ", "a  b ", "日本 x", "x\x0by", "<|endoftext|> a"] + [r.choice(" \t\n").join(r.choices(made, k=80)) for _ in range(400)]
    monkeypatch.setattr(packing, "CACHE", 0)  # nothing is remembered from one group of texts to the next
    got = words.encode_all(texts)
    assert got == [np.array(words.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    groups = -(-sum(map(len, texts)) // packing.CHARS)
    assert len(calls) <= (groups + 1) * (len(set(made)) + 10) < 400 * 80 / 3
    assert words.encode_all([]) == [] and words.encode_all(["", "日"]) == [b"", words.encode("日")]
