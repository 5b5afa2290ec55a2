"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, bigrams and one-skip bigrams of a text; each coordinate has its own learning
rate and an L1 penalty that leaves most weights at zero, so the weights are a small table that every task can hold.
They are added to the log-odds of the labelled rows' share of toxic ones, which is thus the score of a text that tells
nothing; without labels the share is taken as a quarter, so that nothing is called toxic for want of evidence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, stage, table, unstage

WORD = re.compile(r"\w+")
#: Words hashed at a time, so that a text of any length needs bounded memory besides its features.
CHUNK = 1 << 17
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Params:
    """bits: 2**bits coordinates. toxic and clean bound the training rows of either label, coordinates what they hold in
    all (64 MB); epochs passes over them. weight multiplies the gradient of toxic rows."""

    bits: int = 18
    toxic: int = 2000
    clean: int = 6000
    coordinates: int = 1 << 24
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    weight: float = 3.0


@dataclass(frozen=True)
class Model:
    """Coordinates with their weights, none zero, and the log-odds that they are added to."""

    coordinates: np.ndarray
    weights: np.ndarray
    base: float


_codes: dict[str, int] = {}


def _code(word: str) -> int:
    if len(_codes) > 150_000:
        _codes.clear()
    code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return _codes.setdefault(word, code) if len(word) <= 64 else code  # long words would fill the worker


def features(text: str | None, bits: int) -> np.ndarray:
    """Sorted distinct coordinates of a text; null and wordless texts have none."""
    words, known = WORD.findall((text or "").lower()), _codes
    parts = []
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK + 2]
        try:
            codes = [known[w] for w in part]
        except KeyError:
            codes = [_code(w) for w in part]
        h = np.array(codes, np.uint64) * A
        h ^= h >> np.uint64(29)
        grams = [h[:CHUNK], (h[:-1] * B + h[1:])[:CHUNK], (h[:-2] * B + h[2:] + A)[:CHUNK]]
        parts.append(np.unique((np.concatenate(grams) * B >> np.uint64(64 - bits)).astype(np.int32)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def scale(n: int) -> float:
    """Features weigh less in texts that have more of them."""
    return 1 / np.sqrt(1 + np.log1p(n))


def base_odds(toxic: int, clean: int) -> float:
    """Log-odds of the share of toxic rows, as if one toxic and three clean rows had been seen before."""
    return math.log((toxic + 1) / (clean + 3))


def fit(rows: list[tuple[np.ndarray, int]], base: float, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero. rows in training order."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i, y in rows:
            s, w = scale(len(i)), weights(i)
            g = (sigmoid(base + s * w.sum()) - y) * s * (p.weight if y else 1.0)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    keep = np.nonzero(w)[0].astype(np.int32)
    return keep, w[keep]


def is_held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls into the fold. A null id is in no fold but is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit on at most p.toxic and p.clean labelled rows of either class, those of the smallest hashes of their ids, and no
    more of them than hold p.coordinates in all. One task trains; the driver sees ids and the weights.

    Rows that are held out or lack an id or a label are never read; a document with two labels counts as toxic.
    """
    spark = docs.sparkSession
    own = labels.filter(~is_held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    own = own.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    counts = dict(map(tuple, own.groupBy("y").count().collect()))
    base = base_odds(counts.get(1, 0), counts.get(0, 0))
    picked = [r for y, most in ((0, p.clean), (1, p.toxic)) for r in own.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    few = F.broadcast(spark.createDataFrame(picked, "id long, y int"))  # at most p.clean + p.toxic rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                found = [features(t.as_py(), p.bits) for t in b.column(2)[at : at + 64]]
                kept = [c.slice(at, 64) for c in b.columns[:2]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x.tobytes() for x in found], pa.binary())], ["id", "y", "x"])

    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(few, "id").select("id", "y", "text")
    rows = stage(found.mapInArrow(extract, "id long, y int, x binary"), "features")
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("x")]
    upto = F.sum(F.length("x") / 4).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    bounded = rows.withColumn("upto", upto).filter(F.col("upto") <= p.coordinates)  # one window over at most p.clean + p.toxic rows

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.frombuffer(x.as_py(), np.int32), y) for b in batches for y, x in zip(b.column(0).to_pylist(), b.column(1))]
        made = fit(seen, base, p)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in made], ["at", "weight"])

    made = bounded.repartition(1).sortWithinPartitions(*order).select("y", "x").mapInArrow(learn, "at int, weight double").toArrow()
    unstage(rows)
    return Model(made.column("at").to_numpy(), made.column("weight").to_numpy(), base)


def score(docs: DataFrame, model: Model, p: Params = Params(), text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column score, or of another name, in 0 to 1. Null and wordless texts get the labels' share of toxic
    ones; the model is at most 12 bytes x 2**bits. Works on whole texts; other columns pass through (an old score is
    replaced)."""
    rest = docs.drop(name)
    schema = rest.select("*", F.lit(0.0).alias(name)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, base = np.zeros(1 << p.bits), sent.value.base
        w[sent.value.coordinates] = sent.value.weights
        for b in batches:
            found = (features(t.as_py(), p.bits) for t in b.column(at))
            made = pa.array([float(sigmoid(base + scale(len(x)) * w[x].sum())) for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, name])

    return rest.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under 0.5; columns of any name pass through.

    Null, empty and wordless texts score the labels' share of toxic rows, so they stay unless most labels are toxic; with
    no labels, or none of toxic rows, every row stays. Repeated rows share their score; no rows give none.
    """
    name = free_name(docs, "score")
    return score(docs, train(docs, labels), name=name).filter(F.col(name) < 0.5).drop(name)
