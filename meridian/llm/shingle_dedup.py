"""Near-dedup by exact Jaccard similarity of five-word shingles, on top of the SimHash operator.

Candidates come from two sides: links of the vantage-point tree over five-word fingerprints, and texts that share a band of
MinHashes, for at a similarity of 0.8 fingerprints differ in up to 14 bits, a radius within which a tree prunes nothing.
In a band each text is joined to its bucket's smallest, so there are at most BANDS edges a text and never a bucket's
pairs. Components of all these edges hold both ends of every candidate pair. Within one, sets of shingles are compared
exactly, in pairs of bounded blocks that return spanning forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import attach, components, first_row, one_of_each, row_key, stage, topped, unstage
from .simhash_dedup import Forest, bits_of, shingle_hashes

#: Words of a shingle. Linked sets share at least 4 of 5 of their union.
WIDTH = 5
#: A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS: 3e-7 at 0.8, 2e-19 at 0.9.
BANDS, ROWS = 64, 7
#: Shingles that a block of a component holds on average; shingles that are hashed at a time.
BLOCK, PIECE = 1 << 21, 256
_odd = np.random.default_rng(42).integers(0, 1 << 31, (2, BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str | None) -> tuple[np.ndarray, int]:
    """The sorted distinct hashes of a text's shingles and its fingerprint; a null or blank text has none, and 0."""
    pieces = list(shingle_hashes(text, WIDTH))
    return np.unique(np.concatenate([np.empty(0, "<u8"), *pieces])), bits_of(pieces)


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.tobytes())


def bands(found: np.ndarray) -> list[int]:
    """A signed long for each band of MinHashes; none for an empty set."""
    if not len(found):
        return []
    least, low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), PIECE):
        least = np.minimum(least, (low[at : at + PIECE] * _odd[0] + _odd[1]).min(1))
    hashed = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(hashed, np.uint64).view(np.int64).tolist()


def link_sets(sets: list[np.ndarray]) -> np.ndarray:
    """The root of each set under links of similarity 0.8 or more; a set is compared with all others at once, until those
    not yet compared are all in one component."""
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts, left = np.cumsum(sizes) - sizes, np.ones(len(sets), bool)
    while True:
        rest = np.flatnonzero(left)
        roots = forest.roots()[rest]
        of, count = np.unique(roots, return_counts=True)
        if len(of) < 2:
            return forest.roots()
        i = rest[np.argmax(roots == of[count.argmin()])]
        has = np.zeros(len(words), bool)
        has[at[starts[i] : starts[i] + sizes[i]]] = True
        common = np.add.reduceat(has[at].astype(np.int64), starts)
        same = np.flatnonzero(9 * common >= 4 * (sizes + sizes[i]))
        forest.link(np.full(len(same), i), same)
        left[i] = False


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [(digest(s), len(s), np.uint64(fp).view(np.int64), bands(s)) for s, fp in map(shingles, b.column(2).to_pylist())]
        cols = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["id", "key", "set", "size", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 500):
            made = [shingles(t)[0] for t in b.column(1)[at : at + 500].to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 500], pa.array([s.tobytes() for s in made], pa.binary())], ["key", "grams"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, lo, hi, cid, grams) in order: a spanning forest (a, b) of each group's links."""
    held, cids, sets = None, [], []

    def forest() -> pa.RecordBatch:
        up, cid = link_sets(sets), np.array(cids, np.int64)
        new = up != np.arange(len(up))
        return pa.RecordBatch.from_arrays([pa.array(cid[new]), pa.array(cid[up[new]])], ["a", "b"])

    for b in batches:
        for *key, cid, grams in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
            if key != held:
                if len(cids) > 1:
                    yield forest()
                held, cids, sets = key, [], []
            cids.append(cid)
            sets.append(np.frombuffer(grams.as_py(), "<u8"))
    if len(cids) > 1:
        yield forest()


def candidates(classes: DataFrame) -> DataFrame:
    """(node, root) of the classes (cid, fp, bands) that a band or the tree joins with another, root by root."""
    same = F.array_append("bands", F.xxhash64("fp"))  # equal fingerprints are one band more
    dealt = classes.select("cid", F.explode(same).alias("band"))
    least = stage(dealt.groupBy("band").agg(F.min("cid").alias("least"), F.count("*").alias("n")).filter("n > 1"), "bands")
    total = least.agg(F.sum("n")).first()[0] or 0
    pairs = attach(dealt, least, "band", "n", total).filter("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    points = stage(classes.groupBy("fp").agg(F.min("cid").alias("cid")), "points")
    near = simhash_dedup.links(points, points.count())
    pairs = stage(pairs.distinct().unionByName(near), "pairs")
    unstage(least, near, points)
    found = components(pairs)
    out = stage(found, "candidates")
    unstage(found)
    return out


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), stored: a spanning forest of the links between classes (set, first, cid, size, fp, bands); docs are (key, text)."""
    found = candidates(classes)
    members = stage(classes.select("first.key", "cid", "size").join(found.withColumnRenamed("node", "cid"), "cid"), "members")
    groups = stage(members.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / BLOCK).alias("blocks")), "groups")
    sets = docs.join(members.select("key"), "key", "left_semi").mapInArrow(_sets, "key string, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))
    dealt = attach(members, groups, "root", "n", members.count()).join(sets, "key").withColumn("lo", F.pmod(F.xxhash64("cid"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("lo", "other").alias("lo"), F.greatest("lo", "other").alias("hi"), "cid", "grams")
    group = ["root", "lo", "hi"]
    out = stage(dealt.repartition(*group).sortWithinPartitions(*group, "cid").mapInArrow(_connect, "a long, b long"), "forest")
    unstage(found, members, groups)
    return out


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, set), and classes (set, n, top) of which top is the first row of its group."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    prints = stage(own.mapInArrow(_profile, "id long, key string, set binary, size long, fp long, bands array<long>"), "prints")
    classes = prints.groupBy("set").agg(first_row().alias("first"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "fp", "bands")))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    named = topped(classes.select("set", "n", "first", "cid"), links(own.select("key", "text"), classes))
    unstage(classes)
    return prints.select("id", "key", "set"), named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for each row of docs; component_id is the smallest id that links reach.

    Null and blank texts are one class, as are texts of equal shingles; a row with a null id is linked but never names a
    component (its component_id is null if only such rows are linked). Repeated rows stay; no rows give none.
    """
    prints, named = _named(docs, id_col, text_col)
    return attach(prints, named, "set", "n", prints.count()).select(F.col("id").alias(id_col), F.col("top.id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays, as simhash_dedup.keep_first has it."""
    return one_of_each(docs, _named(docs, "doc_id", "text")[1].select("top.key").distinct())
