"""SimHash near-dedup: fingerprints are partitioned by a vantage-point tree and linked shard by shard.

A vantage point and a radius split a set of fingerprints by Hamming distance. A fingerprint whose distance is at
most the radius plus the link distance also goes inside, so by the triangle inequality both ends of every link
meet in at least one shard. Within a shard the same splitting goes on until a block is small enough to compare.
A shard returns a spanning forest of its links, never its pairs; components of the forests' edges are the groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, first_row, one_of_each, row_key, stage, table, topped, unstage

SEED = 42
#: Bits in which two linked fingerprints may differ.
LINK_BITS = 2
#: Distinct fingerprints that a shard is to hold before replication, which each level of the tree multiplies by about 1.2:
#: at most SHARD_ROWS (4 MB with ids), fewer, down to LEAST_ROWS, while there are cores that have none.
SHARD_ROWS, LEAST_ROWS, MAX_SHARDS = 1 << 18, 1 << 13, 1 << 16
#: A shard of more routed rows is dealt into blocks, and its pairs of blocks are linked apart.
SPLIT_ROWS = 1 << 20
#: Fingerprints of the sample for each shard; the sample that the driver sees has at most MAX_SHARDS times as many.
SAMPLE_PER_SHARD = 32
#: Blocks of at most this many fingerprints are compared directly.
BLOCK = 512
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's shingles of width words in order, in pieces of bounded size; none of a null or blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    n = max(1, len(words) - width + 1)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, n, CHUNK):
        yield np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], "<u8")


def bits_of(pieces: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of hashes that come in pieces; 0 of none."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in pieces:
        n += len(h)
        h = np.concatenate((h, np.zeros(-len(h) % 128, "<u8")))
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 128, 64)
        ones += bits.sum(1, dtype=np.uint8).sum(0, dtype=np.int64)  # at most 128 of a byte's 255
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over shingles of width words; a null or blank text has 0. Bounded memory for any length."""
    return bits_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, key, fp): row_key() and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["id", "key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col)).mapInArrow(run, "id long, key string, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose_split(points: np.ndarray, bits: int, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point and radius with the least replication among splits that leave 0.3 to 0.7 inside."""
    best = None
    for v in points[:: max(1, len(points) // tries)][:tries]:
        within = np.cumsum(np.bincount(distance(points, v), minlength=65)[:65])
        for radius in range(64):
            inside, both = within[radius], within[min(64, radius + bits)]
            if 0.3 <= inside / len(points) <= 0.7 and (best is None or both - inside < best[0]):
                best = both - inside, v, radius
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int, bits: int) -> tuple:
    """Nested (vantage, radius, inside, outside), a leaf is (). Depth follows the wanted number of shards."""
    if shards < 2 or len(sample) < 2 * SAMPLE_PER_SHARD // 4 or not (split := choose_split(sample, bits)):
        return ()
    near = distance(sample, split[0])
    inside, outside = sample[near <= split[1]], sample[near > split[1]]
    part = max(1, min(shards - 1, round(shards * len(inside) / len(sample))))
    return (*split, build_tree(inside, part, bits), build_tree(outside, shards - part, bits))


def route(tree: tuple, fps: np.ndarray, rows: np.ndarray, bits: int, first: int = 0) -> tuple[list[tuple[int, np.ndarray]], int]:
    """(leaf, rows that go there) of every leaf, and the number of leaves."""
    if not tree:
        return [(first, rows)], 1
    vantage, radius, inside, outside = tree
    near = distance(fps[rows], vantage)
    a, n = route(inside, fps, rows[near <= radius + bits], bits, first)
    b, m = route(outside, fps, rows[near > radius], bits, first + n)
    return a + b, n + m


class Forest:
    """Union-find over rows; roots are the smallest row."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while (self.up != (flat := self.up[self.up])).any():
            self.up = flat
        return self.up


def link_block(fps: np.ndarray, rows: np.ndarray, bits: int, forest: Forest) -> None:
    for at in range(0, len(rows), BLOCK):
        own = rows[at : at + BLOCK]
        for other in range(at, len(rows), BLOCK):
            i, j = np.nonzero(distance(fps[own][:, None], fps[rows[other : other + BLOCK]][None, :]) <= bits)
            left, right = own[i], rows[other + j]
            new = forest.up[left] != forest.up[right]
            forest.link(left[new], right[new])


def link_all(fps: np.ndarray, rows: np.ndarray, bits: int, forest: Forest) -> None:
    """Splitting goes on with local vantage points; a set that no point splits (a tight group) is compared in blocks."""
    split = choose_split(fps[rows][:: max(1, len(rows) // 2048)], bits) if len(rows) > BLOCK else None
    near = split and distance(fps[rows], split[0])
    if not split or (near <= split[1] + bits).mean() > 0.9 or (near > split[1]).mean() > 0.9:
        return link_block(fps, rows, bits, forest)
    link_all(fps, rows[near <= split[1] + bits], bits, forest)
    link_all(fps, rows[near > split[1]], bits, forest)


def shard_count(total: int, cores: int) -> int:
    return max(1, min(MAX_SHARDS, max(-(-total // SHARD_ROWS), min(-(-total // LEAST_ROWS), cores))))


def links(classes: DataFrame, total: int, bits: int = LINK_BITS) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints (cid, fp), shard by shard."""
    spark = classes.sparkSession
    shards = shard_count(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    want = SAMPLE_PER_SHARD * shards
    some = classes if total <= want else classes.filter(F.pmod(F.xxhash64("fp"), F.lit(total)) < 2 * want)
    sample = some.select("fp").orderBy(F.xxhash64("fp")).limit(want).toArrow().column(0).to_numpy().view(np.uint64)  # 16 MB at most
    tree = spark.sparkContext.broadcast(build_tree(sample, shards, bits))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            found = route(tree.value, fp.view(np.uint64), np.arange(len(fp)), bits)[0]
            leaf = np.repeat(np.array([k for k, _ in found], np.int32), [len(rows) for _, rows in found])
            rows = np.concatenate([rows for _, rows in found])
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(cid[rows]), pa.array(fp[rows])], ["shard", "cid", "fp"])

    def connect(group: pa.Table) -> pa.Table:
        cid, fps = group.column("cid").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(cid, kind="stable")
        fps, cid, forest = fps[order], cid[order], Forest(len(cid))
        link_all(fps, np.arange(len(cid)), bits, forest)
        up = forest.roots()
        new = up != np.arange(len(up))
        return pa.table({"a": cid[new], "b": cid[up[new]]})

    routed = stage(classes.select("cid", "fp").mapInArrow(assign, "shard int, cid long, fp long"), "routed")
    sizes = routed.groupBy("shard").agg(F.ceil(F.count("*") / SPLIT_ROWS).cast("int").alias("blocks")).filter("blocks > 1")  # a row for each big shard
    blocks = F.coalesce("blocks", F.lit(1))
    at = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    dealt = routed.join(F.broadcast(sizes), "shard", "left").withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("shard", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "cid", "fp")
    return dealt.groupBy("shard", "i", "j").applyInArrow(connect, "a long, b long")


def _named(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, fp), and classes (fp, n, top) of which top is the first row of its group."""
    prints = stage(fingerprints(docs, id_col, text_col, width), "prints")
    classes = stage(prints.groupBy("fp").agg(first_row().alias("first"), F.count("*").alias("n")).withColumn("cid", F.col("fp")), "classes")
    found = links(classes, classes.count(), bits)
    named = topped(classes, stage(found, "forest"))
    unstage(found, classes)
    return prints, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = LINK_BITS) -> DataFrame:
    """(id, fp, component_id) for each row of docs; component_id is the smallest id that links reach.

    Null and blank texts have fingerprint zero and link like any other; a row with a null id is linked but never
    names a component (its component_id is null if only such rows are linked). Repeated rows stay. Empty input
    gives no rows. Other columns are not read.
    """
    prints, named = _named(docs, id_col, text_col, width, bits)
    return attach(prints, named, "fp", "n", prints.count()).select(F.col("id").alias(id_col), "fp", F.col("top.id").alias("component_id"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 3, bits: int = LINK_BITS) -> DataFrame:
    """One row of each group of near copies stays: the smallest id's, null ids last, and of one id the smallest key's.

    Rows of one id and different texts are told apart; columns of any name pass through; no rows give none.
    """
    prints, named = _named(docs, "doc_id", "text", width, bits)
    return one_of_each(docs, named.select("top.key").distinct())
