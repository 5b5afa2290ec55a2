"""Embedding near-dedup: an exact range join under the Euclidean metric of the unit sphere.

cos(x, y) >= c says |x - y| <= r with r = sqrt(2 - 2c). Every vector's home is the cell of its nearest pivot. Vectors
are written once, in blocks of one home each, and blocks meet block by block as Spark's product of the files: nothing
is copied to the cells that it may link with, so what is written grows with the rows even where no bound holds (vectors
without clusters), and only time grows with their square. Homes i and j do not meet if |p_i - p_j| > R_i + R_j + r (R:
a home's radius); where blocks meet, y of home j is left out unless |y - p_i| <= R_i + r and |y - p_i| - |y - p_j| <= 2r.
Equal vectors are joined once, as a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import attach, stage, table, topped, unstage
from .simhash_dedup import Forest

#: Classes wanted in a cell, and the most pivots. Pivots come from a sample of at most PIVOT_SAMPLE vectors.
CELL_ROWS, MAX_PIVOTS, PIVOT_SAMPLE = 4096, 4096, 16384
#: A block has at most so many classes and so many bytes of vectors; a task of the product holds two.
BLOCK, BLOCK_BYTES = 4096, 1 << 22
#: Bytes of vectors in a file of blocks; a smaller table is written as up to FILES files, so that pairs of them are many tasks.
FILE_BYTES, FILES = 1 << 24, 16
#: Slack of the float32 prefilter; what lies within it of the bound is decided in double precision.
SLACK = 1e-4
#: Slack of the bounds on distances, which come from products of unit vectors.
NEAR = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal: pivots lie as far apart as the sample allows."""
    picked, near = [0], gaps(sample, sample[:1])[:, 0]
    while len(picked) < count and near.max() > 1e-6:
        picked.append(int(near.argmax()))
        near = np.minimum(near, gaps(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def homes(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each unit vector, and its distance; equal vectors have one home whatever stands beside them, as
    a product of matrices may round a row differently in another place."""
    home, far = np.zeros(len(x), np.int32), np.zeros(len(x))
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        like = part @ pivots.T
        i, k = np.nonzero(like >= like.max(1, keepdims=True) - 1e-12)
        size = np.sqrt(((part[i] - pivots[k]) ** 2).sum(1))
        order = np.lexsort((k, size, i))
        order = order[np.unique(i[order], return_index=True)[1]]
        home[at : at + 1024], far[at : at + 1024] = k[order], size[order]
    return home, far


def linked_pairs(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) with cosine at least least, by double arithmetic on the vectors x and y as given wherever their float32
    unit vectors ux and uy leave a doubt."""
    like = (ux @ uy.T).ravel()
    found = np.flatnonzero(like >= np.float32(least - SLACK))
    i, j = np.divmod(found, len(uy))
    keep = like[found] > np.float32(least + SLACK)
    doubt = np.flatnonzero(~keep)
    for at in range(0, len(doubt), 1 << 16):
        some = doubt[at : at + (1 << 16)]
        a, b = x[i[some]].astype(np.float64), y[j[some]].astype(np.float64)
        keep[some] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= least
    return i[keep], j[keep]


def _binary(data: bytes, width: int) -> pa.Array:
    """Values of width bytes each."""
    count = len(data) // width
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(np.arange(count + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(data)])


def _coded(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec) to (id, dim, key, vec): vec as bytes, key its digest; both null for vectors that link with nothing."""
    for b in batches:
        column = b.column("vec")
        size = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros((), kind)  # -0.0 is 0.0
        end = np.cumsum(size)
        counted = lambda test: np.concatenate(([0], np.cumsum(test)))  # noqa: E731, B023
        bad, some = counted(~np.isfinite(values)), counted(values != 0)
        ok = (bad[end] == bad[end - size]) & (some[end] > some[end - size])  # noqa: B023
        keys, vecs = [None] * len(b), [None] * len(b)
        for dim in np.unique(size[ok]):
            rows = np.flatnonzero(ok & (size == dim))
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                x = values[(end - size)[part][:, None] + np.arange(dim)]
                with np.errstate(over="ignore"):
                    norm = (x.astype(np.float64) ** 2).sum(1)
                odd = (norm < 1e-250) | (norm > 1e250)  # products must neither overflow nor vanish
                x[odd] = x[odd] / np.abs(x[odd]).max(1, keepdims=True) + 0.0
                for k, row in zip(part.tolist(), x):
                    vecs[k] = row.tobytes()
                    keys[k] = blake2b(vecs[k], digest_size=16).digest()
        dims = pa.array(size.astype(np.int32), mask=~ok)
        yield pa.RecordBatch.from_arrays([b.column("id"), dims, pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "dim", "key", "vec"])


def _merged(rows: pa.Table) -> pa.Table:
    """Rows of one key as one: the least id that is not null, the sum of n; in the order of their first."""
    if pc.count_distinct(rows.column("key")).as_py() == len(rows):
        return rows
    own = rows.append_column("row", pa.array(np.arange(len(rows))))
    got = own.group_by("key", use_threads=False).aggregate([("row", "min"), ("first", "min"), ("n", "sum")]).sort_by("row_min")
    one = rows.take(got.column("row_min"))
    for name in ("first", "n"):
        one = one.set_column(one.schema.get_field_index(name), name, got.column(f"{name}_{'min' if name == 'first' else 'sum'}"))
    return one


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    n_links counts the other rows with cosine >= least, component_id is the smallest id that links reach, itself
    included. A vector that is null, empty, zero or holds null or non-finite numbers links with nothing; nor do
    vectors of different lengths. Very small and very large vectors are scaled by their largest component first. Repeated rows and equal vectors link with each other. A null id is counted in
    others' n_links but its own component_id is its class's. Empty input gives no rows; other columns are not read.
    """
    spark, held = vectors.sparkSession, vectors.schema[vec_col].dataType
    kind = "float" if isinstance(held, ArrayType) and isinstance(held.elementType, FloatType) else "double"
    typed = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    code = {"float": "<f4", "double": "<f8"}[kind]
    base = stage(typed.mapInArrow(lambda batches: _coded(code, batches), "id long, dim int, key binary, vec binary"), "vectors")
    good = base.filter("key IS NOT NULL")
    none = spark.createDataFrame([], "a long, b long, links long")
    parts, known = [], [spark.createDataFrame([], "key binary, cid long, first struct<none:boolean,id:long>, n long")]
    for dim, total in sorted(map(tuple, good.select("dim", "key").distinct().groupBy("dim").count().collect())):
        blocks, homes_ = _blocks(good.filter(F.col("dim") == dim).select("id", "key", "vec"), dim, total, code, len(parts))
        parts.append(stage(_join(blocks, homes_, dim, code, least), "found"))
        known.append(stage(_classes(blocks), "classes"))
        unstage(blocks)
    classes = reduce(DataFrame.unionByName, known)
    found = reduce(DataFrame.unionByName, parts, none)
    extra = stage(found.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links")), "extra")
    named = topped(classes, found.filter("b IS NOT NULL").select("a", "b"))
    answer = named.join(extra, "cid", "left").select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("top.id").alias("component_id"))
    known = stage(answer, "known")
    unstage(named, classes, extra)
    rows = attach(good.select("id", "key"), known, "key", "n", base.count()).select("id", "n_links", "component_id")
    alone = base.filter("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return rows.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _blocks(rows: DataFrame, dim: int, total: int, code: str, turn: int) -> tuple[DataFrame, np.ndarray]:
    """Staged blocks (start, home, radius, keys, firsts, ns, vecs) of rows (id, key, vec) of total classes, and the pivots.

    A block's classes are of one home and are numbered from start; turn tells the numbers of one length from another's.
    """
    spark = rows.sparkSession
    cells = max(1, min(MAX_PIVOTS, -(-total // CELL_ROWS)))
    want = min(PIVOT_SAMPLE, 64 * cells)
    some = rows if total <= want else rows.filter(F.pmod(F.xxhash64("key"), F.lit(total)) < 2 * want)
    some = some.dropDuplicates(["key"]).orderBy(F.xxhash64("key")).limit(want).select("vec").collect()
    chosen = choose_pivots(unit(np.array([np.frombuffer(r[0], code) for r in some], np.float64)), cells)
    pivots = spark.sparkContext.broadcast(chosen)
    width = dim * np.dtype(code).itemsize
    most, size = max(1, min(BLOCK, BLOCK_BYTES // width)), total * (width + 40)
    files = min(1 << 16, max(-(-size // FILE_BYTES), min(FILES, -(-size // (1 << 20)))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = _merged(pa.table([b.column("key"), b.column("id"), pa.array(np.ones(len(b), np.int64)), b.column("vec")], ["key", "first", "n", "vec"])).combine_chunks()
            x = np.frombuffer(b"".join(one.column("vec").to_pylist()), code).reshape(-1, dim).astype(np.float64)
            home, far = homes(unit(x), pivots.value)
            yield from one.append_column("home", pa.array(home)).append_column("far", pa.array(far)).to_batches()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = (turn << 48) + (TaskContext.get().partitionId() << 32), None

        def block(part: pa.Table) -> pa.RecordBatch:
            nonlocal at
            row = {
                "start": [at], "home": [part.column("home")[0].as_py()], "radius": [pc.max(part.column("far")).as_py()], "keys": [b"".join(part.column("key").to_pylist())],
                "firsts": [part.column("first").to_pylist()], "ns": [part.column("n").to_numpy().astype("<i8").tobytes()], "vecs": [b"".join(part.column("vec").to_pylist())],
            }
            at += len(part)
            return pa.RecordBatch.from_pydict(row, BLOCKS)

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            held = _merged(held)
            home = held.column("home").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
            cuts = [c for lo, hi in zip(cuts, cuts[1:]) for c in range(lo, hi, most)]
            # the last piece waits for what follows, which may hold more of its last key
            for lo, hi in zip(cuts, cuts[1:]):
                yield block(held.slice(lo, hi - lo))
            held = held.slice(cuts[-1])
        if held is not None:
            yield block(held)

    shape = "key binary, first long, n long, vec binary, home int, far double"
    dealt = rows.mapInArrow(placed, shape).repartitionByRange(files, "home", "key").sortWithinPartitions("home", "key")
    return stage(dealt.mapInArrow(packed, "start long, home int, radius double, keys binary, firsts array<long>, ns binary, vecs binary"), "blocks"), chosen


BLOCKS = pa.schema([("start", pa.int64()), ("home", pa.int32()), ("radius", pa.float64()), ("keys", pa.binary()), ("firsts", pa.list_(pa.int64())), ("ns", pa.binary()), ("vecs", pa.binary())])


def _classes(blocks: DataFrame) -> DataFrame:
    """(key, cid, first, n) of the classes in blocks; vectors are not read."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, keys, firsts, ns in zip(*(b.column(c).to_pylist() if c != "firsts" else b.column(c) for c in ("start", "keys", "firsts", "ns"))):
                n = np.frombuffer(ns, "<i8")
                yield pa.RecordBatch.from_arrays([_binary(keys, 16), pa.array(start + np.arange(len(n))), pa.array(firsts.as_py(), pa.int64()), pa.array(n)], ["key", "cid", "id", "n"])

    rows = blocks.select("start", "keys", "firsts", "ns").mapInArrow(apart, "key binary, cid long, id long, n long")
    return rows.select("key", "cid", F.struct(F.col("id").isNull().alias("none"), "id").alias("first"), "n")


def _join(blocks: DataFrame, chosen: np.ndarray, dim: int, code: str, least: float) -> DataFrame:
    """(a, b, links): forest edges (links null), and for a class the rows linked with it (b null), a row for each pair of blocks."""
    spark, r = blocks.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * least))) + NEAR
    radius = np.full(len(chosen), -np.inf)
    for home, far in blocks.groupBy("home").agg(F.max("radius")).collect():
        radius[home] = far + NEAR
    meets = gaps(chosen, chosen) <= radius[:, None] + radius[None, :] + r
    pivots, radii = spark.sparkContext.broadcast(chosen), spark.sparkContext.broadcast(radius)
    left = blocks.select("start", "home", "ns", "vecs")
    right = blocks.select(*(F.col(c).alias(f"{c}_") for c in ("start", "home", "ns", "vecs")))
    near = F.col("start_") >= F.col("start")
    used = np.flatnonzero(radius >= 0)
    if not meets[np.ix_(used, used)].all():
        few = spark.createDataFrame([(int(h), np.flatnonzero(meets[h]).tolist()) for h in used], "home int, meets array<int>")
        left = left.join(F.broadcast(few), "home")  # a row for each home, at most MAX_PIVOTS
        near &= F.array_contains("meets", F.col("home_"))
    pairs = left.crossJoin(right).filter(near).select("start", "home", "ns", "vecs", "start_", "home_", "ns_", "vecs_")

    def side(b: pa.RecordBatch, k: int, end: str) -> tuple:
        x = np.frombuffer(b.column("vecs" + end)[k].as_buffer(), code).reshape(-1, dim)
        u = unit(x.astype(np.float64))
        return b.column("start" + end)[k].as_py(), b.column("home" + end)[k].as_py(), np.frombuffer(b.column("ns" + end)[k].as_buffer(), "<i8"), x, u, u.astype(np.float32)

    def reach(u: np.ndarray, own: int, other: int) -> np.ndarray:
        """Rows of home own that may link with a row of home other."""
        far, near = gaps(u, pivots.value[[other, own]]).T
        between = float(np.sqrt(((pivots.value[own] - pivots.value[other]) ** 2).sum()))
        # the last test: how far a row lies behind the plane between the two pivots
        return np.flatnonzero((far <= radii.value[other] + r) & (far - near <= 2 * r + NEAR) & (far**2 - near**2 <= 2 * r * between + NEAR))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None,)
        for b in batches:
            for k in range(len(b)):
                if b.column("start")[k].as_py() != last[0]:
                    last = side(b, k, "")
                at, home, n, x, u, ux = last
                same = b.column("start_")[k].as_py() == at
                at_, home_, n_, y, v, uy = last if same else side(b, k, "_")
                size = len(x) + (0 if same else len(y))
                i = np.arange(len(x)) if home == home_ else reach(u, home, home_)
                j = np.arange(len(y)) if home == home_ else reach(v, home_, home)
                links, forest = np.zeros(size), Forest(size)
                for lo in range(0, len(i), 256) if len(j) else ():
                    part = i[lo : lo + 256]
                    own = j[lo:] if same else j  # one block with itself: each pair once
                    p, q = linked_pairs(x[part], y[own], ux[part], uy[own], least)
                    p, q = part[p], own[q]
                    if same:
                        p, q = p[p < q], q[p < q]
                    if not len(p):
                        continue
                    a, c = p, q if same else q + len(x)
                    links += np.bincount(a, n_[q], size) + np.bincount(c, n[p], size)
                    for _ in range(2):  # most links join what the first few have joined
                        new = np.flatnonzero(forest.up[a] != forest.up[c])
                        forest.link(a[new][: 4 * size], c[new][: 4 * size])
                        forest.roots()
                    new = forest.up[a] != forest.up[c]
                    forest.link(a[new], c[new])
                up, cid = forest.roots(), np.concatenate((at + np.arange(len(x)), at_ + np.arange(len(y))))[:size]
                new, some = np.flatnonzero(up != np.arange(size)), np.flatnonzero(links)
                if len(some):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate((cid[new], cid[some]))),
                        pa.concat_arrays([pa.array(cid[up[new]]), pa.nulls(len(some), pa.int64())]),
                        pa.concat_arrays([pa.nulls(len(new), pa.int64()), pa.array(links[some].astype(np.int64))]),
                    ], ["a", "b", "links"])

    return pairs.mapInArrow(compare, "a long, b long, links long")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
