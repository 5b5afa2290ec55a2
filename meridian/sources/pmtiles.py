"""Tile archives of the PMTiles format, version 3, as rows (offset, bytes) of an archive's pieces.

Executors cannot write into one file of a shared store, so an archive is a folder of pieces; laid end to end by their
offsets they are the file, which save() streams out, and a file that Spark reads whole is one piece. Writing: contents are
stored once and named by their hash, placed in the order in which tiles come first; runs of one content are one entry;
entries go in leaves of 4096, or of twice as many while the root directory is over what a first request fetches. Reading:
the root is decoded once, leaves and tiles are cut out of the pieces by joins on ranges of bytes.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import attach
from ..operators.order import numbered, sums_before
from ..operators.tiles import dedup_runs
from ..storage import stage, unstage
from .pbf import packed

# Fixed values of the format: bytes of the header, most bytes of a root, first entries of a leaf, codes of compressions.
HEADER, ROOT_MOST, LEAF = 127, 16257, 4096
COMPRESSION = {"none": 1, "gzip": 2}
#: Entries that are tried as one root; bytes by which pieces and ranges meet.
SMALL, CELL = 1 << 16, 1 << 20


def _varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, lowest first, the last byte of each under 128."""
    v = np.asarray(values, np.uint64)
    size = np.maximum(1, sum((v >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(10)))
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = (np.repeat(v, size) >> (7 * place).astype(np.uint64) & np.uint64(127)).astype(np.uint8)
    return (out | np.where(place < np.repeat(size, size) - 1, 128, 0).astype(np.uint8)).tobytes()


def directory(ids: np.ndarray, runs: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> bytes:
    """Entries in ascending order of ids, compressed; an offset that follows on the entry before is written as 0."""
    ids, runs, lengths, offsets = (np.asarray(x, np.int64) for x in (ids, runs, lengths, offsets))
    follows = np.concatenate(([False], offsets[1:] == offsets[:-1] + lengths[:-1])) if len(ids) else np.empty(0, bool)
    columns = np.diff(ids, prepend=0), runs, lengths, np.where(follows, 0, offsets + 1)
    return gzip.compress(_varints([len(ids)]) + b"".join(map(_varints, columns)), mtime=0)


def entries_of(data: bytes) -> list[np.ndarray]:
    """[ids, runs, lengths, offsets] of a directory; run 0 marks a leaf. Damaged ones raise ValueError."""
    try:
        found = packed(memoryview(gzip.decompress(data))).astype(np.int64)
    except (OSError, EOFError, IndexError) as e:
        raise ValueError("not a directory") from e
    if not len(found) or len(found) != 4 * found[0] + 1:
        raise ValueError("entries and their count differ")
    steps, runs, lengths, offsets = found[1:].reshape(4, -1)
    offsets = offsets - 1
    for k in np.flatnonzero(offsets < 0):
        if not k:
            raise ValueError("the first entry follows on none")
        offsets[k] = offsets[k - 1] + lengths[k - 1]
    return [np.cumsum(steps), runs, lengths, offsets]


@F.arrow_udf(T.BinaryType())
def _gzip(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else gzip.compress(d, mtime=0) for d in data.to_pylist()], pa.binary())


def _leaf(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("first_id")
    made = directory(*(group[c].to_numpy() for c in ("first_id", "run_length", "length", "offset")))
    return pd.DataFrame({"leaf": group["leaf"].iloc[:1], "first_id": group["first_id"].iloc[:1], "bytes": [made]})


def _header(root: int, meta: int, leaves: int, data: int, counts: tuple[int, int, int], zooms: tuple[int, int], box: tuple[float, float, float, float], compression: str) -> bytes:
    h = bytearray(HEADER)
    h[:8] = b"PMTiles\x03"
    at = np.cumsum([HEADER, root, meta, leaves]).tolist()
    struct.pack_into("<11Q", h, 8, at[0], root, at[1], meta, at[2], leaves, at[3], data, *counts)
    west, south, east, north = box
    place = lambda *v: [round(x * 1e7) for x in v]
    struct.pack_into("<6B4iB2i", h, 96, 1, 2, COMPRESSION[compression], 1, *zooms, *place(west, south, east, north), zooms[0], *place((west + east) / 2, (south + north) / 2))
    return bytes(h)


def write(tiles: DataFrame, path: str, zooms: tuple[int, int], box: tuple[float, float, float, float], metadata: dict, compression: str = "gzip", small: int = SMALL) -> None:
    """Write tiles (tile_id, data), ids once each, as the pieces of an archive at path. A null content is no tile.

    A content that a third of all tiles have is stored once and joined without moving them to one task. Beyond small entries
    there are always leaves; their pointers, one for each, pass through the driver. No tiles give an archive without any.
    """
    spark = tiles.sparkSession
    rows = stage(tiles.filter("data IS NOT NULL").select(F.col("tile_id").cast("long").alias("tile_id"), "data"), "tiles")
    runs = stage(dedup_runs(rows), "runs")
    firsts = runs.groupBy("hash").agg(F.min("first_id").alias("tile_id"), F.count("*").alias("uses"))
    packed_ = (_gzip if compression == "gzip" else F.col)("data")
    contents = stage(rows.join(firsts, "tile_id").select("hash", "tile_id", "uses", packed_.alias("bytes")), "contents")
    slim = contents.select("hash", "tile_id", "uses", F.length("bytes").cast("long").alias("length"))
    placed = stage(sums_before(slim, "length", "tile_id", name="offset"), "placed")
    n, addressed = runs.count(), rows.count()
    data, kinds = placed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    found = numbered(attach(runs, placed.select("hash", "uses", "length", "offset"), "hash", "uses", n).select("first_id", "run_length", "length", "offset"), "first_id")
    root, leaves, size = None, None, LEAF
    if n <= small:
        every = found.toPandas().sort_values("first_id")
        root = directory(*(every[c].to_numpy() for c in ("first_id", "run_length", "length", "offset")))
    while root is None or len(root) > ROOT_MOST:
        if leaves is not None:
            unstage(leaves)
        made = found.withColumn("leaf", F.floor(F.col("number") / size)).groupBy("leaf").applyInPandas(_leaf, "leaf long, first_id long, bytes binary")
        leaves = stage(made, "leaves")
        lengths = leaves.select("first_id", F.length("bytes")).orderBy("first_id").collect()
        size_of = np.array([r[1] for r in lengths], np.int64)
        root = directory(np.array([r[0] for r in lengths]), np.zeros(len(lengths)), size_of, np.cumsum(size_of) - size_of)
        size *= 2
    meta = gzip.compress(json.dumps(metadata).encode(), mtime=0)
    of_leaves = 0 if leaves is None else int(size_of.sum())
    head = _header(len(root), len(meta), of_leaves, data, (addressed, n, kinds), zooms, box, compression) + root + meta
    pieces = spark.createDataFrame([(0, bytearray(head))], "offset long, bytes binary")
    if leaves is not None:
        at = spark.createDataFrame([(r[0], len(head) + int(o)) for r, o in zip(lengths, np.cumsum(size_of) - size_of)], "first_id long, offset long")
        pieces = pieces.unionByName(leaves.join(at, "first_id").select("offset", "bytes"))
    own = contents.select("tile_id", "bytes").join(placed.select("tile_id", "offset"), "tile_id")
    pieces = pieces.unionByName(own.select((F.col("offset") + len(head) + of_leaves).alias("offset"), "bytes"))
    pieces.write.parquet(path)
    unstage(rows, runs, contents, placed, *([] if leaves is None else [leaves]))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(offset, bytes) of what write() wrote."""
    return spark.read.parquet(path)


def pieces_of_file(spark: SparkSession, path: str) -> DataFrame:
    """(offset, bytes) of an archive in one file, which Spark reads whole: at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.lit(0).cast("long").alias("offset"), F.col("content").alias("bytes"))


def save(pieces: DataFrame, path: str) -> None:
    """Stream pieces in order into one file at path, whatever store it is in; the driver holds one partition at a time."""
    spark = pieces.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        for r in pieces.repartitionByRange("offset").sortWithinPartitions("offset").toLocalIterator():
            out.write(bytes(r["bytes"]))
    finally:
        out.close()


def ranges(pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (at, length, ...), no two rows alike, with bytes: what the pieces hold there. Pieces and ranges are dealt to
    cells of CELL bytes and meet in those; a range that the pieces do not cover is dropped."""
    cells = lambda start, size: F.sequence(F.floor(start / CELL), F.floor((start + F.greatest(size, F.lit(1)) - 1) / CELL))
    cut = pieces.withColumn("_cell", F.explode(cells(F.col("offset"), F.length("bytes"))))
    low = F.greatest("offset", F.col("_cell") * CELL)
    high = F.least(F.col("offset") + F.length("bytes"), (F.col("_cell") + 1) * CELL)
    part = F.expr("substring(bytes, CAST(_low - offset + 1 AS INT), CAST(_high - _low AS INT))")
    cut = cut.withColumns({"_low": low, "_high": high}).select("_cell", "_low", "_high", part.alias("_part"))
    met = wanted.withColumn("_cell", F.explode(cells(F.col("at"), F.col("length")))).join(cut, "_cell").filter("_low < at + length AND _high > at")
    own = F.expr("substring(_part, CAST(greatest(at - _low, 0) + 1 AS INT), CAST(least(_high, at + length) - greatest(_low, at) AS INT))")
    whole = met.groupBy(*wanted.columns).agg(F.array_sort(F.collect_list(F.struct("_low", own.alias("x")))).alias("_parts"))
    joined = F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["x"]))
    return whole.withColumn("bytes", joined).filter(F.length("bytes") == F.col("length")).drop("_parts")


def header(pieces: DataFrame) -> dict:
    """What an archive's header says; ValueError if it is none."""
    first = pieces.filter("offset = 0").select(F.substring("bytes", 1, HEADER).alias("h")).first()
    h = bytes(first["h"]) if first else b""
    if len(h) < HEADER or h[:8] != b"PMTiles\x03":
        raise ValueError("not a PMTiles archive of version 3")
    names = ("root_at", "root", "meta_at", "meta", "leaves_at", "leaves", "data_at", "data", "addressed", "entries", "contents")
    found = dict(zip(names, struct.unpack_from("<11Q", h, 8)))
    inner, outer = h[97], h[98]
    if inner != 2 or outer not in COMPRESSION.values():
        raise ValueError("unknown compression")
    return found | {"compression": {v: k for k, v in COMPRESSION.items()}[outer], "zooms": (h[100], h[101]), "box": tuple(x / 1e7 for x in struct.unpack_from("<4i", h, 102))}


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in entries_of(data)], ["first_id", "run_length", "length", "offset"])


def entries(pieces: DataFrame) -> DataFrame:
    """(first_id, run_length, length, offset) of all tiles, leaves of any depth decoded in parallel; offset counts from the
    first tile's bytes."""
    spark, h = pieces.sparkSession, header(pieces)
    schema = "first_id long, run_length long, length long, offset long"
    at = lambda rows: rows.select((F.col("offset") + h["leaves_at"]).alias("at"), "length")
    found = ranges(pieces, spark.createDataFrame([(h["root_at"], h["root"])], "at long, length long")).select("bytes").mapInArrow(_decoded, schema)
    found, out = stage(found, "entries"), None
    while True:
        own = found.filter("run_length > 0")
        out = own if out is None else out.unionByName(own)
        below = found.filter("run_length = 0")
        if below.isEmpty():
            return out
        found = stage(ranges(pieces, at(below)).select("bytes").mapInArrow(_decoded, schema), "entries")


def read(pieces: DataFrame) -> DataFrame:
    """(tile_id, data) of every tile, runs written out, contents decompressed."""
    h = header(pieces)
    found = entries(pieces)
    held = ranges(pieces, found.select((F.col("offset") + h["data_at"]).alias("at"), "length").distinct()).select((F.col("at") - h["data_at"]).alias("offset"), "length", "bytes")
    tiles = found.withColumn("tile_id", F.explode(F.sequence(F.col("first_id"), F.col("first_id") + F.col("run_length") - 1))).join(held, ["offset", "length"])
    data = _gunzip("bytes") if h["compression"] == "gzip" else F.col("bytes")
    return tiles.select("tile_id", data.alias("data"))


@F.arrow_udf(T.BinaryType())
def _gunzip(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else gzip.decompress(d) for d in data.to_pylist()], pa.binary())
