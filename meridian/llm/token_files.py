"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length codes, control bytes apart.

An id is written as its rank by frequency, so that common ids take one byte. A rank takes 1 to 4 bytes, little-endian;
a control byte says for four ranks how many, two bits each, lowest first. Files are Parquet, which every shared store and
Spark's commit protocol can handle: `blocks` has rows (part, block, first, doc_ids, lengths, controls, data) of whole
documents in ascending id order, `ranks` one row, the ids by rank as unsigned 32-bit integers. A decoder looks control
bytes up in a table of 256 byte masks, and ranks in the table of ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stage, table, unstage
from .packing import default_tokenizer, tokenizer

#: A block is closed once it has this many ids; a document is never cut, so only a longer one makes a longer block.
BLOCK_IDS = 1 << 16
#: For each control byte, which of the 16 bytes of four ranks are written.
MASKS = np.array([[[k <= (c >> 2 * i & 3) for k in range(4)] for i in range(4)] for c in range(256)])
BLOCKS = "part int, block int, first long, doc_ids array<long>, lengths array<long>, controls binary, data binary"


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2 to the 32nd."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.concatenate((more, np.zeros(-len(more) % 4, np.uint8))).reshape(-1, 4)
    controls = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return controls.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]].tobytes()


def decode(controls: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks that encode() was given. What its control bytes do not account for raises ValueError."""
    if len(controls) != -(-count // 4):
        raise ValueError("control bytes and count differ")
    mask = MASKS[np.frombuffer(controls, np.uint8)].reshape(-1, 4)[:count]
    if mask.sum() != len(data):
        raise ValueError("control bytes and data differ")
    ranks = np.zeros((count, 4), np.uint8)
    ranks[mask] = np.frombuffer(data, np.uint8)
    return ranks.view("<u4").reshape(-1)


def _ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Staged (doc_id, n, crc, ids): ids as unsigned 16-bit integers where they fit, else 32-bit ones; n counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = tokenizer(path).encode_all, np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, len(b), 1024):
                rows = [e + end for e in own([text or "" for text in b.column(1).slice(lo, 1024).to_pylist()])]
                slim = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else e for e in rows for x in [np.frombuffer(e, "<u4")]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, 1024), pa.array([len(e) // 4 for e in rows], pa.int64()), pa.array([zlib.crc32(e) for e in rows], pa.int64()), pa.array(slim, pa.binary())],
                    ["doc_id", "n", "crc", "ids"],
                )

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, crc long, ids binary"), "ids")


def _numbers(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _frequencies(rows: DataFrame) -> list[tuple[int, int]]:
    """(id, count) of every id, the most frequent first, ties by id: at most as many as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.bincount(_numbers(ids, n))
                if len(own) > len(total):
                    total = np.concatenate((total, np.zeros(len(own) - len(total), np.int64)))
                total[: len(own)] += own
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "count"])

    found = rows.select("n", "ids").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    return sorted(map(tuple, found), key=lambda x: (-x[1], x[0]))


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Write the ids of docs (doc_id, text), end_id after each document, in ascending order of doc_id to files at path.

    A null text is empty and has the end id alone; null ids come last. Rows of one id follow each other by length, then by
    the checksum of their ids; repeated rows are written as often as they come. Very long texts are encoded whole, in one
    block. No rows give files without blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = _ids(docs, vocabulary or default_tokenizer(), end_id)
    by_rank = np.array([x for x, _ in _frequencies(rows)], "<u4")
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    rank[by_rank] = np.arange(len(by_rank), dtype="<u4")
    sent = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, block, docs_, parts = TaskContext.get().partitionId(), 0, 0, [], []

        def closed() -> pa.RecordBatch:
            controls, data = encode(sent.value[np.concatenate(parts)])
            values = [part, block, first, [d for d, _ in docs_], [n for _, n in docs_], controls, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        held = 0
        for b in batches:
            for doc, n, ids in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("doc_id", "n", "ids"))):
                docs_.append((doc, n))
                parts.append(_numbers(ids, n))
                held += n
                if held >= BLOCK_IDS:
                    yield closed()
                    first, block, held, docs_, parts = first + held, block + 1, 0, [], []
        if docs_:
            yield closed()

    order = [F.asc_nulls_last("doc_id"), F.col("n"), F.col("crc")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    unstage(rows)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and ids array<int> if asked for, of the documents in files at path.

    start counts the ids of all documents before; it is a part's place (one number for each part that was written) and
    the block's place in its part. Documents come in the order of the files within a block; sort by start for all.
    """
    stored = spark.read.parquet(f"{path}/blocks")
    sizes = stored.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n")).collect()
    sizes = sorted(map(tuple, sizes))
    starts = {p: b - n for (p, n), b in zip(sizes, accumulate(n for _, n in sizes))}
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()[0], "<u4")  # at most the vocabulary
    sent = spark.sparkContext.broadcast((starts, by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, by_rank = sent.value
        for b in batches:
            for part, first, docs, lengths, controls, data in zip(*(c.to_pylist() for c in b.columns)):
                ids = by_rank[decode(controls, data, sum(lengths))]
                ends = np.cumsum(lengths)
                own = [ids[e - n : e] for e, n in zip(ends, lengths)]
                columns = [pa.array(docs, pa.int64()), pa.array(starts[part] + first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in own], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return stored.select("part", "first", "doc_ids", "lengths", "controls", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path, with_ids=False)
