"""Best-fit packing by minimum bin slack.

Which documents fill a sequence matters only by their lengths, so the plan is made on the histogram of lengths, whose
size is the sequence length whatever the corpus. Per bin the longest piece left is placed and a bitset subset-sum
over the lengths left finds the fullest combination beside it; the bin is then repeated as often as the counts allow.
Spark tokenises, counts, ranks the pieces of a length and looks each rank up in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

SEQUENCE = 2048
#: A length's pieces are ranked in parts of at most this share of all pieces.
PARTS = 8192
#: Words whose ids a worker remembers, and the most letters of one.
CACHE, LETTERS = 400_000, 64
#: Characters of texts, about, whose words are told apart at once.
CHARS = 1 << 21

#: Pieces of lower-cased text that the tokenizer splits at, in the characters for which Python and it agree.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+(?:_+[^\s\w]*)*|_[^\s\w]*(?:_+[^\s\w]*)*")
#: The normaliser and the cuts for which PIECE and PLAIN hold; a file with others is left to its own tokenizer.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: Letters with one lower case and no decomposition to compose: other texts go to the tokenizer whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ž‐-‧‰-⁞€]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """ids of a text as little-endian 32-bit integers; a word between white space is tokenised once while remembered.

    If the file cuts texts as KNOWN says, texts of PLAIN characters are cut so here and its model tokenises the pieces; all
    others, and those that may hold an added token, go to the tokenizer whole. Both give the tokenizer's own ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.known = Tokenizer.from_file(path), {}
        self.model = self.whole.model
        own = json.loads(self.whole.to_str())
        added = [t["content"] for t in own["added_tokens"]]
        self.plain = all(own[k] == v for k, v in KNOWN.items()) and all("<|" in t for t in added)
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes written as themselves, as byte-level BPE does
        rest = [b for b in range(256) if b not in own]
        self.bytes = {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(piece) <= LETTERS:
            self.known[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        known, stem = self.known, word.rstrip(".,;:!?")
        if stem.isalpha():  # the two pieces are remembered, the word is not
            return b"".join([self._piece(p) if (ids := known.get(p)) is None else ids for p in (stem, word[len(stem) :])])
        found = b"".join([self._piece(p) if (ids := known.get(p)) is None else ids for p in PIECE.findall(word)])
        if len(word) <= LETTERS:
            known[word] = found
        return found

    def _is_plain(self, text: str) -> bool:
        return self.plain and "<|" not in text and PLAIN.fullmatch(text) is not None

    def encode(self, text: str) -> bytes:
        known = self.known
        if not self._is_plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        if len(known) > CACHE:
            known.clear()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known.get(w) or self._word(w) for w in words])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text. Texts are taken together for about CHARS characters; of their words each different one is
        looked up once, and Arrow lays the ids out by word."""
        found, lo = [], 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size < CHARS:
                hi, size = hi + 1, size + len(texts[hi])
            found += self._together(texts[lo:hi])
            lo = hi
        return found

    def _together(self, texts: list[str]) -> list[bytes]:
        known, plain = self.known, [self._is_plain(t) for t in texts]
        # white space of plain texts is that of ASCII
        words = pc.ascii_split_whitespace(pa.array([t.lower() for t, own in zip(texts, plain) if own], pa.large_string()))
        each = words.flatten().dictionary_encode()
        if len(known) > CACHE:
            known.clear()
        ids = [self._word(w) if (x := known.get(w)) is None else x for w in each.dictionary.to_numpy(zero_copy_only=False).tolist()]
        laid = pa.array(ids, pa.large_binary()).take(each.indices)
        _, offsets, data = laid.buffers()
        ends = np.frombuffer(offsets, np.int64)[words.offsets.to_numpy()].tolist() if len(laid) else [0] * (len(words) + 1)
        data, rows = memoryview(data or b""), iter(zip(ends, ends[1:]))
        return [bytes(data[slice(*next(rows))]) if own else self.encode(t) for t, own in zip(texts, plain)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that later tasks find its words known."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenise(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with ids array<int> if asked for: a row for each piece of a document.

    A null text is empty and has the end id alone; only documents over size are cut. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = tokenizer(path).encode_all, np.array([end_id], "<u4").tobytes(), 4 * size
        for b in batches:
            for lo in range(0, len(b), 1024):
                rows = []
                for i, e in zip(b.column(0).slice(lo, 1024).to_pylist(), encode([text or "" for text in b.column(1).slice(lo, 1024).to_pylist()])):
                    e += end
                    rows += [(i, at // step, at // 4, len(cut) // 4, zlib.crc32(cut), cut) for at in range(0, len(e), step) for cut in [e[at : at + step]]]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(r[5], "<i4") for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def fullest(counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination of available lengths whose sum is the largest up to room."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in range(room, 0, -1):
        left = min(counts[length], room // length)
        part = 1
        while left > 0 and not reach >> room & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach = (reach | reach << (length * part)) & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            taken[length] = taken.get(length, 0) + part
    return sorted(taken.items(), reverse=True)


def plan(counts: list[int], size: int = SEQUENCE) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, {length: copies}) of bins that together hold counts[length] pieces of each length."""
    counts, bins = list(counts), []
    longest = size
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return bins
        counts[longest] -= 1
        content = dict(fullest(counts, size - longest))
        counts[longest] += 1
        content[longest] = content.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in content.items())
        for length, n in content.items():
            counts[length] -= n * times
        bins.append((times, content))


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[list[int], list[tuple[int, int, int, int]]]]:
    """For each length: first ranks, and for each its (first rank, copies in a bin, first sequence, offset in a bin)."""
    found, taken, sequence = {}, {}, 0
    for times, content in bins:
        offset = 0
        for length, n in sorted(content.items(), reverse=True):
            first = taken.get(length, 0)
            starts, rows = found.setdefault(length, ([], []))
            starts.append(first)
            rows.append((first, n, sequence, offset))
            taken[length], offset = first + n * times, offset + n * length
        sequence += times
    return found


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be stored (it is read twice) and have length from 1 to size.

    Repeated rows and ties are separate pieces. Empty input gives no rows.
    """
    spark = pieces.sparkSession
    counts = [0] * (size + 1)
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():  # at most size rows
        counts[length] = n
    total = max(1, sum(counts))
    parts = spark.createDataFrame([(k, -(-n * PARTS // total)) for k, n in enumerate(counts) if n], "length long, parts long")
    part = F.pmod(F.xxhash64("doc_id", "piece", "row"), F.col("parts"))
    rows = pieces.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(parts), "length").withColumn("part", part).drop("parts")
    rows = stage(rows, "parts")
    before, firsts = {}, {}
    for length, k, n in sorted(map(tuple, rows.groupBy("length", "part").agg(F.count("*")).collect())):  # at most PARTS + size rows
        firsts[length, k] = before.get(length, 0)
        before[length] = firsts[length, k] + n
    sent = spark.sparkContext.broadcast((firsts, places(plan(counts, size))))
    names = [f for f in pieces.columns]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1)
    ranked = ranked.select(*names, "part", "rank")
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, found = sent.value
        for b in batches:
            out = []
            for length, k, r in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("length", "part", "rank"))):
                rank = first[length, k] + r
                starts, own = found[length]
                start, n, sequence, offset = own[bisect_right(starts, rank) - 1]
                out.append((sequence + (rank - start) // n, offset + (rank - start) % n * length))
            made = [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *made], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Tokenise docs and pack all pieces; see tokenise() and pack()."""
    return pack(stage(tokenise(docs, path or default_tokenizer(), size, with_ids=with_ids), "pieces"), size)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
