"""Language identification by bit-sliced Bloom filters over character n-grams.

One array serves all languages: each position has a word for every 64 languages, in which a bit is a language's filter. Looking an n-gram up ANDs the
words at its positions, which gives the languages that contain it, all at once. A language's popcount over a text,
corrected for its filter's false positives, is its score; of equal scores the language with more labelled documents wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage
from .toxicity import is_held_out

#: Characters of an n-gram; a code point has 21 bits, so three fit a long.
N = 3
#: Labelled documents learned from for each language, and languages of a word (its bits).
PER_LANGUAGE, WORD = 1500, 64
#: An n-gram is in a language's filter when it is at least this frequent there, so that a language has at most 1 / LEAST,
#: and at least this share of where it is most frequent.
LEAST, SHARE = 2e-5, 0.25
#: Positions of an n-gram and bits of a filter for each n-gram that it may hold.
HASHES, BITS_EACH = 3, 10
CHUNK = 1 << 18


def grams(text: str) -> Iterator[np.ndarray]:
    """n-grams of letters and word boundaries, the text's ends among them, of the lower-cased text, packed into longs, in
    bounded pieces. A text has n-grams just when it has a letter."""
    low = f" {text.lower()} "
    for at in range(0, len(low), CHUNK):
        piece = low[at : at + CHUNK + N - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _letters(codes)
        codes = np.where(letter, codes, 32)
        packed = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        yield packed[letter[1:-1] | (letter[:-2] & letter[2:])]  # pieces overlap by N - 1; an inner letter has neighbours


_is_letter = np.zeros(0x110000, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _is_letter[97]:
        _is_letter[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _is_letter[codes]


def positions(packed: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """HASHES positions below size, a power of two, by double hashing."""
    h = packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    step = h >> np.uint64(33) | np.uint64(1)
    for k in range(HASHES):
        yield ((h >> np.uint64(7)) + np.uint64(k) * step) & np.uint64(size - 1)


class Filters:
    """languages in the order in which ties are settled, the words of the bit-sliced filters (a column for every WORD
    languages; one column may be flat), and each language's rate of false positives."""

    def __init__(self, languages: list[str], words: np.ndarray):
        self.languages, self.words = languages, words
        fill = np.array([self.bit(words, k).mean() for k in range(len(languages))])
        self.wrong = fill**HASHES

    @staticmethod
    def bit(words: np.ndarray, k: int) -> np.ndarray:
        """Language k's bit of each row of words."""
        return (words if words.ndim == 1 else words[:, k // WORD]) >> np.uint64(k % WORD) & np.uint64(1)

    def contains(self, packed: np.ndarray) -> np.ndarray:
        """A bitmask of languages for each n-gram, as wide as words."""
        mask = np.full((len(packed), *self.words.shape[1:]), ~np.uint64(0))
        for at in positions(packed, len(self.words)):
            mask &= self.words[at]
        return mask

    def decide(self, text: str | None) -> tuple[str, float]:
        hits, n = np.zeros(len(self.languages)), 0
        for packed in grams(text or ""):
            mask, n = self.contains(packed), n + len(packed)
            hits += [int(self.bit(mask, k).sum()) for k in range(len(self.languages))]
        if not n or not self.languages:
            return "und", 0.0
        true = np.clip((hits - n * self.wrong) / (1 - self.wrong), 0, None) / n
        best = int(true.argmax())
        return self.languages[best], float(min(1.0, true[best]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learn from at most PER_LANGUAGE documents of a language, those of the smallest hashes of their ids, outside the held-out fold.

    Null ids and null languages are not learned from. Without any labelled row every text is und. The driver holds the
    filters: at most 1 / LEAST n-grams of a language.
    """
    spark = docs.sparkSession
    own = docs.filter(~is_held_out("doc_id", 4, 2) & F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull() & F.col(text_col).isNotNull())
    sizes = own.groupBy(F.col(lang_col).alias("lang")).count().collect()
    counts = {r["lang"]: r["count"] for r in sizes}
    languages = sorted(counts, key=lambda lang: (-counts[lang], lang))
    if not languages:
        return Filters([], np.zeros(64, np.uint64))
    # a hash threshold that PER_LANGUAGE documents of each language pass on average: no sort, no counting beyond it
    place = F.array_position(F.array(*map(F.lit, languages)), F.col(lang_col)).cast("int") - 1
    most = F.array(*(F.lit(int(min(1.0, PER_LANGUAGE / counts[lang]) * (1 << 30))) for lang in languages))
    within = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.get(most, place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column(0).to_numpy()
            for k in np.unique(lang):
                texts = b.column(1).filter(pa.array(lang == k))
                got, n = np.unique(np.concatenate([g for t in texts for g in grams(t.as_py())] or [np.empty(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), k, np.int32)), pa.array(got), pa.array(n)], ["lang", "gram", "n"])

    seen = own.filter(within).select(place.alias("lang"), F.col(text_col)).mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    wide = stage(seen.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == k, F.col("n"))).alias(f"n{k}") for k in range(len(languages)))), "grams")
    totals = wide.agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(languages)))).first()
    rate = [F.coalesce(F.col(f"n{k}"), F.lit(0)) / (totals[k] or 1) for k in range(len(languages))]
    top = F.greatest(*rate) if len(rate) > 1 else rate[0]
    has = wide.select("gram", F.posexplode(F.array(*((r >= LEAST) & (r >= SHARE * top) for r in rate))).alias("lang", "has")).filter("has")
    found = has.select("lang", "gram").toArrow()
    unstage(wide)
    lang, packed = found.column(0).to_numpy(), found.column(1).to_numpy()
    most = np.bincount(lang, minlength=1).max()
    size = 1 << max(6, int(np.ceil(np.log2(BITS_EACH * most + 1))))
    words = np.zeros((size, -(-len(languages) // WORD)), np.uint64)
    for at in positions(packed, size):
        np.bitwise_or.at(words, (at.astype(np.int64), lang // WORD), np.uint64(1) << (lang % WORD).astype(np.uint64))
    return Filters(languages, words)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; und and 0 where the text is null or has no letter. Whole texts; equal scores, such as
    those of texts that no filter knows, go to the language with most labelled documents, then to that which sorts first;
    other columns pass through (old predictions are replaced)."""
    rest = docs.drop("lang_pred", "score")
    schema = rest.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    sent, at = docs.sparkSession.sparkContext.broadcast(filters), rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sent.value.decide(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
