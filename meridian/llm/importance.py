r"""Target-distribution importance resampling over hashed n-grams.

A document's words give runs of one to three words, each hashed to a bucket by CRC-32. Buckets that are commoner in the
target than in the corpus gain, others lose; a document's weight is the sum over its runs. Scoring explodes nothing:
higher-order functions make the array of a document's buckets and add up entries of an array of gains that is a literal of
the plan. All that is shuffled is the buckets' totals, and the slim rows of scores to be ranked.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import free_name, stage, table, unstage

BUCKETS = 10000
#: ASCII characters that part words.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: str) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase + GAPS, string.ascii_lowercase + " " * len(GAPS))
    return F.array_remove(F.split(plain, " "), "")


def bucketed(docs: DataFrame, text: str = "text", own: str = "buckets", n_words: str = "n_words") -> DataFrame:
    """docs with the buckets of a text's runs of one to three words, repeats included, and the number of its words."""
    w = free_name(docs, "words_of_text")
    bucket = lambda s: (F.crc32(s.cast("binary")) % BUCKETS).cast("int")
    run = lambda k: lambda x, i: bucket(F.concat(x, *(part for j in range(1, k + 1) for part in (F.lit(" "), F.get(w, i + j)))))
    runs = [F.transform(w, run(k)) for k in range(3)]
    whole = [r if not k else F.slice(r, 1, F.greatest(F.size(w) - k, F.lit(0))) for k, r in enumerate(runs)]  # the last k words start no such run
    return docs.withColumn(w, words(text)).withColumns({own: F.concat(*whole), n_words: F.size(w)}).drop(w)


def totals(docs: DataFrame, text: str = "text") -> list[int]:
    """How often each bucket occurs in all texts: BUCKETS numbers, whatever the corpus."""
    # the outer form, as the inner one has the optimiser test each array's size beforehand, which makes it twice
    found = bucketed(docs.select(text), text).select(F.explode_outer("buckets").alias("b")).groupBy("b").count()
    counts = [0] * BUCKETS
    for b, n in found.collect():
        if b is not None:
            counts[b] = n
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the corpus."""
    s_all, t_all = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus, target)]


def scored(docs: DataFrame, gain: list[int], seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row: weight is the sum of its runs' gains, score adds Gumbel noise
    from a hash of the seed and the id, so that the highest scores are a sample without replacement by weight."""
    rows = bucketed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    table_ = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table_, b + 1))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    rows = rows.select("id", F.col("n_words").cast("long").alias("n_words"), F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    return rows.select("id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).cast("long").alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of docs; rank is 1, 2, ... for those drawn, null for the rest.

    Of the rows with least_words words or more, percent of a hundred (rounded down) are drawn by score; ties go to the
    smaller id, null ids last, then to the smaller weight and number of features, then to any. A null text has no
    features and weight 0; a null id is hashed as an empty one; repeated rows count and may be drawn each. Very long texts
    are read whole, in the memory of a few arrays of their words. No rows give none; an empty target has only smoothed
    shares. Other columns are not read.
    """
    gain = gains(totals(docs, text_col), totals(target, text_col))
    rows = stage(scored(docs, gain, seed, id_col, text_col), "scored")
    able = F.col("n_words") >= least_words
    place = numbered(rows.filter(able), F.desc("score"), F.asc_nulls_last("id"), "weight", "n_features")
    drawn = percent * rows.filter(able).count() // 100
    ranked = place.withColumn("rank", F.when(F.col("number") < drawn, F.col("number") + 1))
    out = ranked.unionByName(rows.filter(~able).withColumns({"number": F.lit(None).cast("long"), "rank": F.lit(None).cast("long")}))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc_of_byte(v: int) -> int:
    for _ in range(8):
        v = v >> 1 ^ 0xEDB88320 * (v & 1)
    return v


def crc_sql(digits: str) -> str:
    """CRC-32 of the bytes whose hexadecimal digits a column has, folded byte by byte with the table of its own rule."""
    codes = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || {digits}[2 * i + 1:2 * i + 2])::BIGINT)"
    rule = f"[{', '.join(str(_crc_of_byte(v)) for v in range(256))}]::BIGINT[]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(({rule})[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


def _features_sql(name: str, key: str, source: str) -> str:
    runs = " UNION ALL ".join(f"SELECT {key}, unnest(list_transform(range(1, greatest(len(w) - {k}, 0) + 1), lambda i: array_to_string(w[i:i + {k}], ' '))) AS f FROM {name}_words" for k in range(3))
    return rf"""
{name}_words AS (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {source}),
{name}_runs AS ({runs})"""


ORACLE = f"""
WITH {_features_sql('d', 'doc_id', 'documents')}, {_features_sql('t', 'item_id', 'benchmark')},
hashed AS (SELECT f, ({crc_sql('digits')} % 10000)::INT AS b FROM (SELECT f, hex(encode(f)) AS digits FROM (SELECT f FROM d_runs UNION SELECT f FROM t_runs))),
s AS (SELECT b, count(*) AS s FROM d_runs JOIN hashed USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM t_runs JOIN hashed USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d_runs) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM t_runs) + 10000)::DOUBLE)))::BIGINT AS g
  FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM d_runs JOIN hashed USING (f) JOIN gain USING (b) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d_words LEFT JOIN w USING (doc_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n >= 20) OVER () AS able FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM y
"""
