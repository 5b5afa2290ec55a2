"""URL filters: rules first, then exact list membership by a Bloom filter cascade.

The corpus's complete key universe is cut into shards by hash. In a shard, level 1 is a Bloom filter of the listed
keys; level 2 holds the other keys that level 1 takes in; level 3 the listed keys that level 2 takes in; and so on
until none is left. A key of the universe is listed just when the first level that lets it fall has an even number,
so pages are judged by looking bits up, without a join. Filters of a proven small size are broadcast; larger ones stay in
the shared folder, and each shard's levels meet the pages of the shard once, in one scan of the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stage, table, unstage

#: Keys wanted in a shard; bits and positions for each key of a level; most bytes of filters that are broadcast; rows of a
#: shard that are judged together when its levels are not broadcast, so that a hot host is split.
SHARD_KEYS, BITS_EACH, HASHES, BROADCAST_BYTES, GROUP_ROWS = 100_000, 8, 4, 32 << 20, 200_000

#: (verdict, host, path) of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host(url: str) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, ties in the order given; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # what comes last goes first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def hashes(keys: list[str], level: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), level) for k in keys], np.uint64)


def positions(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    step = h >> np.uint64(32) | np.uint64(1)
    for k in range(HASHES):
        yield ((h & np.uint64(0xFFFFFFFF)) + np.uint64(k) * step) % np.uint64(size)


def bloom(keys: list[str], level: int) -> np.ndarray:
    bits = np.zeros(max(64, BITS_EACH * len(keys)) // 8 * 8, bool)
    for at in positions(hashes(keys, level), len(bits)):
        bits[at.astype(np.int64)] = True
    return np.packbits(bits)


def passes(bits: np.ndarray, keys: list[str], level: int) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in positions(hashes(keys, level), 8 * len(bits)):
        at = at.astype(np.int64)
        found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def cascade(listed: list[str], others: list[str]) -> list[np.ndarray]:
    """The levels for one shard. Ends because each level has a seed of its own and a key in two lists cannot be."""
    levels, keys, rest = [], listed, others
    while keys:
        bits = bloom(keys, len(levels))
        levels.append(bits)
        through = passes(bits, rest, len(levels) - 1)
        keys, rest = [k for k, t in zip(rest, through) if t], keys
    return levels


def is_listed(levels: list[np.ndarray], keys: list[str]) -> np.ndarray:
    """Exact for every key of the universe that the levels were made for."""
    out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for level, bits in enumerate(levels):
        through = passes(bits, [keys[i] for i in open_], level)
        out[open_[~through]] = level % 2 == 1
        open_ = open_[through]
    out[open_] = len(levels) % 2 == 1
    return out


class UrlFilter:
    """Cascades for the keys of universe (key) that are in listed (key). Null keys are in neither; repeats count once."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        keys = universe.select("key", F.lit(0).alias("l")).unionByName(listed.select("key", F.lit(1).alias("l"))).filter("key IS NOT NULL")
        keys = stage(keys.groupBy("key").agg(F.max("l").alias("l")), "keys")
        self.shards = max(1, -(-keys.count() // SHARD_KEYS))

        def build(group: pd.DataFrame) -> pd.DataFrame:
            levels = cascade(*(sorted(group.loc[group["l"] == k, "key"]) for k in (1, 0)))
            return pd.DataFrame({"shard": np.full(len(levels), group["shard"].iloc[0], np.int32), "level": np.arange(len(levels), dtype=np.int32), "bits": [x.tobytes() for x in levels]})

        made = keys.withColumn("shard", self.shard(F.col("key"))).groupBy("shard").applyInPandas(build, "shard int, level int, bits binary")
        self.levels = stage(made, "levels")
        unstage(keys)

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def judge(self, rows: DataFrame, key: str = "host") -> DataFrame:
        """rows with a boolean column listed; a null key is not listed. rows are read once (and their shards counted first
        when the filters are too large to broadcast)."""
        rows = rows.drop("listed")
        schema = rows.select("*", F.lit(False).alias("listed")).schema
        names, at = rows.columns, free_name(rows, "shard")
        dealt = rows.withColumn(at, self.shard(F.coalesce(F.col(key), F.lit(""))))
        if (self.levels.agg(F.sum(F.length("bits"))).first()[0] or 0) <= BROADCAST_BYTES:
            own = {}
            for r in self.levels.orderBy("shard", "level").collect():
                own.setdefault(r["shard"], []).append(np.frombuffer(bytes(r["bits"]), np.uint8))
            sent = rows.sparkSession.sparkContext.broadcast(own)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    keys, shards = b.column(names.index(key)), b.column(len(names)).to_numpy()
                    found = np.zeros(len(keys), bool)
                    for s in np.unique(shards):
                        mine = np.nonzero(shards == s)[0]
                        found[mine] = listed(sent.value.get(int(s), []), keys.take(pa.array(mine)))
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found)], [*names, "listed"])

            return dealt.mapInArrow(run, schema)

        part, parts = free_name(rows, "part"), free_name(rows, "parts")
        sizes = stage(dealt.groupBy(at).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(parts)), "sizes")  # a row for each shard
        split = F.broadcast(sizes.filter(F.col(parts) > 1))
        dealt = dealt.join(split, at, "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col(parts), F.lit(1))).cast("int")).drop(parts)
        copies = self.levels.join(F.broadcast(sizes), self.levels["shard"] == sizes[at]).select("shard", "level", "bits", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("part"))

        def meet(pages: pa.Table, levels: pa.Table) -> pa.Table:
            levels = levels.sort_by("level").column("bits").to_pylist()
            found = listed([np.frombuffer(x, np.uint8) for x in levels], pages.column(key).combine_chunks())
            return pages.select(names).append_column("listed", pa.array(found))

        return dealt.groupBy(at, part).cogroup(copies.groupBy("shard", "part")).applyInArrow(meet, schema)


def listed(levels: list[np.ndarray], keys: pa.Array) -> np.ndarray:
    """is_listed() of keys that may be null."""
    found = is_listed(levels, ["" if k is None else k for k in keys.to_pylist()])
    return found & keys.is_valid().to_numpy(zero_copy_only=False)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict: the longest fitting rule's verdict, else block just for listed hosts.

    Null and malformed urls have empty host and path, fit no rule and are allowed unless the empty host is listed;
    repeated rows repeat; other columns pass through, clashing ones are replaced.
    """
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host(url_col), "path": path(url_col)})
    found = UrlFilter(rows.select(F.col("host").alias("key")), listed).judge(rows)
    chosen = rule(F.col("host"), F.col("path"), rules)
    own = F.coalesce(chosen["verdict"], F.when(F.col("listed"), "block").otherwise("allow"))
    return found.withColumns({"rule": chosen["rule"], "verdict": own}).drop("listed")


def listed_hosts(pages: DataFrame) -> DataFrame:
    """The query's list, which stands for one that a corpus owner brings: hosts whose MD5 starts with 0 to 3."""
    hosts = pages.select(host("url").alias("key")).filter("key <> ''").distinct()
    return hosts.filter(F.substring(F.md5("key"), 1, 1).isin("0", "1", "2", "3"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def _rules_sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    when = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    return f"CASE {' '.join(f"WHEN {w} THEN '{r}'" for w, r, _ in when)} END AS rule, CASE {' '.join(f"WHEN {w} THEN '{v}'" for w, _, v in when)} ELSE"


ORACLE = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {_rules_sql()} CASE WHEN host <> '' AND md5(host)[1] IN ('0', '1', '2', '3') THEN 'block' ELSE 'allow' END END AS verdict FROM p
"""
