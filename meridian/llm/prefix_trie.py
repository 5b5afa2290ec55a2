"""A trie of conversations by their turns, its subtree totals by leaf-peeling message passing.

A node is a sequence of turns that conversations start with, named by its depth and the exclusive or of its turns' hashes,
each taken with its position, which blocks of a conversation can take on their own. Every node belongs to the member
whose id hashes lowest, so that a member owns one stretch of its own path, and a way from the root to a leaf changes its
owner some ln(n) times for n conversations. Nodes hold counters of the children that other members own. A stretch whose
counters are all 0 completes: its totals run up the stretch and are sent to the parent of its top, whose counter goes
down. Only open nodes are read in a round, and rounds go on until the root has finished.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered, running
from .common import attach, stage, table, unstage
from .importance import crc_sql
from .mixing import n_words

#: Conversations whose ids this divides lead those up to the next; they share at most SHARED opening turns.
GROUP, SHARED = 20, 4
#: Bytes of listed ids that are hashed at a time.
CHUNK = 1 << 16
NODE = "struct<depth:bigint,p1:bigint,p2:bigint>"


def turns(rows: DataFrame) -> DataFrame:
    """Staged (conv_id, item, words, number) of rows (conv_id, turn, role, text): numbered by conversation and turn.

    Null turns come first, those of one turn in the order of their digests; null roles and texts are empty; repeated rows
    are turns of their own; rows without a conv_id belong to no conversation and are left out. item is the digest of role
    and text, so texts of any length move no further.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    item = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), item.alias("item"), n_words("text").alias("words"))
    slim = stage(slim, "turns")
    out = stage(numbered(slim, "conv_id", F.asc_nulls_first("turn"), "item").drop("turn"), "numbered")
    unstage(slim)
    return out


def with_shared_openings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, item, words) and (conv_id, size) of conversations rebuilt from turns(): a conversation opens with the
    first h turns of the one whose id is the next lower multiple of GROUP, h = crc32(id) % SHARED, and goes on after its own
    first h."""
    sizes = stage(found.groupBy("conv_id").agg(F.min("number").alias("first"), F.count("*").alias("n")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    leads = sizes.select(F.col("conv_id").alias("leader"), F.col("n").alias("has"))
    convs = sizes.withColumns({"h": h, "leader": F.col("conv_id") - F.col("conv_id") % GROUP}).join(leads, "leader", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stage(convs.select("conv_id", "first", "n", "h", "leader", "taken", "size"), "convs")
    own = attach(found, convs, "conv_id", "n", found.count()).withColumn("pos", F.col("number") - F.col("first")).filter("pos >= h")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "item", "words")
    led = found.filter(F.col("conv_id") % GROUP == 0).join(sizes.select("conv_id", "first"), "conv_id").withColumn("pos", F.col("number") - F.col("first"))
    led = led.filter(F.col("pos") < SHARED - 1).select(F.col("conv_id").alias("leader"), "pos", "item", "words")
    opening = convs.filter("taken > 0").select("conv_id", "leader", "taken").join(led, "leader").filter("pos < taken")
    every = stage(own.unionByName(opening.select("conv_id", (F.col("pos") + 1).alias("depth"), "item", "words")), "rebuilt")
    return every, convs.select("conv_id", "size")


def _named(paths: DataFrame) -> DataFrame:
    """Staged (conv_id, words, node, up) of paths (conv_id, depth, item, words): each turn's node and its parent."""
    hashes = {f"p{k}": F.xxhash64(F.lit(k), "depth", "item") for k in (1, 2)}
    one = stage(paths.select("conv_id", "depth", "words", *(h.alias(c) for c, h in hashes.items()), *(h.alias(f"x{c[1]}") for c, h in hashes.items())), "hashes")
    found = running(one, "conv_id", F.col("depth"), {c: F.bit_xor for c in hashes}, lambda a, b: a.bitwiseXOR(b))
    node = F.struct("depth", "p1", "p2").alias("node")
    up = F.struct((F.col("depth") - 1).alias("depth"), *(F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2))).alias("up")
    out = stage(found.select("conv_id", "words", node, up), "paths")
    unstage(one)
    return out


def _nodes(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """Staged nodes with the parent's conv_id and owner and the number of children, the root among them."""
    rank = F.struct(F.xxhash64("conv_id").alias("h"), "conv_id")
    of = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(rank)["conv_id"].alias("owner")]
    deep = paths.groupBy("node").agg(*of, F.max("words").alias("words"), F.min("up").alias("up"))
    root = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2"))).alias("node")
    top = sizes.agg(*of).filter("n_convs > 0").select(root, "n_convs", "conv_id", "owner", F.lit(0).cast("long").alias("words"), F.lit(None).cast(NODE).alias("up"))
    nodes = stage(deep.unionByName(top), "nodes")
    kids = stage(nodes.filter("up IS NOT NULL").groupBy("up").agg(F.count("*").alias("n_children")), "kids")
    parents = kids.join(nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("parent_owner")), "up")
    below = attach(nodes.filter("up IS NOT NULL"), stage(parents, "parents"), "up", "n_children", nodes.count()).drop("up", "n_children")
    every = below.unionByName(nodes.filter("up IS NULL").drop("up").withColumns({c: F.lit(None).cast("long") for c in ("parent_conv_id", "parent_owner")}))
    return stage(every.join(kids.withColumnRenamed("up", "node"), "node", "left").fillna(0, ["n_children"]).withColumn("depth", F.col("node.depth")), "trie")


def peeled(nodes: DataFrame) -> DataFrame:
    """(owner, depth, n_leaves, saved) of every node: totals over its subtree, itself included."""
    hangs = (F.col("parent_owner") != F.col("owner")) & F.col("parent_owner").isNotNull()
    waits = nodes.filter(hangs).groupBy(F.col("parent_owner").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("remaining"))
    own = nodes.select("owner", "depth", F.when(hangs, F.col("parent_owner")).alias("up_owner"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    left = stage(own.join(waits, ["owner", "depth"], "left").fillna(0, ["remaining"]), "open")
    add, finished = lambda a, b: a + b, []
    while True:
        blocked = left.filter("remaining > 0").select("owner").distinct()
        ready = stage(left.join(blocked, "owner", "left_anti").drop("remaining"), "ready")
        done = stage(running(ready, "owner", -F.col("depth"), {c: F.sum for c in ("n_leaves", "saved")}, add), "done")
        finished.append(done.select("owner", "depth", "n_leaves", "saved"))
        sent = done.filter("up_owner IS NOT NULL").groupBy(F.col("up_owner").alias("owner"), (F.col("depth") - 1).alias("depth"))
        sent = sent.agg(F.count("*").alias("came"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        got = left.join(blocked, "owner", "left_semi").join(sent, ["owner", "depth"], "left").fillna(0, ["came", "more_leaves", "more_saved"])
        now = got.select("owner", "depth", "up_owner", (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"), (F.col("remaining") - F.col("came")).alias("remaining"))
        rest = stage(now, "open")
        unstage(left, ready)
        left = rest
        if left.isEmpty():
            unstage(left)
            return reduce(DataFrame.unionByName, finished)


def _list_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of stored ends (node, conv_id): the ids in ascending order, comma-joined, hashed as they stream.

    Ids are listed in chunks by ranges of nodes and ids, so that a node of any number of ends is many tasks; its one digest
    then reads the chunks, some thousands of ids each.
    """
    columns = ("depth", "p1", "p2", "conv_id")
    flat = ends.select("node.*", "conv_id").repartitionByRange(*columns).sortWithinPartitions(*columns)
    kinds = [pa.int64()] * 4

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size, out = None, [], 0, []
        for b in batches:
            for *node, c in zip(*(x.to_pylist() for x in b.columns)):
                if node != now or size >= CHUNK:
                    out += [(*now, ids[0], ",".join(map(str, ids)))] if ids else []
                    now, ids, size = node, [], 0
                ids.append(c)
                size += 12
            yield listed(out)
            out = []
        if ids:
            yield listed([(*now, ids[0], ",".join(map(str, ids)))])

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([*kinds, pa.string()])], [*columns, "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for b in batches:
            for *node, _, ids in zip(*(x.to_pylist() for x in b.columns)):
                if node != now:
                    out += [(*now, sha.hexdigest())] if now else []
                    now, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield hashed(out)
            out = []
        if now:
            yield hashed([(*now, sha.hexdigest())])

    def hashed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([*kinds[:3], pa.string()])], [*columns[:3], "ends_sha256"])

    parts = flat.mapInArrow(chunks, "depth long, p1 long, p2 long, conv_id long, ids string").repartition("depth", "p1", "p2").sortWithinPartitions(*columns)
    return parts.mapInArrow(digests, "depth long, p1 long, p2 long, ends_sha256 string").select(F.struct("depth", "p1", "p2").alias("node"), "ends_sha256")


def trie(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each node of the trie of paths (conv_id, depth from 1 without gaps, item binary, words): conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    sizes (conv_id, ...) has each conversation once, those without turns too, which end at the root. No conversations give no
    nodes. saved_tokens counts the words of a node's turn once for each member but one, summed over its subtree.
    """
    named = _named(paths)
    nodes = _nodes(named, sizes)
    root = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2")))
    ends = sizes.select("conv_id").join(named.groupBy("conv_id").agg(F.max("node").alias("node")), "conv_id", "left")
    ends = stage(ends.select(F.coalesce("node", root).alias("node"), "conv_id"), "ends")
    digests = stage(_list_digests(ends), "digests")
    unstage(named, ends)
    out = nodes.join(peeled(nodes), ["owner", "depth"]).join(digests, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*with_shared_openings(turns(table(spark, sf_dir, "conversations"))))


ORACLE = rf"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, {crc_sql('digits')} % 4 AS h FROM (SELECT conv_id, hex(encode(conv_id::VARCHAR)) AS digits FROM (SELECT DISTINCT conv_id FROM c))),
r AS (SELECT k.conv_id, c.pos, c.role, c.text FROM k JOIN c ON c.conv_id = k.conv_id AND c.pos >= h UNION ALL SELECT k.conv_id, c.pos, c.role, c.text FROM k JOIN c ON c.conv_id = k.conv_id - k.conv_id % 20 AND c.pos < h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text FROM r),
p AS (SELECT conv_id, depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM q
  UNION ALL SELECT conv_id, 0, '', 0 FROM k),
l AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT node, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM l GROUP BY node, depth),
kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up, depth - 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node, depth)),
s AS (SELECT p.node, p.depth, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words)::BIGINT AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.node, p.depth)
SELECT m.conv_id, m.depth, b.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (node, depth) LEFT JOIN n b ON b.node = m.up AND b.depth = m.depth - 1
"""
