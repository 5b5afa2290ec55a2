"""Tar archives: an index of plain ones, found by ranges of blocks, and bundles (gzip) read as streams and held against their manifests.

Headers are looked for in all blocks of 512 bytes at once, each range in its own task; a body may hold what looks like one, so
the true ones are those that lead from one to the next from the file's beginning, which pointer doubling finds in as many
rounds as the logarithm of their number. Files must be in a store that pyarrow can open.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..operators import bundles
from ..storage import stage, unstage
from .pbf import _opened

BLOCK, CHUNK = 512, 1 << 20
#: Bytes of a file that one task reads, unless the option says otherwise; whole blocks.
RANGE = 64 << 20
#: Most bytes of an extended header whose name counts, and of a manifest.
PAX_MOST, MANIFEST_MOST = 65536, 1 << 20

BLOCKS = "file string, pos long, end long, kind string, name string, size long, file_size long"
OCTAL = np.zeros(256, bool)
OCTAL[[0, 32, *range(48, 56)]] = True


def octal(field: bytes) -> int:
    """The number that the field begins with, 0 if there is none."""
    found = re.match(rb"[ \0]*([0-7]+)", field)
    return int(found[1], 8) if found else 0


def checksum_holds(head: bytes) -> bool:
    return sum(head) - sum(head[148:156]) + 8 * 32 == octal(head[148:156])


def text(field: bytes) -> str:
    return field.decode("utf-8", "replace").rstrip("\0")


def padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


class Range(InputPartition):
    def __init__(self, file: str, size: int, start: int, end: int):
        super().__init__((file, size, start, end))


def files_of(path: str, endings: tuple[str, ...]) -> list[fs.FileInfo]:
    store, at = _opened(path)
    info = store.get_file_info(at)
    files = [info] if info.is_file else sorted((i for i in store.get_file_info(fs.FileSelector(at)) if i.is_file and i.path.endswith(endings)), key=lambda i: i.path)
    if not files:
        raise FileNotFoundError(path)
    return files


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range = options["path"], padded(int(options.get("range", RANGE)))

    def partitions(self) -> list[Range]:
        return [Range(f.path, f.size, at, min(at + self.range, f.size)) for f in files_of(self.path, (".tar",)) for at in range(0, f.size, self.range)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        file, size, start, end = partition.value
        store, _ = _opened(self.path)
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        with store.open_input_file(file) as source:
            zero = None  # where the present run of empty blocks began
            for at in range(start, end - BLOCK + 1, CHUNK):
                source.seek(at)
                data = source.read(min(CHUNK, end - at) // BLOCK * BLOCK)
                blocks = np.frombuffer(data, np.uint8).reshape(-1, BLOCK)
                empty = ~blocks.any(axis=1)
                plausible = np.flatnonzero(~empty & OCTAL[blocks[:, 148:156]].all(axis=1))
                change = np.flatnonzero(np.diff(empty, prepend=np.array([zero is not None])))
                rows = []
                for i in change:
                    if empty[i]:
                        zero = at + int(i) * BLOCK
                    else:
                        rows.append((file, zero, at + int(i) * BLOCK, "zero", None, 0, size))
                        zero = None
                for i in plausible:
                    head = data[i * BLOCK : (i + 1) * BLOCK]
                    if checksum_holds(head):
                        rows.append(self.header(source, file, size, at + int(i) * BLOCK, head))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=ARROW)
            if zero is not None:
                yield pa.RecordBatch.from_pydict(dict(zip(names, ([v] for v in (file, zero, start + (end - start) // BLOCK * BLOCK, "zero", None, 0, size)))), schema=ARROW)

    def header(self, source, file: str, size: int, pos: int, head: bytes) -> tuple:
        own, kind, prefix = octal(head[124:136]), chr(head[156]), text(head[345:500])
        name = text(head[:100])
        end = pos + BLOCK + padded(own)
        if kind not in "xg":
            return file, pos, end, "file" if kind in "0\0" else "other", f"{prefix}/{name}" if prefix else name, own, size
        named = None
        if 0 < own < PAX_MOST:
            source.seek(pos + BLOCK)
            if found := re.search(r"\d+ path=(.+)\n", source.read(own).decode("utf-8", "replace")):
                named = found[1]
        return file, pos, end, "pax", named, own, size


ARROW = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("file_size", pa.int64())])


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meridian_tar"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def reached(steps: DataFrame) -> DataFrame:
    """(file, pos) of stored steps (file, pos, end) that lie on the way from 0, each end being the next pos. Stored."""
    jumps = stage(steps.select("file", "pos", "end"), "jumps")
    found = stage(steps.filter("pos = 0").select("file", "pos"), "reached")
    count = found.count()
    while True:
        on = found.join(jumps, ["file", "pos"]).select("file", F.col("end").alias("pos")).join(steps.select("file", "pos"), ["file", "pos"])
        more = stage(found.union(on).distinct(), "reached")
        unstage(found)
        found, before, count = more, count, more.count()
        if count == before:
            unstage(jumps)
            return found
        twice = stage(jumps.join(jumps.select("file", F.col("pos").alias("end"), F.col("end").alias("after")), ["file", "end"]).select("file", "pos", F.col("after").alias("end")), "jumps")
        unstage(jumps)
        jumps = twice


def chain(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The blocks (file, pos, end, kind, name, size, file_size) that are headers (kind file, pax, other) or begin empty stretches
    (zero), and those where a header should be and none holds (damaged). Stored."""
    spark.dataSource.register(TarSource)
    found = stage(spark.read.format("meridian_tar").option("range", str(range_bytes)).load(path), "blocks")
    span = padded(range_bytes)
    # where a header leads to the midst of an empty stretch, it leads to its end; ranges bound what is looked through
    place = lambda c: F.floor(F.col(c) / span)
    zeros = found.filter("kind = 'zero'").select("file", place("pos").alias("range"), F.col("pos").alias("at"), F.col("end").alias("to"))
    asked = found.filter("kind <> 'zero'").select("file", place("end").alias("range"), F.col("end").alias("at"), F.lit(None).cast("long").alias("to"), "pos")
    until = Window.partitionBy("file", "range").orderBy("at", F.col("pos").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    led = zeros.withColumn("pos", F.lit(None).cast("long")).unionByName(asked).withColumn("last", F.last("to", True).over(until)).filter("pos IS NOT NULL")
    led = led.select("file", "pos", F.greatest("at", "last").alias("led"))
    steps = stage(found.join(led, ["file", "pos"], "left").withColumn("end", F.coalesce("led", "end")).drop("led"), "steps")
    unstage(found)
    on = reached(steps)
    good = steps.join(on, ["file", "pos"])
    starts = steps.select("file", "file_size").distinct().select("file", F.lit(0).cast("long").alias("pos"), "file_size")
    lost = good.select("file", F.col("end").alias("pos"), "file_size").union(starts).filter(F.col("pos") + BLOCK <= F.col("file_size")).join(steps, ["file", "pos"], "left_anti").distinct()
    out = stage(good.unionByName(lost.withColumns({"end": F.col("pos"), "kind": F.lit("damaged")}), allowMissingColumns=True), "chain")
    unstage(steps, on)
    return out


def entries(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, name, offset, size) of the regular files in a tar archive, or in those of a folder; pos orders them.

    Empty entries and those that the file ends within are left out. An extended header names the next regular file, over
    empty blocks, unless an entry of another kind or a later name comes between. A block that should be a header and fails
    its checksum fails the job with its file and place.
    """
    blocks = chain(spark, path, range_bytes)
    if bad := blocks.filter("kind = 'damaged'").orderBy("file", "pos").first():
        raise ValueError(f"{bad.file}: no valid header at {bad.pos}")
    # names move on from block to block until they come to a regular file; there are as many rounds as such blocks in a row
    plain = blocks.filter("kind = 'file'")
    moving = blocks.filter("kind = 'pax' AND name IS NOT NULL").select("file", F.col("end").alias("pos"), F.col("name").alias("named"))
    named = plain.select("file", "pos", F.lit(None).cast("string").alias("named")).limit(0)
    over = blocks.filter("kind = 'zero' OR kind = 'pax' AND name IS NULL").select("file", "pos", "end")
    while not moving.isEmpty():
        named = named.unionByName(moving.join(plain.select("file", "pos"), ["file", "pos"]))
        moving = stage(moving.join(over, ["file", "pos"]).select("file", F.col("end").alias("pos"), "named"), "names")
    rows = plain.join(named, ["file", "pos"], "left").filter((F.col("size") > 0) & (F.col("pos") + BLOCK + F.col("size") <= F.col("file_size")))
    return rows.select("file", "pos", F.coalesce("named", "name").alias("name"), (F.col("pos") + BLOCK).alias("offset"), "size")


def hashed(found: DataFrame, path: str) -> DataFrame:
    """entries() with sha256 of their bodies, read by ranges of a MB, each entry in one task."""

    def run(frames):
        store, _ = _opened(path)
        for f in frames:
            out = []
            for file, offset, size in zip(f["file"], f["offset"], f["size"]):
                digest = hashlib.sha256()
                with store.open_input_file(file) as source:
                    source.seek(offset)
                    while size and (data := source.read(min(size, CHUNK))):
                        digest.update(data)
                        size -= len(data)
                out.append(digest.hexdigest())
            yield f.assign(sha256=out)

    return found.repartition(F.hash("file", "pos")).mapInPandas(run, found.withColumn("sha256", F.lit("")).schema)


def _stream(source) -> Iterator[tuple]:
    """(name, bytes, sha256, manifest, problem) of a bundle's entries; the first problem ends it."""
    seen: set[str] = set()
    try:
        with gzip.GzipFile(fileobj=source) as data:
            while True:
                head = data.read(BLOCK)
                if len(head) < BLOCK:
                    return (yield None, None, None, None, "truncated")
                if not any(head):
                    break
                cut = lambda b: b.split(b"\0")[0].decode("utf-8", "replace")
                if not checksum_holds(head) or cut(head[257:263]) != "ustar":
                    return (yield None, None, None, None, "invalid header")
                name, size = cut(head[:100]), re.match(r"\s*([0-7]+)", cut(head[124:136]))
                if head[345] or head[156] not in (0, 48) or not size or name in seen:
                    return (yield name, None, None, None, "unsafe entry")
                size, first = int(size[1], 8), not seen
                if (name == "manifest.json") != first or first and size > MANIFEST_MOST:
                    return (yield name, size, None, None, "the manifest must be the first entry")
                seen.add(name)
                digest, left, kept = hashlib.sha256(), size, []
                while left:
                    part = data.read(min(left, CHUNK))
                    if not part:
                        return (yield name, size, None, None, "truncated")
                    digest.update(part)
                    left -= len(part)
                    if first:
                        kept.append(part)
                if len(data.read(padded(size) - size)) < padded(size) - size:
                    return (yield name, size, None, None, "truncated")
                yield name, size, digest.hexdigest(), b"".join(kept).decode("utf-8", "replace") if first else None, None
            while part := data.read(CHUNK):
                if part.strip(b"\0"):
                    return (yield None, None, None, None, "trailing data")
    except (OSError, EOFError, zlib.error) as e:
        yield None, None, None, None, f"damaged gzip: {e}"


STREAMED = "bundle string, seq long, name string, bytes long, sha256 string, manifest string, problem string"


def streamed(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, seq, name, bytes, sha256, manifest, problem): the entries of the gzipped bundles of a folder. A bundle is one
    task, as gzip can only be read from its beginning; it holds a MB of it at a time."""
    files = spark.createDataFrame([(f.path,) for f in files_of(path, (".tar.gz", ".tgz"))], "bundle string")

    def run(frames):
        store, _ = _opened(path)
        for f in frames:
            for bundle in f["bundle"]:
                with store.open_input_file(bundle) as source:
                    rows = [(bundle, k, *row) for k, row in enumerate(_stream(source))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in STREAMED.split(", ")]).astype({"bytes": "Int64"})

    return files.repartition(F.col("bundle")).mapInPandas(run, STREAMED)


def gate(read: DataFrame, form: str, formats: dict[str, tuple[str, str]]) -> DataFrame:
    """(bundle, name, problem) of streamed() bundles that must not be installed: what ended the reading, what is wrong with the
    manifest, and where it and the entries differ. read must be stored."""
    broken = read.filter("problem IS NOT NULL").select("bundle", "name", "problem")
    texts = read.select("bundle").distinct().join(read.filter("seq = 0").select("bundle", "manifest"), "bundle", "left").withColumn("m", bundles.parsed(F.col("manifest")))
    wrong = texts.withColumn("problem", bundles.problem(F.col("m"), form, formats)).filter("problem IS NOT NULL").select("bundle", F.lit("manifest.json").alias("name"), "problem")
    listed = texts.select("bundle", F.explode("m.artifacts").alias("a")).select("bundle", "a.name", "a.bytes", "a.sha256")
    held = read.filter("seq > 0 AND sha256 IS NOT NULL").select("bundle", "name", "bytes", "sha256")
    return broken.unionByName(wrong.join(broken.select("bundle").distinct(), "bundle", "left_anti")).unionByName(bundles.mismatches(listed, held))
