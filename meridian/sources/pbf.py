"""Map extracts in the PBF format, as DataFrames of nodes, ways and relations.

elements() is a data source of its own: the driver walks the blobs' headers with seeks, a partition is a range of blobs, and
a task reads and decodes one blob after the other, so files of any size are read by ranges. Filters on kind and on a
box of coordinates reach the decoder, which then makes no rows for what they rule out. The files must be in a store that
pyarrow can open. whole_files() reads them as Spark reads binary files, from any store it knows: at most 2 GB each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Most bytes of a blob's header and of its inflated content that the format allows.
HEADER_MOST, BLOB_MOST = 64 << 10, 96 << 20
#: Bytes of a file that one task reads, unless the option says otherwise.
RANGE = 64 << 20
COMPRESSIONS = {4: "lzma", 5: "bzip2", 6: "lz4", 7: "zstd"}
KNOWN = ("OsmSchema-V0.6", "DenseNodes", "HistoricalInformation")
TAGS = "map<string,string>"


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields; an integer, or the bytes of a field that has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"field of unknown kind {kind}")
        if at > len(data):
            raise ValueError("truncated message")
        yield key >> 3, value


def varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated number")
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def packed(data: memoryview) -> np.ndarray:
    """The numbers of a packed field, at once: each ends at a byte under 128."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    if b[-1] > 127:
        raise ValueError("truncated number")
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def signed(n: np.ndarray) -> np.ndarray:
    return ((n >> np.uint64(1)).astype(np.int64)) ^ -(n & np.uint64(1)).astype(np.int64)


def as_signed(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def blobs(data: memoryview) -> Iterator[tuple[str, memoryview]]:
    """(kind, blob) of a file, in order; a file that ends within a blob raises ValueError."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("truncated file")
        (size,) = struct.unpack(">I", data[at : at + 4])
        if size > HEADER_MOST:
            raise ValueError("not a PBF file")
        head = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        end = at + head[3]
        if end > len(data):
            raise ValueError("truncated file")
        yield bytes(head[1]).decode(), data[at:end]
        at = end


def inflated(blob: memoryview) -> memoryview:
    """A blob's content. What it inflates to is bounded whatever size it declares; unknown compressions are named."""
    found = dict(fields(blob))
    if 1 in found and len(found[1]) <= BLOB_MOST:
        return found[1]
    if 3 not in found:
        raise ValueError(f"blob of compression {next((COMPRESSIONS[k] for k in found if k in COMPRESSIONS), 'none, too large' if 1 in found else 'unknown')}")
    if found.get(2, 0) > BLOB_MOST:
        raise ValueError("blob of too large a size")
    engine = zlib.decompressobj()
    data = engine.decompress(found[3], BLOB_MOST + 1)
    if len(data) > BLOB_MOST:
        raise ValueError("blob of too large a size")
    if not engine.eof:
        raise ValueError("truncated blob")
    return memoryview(data)


def grouped(message: memoryview) -> dict[int, list]:
    """A message's values by field, as often as they come."""
    found = {}
    for k, v in fields(message):
        found.setdefault(k, []).append(v)
    return found


def numbers(parts: list) -> np.ndarray:
    """The numbers of a repeated field, whose parts may each be packed or alone."""
    if len(parts) == 1 and not isinstance(parts[0], int):
        return packed(parts[0])
    return np.concatenate([np.empty(0, np.uint64), *(np.array([p], np.uint64) if isinstance(p, int) else packed(p) for p in parts)])


def deleted(info: list) -> bool:
    """Whether an element's own history says that it is not visible."""
    return any(k == 6 and not v for part in info for k, v in fields(part))


def check_header(blob: memoryview) -> None:
    needs = [bytes(v).decode() for k, v in fields(inflated(blob)) if k == 4]
    if unknown := [n for n in needs if n not in KNOWN]:
        raise ValueError(f"needs {unknown}")


EVERYWHERE = (-float("inf"), -float("inf"), float("inf"), float("inf"))


def block(data: memoryview, kinds: str = "nwr", box: tuple[float, float, float, float] = EVERYWHERE) -> Iterator[tuple]:
    """(kind, id, lat, lon, refs, types, roles, tags) of a block's elements of these kinds; kind is n, w or r. Nodes outside
    the box (west, south, east, north) and elements that a history marks as deleted are left out."""
    strings, groups, step, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(data):
        if k == 1:
            strings = [bytes(s).decode("utf-8", "replace") for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            step = v
        elif k in (19, 20):
            v = v - (1 << 64) if v >> 63 else v
            lat0, lon0 = (v, lon0) if k == 19 else (lat0, v)
    place = lambda base, n: (base + step * n) / 1e9
    tagged = lambda m: list(zip((strings[k] for k in numbers(m.get(2, [])).tolist()), (strings[v] for v in numbers(m.get(3, [])).tolist())))
    west, south, east, north = box
    for group in groups:
        for k, v in fields(group):
            if k in (1, 2) and "n" not in kinds or k == 3 and "w" not in kinds or k == 4 and "r" not in kinds or k > 4:
                continue
            m = grouped(v)
            if k == 1:
                lat, lon = place(lat0, as_signed(m[8][-1])), place(lon0, as_signed(m[9][-1]))
                if west <= lon <= east and south <= lat <= north and not deleted(m.get(4, [])):
                    yield "n", as_signed(m[1][-1]), lat, lon, None, None, None, tagged(m)
            elif k == 2:
                ids, lats, lons = (np.cumsum(signed(numbers(m.get(n, [])))) for n in (1, 8, 9))
                lats, lons = place(lat0, lats), place(lon0, lons)
                kept = (lons >= west) & (lons <= east) & (lats >= south) & (lats <= north)
                seen = numbers([p for part in m.get(5, []) for n, p in fields(part) if n == 6])
                if len(seen):
                    kept &= seen.astype(bool)
                keys = numbers(m.get(10, [])).astype(np.int64)
                ends = np.flatnonzero(keys[: len(keys)] == 0)
                if len(keys):  # keys and values are never 0, which closes a node's list
                    starts = np.concatenate(([0], ends[:-1] + 1))
                for j in np.flatnonzero(kept).tolist():
                    own = keys[starts[j] : ends[j]].tolist() if len(keys) else []
                    yield "n", int(ids[j]), float(lats[j]), float(lons[j]), None, None, None, [(strings[a], strings[b]) for a, b in zip(own[::2], own[1::2])]
            elif deleted(m.get(4, [])):
                continue
            elif k == 3:
                yield "w", m[1][-1], None, None, np.cumsum(signed(numbers(m.get(8, [])))).tolist(), None, None, tagged(m)
            elif k == 4:
                roles = [strings[r] for r in numbers(m.get(8, [])).tolist()]
                types = [("node", "way", "relation")[t] for t in numbers(m.get(10, [])).tolist()]
                yield "r", m[1][-1], None, None, np.cumsum(signed(numbers(m.get(9, [])))).tolist(), types, roles, tagged(m)


SCHEMA = f"file string, seq int, at int, kind string, id long, lat double, lon double, refs array<long>, types array<string>, roles array<string>, tags {TAGS}"
NAMES = ["file", "seq", "at", "kind", "id", "lat", "lon", "refs", "types", "roles", "tags"]
KINDS = (pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()))


def _batches(file: str, seq: int, blob: memoryview, *only) -> Iterator[pa.RecordBatch]:
    rows = [(at, *e[:-1], list(dict(e[-1]).items())) for at, e in enumerate(block(inflated(blob), *only))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([seq] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*rows), KINDS))], NAMES)


class Blobs(InputPartition):
    """Blobs of a file: from one's place and number up to a place."""

    def __init__(self, file: str, seq: int, start: int, end: int):
        self.file, self.seq, self.start, self.end = file, seq, start, end


def _exactly(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) < n:
        raise ValueError("truncated file")
    return data


def _next(source) -> tuple[str, int] | None:
    """(kind, bytes) of the blob that comes next, whose header is read past; None at the end of the file."""
    head = source.read(4)
    if not head:
        return None
    if len(head) < 4:
        raise ValueError("truncated file")
    (size,) = struct.unpack(">I", head)
    if size > HEADER_MOST:
        raise ValueError("not a PBF file")
    found = dict(fields(memoryview(_exactly(source, size))))
    if found[3] > BLOB_MOST + HEADER_MOST:
        raise ValueError("blob of too large a size")
    return bytes(found[1]).decode(), found[3]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class PbfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range = options["path"], int(options.get("range", RANGE))
        self.kinds, self.box = "nwr", list(EVERYWHERE)

    def pushFilters(self, filters):
        """Takes equality of kind and bounds of lat and lon in; all are still tested by Spark, so bounds may be taken wider."""
        for f in filters:
            of = getattr(f, "attribute", None)
            if isinstance(f, EqualTo) and of == ("kind",):
                self.kinds = "".join(k for k in self.kinds if k == f.value)
            elif isinstance(f, In) and of == ("kind",):
                self.kinds = "".join(k for k in self.kinds if k in f.value)
            elif of in (("lon",), ("lat",)) and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.kinds = self.kinds.replace("w", "").replace("r", "")  # only nodes lie somewhere
                low, at = isinstance(f, (GreaterThan, GreaterThanOrEqual)), 0 if of == ("lon",) else 1
                self.box[at if low else at + 2] = max(self.box[at], f.value) if low else min(self.box[at + 2], f.value)
            yield f

    def partitions(self) -> list[Blobs]:
        """Ranges of whole blobs; reads the blobs' headers alone."""
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else sorted((i for i in store.get_file_info(fs.FileSelector(path)) if i.is_file and i.path.endswith(".pbf")), key=lambda i: i.path)
        if not files:
            raise FileNotFoundError(path)
        found = []
        for file in files:
            with store.open_input_file(file.path) as source:
                seq, start, first = 0, 0, 0
                while blob := _next(source):
                    kind, size = blob
                    end = source.tell() + size
                    if end > file.size:
                        raise ValueError("truncated file")
                    if kind == "OSMHeader":
                        check_header(memoryview(_exactly(source, size)))
                    source.seek(end)
                    seq += 1
                    if end - start >= self.range or end == file.size:
                        found.append(Blobs(file.path, first, start, end))
                        start, first = end, seq
        return found

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        with store.open_input_file(partition.file) as source:
            source.seek(partition.start)
            seq = partition.seq
            while source.tell() < partition.end:
                kind, size = _next(source)
                blob = memoryview(_exactly(source, size))
                if kind == "OSMData" and self.kinds:
                    yield from _batches(partition.file, seq, blob, self.kinds, tuple(self.box))
                seq += 1


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meridian_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options)


def elements(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, seq, at, kind, id, lat, lon, refs, types, roles, tags): the elements of a PBF file, or of those of a folder, at
    their places in the files; at counts a blob's rows, so it is a place among those that filters leave.

    Of a key that comes twice the last value counts; elements marked as deleted are left out. Damaged files and those that
    need unknown features fail the job.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PbfSource)
    return spark.read.format("meridian_pbf").option("range", str(range_bytes)).load(path)


def whole_files(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """elements() of files that only Spark can open, each of them in one row of a task before its blobs are dealt out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                for seq, (kind, blob) in enumerate(blobs(memoryview(content.as_buffer()).cast("B"))):
                    if kind == "OSMHeader":
                        check_header(blob)
                    elif kind == "OSMData":
                        yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([seq], pa.int32()), pa.array([bytes(blob)])], ["file", "seq", "blob"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, seq, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                yield from _batches(file, seq, memoryview(blob.as_buffer()).cast("B"))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    dealt = files.mapInArrow(cut, "file string, seq int, blob binary").repartition(tasks or spark.sparkContext.defaultParallelism, "file", "seq")
    return dealt.mapInArrow(decode, SCHEMA)


def nodes(found: DataFrame) -> DataFrame:
    """(id, lat, lon, tags) as the XML source has them: coordinates in range, the last of an id."""
    ok = found.filter("kind = 'n' AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
    rows = ok.groupBy("id").agg(F.max_by(F.struct("lat", "lon", "tags"), F.struct("file", "seq", "at")).alias("v"))
    return rows.select("id", "v.*")


def ways(found: DataFrame) -> DataFrame:
    """(id, refs, tags) of ways with a tag and two references."""
    return found.filter("kind = 'w' AND size(refs) >= 2 AND size(tags) >= 1").select("id", "refs", "tags")


def relations(found: DataFrame) -> DataFrame:
    """(id, members array<struct<type, ref, role>>, tags)."""
    members = F.transform(F.arrays_zip("types", "refs", "roles"), lambda m: F.struct(m["types"].alias("type"), m["refs"].alias("ref"), m["roles"].alias("role")))
    return found.filter("kind = 'r'").select("id", members.alias("members"), "tags")
