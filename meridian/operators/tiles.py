"""Map tiles: cover, Hilbert order, content dedup and runs, vector-tile and polyline encoding."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geo import hilbert_id, mercator, tile_of


def points_to_tiles(points: DataFrame, zoom: int) -> DataFrame:
    m = points.withColumn("_m", mercator(F.col("lon"), F.col("lat")))
    t = m.withColumns({"x": tile_of(F.col("_m.x"), zoom), "y": tile_of(F.col("_m.y"), zoom)}).drop("_m")
    return t.withColumn("tile_id", hilbert_id(zoom, F.col("x"), F.col("y")))


def cover(boxes: DataFrame, zoom: int, buffer: float = 0.08) -> DataFrame:
    """boxes (id, west, south, east, north): a row (id, x, y) for each tile that a box touches, widened by a buffer."""
    n = 1 << zoom
    clamp = lambda c: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(c))).cast("int")
    a, b = mercator(F.col("west"), F.col("north")), mercator(F.col("east"), F.col("south"))
    xs = F.sequence(clamp(a["x"] * n - buffer), clamp(b["x"] * n + buffer))
    ys = F.sequence(clamp(a["y"] * n - buffer), clamp(b["y"] * n + buffer))
    return boxes.select("id", xs.alias("xs"), ys.alias("ys")).withColumn("x", F.explode("xs")).withColumn("y", F.explode("ys")).select("id", "x", "y")


def dedup_runs(tiles: DataFrame) -> DataFrame:
    """tiles (tile_id, data): consecutive ids of equal content as (first_id, run_length, hash).

    Windows run within ranges of 4096 ids, then once more over the ranges' first and last runs, so no task sees all."""
    hashed = tiles.select("tile_id", F.sha2("data", 256).alias("hash")).withColumn("block", F.floor(F.col("tile_id") / 4096))
    order = Window.partitionBy("block", "hash").orderBy("tile_id")
    runs = hashed.withColumn("g", F.col("tile_id") - F.row_number().over(order)).groupBy("block", "hash", "g").agg(F.min("tile_id").alias("first_id"), F.max("tile_id").alias("last_id"))
    edge = (F.col("first_id") % 4096 == 0) | (F.col("last_id") % 4096 == 4095)
    inner = runs.filter(~edge).select("first_id", "last_id", "hash")
    chain = Window.partitionBy("hash").orderBy("first_id")
    outer = runs.filter(edge).withColumn("new", F.coalesce((F.lag("last_id").over(chain) + 1 != F.col("first_id")).cast("int"), F.lit(1)))
    outer = outer.withColumn("c", F.sum("new").over(chain)).groupBy("hash", "c").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")).select("first_id", "last_id", "hash")
    return inner.unionByName(outer).select("first_id", (F.col("last_id") - F.col("first_id") + 1).alias("run_length"), "hash")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _zigzag(n: int) -> int:
    return n << 1 ^ n >> 63


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _geometry(paths: list, polygon: bool) -> bytes:
    """Commands of a feature's paths, each from where the one before ended; paths with too few points are left out."""
    out, x0, y0 = [], 0, 0
    for path in paths:
        if len(path) < (3 if polygon else 2):
            continue
        for k, p in enumerate(path):
            out += [9] if k == 0 else [len(path) - 1 << 3 | 2] if k == 1 else []
            out += [_zigzag(p["x"] - x0), _zigzag(p["y"] - y0)]
            x0, y0 = p["x"], p["y"]
        out += [15] if polygon else []
    return b"".join(map(_varint, out))


@F.arrow_udf(T.BinaryType())
def _feature(kind: pa.Array, name: pa.Array, polygon: pa.Array, paths: pa.Array) -> pa.Array:
    made = []
    for k, n, area, parts in zip(*(c.to_pylist() for c in (kind, name, polygon, paths))):
        tags = _varint(0) + _varint(k) + (b"" if n is None else _varint(1) + _varint(n))
        made.append(_field(2, _field(2, tags) + _varint(3 << 3) + _varint(3 if area else 2) + _field(4, _geometry(parts, area))))
    return pa.array(made, pa.binary())


@F.arrow_udf(T.BinaryType())
def _layer(name: pa.Array, features: pa.Array, values: pa.Array) -> pa.Array:
    made = []
    for n, parts, words in zip(*(c.to_pylist() for c in (name, features, values))):
        body = _field(1, n.encode()) + b"".join(parts) + _field(3, b"class") + _field(3, b"name") + b"".join(_field(4, _field(1, v.encode())) for v in words)
        made.append(_field(3, body + _varint(5 << 3) + _varint(EXTENT) + _varint(15 << 3) + _varint(2)))
    return pa.array(made, pa.binary())


@F.arrow_udf(T.BinaryType())
def _joined(parts: pa.Array) -> pa.Array:
    return pa.array([b"".join(x) for x in parts.to_pylist()], pa.binary())


#: Steps of a tile's grid.
EXTENT = 4096


def encode_tiles(features: DataFrame) -> DataFrame:
    """features (tile_id, layer, seq, class, name, paths array<array<struct<x:int,y:int>>>, polygon): (tile_id, data), version
    2 vector tiles with layers by name and features by seq, an order of a layer's own.

    A layer's words are numbered in the order in which they come first, by a window over its distinct words; features are
    encoded row by row, so that only their bytes meet in a tile, which is one value in the end. A null name is no name.
    """
    rows = features.withColumn("name", F.coalesce("name", F.lit("")))
    layer = ["tile_id", "layer"]
    said = rows.select(*layer, F.posexplode(F.array("class", "name")).alias("at", "word"), "seq").groupBy(*layer, "word").agg(F.min(F.struct("seq", "at")).alias("first"))
    words = said.withColumn("number", F.row_number().over(Window.partitionBy(*layer).orderBy("first")) - 1)
    number = lambda word: words.select(*layer, F.col("word").alias(word), F.col("number").alias(f"{word}_id"))
    numbered = rows.join(number("class"), [*layer, "class"]).join(number("name"), [*layer, "name"])
    named = F.when(F.col("name") != "", F.col("name_id"))
    encoded = numbered.select(*layer, "seq", _feature("class_id", named, "polygon", "paths").alias("bytes"))
    listed = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    parts = encoded.groupBy(*layer).agg(listed("seq", "bytes").alias("parts"))
    whole = parts.join(words.groupBy(*layer).agg(listed("number", "word").alias("words")), layer)
    layers = whole.select("tile_id", "layer", _layer("layer", "parts", "words").alias("bytes"))
    return layers.groupBy("tile_id").agg(listed("layer", "bytes").alias("layers")).select("tile_id", _joined("layers").alias("data"))


def encode_polyline(points: list[tuple[float, float]], digits: int = 6) -> str:
    """(lon, lat) points as a polyline string."""
    out, last = [], (0, 0)
    for lon, lat in points:
        now = (round(lat * 10**digits), round(lon * 10**digits))
        for d in (now[0] - last[0], now[1] - last[1]):
            n = ~(d << 1) if d < 0 else d << 1
            while n >= 32:
                out.append(chr((n & 31 | 32) + 63))
                n >>= 5
            out.append(chr(n + 63))
        last = now
    return "".join(out)


def decode_polyline(text: str, digits: int = 6) -> list[tuple[float, float]]:
    """The (lon, lat) points of a polyline; a truncated or foreign string, or one with places off the earth, raises ValueError."""
    def numbers() -> Iterator[int]:
        n = shift = 0
        for c in text:
            v = ord(c) - 63
            if not 0 <= v < 64 or shift > 30:
                raise ValueError("not a polyline")
            n |= (v & 31) << shift
            shift += 5
            if v < 32:
                yield ~(n >> 1) if n & 1 else n >> 1
                n = shift = 0
        if shift:
            raise ValueError("truncated polyline")

    found, lat, lon, points = list(numbers()), 0, 0, []
    if len(found) % 2:
        raise ValueError("truncated polyline")
    for a, b in zip(found[::2], found[1::2]):
        lat, lon = lat + a, lon + b
        if abs(lat) > 90 * 10**digits or abs(lon) > 180 * 10**digits:
            raise ValueError("coordinates out of range")
        points.append((lon / 10**digits, lat / 10**digits))
    return points


# Points stay Arrow's columns of doubles, 16 bytes each; only those of one line at a time are Python's objects.


@F.arrow_udf(T.StringType())
def polyline(points: pa.Array) -> pa.Array:
    lines = (p.values for p in points)
    return pa.array([None if p is None else encode_polyline(list(zip(p.field("lon").to_pylist(), p.field("lat").to_pylist()))) for p in lines], pa.string())


@F.arrow_udf(T.ArrayType(T.StructType().add("lon", T.DoubleType()).add("lat", T.DoubleType())))
def from_polyline(text: pa.Array) -> pa.Array:
    lon, lat, ends = array("d"), array("d"), [0]
    for t in text:
        if t.is_valid:
            for a, b in decode_polyline(t.as_py()):
                lon.append(a)
                lat.append(b)
        ends.append(len(lon))
    points = pa.StructArray.from_arrays([pa.array(np.array(c, float), pa.float64()) for c in (lon, lat)], ["lon", "lat"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points, mask=text.is_null())
