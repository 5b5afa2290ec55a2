"""Tile archives: directories, leaves, one file, damaged input."""

import gzip
import random
import struct

import numpy as np
import pytest

from meridian.operators.tiles import dedup_runs
from meridian.sources import pmtiles


def test_directories_round_trip():
    r = np.random.default_rng(1)
    ids, runs, lengths = np.cumsum(r.integers(1, 10**6, 5000)), r.integers(0, 9, 5000), r.integers(1, 10**5, 5000)
    offsets = np.where(r.random(5000) < 0.5, np.concatenate(([0], np.cumsum(lengths)[:-1])), r.integers(0, 10**12, 5000))
    for got, want in zip(pmtiles.entries_of(pmtiles.directory(ids, runs, lengths, offsets)), (ids, runs, lengths, offsets)):
        assert (got == want).all()
    assert all(len(c) == 0 for c in pmtiles.entries_of(pmtiles.directory(*[np.empty(0)] * 4)))
    for bad in (b"", gzip.compress(b""), gzip.compress(b"\x02\x01"), gzip.compress(b"\x01\x05\x01\x01\x00"), gzip.compress(b"\x81")):
        with pytest.raises(ValueError):
            pmtiles.entries_of(bad)


@pytest.mark.parametrize("small,most", [(1 << 16, 16257), (0, 16257), (0, 60)])
def test_archives_are_read_back(spark, tmp_path, monkeypatch, small, most):
    """As one root, with leaves, and with leaves that double until the root is small."""
    monkeypatch.setattr(pmtiles, "ROOT_MOST", most)
    monkeypatch.setattr(pmtiles, "LEAF", 8)
    r = random.Random(4)
    tiles = {k: b"sea" if r.random() < 0.4 else bytes(r.choices(range(256), k=r.choice([1, 50, 3000]))) if r.random() < 0.8 else b"park" for k in sorted(r.sample(range(2000), 700))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in tiles.items()] + [(5000, None)], "tile_id long, data binary").repartition(3)
    path = f"file://{tmp_path}/archive"
    pmtiles.write(df, path, (0, 6), (-10.0, -20.0, 30.0, 40.0), {"name": "x"}, small=small)
    parts = pmtiles.pieces(spark, path)
    h = pmtiles.header(parts)
    runs = dedup_runs(df.filter("data IS NOT NULL"))
    assert (h["addressed"], h["entries"], h["contents"]) == (len(tiles), runs.count(), len(set(tiles.values()))) and h["zooms"] == (0, 6) and h["box"] == (-10.0, -20.0, 30.0, 40.0)
    assert (h["leaves"] == 0) == (small > 0) and h["root"] <= most or most < 100
    assert {x["tile_id"]: bytes(x["data"]) for x in pmtiles.read(parts).collect()} == tiles
    pmtiles.save(parts, f"file://{tmp_path}/one.pmtiles")
    whole = (tmp_path / "one.pmtiles").read_bytes()
    assert len(whole) == h["data_at"] + h["data"] == struct.unpack_from("<Q", whole, 56)[0] + struct.unpack_from("<Q", whole, 64)[0]
    monkeypatch.setattr(pmtiles, "CELL", 100)
    again = pmtiles.pieces_of_file(spark, f"file://{tmp_path}/one.pmtiles")
    assert {x["tile_id"]: bytes(x["data"]) for x in pmtiles.read(again).collect()} == tiles


def test_odd_archives(spark, tmp_path):
    none = spark.createDataFrame([], "tile_id long, data binary")
    pmtiles.write(none, f"file://{tmp_path}/none", (0, 0), (0.0, 0.0, 0.0, 0.0), {})
    assert pmtiles.read(pmtiles.pieces(spark, f"file://{tmp_path}/none")).count() == 0
    for bad in (b"PMTiles\x02" + bytes(200), b"PM"):
        with pytest.raises(ValueError):
            pmtiles.header(spark.createDataFrame([(0, bytearray(bad))], "offset long, bytes binary"))
