import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from meridian.sources import tar
from meridian.storage import stage

BODY = bytes(range(256)) * 9


def add(out, name, data, kind=tarfile.REGTYPE):
    info = tarfile.TarInfo(name)
    info.size, info.type = len(data), kind
    out.addfile(info, io.BytesIO(data))


def archive(entries, form=tarfile.PAX_FORMAT):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w", format=form) as out:
        for e in entries:
            add(out, *e)
    return held.getvalue()


def test_entries_equal_the_library(spark, tmp_path):
    inner = archive([("not/an/entry", b"x" * 700)])
    many = [("0/001.gph", BODY), ("empty", b""), ("inner.tar", inner), ("long/" + "n" * 150, b"long"), ("zeros", bytes(5000)), ("d", b"", tarfile.DIRTYPE)] + [(f"t/{k}", b"%d" % k * k) for k in range(1, 40)]
    (tmp_path / "a.tar").write_bytes(archive(many))
    (tmp_path / "b.tar").write_bytes(archive([("0/1", b"1")])[:1024] + bytes(2048) + archive([("0/2", b"2")])[:1024] + bytes(4096))
    got = tar.entries(spark, str(tmp_path), 4096).orderBy("file", "pos").collect()
    with tarfile.open(tmp_path / "a.tar") as t:
        want = [(m.name, m.offset_data, m.size) for m in t if m.isfile() and m.size]
    assert [(r["name"], r["offset"], r["size"]) for r in got if r["file"].endswith("a.tar")] == want
    assert [(r["name"], r["offset"]) for r in got if r["file"].endswith("b.tar")] == [("0/1", 512), ("0/2", 3584)]
    hashes = {r["name"]: r["sha256"] for r in tar.hashed(tar.entries(spark, str(tmp_path / "a.tar")), str(tmp_path)).collect()}
    assert hashes["0/001.gph"] == hashlib.sha256(BODY).hexdigest() and hashes["inner.tar"] == hashlib.sha256(inner).hexdigest()


def test_cut_and_damaged_archives(spark, tmp_path):
    whole = archive([("a", BODY), ("b", BODY)])
    (tmp_path / "cut.tar").write_bytes(whole[: 512 + 2560 + 512 + 100])
    assert [r["name"] for r in tar.entries(spark, str(tmp_path / "cut.tar")).collect()] == ["a"]
    bad = bytearray(whole)
    bad[3072] ^= 1
    (tmp_path / "bad.tar").write_bytes(bytes(bad))
    with pytest.raises(ValueError, match="bad.tar: no valid header at 3072"):
        tar.entries(spark, str(tmp_path / "bad.tar"))


FORMATS = {"tiles.pmtiles": ("tiles", "pmtiles"), "gaz.jsonl.gz": ("search", "jsonl")}


def bundle(change=None, data=None):
    files = {"tiles.pmtiles": b"tiles" * 300, "gaz.jsonl.gz": b"gaz"}
    listed = [{"name": k, "role": FORMATS[k][0], "format": FORMATS[k][1], "bytes": len(v), "sha256": hashlib.sha256(v).hexdigest()} for k, v in files.items()]
    m = {"format": "f/1", "build": {"id": "b1", "created": "2026-01-01T00:00:00Z", "packserver": "1", "valhalla": "3"}, "region": {"name": "R", "bbox": [0, 0, 1, 1], "counts": {"nodes": 1, "ways": 1, "routable": 1}},
         "inputs": [{"filename": "x", "bytes": 1, "sha256": "0" * 64, "sorted": True, "resorted": False}], "artifacts": listed}
    entries = [("manifest.json", json.dumps(m).encode()), *(({**files, **(data or {})}).items())]
    return archive(change(entries) if change else entries, tarfile.USTAR_FORMAT)


def test_bundles_are_held_against_their_manifests(spark, tmp_path):
    import gzip

    cases = {
        "good": bundle(), "hash": bundle(data={"gaz.jsonl.gz": b"gab"}), "size": bundle(data={"gaz.jsonl.gz": b"gaz2"}), "order": bundle(lambda e: e[1:] + e[:1]), "missing": bundle(lambda e: e[:-1]),
        "twice": bundle(lambda e: e + e[-1:]), "trailing": bundle() + b"x" * 512, "link": bundle(lambda e: e[:1] + [("l", b"", tarfile.SYMTYPE)]),
    }
    for name, data in cases.items():
        (tmp_path / f"{name}.tar.gz").write_bytes(gzip.compress(data))
    (tmp_path / "cut.tar.gz").write_bytes(gzip.compress(bundle())[:-30])
    read = stage(tar.streamed(spark, str(tmp_path)), "bundles")
    got = {}
    for r in tar.gate(read, "f/1", FORMATS).withColumn("b", F.regexp_extract("bundle", r"(\w+)\.tar", 1)).collect():
        got.setdefault(r["b"], set()).add(r["problem"].split(":")[0])
    assert "good" not in got and got["hash"] == {"checksum"} and got["size"] == {"size", }
    assert got["order"] == {"the manifest must be the first entry"} and got["missing"] == {"missing"} and got["trailing"] == {"trailing data"}
    assert "unsafe entry" in got["twice"] and "unsafe entry" in got["link"] and "damaged gzip" in got["cut"]
