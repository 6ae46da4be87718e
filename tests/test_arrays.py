"""Zarr arrays: both versions, codecs, windows, failures."""

import gzip
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringContains
from pyspark.sql.types import _parse_datatype_string

from oscilla.sources import zarr


def blosc(data, item, inner, shuffle=True, block=1 << 14):
    """A Blosc 1 frame by its public description; blocks of whole items, one stream for each byte of an item."""
    code, pack = {"lz4": (1, lambda b: pa.Codec("lz4_raw").compress(b).to_pybytes()), "zlib": (3, zlib.compress), "zstd": (4, zstandard.ZstdCompressor().compress)}[inner]
    starts, body, at = [], b"", 16 + 4 * -(-len(data) // block)
    for k in range(0, len(data), block):
        part = data[k : k + block]
        if shuffle:
            part = np.frombuffer(part, np.uint8).reshape(-1, item).T.tobytes()
        split = item if len(part) == block else 1
        starts.append(at + len(body))
        for j in range(split):
            piece = part[j * len(part) // split : (j + 1) * len(part) // split]
            packed = pack(piece)
            packed = piece if len(packed) >= len(piece) else packed
            body += struct.pack("<i", len(packed)) + packed
    return struct.pack("<BBBBIII", 2, 1, int(shuffle) | code << 5, item, len(data), block, at + len(body)) + struct.pack(f"<{len(starts)}i", *starts) + body


PACK = {
    None: lambda b: b,
    "gzip": gzip.compress,
    "zlib": zlib.compress,
    "zstd": zstandard.ZstdCompressor().compress,
    "lz4": lambda b: struct.pack("<I", len(b)) + pa.Codec("lz4_raw").compress(b).to_pybytes(),
    "blosc lz4": lambda b: blosc(b, 4, "lz4"),
    "blosc zstd": lambda b: blosc(b, 4, "zstd", False),
    "blosc zlib": lambda b: blosc(b, 4, "zlib"),
    "blosc copy": lambda b: struct.pack("<BBBBIII", 2, 1, 2, 4, len(b), 1 << 14, len(b) + 16) + b,
}


def store(root, x, chunks, version, how, order="C", skip=()):
    """An array as other writers store it."""
    root.mkdir(parents=True)
    codec = how.split()[0] if how else None
    if version == 2:
        (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": x.shape, "chunks": chunks, "dtype": x.dtype.str, "fill_value": 7, "order": order, "filters": None, "compressor": {"id": codec} if codec else None}))
        (root / ".zattrs").write_text(json.dumps({"metadata": {"fs": 30}}))
    else:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec, "configuration": {}}] if codec else [])
        codecs = ([{"name": "transpose", "configuration": {"order": [1, 0]}}] if order == "F" else []) + codecs
        grid = {"name": "regular", "configuration": {"chunk_shape": chunks}}
        (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": x.shape, "data_type": x.dtype.name, "chunk_grid": grid, "chunk_key_encoding": {"name": "default"}, "fill_value": 7, "codecs": codecs, "attributes": {"metadata": {"fs": 30}}}))
    for r in range(-(-x.shape[0] // chunks[0])):
        for c in range(-(-x.shape[1] // chunks[1])):
            if (r, c) in skip:
                continue
            part = np.zeros(chunks, x.dtype)
            piece = x[r * chunks[0] : (r + 1) * chunks[0], c * chunks[1] : (c + 1) * chunks[1]]
            part[: piece.shape[0], : piece.shape[1]] = piece
            at = root / (f"{r}.{c}" if version == 2 else f"c/{r}/{c}")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(PACK[how](part.tobytes(order=order)))


@pytest.mark.parametrize("how", list(PACK), ids=str)
def test_foreign_arrays(spark, tmp_path, how):
    x = np.random.default_rng(3).integers(-50, 50, (5000, 5)).astype("<i4" if how != "zstd" else "<f4")
    for version, order in ((2, "C"), (2, "F"), (3, "C"), (3, "F")):
        root = tmp_path / f"{version}{order}"
        store(root, x, (2048, 2), version, how, order, skip={(1, 1)})
        want = x.astype(float)
        want[2048:4096, 2:4] = 7
        got = zarr.read_zarr(spark, f"file://{root}").orderBy("i").collect()
        assert [tuple(r) for r in got] == [(i, *map(float, row)) for i, row in enumerate(want)]
        assert zarr.attributes(str(root)) == {"metadata": {"fs": 30}}


def test_windows_read_their_chunks_only(spark, tmp_path):
    x = np.arange(60_000.0).reshape(20_000, 3)
    store(tmp_path / "a", x, (1000, 1), 3, "zstd")
    for row in range(20):
        for column in range(3):
            if not (column == 1 and row in (5, 6)):
                (tmp_path / "a" / "c" / str(row) / str(column)).write_bytes(b"broken")  # reading it would fail
    got = zarr.read_zarr(spark, str(tmp_path / "a"), [1], 5900, 6100).orderBy("i").collect()
    assert [(r.i, r["1"]) for r in got] == [(i, 3.0 * i + 1) for i in range(5900, 6100)]
    reader = zarr.PushedZarrReader({"path": str(tmp_path / "a"), "split": "1"}, _parse_datatype_string("i long, `1` double"))
    rest = list(reader.pushFilters([GreaterThanOrEqual(("i",), 1500), GreaterThan(("i",), 1700), LessThan(("i",), 9000), LessThanOrEqual(("i",), 4000), EqualTo(("1",), 3), StringContains(("i",), "x")]))
    assert len(rest) == 2 and [(p.first, p.last) for p in reader.partitions()] == [(1701, 2000), (2000, 3000), (3000, 4000), (4000, 4001)]
    list(reader.pushFilters([EqualTo(("i",), 99_999)]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 0)]


def test_two_windows_of_one_frame(spark, tmp_path):
    store(tmp_path / "a", np.arange(100.0).reshape(100, 1), (10, 1), 3, "zstd")
    whole = zarr.read_zarr(spark, str(tmp_path / "a"))
    assert sorted(r.i for r in whole.where("i < 3").unionByName(whole.where("i >= 97")).collect()) == [0, 1, 2, 97, 98, 99]
    assert zarr.read_zarr(spark, str(tmp_path / "a"), start=-5, end=500).count() == 100 and zarr.read_zarr(spark, str(tmp_path / "a"), start=50, end=20).count() == 0


def test_groups_and_fallbacks(spark, tmp_path):
    x = np.arange(20, dtype="<f8").reshape(10, 2)
    store(tmp_path / "g" / "traces_seg1", x, (4, 2), 2, None)
    assert zarr.read_zarr(spark, str(tmp_path / "g"), segment=1).count() == 10
    root = tmp_path / "g" / "traces_seg1"
    every = {"traces_seg1/.zarray": json.loads((root / ".zarray").read_text()), "traces_seg1/.zattrs": {"from": "consolidated"}}
    (tmp_path / "g" / ".zmetadata").write_text(json.dumps({"metadata": every}))
    (root / ".zarray").write_text("not read")  # consolidated metadata come first
    assert zarr.read_zarr(spark, str(tmp_path / "g"), array="traces_seg1").agg(F.sum("1")).first()[0] == 100.0
    assert zarr.attributes(str(tmp_path / "g"), "traces_seg1") == {"from": "consolidated"}
    with pytest.raises(FileNotFoundError, match="local: no .zmetadata, zarr.json or .zarray"):
        zarr.open_array(str(tmp_path / "nowhere"))
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group"}))
    with pytest.raises(ValueError, match="group"):
        zarr.open_array(str(tmp_path / "h"))


def test_unknown_codecs_are_named(spark, tmp_path):
    x = np.zeros((4, 1))
    store(tmp_path / "a", x, (4, 1), 2, None)
    meta = json.loads((tmp_path / "a" / ".zarray").read_text())
    (tmp_path / "a" / ".zarray").write_text(json.dumps(meta | {"compressor": {"id": "bzip9"}}))
    with pytest.raises(Exception, match="unknown codec 'bzip9'"):
        zarr.read_zarr(spark, str(tmp_path / "a")).collect()
    with pytest.raises(ValueError, match="unknown codec 'blosc'"):
        zarr._unblosc(struct.pack("<BBBBIII", 2, 1, 5, 4, 16, 16, 36) + b"\0" * 20)
    with pytest.raises(Exception, match="unknown codec 'zip'"):
        zarr.write_zarr(spark.createDataFrame([(0, 1.0)], "i long, a double"), str(tmp_path / "b"), codec="zip")
    (tmp_path / "a" / ".zarray").write_text(json.dumps(meta))
    (tmp_path / "a" / "0.0").write_bytes(b"short")
    with pytest.raises(Exception, match="a chunk of 5 bytes instead of 32"):
        zarr.read_zarr(spark, str(tmp_path / "a")).collect()


@pytest.mark.parametrize("codec", ["zstd", "gzip", "none"])
def test_round_trip(spark, tmp_path, codec):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2503, 3))
    rows = [(i, *map(float, v)) for i, v in enumerate(x) if i not in (7, 900)] + [(7, None, 1.0, float("nan"))]
    wide = spark.createDataFrame(rows, "i long, a double, b double, `c.d` double").repartition(4)
    for dtype in ("float64", "int16"):
        path = zarr.write_zarr(wide, f"file://{tmp_path}/{dtype}", chunk=400, codec=codec, dtype=dtype, metadata={"fs": 10})
        got = {r.i: tuple(r)[1:] for r in zarr.read_zarr(spark, path).collect()}
        assert len(got) == 2503 and zarr.attributes(path) == {"metadata": {"fs": 10}}
        want = x if dtype == "float64" else np.trunc(x)
        assert all(got[i] == tuple(want[i]) for i in range(2503) if i not in (7, 900))
        assert str(got[7]) == str((float("nan"), 1.0, float("nan"))) or got[7] == (0.0, 1.0, 0.0)
        assert len(list((tmp_path / dtype / "c").iterdir())) == 7 and not list((tmp_path / dtype).rglob("*.part"))
    empty = zarr.write_zarr(wide.where("false"), str(tmp_path / "empty"))
    assert zarr.read_zarr(spark, empty).columns == ["i", "0", "1", "2"] and zarr.read_zarr(spark, empty).count() == 0


def test_paths_mean_the_same_store(spark, tmp_path):
    from oscilla.sources.stores import opened, qualified

    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == qualified(spark, f"file:{tmp_path}") == qualified(spark, f"file://{tmp_path}")
    assert qualified(spark, "s3a://bucket/key") == "s3://bucket/key"
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert opened(path)[1] == str(tmp_path)
