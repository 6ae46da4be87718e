"""Zarr arrays (versions 2 and 3) of samples by channels as a Spark data source, written in Python.

``spark.dataSource.register(ZarrSource)``, then ``spark.read.format("zarr").load(path)`` gives a wide signal: ``i`` and a column
for each channel, named 0, 1, ..  A partition is a run of chunks of rows, ``SPLIT`` bytes or one chunk.  The options ``start`` and
``end`` choose the chunks before anything is read, and with the option
``pushdown`` so do conditions on ``i``, in sessions whose ``spark.sql.python.filterPushdown.enabled`` is on (Spark 4.1 then mixes up
the conditions of two scans of one loaded frame in one query, so it is off unless asked for); a schema with fewer channels reads only the chunks that hold them.  Further
options: ``array``, a path inside a group; ``segment`` k stands for ``traces_seg<k>``; ``split``, other bytes a partition.

Metadata are sought as consolidated first, then plain, in version 3 and version 2; a bucket is opened anonymously first and then
with the user's keys.  The error names all that was tried.  Codecs: none, gzip, zlib, zstd, lz4 and blosc (with lz4, zstd or zlib
inside, bytes shuffled or not); any other is named in an error.  Chunks that are not there hold the fill value.

:func:`write_zarr` writes version 3.  A task writes whole chunks, each under a name of its own that is then moved into place, so a
second attempt replaces equal bytes; the metadata come last, so an unfinished array is not an array.

Empty signals: an array of no samples.  Null values: NaN (of whole-number arrays: the fill value).  Missing samples: the fill value.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from oscilla.sources.stores import opened, qualified

SPLIT = 16 << 20
CHUNK_ROWS = 10_000


# ---- stores and metadata -----------------------------------------------------------------------


def _stores(path: str) -> list[tuple[fs.FileSystem, str]]:
    """File systems that may open a path, in the order in which they are tried."""
    if path.startswith("s3://"):
        return [(fs.S3FileSystem(anonymous=anonymous), path[5:]) for anonymous in (True, False)]
    return [opened(path)]


def _bytes(store: fs.FileSystem, path: str) -> bytes | None:
    try:
        with store.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


@dataclass
class Layout:
    """What the metadata say of one array."""

    root: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    fill: float
    codecs: list[dict]
    prefix: str
    separator: str
    order: str
    attributes: dict

    @property
    def channels(self) -> int:
        return self.shape[1] if len(self.shape) > 1 else 1

    def chunk_path(self, row: int, column: int) -> str:
        at = [str(row), str(column)][: len(self.shape)]
        return f"{self.root}/{self.prefix}{self.separator.join(at)}"


def _fill(value, dtype: np.dtype) -> float:
    if isinstance(value, str):
        return float(value.replace("Infinity", "inf"))
    return float(value) if value is not None else (math.nan if dtype.kind == "f" else 0.0)


def _version3(root: str, meta: dict) -> Layout:
    if meta.get("node_type") != "array":
        raise ValueError(f"{root} is a group; name one of its arrays")
    grid, keys = meta["chunk_grid"], meta.get("chunk_key_encoding", {"name": "default"})
    if grid["name"] != "regular":
        raise ValueError(f"unknown chunk grid {grid['name']!r}")
    dtype, codecs, order = np.dtype(meta["data_type"]), [], "C"
    for c in meta["codecs"]:
        how = c.get("configuration", {})
        if c["name"] == "bytes":
            dtype = dtype.newbyteorder("<" if how.get("endian", "little") == "little" else ">")
        elif c["name"] == "transpose" and list(how.get("order", [])) in ([1, 0], [0, 1], [0]):
            order = "F" if how["order"] == [1, 0] else "C"
        else:
            codecs.append({"id": c["name"], **how})
    name = keys["name"]
    separator = keys.get("configuration", {}).get("separator", "/" if name == "default" else ".")
    prefix = f"c{separator}" if name == "default" else ""
    return Layout(root, tuple(meta["shape"]), tuple(grid["configuration"]["chunk_shape"]), dtype, _fill(meta.get("fill_value"), dtype), codecs, prefix, separator, order, meta.get("attributes", {}))


def _version2(root: str, meta: dict, attributes: dict) -> Layout:
    dtype = np.dtype(meta["dtype"])
    codecs = [*(meta.get("filters") or []), *([meta["compressor"]] if meta.get("compressor") else [])]
    return Layout(root, tuple(meta["shape"]), tuple(meta["chunks"]), dtype, _fill(meta.get("fill_value"), dtype), codecs, "", meta.get("dimension_separator", "."), meta.get("order", "C"), attributes)


def _found(store: fs.FileSystem, base: str, array: str) -> Layout | None:
    root = f"{base}/{array}".rstrip("/")
    key = f"{array}/" if array else ""
    if raw := _bytes(store, f"{base}/.zmetadata"):
        every = json.loads(raw)["metadata"]
        if f"{key}.zarray" in every:
            return _version2(root, every[f"{key}.zarray"], every.get(f"{key}.zattrs", {}))
    if array and (raw := _bytes(store, f"{base}/zarr.json")):
        every = ((json.loads(raw).get("consolidated_metadata") or {}).get("metadata")) or {}
        if array in every:
            return _version3(root, every[array])
    if raw := _bytes(store, f"{root}/zarr.json"):
        return _version3(root, json.loads(raw))
    if raw := _bytes(store, f"{root}/.zarray"):
        return _version2(root, json.loads(raw), json.loads(_bytes(store, f"{root}/.zattrs") or b"{}"))
    return None


def open_array(path: str, array: str = "") -> tuple[fs.FileSystem, Layout]:
    """The first store and form of metadata that open ``path``; else an error that lists the attempts."""
    tried = []
    for store, base in _stores(path.rstrip("/")):
        try:
            got = _found(store, base, array.strip("/"))
            if got:
                if len(got.shape) not in (1, 2):
                    raise ValueError(f"{path} has {len(got.shape)} dimensions; samples by channels are wanted")
                return store, got
            tried.append(f"{store.type_name}: no .zmetadata, zarr.json or .zarray for {array or 'the root'}")
        except OSError as err:
            tried.append(f"{store.type_name}: {err}")
    raise FileNotFoundError(f"no array at {path} ({'; '.join(tried)})")


# ---- codecs ------------------------------------------------------------------------------------


def _unblosc(data: bytes) -> bytes:
    """A Blosc 1 frame: a header, the starts of its blocks, and in each block one stream, or one for each byte of an item."""
    _, _, flags, item, size, block_size, _ = struct.unpack("<BBBBIII", data[:16])
    if flags & 2:
        return data[16 : 16 + size]
    inner = {1: "lz4_raw", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if inner is None or flags & 4:
        raise ValueError(f"unknown codec 'blosc' with {'bits shuffled' if flags & 4 else f'inner format {flags >> 5}'}")
    n_blocks = -(-size // block_size)
    starts, out = struct.unpack(f"<{n_blocks}i", data[16 : 16 + 4 * n_blocks]), []
    for k, at in enumerate(starts):
        want = min(block_size, size - k * block_size)
        split = item if not flags & 16 and want == block_size and 1 < item <= 16 and block_size // item >= 128 else 1
        parts = []
        for _ in range(split):
            (length,) = struct.unpack("<i", data[at : at + 4])
            piece, at = data[at + 4 : at + 4 + length], at + 4 + length
            whole = want // split
            parts.append(piece if length == whole else zlib.decompress(piece) if inner == "zlib" else pa.Codec(inner).decompress(piece, whole).to_pybytes())
        block = b"".join(parts)
        if flags & 1 and item > 1:  # the first bytes of all items, then the second ones, ..
            n = len(block) // item
            block = np.frombuffer(block, np.uint8, n * item).reshape(item, n).T.tobytes() + block[n * item :]
        out.append(block)
    return b"".join(out)


def _decode(data: bytes, codecs: list[dict], size: int) -> bytes:
    import zstandard

    for c in reversed(codecs):
        name = c["id"]
        if name in ("gzip", "zlib"):
            data = zlib.decompress(data, 47)
        elif name == "zstd":
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif name == "lz4":
            data = pa.Codec("lz4_raw").decompress(data[4:], struct.unpack("<I", data[:4])[0]).to_pybytes()
        elif name == "blosc":
            data = _unblosc(data)
        else:
            raise ValueError(f"unknown codec {name!r}")
    if len(data) != size:
        raise ValueError(f"a chunk of {len(data)} bytes instead of {size}")
    return data


def _encode(data: bytes, codec: str | None, level: int) -> bytes:
    import zstandard

    if codec == "zstd":
        return zstandard.ZstdCompressor(level=level).compress(data)
    if codec == "gzip":
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()
    return data


# ---- reading -----------------------------------------------------------------------------------


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.array, self.split = options["path"], options.get("array", ""), int(options.get("split", SPLIT))
        self.names = schema.names
        self.channels = [int(c) for c in schema.names if c != "i"]
        _, self.layout = open_array(self.path, self.array)
        beyond = [c for c in self.channels if not 0 <= c < self.layout.channels]
        if beyond:
            raise ValueError(f"no channels {beyond} in an array of {self.layout.channels}")
        self.lo, self.hi = max(0, int(options.get("start", 0))), min(self.layout.shape[0], int(options.get("end", self.layout.shape[0])))

    def partitions(self) -> list[InputPartition]:
        """Whole chunks of rows within the wanted range."""
        high = self.layout.chunks[0]
        wide = self.layout.chunks[1] if len(self.layout.chunks) > 1 else 1
        columns = len({c // wide for c in self.channels}) * wide or 1
        step = high * max(1, self.split // (high * columns * 8))
        first = self.lo // high * high
        return [Rows(max(at, self.lo), min(at + step, self.hi)) for at in range(first, self.hi, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, lay = open_array(self.path, self.array)
        high, wide = lay.chunks[0], lay.chunks[1] if len(lay.chunks) > 1 else 1
        at = partition.first
        while at < partition.last:
            row = at // high
            stop = min((row + 1) * high, partition.last)
            held: dict[int, np.ndarray] = {}
            for c in self.channels:
                if c // wide not in held:
                    raw = _bytes(store, lay.chunk_path(row, c // wide))
                    if raw is None:
                        held[c // wide] = np.full((high, wide), lay.fill)
                    else:
                        flat = np.frombuffer(_decode(raw, lay.codecs, high * wide * lay.dtype.itemsize), lay.dtype)
                        held[c // wide] = flat.reshape((high, wide), order=lay.order)
            inside = slice(at - row * high, stop - row * high)
            columns = [np.arange(at, stop) if name == "i" else held[int(name) // wide][inside, int(name) % wide].astype(float) for name in self.names]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if n == "i" else pa.float64()) for n, x in zip(self.names, columns, strict=True)], names=self.names)
            at = stop


class PushedZarrReader(ZarrReader):
    """A reader that Spark hands conditions on ``i`` to, for sessions whose ``spark.sql.python.filterPushdown.enabled`` is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, v = getattr(f, "attribute", ()), getattr(f, "value", None)
            if name == ("i",) and isinstance(v, int):
                match f:
                    case EqualTo():
                        self.lo, self.hi = max(self.lo, v), min(self.hi, v + 1)
                    case GreaterThanOrEqual():
                        self.lo = max(self.lo, v)
                    case GreaterThan():
                        self.lo = max(self.lo, v + 1)
                    case LessThan():
                        self.hi = min(self.hi, v)
                    case LessThanOrEqual():
                        self.hi = min(self.hi, v + 1)
                    case _:
                        yield f
            else:
                yield f


# ---- writing -----------------------------------------------------------------------------------


@dataclass
class Done(WriterCommitMessage):
    chunks: int


class ZarrWriter(DataSourceArrowWriter):
    """Rows (i, channels) of whole chunks, each chunk's rows together and in order."""

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"].rstrip("/")
        self.shape = (int(options["samples"]), len(schema.names) - 1)
        self.rows, self.dtype = int(options.get("chunk", CHUNK_ROWS)), options.get("dtype", "float64")
        self.codec, self.level = options.get("codec", "zstd"), int(options.get("level", 3))
        self.attributes = options.get("attributes", "{}")
        if self.codec not in ("zstd", "gzip", "none"):
            raise ValueError(f"unknown codec {self.codec!r}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        store, root = _stores(self.path)[-1]
        now, held, done = None, None, 0
        kind = np.dtype(self.dtype).newbyteorder("<")
        fill = math.nan if kind.kind == "f" else 0

        def put() -> None:
            path = f"{root}/c/{now}/0"
            store.create_dir(f"{root}/c/{now}", recursive=True)
            with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}.part") as out:
                out.write(_encode(held.tobytes(), self.codec, self.level))
            store.move(own, path)

        for b in iterator:
            at = b.column("i").to_numpy()
            values = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k, n in enumerate(b.schema.names) if n != "i"], axis=1) if b.num_rows else np.zeros((0, self.shape[1]))
            for row in dict.fromkeys((at // self.rows).tolist()):
                if row != now:
                    if now is not None:
                        put()
                    now, held, done = row, np.full((self.rows, self.shape[1]), fill, kind), done + 1
                some = at // self.rows == row
                v = values[some]
                held[at[some] - row * self.rows] = v if kind.kind == "f" else np.nan_to_num(v, nan=fill)
        if now is not None:
            put()
        return Done(done)

    def commit(self, messages: list[Done | None]) -> None:
        store, root = _stores(self.path)[-1]
        store.create_dir(root, recursive=True)
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}]
        if self.codec != "none":
            codecs.append({"name": self.codec, "configuration": {"level": self.level} | ({"checksum": False} if self.codec == "zstd" else {})})
        meta = {
            "zarr_format": 3, "node_type": "array", "shape": list(self.shape), "data_type": self.dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [self.rows, max(self.shape[1], 1)]}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN" if np.dtype(self.dtype).kind == "f" else 0, "codecs": codecs, "attributes": json.loads(self.attributes),
        }
        with store.open_output_stream(f"{root}/zarr.json") as out:
            out.write(json.dumps(meta, indent=1).encode())

    def abort(self, messages: list[Done | None]) -> None:
        """Chunks without metadata are no array; a later write replaces them."""


class ZarrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _options(self) -> dict:
        got = dict(self.options)
        if "segment" in got:
            got["array"] = f"traces_seg{int(got['segment'])}"
        return got

    def schema(self) -> str:
        got = self._options()
        _, lay = open_array(got["path"], got.get("array", ""))
        return ", ".join(["i long", *(f"`{k}` double" for k in range(lay.channels))])

    def reader(self, schema: StructType) -> ZarrReader:
        kind = PushedZarrReader if str(self.options.get("pushdown", "false")).lower() == "true" else ZarrReader
        return kind(self._options(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ZarrWriter:
        return ZarrWriter(self._options(), schema)


def read_zarr(spark: SparkSession, path: str, channels: list[int] | None = None, start: int | None = None, end: int | None = None, array: str = "", segment: int | None = None, split: int = SPLIT) -> DataFrame:
    """The wide signal of an array, of samples start <= i < end; only the chunks of these and of ``channels`` are read."""
    spark.dataSource.register(ZarrSource)
    reader = spark.read.format("zarr").option("array", array).option("split", split)
    for name, given in (("segment", segment), ("start", start), ("end", end)):
        reader = reader if given is None else reader.option(name, given)
    if channels is not None:
        reader = reader.schema(", ".join(["i long", *(f"`{c}` double" for c in channels)]))
    return reader.load(qualified(spark, path))


def attributes(path: str, array: str = "") -> dict:
    return open_array(path, array)[1].attributes


def write_zarr(wide: DataFrame, path: str, chunk: int = CHUNK_ROWS, codec: str = "zstd", level: int = 3, dtype: str = "float64", metadata: dict | None = None) -> str:
    """A wide signal (``i`` and channels) as an array of samples by channels; of samples that repeat, the last one written counts."""
    spark = wide.sparkSession
    spark.dataSource.register(ZarrSource)
    names = [c for c in wide.columns if c != "i"]
    rows = wide.where("i >= 0").select(F.col("i").cast("long").alias("i"), *(F.col(f"`{c}`").cast("double").alias(str(k)) for k, c in enumerate(names)))
    samples = (rows.agg(F.max("i")).first()[0] if names else None) or 0
    samples = samples + 1 if not rows.isEmpty() else 0
    rows = rows.repartition(F.floor(F.col("i") / chunk)).sortWithinPartitions("i")
    writer = rows.write.format("zarr").mode("append").option("samples", samples).option("chunk", chunk).option("codec", codec).option("level", level)
    writer.option("dtype", dtype).option("attributes", json.dumps({"metadata": metadata} if metadata else {})).save(qualified(spark, path))
    return path
