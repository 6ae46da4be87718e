"""Recording blocks of TDT systems as a Spark data source, written in Python.

A block is a folder with one ``.tsq`` file of header records, 40 bytes each, and one ``.tev`` file of data.  A record says
the kind, the store (four letters), channel, time, where its data begin and how they are kept.

``read_streams``: store, channel, i (samples since the store began), t (seconds since the block began), value, fs.
``read_epochs``: store, onset, offset, data, in seconds since the block began.  An epoch ends at the off record of its store that
comes next, else at the next onset, else at the block's end (null if the block has none).

A partition is a range of header records, ``SPLIT`` of them, so planning reads no header but the first ones; data are
read by their offsets, neighbours together.  The options ``stores``, ``channels``, ``start`` and ``end`` (of seconds) choose records
without touching the data of others, and with the option ``pushdown`` so do conditions on ``store``, ``channel`` and
``t``, in sessions whose ``spark.sql.python.filterPushdown.enabled`` is on (Spark 4.1 then mixes up the conditions of two scans of one
loaded frame in one query, so it is off unless asked for).

Defined results.  No records: no rows.  A record whose data lie beyond the end of the data file, an unknown format of a
stream: an error that names file and record.  Records of other kinds (snippets, scalars, marks) are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from oscilla.model import SignalMeta, long_to_wide
from oscilla.sources import datasets, zarr
from oscilla.sources.stores import opened, qualified

#: A header record: size in words of four bytes with the header's ten, kind, store, channel, sort code, time, place of the data or value, format, rate.
RECORD = np.dtype([("size", "<i4"), ("kind", "<i4"), ("store", "S4"), ("channel", "<u2"), ("sort", "<u2"), ("time", "<f8"), ("place", "<i8"), ("format", "<i4"), ("rate", "<f4")])
# fixed values of the format: kinds of records, marks of a block's ends, formats of samples
ON, OFF, STREAM, MARK = 0x0101, 0x0102, 0x8101, 0x8801
START, STOP = 1, 2
FORMATS = {0: "<f4", 1: "<i4", 2: "<i2", 3: "i1", 4: "<f8"}
SPLIT = 1 << 14
#: Bytes of data that are read together.
TOGETHER = 4 << 20
STREAMS = "store string, channel int, sample long, t double, value double, fs double"
MARKS = "kind string, store string, time double, value double"


@dataclass
class Records(InputPartition):
    first: int
    last: int


class TdtReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.marks, self.split = options.get("what", "streams") == "marks", int(options.get("split", SPLIT))
        self.names, self.uri = schema.names, options["path"].rstrip("/")
        store, root = opened(self.uri)
        found = [i for i in store.get_file_info(fs.FileSelector(root)) if i.path.endswith(".tsq")]
        if len(found) != 1:
            raise FileNotFoundError(f"{len(found)} .tsq files in {self.uri}")
        self.heads, self.data, self.n = found[0].path, found[0].path[:-4] + ".tev", found[0].size // RECORD.itemsize
        given = lambda name: json.loads(options.get(name, "null"))
        self.stores: set[str] | None = None if given("stores") is None else set(given("stores"))
        self.channels: set[int] | None = None if given("channels") is None else set(given("channels"))
        start, end = given("start"), given("end")
        self.lo, self.strict_lo = -np.inf if start is None else start, False
        self.hi, self.strict_hi = (np.inf, False) if end is None else (end, True)

    def partitions(self) -> list[InputPartition]:
        return [Records(at, min(at + self.split, self.n)) for at in range(0, self.n, self.split)] or [Records(0, 0)]

    def _began(self, store: fs.FileSystem) -> float:
        """The time of the start mark, which stands among the first records; else of the first record with a time."""
        with store.open_input_file(self.heads) as f:
            head = np.frombuffer(f.read(RECORD.itemsize * min(self.n, 16)), RECORD)
        start = head[(head["kind"] == MARK) & (head["store"] == np.array([START], "<i4").tobytes().rstrip(b"\0"))]
        timed = start if len(start) else head[head["time"] > 0]
        return float(timed["time"][0]) if len(timed) else 0.0

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.uri)
        began = self._began(store)
        with store.open_input_file(self.heads) as f:
            f.seek(partition.first * RECORD.itemsize)
            head = np.frombuffer(f.read((partition.last - partition.first) * RECORD.itemsize), RECORD)
        number = partition.first + np.arange(len(head))
        if self.marks:
            yield self._marks(head, began)
            return
        keep = head["kind"] == STREAM
        if self.stores is not None:
            keep &= np.isin(head["store"], [s.encode() for s in self.stores])
        if self.channels is not None:
            keep &= np.isin(head["channel"], list(self.channels))
        head, number = head[keep], number[keep]
        odd = [int(k) for k in np.unique(head["format"]) if int(k) not in FORMATS]
        if odd:
            raise ValueError(f"unknown format {odd[0]} in {self.heads}, record {number[head['format'] == odd[0]][0]}")
        item = np.array([np.dtype(FORMATS[k]).itemsize for k in head["format"].tolist()], np.int64)
        points = (head["size"].astype(np.int64) - 10) * 4 // item if len(head) else np.zeros(0, np.int64)
        rate, since = head["rate"].astype(float), head["time"] - began
        inside = (since < self.hi + 1e-9) & (since + points / np.maximum(rate, 1e-9) > self.lo - 1e-9)
        head, number, points, rate, since, item = (x[inside] for x in (head, number, points, rate, since, item))
        if not len(head):
            return
        beyond = head["place"] + points * item > store.get_file_info(self.data).size
        if beyond.any():
            raise ValueError(f"the data of {self.heads}, record {number[beyond][0]}, lie beyond the end of {self.data}")
        cuts = np.flatnonzero(np.diff(np.cumsum(points * item) // TOGETHER, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(head)], strict=True):
            yield self._samples(store, head[a:b], points[a:b], rate[a:b], since[a:b])

    def _samples(self, store: fs.FileSystem, head: np.ndarray, points: np.ndarray, rate: np.ndarray, since: np.ndarray) -> pa.RecordBatch:
        values, lo = [], int(head["place"].min())
        spans = [(int(p), FORMATS[int(k)], int(n)) for p, k, n in zip(head["place"], head["format"], points, strict=True)]
        stop = max(p + np.dtype(k).itemsize * n for p, k, n in spans)
        with store.open_input_file(self.data) as f:
            near = f.read_at(stop - lo, lo) if stop - lo <= 4 * TOGETHER else None  # neighbours are read in one go
            for p, k, n in spans:
                raw = near[p - lo : p - lo + np.dtype(k).itemsize * n] if near is not None else f.read_at(np.dtype(k).itemsize * n, p)
                values.append(np.frombuffer(raw, k).astype(float))
        at = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
        every = lambda x: np.repeat(x, points)
        t = every(since) + at / every(rate)
        inside = ((t > self.lo) if self.strict_lo else (t >= self.lo)) & ((t < self.hi) if self.strict_hi else (t <= self.hi))
        columns = {
            "store": every(np.array([s.decode("latin-1") for s in head["store"].tolist()], object)), "channel": every(head["channel"].astype(np.int32)),
            "sample": every(np.round(since * rate).astype(np.int64)) + at, "t": t, "value": np.concatenate(values), "fs": every(rate),
        }
        kinds = {"store": pa.string(), "channel": pa.int32(), "sample": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c][inside], kinds.get(c, pa.float64())) for c in self.names], names=self.names)

    def _marks(self, head: np.ndarray, began: float) -> pa.RecordBatch:
        stop = (head["kind"] == MARK) & (head["store"] == np.array([STOP], "<i4").tobytes().rstrip(b"\0"))
        head_kind = np.where(head["kind"] == ON, "on", np.where(head["kind"] == OFF, "off", np.where(stop, "stop", "")))
        keep = head_kind != ""
        names = np.array([s.decode("latin-1") for s in head["store"].tolist()], object)
        if self.stores is not None:
            keep &= np.isin(names.astype(str), list(self.stores)) if len(names) else keep
        columns = {"kind": head_kind.astype(object), "store": names, "time": head["time"] - began, "value": head["place"].copy().view("<f8")}
        return pa.RecordBatch.from_arrays([pa.array(columns[c][keep], pa.string() if c in ("kind", "store") else pa.float64()) for c in self.names], names=self.names)


class PushedTdtReader(TdtReader):
    """A reader that Spark hands conditions to, for sessions whose ``spark.sql.python.filterPushdown.enabled`` is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, v = getattr(f, "attribute", ()), getattr(f, "value", None)
            some = set(v) if isinstance(f, In) else {v} if isinstance(f, EqualTo) else None
            if name == ("store",) and some is not None:
                self.stores = some if self.stores is None else self.stores & some
            elif name == ("channel",) and some is not None and not self.marks:
                self.channels = some if self.channels is None else self.channels & some
            elif name == ("t",) and isinstance(f, (GreaterThanOrEqual, GreaterThan)) and not self.marks:
                self.lo, self.strict_lo = max((self.lo, self.strict_lo), (v, isinstance(f, GreaterThan)))
            elif name == ("t",) and isinstance(f, (LessThanOrEqual, LessThan)) and not self.marks:
                hi, strict = min((self.hi, not self.strict_hi), (v, not isinstance(f, LessThan)))
                self.hi, self.strict_hi = hi, not strict
            else:
                yield f


class TdtSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tdt"

    def schema(self) -> str:
        return MARKS if self.options.get("what") == "marks" else STREAMS

    def reader(self, schema: StructType) -> TdtReader:
        kind = PushedTdtReader if str(self.options.get("pushdown", "false")).lower() == "true" else TdtReader
        return kind(dict(self.options), schema)


def _read(spark: SparkSession, path: str, what: str, split: int, **chosen: object) -> DataFrame:
    spark.dataSource.register(TdtSource)
    reader = spark.read.format("tdt").option("what", what).option("split", split)
    for name, value in chosen.items():
        reader = reader.option(name, json.dumps(value))
    return reader.load(qualified(spark, path))


def read_streams(spark: SparkSession, path: str, stores: list[str] | None = None, channels: list[int] | None = None, start: float | None = None, end: float | None = None, split: int = SPLIT) -> DataFrame:
    """Samples of a block's streams, of some stores and channels, with start <= t < end: store, channel, i, t, value, fs.

    ``i`` counts from the store's first sample in the block that is read, so a time segment begins at 0.
    """
    rows = _read(spark, path, "streams", split, stores=stores, channels=channels, start=start, end=end)
    first = rows.groupBy(F.col("store").alias("_store")).agg(F.min("sample").alias("_first"))  # a row a store
    out = rows.join(first, F.col("store") == F.col("_store"))
    return out.select("store", "channel", (F.col("sample") - F.col("_first")).alias("i"), "t", "value", "fs")


def read_epochs(spark: SparkSession, path: str, stores: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Epochs of a block: store, onset, offset, data."""
    rows = _read(spark, path, "marks", split)
    stop = rows.where("kind = 'stop'").agg(F.max("time").alias("_stop"))  # one row
    marks = rows.where("kind != 'stop'") if stores is None else rows.where(F.col("kind") != "stop").where(F.col("store").isin(stores))
    # an epoch's end is the next mark of its store; events of one store, not samples, are ordered together
    w = Window.partitionBy("store").orderBy("time", F.col("kind").asc())
    nxt = marks.withColumn("_next", F.lead("time").over(w)).where("kind = 'on'").crossJoin(stop)
    return nxt.select("store", F.col("time").alias("onset"), F.coalesce("_next", "_stop").alias("offset"), F.col("value").alias("data"))


def available(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The stream stores of a block: store, channels (ascending), fs, samples of a channel."""
    rows = _read(spark, path, "streams", split)
    return rows.groupBy("store").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.first("fs").alias("fs"), (F.max("sample") - F.min("sample") + 1).alias("samples"))


def convert(spark: SparkSession, path: str, folder: str, stores: list[str] | None = None, epochs: list[str] | None = None, start: float | None = None, end: float | None = None, form: str = "parquet", split: int = SPLIT) -> list[str]:
    """Streams of a block as stored datasets (``form`` "parquet", with a side-car) or arrays ("zarr"), its epochs as tables; the paths.

    A time segment's bounds stand in the names and in the metadata.  Each store is one job over its own records.
    """
    if form not in ("parquet", "zarr"):
        raise ValueError(f"unknown form {form!r}")
    segment = "" if start is None and end is None else f"_t{start or 0:g}-{'end' if end is None else f'{end:g}'}"
    out = []
    for s in available(spark, path, split).orderBy("store").collect():  # a row a store
        if stores is not None and s.store not in stores:
            continue
        rows = read_streams(spark, path, [s.store], None, start, end, split)
        wide = long_to_wide(rows, s.channels, "")
        meta = SignalMeta(f"{s.store}{segment}", s.fs, 0, [str(c) for c in s.channels], ["stream"] * len(s.channels), "tdt", {"segment_info": {"segment_start_time": start, "segment_end_time": end}} if segment else {})
        if form == "zarr":
            out.append(zarr.write_zarr(wide, f"{folder}/{meta.name}.zarr", metadata={"fs": s.fs, "name": s.store}))
        else:
            out.append(datasets.write_stream(wide, f"{folder}/{meta.name}.ant", meta))
    marks = read_epochs(spark, path, epochs, split)
    for name in [r.store for r in marks.select("store").distinct().orderBy("store").collect()]:
        out.append(f"{folder}/{name}.parquet")
        datasets.write_epochs(marks.where(F.col("store") == name), out[-1])
    return out
