"""Token ids in Parquet list columns, written in document order for selective reads.

Layout of a written folder.  ``data/``: one row per document in ascending id order over the files
(range-partitioned, then sorted), with ``part`` (number of the file's partition), ``local_start``
(ids before it in the partition), ``doc_id``, ``n_tokens`` and ``tokens array<int>``.  Ids are
dictionary-encoded (two bytes an id or less), numbers that ascend are delta-encoded; row groups
and pages have set sizes, and the writer adds page indexes, so a reader that wants few documents
or no ids at all touches few pages.  ``index/``: a row for each part with ``base`` (ids in all parts
before), ``n`` (its ids), ``longest`` (most ids of one document) and its least and greatest doc_id.
A document starts at ``base + local_start`` of the whole sequence.

Selective reads.  :func:`read_window` and :func:`read_documents` first look into the index (a few
thousand rows) for the parts concerned, and give the scan plain ranges of ``part`` and
``local_start`` or ``doc_id``: row groups by their statistics and pages by the page index are then
skipped, of the ids as well as of the numbers.

Defined results.  Null or empty text: the end id alone.  Null id: sorts first.  Repeated ids: each
row is kept, ordered by text.  Very long texts: encoded in pieces, one list.  Empty table: empty
folders.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oscilla.llm import common
from oscilla.llm.vocab import default_path, encoder

#: Bytes of text whose ids are made and handed on together.
SLICE = 8 << 20
DATA = "part int, local_start long, doc_id long, n_tokens long, tokens array<int>"
INDEX = "part int, base long, n long, longest long, least_id long, greatest_id long, has_null boolean"
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for b in common.record_batches(batches):
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            # parts of about SLICE bytes, so that ids of a whole batch are never held at once
            cuts = np.flatnonzero(np.diff(size // SLICE, prepend=0, append=-1)).tolist()
            for first, last in zip([0, *cuts[:-1]], cuts, strict=True):
                rows = b.slice(first, last - first)
                if not rows.num_rows:
                    continue
                ids, n = enc.encode(t or "" for t in rows.column("text").to_pylist())
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                stop = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(at + stop - n), rows.column("doc_id"), pa.array(n), lists],
                    names=["part", "local_start", "doc_id", "n_tokens", "tokens"],
                )
                at += int(stop[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text") -> str:
    """Encode whole texts, append ``end_id`` to each and write the folder described above."""
    rows = common.two_columns(docs, key, text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encoded(tokenizer or default_path(), end_id), DATA).write.options(**WRITER).parquet(f"{path}/data")
    parts = docs.sparkSession.read.schema(DATA).parquet(f"{path}/data").groupBy("part")
    parts = parts.agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("greatest_id"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    # one row for each partition of the writer: a table of a few thousand rows at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n", "longest", "least_id", "greatest_id", "has_null").write.parquet(f"{path}/index")
    return path


def _data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATA).parquet(f"{path}/data")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens; columns that are not asked for are not read."""
    index = _index(spark, path).select("part", "base")
    return _data(spark, path).join(index, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _ranges(spark: SparkSession, path: str, ranges: list[tuple[int, int, Column]]) -> DataFrame:
    """Documents of the given parts (part, base, condition), as one scan with plain conditions."""
    wanted = F.lit(False)
    for part, _, condition in ranges:
        wanted = wanted | ((F.col("part") == part) & condition)
    base = F.lit(0)
    if ranges:
        base = F.element_at(F.create_map(*(F.lit(x) for part, at, _ in ranges for x in (part, at))), F.col("part"))
    return _data(spark, path).where(wanted).select("doc_id", (base + F.col("local_start")).cast("long").alias("start"), "n_tokens", "tokens")


def read_window(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents that overlap ids first <= position < last of the whole sequence."""
    parts = _index(spark, path).where((F.col("base") < last) & (F.col("base") + F.col("n") > first)).collect()  # a row a part
    at = F.col("local_start")
    # parts that lie in the window as a whole are one range of parts, so a wide window has a short condition
    whole = sorted(r.part for r in parts if first <= r.base and r.base + r.n <= last)
    # plain comparisons with numbers, which reach the scan; the exact condition follows
    edges = [(r.part, r.base, (at < last - r.base) & (at > first - r.base - r.longest)) for r in parts if r.part not in set(whole)]
    out = _ranges(spark, path, edges).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    if whole:  # parts are numbered in the order of their bases
        index = _index(spark, path).where(F.col("part").between(whole[0], whole[-1])).select("part", "base")
        inner = _data(spark, path).where(F.col("part").between(whole[0], whole[-1])).join(index, "part")
        out = out.unionByName(inner.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens"))
    return out


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """All rows of the given doc_ids (a list that the caller holds)."""
    ids = sorted({int(i) for i in ids})
    hit = lambda r: [i for i in ids if r.least_id is not None and r.least_id <= i <= r.greatest_id]
    parts = [(r, hit(r)) for r in _index(spark, path).collect()]  # a row a part
    return _ranges(spark, path, [(r.part, r.base, F.col("doc_id").isin(some)) for r, some in parts if some])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.record_batches(batches):
            lists = b.column("tokens")
            stops = np.asarray(lists.offsets)
            ids = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
            crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(stops[:-1], stops[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
