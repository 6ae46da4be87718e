"""Documents drawn with probability by likeness to a target: importance weights over hashed runs of words, and Gumbel keys.

Both corpora are counted in ``buckets`` of hashed runs of 1 to ``longest`` words.  A bucket's gain is the log
of its smoothed share in the target over that in the documents, in thousandths, rounded down; a
document's weight is the sum of its runs' gains; the weight plus a Gumbel key made from the id is its
score, and the greatest scores are drawn (a sample without replacement in proportion to likeness).

Long texts.  A text of more than ``CHUNK`` bytes becomes chunks, cut at word boundaries with the
``longest - 1`` words that follow; a chunk owns the runs that begin before its cut.  Chunks are dealt over
all tasks, and their counts and weights are summed by document, so a task's work is bounded however
long a text is.  Short texts are never moved.

Ranks.  Thin rows are range-partitioned by score and numbered within their partitions; the partitions'
sizes, a small table, give each its first number.  No task orders all rows.

Defined results.  Null or empty text: no features, weight 0.  Null ids: the key of an empty id; last among
equal scores.  Repeated ids and rows: each is scored, and may be drawn, on its own.  Empty
tables: no rows, or gains against a target without features.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oscilla.llm import common, grams
from oscilla.llm.grams import Splitter

#: Words are runs of digits, letters a-z (after lower-casing) and everything beyond ASCII.
SPLITTER = Splitter(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20


def chunked(docs: DataFrame, longest: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Short texts as they stand, and the chunks of long ones dealt over all tasks: doc_id, row, carried, text."""
    rows = common.two_columns(docs, key, text)
    long = F.octet_length("text") > grams.CHUNK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33  # names a row: the partition and its place there
        for b in common.record_batches(batches):
            for doc, whole in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                for part, carried in SPLITTER.chunks(whole.as_py().encode(), longest):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], pa.int64()), pa.array([number], pa.int64()), pa.array([carried], pa.int32()), pa.array([part.decode()], pa.string())],
                        names=["doc_id", "row", "carried", "text"],
                    )
                number += 1

    chunks = rows.where(long).mapInArrow(cut, "doc_id long, row long, carried int, text string")
    short = rows.where(~F.coalesce(long, F.lit(False))).select("doc_id", F.lit(None).cast("long").alias("row"), F.lit(0).alias("carried"), "text")
    return short, chunks.repartition("row", F.xxhash64("text"))


def _buckets(words: grams.Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of the runs of 1, 2 .. words: crc32 of their words joined by one space, modulo ``buckets``."""
    texts = [w.encode() for w in words.distinct.to_pylist()]
    run, crc = words.word.astype(np.int64), np.array([zlib.crc32(t) for t in texts], np.int64)
    for n in range(1, longest + 1):
        if n > 1:  # the crc goes on from that of the run without its last word, once for each distinct run
            pair = run[:-1] * max(len(texts), 1) + words.word[n - 1 :]
            distinct, run = np.unique(pair, return_inverse=True)
            crc = np.array([zlib.crc32(b" " + texts[p % len(texts)], int(crc[p // len(texts)])) for p in distinct.tolist()], np.int64)
        at = words.runs(n)
        yield at, crc[run[at]] % buckets


def _counted(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in common.record_batches(batches):
            words = SPLITTER.words(b.column("text"), b.column("carried").to_numpy(zero_copy_only=False))
            for _, bucket in _buckets(words, longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(parts: tuple[DataFrame, ...], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs each bucket holds; one row a bucket comes to the driver."""
    rows = [p.mapInArrow(_counted(longest, buckets), "bucket long, n long") for p in parts]
    out = np.zeros(buckets, np.int64)
    for r in rows[0].unionByName(rows[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of every bucket."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.record_batches(batches):
            words = SPLITTER.words(b.column("text"), b.column("carried").to_numpy(zero_copy_only=False))
            features, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for at, bucket in _buckets(words, longest, len(gain)):
                np.add.at(features, words.text[at], 1)
                np.add.at(weight, words.text[at], gain[bucket])
            n_words = np.bincount(words.text[words.owned], minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n_words), pa.array(features), pa.array(weight)], names=["doc_id", "row", "n_words", "n_features", "weight"])

    return run


def weights(parts: tuple[DataFrame, DataFrame], gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row; chunks are summed by document."""
    columns = ["n_words", "n_features", "weight"]
    short, chunks = (p.mapInArrow(_weighed(gain, longest), "doc_id long, row long, n_words long, n_features long, weight long") for p in parts)
    whole = chunks.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in columns))
    return short.select("doc_id", *columns).unionByName(whole.select("doc_id", *columns))


def _keyed(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = ["" if i is None else i for i in b.column("doc_id").to_pylist()]
            h = (int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) for i in ids)
            key = [math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h]
            score = pc.add(b.column("weight"), pa.array(key, pa.int64()))
            yield b.append_column("score", score)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in common.record_batches(batches):
        yield b.append_column("part", pa.array(np.full(b.num_rows, part, np.int32))).append_column("at", pa.array(np.arange(at, at + b.num_rows)))
        at += b.num_rows


def draw(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` 1, 2, .. to the floor(percent n / 100) greatest scores (ties: least doc_id, null last), null to the rest."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    schema = "doc_id long, n_words long, n_features long, weight long, score long, part int, at long"
    rows = common.materialize(scored.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, schema), "ranked")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    drawn = rows.count() * percent // 100
    rank = F.col("base") + F.col("at") + 1
    return rows.join(base, "part").withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "at", "base")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED,
    key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (null: not drawn)."""
    parts = chunked(docs, longest, key, text)
    gain = gains(bucket_counts(parts, longest, buckets), bucket_counts(chunked(target, longest, target_key, target_text), longest, buckets))
    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    scored = common.materialize(weights(parts, gain, longest).mapInArrow(_keyed(seed), schema), "scored")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return draw(scored.where(F.col("n_words") >= least_words), percent).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
