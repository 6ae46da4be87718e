"""Phrases that occur far more often than their parts would by chance, for each language.

First pass: each task counts the runs of 1 to ``longest`` words of its texts in a count-min sketch of
``DEPTH`` rows of one-byte counters, which stop at 255; the sketches are merged block by block in
Spark.  A sketch overestimates only, so every run that occurs ``least`` times has large counters in
each row.  Which counters are large enough is one bit each: 2 * 8 MB at most for all of a corpus.
Second pass: runs whose bits are all set, the survivors, are counted exactly; a run that is not
frequent may survive and is dropped by its exact count.  So nothing frequent is lost, whatever the
sketch's width: the width, an eighth of the texts' bytes up to ``WIDEST``, decides only how many
rare runs are sent to the exact count.

Scores.  A candidate is a run of 2 words and more with a = f(phrase) >= least.  A cut after k words
gives l = f(first part), r = f(rest) and floor(10^6 a a / (l r)), in exact decimals; the cut with the least
score counts, the first of equals.  A part of a candidate is as frequent as the candidate, so it is
among the exact counts.  A candidate is subsumed if it lies in a longer candidate that occurs at
least ``share`` percent as often.

Runs are told apart by the texts themselves; the sketch alone uses hashes.  Counts are combined in
each task before they are shuffled; the tables of parts are salted, since one word may end or begin a
large share of all phrases.

Defined results.  Null text: empty.  Null lang: ``und``.  Null ids, repeated ids and rows: every row's
text counts.  Very long texts: whole, taken apart in chunks that own the runs which begin in them.
Ties: by the order stated at :func:`phrases`.  Empty table: empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.llm import common
from oscilla.llm.grams import Splitter, Words

SPLITTER = Splitter(b" \t", b".,;:!?\n\x0b\x0c\r")
DEPTH = 2
#: Counters of a row at most: a task holds DEPTH * WIDEST bytes, the second pass an eighth of that.
WIDEST = 1 << 26
NARROWEST = 1 << 16
#: Counters that are merged together.
BLOCK = 1 << 20
SALTS = 16
#: Bytes of texts that are sketched, and that are counted, together; texts beyond LONG are taken apart in chunks.
SKETCHED, COUNTED, LONG = 2 << 20, 4 << 20, 4 << 20
LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their differences over all bits."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _cells(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each hash in each row; ``width`` is a power of two."""
    return [(_mixed(hashes * _ODD[k] + np.uint64(k)) & np.uint64(width - 1)).astype(np.int64) for k in range(DEPTH)]


def _batches(batches: Iterator[pa.RecordBatch], longest: int, most: int) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Words of about ``most`` bytes of texts of (lang, text) at a time, with their language numbers and the languages; long texts in chunks."""
    for b in common.record_batches(batches):
        langs = b.column("lang").dictionary_encode()
        lang, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(size <= LONG)
        for some in np.split(plain, np.flatnonzero(np.diff(np.cumsum(size[plain], dtype=np.int64) // most)) + 1):
            if len(some):
                words = SPLITTER.words(b.column("text").take(pa.array(some)))
                yield words, lang[some][words.text], names
        for k in np.flatnonzero(size > LONG):
            for part, carried in SPLITTER.chunks(b.column("text")[int(k)].as_py().encode(), longest):
                words = SPLITTER.words(pa.array([part], pa.large_binary()).cast(pa.large_string()), np.array([carried]))
                yield words, np.full(len(words.word), lang[k]), names


def _hashes(words: Words, lang: np.ndarray, names: list[str]) -> np.ndarray:
    """For each place the hash of its word in its language."""
    of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in words.distinct.to_pylist()], np.uint64)
    of_lang = np.array([xxhash.xxh3_64_intdigest(n) for n in names], np.uint64)
    return _mixed(of_word[words.word] + of_lang[lang] * _ODD[2]) if len(words.word) else np.zeros(0, np.uint64)


def _runs(words: Words, one: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the runs of n words."""
    hashes = one
    for n in range(1, longest + 1):
        if n > 1:
            hashes = _mixed(hashes[:-1] * _ODD[0] + one[n - 1 :]) if len(hashes) > 1 else hashes[:0]
        at = words.runs(n)
        yield n, at, hashes[at]


def _sketched(width: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((DEPTH, width), np.uint8)
        for words, lang, names in _batches(batches, longest, SKETCHED):
            hashes = np.concatenate([h for _, _, h in _runs(words, _hashes(words, lang, names), longest)])
            distinct, counts = np.unique(hashes, return_counts=True)
            for row, cells in zip(rows, _cells(distinct, width), strict=True):
                order = np.argsort(cells, kind="stable")
                cells, n = cells[order], counts[order]
                begin = np.flatnonzero(np.diff(cells, prepend=-1))
                if len(begin):
                    cells = cells[begin]
                    row[cells] = np.minimum(row[cells] + np.add.reduceat(n, begin), 255)
        packer, block = zstandard.ZstdCompressor(level=1), min(BLOCK, width)
        for k in range(DEPTH):
            for j in range(width // block):
                part = rows[k, j * block : (j + 1) * block]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k * (width // block) + j], pa.int32()), pa.array([packer.compress(part.tobytes())], pa.binary())], names=["block", "counters"])

    return run


def _merged(width: int, least: int):
    """Sums of the counters of each block, rows arriving block by block; a bit for each that reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, block = zstandard.ZstdDecompressor(), min(BLOCK, width)
        now, total = None, None

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= min(least, 255)).tobytes()], pa.binary())], names=["block", "bits"])

        for b in common.record_batches(batches):
            for k, packed in zip(b.column("block").to_pylist(), b.column("counters").to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        yield bits()
                    now, total = k, np.zeros(block, np.uint16)
                total = np.minimum(total + np.frombuffer(unpacker.decompress(packed), np.uint8), 255).astype(np.uint16)
        if now is not None:
            yield bits()

    return run


def sketch_bits(texts: DataFrame, width: int, least: int = LEAST, longest: int = LONGEST) -> np.ndarray:
    """DEPTH rows of ``width`` bits: whether the merged counters reach ``least``.  At most DEPTH * WIDEST / 8 bytes."""
    if width > WIDEST or width & (width - 1):
        raise ValueError("the width must be a power of two of at most WIDEST")
    blocks = texts.mapInArrow(_sketched(width, longest), "block int, counters binary")
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(width, least), "block int, bits binary")
    out = np.zeros(DEPTH * width // 8, np.uint8)
    step = min(BLOCK, width) // 8
    for r in merged.toLocalIterator():  # a bounded number of rows, whatever the corpus
        out[r.block * step : (r.block + 1) * step] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(DEPTH, width // 8)


def _survivors(bits, width: int, longest: int):
    """(lang, n, phrase, c) of surviving runs, counted within each batch; phrase null: all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = bits.value
        for words, lang, names in _batches(batches, longest, COUNTED):
            text_of = words.distinct.to_pylist()
            total = np.bincount(lang[words.owned], minlength=len(names)) if len(lang) else np.zeros(len(names), np.int64)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for name, n in zip(names, total.tolist(), strict=True):
                if n:
                    for column, v in zip(out, (name, 0, None, n), strict=True):
                        column.append(v)
            for n, at, hashes in _runs(words, _hashes(words, lang, names), longest):
                stays = np.ones(len(hashes), bool)
                for row, cells in zip(rows, _cells(hashes, width), strict=True):
                    stays &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                at = at[stays]
                # runs are equal if their languages and words are
                key = lang[at].astype(np.int64)
                for j in range(n):
                    # numbers stay below the number of places times the number of words, far below 2^63
                    key = np.unique(key, return_inverse=True)[1] * len(text_of) + words.word[at + j] if len(at) else key
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                place = at[first]
                out[0].extend(names[k] for k in lang[place])
                out[1].extend([n] * len(place))
                parts = [[text_of[w] for w in words.word[place + j]] for j in range(n)]
                out[2].extend(map(" ".join, zip(*parts, strict=True)))
                out[3].extend(count.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["lang", "words", "phrase", "c"])

    return run


def _sent(bits: np.ndarray, docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(bits)  # DEPTH * WIDEST / 8 bytes at most


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", width: int | None = None) -> DataFrame:
    """(lang, words, phrase, f): every run of 1 to ``longest`` words that occurs ``least`` times and more, and a row with
    words = 0 and a null phrase for each language's number of words.  Written to the shared folder."""
    common.bound_batches(docs.sparkSession)
    texts = common.spread(docs).select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    if width is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width = min(WIDEST, max(NARROWEST, 1 << max(0, (int(size) // 8 - 1).bit_length())))
    bits = _sent(sketch_bits(texts, width, least, longest), texts)
    found = texts.mapInArrow(_survivors(bits, width, longest), "lang string, words int, phrase string, c long")
    counted = found.groupBy("lang", "words", "phrase").agg(F.sum("c").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))
    return common.materialize(counted, "frequent")


def _part(first: int | Column, n: Column | None = None) -> Column:
    return F.array_join(F.slice("ws", first, n), " ")


def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of every candidate of the exact counts."""
    cand = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    # a word may begin or end a large share of the candidates: a single word's row stands in SALTS places, a longer part's in one
    places = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    parts = counts.where(f"words BETWEEN 1 AND {max(1, longest - 1)}").select("lang", "phrase", "f", F.explode(places).alias("salt"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    for side, name, single in (("first", "l", F.col("k") == 1), ("rest", "r", F.col("k") == F.col("words") - 1)):
        cuts = cuts.withColumn("salt", F.when(single, salt).otherwise(0))
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name), "salt"), ["lang", side, "salt"]).drop("salt")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top div under"))
    best = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "words", "phrase", "a", "b.l", "b.r", "b.score")


def subsumed(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase) of candidates that lie in a longer candidate which occurs at least ``share`` percent as often."""
    long = counts.where("words >= 3").withColumn("ws", F.split("phrase", " "))
    inner = long.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("s", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    within = inner.select("lang", _part(F.col("s"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return counts.where("words >= 2").join(within, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("f") * share).select("lang", "phrase")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, text: str = "text", lang: str = "lang", width: int | None = None) -> DataFrame:
    """Each language's first ``top`` phrases by score and a descending, then phrase: lang, rank, phrase, a, l, r, n, score."""
    counts = frequent(docs, least, longest, text, lang, width)
    left = scored(counts, longest).join(subsumed(counts, share), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the best of each of SALTS parts first, so that no task orders all phrases of one language
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = left.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("_r") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
