"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of whole texts in it, lower-cased and
with all but letters turned into single spaces, so that capitals, digits and symbols do not count.
Texts that dictionaries of other texts assign to another language are left out of the dictionaries
(labels may be wrong).  A text is treated alike and cut into blocks, every block is compressed with every language's dictionary, and the language with the
smallest total wins; on equal totals, the one that more learned rows have.  The margin is the
relative distance of the second-smallest total; below ``MARGIN`` the decision is marked rejected.

Fitting uses a bounded sample, by documented parameters: ``PER_LANGUAGE`` distinct rows of each
language at most, of each an eighth of a dictionary at most (of a longer text, the part from a
place that its hash gives), and of these three times the bytes of a dictionary.  Every language has
a full dictionary if its rows have the text for it.  All dictionaries together may have
``MODEL_BYTES``; more is an error, not a smaller dictionary.  Prediction covers every row and whole
texts; languages are taken ``AT_ONCE`` at a time, so prepared dictionaries never add up.

Defined results.  Null text or no letter: ``und``, score 0, rejected.  No learned language: ``und``
too.  Repeated or null ids: a result for each row; equal rows are learned from once.  Equal totals:
the language with more learned rows, then the first by name.  Very long texts: block by block.  Empty table:
empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.llm import common
from oscilla.llm.samples import CLASSES, bounded_sample

PER_LANGUAGE = 400
DICTIONARY = 112 << 10
BLOCK = 2 << 10
MODEL_BYTES = 192 << 20
AT_ONCE = 64
LEVEL = 9
MARGIN = 0.01


def held_out(key: str):
    return F.coalesce(common.crc_mod(key, 4) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, dictionary: int = DICTIONARY, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of learned rows, ties by name."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id") & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(CLASSES + 1).collect()}
    if not counts:
        return []
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} languages")
    part, most = dictionary // 8, 3 * dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.record_batches(batches):
            got = [(lang, zlib.crc32(t.encode()), piece(t, part)) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["lang", "place", "text"])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "text"], kind="stable")
        size = pdf["text"].map(lambda t: len(t.encode()))
        return pdf[size.cumsum() - size < most]

    schema = "lang string, place long, text string"
    picked = bounded_sample(rows, "lang", ["doc_id", "text"], per_language).select("lang", "text").mapInArrow(run, schema).distinct()
    texts: dict[str, list[str]] = {name: [] for name in counts}
    for r in picked.groupBy("lang").applyInPandas(first, schema).toLocalIterator():  # a bounded sample
        texts[r["lang"]].append((r["place"], r["text"]))
    order = sorted(counts, key=lambda x: (-counts[x], x))
    if sum(min(dictionary, sum(len(t.encode()) for _, t in texts[name])) for name in order) > MODEL_BYTES:
        raise ValueError(f"the dictionaries of {len(order)} languages take more than {MODEL_BYTES} bytes")
    known = [(name, t) for name in order for _, t in sorted(texts[name])]
    halves = [known[::2], known[1::2]]
    for k in (0, 1, 0, 1):  # each half is cleaned by the other's dictionaries
        judge = Compressor(dictionaries(halves[k], order, dictionary))
        halves[1 - k] = [r for r, got in zip(halves[1 - k], judge.predict_all([t for _, t in halves[1 - k]]), strict=True) if got[0] == r[0]]
    clean = dictionaries(halves[0] + halves[1], order, dictionary)
    # a language whose rows all look like others' is learned from as it is
    return [(name, data or whole) for (name, data), (_, whole) in zip(clean, dictionaries(known, order, dictionary), strict=True)]


def piece(text: str, most: int) -> str:
    """The text's letters; of more than ``most`` bytes a part of that length, from a place given by its hash."""
    data = letters(text).encode()
    if len(data) > most:
        at = zlib.crc32(data) % (len(data) - most + 1)
        data = data[at : at + most]
    return data.decode(errors="ignore")


def dictionaries(rows: list[tuple[str, str]], order: list[str], room: int) -> list[tuple[str, bytes]]:
    """Each language's texts in order until its room is full; the last one as far as it goes."""
    data = {name: bytearray() for name in order}
    for name, t in rows:
        data[name] += (t.encode() + b"\n")[: room - len(data[name])]
    return [(name, bytes(x)) for name, x in data.items()]


@cache
def _other():
    import regex

    return regex.compile(r"[^\p{L}]+")


def letters(text: str) -> str:
    """Lower case, anything between letters as one space."""
    return _other().sub(" ", text.lower())


def _compressor(data: bytes, level: int):
    import zstandard

    d = zstandard.ZstdCompressionDict(data.rjust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)  # eight bytes at least
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False)


class Compressor:
    """Predicts with a prepared compressor for each language, ``at_once`` of them at a time."""

    def __init__(self, model: list[tuple[str, bytes]], level: int = LEVEL, at_once: int = AT_ONCE):
        self.names, self.data, self.level, self.at_once = [name for name, _ in model], [x for _, x in model], level, at_once
        self.kept: list = []  # all compressors, if they are few

    def _some(self, k: int) -> list:
        if len(self.names) > self.at_once:
            return [_compressor(x, self.level) for x in self.data[k : k + self.at_once]]
        self.kept = self.kept or [_compressor(x, self.level) for x in self.data]
        return self.kept

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score (the posterior of code lengths) and margin of each text."""
        plain = [letters(t or "").strip().encode() if self.names else b"" for t in texts]
        asked = [k for k, data in enumerate(plain) if data]
        sizes: list[list[int]] = [[] for _ in asked]
        for k in range(0, len(self.names), self.at_once):
            each = self._some(k)
            for row, data in zip(sizes, (plain[i] for i in asked), strict=True):
                blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                row += [sum(len(c.compress(b)) for b in blocks) for c in each]
        out = [("und", 0.0, 0.0)] * len(texts)
        for i, row in zip(asked, sizes, strict=True):
            best = min(range(len(row)), key=row.__getitem__)
            rest = sorted(row)[:2]
            margin = (rest[1] - rest[0]) / rest[1] if len(rest) > 1 else 1.0
            total = sum(math.exp(max(-60.0, -0.5 * (s - row[best]))) for s in row)
            out[i] = self.names[best], 1 / total, margin
        return out


def predict(docs: DataFrame, model: list[tuple[str, bytes]], margin: float = MARGIN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, margin, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressor(held.value)
        for b in common.record_batches(batches):
            got = c.predict_all(b.column("text").to_pylist())
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "lang_pred", "score", "margin"])

    out = common.two_columns(docs, key, text).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")
    return out.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", (F.col("margin") < margin).alias("rejected"))
