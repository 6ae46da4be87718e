"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Method.  A short item inside a long document has a tiny Jaccard similarity with it, so sketches of
whole documents would miss it.  Items are therefore partitioned by the size of their shingle set
(a class holds sizes 2^k to 2^(k+1) - 1), and for each class a document is read in windows of
2^(k+2) shingles that overlap by half: any passage as long as an item of the class lies within
one window, with a similarity of at least 0.17.  Windows and items get fast similarity sketches of
``COORDS`` coordinates, and an item whose sketch agrees in a coordinate with a window's is a
candidate for the document (all coordinates differ with a probability of about 1e-11).  Candidates
are verified by exact containment: the share of the item's shingles among all of the document's.

A window without any shingle that an item's sketch is made of cannot agree in any coordinate, so
its sketch is not computed.

The items' sketches are sent to all tasks.  Their size is computed first; beyond
``common.BROADCAST_BYTES`` items are searched for in blocks of that size, each against all rows.

Defined results.  Null or empty texts and items without words: no hit.  Items with fewer words
than the shingle width: one shingle of all its words, sought among the document's runs of as many
words.  Repeated rows, ids and items: each document row is answered; an item id with several texts
counts each distinct one.  Null ids: kept as null.  Very long texts: all windows.  Empty tables:
empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.llm import common
from oscilla.llm.shingles import WIDTH, mix, shingle_hashes, sketch, word_hashes
from oscilla.llm.shingles import common as overlap

PERCENT = 75
COORDS = 128
_TABLE = 20


def _key(sk: np.ndarray) -> np.ndarray:
    """One number for a coordinate's place and value."""
    return mix(sk * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, len(sk) + 1, dtype=np.uint64))


class Part:
    """The items of one shingle width and size class."""

    def __init__(self, width: int, k: int, items: list[tuple[int | None, np.ndarray]]):
        self.width, self.window = width, 1 << (k + 2)
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        keys = [_key(sketch(s, COORDS)) for s in self.sets]
        owner = np.repeat(np.arange(len(items)), COORDS)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], owner[order]
        self.elements = np.unique(np.concatenate(self.sets))
        self.maybe = np.zeros(1 << _TABLE, bool)
        self.maybe[self.elements >> np.uint64(64 - _TABLE)] = True

    def search(self, h: np.ndarray) -> set[int]:
        """Items (by place) that share a sketch coordinate with a window of the sequence ``h``."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - _TABLE)])
        if not len(at):
            return set()
        near = np.searchsorted(self.elements, h[at])
        near[near == len(self.elements)] = 0
        at = at[self.elements[near] == h[at]]
        step = self.window // 2
        last = max(0, math.ceil((len(h) - self.window) / step))  # number of the last window
        wins = np.unique(np.concatenate([at // step, at // step - 1]))
        found: set[int] = set()
        for w in np.unique(np.clip(wins, 0, last)):
            keys = _key(sketch(np.unique(h[w * step : w * step + self.window]), COORDS))
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for i, j in zip(lo[hi > lo], hi[hi > lo], strict=True):
                found.update(self.owner[i:j].tolist())
        return found


class Index:
    """All items, partitioned; built once in each worker from their texts."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        groups: dict[tuple[int, int], dict] = {}
        for i, t in items:
            words = word_hashes((t or "").encode())
            if not len(words):
                continue
            width = min(WIDTH, len(words))
            s = np.unique(shingle_hashes(words, width))
            groups.setdefault((width, len(s).bit_length() - 1), {})[i, s.tobytes()] = (i, s)
        self.parts = [Part(w, k, list(g.values())) for (w, k), g in sorted(groups.items())]

    def hits(self, text: str | None, percent: int = PERCENT) -> list[tuple[int | None, int, int]]:
        """(item, its shingles, shared shingles) of all contained items."""
        words = word_hashes((text or "").encode())
        out, seqs, sets = [], {}, {}
        for p in self.parts:
            if len(words) < p.width:
                continue
            if p.width not in seqs:
                seqs[p.width] = shingle_hashes(words, p.width)
            found = p.search(seqs[p.width])
            if found and p.width not in sets:
                sets[p.width] = np.unique(seqs[p.width])
            for k in sorted(found):
                shared = overlap(p.sets[k], sets[p.width])
                if 100 * shared >= percent * len(p.sets[k]):
                    out.append((p.ids[k], len(p.sets[k]), shared))
        return out


SCHEMA = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"


def _search(docs: DataFrame, items: list[tuple[int | None, str | None]], percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for b in common.record_batches(batches):
            rows = [(d, i, n, m, m / n) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for i, n, m in index.hits(t.as_py(), percent)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            names = ["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.mapInArrow(run, SCHEMA)


def _blocks(benchmark: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks whose sketches stay below the broadcast bound."""
    items = common.two_columns(benchmark, item_key, item_text).where("text IS NOT NULL")
    # an item's keys and set take about 16 bytes for each coordinate and 8 for each byte of text
    size = items.agg(F.sum(F.octet_length("text") * 8 + COORDS * 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / common.BROADCAST_BYTES))
    held = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        rows = held.where(F.col("block") == k).select("doc_id", "text").distinct().collect()  # at most one block
        yield sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; a filter, so nothing is shuffled."""
    for items in _blocks(benchmark, item_key, item_text):
        docs = docs.where(_clean(items, percent)(F.col(f"`{text}`")))
    return docs


def _clean(items: list[tuple[int | None, str | None]], percent: int):
    built: list[Index] = []

    @F.pandas_udf("boolean")
    def clean(col: pd.Series) -> pd.Series:
        if not built:
            built.append(Index(items))
        return pd.Series([not built[0].hits(t, percent) for t in col], dtype=bool)

    return clean


def contained_items(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """A row for each document row and benchmark item contained in it to ``percent`` at least."""
    base = common.two_columns(docs, key, text)
    return reduce(DataFrame.unionByName, (_search(base, items, percent) for items in _blocks(benchmark, item_key, item_text)))
