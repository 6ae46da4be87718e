"""Words and runs of words of many texts at once, in Arrow batches: whole arrays, no loop over words.

A :class:`Splitter` knows which bytes are words, gaps and breaks (a break ends a run of words).  It
turns the texts of a batch into :class:`Words`: the distinct words, and for each place its word, its
text and its piece.  Delimiters are single ASCII bytes, so no cut falls inside a code point.

Long texts are cut into chunks at word boundaries, each followed by the ``n - 1`` words that runs
of ``n`` words may reach into (the carry).  A chunk owns the runs that start before its cut, so
every run of the whole text is counted exactly once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, GAP, BREAK = 0, 1, 2
#: A-Z alone are lower-cased.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of a text that are taken apart together.
CHUNK = 1 << 20


@dataclass
class Words:
    """Distinct words (Arrow strings) and, for every place in order: word number, text number, piece number, ownership."""

    distinct: pa.Array
    word: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    owned: np.ndarray

    def runs(self, n: int) -> np.ndarray:
        """Places where a run of n words of one piece begins, owned ones only."""
        last = len(self.word) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.owned[:last] & (self.piece[:last] == self.piece[n - 1 :]))


class Splitter:
    def __init__(self, gaps: bytes, breaks: bytes = b""):
        self.kind = np.zeros(256, np.uint8)
        self.kind[list(gaps)], self.kind[list(breaks)] = GAP, BREAK
        apart = re.escape(gaps + breaks)
        self.apart = re.compile(b"[" + apart + b"]")
        self.word = re.compile(b"[" + apart + b"]*[^" + apart + b"]+")

    def chunks(self, data: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
        """(bytes, words at the end that are carried, not owned) of a text, for runs of n words."""
        at = 0
        while len(data) - at > size:
            cut = self.apart.search(data, at + size)
            if not cut:
                break
            end, carried = cut.start(), 0
            while carried < n - 1 and (m := self.word.match(data, end)):
                end, carried = m.end(), carried + 1
            yield data[at:end], carried
            at = cut.start()
        yield data[at:], 0

    def words(self, texts: pa.Array, carried: np.ndarray | None = None) -> Words:
        """Words of lower-cased texts (null: none); ``carried`` words at the end of each text are not owned."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        off = np.asarray(texts.buffers()[1]).view(np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer((raw.to_pybytes() if raw else b"")[off[0] : off[-1]].translate(LOWER), np.uint8)
        off = off - off[0]
        kind = self.kind[data]
        inside = kind == WORD
        first = np.zeros(len(data) + 1, bool)  # first byte of a text
        first[off] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:-1]
        start = np.flatnonzero(begin)
        size = np.diff(np.append(np.cumsum(inside)[start] - 1, np.count_nonzero(inside))) if len(start) else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        strings = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[inside].tobytes()))
        coded = strings.dictionary_encode()
        text = np.searchsorted(off, start, side="right") - 1
        piece = np.cumsum(kind == BREAK)[start] + text if len(start) else text  # rises with each break and each text
        owned = np.ones(len(start), bool)
        if carried is not None and carried.any():
            stop = np.searchsorted(text, np.arange(len(carried)), side="right")
            for k in np.flatnonzero(carried):
                owned[stop[k] - carried[k] : stop[k]] = False
        return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), text, piece, owned)
