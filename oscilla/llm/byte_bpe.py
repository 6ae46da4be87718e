"""Byte-level BPE as a monoid: encodings of neighbouring spans join, so a text is a tree reduction.

A span is encoded by halves.  Two neighbours join by re-encoding a window around the cut, which
grows on each side until it ends at a place where every scan of the pattern ends a match: a
character that is not white space, followed by white space, both within the side that was encoded
alone.  Matches left of the window's start and right of its end then provably stand, and so do
their tokens, since each match is encoded separately.

Where the stretch around the middle has no such place for longer than a leaf, the span is halved at
the stretch's end instead, where nothing needs joining; a span without any such place is taken
match by match, once, not again at each level.

A single match longer than a piece is reduced by the same tree over bytes, cut at pieces times
powers of two, so that runs of one character stay in step.  There the window grows by tokens until
its outer tokens are compatible with their neighbours: encoding the two tokens' bytes yields just
these two tokens.  A sequence of tokens is the BPE encoding of its bytes exactly if all adjacent
pairs are compatible.

Decoding concatenates the bytes of halves up the tree.

Defined results.  Null or empty text: no ids, empty bytes.  Repeated or null ids: a result for
each row.  Very long texts, stretches and matches: each level of the tree takes time in proportion
to the bytes at most, so the whole is never quadratic.  Empty table: empty result.  Extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oscilla.llm import common
from oscilla.llm.vocab import WHITE, default_path

#: Characters of a leaf; bytes of a leaf within one match.
LEAF, PIECE = 4096, 1536
_SAFE = re.compile(f"[^{WHITE}](?=[{WHITE}])")


class TreeEncoder:
    """Encodes and decodes by tree reduction with the ranks of a tiktoken file."""

    def __init__(self, path: str, pattern: str | None = None, leaf: int = LEAF, piece: int = PIECE):
        import public_tokenizers
        import regex
        import tiktoken

        pattern = pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.match = regex.compile(pattern)
        self.leaf, self.piece = leaf, piece

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.bpe.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        start, stop = self._safe_before(text, lo, mid), self._safe_after(text, mid, hi)
        if stop - start > self.leaf:
            if start == lo and stop == hi:
                return self._window(text[lo:hi])
            cut = start if start > lo and (stop == hi or mid - start <= stop - mid) else stop
            return self._span(text, lo, cut) + self._span(text, cut, hi)
        return self._join(text, start, mid, stop, self._span(text, lo, mid), self._span(text, mid, hi))

    def _safe_before(self, text: str, lo: int, mid: int) -> int:
        """The last place before ``mid`` where every scan ends a match; ``lo`` if there is none."""
        grow, last = 64, mid
        while last > lo:
            at = max(lo, mid - grow)
            found = [m.end() for m in _SAFE.finditer(text, at, min(mid, last + 2))]
            if found:
                return found[-1]
            grow, last = grow * 2, at
        return lo

    def _safe_after(self, text: str, mid: int, hi: int) -> int:
        """The first such place after ``mid``; ``hi`` if there is none."""
        m = _SAFE.search(text, mid, hi)
        return m.end() if m else hi

    def _join(self, text: str, start: int, mid: int, stop: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens left of ``start`` and right of ``stop`` stand; those between are encoded anew."""
        keep = len(left) - len(self._window(text[start:mid]))
        return left[:keep] + self._window(text[start:stop]) + right[len(self._window(text[mid:stop])) :]

    def _window(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        for m in self.match.finditer(text):
            out += self._bytes(m[0].encode())
        return out

    def _bytes(self, data: bytes) -> list[int]:
        """One match."""
        if len(data) <= self.piece:
            return self._merge(data)
        mid = self.piece << ((len(data) - 1) // self.piece).bit_length() - 1
        left, right = self._bytes(data[:mid]), self._bytes(data[mid:])
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self._merge(self.bpe.decode_bytes(left[i:] + right[:j]))
            if (i == 0 or self._stands(left[i - 1], window[0])) and (j == len(right) or self._stands(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def _merge(self, data: bytes) -> list[int]:
        return self.bpe._encode_single_piece(data)

    def _stands(self, a: int, b: int) -> bool:
        return self._merge(self.bpe.decode_single_token_bytes(a) + self.bpe.decode_single_token_bytes(b)) == [a, b]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.bpe.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_ENCODERS: dict[str, TreeEncoder] = {}


def tree_encoder(path: str) -> TreeEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TreeEncoder(path)
    return _ENCODERS[path]


def encode_texts(docs: DataFrame, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, tokens array<int>."""
    path = ranks or default_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tree_encoder(path)
        for b in common.record_batches(batches):
            ids = pa.array([enc.encode(t or "") for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "tokens"])

    return common.two_columns(docs, key, text).mapInArrow(run, "doc_id long, tokens array<int>")


def decode_tokens(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per row of (doc_id, tokens): doc_id, data binary (null tokens: empty)."""
    path = ranks or default_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tree_encoder(path)
        for b in common.record_batches(batches):
            data = pa.array([enc.decode(t or []) for t in b.column("tokens").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), data], names=["doc_id", "data"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks: str | None = None, key: str = "doc_id", text: str = "text", with_tokens: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and the tokens); encoding and decoding meet in one task."""
    path = ranks or default_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tree_encoder(path)
        for b in common.record_batches(batches):
            every, ids_sha, data_sha = [], [], []
            for t in b.column("text"):
                ids = enc.encode(t.as_py() or "")
                every.append(np.array(ids, "<u4"))
                ids_sha.append(hashlib.sha256(every[-1].tobytes()).hexdigest())
                data_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            n = np.array([len(x) for x in every], np.int64)
            cols = [b.column("doc_id"), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_tokens:
                stops = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                cols.append(pa.ListArray.from_arrays(stops, pa.array(np.concatenate(every).astype(np.int32))))
                names.append("tokens")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * with_tokens
    return common.two_columns(docs, key, text).mapInArrow(run, schema)
