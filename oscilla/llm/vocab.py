"""Exact, bounded-memory encoding with the tokenizers library, piece by piece.

The byte-level pre-tokenizer ends a match wherever a character that is not white space is followed
by white space: no alternative of its pattern crosses that place, and none that ends there looks
further.  So a text falls into units (white space, then other characters), and encoding the units
one by one gives exactly the ids of the whole text, whatever special strings it holds (none holds
white space).  The library encodes each distinct unit; ids of frequent units are remembered.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: The characters of the Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space right before a space or a line feed: there neither begins a unit.
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_CUT = [c + cut for c in _BLANKS for cut in " \n"]
_CUT = re.compile(f"[^{WHITE}](?=[{WHITE}])")
#: Units that are remembered at most, and their greatest length in characters.
REMEMBER, LONGEST = 500_000, 48


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_pieces(text: str, most: int) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut only before white space that follows other characters."""
    at = 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most - 1)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def utf8_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet by rule: printable Latin-1 stands for itself, other bytes for 256, 257, ... in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_characters()
#: Perhaps a line feed, letters whose class no version of Unicode has changed, perhaps ASCII marks (no apostrophe): one match of the pattern each.
_WORD = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


class UnitEncoder:
    """Ids of whole texts, from Arrow arrays, without a Python step for each word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.marks: dict[str, list[int]] = {"": []}
        self.known: dict[str, bytes] = {}

    def _mark(self, marks: str) -> list[int]:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": []}
            self.marks[marks] = self.lib.encode(marks, add_special_tokens=False).ids
        return self.marks[marks]

    def _values(self, units: list[str], lead: str = "") -> list[bytes]:
        """Ids of units as bytes; each follows ``lead``, or nothing if it begins with a line feed.

        A plain word is one match of the pattern, so the library's model takes it as it is; all
        else goes through the library's whole pipeline.
        """
        later, model, known = [], self.lib.model, self.known
        room = len(known) < REMEMBER
        out = list(map(known.get, units)) if lead else [None] * len(units)
        for k in [k for k, v in enumerate(out) if v is None]:
            u = units[k]
            m = _WORD.fullmatch(u) if len(u) <= LONGEST else None
            if m:
                feed, word, marks = m.groups()
                if word.isascii():
                    word = "\u0120" + word if lead and not feed else word  # the space's letter in the byte alphabet
                else:
                    word = (lead + word if not feed else word).encode().decode("latin-1").translate(_ALPHABET)
                ids = [x.id for x in model.tokenize(word)]
                if feed:
                    ids[:0] = self._mark("\n")
                if marks:
                    ids += self._mark(marks)
                out[k] = array("I", ids).tobytes()
                if room and lead:
                    known[u] = out[k]
            else:
                later.append((k, u))
        for (k, u), e in zip(later, self.lib.encode_batch_fast([u if u[:1] == "\n" else lead + u for _, u in later], add_special_tokens=False), strict=True):
            out[k] = array("I", e.ids).tobytes()
            if room and lead and len(u) <= LONGEST:
                known[u] = out[k]
        return out

    def _plan(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct units' ids, the units of all texts in order as places in that list, and where texts end."""
        lists = pc.split_pattern(texts, " ")
        stops = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at = np.asarray(coded.indices).astype(np.int64)
        values = self._values(coded.dictionary.to_pylist(), " ")
        # a text's first unit has no space before it, and none at all if it is empty
        heads = np.concatenate([[0], stops[:-1]])
        first = pa.array([x or "" for x in lists.flatten().take(pa.array(heads)).to_pylist()]).dictionary_encode()
        at[heads] = np.asarray(first.indices) + len(values)
        values += [v if u else b"" for u, v in zip(first.dictionary.to_pylist(), self._values(first.dictionary.to_pylist()), strict=True)]
        return values, at, stops

    def _slice(self, texts: list[str], counts: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order (none if only counts are wanted) and the number of each text's ids."""
        odd = [k for k, t in enumerate(texts) if any(x in t for x in (_BEFORE_CUT if not t.isascii() else _BEFORE_CUT[:12]))]
        at_odd = set(odd)
        values, at, stops = self._plan(pa.array(["" if k in at_odd else t.replace("\n", " \n") for k, t in enumerate(texts)], pa.string()))
        if odd:  # white space of other kinds before a space: units by the pattern, put in place of the empty text's one
            units = [_UNITS.findall(texts[k]) for k in odd]
            distinct = sorted({u for x in units for u in x})
            place = {u: k + len(values) for k, u in enumerate(distinct)}
            values += self._values(distinct)
            starts = np.concatenate([[0], stops[:-1]])
            more = dict(zip(odd, units, strict=True))
            pieces = [np.array([place[u] for u in more[k]], np.int64) if k in more else at[i:j] for k, (i, j) in enumerate(zip(starts, stops, strict=True))]
            at, stops = np.concatenate(pieces), np.cumsum([len(x) for x in pieces])
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        each = size[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        n = np.diff(np.concatenate([[0], ends[stops]]))
        if counts:
            return np.zeros(0, np.int32), n
        pool = np.frombuffer(b"".join(values), np.int32)
        begin = np.cumsum(size) - size
        return pool[np.repeat(begin[at] - ends[:-1], each) + np.arange(ends[-1])], n

    def encode(self, texts: Iterable[str], counts: bool = False, most: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
        """As above for any number of texts: worked off in batches of about ``most`` bytes of UTF-8; longer texts are cut safely."""
        pieces, owner, ids, n = [], [], [], []
        size = total = 0

        def flush() -> None:
            nonlocal pieces, owner, size
            got, each = self._slice(pieces, counts)
            ids.append(got)
            n.append(np.bincount(np.array(owner) - owner[0], each, owner[-1] - owner[0] + 1).astype(np.int64) if counts or len(set(owner)) < len(owner) else each)
            spans.append(owner[0])
            pieces, owner, size = [], [], 0

        spans: list[int] = []
        for total, t in enumerate(texts, 1):
            long = utf8_length(t) > most
            for x in safe_pieces(t, most if t.isascii() else max(1, most // 4)) if long else (t,):
                n_bytes = utf8_length(x)
                if pieces and size + n_bytes > most:
                    flush()
                pieces.append(x)
                owner.append(total - 1)
                size += n_bytes
        if pieces:
            flush()
        out = np.zeros(total, np.int64)
        for at, each in zip(spans, n, strict=True):
            out[at : at + len(each)] += each
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
