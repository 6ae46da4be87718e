"""Personal data: fixed base rules, widened by a semi-Markov conditional random field.

Base.  Emails, IPv4 addresses, payment cards and phone numbers by the patterns below, leftmost and
non-overlapping for each kind; matches that fail their test are dropped.

Method.  Around digits and at-signs the text is cut into tokens.  A segment of up to ``LONGEST``
tokens may be an entity of one of the four kinds; features of the whole span (its shape, digit
groups, checksums, what stands on either side) score each candidate segment and kind, all other
tokens score zero, and bounded-entity dynamic programming chooses boundaries and kinds jointly.
Segments must hold a digit or an at-sign, so stretches without them are outside every entity and
windows between such stretches can be decoded one by one with the same result.  A segment of
digits and their separators alone has 7 to 19 digits, or 4 or more and three points.  The model is
fitted by conditional likelihood (forward and backward sums over segments) to sentences made by
rule with a fixed seed.  Spans that it finds beside the base's are added; base spans stay.

Defined results.  Null and empty texts: no spans.  Repeated rows and ids: each row is answered.
Very long texts: whole; every pattern runs in linear time, and decoding keeps some bytes a token:
segments are scored as they come, by sums that equal shapes share, and numeric ones a block of starts at a time.  Empty table: empty result.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.llm import common

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24
_DIM = 1 << 13

# ---- base rules -------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]\s?at\s?[)\]]", re.I)


_TWICE = {str(d): d * 2 - 9 * (d > 4) for d in range(10)}
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(map(_TWICE.__getitem__, digits[-2::-2]))) % 10 == 0


def _digits(s: str) -> str:
    return _NO_DIGIT.sub("", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base matches, ascending."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            last = m.end()
            out.append((lo, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- semi-Markov model ------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_AT = re.compile(r"@|[(\[]\s?at\s?[)\]]", re.I)
_GROUP = re.compile(r"[0-9]+")


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) & (_DIM - 1)


def _of_shape(shape: str, first: str) -> list[str]:
    """Features that equal shapes share."""
    groups = [int(g) for g in re.findall(r"([0-9]+);", shape)]
    coarse = re.sub(r"(?:9|\W9)+", "9", re.sub(r"[0-9]+;", "9", shape))[:12]
    return ["bias", "shape " + shape, "coarse " + coarse, f"digits {min(sum(groups), 20)}", f"groups {min(len(groups), 6)}", "first " + first]


def _of_digits(span: str, digits: str) -> list[str]:
    """Checks of the digits themselves."""
    f = []
    if 12 < len(digits) < 20:
        f.append("luhn" if luhn(digits) else "no luhn")
    if len(span) == len(digits) + 3 and span.count(".") == 3:
        groups = _GROUP.findall(span)
        if len(groups) == 4:
            f.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "no octets")
    return f


def _of_at(span: str) -> list[str]:
    if not _AT.search(span):
        return []
    left, right = _AT.split(span, maxsplit=1)
    local = " local" if re.fullmatch(r"[\w.%+-]+\s?", left, re.A) else " odd"
    host = " host" if re.fullmatch(r"\s?[\w-]+((\.|\s?[(\[]\s?dot\s?[)\]]\s?)[\w-]+)+", right, re.A | re.I) else " odd"
    return ["at" + local + host]


def _of_left(text: str, lo: int) -> list[str]:
    before = re.findall(r"\w+", text[max(0, lo - 24) : lo])
    return [
        "before " + (before[-1].lower() if before else ""),
        "left " + (text[lo - 1] if lo and not text[lo - 1].isalnum() else "x" if lo else ""),
        "joined" if lo > 1 and text[lo - 1] in "-./:," and text[lo - 2].isalnum() else "free",
    ]


def _of_right(text: str, hi: int) -> list[str]:
    after = text[hi : hi + 2]
    return ["right " + ("x" if after[:1].isalnum() or (after[:1] in ("-", ".", "/", ":", ",") and after[1:].isalnum()) else " ")]


def _first(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.isalpha() else c


def _shape(token: str, c: str) -> str:
    return f"{min(len(token), 20)};" if "0" <= c <= "9" else "a" if c.isalnum() and not c.isdecimal() else token


def features(text: str, lo: int, hi: int) -> list[int]:
    """Features of the whole span text[lo:hi] and its surroundings."""
    span = text[lo:hi]
    shape = "".join(_shape(m[0], m[0][0]) for m in _TOKEN.finditer(span))
    f = _of_shape(shape, _first(span[0])) + _of_digits(span, _digits(span)) + _of_at(span) + _of_left(text, lo) + _of_right(text, hi)
    return [_hash(x) for x in f]


_DIGIT, _LETTER, _SPACE, _BREAK, _AT_OR_BRACKET, _SEPARATOR, _OTHER = range(7)
_CLASS = {"@": _AT_OR_BRACKET, "(": _AT_OR_BRACKET, "[": _AT_OR_BRACKET} | dict.fromkeys(").+-", _SEPARATOR)


def token_arrays(text: str, lo: int = 0, hi: int | None = None) -> tuple[array, bytearray]:
    """Starts of the tokens of text[lo:hi] with its end behind them, and their classes."""
    starts, classes = array("q"), bytearray()
    for m in _TOKEN.finditer(text, lo, len(text) if hi is None else hi):
        c = text[m.start()]
        starts.append(m.start())
        if "0" <= c <= "9":
            classes.append(_DIGIT)
        elif c.isspace():
            classes.append(_BREAK if "\n" in m[0] else _SPACE)
        else:
            classes.append(_CLASS.get(c) or (_LETTER if c.isalnum() else _OTHER))
    starts.append(len(text) if hi is None else hi)
    return starts, classes


def segments_from(text: str, starts: array, classes: bytearray, i: int, next_at: int) -> Iterator[tuple[int, bool, int]]:
    """Candidate segments that begin with token i, as (end token, numeric, digits): whole words, with a digit or an at-sign, either
    numeric or around one at-sign.  ``next_at``: the first token from i on that may belong to an at-sign."""
    lo, k = starts[i], classes[i]
    c = text[lo]
    if k in (_SPACE, _BREAK) or (lo and c.isalnum() and text[lo - 1].isalnum()) or not (c.isalnum() or c in "+("):
        return
    n, size = len(classes), len(text)
    last = min(n, i + LONGEST)
    numeric, digits, dots = True, 0, 0
    for j in range(i, last):
        k, hi = classes[j], starts[j + 1]
        if k == _BREAK:
            return
        if k == _DIGIT:
            digits += hi - starts[j]
        elif k in (_LETTER, _OTHER) or (k == _AT_OR_BRACKET and text[starts[j]] != "("):
            numeric = False
        elif text[starts[j]] == ".":
            dots += 1
        if next_at >= last and (not numeric or digits > 19):
            return  # no at-sign in reach: nothing longer is a candidate
        if k > _LETTER and not text[hi - 1].isalnum() or k == _SPACE or (hi < size and text[hi].isalnum()):
            continue
        if numeric:
            if 7 <= digits <= 19 or (dots == 3 and 4 <= digits <= 12):
                yield j + 1, True, digits
            continue
        span = text[lo:hi]
        ats = len(_AT.findall(span)) if next_at <= j else 0
        if ats == 1 and len(span.split()) <= 7:
            yield j + 1, False, digits
        elif ats == 0 and len(span.split()) > 3:
            return


def _next_at(classes: bytearray, i: int, known: int) -> int:
    """The first token from i on that may belong to an at-sign; ``known`` is the answer for i - 1."""
    return known if known >= i else classes.find(_AT_OR_BRACKET, i) if classes.find(_AT_OR_BRACKET, i) >= 0 else len(classes)


def segments(text: str) -> tuple[array, list[tuple[int, int]]]:
    """Token starts and all candidate segments (first token, end token) of a text."""
    starts, classes = token_arrays(text)
    out, at = [], -1
    for i in range(len(classes)):
        at = _next_at(classes, i, at)
        out += [(i, j) for j, _, _ in segments_from(text, starts, classes, i, at)]
    return starts, out


#: Tokens from which on numeric segments are scored by arrays, and starts that are scored together.
DENSE, DENSE_BLOCK = 512, 1 << 14


class _NumericShapes:
    """Numeric segments of many starts at once.  A shape is a state, reached from the shape without its last token; every
    state's features are summed once, however many segments have it."""

    def __init__(self, model: SemiCRF):
        self.model = model
        self.tokens: dict[str, int] = {}
        self.clear()
        part = lambda x: np.array(model.part([x]))
        self.checks = np.array([part("no luhn"), part("luhn"), part("no octets"), part("octets"), np.zeros(len(KINDS))])
        self.right = np.array([model.part(["right  "]), model.part(["right x"])])

    def clear(self) -> None:
        self.states, self.next, self.own = [""], {}, [None]
        self.tokens = {f"{k};": k for k in range(21)}
        self.lefts: dict[tuple[str, ...], tuple[float, ...]] = {}

    def _step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The states after one more token each; only pairs that are new cost a look-up."""
        pairs, where = np.unique(state * (1 << 24) + token, return_inverse=True)
        names = None
        out = np.empty(len(pairs), np.int64)
        for k, pair in enumerate(pairs.tolist()):
            got = self.next.get(pair)
            if got is None:
                names = names or list(self.tokens)
                got = self.next[pair] = len(self.states)
                self.states.append(self.states[pair >> 24] + names[pair & 0xFFFFFF])
                self.own.append(None)
            out[k] = got
        return out[where]

    def _sums(self, state: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(state, return_inverse=True)
        for k in distinct.tolist():
            if self.own[k] is None:
                shape = self.states[k]
                self.own[k] = self.model.part(_of_shape(shape, "9" if "0" <= shape[0] <= "9" else shape[0]))
        return np.array([self.own[k] for k in distinct.tolist()])[where]

    def _left(self, text: str, lo: int) -> tuple[float, ...]:
        names = tuple(_of_left(text, lo))
        got = self.lefts.get(names)
        if got is None:
            got = self.lefts[names] = self.model.part(list(names))
        return got

    def scored(self, text: str, starts: array, classes: bytearray, a: int, b: int) -> list[tuple[int, int, float, int]]:
        """(first token, end token, score, kind) of segments that begin with tokens a .. b - 1, by first and end token."""
        if len(self.states) > 200_000 or len(self.lefts) > 200_000 or len(self.tokens) > 100_000:
            self.clear()
        n = len(classes)
        b, e = min(b, n), min(b + LONGEST, n)
        cls, at = np.frombuffer(classes[a : e + 1], np.uint8)[: e - a], np.array(starts[a : e + 1], np.int64)
        size = np.diff(at)
        char = np.frombuffer(text[at[0] : at[-1] + 1].encode("utf-32-le", "surrogatepass"), "<u4")[at[:-1] - at[0]]
        digit = cls == _DIGIT
        word = np.append(digit | (cls == _LETTER), at[-1] < len(text) and text[at[-1]].isalnum())  # whether a token begins with a word's character
        before = np.concatenate([[at[0] > 0 and text[at[0] - 1].isalnum()], word[:-1]])[: e - a]
        fine = digit | (cls == _SPACE) | (cls == _SEPARATOR)
        first = np.flatnonzero(((digit & ~before) | ((cls == _SEPARATOR) & (char == ord("+"))))[: b - a])
        digits = np.concatenate([[0], np.cumsum(size * digit)])
        dots = np.concatenate([[0], np.cumsum((cls == _SEPARATOR) & (char == ord(".")))])
        token = np.where(digit, np.minimum(size, 20), 0)
        for k in np.flatnonzero(fine & ~digit).tolist():
            token[k] = self.tokens.setdefault(text[at[k] : at[k + 1]], len(self.tokens))
        state, found = np.zeros(len(first), np.int64), []
        for length in range(1, LONGEST + 1):
            last = first + length - 1
            stays = last < e - a
            stays[stays] = fine[last[stays]]
            first, last, state = first[stays], last[stays], state[stays]
            n_digits = digits[last + 1] - digits[first]
            stays = n_digits <= 19
            first, last, n_digits = first[stays], last[stays], n_digits[stays]
            if not len(first):
                break
            state = self._step(state[stays], token[last])
            n_dots = dots[last + 1] - dots[first]
            good = digit[last] & ~word[last + 1] & (((n_digits >= 7) & (n_digits <= 19)) | ((n_dots == 3) & (n_digits >= 4) & (n_digits <= 12)))
            found.append(np.stack([x[good] for x in (first, last + 1, state, n_digits, n_dots)]))
        first, stop, state, n_digits, n_dots = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        if not len(first):
            return []
        total = self._sums(state)
        some, where = np.unique(first, return_inverse=True)
        total += np.array([self._left(text, at[k]) for k in some.tolist()])[where]
        # beside what follows: a sign and then a word's character, or not
        after = np.zeros(len(stop), np.int64)
        inner = stop < e - a - 1
        after[inner] = np.isin(char[stop[inner]], [ord(c) for c in "-./:,"]) & word[stop[inner] + 1]
        for k in np.flatnonzero(~inner).tolist():
            after[k] = _of_right(text, int(at[stop[k]])) == ["right x"]
        total += self.right[after]
        check = np.full(len(first), 4)
        long = (n_digits > 12) & (n_digits < 20)
        if long.any():
            d = np.frombuffer("".join(text[at[k] : at[k + 1]] for k in np.flatnonzero(digit).tolist()).encode(), np.uint8).astype(np.int64) - 48
            twice = d * 2 - 9 * (d > 4)
            odd = np.arange(len(d)) % 2 == 1
            sums = [np.concatenate([[0], np.cumsum(np.where(odd == side, d, twice))]) for side in (False, True)]
            p, q = digits[first[long]], digits[stop[long]]
            check[long] = np.where((q - 1) % 2 == 0, sums[0][q] - sums[0][p], sums[1][q] - sums[1][p]) % 10 == 0
        for k in np.flatnonzero((n_dots == 3) & (at[stop] - at[first] == n_digits + 3)).tolist():
            said = _of_digits(text[at[first[k]] : at[stop[k]]], "0" * int(n_digits[k]))
            total[k] += self.checks[3 if "octets" in said else 2 if "no octets" in said else 4]  # beside a checksum, if it has one
        total += self.checks[check]
        top = total.max(axis=1)
        keep = np.flatnonzero(top > 0)
        keep = keep[np.lexsort((stop[keep], first[keep]))]
        return list(zip((first[keep] + a).tolist(), (stop[keep] + a).tolist(), top[keep].tolist(), total[keep].argmax(axis=1).tolist(), strict=True))


class SemiCRF:
    """Weights by kind and feature; entities score by segment, other tokens zero."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight
        self.shapes: dict[tuple[str, str], tuple[float, ...]] = {}
        self.right: dict[str, tuple[float, ...]] = {}
        self.table: list[tuple[float, ...]] = []
        self.rest: tuple[tuple[float, ...], ...] = ()
        self.numeric: _NumericShapes | None = None

    def __reduce__(self):
        return SemiCRF, (self.weight,)  # what is remembered stays behind

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return np.array([self.weight[:, f].sum(axis=1) for f in feats]).reshape(len(feats), len(KINDS))

    def part(self, names: list[str]) -> tuple[float, ...]:
        """Sums over some features, one for each kind."""
        if not self.table:
            self.table = [tuple(x) for x in self.weight.T.astype(float).tolist()]
        a, b, c, d = 0.0, 0.0, 0.0, 0.0
        for x in names:
            e, f, g, h = self.table[_hash(x)]
            a, b, c, d = a + e, b + f, c + g, d + h
        return a, b, c, d

    def _most_of_rest(self, *sets: tuple[str, ...]) -> tuple[float, ...]:
        """What the right side and one feature at most of each of ``sets`` can add to a segment at most, for each kind."""
        right, most = self.right.values(), [[self.part([x]) for x in some] for some in sets]
        return tuple(max(r[y] for r in right) + sum(max(0.0, *(x[y] for x in some)) for some in most) + 1e-9 for y in range(len(KINDS)))

    def decode_text(self, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """The best set of disjoint entities (start, kind, end) of text[lo:hi], scored as segments come; some bytes a token are kept."""
        starts, classes = token_arrays(text, lo, hi)
        n = len(classes)
        best, reach, back, kind = array("d", [0.0]) * (n + 1), array("d", [-math.inf]) * (n + 1), array("q", [-1]) * (n + 1), bytearray(n + 1)
        if not self.right:
            self.right = {x: self.part(["right " + x]) for x in ("x", " ")}
            # by what a numeric segment's digits are checked for: nothing, Luhn's sum, octets
            sums, octets = ("luhn", "no luhn"), ("octets", "no octets")
            self.rest = self._most_of_rest(), self._most_of_rest(sums, octets), self._most_of_rest(octets)
        right, shapes, at = self.right, self.shapes, -1
        dense = self._dense(text, starts, classes) if n >= DENSE else None
        for i in range(n + 1):
            if i:
                best[i] = best[i - 1]
                if reach[i] > best[i] + 1e-12:
                    best[i] = reach[i]
                else:
                    back[i] = -1
            if i == n:
                break
            at = _next_at(classes, i, at)
            if dense and at >= min(n, i + LONGEST):
                for j, top, y in dense(i):
                    if best[i] + top > reach[j] + 1e-12:
                        reach[j], back[j], kind[j] = best[i] + top, i, y
                continue
            shape, done, left = "", i, None
            for j, numeric, size in segments_from(text, starts, classes, i, at):
                if left is None:
                    left, first = self.part(_of_left(text, starts[i])), _first(text[starts[i]])
                    l0, l1, l2, l3 = left
                for k in range(done, j):
                    token = text[starts[k] : starts[k + 1]]
                    shape += _shape(token, token[0])
                done = j
                own = shapes.get((shape, first))
                if own is None:
                    if len(shapes) > 100_000:
                        shapes.clear()
                    own = shapes[shape, first] = self.part(_of_shape(shape, first))
                a, b, c, d = own
                a, b, c, d = a + l0, b + l1, c + l2, d + l3
                if numeric:
                    r0, r1, r2, r3 = self.rest[1 if size > 12 else 2 if shape.count(".") == 3 else 0]
                    if a + r0 <= 0 and b + r1 <= 0 and c + r2 <= 0 and d + r3 <= 0:
                        continue  # whatever the rest adds, the segment scores below nothing
                span = text[starts[i] : starts[j]]
                e, f, g, h = self.part(_of_digits(span, _digits(span)) + ([] if numeric else _of_at(span)))
                w, x, y, z = right[_of_right(text, starts[j])[0][6:]]
                total = a + e + w, b + f + x, c + g + y, d + h + z
                top = max(total)
                if best[i] + top > reach[j] + 1e-12:
                    reach[j], back[j], kind[j] = best[i] + top, i, total.index(top)
        out, j = [], n
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                out.append((starts[back[j]], kind[j], starts[j]))
                j = back[j]
        return out[::-1]

    def _dense(self, text: str, starts: array, classes: bytearray) -> Callable[[int], Iterator[tuple[int, float, int]]]:
        """(end token, score, kind) of the numeric segments of each start that score above nothing, starts asked for in ascending
        order and without an at-sign in reach: scored for a block of starts at a time, as whole arrays."""
        self.numeric = self.numeric or _NumericShapes(self)
        block, at, hi = [], 0, 0

        def of(i: int) -> Iterator[tuple[int, float, int]]:
            nonlocal block, at, hi
            if i >= hi:
                hi = i + DENSE_BLOCK
                block, at = self.numeric.scored(text, starts, classes, i, hi), 0
            while at < len(block) and block[at][0] < i:
                at += 1
            while at < len(block) and block[at][0] == i:
                yield block[at][1:]
                at += 1

        return of

    def decode(self, n: int, segs: list[tuple[int, int]], score: np.ndarray) -> list[tuple[int, int, int]]:
        """The best set of disjoint (first token, kind, end token); on ties fewer and shorter entities."""
        ends: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(segs):
            ends.setdefault(j, []).append(k)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for k in ends.get(j, ()):
                y = int(score[k].argmax())
                v = best[segs[k][0]] + score[k, y]
                if v > best[j] + 1e-12:
                    best[j], back[j] = v, (segs[k][0], y)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, y = back[j]
                out.append((i, y, j))
                j = i
        return out[::-1]

    def likelihood_step(self, n: int, segs: list[tuple[int, int]], feats: list[list[int]], gold: set[tuple[int, int, int]], rate: np.ndarray, power: float, decay: float) -> None:
        """One step uphill on log P(gold): observed less expected feature counts, with per-weight step sizes."""
        s = self.scores(feats)
        fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fwd[0] = bwd[n] = 0.0
        total = np.logaddexp.reduce(s, axis=1) if len(segs) else np.zeros(0)
        ends, begins = {}, {}
        for k, (i, j) in enumerate(segs):
            ends.setdefault(j, []).append(k)
            begins.setdefault(i, []).append(k)
        for j in range(1, n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(fwd[segs[k][0]] + total[k] for k in ends.get(j, ()))])
        for i in range(n - 1, -1, -1):
            bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[segs[k][1]] + total[k] for k in begins.get(i, ()))])
        for k, (i, j) in enumerate(segs):
            p = np.exp(fwd[i] + s[k] + bwd[j] - fwd[n])
            for y in range(len(KINDS)):
                g = float((i, y, j) in gold) - p[y]
                if abs(g) > 1e-4:
                    f = feats[k]
                    grad = g - decay * self.weight[y, f]
                    rate[y, f] += grad * grad
                    self.weight[y, f] += power * grad / np.sqrt(rate[y, f])


def _made(rng: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    """A sentence with marked entities and look-alikes."""
    word = lambda: "".join(rng.choice("bcdfglmnprstvwzhk") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card(good: bool) -> str:
        d = rng.choice("3456") + num(rng.choice((14, 15, 15, 15)) - 1)
        check = next(c for c in "0123456789" if luhn(d + c))
        return d + (check if good else str((int(check) + rng.randint(1, 9)) % 10))

    def grouped(d: str) -> str:
        sep = rng.choice(("", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    a, b, c = num(3), num(3), num(4)
    user = rng.choice((word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}+{word()}"))
    host = rng.choice((f"{word()}.{rng.choice(('com', 'org', 'net', 'de'))}", f"mail.{word()}.com"))
    made = {
        "email": (f"{user}@{host}", f"{user} (at) {host}", f"{user}(at){host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user}@{host}"),
        "ip": (".".join(str(rng.randint(0, 255)) for _ in range(4)),),
        "card": (grouped(card(True)), grouped(card(True))),
        "phone": (f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)} {num(2)} {num(4)} {num(4)}", f"+49{num(10)}", f"({a}) {b} {c}"),
    }
    not_any = (
        f"{rng.randint(1, 9)}.{rng.randint(0, 12)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}", f"version {rng.randint(1, 4)}", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1990, 2030)}",
        f"{rng.randint(1, 12)}:{num(2)}", f"${rng.randint(1, 999)}.{num(2)}", f"{rng.randint(1, 9)},{num(3)},{num(3)}", f"#{num(6)}", num(rng.randint(1, 12)), grouped(card(False)), card(False), f'token = "{hexa(40)}"', f"password={hexa(18)}", "AKIA" + hexa(16).upper(),
        f"978-3-16-{num(6)}-{num(1)}", ".".join(str(rng.randint(300, 999)) for _ in range(4)), f"{num(2)}.{num(2)}.{rng.randint(1990, 2030)}", f"@{word()}", f"{word()}@", f"{num(2)}%", f"{num(4)}-{num(4)}", f"§ {num(2)}.{num(1)}", f"{num(1)} ({num(2)}) {num(2)}", f"{num(4)} {num(4)} {num(4)}", f"{num(3)} {num(3)}",
        f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", f"{num(5)}.{num(5)}", hexa(32), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(12)}",
    )
    lead = {"email": ("mail", "write to", "contact"), "ip": ("from", "address", "host"), "card": ("card", "pay with"), "phone": ("call", "tel", "phone", "tel.:")}
    text, gold = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 5))) + rng.choice((" ", " ", ", ", ": "))
        if rng.random() < 0.5:
            kind = rng.choice(KINDS)
            if rng.random() < 0.3:
                text += rng.choice(lead[kind]) + " "
            e = rng.choice(made[kind])
            gold.append((len(text), kind, len(text) + len(e)))
            text += e
        else:
            text += rng.choice(not_any)
        text += rng.choice((" ", " ", ". ", ", ", ".\n", ") "))
    return text + word() + ".", gold


def fit(sentences: int = 700, rounds: int = 6, seed: int = 9) -> SemiCRF:
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _made(rng)
        at, segs = segments(text)
        token = {a: k for k, a in enumerate(at)}
        want = {(token[a], KINDS.index(y), token[b]) for a, y, b in gold}
        data.append((len(at) - 1, segs, [features(text, at[i], at[j]) for i, j in segs], want & {(i, y, j) for i, j in segs for y in range(len(KINDS))}))
    model = SemiCRF(np.zeros((len(KINDS), _DIM)))
    rate = np.full((len(KINDS), _DIM), 0.1)
    for _ in range(rounds):
        for n, segs, feats, want in data:
            model.likelihood_step(n, segs, feats, want, rate, 0.3, 1e-3)
    model.weight = model.weight.astype(np.float32)
    return model


@cache
def default_model() -> SemiCRF:
    return fit()


_SCAN = re.compile(r"[0-9@]+|[(\[]\s?at\s?[)\]]|\s", re.I)


def _windows(text: str, covered: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """(lo, hi) from eight white-space characters or a line break before a run of marks to as many after the last mark, if a mark is not covered."""
    before: deque[int] = deque([0], 8)  # the line's last white space; its beginning, as long as there are fewer than eight
    lo, since, needed = -1, 0, False
    for m in _SCAN.finditer(text):
        a = m.start()
        if not text[a].isspace():
            if lo < 0:
                lo = before[0]
            since, needed = 0, needed or not covered(a, m.end())
            continue
        since += 1
        if lo >= 0 and (since == 8 or m[0] == "\n"):
            if needed:
                yield lo, a
            lo, needed = -1, False
        if m[0] == "\n":
            before.clear()
        before.append(a)
    if lo >= 0 and needed:
        yield lo, len(text)


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiCRF) -> list[tuple[int, int, int]]:
    """Entities of the model that touch no base span; ``base`` ascends.  A window whose marks all lie in base spans has none, since every candidate holds a mark."""
    begins, far = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    reached = lambda p: far[p - 1] if p else 0
    out: list[tuple[int, int, int]] = []
    for lo, hi in _windows(text, lambda a, b: reached(bisect_right(begins, a)) >= b):
        out += [(a, y, b) for a, y, b in model.decode_text(text, lo, hi) if reached(bisect_left(begins, b)) <= a]
    return out


def find(text: str | None, model: SemiCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans (start, kind's number, end), ascending."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, model))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[y]}:{a}:{b}" for a, y, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones merged) replaced by its first kind in brackets."""
    out, at = [], 0
    for a, y, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[y].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, model: SemiCRF | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base counts by kind, base_sha256, spans."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.record_batches(batches):
            counts, sha, spans = [], [], []
            for t in b.column("text"):
                base, full = find(t.as_py(), model)
                counts.append([sum(y == k for _, y, _ in base) for k in range(4)])
                sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(full))
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(sha), pa.array(spans)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return common.two_columns(docs, key, text).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame, model: SemiCRF | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` replaced by the kind's name; other columns as they are."""
    model = model or default_model()

    common.bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def hide(col: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t, find(t, model)[1]) for t in col], dtype=object)

    return docs.withColumn(text, hide(F.col(f"`{text}`")))
