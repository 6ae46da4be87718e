"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tokens, tags and runs of words.  Each word scores positive and each
tag negative, by weights learned from labelled pages; what stands in a menu, header, footer,
sidebar, notice, advert, form or among reader comments (by its element or the words of its class,
id or role) scores nothing, tags and words alike, so it cannot break a region that it stands in.
What a class, id or role only says for itself (has-sidebar, no-header, post-header) makes no part
excluded, nor does any name where the element holds the page's main element, its only articles or
most of its words outside links.  Inside an article, and for paragraphs, headings and the like
anywhere, a name excludes only if all its words name furniture or say nothing (share-buttons, but
not share-price or newsletter-story).
Words are judged by the block that they stand in: whether it lies in the page's article, what holds it (a paragraph, a
heading, a list item or cell, a mere box) and how long it is, whether it ends as a sentence, whether
half of it is links, and for a heading whether links follow.  Each such fact has a weight, and their sum is the weight of each word of the
block: a menu, a footer or a list of links loses by every word, whatever its element is called, and
tags cost what they were learned to cost.  One linear scan finds the contiguous region with the
greatest total; short or linked blocks inside it belong to it, those around it do not.  The
region's blocks, without excluded parts, are the page's text: character references are decoded,
white space inside a block is one space, blocks are joined by two line feeds.

The weights of blocks are a logistic fit, those of tags smoothed log odds, both from labelled pages that
:func:`labelled_pages` makes from layouts, names without meaning and random words by a fixed seed.

Defined results.  Null or empty html and pages without words: empty text.  Truncated pages: what is
there.  Text without any tag: one block.  Unclosed quotes and tags: a tag ends at its first >; a < without a
> after it is text.  If no region scores above nothing, the best block without links.  Repeated rows: each
is answered.  Very long and malformed pages: whole, in linear time.  Empty table: empty result.  Extra columns are
not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.llm import common

_RAW = re.compile(r"<(script|style|noscript|template|iframe|svg|textarea|select|title)\b", re.I)
_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
_STOP = re.compile(r"[>\"']")
_BLOCK = frozenset(
    "html body head article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption "
    "header footer nav aside form fieldset hr address details summary menu center".split()
)
_KEPT_OPEN = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "hr", "thead", "tbody", "tfoot", "caption", "summary", "figcaption"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BY_TAG = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "label": "form", "head": "hidden", "dialog": "notice"}
_BY_WORD = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip",
    "header": "header masthead topbar sitehead",
    "footer": "footer colophon copyright",
    "sidebar": "sidebar aside widget related recommended recommendations share sharing social newsletter subscribe signup trending popular complementary",
    "notice": "cookie cookies consent notice gdpr popup modal overlay banner disclaimer alert paywall",
    "advert": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted dfp",
    "form": "form search login signin",
    "comment": "comment comments commentlist disqus respond reply replies discussion responses",
    "hidden": "hidden offscreen",
}
_ROLE = {w: role for role, words in _BY_WORD.items() for w in words.split()}
_NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MAIN = ("article", "main")
#: Roles of parts that may well hold articles, or more words than the text itself.
_LISTED = frozenset("comment sidebar advert notice hidden".split())
#: Before a word that names a part: the element has, or lacks, such a part elsewhere.
_MODIFIER = frozenset("has with no without".split())
#: Before "header": the heading of a text, not of the site.
_OF_TEXT = frozenset("post entry article story page content blog news recipe product title".split())
#: Words beside a furniture word that leave its meaning as it is.
_NEUTRAL = frozenset(
    "list lists item items box wrap wrapper block container inner outer slot unit bar row col column panel area module group link links button buttons icon icons "
    "top bottom left right center inline fixed sticky floating small large wide narrow mobile desktop post posts article articles stories entry entries thread threads "
    "count tools toolbar label title heading form field us me now here main primary secondary global site page".split()
)
#: Elements of running text.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption caption q em strong".split())
#: What holds a block of words: the last block element that was opened, if it is none of these a box.
_HOLDER = dict.fromkeys("p blockquote pre figcaption".split(), "para") | dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "head") | dict.fromkeys("li dt dd td th".split(), "item")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u00bb)\]]*\s*\Z")
#: Contexts that count; all others are the roles of excluded parts.
_SCORED = ("main", "plain")


@lru_cache(10_000)
def _named(tag: str, attrs: str) -> tuple[str | None, bool]:
    """The role that the names of an element suggest ("title" for the heading of an article), and whether other words in the name cast doubt on it."""
    doubtful = None
    for m in _NAMING.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            before, parts = "", [x.lower() for x in _NAME_PART.findall(name)]
            for part in parts:
                if part in _MODIFIER:
                    break  # what follows is said of the element's surroundings
                role = _ROLE.get(part)
                if role == "header" and before in _OF_TEXT and (tag, before) != ("header", "page"):
                    role = "title"
                if role and (tag not in _MAIN or role == "comment"):
                    if role == "title" or all(x in _ROLE or x in _NEUTRAL or len(x) < 3 for x in parts):
                        return role, False
                    doubtful = doubtful or role
                    break
                before = part
    return doubtful, doubtful is not None


def _roles(tag: str, attrs: str) -> tuple[str | None, str | None, bool]:
    """(by the element itself, by its names, whether that is doubtful): the second can be void, the first cannot."""
    if tag in ("html", "body"):
        return None, None, False
    role = _BY_TAG.get(tag)
    if role in (None, "header") and attrs and ("=" in attrs or "hidden" in attrs.lower()):
        if _UNSEEN.search(attrs):
            return "hidden", None, False
        return role, *_named(tag, attrs)
    return role, None, False


class _Part:
    """An element: what it is, and what it holds."""

    __slots__ = ("tag", "up", "hard", "soft", "doubt", "words", "article", "main", "role", "inside", "title")

    def __init__(self, tag: str, up: _Part | None, hard: str | None = None, soft: str | None = None, doubt: bool = False):
        self.tag, self.up, self.hard, self.soft, self.doubt = tag, up, hard, soft, doubt
        self.words, self.article, self.main = 0, False, False
        self.role, self.inside, self.title = None, False, False

    def settle(self, void: bool = False) -> None:
        """Role and place, from those of the element around it."""
        up, own = self.up, None if self.soft == "title" else self.hard if void or not self.soft else self.soft
        if self.doubt and (up.inside or self.tag in _TEXT):
            own = self.hard
        if own == "header" and up.inside:
            own = None  # the heading of the article itself
        self.role = up.role or own
        self.inside = up.inside or (self.tag in _MAIN and not self.role)
        self.title = up.title or self.soft == "title"

    def context(self) -> str:
        return self.role or ("main" if self.inside else "title" if self.title else "plain")


def _settle(parts: list[_Part]) -> None:
    """Roles of all elements, in page order; names that would exclude the main text are void."""
    for p in parts[1:]:
        p.settle()
    if not any(p.soft and p.role for p in parts):
        return
    bare = any(p.words and not p.role for p in parts)
    shut = {p for p in parts if p.hard and not (p.soft == "title" or (p.hard == "header" and p.up.inside))}
    for p in reversed(parts[1:]):  # inner elements first
        if p in shut:
            p.words, p.article, p.main = 0, False, False
            continue
        p.main |= p.tag == "main"
        p.article |= p.tag == "article" and p.soft != "comment"
        p.up.words += p.words
        p.up.article |= p.article and p.soft != "comment"
        p.up.main |= p.main
    total = parts[0].words
    most = lambda p: 2 * p.words > total
    outer = lambda p: p.soft not in (None, "title") and p.role and not p.up.role and p not in shut
    began = free = any(p.inside and p.words for p in parts)
    # with no text elsewhere and no better part, any that holds articles
    rest = not bare and not any(outer(p) and p.article and (most(p) or p.soft not in _LISTED) for p in parts[1:])
    within = set()  # parts whose names are void, and all inside them
    for p in parts[1:]:
        p.settle()
        if outer(p):
            holds = p.article and not (free if p.up in within else began) and (most(p) or p.soft not in _LISTED or rest)
            if p.main or holds or (most(p) and (p.soft == "sidebar" or p.soft not in _LISTED or (p.soft != "hidden" and p.words == total))):
                p.settle(void=True)
                within.add(p)
        if p.up in within:
            within.add(p)
        free = free or bool(p.inside and p.words)


class _Reader:
    """Takes a page apart from left to right in linear time: what is sought and not found once is not sought again."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()  # strings that do not occur any more
        self.dead: set[int] = set()  # quotes from which on no tag ends outside quotes

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """The end of the tag whose attributes begin at ``at``: past the first > outside quotes, or with an unclosed quote past the first > at all."""
        k, quotes = at, []
        while m := _STOP.search(self.page, k):
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead:
                break
            quotes.append(m.start())
            k = self.find(m[0], m.end()) + 1
            if not k:
                break
        self.dead.update(quotes)
        return self.find(">", at) + 1

    def pieces(self) -> Iterator[tuple[str, str, str, int]]:
        """(kind, name or text, attributes, offset); kinds: text, open, close, raw (what is not read), other."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            if page[at] != "<" or self.find(">", at) < 0:  # without a > ahead all is text
                end = page.find("<", at) if ">" not in self.gone else -1
                end = n if end < 0 else end
                yield "text", page[at:end], "", at
                at = end
                continue
            end, kind, name, attrs = 0, "other", "", ""
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4) + 3
                end = end if end > 2 else n
            elif (m := _RAW.match(page, at)) and (shut := self.find(">", m.end())) >= 0:
                kind, name = "raw", m[1].lower()
                close = re.compile(f"</{name}\\s*>", re.I).search(page, shut + 1) if name not in self.gone else None
                if not close:
                    self.gone.add(name)
                end = close.end() if close else n
            elif page[at + 1 : at + 2] in ("!", "?") or (page.startswith("</", at) and not _NAME.match(page, at)):
                end = self.find(">", at + 2) + 1
            elif (m := _NAME.match(page, at)) and self.find(">", m.end()) >= 0:
                end = self.tag_end(m.end())
                kind, name, attrs = "close" if m[1] else "open", m[2].lower(), page[m.end() : end - 1]
            if not end:  # no tag: the sign itself
                kind, name, end = "text", "<", at + 1
            yield kind, name, attrs, at
            at = end


def tokens(page: str) -> list[tuple[str, str, str, int, int, bool]]:
    """(kind, name or text, context, offset, block, linked): kinds are word runs, tags (block or not) and breaks; ``block`` numbers the blocks of words."""
    out: list[tuple[str, str, _Part, int, int, bool]] = []
    parts = [_Part("", None)]
    stack = [parts[0]]  # open elements, below them the page
    opened: Counter = Counter()
    link, block = False, 0
    for what, name, attrs, at in _Reader(page).pieces():
        if what == "text":
            if name.strip() or out:
                out.append(("text", name, stack[-1], at, block, link))
            if not link:
                stack[-1].words += len(name.split())
            continue
        if what == "other":
            continue
        if what == "raw":
            out.append(("tag", name, stack[-1], at, block, link))
            continue
        is_block = name in _BLOCK
        kind = "block" if is_block else "break" if name in ("br", "td", "th") else "tag"
        if is_block or name in ("td", "th"):
            block += 1
        if name == "a":
            link = what == "open"
        if name in _VOID or what == "close":
            out.append((kind, name if name in _VOID else "/" + name, stack[-1], at, block, link))
        if name in _VOID:
            continue
        if what == "close":
            if opened[name]:
                while (top := stack.pop()).tag != name:
                    opened[top.tag] -= 1
                opened[name] -= 1
            continue
        while is_block and stack[-1].tag == "p":
            stack.pop()
            opened["p"] -= 1
        hard, soft, doubt = _roles(name, attrs) if name in _BY_TAG or attrs else (None, None, False)
        if hard or soft or name in _KEPT_OPEN:
            parts.append(_Part(name, stack[-1], hard, soft, doubt))
            stack.append(parts[-1])
            opened[name] += 1
        out.append((kind, name, stack[-1], at, block, link))
    _settle(parts)
    return [(kind, text, part.context(), *rest) for kind, text, part, *rest in out]


def _size(n: int) -> str:
    return "1" if n < 3 else "3" if n < 8 else "8" if n < 20 else "20"


def _classes(page: str) -> Iterator[tuple[tuple[str, str, str, int], tuple[str, ...], int]]:
    """Each token (kind, name or text, context, offset) with its features and how many words it has, or -1 for a tag.

    Words are judged by the block that they stand in: where it is, what holds it, how long it is, whether half of it
    or more is links, whether it ends as a sentence does; a heading also by what follows it.
    """
    toks = tokens(page)
    has_main = any(t[2] == "main" for t in toks if t[0] == "text")
    held: dict[int, str] = {}
    words: Counter = Counter()
    linked: Counter = Counter()
    last: dict[int, str] = {}
    for kind, name, _, _, block, link in toks:
        if kind in ("block", "break"):
            held.setdefault(block, _HOLDER.get(name, "box"))
        elif kind == "text" and (n := len(name.split())):
            words[block] += n
            linked[block] += n * link
            last[block] = name
    order = list(words)
    after = dict(zip(order, order[1:], strict=False))
    is_linked = lambda b: 2 * linked[b] >= words[b] > 0
    features: dict[tuple[int, str], tuple[str, ...]] = {}
    for kind, name, where, at, block, _ in toks:
        if where == "title":
            where = "main" if has_main else "plain"
        ctx = "outside" if has_main and where == "plain" else where
        if kind != "text":
            yield (kind, name, where, at), (f"tag {name} {ctx}",), -1
            continue
        got = features.get((block, ctx))
        if got is None:
            holder, n = held.get(block, "box"), words[block]
            ends = "ended" if block in last and _SENTENCE.search(last[block][-40:]) else "open"
            got = features[block, ctx] = (f"word {ctx}", f"word {holder} {_size(n)}", f"word {holder} {ends}", "word linked" if is_linked(block) else "word free")
            if holder == "head":  # what a heading heads
                got = features[block, ctx] = (*got, "word head of " + ("nothing" if block not in after else "links" if is_linked(after[block]) else "text"))
        yield (kind, name, where, at), got, len(name.split())


def labelled_pages(n: int = 240, seed: int = 5, mixed: bool = False) -> Iterator[list[tuple[str, bool]]]:
    """Pages as pieces of html, each marked as main text or not: framed by article elements and known names, or of plain
    boxes with names that say nothing.  ``mixed``: with pieces in the text that are unlike it by themselves, lists of links, captions, lines in boxes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    say = lambda a, b: some(a, b).capitalize() + "."
    a = lambda x, y: f'<a href="/{word()}">{some(x, y)}</a>'
    named = lambda tag="div": f"<{tag}" + rng.choice(("", f' class="{word()}"', f' id="{word()}-{word()}"', f' class="{word()} {word()}"')) + ">"
    listed = lambda lo=3, hi=9: "<ul>" + "".join(f"<li>{a(1, 3)}</li>" for _ in range(rng.randint(lo, hi))) + "</ul>"

    def menu() -> str:
        k = rng.randint(2, 12)
        return rng.choice((
            lambda: named() + listed() + "</div>", lambda: named() + rng.choice((" ", " | ", "\n")).join(a(1, 2) for _ in range(k)) + "</div>",
            lambda: named("table") + "<tr>" + "".join(f"<td>{a(1, 2)}</td>" for _ in range(k)) + "</tr></table>",
            lambda: named() + "".join(f"<div>{a(1, 2)}</div>" for _ in range(k)) + "</div>", lambda: "<p>" + " ".join(a(1, 2) for _ in range(k)) + "</p>",
        ))()

    def beside() -> str:
        return named() + f"<h3>{some(1, 3)}</h3>" + listed() + "</div>" if rng.random() < 0.6 else named() + f"{some(1, 4)} {a(1, 2)}</div>"

    def foot() -> str:
        return named() + rng.choice((lambda: f"&copy; {rng.randint(1999, 2030)} {some(1, 4)}", lambda: some(2, 6).capitalize(), lambda: f"<p>{some(2, 9).capitalize()}</p>", lambda: " ".join(a(1, 2) for _ in range(rng.randint(2, 6))), lambda: f"{some(1, 3)} &middot; {a(1, 2)} {a(1, 2)}"))() + "</div>"

    def passage() -> str:
        def sentence(lo: int, hi: int) -> str:
            t = say(lo, hi)
            return t if rng.random() < 0.7 else f"{t[:-1]} {rng.choice((a(1, 3), f'<em>{some(1, 2)}</em>', f'<b>{some(1, 2)}</b>'))} {say(1, 8).lower()}"

        form = rng.random()
        if form < 0.62:
            return f"<p>{sentence(3, 90)}</p>"
        if form < 0.68:
            return f"<p>{some(3, 60)}</p>"
        if form < 0.76:
            return f"<h3>{some(1, 6).capitalize()}</h3>"
        if form < 0.86:
            return "<ul>" + "".join(f"<li>{sentence(3, 16)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if form < 0.89:
            return f"<blockquote>{sentence(5, 30)}</blockquote>"
        if form < 0.92:
            return "<table>" + "".join(f"<tr><td>{say(2, 6)}</td><td>{say(2, 9)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if mixed and form < 0.96:
            return rng.choice((lambda: "<p>" + a(2, 5) + "</p>", lambda: listed(2, 4), lambda: f"<div>{some(1, 6).capitalize()}</div>", lambda: f"<div>{some(1, 3)} {a(1, 3)}</div>"))()
        if form < 0.98:
            return f'<figure><img src="{word()}"><figcaption>{say(3, 9)}</figcaption></figure><hr>'
        return f"<div>{sentence(12, 60)}<br><br>{sentence(12, 60)}</div>"

    for _ in range(n):
        framed, plain = rng.random() < 0.4, rng.random() < 0.6
        page = [(f"<html><head><title>{say(2, 6)}</title><style>p{{}}</style></head><body>", False)]
        page.append((menu() if plain else f"<nav>{listed()}</nav>", False))
        if rng.random() < 0.5:
            page.append((named() + a(1, 3) + "</div>" if plain else f'<header class="masthead"><a href="/">{say(1, 3)}</a></header>', False))
        if not plain and rng.random() < 0.5:
            page.append((f'<div class="cookie-notice"><p>{say(6, 20)}</p><button>{word()}</button></div>', False))
        if rng.random() < 0.4:
            page.append((f'<div class="ad">{say(4, 15)}</div>' if not plain else menu(), False))
        if framed and rng.random() < 0.4:
            page.append((f"<p>{say(3, 8)}</p>", False))
        page.append(("<article>" if framed else named() + rng.choice(("", "<div>", "<div><div>")), False))
        page.append((f"<h1>{some(1, 9).capitalize()}</h1>", True))
        page.append((f"<p>{say(4, 40)}</p>", True))
        for _ in range(rng.randint(1, 9)):
            page.append((passage(), True))
            if rng.random() < 0.08:
                page.append((f'<div class="ad">{say(3, 10)}</div>', False))
        page.append((f"<p>{say(4, 40)}</p>", True))
        page.append(("</article>" if framed else "</div>", False))
        if rng.random() < 0.5:
            page.append((beside() if plain else f"<aside><h3>{word()}</h3>{listed()}</aside><form action=\"/s\"><input name=\"q\"><label>{word()}</label></form>", False))
        if not plain and rng.random() < 0.4:
            page.append(('<section id="comments">' + "".join(f'<div class="comment"><p>{say(4, 30)}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>", False))
        page.append(((foot() if plain else f"<footer>{say(4, 14)}</footer>") + "</body></html>", False))
        yield page


def learn(pages: Iterator[list[tuple[str, bool]]], rounds: int = 600) -> dict[str, float]:
    """Weights of features.  Of blocks of words: a logistic fit, so that facts which go together do not count twice.  Of tags:
    smoothed log odds, at most a small cost and at most one."""
    blocks: list[tuple[tuple[str, ...], bool]] = []
    yes: Counter = Counter()
    no: Counter = Counter()
    for pieces in pages:
        ends, at = [], 0
        for piece, main in pieces:
            at += len(piece)
            ends.append((at, main))
        k, seen = 0, None
        for tok, features, n in _classes("".join(p for p, _ in pieces)):
            while tok[3] >= ends[k][0]:
                k += 1
            if tok[2] not in _SCORED or not n:
                continue
            if n < 0:
                (yes if ends[k][1] else no)[features[0]] += 1
            elif features is not seen:  # a block counts once, however it is cut by tags
                seen = features
                blocks.append((features, ends[k][1]))
    names = sorted({x for f, _ in blocks for x in f})
    place = {x: k for k, x in enumerate(names)}
    facts = np.zeros((len(blocks), len(names)))
    for k, (f, _) in enumerate(blocks):
        facts[k, [place[x] for x in f]] = 1
    main, w = np.array([y for _, y in blocks], float), np.zeros(len(names))
    for _ in range(rounds):
        w += 0.5 * (facts.T @ (main - 1 / (1 + np.exp(-(facts @ w)))) / max(len(blocks), 1) - 2e-4 * w) * 4
    out = dict(zip(names, w.tolist(), strict=True))
    all_yes, all_no = yes.total() + 1, no.total() + 1
    for name in sorted({*yes, *no}):
        out[name] = min(-0.01, max(-1.0, math.log((yes[name] + 1) / all_yes) - math.log((no[name] + 1) / all_no)))
    return out


@cache
def weights() -> dict[str, float]:
    return learn(labelled_pages(mixed=True))


def _weight(weight: dict[str, float], features: tuple[str, ...]) -> float:
    """Of a word of a block, or of a tag."""
    if features[0][0] == "t":
        return weight.get(features[0], -0.3)
    return max(-4.0, min(4.0, sum(weight.get(x, 0.0) for x in features)))


def region(scores: list[float]) -> tuple[int, int]:
    """[start, stop) of the contiguous stretch with the greatest total, the first of equals; (0, 0) if nothing is above zero."""
    best = total = 0.0
    first = start = stop = 0
    for k, x in enumerate(scores):
        total += x
        if total <= 0:
            total, first = 0.0, k + 1
        elif total > best:
            best, start, stop = total, first, k + 1
    return start, stop


def main_text(page: str | None, weight: dict[str, float] | None = None) -> str:
    """The text of the best-scoring region, without excluded parts; if no region scores above nothing, of the best block without links."""
    if not page:
        return ""
    weight = weight or weights()
    toks = list(_classes(page))
    known: dict[tuple[str, ...], float] = {}
    scores = []
    for (_, _, where, _), features, n in toks:
        if where not in _SCORED:
            scores.append(0.0)  # what is excluded neither gains nor breaks
            continue
        w = known.get(features)
        if w is None:
            w = known[features] = _weight(weight, features)
        scores.append(w * abs(n))
    start, stop = region(scores)
    if start == stop:
        free = [k for k, (t, features, n) in enumerate(toks) if n > 0 and t[2] in _SCORED and features[3] == "word free"]
        if free:
            at = max(free, key=lambda k: (_weight(weight, toks[k][1]), -k))
            start, stop = at, at + 1
            while start and toks[start - 1][0][0] not in ("block",):
                start -= 1
            while stop < len(toks) and toks[stop][0][0] != "block":
                stop += 1
    blocks: list[str] = []
    run: list[str] = []
    for (kind, text, where, _), _, _ in [*toks[start:stop], (("block", "", "main", 0), ("tag",), -1)]:
        if kind == "text":
            if where in _SCORED:
                run.append(text)
        elif kind == "break":
            run.append(" ")
        elif kind == "block" and run:
            block = " ".join(html.unescape("".join(run)).split())
            if block:
                blocks.append(block)
            run = []
    return "\n\n".join(blocks)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Per row: page_id, url, text (empty if none), n_chars (its code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.record_batches(batches):
            got = [main_text(t.as_py()) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    common.bound_batches(pages.sparkSession)
    base = common.spread(pages).select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{body}`").cast("string").alias("html"))
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
