"""Corpus operators against brute force, on small awkward tables."""

import base64
import hashlib
import itertools
import random
import re
import resource
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oscilla.llm import byte_bpe, components, decontaminate, html_text, language, near_dedup, outliers, pii, quality, shingles, token_counts, token_files
from oscilla.llm.vocab import UnitEncoder, default_path, safe_pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [say(rng, rng.randint(1, 120)) for _ in range(40)]
    out = [None, "", "  \n\t ", "one two", "One  TWO", "é " * 30, "　x y\x1c z", "word\n" * 60, say(rng, 9000)]
    for t in base:
        out.append(t)
        for _ in range(rng.randint(0, 3)):  # near copies of growing distance, and exact ones
            w = t.split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = say(rng, 1)
            out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 2}", 0, "clash") for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s0", 1, "again"), (None, "no id here", "en", "s0", 1, "null")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_shingles int, comp string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def shingle_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def groups_of(sets):
    """Least member of each set's component, by all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_match_all_pairs(docs, nothing, texts):
    sets = shingle_sets(texts)
    least = groups_of(sets)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), least[r.doc_id], least[r.doc_id] == r.doc_id), r
    assert near_dedup.near_duplicates(nothing).count() == 0
    w = say(random.Random(1), 60)
    odd = docs.sparkSession.createDataFrame([(None, w), (None, w + " end"), (8, "start " + w), (9, w), (9, "quite another text of more than five words")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()), key=str)
    assert got == [(8, 8, True), (9, 8, False), (9, 9, True), (None, 8, True), (None, 8, True)]


@pytest.mark.parametrize("size", [(4, 3, 1 << 24), (4, 3, 6000), (768, 8, 1 << 24)])
def test_near_duplicates_by_blocks(spark, monkeypatch, size):
    """Families around the threshold share buckets without being one component; many copies; one very long text."""
    for name, value in zip(("BLOCK", "BLOCKS", "BLOCK_BYTES"), size, strict=True):
        monkeypatch.setattr(near_dedup, name, value)
    rng, some = random.Random(21), []
    for _ in range(3):
        base = say(rng, 90).split(" ")
        for _ in range(36):
            at, n = rng.randrange(60), rng.choice((2, 4, 6, 8, 12, 16))
            some.append(" ".join(base[:at] + say(rng, n).split(" ") + base[at + n :]))
    some += [some[5]] * 60 + [say(rng, 30_000)]
    sets = shingle_sets(some)
    least = groups_of(sets)
    d = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()}
    assert got == {i: (len(sets[i]), least[i], least[i] == i) for i in range(len(some))}
    assert 4 < len(set(least)) < 100


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (None, 1), (9, 9)] + [(k, k + 1) for k in range(20, 60)], "a long, b long")
    got = {r.node: r.comp for r in components.connected_components(e).collect()}
    assert got[3] == 1 and got[6] == 5 and got[60] == 20 and got[9] == 9 and len(got) == 47


def test_components_of_long_chains(spark):
    n = 4000
    name = [hashlib.sha256(str(k).encode()).digest()[:16] for k in range(n)]
    links = [(name[k], name[k + 1]) for k in range(n - 1)]
    links += [(b"b" + name[k], b"b" + name[k + d]) for k in range(n // 2) for d in (1, 2)]  # two neighbours on each side
    got = {bytes(r.node): bytes(r.comp) for r in components.connected_components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    wide = [b"b" + x for x in name[: n // 2 + 2]]
    assert len(got) == n + len(wide)
    assert {got[x] for x in name} == {min(name)} and {got[x] for x in wide} == {min(wide)}


def test_sketch_is_unbiased():
    rng = np.random.default_rng(1)
    for n in (2, 40, 2000):
        got, want = [], []
        for _ in range(40):
            u = rng.integers(1, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(u[: n + n // 2]), np.unique(u[n // 2 :])
            got.append((shingles.sketch(a, 200) == shingles.sketch(b, 200)).mean())
            want.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(got) - np.mean(want)) < 0.02


def test_word_hashes_by_blocks(monkeypatch):
    data = say(random.Random(2), 5000).encode() + b"x" * 5000
    whole = shingles.word_hashes(data)
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert (shingles.word_hashes(data) == whole).all() and len(whole) == 5000


def test_statistics_match_plain_counts(docs, texts):
    for r in outliers.statistics(docs).where("doc_id IS NOT NULL").collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {p for k, x in enumerate(tri) if tri.count(x) > 1 for p in (k, k + 1, k + 2)} if len(tri) < 500 else None
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert again is None or r.n_repeat_words == len(again)


def test_outliers_reject_symbols_only(spark, docs, nothing):
    rng = random.Random(8)
    rows = [(i, say(rng, rng.randint(60, 400)), "en", f"s{i % 2}") for i in range(200)]
    rows += [(1000 + i, " ".join(x + "###" for x in say(rng, 90).split()), "en", "s0") for i in range(8)]
    got = {r.doc_id: r.kept for r in outliers.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(8))
    assert outliers.robust_outliers(docs).count() == docs.count()
    assert outliers.robust_outliers(nothing).count() == 0


def test_covariance_inverse(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4, 4))
    cov = a @ a.T + np.eye(4)
    row = {"g": "x", **{f"m{i}": 0.0 for i in range(4)}, **{f"c{i}{j}": float(cov[i, j]) for i in range(4) for j in range(i, 4)}}
    got = outliers._inverse(spark.createDataFrame([row])).first()
    want = np.linalg.inv(cov)
    assert all(abs(got[f"p{i}{j}"] - want[i, j]) < 1e-9 for i in range(4) for j in range(i, 4))


def exhaustive_mcd(x, errors):
    """Mean and inverse covariance by the least regularised determinant of all subsets of three quarters, then reweighted."""
    floor = np.diag(errors)
    cov = lambda y, factor: np.cov(y.T, bias=True) * factor + floor
    h = int(np.ceil(len(x) * outliers.SHARE))
    best = min((list(c) for c in itertools.combinations(range(len(x)), h)), key=lambda c: np.linalg.det(cov(x[c], outliers.CONSISTENT)))
    m, p = x[best].mean(axis=0), np.linalg.inv(cov(x[best], outliers.CONSISTENT))
    near = np.einsum("ni,ij,nj->n", x - m, p, x - m) <= outliers.WEIGHED
    return x[near].mean(axis=0), np.linalg.inv(cov(x[near], outliers.WEIGHED_CONSISTENT))


def test_estimates_against_all_subsets(spark):
    rng, groups = np.random.default_rng(5), {}
    for k in range(24):
        a = rng.normal(size=(4, 4)) * rng.choice([0.1, 1.0, 3.0])
        x = rng.normal(size=(rng.integers(9, 14), 4)) @ a
        x[: rng.integers(0, 3)] += rng.normal(size=4) * 40
        groups[f"g{k}"] = x
    errors = {g: rng.choice([1e-4, 1e-2, 0.05], size=(len(x), 4)) for g, x in groups.items()}
    rows = [(g, *map(float, v), *map(float, e)) for g, x in groups.items() for v, e in zip(x, errors[g], strict=True)]
    got = {r.g: r for r in outliers.estimates(spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, x4 double, v1 double, v2 double, v3 double, v4 double")).collect()}
    same = 0
    for g, x in groups.items():
        m, p = exhaustive_mcd(x, errors[g].mean(axis=0))
        r = got[g]
        mine, inv = np.array([r[f"m{i}"] for i in range(4)]), np.array([[r[f"p{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
        kept = lambda c, q: np.einsum("ni,ij,nj->n", x - c, q, x - c) <= outliers.CUTOFF  # noqa: B023, E731
        same += bool((kept(mine, inv) == kept(m, p)).all())
    assert same >= 22  # concentration from three starts may end in another local least of a dozen points


def test_the_estimate_decides(spark):
    """A group's own spread decides: the same deviation is ordinary in one and far out in another; sampling errors alone would reject other rows."""
    rng = np.random.default_rng(12)
    rows = []
    for g, scale in (("narrow", 0.02), ("wide", 0.4)):
        for k in range(200):
            rows.append((g, k, *map(float, rng.normal(size=4) * [scale, 0.05, 0.05, 0.05])))
        rows.append((g, 999, 0.5, 0.0, 0.0, 0.0))
    fit = spark.createDataFrame([(*r, 1e-4, 1e-4, 1e-4, 1e-4) for r in rows], "g string, k int, x1 double, x2 double, x3 double, x4 double, v1 double, v2 double, v3 double, v4 double")
    est = outliers.estimates(fit)
    kept = {(r.g, r.k): r.d <= outliers.CUTOFF for r in fit.join(est, "g").withColumn("d", outliers._distance()).select("g", "k", "d").collect()}
    assert kept["wide", 999] and not kept["narrow", 999]
    assert sum(kept.values()) >= 398
    by_errors = {(r[0], r[1]): sum(x * x for x in r[2:]) / 1e-4 <= outliers.CUTOFF for r in rows}
    assert sum(by_errors[k] != kept[k] for k in kept) > 300


def test_texts_are_judged_by_their_group(spark):
    """Long words reject a text where words are alike in length, and not where they vary."""
    rng = random.Random(15)
    word = lambda a, b: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(a, b)))
    text = lambda a, b: " ".join(word(a, b) for _ in range(300))
    rows = [(k, text(4, 6), "en", "even") for k in range(60)]
    for k in range(60):
        lo = rng.randint(2, 8)
        rows.append((100 + k, text(lo, lo + 2), "en", "mixed"))
    rows += [(900, text(7, 9), "en", "even"), (901, text(7, 9), "en", "mixed")]
    got = {r.doc_id: r.kept for r in outliers.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900] and got[901] and sum(got.values()) >= 119


def test_outliers_of_small_and_tied_groups(spark):
    rng = random.Random(9)
    long = lambda: say(rng, rng.randint(60, 90))
    rows = [(i, long(), "en", "big") for i in range(50)] + [(100 + i, long(), "en", "less") for i in range(49)] + [(200, long(), "fr", "one")]
    rows += [(300 + i, rows[0][1], "de", "tied") for i in range(60)] + [(7, rows[7][1], "en", "big"), (7, rows[7][1] + " ###" * 80, "en", "big"), (None, long(), None, None)]
    d = spark.createDataFrame([(*r, 1, "g", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_words int, g string, x1 double")
    got = outliers.robust_outliers(d).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 7 for r in got) == 3
    bad = [r for r in got if not r.kept]
    assert [(r.doc_id, r.n_symbols) for r in bad] == [(7, 240)]
    assert all(r.distance2 < 1e-9 for r in got if r.doc_id and r.doc_id >= 300)  # all rows alike: no distance, none rejected
    assert [(r.kept, r.distance2) for r in outliers.robust_outliers(d.where("doc_id = 200")).collect()] == [(True, 0.0)]
    alone = outliers.robust_outliers(d.where("source = 'less'"), least=49).orderBy("doc_id").select("distance2").collect()
    assert alone == outliers.robust_outliers(d.where("source = 'less'")).orderBy("doc_id").select("distance2").collect()  # pooled alone, it is the same group


def test_html():
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><nav><a href="/">menu words here</a></nav>'
        '<div class="cookie-notice">We use cookies</div><main><header><h1>A &amp; b</h1></header><p>One two<br>three<p>four   five\n six<div class="ad">Buy this now</div>'
        '<p>end.</main><section id="comments"><article class="comment"><p>I like this page very much indeed.</p></article></section><footer>(c) all rights</footer>'
    )
    assert html_text.main_text(page) == "A & b\n\nOne two three\n\nfour five six\n\nend."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("only text") == "only text"
    right = 0
    pages = list(html_text.labelled_pages(40, seed=77))
    for pieces in pages:
        want = [x for p, main in pieces if main for x in html_text.main_text(p).split("\n\n")]
        right += html_text.main_text("".join(p for p, _ in pieces)).split("\n\n") == want
    assert right >= 38


def test_html_parts_inside_the_main_text():
    links = lambda n: "".join(f'<li><a href="/{k}">word{k}</a></li>' for k in range(n))
    body = "<p>" + "some text of the article itself " * 20 + "</p>"
    want = ("some text of the article itself " * 20).strip()
    for part in ('<nav class="toc"><ul>{}</ul></nav>', '<div class="share"><ul>{}</ul></div>', "<aside><ul>{}</ul></aside>", '<div class="related"><p>' + "more of it " * 900 + "</p><ul>{}</ul></div>"):
        for n in (7, 40):
            page = f"<body><article><h1>One headline of six words here</h1>{part.format(links(n))}{body}{part.format(links(n))}<p>The end.</p></article></body>"
            assert html_text.main_text(page) == f"One headline of six words here\n\n{want}\n\nThe end."


def test_html_names_of_wrappers():
    menu, foot = '<nav><a href="/">menu words</a></nav>', "<footer>all rights</footer>"
    text = "<h1>A headline</h1><p>" + "text of the page " * 12 + "</p>"
    want = "A headline\n\n" + ("text of the page " * 12).strip()
    card = '<div class="related"><article><h3>Another page</h3><p>its teaser text</p></article></div>'
    for name in ("has-sidebar", "content has-sidebar", "with-sidebar", "no-sidebar", "page has-header", "hasSidebar", "search-results", "sidebar-layout", "promo-page", "hidden"):
        for tag in ("div", "section"):
            for inner in (f"<article>{text}</article>{card}", f"<main>{text}</main>{card}", text)[: 2 if name == "hidden" else 3]:
                assert html_text.main_text(f'<body>{menu}<{tag} id=page class="{name}">{inner}</{tag}>{foot}') == want, (name, tag, inner)
    body = text.partition("</h1>")[2]
    for name in ("post-header", "entry-header", "articleHeader"):
        for rest in (f"<article>{body}</article>", f'<div class="post-content">{body}</div>'):
            for tag in ("div", "header"):
                assert html_text.main_text(f'<body>{menu}<{tag} class="{name}"><h1>A headline</h1></{tag}>{rest}{foot}') == want, (name, rest)
    assert html_text.main_text('<body>' + '<div class="widget"><article><p>one of several</p></article></div>' * 3) == "\n\n".join(["one of several"] * 3)
    # parts that are excluded by name stay so
    for part in (card, '<div class="sidebar"><p>words beside the text</p></div>', '<section id="comments"><article><p>' + "I like it " * 90 + "</p></article></section>"):
        assert html_text.main_text(f"<body>{menu}<article>{text}</article>{part}{foot}") == want
    assert html_text.main_text(f"<body>{menu}<div id=content>{text}</div>" + '<div class="sidebar"><p>words beside the text</p></div>' + foot) == want


def test_html_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>a b</p></article>"), (3, "u", "<article><p>a b</p></article>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0), (2, "", 0), (3, "a b", 3), (3, "a b", 3)]


def test_tokens_against_the_library(spark, docs, nothing, texts, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_path())
    ids = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for r in token_counts.token_counts(docs).where("doc_id IS NOT NULL").collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 512)
    path = token_files.write_token_files(docs, str(tmp_path / "ids"))
    back = token_files.read_token_files(spark, path)
    rows = sorted(back.collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.tokens)
        assert r.doc_id is None or r.tokens == [*ids[r.doc_id], 0]
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    for r in token_files.checksums(back).where("doc_id IS NOT NULL").collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*ids[r.doc_id], 0], "<u4").tobytes())
    window = token_files.read_window(spark, path, 10, 20).collect()
    assert {r.start for r in window} == {r.start for r in rows if r.start < 20 and r.start + r.n_tokens > 10}
    assert token_files.read_token_files(spark, token_files.write_token_files(nothing, str(tmp_path / "none"))).count() == 0


def scanned(df):
    """Rows that the scans of a plan handed on when it was collected."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan).collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_selective_reads_of_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "WRITER", token_files.WRITER | {"parquet.block.size": "20000", "parquet.page.size": "2000", "parquet.page.row.count.limit": "40", "parquet.block.size.row.check.min": "10", "parquet.block.size.row.check.max": "10"})
    rng = random.Random(31)
    rows = [(i // 2 if i < 100 else i, say(rng, rng.randint(1, 40)), 9, "x") for i in range(4000)] + [(None, "a b", 1, "x"), (50, None, 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, tokens string").repartition(4)
    path = token_files.write_token_files(d, str(tmp_path / "ids"))
    every = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    total = every[-1].start + every[-1].n_tokens
    assert len(every) == 4002 and [x.doc_id for x in every] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    for first, last in ((0, 1), (0, 10), (total // 2, total // 2 + 10), (total - 1, total), (total // 3, 2 * total // 3), (-5, total + 5), (7, 7), (total, total + 9)):
        got = token_files.read_window(spark, path, first, last)
        rows_got = sorted((r.start, r.doc_id, tuple(r.tokens)) for r in got.collect() if r.doc_id is not None)
        assert rows_got == sorted((r.start, r.doc_id, tuple(r.tokens)) for r in every if r.doc_id is not None and r.start < last and r.start + r.n_tokens > first)
        if last - first <= 10:
            assert scanned(got) <= 400, "only pages around the window are read"
    got = token_files.read_documents(spark, path, [3, 50, 2500, 99_999])
    assert sorted((r.start, r.doc_id) for r in got.collect()) == [(r.start, r.doc_id) for r in every if r.doc_id in (3, 50, 2500)]
    assert scanned(got) <= 800
    assert "part" in (pushed := got._jdf.queryExecution().toString()) and "PushedFilters: [" in pushed
    files = sorted((tmp_path / "ids" / "data").glob("*.parquet"))
    seen = set()
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                name = col.path_in_schema.split(".")[0]
                seen.add(name)
                assert col.has_offset_index and col.has_column_index
                want = {"tokens": "RLE_DICTIONARY", "part": "RLE_DICTIONARY"}.get(name, "DELTA_BINARY_PACKED")
                assert want in col.encodings, (name, col.encodings)
    assert seen == {"part", "local_start", "doc_id", "n_tokens", "tokens"} and sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 4


def test_units_of_odd_white_space():
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'r", "'", "e", "é", "1", "<|endoftext|>", "　", "\x1c", "\x85", "!", "re", "​"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    enc = UnitEncoder(default_path())
    for most in (4, 300):
        ids, n = enc.encode(some, most=most)
        stop = np.cumsum(n)
        for t, i, j in zip(some, stop - n, stop, strict=True):
            assert enc.lib.encode(t, add_special_tokens=False).ids == ids[i:j].tolist(), t
            assert "".join(safe_pieces(t, 3)) == t
        assert (enc.encode(some, counts=True, most=most)[1] == n).all()


def test_tree_equals_whole_encoding():
    rng = random.Random(5)
    small = byte_bpe.TreeEncoder(default_path("byte_bpe_50k.tiktoken"), leaf=4, piece=3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'r", "'", "e", "é", "1", "　", "\x1c", "!", "re", "th", "the", "ll"]
    for k in range(4000):
        t = "".join(rng.choices(parts if k % 4 else ["aeth", "in", "ghs"], k=rng.randint(0, 40)))
        ids = small.encode(t)
        assert ids == small.bpe.encode_ordinary(t), t
        assert small.decode(ids) == t.encode()


def test_tree_of_unbroken_texts():
    enc = byte_bpe.tree_encoder(default_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(6)
    n = 3_000_000
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    mixed = "".join(rng.choices("ab1!é", k=n // 10))
    for t in ("x" * n, letters, "é" * (n // 3) + " " + "あ" * (n // 3) + "ab" * 9, "abcde" * (n // 10), mixed, " " * (n // 10) + "a", ("y" * 5000 + " ") * 60, "word " * 9000 + "z" * 90_000 + " word" * 9000):
        began = time.perf_counter()
        ids = enc.encode(t)
        spent = time.perf_counter() - began
        assert ids == enc.bpe.encode_ordinary(t) and enc.decode(ids) == t.encode()
        assert spent < 30


def test_round_trip(docs, nothing, texts):
    enc = byte_bpe.tree_encoder(default_path("byte_bpe_50k.tiktoken"))
    for r in byte_bpe.round_trip(docs, with_tokens=True).where("doc_id IS NOT NULL").collect():
        t = texts[r.doc_id] or ""
        assert r.tokens == enc.bpe.encode_ordinary(t) and r.n_tokens == len(r.tokens)
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    again = byte_bpe.decode_tokens(byte_bpe.encode_texts(docs)).where("doc_id IS NOT NULL").collect()
    assert all(r.data == (texts[r.doc_id] or "").encode() for r in again)
    assert byte_bpe.round_trip(nothing).count() == 0


def test_containment_matches_all_pairs(spark, docs, nothing, texts, monkeypatch):
    rng = random.Random(6)
    items = [(0, None), (1, ""), (2, "one two"), (3, "zzz")] + [(10 + k, " ".join(t.split()[3:40])) for k, t in enumerate(texts) if t and len(t.split()) > 60][:25] + [(100, say(rng, 30)), (100, say(rng, 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOW))
        for i, x in items:
            q = WORD.findall((x or "").translate(LOW))
            k = min(5, len(q))
            if k:
                a, b = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)}, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
                if 100 * len(a & b) >= 75 * len(a):
                    want.add((d, i, len(a), len(a & b)))
    read = lambda: {(r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in decontaminate.contained_items(docs, bench).where("doc_id IS NOT NULL").collect()}
    assert read() == want and want
    monkeypatch.setattr(decontaminate.common, "BROADCAST_BYTES", 20_000)  # several blocks
    assert read() == want
    clean = {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()}
    assert clean == {*range(len(texts)), None} - {d for d, *_ in want}
    assert decontaminate.contained_items(nothing, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.where("false")).count() == 0


PLAIN = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(pii._digits(s)) <= 19 and pii.luhn(pii._digits(s))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(pii._digits(s)) <= 15),
]


def test_base_spans_match_plain_patterns():
    rng = random.Random(7)
    for _ in range(8000):
        t = "".join(rng.choices(["1", "25", "+", "(", ")", "-", " ", ".", "a", "@", "b.c", "4012888888881881", "1.2.3.4", "\n", "_"], k=rng.randint(0, 25)))
        assert pii.base_spans(t) == sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PLAIN) for m in p.finditer(t) if ok(m[0]))


def test_segments_are_decoded_jointly():
    rng, model = random.Random(1), pii.SemiCRF(np.zeros((4, 8)))
    for _ in range(60):
        n = rng.randint(1, 6)
        segs = sorted({(i, rng.randint(i + 1, n)) for i in range(n) for _ in range(2) if i < n})
        score = np.array([[rng.uniform(-1, 1) for _ in range(4)] for _ in segs]).reshape(len(segs), 4)

        def best(at):
            if at >= n:
                return 0.0
            return max([best(at + 1), *(score[k].max() + best(j) for k, (i, j) in enumerate(segs) if i == at)])

        got = sum(score[segs.index((i, j)), y] for i, y, j in model.decode(n, segs, score))
        assert abs(got - best(0)) < 1e-9


def decoded(text, model):
    """The model's entities of a whole text, by features of each candidate in turn."""
    at, segs = pii.segments(text)
    score = model.scores([pii.features(text, at[i], at[j]) for i, j in segs])
    return [(at[i], y, at[j]) for i, y, j in model.decode(len(at) - 1, segs, score)]


def test_personal_data_by_windows():
    """Windows and remembered sums give what plain decoding of the whole text gives."""
    rng, model = random.Random(40), pii.default_model()
    parts = ["12", "3456", " ", " ", "-", ".", "(", ")", "+", "a", "word ", "@", " (at) ", "x.org", "\n", "555-1234", "v1.2", "é", "10.0.0.1", "4012 8888 8888 1881", ",", "\t", "[at]", " two three four five six seven eight nine ten eleven "]
    for k in range(1500):
        t = "".join(rng.choices(parts, k=rng.randint(0, 40))) if k % 3 else "".join(pii._made(rng)[0] + " " for _ in range(3))
        whole = decoded(t, model)
        assert model.decode_text(t, 0, len(t)) == whole, t
        base = pii.base_spans(t)
        assert pii.added_spans(t, [], model) == whole, t
        assert pii.added_spans(t, base, model) == [(a, y, b) for a, y, b in whole if not any(s < b and a < e for s, _, e in base)], t


def test_segments_scored_by_arrays(monkeypatch):
    """Numeric segments of blocks of starts, of any block's size, give the spans of the plain loop."""
    model, rng = pii.default_model(), random.Random(43)
    number = lambda: str(rng.randint(1, 10 ** rng.randint(1, 9)))
    signs = [*"+.-() \n@,:", "  ", "word", "a1", "\u0663", "4111 1111 1111 1111", "1.2.3.4", "300.2.3.4", "\u00e9"]
    for _ in range(300):
        text = "".join((number() if rng.random() < 0.4 else rng.choice(signs)) + rng.choice(["", " ", ".", " "]) for _ in range(rng.randint(1, 160)))
        lo = rng.randint(0, len(text) // 3)
        hi = rng.randint(lo, len(text))
        monkeypatch.setattr(pii, "DENSE", 1 << 40)
        plain = model.decode_text(text, lo, hi)
        monkeypatch.setattr(pii, "DENSE", 1)
        monkeypatch.setattr(pii, "DENSE_BLOCK", rng.choice([1, 3, 20, 1000]))
        assert model.decode_text(text, lo, hi) == plain


def test_personal_data_in_very_long_lines():
    model = pii.default_model()
    rng = random.Random(41)
    line = " ".join(str(rng.randint(1, 10**rng.randint(1, 6))) for _ in range(1_150_000))[:5_000_000]
    for t in (line, "1.2.3.4 " * 200_000, "1" * 5_000_000, "a@b " * 20_000, "x" * 5_000_000 + " 1", ("word " * 7 + "12 ") * 20_000):
        began = time.perf_counter()
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        base, every = pii.find(t, model)
        spent, more = time.perf_counter() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
        assert set(base) <= set(every)
        assert spent < 60 and more < 500_000, (t[:20], spent, more)


def test_personal_data_beyond_the_base():
    rng = random.Random(321)
    model = pii.default_model()
    tp = fp = fn = 0
    for _ in range(200):
        t, gold = pii._made(rng)
        got = {(a, pii.KINDS[y], b) for a, y, b in decoded(t, model)}
        tp, fp, fn = tp + len(got & set(gold)), fp + len(got - set(gold)), fn + len(set(gold) - got)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95
    t = "call (555) 123-4567 or bob (at) example.com, version 2.0"
    assert pii.mask(t, pii.find(t, model)[1]) == "call [PHONE] or [EMAIL], version 2.0"


def test_personal_data_table(docs, nothing, texts):
    got = pii.detect(docs).collect()
    assert len(got) == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in got if r.doc_id in (0, 1, 2))
    assert pii.detect(nothing).count() == 0
    kept = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert kept[0] is None and kept[3] == "one two"


def test_quality_on_held_out_rows(spark, nothing):
    rng = random.Random(12)
    rows, labels = [(10_000, None), (10_001, "")], []
    for i in range(400):
        good = rng.random() < 0.7
        t = say(rng, rng.randint(5, 60))
        rows.append((i, t if good else " ".join(x + rng.choice(("###", "$$$")) for x in t.split())))
        labels.append((i, int(good)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    truth = dict(labels)
    got = quality.scores(d, quality.fit(d, lab)).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.score == 1 or r.score > 0.99 for r in quality.scores(d, quality.fit(d, lab.where("false"))).collect())
    assert quality.scores(nothing, quality.fit(nothing, lab)).count() == 0


def test_language_on_held_out_rows(spark, docs, nothing):
    rng = random.Random(13)
    made = {k: ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 9))) for _ in range(60)] for k in ("aa", "bb", "cc")}
    rows = [(10_000, None, "aa"), (10_001, "123 !", "bb"), (10_002, "", None)]
    for i in range(240):
        lang = rng.choice(sorted(made))
        rows.append((i, " ".join(rng.choices(made[lang], k=rng.randint(20, 60))), lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {i: x for i, _, x in rows}
    got = language.predict(d, language.fit(d)).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id >= 10_000)
    held = [r for r in got if r.held_out and r.doc_id < 10_000]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert language.predict(nothing, language.fit(nothing)).count() == 0
    assert {r.lang_pred for r in language.predict(d, []).collect()} == {"und"}


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(15)
    good = [say(rng, rng.randint(30, 80)) for _ in range(120)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(200 + i, " ".join(x + "###" for x in say(rng, 40).split()), "en", "s", 1) for i in range(60)]
    rows += [(300, good[3] + " tail", "en", "s", 1), (301, good[4], None, None, None), (302, say(rng, 30) + " mail a.b@c.example now", "en", "s", 1), (None, say(rng, 40), "en", "s", 1)]
    item = say(rng, 25)
    rows += [(303, f"{say(rng, 20)} {item} {say(rng, 20)}", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(120), 302, None}
    want = next(t for i, t, *_ in rows if i == 302).replace("a.b@c.example", "[EMAIL]")
    assert got[302].decoded_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[7].decoded_sha256 == hashlib.sha256(good[7].encode()).hexdigest()


def test_dedup_stage_keeps_one_row_of_a_group(spark):
    import corpus_pipeline as cp

    rng = random.Random(16)
    a, b, c, d = (say(rng, 60) for _ in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (None, d), (None, d + " end"), (None, a), (7, None), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = cp.dedup(spark, docs, "")
    assert got.columns == cp.COLUMNS
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    last = next(x for x in kept if x[0] is None and x[1])
    assert last[1] in (d, d + " end")
    assert kept == sorted([(1, a), (2, b), (3, c), last, (7, None), (7, None), (None, "")], key=str)


def test_ranks_file_is_read_whole():
    with open(default_path("byte_bpe_50k.tiktoken"), "rb") as f:
        n = sum(bool(base64.b64decode(x.split()[0])) for x in f)
    assert byte_bpe.tree_encoder(default_path("byte_bpe_50k.tiktoken")).bpe.n_vocab == n


def test_queries_keep_contract_columns(spark):
    from oscilla.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    want = {
        "op1_robust_outliers": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op2_html_text": "page_id url text n_chars",
        "op3_minhash_near_dedup": "doc_id n_shingles component_id kept",
        "op4_token_files": "doc_id start n_tokens ids_crc32",
        "op5_decontamination": "doc_id item_id",
        "op6_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op7_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8_quality_classifier": "doc_id held_out score predicted",
        "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op10_language_id": "doc_id held_out lang_pred score",
    }
    assert set(want) == set(QUERIES)
    for name, columns in want.items():
        out = QUERIES[name](spark, d)
        assert set(columns.split()) <= set(out.columns)
        assert out.select(F.count("*")).first()[0] > 0 or name == "op5_decontamination"
