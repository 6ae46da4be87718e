"""Web archives, phrases and resampling against brute force, foreign files and awkward tables."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains, StringStartsWith
from pyspark.sql.types import _parse_datatype_string

from oscilla.llm import grams, phrases, resample, warc

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALPHABET = "aB c.\t,é\n;日 zZ09-"


def babble(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


# ---- words and runs --------------------------------------------------------------------------


def plain_runs(text, n):
    """Runs of n words within pieces, in order of their start."""
    out = []
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(LOW)):
        w = re.findall("[^ \t]+", piece)
        out += [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    return out


def runs_of(words, n):
    names = words.distinct.to_pylist()
    return [" ".join(names[w] for w in words.word[i : i + n]) for i in words.runs(n)]


def test_words_of_batches():
    rng = random.Random(1)
    texts = [None, "", " ", "a", *(babble(rng, rng.randint(0, 60)) for _ in range(300))]
    got = phrases.SPLITTER.words(pa.array(texts))
    for n in (1, 2, 3):
        assert runs_of(got, n) == [r for t in texts for r in plain_runs(t or "", n)]
    part = pa.array(["x y", *texts, "end"])[1:-1]  # a slice of a larger array
    assert runs_of(phrases.SPLITTER.words(part), 2) == runs_of(got, 2)
    assert len(phrases.SPLITTER.words(pa.array([], pa.string())).word) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_chunks_own_every_run_once(n):
    rng = random.Random(n)
    for _ in range(60):
        text = babble(rng, rng.randint(0, 400)) + rng.choice(["", "x" * 90])
        found = []
        for part, carried in phrases.SPLITTER.chunks(text.encode(), n, size=rng.randint(1, 50)):
            found += runs_of(phrases.SPLITTER.words(pa.array([part.decode()]), np.array([carried])), n)
        assert found == plain_runs(text, n)


# ---- web archives ----------------------------------------------------------------------------


def sha(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def test_pages_come_back(spark, tmp_path):
    same, other = "<p>same é</p>", "<b>" + "x" * 3_000_000
    rows = [(1, "u", same), (5, None, same), (3, "http://a b\r\nX: y", same), (2, "u", None), (7, "u", ""), (None, "u", same), (9, "u", other), (9, "u", other), (4, "v", "only"), (None, None, "alone")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("clash").alias(c) for c in ("payload", "hex", "salt", "best", "warc_type")))
    path = warc.write_pages(d.repartition(3), str(tmp_path / "a"))
    got = warc.page_records(spark, path).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        old = best[h or ""] >= 0 and i != best[h or ""]
        want.append((i, len(body), sha(body), "revisit" if old else "response", best[h or ""] if old else None, None if old else body))
    key = lambda r: str(r)
    assert sorted(map(tuple, (tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got)), key=key) == sorted(want, key=key)
    assert not [p for p in (tmp_path / "a").iterdir() if not p.name.endswith(".warc.gz")]
    uris = {r.record_id: r.target_uri for r in warc.read(spark, path).collect()}
    assert uris[warc.PAGE + "3"] == "http://a%20b%0D%0AX:%20y" and uris[warc.PAGE + "5"] is None
    short = warc.write_pages(d, str(tmp_path / "b"), least_bytes=14)  # shorter payloads are all responses
    assert Counter(r.record_type for r in warc.page_records(spark, short).collect()) == Counter(response=7, revisit=3)
    empty = warc.write_pages(d.where("false"), str(tmp_path / "c"))
    assert warc.page_records(spark, empty).count() == 0


def foreign():
    """Records as crawlers write them: information, a request, a response, a folded header, a body that looks like a record."""
    trap = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + trap
    return [
        warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Type", "application/warc-fields")], [b"software: x\r\n"]),
        warc.record([("warc-type", "request"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Target-URI", "http://a/\r\n b"), ("Content-Type", "application/http; msgtype=request")], [b"GET / HTTP/1.1\r\n\r\n"]),
        warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Target-URI", "http://b/"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + sha(trap))], [http]),
        warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:uuid:4>"), ("WARC-Target-URI", "http://b/c"), ("Content-Type", "text/plain")], [b"z" * 400_000]),
    ], trap


FORMS = {
    "plain.warc": lambda recs: b"".join(b"".join(r) for r in recs),
    "members.warc.gz": lambda recs: b"".join(gzip.compress(b"".join(r)) for r in recs),
    "lengths.warc.gz": lambda recs: b"".join(warc.member(r) for r in recs),
}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_foreign_archives(spark, tmp_path, name):
    recs, trap = foreign()
    data = FORMS[name](recs)
    (tmp_path / name).write_bytes(data)
    got = {r.record_id[-1]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert [got[k].warc_type for k in "1234"] == ["warcinfo", "request", "response", "resource"]
    assert bytes(got["3"].payload) == trap and got["3"].payload_length == len(trap) and got["2"].target_uri == "http://a/ b"
    assert bytes(got["4"].payload) == b"z" * 400_000 and got["4"].headers["content-type"] == "text/plain"
    some = warc.read(spark, str(tmp_path), "warc_type string, target_uri string").where("warc_type = 'response' AND target_uri LIKE 'http://b%'")
    assert [tuple(r) for r in some.collect()] == [("response", "http://b/")]
    assert warc.read(spark, f"file://{tmp_path}/{name}").where("payload_length > 100000").count() == 1
    given = warc.read(spark, str(tmp_path), "record_id string", [("warc_type", "in", ["response", "resource"]), ("target_uri", ">=", "http://b/c")])
    assert [r.record_id for r in given.collect()] == ["urn:uuid:4"]
    both = warc.read(spark, str(tmp_path))  # one loaded frame, two conditions
    assert sorted(r.record_id[-1] for r in both.where("warc_type = 'request'").unionByName(both.where("warc_type = 'response'")).collect()) == ["2", "3"]
    with pytest.raises(Exception, match="can be pushed down"):
        warc.read(spark, str(tmp_path), where=[("payload_length", "=", 3)]).count()
    for cut in (len(data) - 7, len(data) // 2):
        with pytest.raises(warc.Damaged, match="broken"):
            list(warc.records(io.BytesIO(data[:cut]), cut, "broken"))


def test_unwanted_payloads_are_passed_over():
    big = [warc.record([("WARC-Type", t), ("WARC-Record-ID", f"<{t}>")], [random.Random(k).randbytes(2_000_000)]) for k, t in enumerate(["response", "request", "response"])]
    for form in ("plain.warc", "lengths.warc.gz"):
        data = FORMS[form](big)
        read = []

        class Counted(io.BytesIO):
            def read(self, n=-1):
                out = super().read(n)
                read.append(len(out))
                return out

        assert [r["warc_type"] for r in warc.records(Counted(data), len(data), form, lambda r: r["warc_type"] == "request", payload=False, lengths=False)] == ["request"]
        assert sum(read) < 4 * warc.READ
        read.clear()
        assert len(list(warc.records(Counted(data), len(data), form))) == 3 and sum(read) == len(data)


def test_verified_digests():
    recs = [warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + sha(b"other"))], [b"body"])]
    data = FORMS["lengths.warc.gz"](recs)
    assert len(list(warc.records(io.BytesIO(data), len(data), "x"))) == 1
    with pytest.raises(warc.Damaged, match="digest"):
        list(warc.records(io.BytesIO(data), len(data), "x", verify=True))


def test_plans_and_pushed_conditions(tmp_path):
    for k in range(9):
        (tmp_path / f"{k}.warc").write_bytes(b"x" * (10 if k else 1000))
    (tmp_path / "notes.txt").write_text("not an archive")
    reader = warc.PushedWarcReader({"path": str(tmp_path), "split": "45"}, _parse_datatype_string(warc.SCHEMA))
    assert sorted(len(p.paths) for p in reader.partitions()) == [1, 4, 4]
    odd = [StringContains(("warc_type",), "x"), EqualTo(("payload_length",), 3)]
    good = [EqualTo(("warc_type",), "response"), In(("record_id",), ("a", "b")), StringStartsWith(("target_uri",), "http")]
    assert list(reader.pushFilters([*odd, *good])) == odd and reader.filters == good
    with pytest.raises(FileNotFoundError):
        warc.WarcReader({"path": str(tmp_path / "none")}, reader.schema).partitions()


def test_conditions_that_spark_pushes(spark, tmp_path):
    (tmp_path / "lengths.warc.gz").write_bytes(FORMS["lengths.warc.gz"](foreign()[0]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(warc.WarcSource)
        got = spark.read.format("warc").option("pushdown", True).load(str(tmp_path)).where("warc_type = 'response' AND payload_length > 3")
        assert [r.record_id for r in got.collect()] == ["urn:uuid:3"]
        assert "warc_type" not in got._jdf.queryExecution().executedPlan().toString().split("Filter")[1].split("BatchScan")[0]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_failed_writes_leave_nothing(tmp_path):
    writer = warc.WarcWriter(str(tmp_path / "w"), "1970-01-01T00:00:00Z")
    batch = pa.RecordBatch.from_pylist([{"warc_type": "response", "record_id": "a", "target_uri": None, "refers_to": None, "payload_length": 1, "payload": b"x", "payload_digest": sha(b"x")}])
    said = [writer.write(iter([batch])), writer.write(iter([])), writer.write(iter([batch]))]
    assert len(list((tmp_path / "w").glob("*.part"))) == 2 and said[1].path is None
    writer.abort([said[0], None])
    writer.commit(said[1:])
    assert [p.name for p in (tmp_path / "w").iterdir()] == [said[2].path.rsplit("/", 1)[1]]


# ---- phrases ---------------------------------------------------------------------------------


def plain_phrases(rows, least, longest, share, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for k in range(1, longest + 1):
            for r in plain_runs(text or "", k):
                f[lang or "und", r] += 1
                n[lang or "und"] += k == 1
    cand = {k: v for k, v in f.items() if v >= least and " " in k[1]}
    out = []
    for (lang, p), a in cand.items():
        w = p.split(" ")
        cuts = [(10**6 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(lq == lang and q != p and f" {p} " in f" {q} " and 100 * b >= share * a for (lq, q), b in cand.items())
        if not inside:
            out.append((lang, p, a, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], n[lang], score))
    ranked = []
    for _, some in itertools.groupby(sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())), key=lambda r: r[0]):
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(some) if i < top]
    return ranked


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    bag = ["a", "The", "of", "é", "new", "york", "city", "日本", "x-y", "in"]
    say = lambda n: "".join(rng.choice(bag) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(n))
    rows = [(k, say(rng.randint(0, 60)), rng.choice(["en", "fr", None])) for k in range(150)]
    return rows + [(1, None, "en"), (None, "New York city of", "en"), *[(3, "in the  New York City", "en")] * 12, (4, "", None), (5, " . ,", "xx")]


@pytest.mark.parametrize("longest,least,share,top", [(3, 10, 50, 2000), (4, 3, 80, 15), (2, 1, 50, 7)])
def test_phrases_match_brute_force(spark, prose, longest, least, share, top):
    d = spark.createDataFrame(prose, "doc_id long, text string, lang string").repartition(3).select("*", *(F.lit("clash").alias(c) for c in ("words", "phrase", "f", "n", "rank", "salt")))
    for width in (None, 1 << 16, 8):  # eight counters: everything survives, and nothing changes
        got = phrases.phrases(d, least, longest, share, top, width=width).collect()
        assert sorted(map(tuple, got)) == sorted(plain_phrases(prose, least, longest, share, top))
    assert phrases.phrases(d.where("false")).count() == 0


def test_sketch_keeps_what_is_frequent_and_little_else(spark):
    rng = random.Random(5)
    text = [" ".join(str(rng.randint(0, 3000)) for _ in range(300)) + " often seen here" for _ in range(30)]
    d = spark.createDataFrame([(t, "en") for t in text], "text string, lang string").select("lang", "text").repartition(4)
    bits = phrases.sketch_bits(d, 1 << 18)
    assert bits.shape == (2, 1 << 15) and 4 <= np.unpackbits(bits, axis=1).sum(axis=1).min() <= 60
    with pytest.raises(ValueError):
        phrases.sketch_bits(d, 1000)


def test_phrases_of_very_long_texts(spark):
    rng = random.Random(6)
    long = " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(1_600_000))  # one piece of 4.8 MB
    rows = [(1, long, "en"), (2, "y" * 5_000_000 + " ab", "en")]
    got = phrases.phrases(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, 10, 3, 50, 2000))


# ---- resampling ------------------------------------------------------------------------------


def plain_resampled(docs, target, percent, longest, buckets, least, seed):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for _, x in target:
        t.update(features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    order = sorted((k for k in range(len(out)) if out[k][4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, out[k][1], out[k][2]))
    rank = {k: r + 1 for r, k in enumerate(order[: percent * len(order) // 100])}
    return [(*out[k][:4], rank.get(k)) for k in range(len(out))]


@pytest.mark.parametrize("longest,percent,buckets", [(1, 10, 10_000), (3, 37, 50), (2, 100, 7)])
def test_resampling_matches_brute_force(spark, longest, percent, buckets):
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma9", "é", "日本", "x_y", "it's", "1.5"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    docs = [(k, say(rng.randint(0, 60))) for k in range(120)]
    docs += [(None, None), (None, say(30)), (3, ""), *[(7, docs[7][1])] * 3, (200, say(260_000)), (201, "z" * 2_500_000), (None, say(200_000))]
    target = [(k, say(20).replace("é", "Beta")) for k in range(9)] + [(None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).select("*", *(F.lit("clash").alias(c) for c in ("row", "carried", "part", "at", "weight", "rank")))
    aim = spark.createDataFrame(target, "item_id long, text string")
    got = resample.resample(frame, aim, percent=percent, longest=longest, buckets=buckets).collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_resampled(docs, target, percent, longest, buckets, 20, 2024), key=key)
    assert resample.resample(frame.where("false"), aim).count() == 0
    assert all(r.rank is None or r.rank >= 1 for r in resample.resample(frame, aim.where("false")).collect())


def test_long_texts_are_dealt_over_tasks(spark):
    text = "alpha beta gamma " * 600_000  # ten chunks
    short, chunks = resample.chunked(spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string"), 1, "doc_id", "text")
    sizes = [len(r.text) for r in chunks.collect()]
    assert len(sizes) == 10 and max(sizes) <= grams.CHUNK + 10 and [r.doc_id for r in short.collect()] == [2]
