"""MinHash near-duplicate groups: fast similarity sketches, banding, exact verification.

Method.  Every text becomes its set of distinct word shingles.  Rows with the same set form one
class (a map-side-combined aggregate, so thousands of copies cost one row).  Each class gets a
fast similarity sketch of ``BANDS * ROWS`` coordinates: rounds of hashed bin placement fill every
coordinate for certain, and the concentration is that of sampling without replacement.  Classes
that agree in a whole band are candidates.  Links count only after exact comparison of full sets.

No bucket is expanded into its pairs.  First each member is compared with the least member of its
bucket (a star: linear).  Classes so linked are merged into components.  Only buckets that still
hold several components are looked into again, with wider sketches of ``WIDE`` coordinates and the
full sets.  Within a bucket only members of different components are compared: members of the
largest component meet the rest, but not each other.  A bucket is dealt in blocks bounded by
members and bytes, of which there are few copies.  A task verifies pairs of two blocks whose
sketches could reach the threshold (a margin of five standard deviations) on their full sets, the
likeliest first, and merges components as it goes, so it hands on at most one link for each
component it saw, never all pairs.  A pair that shares several bands is taken up in the first of
them only.  Pairs within a component are never made, which loses no component.

With 40 bands of 5, a pair at the threshold of 0.75 shares no band with probability 2e-5, at 0.8
with 6e-8.

Defined results.  Null text, empty text and text without words: 0 shingles, linked with nothing,
its own component.  Fewer words than the shingle width: one shingle of all words.  Repeated rows
(the same id more than once): each row is answered, by its own text.  Null id:
linked like any other row, always kept; its component is the least id that is not null.  Empty table: empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.llm import common
from oscilla.llm.components import connected_components
from oscilla.llm.shingles import band_keys, digest, shingle_set, sketch
from oscilla.llm.shingles import common as overlap

BANDS, ROWS, PERCENT = 40, 5, 75
#: Coordinates of the sketches that choose what is verified across components, a byte each.
WIDE = 1024
#: Members of a bucket that are dealt as one block; with more than BLOCKS such blocks, blocks grow up to BLOCK_BYTES of sketches and sets.
BLOCK, BLOCKS, BLOCK_BYTES = 768, 8, 16 << 20


def _sketched(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.record_batches(batches):
            n, dig, keys = [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py().encode(), width) if t.is_valid else ()
                n.append(len(s))
                if len(s):
                    dig.append(digest(s))
                    keys.append(band_keys(sketch(s, bands * rows), rows).view(np.int64))
                else:
                    dig.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n_shingles", "dig", "bands"],
            )

    return run


def _sets(width: int, bands: int, rows: int):
    """Sets, and wide sketches followed by band keys; where an id repeats with another text, the digest tells which one is meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.record_batches(batches):
            got = []
            for d, t in zip(b.column("dig"), b.column("text"), strict=True):
                s = shingle_set(t.as_py().encode(), width)
                if digest(s) == d.as_py():
                    sk = sketch(s, WIDE)
                    got.append((d.as_py(), s.tobytes(), (sk ^ (sk >> np.uint64(40))).astype(np.uint8).tobytes() + band_keys(sketch(s, bands * rows), rows).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.binary()) for k in range(3)], names=["dig", "set", "sig"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.record_batches(batches):
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = overlap(p, q)
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(percent: int):
    """Verified links between different components within one block, or between two, of one bucket: a forest, not all pairs."""
    least = percent / 100
    slack = 5 * (least * (1 - least) / WIDE) ** 0.5

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        sig, bands = both[:, :WIDE], np.ascontiguousarray(both[:, WIDE:]).view(np.int64)
        n, blk, dig = pdf["n"].to_numpy(), pdf["blk"].to_numpy(), pdf["dig"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        comp = pd.factorize(pdf["comp"])[0]
        lo, hi = key[1], key[2]
        rows = np.flatnonzero(blk == lo)
        others = rows if lo == hi else np.flatnonzero(blk == hi)
        links = []
        for x, i in enumerate(rows):
            j = others if lo != hi else others[x + 1 :]
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if not len(j):
                continue
            like = (sig[j] == sig[i]).mean(axis=1)
            j, like = j[like >= least - slack], like[like >= least - slack]
            if len(j):
                agree = bands[j] == bands[i]
                first = bands[i][agree.argmax(axis=1)] == key[0]
                j, like = j[first], like[first]
            for k in j[np.argsort(-like, kind="stable")]:
                if comp[k] == comp[i]:
                    continue  # linked by now
                shared = overlap(sets[i], sets[k])
                if 100 * shared >= percent * (n[i] + n[k] - shared):
                    links.append((min(dig[i], dig[k]), max(dig[i], dig[k])))
                    comp[comp == comp[k]] = comp[i]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    full = pairs.join(sets.select(F.col("dig").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("dig").alias("a"), F.col("set").alias("set_a")), "a")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a binary, b binary")


def _links_across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a bucket.  ``placed``: band, dig, n, comp for each member of a shared bucket."""
    of_comp = placed.groupBy("band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("size"))
    mixed = of_comp.groupBy("band").agg(F.sum("c").alias("m"), (F.sum("size") * 8 + F.sum("c") * (WIDE + 8 * BANDS)).alias("bytes"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"))
    mixed = common.materialize(mixed.where("comps > 1").select("band", "m", "bytes", F.col("top.c").alias("big"), F.col("top.comp").alias("big_comp")), "mixed")
    blocks = lambda members, share: F.ceil(F.greatest(F.least(members / BLOCK, F.lit(float(BLOCKS))), share * F.col("bytes") / BLOCK_BYTES, F.lit(1.0))).cast("int")
    split = blocks(F.col("m"), F.lit(1.0)) > 1  # a bucket of one block is dealt whole
    rest = F.col("m") - F.when(split, F.col("big")).otherwise(0)
    held = placed.join(mixed, "band").withColumn("nrest", blocks(rest, rest / F.col("m")))
    held = held.withColumn("nbig", F.when(split, blocks(F.col("big"), F.col("big") / F.col("m"))).otherwise(0))
    held = held.withColumn("isbig", (F.col("nbig") > 0) & (F.col("comp") == F.col("big_comp")))
    spread = F.xxhash64("dig")
    held = held.withColumn("blk", F.when(F.col("isbig"), F.col("nrest") + F.pmod(spread, F.greatest("nbig", F.lit(1)))).otherwise(F.pmod(spread, F.col("nrest"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("nrest") - 1 + F.when(F.col("isbig"), 0).otherwise(F.col("nbig")))
    dealt = (
        held.join(sets.select("dig", "sig", "set"), "dig")
        .withColumn("other", F.explode(others))
        .select("band", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "dig", "n", "comp", "sig", "set")
    )
    # few bytes but much work: as many tasks as the session's shuffles have, not as few as the bytes suggest
    dealt = dealt.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "lo", "hi")
    links = common.materialize(dealt.groupBy("band", "lo", "hi").applyInPandas(_across(percent), "a binary, b binary").distinct(), "links")
    common.forget(mixed)
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least id reachable), kept."""
    return groups(docs, key, text, **options).drop("mark", "group")


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """As :func:`near_duplicates`, with ``mark`` (xxhash64 of the text, which with the id names a row up to repeats) and ``group``, a
    component's own name however ids repeat (null without shingles)."""
    base = common.two_columns(docs, key, text)
    base = base.withColumn("mark", F.xxhash64("text"))  # with the id, finds a class's text again, whatever ids are null or repeat
    seen = common.materialize(base.mapInArrow(_sketched(width, bands, rows), "doc_id long, mark long, n_shingles long, dig binary, bands array<bigint>"), "sketches")

    # copies are combined before any shuffle, so a text with a million of them is one row a task
    held = seen.where("dig IS NOT NULL")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("one")
    ids = common.materialize(held.groupBy("dig").agg(one).select("dig", F.col("one.doc_id").alias("id"), F.col("one.mark").alias("of")), "classes")
    classes = held.groupBy("dig").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = common.materialize(classes.select("dig", "n", F.explode("bands").alias("band")), "bands")
    # written first, so that both sides of the join are plain shuffles, whose hot keys Spark can split
    buckets = common.materialize(members.groupBy("band").agg(F.min("dig").alias("hub"), F.count("*").alias("m")).where("m > 1"), "hubs")
    shared = common.materialize(members.join(buckets, "band").select("band", "dig", "n", "hub"), "buckets")
    common.forget(members)
    common.forget(buckets)

    stars = shared.where("dig != hub").select(F.col("hub").alias("a"), F.col("dig").alias("b")).distinct()
    first = ids.join(shared.select("dig").distinct(), "dig", "left_semi")
    texts = base.where("text IS NOT NULL").join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")))
    sets = texts.select("dig", "text").mapInArrow(_sets(width, bands, rows), "dig binary, set binary, sig binary").dropDuplicates(["dig"])
    sets = common.materialize(sets, "sets")

    links = common.materialize(_exact(stars, sets, percent), "links")
    comp = connected_components(links)
    placed = shared.select("band", "dig", "n").join(comp.select(F.col("node").alias("dig"), "comp"), "dig", "left").withColumn("comp", F.coalesce("comp", "dig"))
    placed = common.materialize(placed, "members")
    across = _links_across(placed, sets, percent)
    for done in (shared, sets, placed, comp):
        common.forget(done)
    comp = connected_components(links.unionByName(across))

    # components by class, then one join for the rows
    known = common.materialize(ids.join(comp.select(F.col("node").alias("dig"), "comp"), "dig").select("dig", "id", "comp"), "known")
    least = common.materialize(known.groupBy("comp").agg(F.min("id").alias("component_id")), "least")
    linked = common.materialize(known.join(least, "comp").select("dig", "comp", "component_id"), "linked")
    found = ids.join(linked, "dig", "left").select("dig", F.coalesce("comp", "dig").alias("group"), F.coalesce("component_id", "id").alias("component_id"))
    found = common.materialize(found, "found")
    for done in (links, across, comp, ids, known, least, linked):
        common.forget(done)
    out = seen.select("doc_id", "mark", "n_shingles", "dig").join(found, "dig", "left")
    out = out.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
