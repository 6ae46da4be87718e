"""Spike-train analytics: rasters, histograms, correlograms, synchrony, metrics and summaries.

Times are whole numbers (samples or microseconds), so every bin decision is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.functions.windows import band_join, grid, weighted_below


def unit_train(spikes: DataFrame, unit: int, start: int | None = None, end: int | None = None) -> DataFrame:
    out = spikes.where(F.col("unit_id") == unit)
    out = out if start is None else out.where(F.col("sample") >= start)
    return out if end is None else out.where(F.col("sample") < end)


#: Spikes, or events, of a time that a raster pairs at once; pairs that it tests in a share of a bucket and in a task, about; most of its tasks.
AT_ONCE, RASTER_PAIRS, RASTER_TASKS = 1 << 6, 1 << 23, 1 << 12


def _together(rows: DataFrame, name: str) -> DataFrame:
    """_at, _part, _all: the rows of a time in arrays of at most AT_ONCE, numbered; ``name`` stands in structs, so that nulls stay."""
    place = F.row_number().over(Window.partitionBy("sample").orderBy(name))
    parts = rows.select("sample", name).where("sample IS NOT NULL").withColumn("_part", F.floor((place - 1) / AT_ONCE))
    return parts.groupBy(F.col("sample").alias("_at"), "_part").agg(F.collect_list(F.struct(name)).alias("_all"))


def raster(spikes: DataFrame, events: DataFrame, pre: int, post: int) -> DataFrame:
    """unit_id, event_id, rel: spikes with event - pre <= sample < event + post.

    The rows are pairs, far more than what is read.  Spikes and events of equal times meet as arrays, and the rows of two arrays
    follow each other: their ``rel`` is one, and files of columns keep it once.  Buckets as wide as the band are dealt in
    shares of about RASTER_PAIRS pairs, and there are as many tasks as pairs ask for; one job counts them.
    """
    width = max(1, pre + post)
    bucket = lambda at: at - F.pmod(at, F.lit(width))
    own = bucket(F.col("_at"))
    reach = F.explode(F.array_distinct(F.array(bucket(F.col("_at") - pre), bucket(F.col("_at") + post - 1))))
    sizes = [rows.select(F.col("sample").alias("_at")).select(b.alias("_b")).groupBy("_b").agg(F.count("*").cast("double").alias(n)) for rows, b, n in ((spikes, own, "_s"), (events, reach, "_e"))]
    parts = sizes[0].join(sizes[1], "_b").select("_b", (F.col("_s") * F.col("_e") / RASTER_PAIRS).alias("_n"))
    tasks = max(1, min(RASTER_TASKS, math.ceil(parts.agg(F.sum("_n")).first()[0] or 0)))
    shares = parts.select("_b", F.ceil("_n").alias("_n"))
    s = _together(spikes, "unit_id").withColumn("_b", own).join(shares, "_b")
    s = s.select("_b", F.pmod(F.xxhash64("_at", "_part"), F.col("_n")).alias("_share"), "_at", "_all")
    e = _together(events, "event_id").select(reach.alias("_b"), F.col("_at").alias("_e_at"), F.col("_all").alias("_events")).join(shares, "_b")
    e = e.select("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_share"), "_e_at", "_events")
    key, rel = ["_b", "_share"], F.col("_at") - F.col("_e_at")
    met = e.repartition(tasks, *key).join(s.repartition(tasks, *key), key).where((rel >= -pre) & (rel < post))
    each = met.select(rel.alias("rel"), "_all", F.explode("_events").alias("_event")).select("rel", "_event.event_id", F.explode("_all").alias("_spike"))
    return each.select("_spike.unit_id", "event_id", "rel")


def psth(spikes: DataFrame, events: DataFrame, pre: int, post: int, width: int, second: int, baseline: tuple[int, int] | None = None) -> DataFrame:
    """Mean count and rate of each unit and bin over all events, empty ones included.

    A spike on an edge belongs to the lower bin, one on the first edge to none.  Events before each spike's bin edges
    are counted, and no pair of spike and event is made.
    """
    n = (pre + post) // width
    n_events = events.agg(F.count("*").alias("_n"))
    times = spikes.groupBy("unit_id", "sample").agg(F.count("*").alias("_c"))
    edge = times.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n))))
    points = edge.select("unit_id", "bin", F.greatest(F.col("sample") + pre - F.col("bin") * F.lit(width).cast("long"), F.col("sample") - post + 1).alias("at"), "_c")
    upper = weighted_below(points, events.select(F.col("sample").alias("at")), width, ("unit_id", "bin"), ("_c",))
    lower = upper.select("unit_id", (F.col("bin") - 1).alias("bin"), F.col("_c").alias("_less"))
    counts = upper.join(lower, ["unit_id", "bin"]).select("unit_id", "bin", (F.col("_c") - F.col("_less")).alias("_c"))
    full = grid(spikes.select("unit_id").distinct(), n).join(counts, ["unit_id", "bin"], "left").crossJoin(F.broadcast(n_events))
    out = full.select("unit_id", "bin", F.try_divide(F.coalesce("_c", F.lit(0)), F.col("_n")).alias("mean_count")).withColumn("rate", F.col("mean_count") / (width / second))
    if baseline:
        base = out.where(F.col("bin").between(*baseline)).groupBy("unit_id").agg(F.avg("rate").alias("_b"))
        out = out.join(base, "unit_id").withColumn("normalized", F.when(F.col("_b") > 0, (F.col("rate") - F.col("_b")) / F.col("_b")).otherwise(F.col("rate"))).drop("_b")
    return out


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[float]:
    r = math.ceil(3 * sigma) if radius is None else radius
    k = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def smooth_bins(binned: DataFrame, value: str, sigma: float, n: int, edge: str = "mirror", by: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """Gaussian smoothing over dense bins 0..n-1; beyond the ends bins are mirrored, or zero.

    The weights from bin to bin are a small constant table that joins on the bin.
    """
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    table: dict[tuple[int, int], float] = {}
    for b in range(n):
        for k, w in enumerate(kernel):
            src = b + k - r
            if edge == "mirror":
                while not 0 <= src < n:
                    src = -src - 1 if src < 0 else 2 * n - 1 - src
            if 0 <= src < n:
                table[b, src] = table.get((b, src), 0.0) + w
    rows = binned.sparkSession.createDataFrame([(b, s, w) for (b, s), w in table.items()], "to int, bin int, w double")
    return binned.join(F.broadcast(rows), "bin").groupBy(*by, F.col("to").alias("bin")).agg(F.sum(F.col(value) * F.col("w")).alias("smoothed"))


def density(spikes: DataFrame, width: int, n: int, sigma_bins: float, second: int) -> DataFrame:
    """Smoothed rate of each unit: counts in n bins, Gaussian with zeros beyond the ends, per second."""
    counts = spikes.groupBy("unit_id", F.floor(F.col("sample") / width).cast("int").alias("bin")).agg(F.count("*").alias("_c")).where((F.col("bin") >= 0) & (F.col("bin") < n))
    full = grid(spikes.select("unit_id").distinct(), n).join(counts, ["unit_id", "bin"], "left").select("unit_id", "bin", F.coalesce("_c", F.lit(0)).alias("count"))
    return smooth_bins(full, "count", sigma_bins, n, "zero").select("unit_id", "bin", (F.col("smoothed") * (second / width)).alias("rate"))


#: Pairs of spikes that a task makes at a time; pairs from which groups of units are more than one, most groups for pairs' sake, spikes of a group, about, and of a packed row.
HELD, TASK_PAIRS, MOST_GROUPS, TASK_SPIKES, PACKED = 1 << 18, 1 << 22, 1 << 5, 1 << 20, 1 << 16
#: Stands for a missing time.
NEVER = -(1 << 62)


class Group:
    """Spikes of some units in order of unit and sample: ``units``, the place of each spike's unit in them, times by run, numbers of equal times, the units' sizes."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda row: row["_p"])
        self.units = pa.concat_arrays([row["units"] for row in rows])
        names, lengths = self.units.to_numpy(zero_copy_only=False), np.concatenate([row["lengths"] for row in rows])
        fresh = np.append(True, names[1:] != names[:-1])  # a unit may go on in the next row
        self.units, self.names = self.units.take(pa.array(np.flatnonzero(fresh))), names[fresh]
        self.of = np.repeat(np.cumsum(fresh) - 1, lengths)
        each = [[np.frombuffer(v, np.int64 if r == 0 or len(v) > 4 * k else np.int32) for r, v in enumerate(row["at"])] for row, k in ((row, int(row["lengths"].sum())) for row in rows)]
        first, *moved = map(np.concatenate, zip(*each, strict=True))
        self.at = [first, *(first + m for m in moved)]
        self.n = np.concatenate([np.frombuffer(row["n"], np.int64) for row in rows])
        self.sizes = np.add.reduceat(self.n, np.flatnonzero(np.append(True, self.of[1:] != self.of[:-1])))
        timed = first != NEVER
        if not timed.all():  # they count in sizes and meet nothing
            self.of, self.n, self.at = self.of[timed], self.n[timed], [x[timed] for x in self.at]
        self.ends = np.flatnonzero(np.append(self.of[1:] != self.of[:-1], True)) + 1
        self.single = bool((self.n == 1).all())


class Meeting:
    """Pairs of spikes of two groups at most ``reach`` apart, for whole units of the first one after the other."""

    def __init__(self, a: Group, b: Group, reach: int):
        self.a = a
        self.order = [np.argsort(y, kind="stable") for y in b.at]
        self.y = [y[o] for y, o in zip(b.at, self.order, strict=True)]
        self.lo = [np.searchsorted(y, x - reach) for x, y in zip(a.at, self.y, strict=True)]
        self.n = [np.searchsorted(y, x + reach, "right") - lo for x, y, lo in zip(a.at, self.y, self.lo, strict=True)]

    def parts(self) -> Iterator[tuple[int, int, bool]]:
        """from, to, ended: spikes of the first group with about HELD pairs, of whole units or a part of one; whether its unit ends."""
        ends, at = np.cumsum(sum(self.n)), 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
            k = int(np.searchsorted(self.a.ends, to, "right"))
            ended = k > 0 and self.a.ends[k - 1] > at
            to = int(self.a.ends[k - 1]) if ended else to
            yield at, to, ended
            at = to

    def pairs(self, run: int, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """How many spikes of the second group each of the first meets, and their places in order of time."""
        n = self.n[run][at:to]
        return n, np.arange(n.sum()) + np.repeat(self.lo[run][at:to] - np.cumsum(n) + n, n)


def meetings(spikes: DataFrame, reach: int, run, schema: str, at: list[Column] | None = None) -> DataFrame:
    """``run(a, b)`` for every two groups of units, the same ``Group`` twice for a group by itself; it yields lists of columns.

    All spikes of a unit are in its group, so what a pair of units has is whole in one task: spikes travel, their pairs do not.
    Spikes travel packed, once to each group, and a pair of groups is a task.  Groups are as many as the cube root of the pairs
    within ``reach`` asks for, so that what is sent grows slowly.  ``at`` gives times by which units meet (else the sample);
    equal times of a unit are one row with their number n.
    """
    runs, kind = len(at or [0]), dict(spikes.dtypes)["unit_id"]
    known = spikes.where("unit_id IS NOT NULL")
    times = known.groupBy("unit_id", "sample").agg(F.count("*").alias("n")).select("unit_id", "n", *(F.coalesce(c.cast("long"), F.lit(NEVER)).alias(f"at{k}") for k, c in enumerate(at or [F.col("sample")])))
    size = known.where("sample IS NOT NULL").groupBy(F.floor(F.col("sample") / max(1, reach)).alias("b")).agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("q"), F.sum("n").alias("n")).first()
    g = max(1, min(MOST_GROUPS, math.ceil((3 * (size["q"] or 0) * runs / TASK_PAIRS) ** (1 / 3))), math.ceil((size["n"] or 0) / TASK_SPIKES))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit_id", "at0"])
        rows = []
        for k in range(0, len(pdf), PACKED):
            part = pdf.iloc[k : k + PACKED]
            unit, first = part["unit_id"].to_numpy(), part["at0"].to_numpy()
            begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            moved = [part[f"at{r}"].to_numpy() - first for r in range(1, runs)]
            moved = [m.astype(np.int32) if np.abs(m).max() < 1 << 31 else m for m in moved]
            rows.append((key[0], k, unit[begin], np.diff(np.append(begin, len(part))), part["n"].to_numpy().tobytes(), [m.tobytes() for m in (first, *moved)]))
        return pd.DataFrame(rows, columns=["_g", "_p", "units", "lengths", "n", "at"])

    own = F.pmod(F.xxhash64("unit_id"), F.lit(g)).cast("int")
    packed = times.withColumn("_g", own).groupBy("_g").applyInPandas(pack, f"_g int, _p long, units array<{kind}>, lengths array<long>, n binary, at array<binary>")
    sent = packed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))).withColumn("_i", F.least("_g", "_o")).withColumn("_j", F.greatest("_g", "_o")).drop("_o")
    names = [f.split()[0] for f in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list[dict], list[dict]] = ([], [])
        alone = False
        for batch in batches:
            i, j, own = (batch.column(c).to_pylist() for c in ("_i", "_j", "_g"))
            for k in range(batch.num_rows):
                alone = i[k] == j[k]
                row = {c: batch.column(c)[k] for c in ("_p", "units", "lengths", "n", "at")}
                rows[own[k] != i[k]].append({"_p": row["_p"].as_py(), "units": row["units"].values, "lengths": row["lengths"].values.to_numpy(), "n": row["n"].as_py(), "at": row["at"].as_py()})
        if rows[0] and (alone or rows[1]):
            a = Group(rows[0])
            b = a if alone else Group(rows[1])
            rows[0].clear(), rows[1].clear()
            for columns in run(a, b):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    number = (F.col("_j") * (F.col("_j") + 1) / 2 + F.col("_i")).cast("int")
    return sent.repartitionById(g * (g + 1) // 2, number).mapInArrow(task, schema)


def summed(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how many there are of each or the sums of their weights."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    if weights is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.diff(np.append(first, len(codes))) if weights is None else np.add.reduceat(weights, first)


def _in_order(a: Group, b: Group, one: np.ndarray, two: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """unit1, unit2 of places in the units of two groups, and whether they changed sides so that unit1 is the lesser."""
    turn = np.zeros(len(one), bool) if a is b else np.searchsorted(b.names, a.names)[one] > two
    if a is b or not turn.any():
        return a.units.take(pa.array(one)), b.units.take(pa.array(two)), turn
    both, two = pa.concat_arrays([a.units, b.units]), two + len(a.units)
    return both.take(pa.array(np.where(turn, two, one))), both.take(pa.array(np.where(turn, one, two))), turn


def lag_counts(spikes: DataFrame, width: int, half: int, same: str | None = None, at: list[Column] | None = None) -> DataFrame:
    """unit1, unit2, bin, count, others, size: pairs of spikes by lag for the first of the times ``at``, in cells where it has some, those for all other times, and the spikes of unit1.

    ``same`` says which pairs of a unit with itself count: none, "all" or those at "other" times.
    """
    runs, bins = len(at or [0]), (2 * half - 1) // width + 1
    step = 1 if runs == 1 else 2  # a cell's pairs, and those of other times next to them

    def run(a: Group, b: Group) -> Iterator[list]:
        met, alone, single = Meeting(a, b, half), a is b, a.single and b.single
        before = np.searchsorted(b.names, a.names)
        with_b = [b.of[o] for o in met.order]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for at, to, ended in met.parts():
            first = int(a.of[at])
            small = (int(a.of[to - 1]) - first + 1) * len(b.units) * bins * step < 1 << 31
            kind, codes, weights = np.int32 if small else np.int64, [], []
            for r in range(runs):
                n, p = met.pairs(r, at, to)
                u, v = np.repeat(a.of[at:to], n), with_b[r][p]
                lag = met.y[r][p] - np.repeat(a.at[r][at:to], n)
                if alone:  # every pair is met both ways
                    ok = v > u if same is None else v >= u if same == "all" else (v > u) | ((v == u) & (lag != 0))
                else:
                    lag = np.where(np.repeat(before[a.of[at:to]], n) > v, -lag, lag)
                    ok = np.ones(len(lag), bool)
                ok &= lag < half
                if not ok.all():
                    u, v, lag, p = u[ok], v[ok], lag[ok], p[ok]
                code = (u - first).astype(kind) * kind(len(b.units)) + v.astype(kind)
                code = code * kind(bins) + ((lag + half) // width).astype(kind)
                codes.append(code if step == 1 else code * kind(2) + kind(r > 0))
                if not single:
                    k = np.repeat(np.arange(at, to), n)
                    weights.append(a.n[k if ok.all() else k[ok]] * b.n[met.order[r][p]])
            held.append(summed(np.concatenate(codes), None if single else np.concatenate(weights)))
            if not ended and len(held) < 16:
                continue
            code, count = held[0] if len(held) == 1 else summed(*map(np.concatenate, zip(*held, strict=True)))
            if not ended:
                held = [(code, count)]
                continue
            held, others = [], np.zeros(len(code), np.int64)
            if step == 2:
                others[:-1] = np.where(code[1:] == code[:-1] + 1, count[1:], 0)
                real = code % 2 == 0
                code, count, others = code[real] // 2, count[real], others[real]
            if len(code):
                cell, bin_ = np.divmod(code, code.dtype.type(bins))
                one, two = np.divmod(cell, code.dtype.type(len(b.units)))
                one = one + first
                unit1, unit2, turn = _in_order(a, b, one, two)
                yield [unit1, unit2, bin_.astype(np.int32), count, others, np.where(turn, b.sizes[two], a.sizes[one])]

    kind = dict(spikes.dtypes)["unit_id"]
    return meetings(spikes, half, run, f"unit1 {kind}, unit2 {kind}, bin int, count long, others long, size long", at)


def correlograms(spikes: DataFrame, width: int, window: int, second: int, normalization: str | None = "rate", autos: bool = True, crosses: bool = True) -> DataFrame:
    """unit1, unit2, bin, count, value over lags of at most window / 2: all pairs of spikes, self pairs included in autos."""
    half = window // 2
    if crosses:
        binned = lag_counts(spikes, width, half, "all" if autos else None).drop("others")
    else:  # a unit meets itself alone
        times = spikes.groupBy("unit_id", "sample").agg(F.count("*").alias("n"))  # equal times once, with their number
        a = times.select("unit_id", F.col("sample").alias("a_at"), F.col("n").alias("n1"))
        b = times.select("unit_id", F.col("sample").alias("b_at"), F.col("n").alias("n2"))
        own = band_join(a, b, -half, half, ("unit_id",), "a_at", "b_at")
        lag = F.floor((F.col("b_at") - F.col("a_at") + half) / width).cast("int").alias("bin")
        binned = own.groupBy(F.col("unit_id").alias("unit1"), F.col("unit_id").alias("unit2"), lag).agg(F.sum(F.col("n1") * F.col("n2")).alias("count"))
        binned = binned.join(spikes.groupBy(F.col("unit_id").alias("unit1")).agg(F.count("*").alias("size")), "unit1")
    if normalization == "rate":
        return binned.withColumn("value", F.col("count") / (F.col("size") * (width / second))).drop("size")
    binned = binned.drop("size")
    if normalization == "probability":
        total = binned.groupBy("unit1", "unit2").agg(F.sum("count").alias("_t"))
        return binned.join(total, ["unit1", "unit2"]).withColumn("value", F.col("count") / F.col("_t")).drop("_t")
    return binned.withColumn("value", F.col("count").cast("double"))


def tiling_coefficient(spikes: DataFrame, dt: int) -> DataFrame:
    """Per unit pair that ever comes within dt: (ta + tb - ta tb) / max(1 - ta tb, 1e-10), ta and tb the shares with a partner."""

    def run(a: Group, b: Group) -> Iterator[list]:
        met, alone, n = Meeting(a, b, dt), a is b, len(b.units)
        with_b = b.of[met.order[0]]
        held: tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]] = ([], [], [])
        for at, to, ended in met.parts():
            first = int(a.of[at])
            k, p = met.pairs(0, at, to)
            k = np.repeat(np.arange(at, to), k)
            if alone:
                ok = with_b[p] > a.of[k]
                k, p = k[ok], p[ok]
            one = (a.of[k] - first) * n
            near, _ = summed((one + with_b[p]) * (to - at) + k - at)  # spikes of the first unit with one of the second, and the other way
            pair, hits = summed(near // (to - at), a.n[near % (to - at) + at]) if not a.single else summed(near // (to - at))
            back, _ = summed((a.of[k] - first) * len(b.of) + met.order[0][p])
            for part, v in zip(held, (pair, hits, back), strict=True):
                part.append(v)
            if not ended and len(held[0]) < 16:
                continue
            if len(held[0]) > 1:
                pair, hits = summed(np.concatenate(held[0]), np.concatenate(held[1]))
                back, _ = summed(np.concatenate(held[2]))
            held = ([], [], []) if ended else ([pair], [hits], [back])
            if ended and len(pair):
                place = back % len(b.of)
                _, others = summed(back // len(b.of) * n + b.of[place], b.n[place])
                one, two = pair // n + first, pair % n
                ta, tb = hits / a.sizes[one], others / b.sizes[two]
                unit1, unit2, _ = _in_order(a, b, one, two)
                yield [unit1, unit2, (ta + tb - ta * tb) / np.maximum(1 - ta * tb, 1e-10)]

    kind = dict(spikes.dtypes)["unit_id"]
    return meetings(spikes, dt, run, f"unit1 {kind}, unit2 {kind}, coefficient double")


def synchrony(spikes: DataFrame, sizes: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """Per unit: share of its spikes at times that have at least so many spikes of any unit."""
    counts = spikes.groupBy("sample").agg(F.count("*").alias("_c"))
    rows = spikes.select("unit_id", "sample").join(counts, "sample")
    return rows.groupBy("unit_id").agg(*((F.sum(F.when(F.col("_c") >= k, 1).otherwise(0)) / F.count("*")).alias(f"sync_{k}") for k in sizes))


def firing_rates(spikes: DataFrame, seconds: float) -> DataFrame:
    if seconds <= 0:
        raise ValueError("the duration must be positive")
    return spikes.groupBy("unit_id").agg(F.count("*").alias("num_spikes"), (F.count("*") / seconds).alias("firing_rate"))


def presence_ratio(spikes: DataFrame, total: int, width: int, share: float = 0.0) -> DataFrame:
    """Share of whole bins with more than floor(rate * bin * share) spikes; null if the recording has no whole bin."""
    n = total // width
    if n < 1:
        return spikes.select("unit_id").distinct().withColumn("presence_ratio", F.lit(None).cast("double"))
    inside = spikes.where(F.col("sample") <= n * width)
    counts = inside.groupBy("unit_id", F.least(F.floor(F.col("sample") / width), F.lit(n - 1)).alias("bin")).agg(F.count("*").alias("_c"))
    size = spikes.groupBy("unit_id").agg(F.floor(F.count("*") / total * width * share).alias("_limit"))
    got = counts.join(size, "unit_id").where(F.col("_c") > F.col("_limit")).groupBy("unit_id").agg(F.count("*").alias("_k"))
    return size.join(got, "unit_id", "left").select("unit_id", (F.coalesce("_k", F.lit(0)) / n).alias("presence_ratio"))


def isi(spikes: DataFrame) -> DataFrame:
    return spikes.withColumn("isi", F.col("sample") - F.lag("sample").over(Window.partitionBy("unit_id").orderBy("sample")))


def isi_violations(spikes: DataFrame, total: int, threshold: int, shortest: int = 0) -> DataFrame:
    """Number of intervals below the threshold, and (violations / (2 n (threshold - shortest))) / (n / total)."""
    g = isi(spikes).groupBy("unit_id").agg(F.count("*").alias("_n"), F.sum(F.when(F.col("isi") < threshold, 1).otherwise(0)).alias("violations"))
    ratio = F.when(F.col("_n") > 1, (F.col("violations") / (2 * F.col("_n") * (threshold - shortest))) / (F.col("_n") / total))
    return g.select("unit_id", F.col("violations").cast("long").alias("violations"), ratio.alias("ratio"))


def refractory_contamination(spikes: DataFrame, total: int, period: int, censored: int = 0) -> DataFrame:
    """Pairs of a unit's spikes within the period, and the contamination 1 - sqrt(D) (1 where D is negative)."""
    a = spikes.select("unit_id", "event_id", F.col("sample").alias("a_at"))
    b = spikes.select("unit_id", F.col("event_id").alias("other"), F.col("sample").alias("b_at"))
    pairs = band_join(a, b, 0, period + 1, ("unit_id",), "a_at", "b_at").where((F.col("b_at") > F.col("a_at")) | (F.col("other") > F.col("event_id")))
    nv = pairs.groupBy("unit_id").agg(F.count("*").alias("_v"))
    n = spikes.groupBy("unit_id").agg(F.count("*").alias("_n"))
    out = n.join(nv, "unit_id", "left").withColumn("_v", F.coalesce("_v", F.lit(0)))
    dd = 1 - F.col("_v") * (total - 2 * F.col("_n") * censored) / (F.col("_n") * F.col("_n") * F.lit(float(period - censored)))
    return out.select("unit_id", F.col("_v").alias("violations"), F.when(dd < 0, 1.0).otherwise(1 - F.sqrt(dd)).alias("contamination"))


def drift(spikes: DataFrame, position: str, interval: int, least: int, n: int) -> DataFrame:
    """Median position of each interval less the overall median: range, standard deviation, median absolute deviation."""
    whole = spikes.groupBy("unit_id").agg(F.percentile(F.col(position), F.lit(0.5)).alias("_m"))
    each = spikes.groupBy("unit_id", F.floor(F.col("sample") / interval).alias("_k")).agg(F.percentile(F.col(position), F.lit(0.5)).alias("_p"), F.count("*").alias("_c"))
    shift = each.where((F.col("_c") >= least) & (F.col("_k") < n)).join(whole, "unit_id").withColumn("_d", F.col("_p") - F.col("_m"))
    mid = shift.groupBy("unit_id").agg(F.percentile(F.col("_d"), F.lit(0.5)).alias("_mid"))
    got = shift.join(mid, "unit_id").groupBy("unit_id").agg(
        F.count("*").alias("_v"), (F.max("_d") - F.min("_d")).alias("drift_ptp"), F.stddev_pop("_d").alias("drift_std"), F.percentile(F.abs(F.col("_d") - F.col("_mid")), F.lit(0.5)).alias("drift_mad")
    )
    keep = lambda c: F.when(F.col("_v") >= 0.5 * n, F.col(c)).alias(c)
    return whole.select("unit_id").join(got, "unit_id", "left").select("unit_id", keep("drift_ptp"), keep("drift_std"), keep("drift_mad"))


def firing_range(spikes: DataFrame, width: int, n: int, second: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Difference of two percentiles of the rate per bin, empty bins included."""
    counts = spikes.groupBy("unit_id", F.floor(F.col("sample") / width).cast("int").alias("bin")).agg(F.count("*").alias("_c"))
    full = grid(spikes.select("unit_id").distinct(), n).join(counts, ["unit_id", "bin"], "left").withColumn("_r", F.coalesce("_c", F.lit(0)) / (width / second))
    q = full.groupBy("unit_id").agg(F.percentile("_r", F.array(F.lit(low), F.lit(high))).alias("_q"))
    return q.select("unit_id", (F.col("_q")[1] - F.col("_q")[0]).alias("firing_range"))


def unit_summary(spikes: DataFrame, fs: float, violation: float = 0.002) -> DataFrame:
    """Counts, rate over the whole recording, interval statistics (0 with fewer than two spikes)."""
    last = spikes.agg((F.max("sample") / fs).alias("_t"))
    x = F.col("_isi")
    g = isi(spikes).withColumn("_isi", F.col("isi") / fs).groupBy("unit_id").agg(
        F.count("*").alias("n_spikes"), F.avg(x).alias("m"), F.percentile(x, F.lit(0.5)).alias("md"), F.stddev_pop(x).alias("sd"), F.sum(F.when(x < violation, 1).otherwise(0)).cast("long").alias("isi_violations"), F.count(x).alias("_k")
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return g.crossJoin(F.broadcast(last)).select(
        "unit_id", "n_spikes", F.try_divide(F.col("n_spikes"), F.col("_t")).alias("firing_rate"), z(F.col("m")).alias("mean_isi"), z(F.col("md")).alias("median_isi"),
        z(F.when(F.col("m") > 0, F.col("sd") / F.col("m"))).alias("cv_isi"), "isi_violations", z(F.when(F.col("_k") > 0, F.col("isi_violations") / F.col("_k") * 100)).alias("violation_pct"),
    )


def quality_summary(units: DataFrame, label: str = "label") -> DataFrame:
    """Per label: number of units, and mean, standard deviation, least and greatest rate, mean cv, violations and spikes.

    Where units have ``amplitude`` or ``contamination``, their means too.
    """
    r = F.col("firing_rate")
    more = [F.avg(c).alias(f"mean_{c}") for c in ("amplitude", "contamination") if c in units.columns]
    return units.groupBy(label).agg(
        F.count("*").alias("n_units"), F.avg(r).alias("mean_rate"), F.stddev_samp(r).alias("std_rate"), F.min(r).alias("min_rate"), F.max(r).alias("max_rate"),
        F.avg("cv_isi").alias("mean_cv"), F.sum("isi_violations").alias("violations"), F.sum("n_spikes").alias("spikes"), *more,
    )


def channel_summary(spikes: DataFrame, units: DataFrame, templates: DataFrame) -> DataFrame:
    """Primary channel of each unit (greatest magnitude), then per channel: units by label, mean rate, spikes."""
    primary = templates.groupBy("unit_id").agg(F.min_by("channel", F.struct(-F.abs("value"), F.col("channel"))).alias("channel"))
    both = units.join(primary, "unit_id", "left")
    count = lambda k: F.sum(F.when(F.col("label") == k, 1).otherwise(0)).cast("long").alias(f"n_{k}")
    return both.groupBy("channel").agg(F.count("*").alias("n_units"), count("good"), count("mua"), count("unsorted"), F.avg("firing_rate").alias("mean_rate"), F.sum("n_spikes").alias("spikes"))


def recording_summary(units: DataFrame, seconds: float) -> DataFrame:
    return units.agg(
        F.lit(float(seconds)).alias("duration"), F.count("*").alias("n_units"), F.sum("n_spikes").alias("spikes"), F.avg("firing_rate").alias("mean_rate"),
        (F.try_divide(F.sum(F.when(F.col("label") == "good", 1).otherwise(0)), F.count("*")) * 100).alias("pct_good"),
    )
