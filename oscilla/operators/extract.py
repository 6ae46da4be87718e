"""Event-locked extraction: epochs, waveforms, templates, averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.functions.windows import KEYS, explode_windows

EVENT = ("event_id",)


def to_samples(col: str | Column, fs: float, unit: str = "seconds") -> Column:
    """Times to sample numbers: seconds round half to even, samples truncate."""
    c = F.col(col) if isinstance(col, str) else col
    if unit == "seconds":
        return F.bround(c * fs).cast("long")
    if unit == "samples":
        return c.cast("long")
    raise ValueError("unit is seconds or samples")


def epochs(df: DataFrame, events: DataFrame, pre: int = 10, post: int = 40, keys: tuple[str, ...] = KEYS, reject: float | None = None) -> DataFrame:
    """Rows at offsets -pre..post of each event (event_id, keys, i); events that reach outside are left out.

    Each event lists its samples and meets them in an equi-join.  ``reject`` drops epochs in which
    a sample lies more than so many standard deviations from the epoch's mean.
    """
    n = df.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    inside = events.join(n, list(keys)).where((F.col("i") >= pre) & (F.col("i") + post < F.col("n"))).drop("n")
    out = explode_windows(inside.withColumnRenamed("i", "at"), -pre, post, "at").join(df, [*keys, "i"]).select(*EVENT, *keys, "offset", "value")
    if reject is not None:
        stat = out.groupBy(*EVENT, *keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        good = stat.where(F.greatest(F.col("_hi") - F.col("_m"), F.col("_m") - F.col("_lo")) <= reject * F.col("_s"))
        out = out.join(good.select(*EVENT, *keys), [*EVENT, *keys], "left_semi")
    return out


def variable_epochs(df: DataFrame, events: DataFrame, shortest: int = 1, longest: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of [onset_idx, offset_idx), the offset cut at the channel's end; events of other lengths are left out."""
    n = df.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    cut = events.join(n, list(keys)).withColumn("stop", F.least("offset_idx", "n"))
    size = F.col("stop") - F.col("onset_idx")
    cut = cut.where((size >= shortest) & (size <= longest if longest is not None else F.lit(True)))
    rows = cut.withColumn("i", F.explode(F.sequence(F.col("onset_idx"), F.col("stop") - 1)))
    return rows.join(df, [*keys, "i"]).select(*EVENT, *keys, (F.col("i") - F.col("onset_idx")).alias("offset"), "value")


def waveforms(df: DataFrame, spikes: DataFrame, pre: int = 10, post: int = 40, align: str | None = "min", reach: int = 5, jitter: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Epochs whose extremum within ``reach`` of the event is moved to offset 0; larger shifts than ``jitter`` are not applied.

    Samples that the shifted window lacks are zero.
    """
    wide = epochs(df, spikes, pre, post, keys)
    if align is None:
        return wide
    near = wide.where(F.abs("offset") <= reach)
    value = F.col("value") if align == "min" else -F.col("value")
    shift = near.groupBy(*EVENT, *keys).agg(F.min_by("offset", F.struct(value, F.col("offset"))).alias("shift"))
    shift = shift.withColumn("shift", F.when(F.abs("shift") > jitter, 0).otherwise(F.col("shift")))
    moved = wide.join(shift, [*EVENT, *keys]).select(*EVENT, *keys, (F.col("offset") - F.col("shift")).alias("offset"), "value")
    frame = shift.select(*EVENT, *keys, F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("offset"))
    return frame.join(moved, [*EVENT, *keys, "offset"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def template(waves: DataFrame, by: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean over waveforms at each offset."""
    return waves.groupBy(*by, "offset").agg(F.avg("value").alias("value"))


def template_distribution(waves: DataFrame, by: tuple[str, ...] = KEYS) -> DataFrame:
    x = F.col("value")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = waves.groupBy(*by, "offset").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("var"), q.alias("_q"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(*by, "offset", "mean", "std", "var", F.col("_q")[1].alias("median"), "min", "max", F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"))


def triggered_average(df: DataFrame, spikes: DataFrame, pre: int, post: int, out_of_range: str = "drop", baseline: tuple[int, int] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean, and variance (ddof 1), of rows [s - pre, s + post) over a unit's spikes.

    Spikes that reach outside are left out, or count as zeros (``out_of_range="zero"``).
    """
    n_all = spikes.groupBy("unit_id", *keys).agg(F.count("*").alias("_n"))
    waves = epochs(df, spikes.withColumn("event_id", F.struct("unit_id", "i")), pre, post - 1, keys).withColumn("unit_id", F.col("event_id.unit_id"))
    out = waves.groupBy("unit_id", *keys, "offset").agg(F.avg("value").alias("average"), F.var_samp("value").alias("variance"), F.sum("value").alias("_sum"))
    if out_of_range == "zero":
        out = out.join(n_all, ["unit_id", *keys]).withColumn("average", F.col("_sum") / F.col("_n")).drop("_n")
    out = out.drop("_sum")
    if baseline:
        base = out.where(F.col("offset").between(*baseline)).groupBy("unit_id", *keys).agg(F.avg("average").alias("_b"))
        out = out.join(base, ["unit_id", *keys]).withColumn("average", F.col("average") - F.col("_b")).drop("_b")
    return out


def burst_amplitude(df: DataFrame, events: DataFrame, window: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Greatest rms of ``window`` successive samples inside each burst."""
    rows = variable_epochs(df, events, window, None, keys)
    w = Window.partitionBy(*EVENT, *keys).orderBy("offset").rowsBetween(0, window - 1)
    rms = rows.withColumn("_r", F.sqrt(F.avg(F.col("value") * F.col("value")).over(w))).withColumn("_n", F.count("*").over(w))
    return rms.where(F.col("_n") == window).groupBy(*EVENT, *keys).agg(F.max("_r").alias("amplitude"))


def signal_to_rest(df: DataFrame, events: DataFrame, rest: int = 100, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """20 log10 of the rms inside each burst over the rms of the ``rest`` samples before it."""
    power = lambda d: d.groupBy(*EVENT, *keys).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    active = power(variable_epochs(df, events, 1, None, keys))
    before = events.where(F.col("onset_idx") > 0).withColumn("offset_idx", F.col("onset_idx")).withColumn("onset_idx", F.greatest(F.col("onset_idx") - rest, F.lit(0)))
    quiet = power(variable_epochs(df, before, 1, None, keys)).withColumnRenamed("rms", "rest_rms")
    ratio = F.when((F.col("rest_rms") > 0) & (F.col("rms") > 0), 20 * F.log10(F.col("rms") / F.col("rest_rms")))
    return active.join(quiet, [*EVENT, *keys]).select(*EVENT, *keys, ratio.alias("snr_db"))


def spike_amplitudes(df: DataFrame, spikes: DataFrame, window: int = 21, sign: str = "neg", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Extreme value within window//2 of each spike; spikes near the ends are left out."""
    half = window // 2
    e = epochs(df, spikes, half, half, keys).groupBy(*EVENT, *keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    pick = {"neg": F.col("lo"), "pos": F.col("hi"), "both": F.when(F.abs("lo") > F.abs("hi"), F.col("lo")).otherwise(F.col("hi"))}[sign]
    return e.select(*EVENT, *keys, pick.alias("amplitude"))


def noise_outside(df: DataFrame, spikes: DataFrame, window: int = 21, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Standard deviation of samples that no spike's window covers (an anti-join)."""
    half = window // 2
    covered = explode_windows(spikes.select(*keys, F.col("i").alias("at")), -half, half, "at").select(*keys, "i").distinct()
    return df.join(covered, [*keys, "i"], "left_anti").groupBy(*keys).agg(F.stddev_pop("value").alias("noise"))


def template_extremum(templates: DataFrame, by: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """Signed value, offset and channel of the largest magnitude; the first one on ties."""
    rank = F.struct(-F.abs("value"), F.col("channel"), F.col("offset"))
    got = F.min_by(F.struct("value", "offset", "channel"), rank)
    return templates.groupBy(*by).agg(got.alias("_t")).select(*by, "_t.value", "_t.offset", "_t.channel")


def cosine_similarity(vectors: DataFrame, key: str = "label", value: str = "x") -> DataFrame:
    """Cosine of every two vectors (key, x array); a zero vector gives 0.  For sets of templates, not of rows."""
    a = vectors.select(F.col(key).alias("a"), F.col(value).alias("xa"))
    b = vectors.select(F.col(key).alias("b"), F.col(value).alias("xb"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    size = vectors.agg(F.sum(F.size(value) * 8 + 32)).first()[0] or 0
    pairs = a.crossJoin(F.broadcast(b) if size <= 32 << 20 else b)  # a small set by its meaning; beyond that the planner decides
    norm = F.sqrt(dot("xa", "xa")) * F.sqrt(dot("xb", "xb"))
    return pairs.select("a", "b", F.when(norm == 0, 0.0).otherwise(dot("xa", "xb") / norm).alias("similarity"))
