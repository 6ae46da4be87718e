"""Detectors: thresholds, peaks, contractions, threshold crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscilla.functions.quantiles import quantiles
from oscilla.functions.windows import KEYS, over_neighbours, refractory, running, runs


def thresholds(df: DataFrame, value: float, mode: str = "mad", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per channel: lower and upper threshold."""
    x = F.col("value")
    if mode == "absolute":
        got = df.groupBy(*keys).agg(F.lit(-value).alias("lower"), F.lit(value).alias("upper"))
    elif mode == "std":
        got = df.groupBy(*keys).agg((F.avg(x) - value * F.stddev_pop(x)).alias("lower"), (F.avg(x) + value * F.stddev_pop(x)).alias("upper"))
    elif mode == "rms":
        got = df.groupBy(*keys).agg((-value * F.sqrt(F.avg(x * x))).alias("lower"), (value * F.sqrt(F.avg(x * x))).alias("upper"))
    elif mode == "mad":
        mid = quantiles(df, x, [0.5], keys).withColumnRenamed("q0", "_mid")
        dev = quantiles(df.join(mid, list(keys)), F.abs(x - F.col("_mid")), [0.5], keys).join(mid, list(keys)).withColumn("_d", F.col("q0") / 0.67449 * value)
        got = dev.select(*keys, (F.col("_mid") - F.col("_d")).alias("lower"), (F.col("_mid") + F.col("_d")).alias("upper"))
    else:
        raise ValueError(f"unknown threshold mode {mode!r}")
    return got


def peaks(df: DataFrame, limits: DataFrame | None = None, distance: int = 1, polarity: str = "negative", fs: float | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Strict local extrema beyond a threshold, thinned greedily: channel, index, amplitude (and time_sec)."""
    limits = thresholds(df, 4.0, "mad", keys) if limits is None else limits

    def add(d: DataFrame, w) -> DataFrame:
        return d.withColumn("_a", F.lag("value").over(w)).withColumn("_b", F.lead("value").over(w))

    x = F.col("value")
    high = (x > F.col("_a")) & (x > F.col("_b"))
    low = (x < F.col("_a")) & (x < F.col("_b"))
    near = over_neighbours(df, 1, 1, add, keys).where(high | low).join(limits, list(keys))
    want: Column = F.lit(False)
    if polarity in ("positive", "both"):
        want = want | (high & (x > F.col("upper")))
    if polarity in ("negative", "both"):
        want = want | (low & (x < F.col("lower")))
    out = refractory(near.where(want).select(*keys, "i", F.col("value").alias("amplitude")), distance, keys).withColumnRenamed("i", "index")
    return out if fs is None else out.withColumn("time_sec", F.col("index") / fs)


def _limit(method: str, value: float) -> Column:
    x = F.col("value")
    how = {"std": F.avg(x) + value * F.stddev_pop(x), "rms": value * F.sqrt(F.avg(x * x)), "percent_max": value * F.max(x) / 100, "absolute": F.max(F.lit(float(value)))}
    if method not in how:
        raise ValueError(f"unknown threshold method {method!r}")
    return how[method]


def contraction_threshold(df: DataFrame, method: str = "std", value: float = 3.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per channel: mean + value std, value rms, value percent of the maximum, or the value itself."""
    return df.groupBy(*keys).agg(_limit(method, value).alias("threshold"))


def contractions(df: DataFrame, method: str = "std", value: float = 3.0, min_samples: int = 1, refractory_samples: int = 0, fs: float = 1.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs above a threshold as events: onset_idx, offset_idx, amplitude (peak in [onset, offset)), duration in seconds.

    The refractory scan thins onsets and offsets apart; each onset then takes the first offset
    after it, and short events are dropped.  A run that is still open ends at the last sample.
    """
    # one pass for threshold and length, one for the runs, one for the peaks
    stats = df.groupBy(*keys).agg(_limit(method, value).alias("threshold"), (F.max("i") + 1).alias("n"))
    spans = runs(df.join(stats, list(keys)), F.col("value") > F.col("threshold"), keys).join(stats.select(*keys, "n"), list(keys))
    marks = F.explode(F.array(F.struct(F.lit(1).alias("_is_on"), F.col("first").alias("i")), F.struct(F.lit(0).alias("_is_on"), F.least(F.col("last") + 1, F.col("n") - 1).alias("i"))))
    both = spans.select(*keys, marks.alias("_m")).select(*keys, "_m._is_on", "_m.i").distinct()
    both = refractory(both, refractory_samples, (*keys, "_is_on"))
    # the first offset after each onset
    nxt = running(both, "i", F.when(F.col("_is_on") == 0, F.col("i")), "offset_idx", keys, backwards=True).where("_is_on = 1 AND offset_idx > i").drop("_is_on")
    events = nxt.withColumnRenamed("i", "onset_idx").where(F.col("offset_idx") - F.col("onset_idx") >= min_samples)
    return peak_in(df, events, keys).withColumn("duration", (F.col("offset_idx") - F.col("onset_idx")) / fs)


def samples_of(df: DataFrame, events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of [onset_idx, offset_idx) of each event: events list their samples, then an equi-join."""
    listed = events.where("offset_idx > onset_idx").withColumn("i", F.explode(F.sequence(F.col("onset_idx"), F.col("offset_idx") - 1)))
    return listed.join(df, [*keys, "i"])


def peak_in(df: DataFrame, events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return samples_of(df, events, keys).groupBy(*events.columns).agg(F.max("value").alias("amplitude"))


def confirmed_contractions(df: DataFrame, primary: float, secondary: float, points: int = 3, **options) -> DataFrame:
    """Contractions by the primary threshold in which at least ``points`` samples in a row exceed the secondary one."""
    events = contractions(df, "absolute", primary, **options)
    keys = options.get("keys", KEYS)
    inside = samples_of(df, events, keys)
    w = Window.partitionBy(*keys, "onset_idx").orderBy("i")
    hot = inside.where(F.col("value") > secondary).withColumn("_g", F.col("i") - F.row_number().over(w))
    longest = hot.groupBy(*keys, "onset_idx", "_g").agg(F.count("*").alias("_n")).groupBy(*keys, "onset_idx").agg(F.max("_n").alias("_n"))
    return events.join(longest.where(F.col("_n") >= points).drop("_n"), [*keys, "onset_idx"], "left_semi")


def crossings(df: DataFrame, threshold: float, sign: str = "neg", dead_time: int = 30, units: int | None = None) -> DataFrame:
    """Spikes where a channel passes the threshold, thinned by the dead time: unit_id, sample."""
    x = F.col("value")
    beyond = {"neg": x < -abs(threshold), "pos": x > abs(threshold), "both": F.abs(x) > abs(threshold)}[sign]
    found = runs(df, beyond).select("channel", F.col("first").alias("i"))
    out = refractory(found, dead_time)
    unit = F.col("channel") if units is None else F.pmod(F.col("channel"), F.lit(units))
    return out.select(unit.alias("unit_id"), F.col("i").alias("sample"))
