"""Rectification, normalisation and spatial references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscilla.functions.quantiles import quantiles

KEYS = ("channel",)


def rectify(df: DataFrame, method: str = "abs") -> DataFrame:
    x = F.col("value")
    how = {"abs": F.abs(x), "square": x * x, "half": F.greatest(F.lit(0.0), x)}
    if method not in how:
        raise ValueError(f"unknown rectification {method!r}")
    return df.withColumn("value", how[method])


def _joined(df: DataFrame, stats: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    # one row for each channel (or one in all): a table whose size the planner knows, broadcast below its threshold
    return df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))


def statistics(df: DataFrame, method: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """centre and scale of a method, over everything or for each of ``keys``."""
    x = F.col("value")
    group = lambda d: d.groupBy(*keys) if keys else d.groupBy()
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    if method == "zscore":
        return group(df).agg(F.avg(x).alias("centre"), one(F.stddev_pop(x)).alias("scale"))
    if method == "minmax":
        return group(df).agg(F.min(x).alias("centre"), one(F.max(x) - F.min(x)).alias("scale"))
    if method == "robust":
        q = quantiles(df, x, [0.25, 0.5, 0.75], keys)
        return q.select(*keys, F.col("q1").alias("centre"), one(F.col("q2") - F.col("q0")).alias("scale"))
    if method == "mad":
        mid = quantiles(df, x, [0.5], keys).withColumnRenamed("q0", "centre")
        dev = quantiles(_joined(df, mid, keys), F.abs(x - F.col("centre")), [0.5], keys)
        return _joined(mid, dev, keys).select(*keys, "centre", one(F.col("q0") * 1.4826).alias("scale"))
    raise ValueError(f"unknown normalisation {method!r}")


def normalize(df: DataFrame, method: str = "zscore", keys: tuple[str, ...] = (), stats: DataFrame | None = None) -> DataFrame:
    """(value - centre) / scale; a scale of zero counts as one.  ``stats`` may be supplied ready-made."""
    got = stats if stats is not None else statistics(df, method, keys)
    return _joined(df, got, keys).withColumn("value", (F.col("value") - F.col("centre")) / F.col("scale")).drop("centre", "scale")


def normalize_for_view(df: DataFrame, method: str = "zscore", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As :func:`normalize`, but constant channels become zeros."""
    x = F.col("value")
    a, b = {"zscore": (F.avg(x), F.stddev_pop(x)), "minmax": (F.min(x), F.max(x) - F.min(x))}[method]
    got = df.groupBy(*keys).agg(a.alias("centre"), b.alias("scale"))
    return _joined(df, got, keys).withColumn("value", F.when(F.col("scale") == 0, 0.0).otherwise((x - F.col("centre")) / F.col("scale"))).drop("centre", "scale")


def median_of(*cols: Column) -> Column:
    """Median of some columns of one row, even counts averaged."""
    s, n = F.array_sort(F.array(*cols)), len(cols)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def common_reference(df: DataFrame, columns: list[str], operator: str = "median", reference: list[str] | None = None, groups: list[list[str]] | None = None, outside: str = "zero") -> DataFrame:
    """Per sample of a wide signal: subtract the mean or median of all, some, or each group's channels.

    Channels outside every group become 0 (``outside="zero"``) or stay (``"keep"``).
    """
    if operator not in ("mean", "average", "median"):
        raise ValueError("operator is median or average")

    def shift(names: list[str]) -> Column:
        cols = [F.col(c) for c in names]
        return median_of(*cols) if operator == "median" else sum(cols[1:], cols[0]) / len(cols)

    if groups:
        ref = {c: shift(g) for g in groups for c in g}
        new = {c: F.col(c) - ref[c] if c in ref else F.lit(0.0) if outside == "zero" else F.col(c) for c in columns}
    else:
        new = {c: F.col(c) - shift(reference or columns) for c in columns}
    return df.select(*(c for c in df.columns if c not in new), *(v.alias(c) for c, v in new.items()))


def reference_series(df: DataFrame, columns: list[str], operator: str = "median") -> DataFrame:
    """The shift that :func:`common_reference` subtracts."""
    cols = [F.col(c) for c in columns]
    return df.select("i", (median_of(*cols) if operator == "median" else sum(cols[1:], cols[0]) / len(cols)).alias("value"))


def common_reference_long(df: DataFrame, operator: str = "mean") -> DataFrame:
    """The same on a long signal, for many channels: one aggregate for each sample."""
    x = F.col("value")
    ref = df.groupBy("i").agg((F.percentile(x, F.lit(0.5)) if operator == "median" else F.avg(x)).alias("_ref"))
    return df.join(ref, "i").withColumn("value", x - F.col("_ref")).drop("_ref")


def noise_level(df: DataFrame, method: str = "mad", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per channel: standard deviation, or median absolute deviation over 0.67449."""
    x = F.col("value")
    if method == "std":
        return df.groupBy(*keys).agg(F.stddev_pop(x).alias("noise"))
    mid = quantiles(df, x, [0.5], keys).withColumnRenamed("q0", "_mid")
    return quantiles(df.join(mid, list(keys)), F.abs(x - F.col("_mid")), [0.5], keys).select(*keys, (F.col("q0") / 0.67449).alias("noise"))
