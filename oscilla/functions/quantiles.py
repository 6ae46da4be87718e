"""Exact quantiles without gathering a group's distinct values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half width, as a share of the rows, of the band of values around a quantile that is counted exactly, and the accuracy of the sketch that gives the band.
BAND, ACCURACY = 0.005, 10_000
#: Groups with fewer rows are counted as a whole.
SMALL = 2000


def quantiles(df: DataFrame, value: Column, shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and q0, q1, .. : quantiles of ``value`` (nulls left out) with linear interpolation, as ``percentile`` gives them.

    A sketch finds a band of values that surely holds each quantile; one pass counts what lies below
    it and the distinct values inside, a hundredth of all, which alone are ordered.
    """
    rows = df.select(*keys, value.cast("double").alias("_x")).where("_x IS NOT NULL")
    at = [p for q in shares for p in (max(0.0, q - BAND), min(1.0, q + BAND))]
    edge = (rows.groupBy(*keys) if keys else rows.groupBy()).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.percentile_approx("_x", F.array(*map(F.lit, at)), ACCURACY).alias("_e"))
    few = F.col("_n") < SMALL
    bands = F.array(*(
        F.struct(F.lit(k).alias("q"), F.lit(q).alias("share"), F.when(few, F.col("_lo")).otherwise(F.col("_e")[2 * k]).alias("lo"), F.when(few, F.col("_hi")).otherwise(F.col("_e")[2 * k + 1]).alias("hi"))
        for k, q in enumerate(shares)
    ))
    edge = edge.select(*keys, "_n", bands.alias("_bands"))
    # one row for each group: the planner broadcasts it below its threshold
    both = rows.join(edge, list(keys)) if keys else rows.crossJoin(F.broadcast(edge))
    each = both.select(*keys, "_n", "_x", F.explode("_bands").alias("_b")).where(F.col("_x") <= F.col("_b.hi"))
    inside = F.when(F.col("_x") >= F.col("_b.lo"), F.col("_x")).alias("_v")  # null: below the band
    counts = each.groupBy(*keys, "_n", F.col("_b.q").alias("_q"), F.col("_b.share").alias("_s"), inside).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys, "_q").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("_s") * (F.col("_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    run = counts.withColumn("_upto", F.sum("_c").over(w)).where("_v IS NOT NULL")
    holds = lambda k: (F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k)
    got = run.groupBy(*keys, "_q", "_n", "_s").agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"))
    exact = F.when(low == high, F.col("_a")).otherwise((high - place) * F.col("_a") + (place - low) * F.col("_b"))
    out = got.withColumn("_r", exact)
    return (out.groupBy(*keys) if keys else out.groupBy()).agg(*(F.max(F.when(F.col("_q") == k, F.col("_r"))).alias(f"q{k}") for k in range(len(shares))))
