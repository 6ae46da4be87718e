"""Bounded, reproducible samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes at most; their counts (some dozens of bytes each) are broadcast.
CLASSES = 100_000


def place(*keys: str) -> Column:
    """A row's place in [0, 1), by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(77)), F.lit(1 << 30)).cast("double") / float(1 << 30)


def bounded_sample(rows: DataFrame, by: str, keys: list[str], per_class: int) -> DataFrame:
    """About ``per_class`` distinct rows (by ``keys``, which may be null) of each value of ``by`` at most.

    Rows are chosen by a hash of ``keys``, so equal rows all enter or none does: whoever gathers the
    sample drops repeats first.  Distinct rows per class are a map-side-combined sketch; the rate that
    it gives is then a plain filter, so no class is gathered or sorted anywhere.  Null classes are
    left out.
    """
    rows = rows.where(F.col(by).isNotNull())
    n = rows.groupBy(F.col(by).alias("_class")).agg(F.approx_count_distinct(F.xxhash64(*keys), 0.02).alias("_n"))
    found = n.limit(CLASSES + 1).count()
    if found > CLASSES:
        raise ValueError(f"more than {CLASSES} values of {by}")
    joined = rows.join(F.broadcast(n), F.col(by) == F.col("_class"))  # a checked number of rows
    return joined.where(place(*keys) * F.col("_n") < per_class).drop("_class", "_n")
