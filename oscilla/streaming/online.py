"""Streams: event-time rates, and stateful operators whose state is small and bounded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rates(stream: DataFrame, key: str = "unit_id", at: str = "ts", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Spikes of each unit in tumbling windows; events later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("count")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def _kind(stream: DataFrame, column: str) -> str:
    return dict(stream.dtypes)[column]


def exponential(stream: DataFrame, alpha: float) -> DataFrame:
    """The exponential average of each channel, carried on from batch to batch (samples must arrive in order)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("i")
        y = state.get[0] if state.exists else None
        out = []
        for x in rows["value"]:
            y = x if y is None else alpha * x + (1 - alpha) * y
            out.append(y)
        state.update((float(y),))
        yield rows[["channel", "i"]].assign(value=out)

    schema = f"channel {_kind(stream, 'channel')}, i long, value double"
    return stream.select("channel", "i", "value").groupBy("channel").applyInPandasWithState(run, schema, "y double", "append", GroupStateTimeout.NoTimeout)


def crossings(stream: DataFrame, threshold: float, dead_time: int) -> DataFrame:
    """Samples where a channel rises above the threshold, thinned by the dead time; the state is the last sample and the last kept crossing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("i")
        was, last = state.get if state.exists else (False, -(1 << 60))
        keep = []
        for i, x in zip(rows["i"], rows["value"], strict=True):
            on = bool(x > threshold)
            if on and not was and i - last >= dead_time:
                keep.append(int(i))
                last = int(i)
            was = on
        state.update((was, last))
        yield pd.DataFrame({"channel": [key[0]] * len(keep), "i": keep})

    schema = f"channel {_kind(stream, 'channel')}, i long"
    return stream.select("channel", "i", "value").groupBy("channel").applyInPandasWithState(run, schema, "was boolean, last long", "append", GroupStateTimeout.NoTimeout)
