"""The data model: long and wide signals, spikes, events, and their metadata.

A signal is a DataFrame with ``channel``, ``i`` (the sample's number) and ``value``, optionally more
key columns such as ``recording``.  Order is carried by ``i`` alone.  Spikes are ``unit_id`` and
``sample``; point events ``channel``, ``i``, ``amplitude``; interval events ``channel``,
``onset_idx``, ``offset_idx``, ``amplitude``, ``duration``.  Undefined results are null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.functions.windows import number_rows

SIX_HOURS = 6 * 3600 * 1_000_000


@dataclass
class SignalMeta:
    """Side-car of a stored stream."""

    name: str = "stream"
    fs: float = 1.0
    number_of_samples: int = 0
    channel_names: list[str] = field(default_factory=list)
    channel_types: list[str] = field(default_factory=list)
    source: str = ""
    other: dict = field(default_factory=dict)

    @property
    def duration(self) -> float | None:
        return self.number_of_samples / self.fs if self.fs else None

    def to_json(self) -> str:
        n = len(self.channel_names)
        base = {
            "name": self.name,
            "fs": self.fs,
            "number_of_samples": self.number_of_samples,
            "data_shape": [n, self.number_of_samples],
            "channel_numbers": n,
            "channel_names": self.channel_names,
            "channel_types": self.channel_types,
        }
        return json.dumps({"source": self.source, "base": base, "other": self.other}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> SignalMeta:
        d = json.loads(text)
        b = d.get("base", {})
        return cls(
            b.get("name", "stream"), float(b.get("fs", 1.0)), int(b.get("number_of_samples", 0)), list(b.get("channel_names", [])), list(b.get("channel_types", [])), d.get("source", ""), d.get("other", {})
        )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(col: str):
    """Microseconds of a timestamp of either kind."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a signal: a channel for each event type, samples in order of time."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "ts", "event_id", "value")
    return number_rows(rows, F.floor(micros("ts") / SIX_HOURS), ["ts", "event_id"], ("channel",)).select("channel", "i", "value")


def item_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a wide signal of four channels, numbered in one global order of its rows."""
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    rows = read(spark, sf_dir, "lineitem").select(*order, "l_quantity", "l_discount", "l_tax")
    return number_rows(rows, F.floor(F.col("l_orderkey") / 1024), order).select(
        "i", F.col("l_quantity").alias("c0"), F.col("l_extendedprice").alias("c1"), F.col("l_discount").alias("c2"), F.col("l_tax").alias("c3")
    )


def event_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as spikes: a unit for each user, microseconds since 2024-01-01."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), (micros("ts") - F.lit(1704067200000000)).alias("sample"), "value", "event_type", "event_id")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as stimulus events."""
    return read(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", (micros("ts") - F.lit(1704067200000000)).alias("sample"))


def wide_to_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, c0..cN) to (channel, i, value): each row explodes in place, nothing is shuffled."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns))))
    return df.select("i", pairs.alias("p")).select(F.col("p.channel").alias("channel"), "i", F.col("p.value").alias("value"))


def long_to_wide(df: DataFrame, channels: list, prefix: str = "c") -> DataFrame:
    """(channel, i, value) to one row for each sample, for the named channels."""
    return df.groupBy("i").agg(*(F.max(F.when(F.col("channel") == F.lit(c), F.col("value"))).alias(f"{prefix}{k}") for k, c in enumerate(channels)))
