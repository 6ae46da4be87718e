"""Queries that run the ready-made operators through pipelines and processing nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla import emg_queries, event_queries, feature_queries, model, presets, quality_queries, queries  # noqa: F401  (they register the SQL used below)
from oscilla import oracle_parts as parts
from oscilla.operators import filters
from oscilla.plans.pipeline import Op, Pipeline, ProcessingNode, standard_pipeline
from oscilla.queries import COLS, ORACLE_SQL, SIG, out, r6, register, signal

#: Name, operators, and the query whose SQL defines the result.
_SIGNAL = [
    ("energy", lambda: presets.energy(), "tkeo_classic"),
    ("energy_modified", lambda: presets.energy("modified"), "tkeo_modified"),
    ("zscore", lambda: presets.normalizer(), "zscore_global"),
    ("minmax", lambda: presets.normalizer("minmax", True), "minmax_by_channel"),
    ("robust", lambda: presets.normalizer("robust", True), "robust_scale"),
    ("mad", lambda: presets.normalizer("mad", True), "mad_scale"),
    ("moving_average", lambda: presets.moving_average(11), "moving_average"),
    ("moving_average_zero", lambda: presets.moving_average(15, edge="zero"), "moving_average_zero_padded"),
    ("moving_rms", lambda: presets.moving_rms(20, center=False), "moving_rms_causal"),
    ("moving_rms_zero", lambda: presets.moving_rms(15, edge="zero"), "moving_rms_zero_padded"),
    ("exponential_average", lambda: presets.exponential_average(0.1), "exponential_average"),
    ("median", lambda: presets.median(6), "median_filter"),
    ("sinc", lambda: presets.sinc(10.0, 100.0, 9), "sinc_filter"),
    ("comb_notch", lambda: presets.comb_notch(50.0, 1000.0, 0.9), "comb_notch"),
    ("bandpass", lambda: presets.bandpass(20.0, 200.0, 1000.0), "bandpass_filter"),
    ("rms_envelope", lambda: presets.rms_envelope(101), "rms_envelope"),
    ("hilbert_envelope", lambda: presets.hilbert_envelope(), "hilbert_envelope"),
]


def _of_signal(make):
    def run(spark, d):
        ops = make()
        return out(standard_pipeline(ops if isinstance(ops, list) else [ops]).process(signal(spark, d)))

    return run


for _name, _make, _base in _SIGNAL:
    register(f"preset_{_name}", ORACLE_SQL[_base])(_of_signal(_make))


def _filtered(before: str, sos) -> str:
    return f"WITH RECURSIVE {SIG}, {before}{parts.zero_phase('src', sos)} SELECT channel, i, round(value, 5) + 0.0 AS value FROM zp"


_PLAIN, _ABS = "src AS (SELECT channel, i, value FROM sig), ", "src AS (SELECT channel, i, abs(value) AS value FROM sig), "
_FILTERS = [
    ("lowpass", lambda: presets.lowpass(60.0, 1000.0), _filtered(_PLAIN, filters.design("butter", "lowpass", 60.0, 1000.0, 4))),
    ("highpass", lambda: presets.highpass(80.0, 1000.0, 3), _filtered(_PLAIN, filters.design("butter", "highpass", 80.0, 1000.0, 3))),
    ("notch", lambda: presets.notch(50.0, 1000.0, 5.0), _filtered(_PLAIN, filters.notch(50.0, 1000.0, 5.0))),
    ("chebyshev", lambda: presets.lowpass(100.0, 1000.0, 4, "cheby2"), _filtered(_PLAIN, filters.design("cheby2", "lowpass", 100.0, 1000.0, 4))),
    ("bessel", lambda: presets.lowpass(100.0, 1000.0, 3, "bessel"), _filtered(_PLAIN, filters.design("bessel", "lowpass", 100.0, 1000.0, 3))),
    ("smooth_envelope", lambda: presets.smooth_envelope(20.0, 1000.0), _filtered(_ABS, filters.design("butter", "lowpass", 20.0, 1000.0, 4))),
]


def _of_filter(make):
    def run(spark, d):
        ops = make()
        done = standard_pipeline(ops if isinstance(ops, list) else [ops]).process(signal(spark, d))
        return done.select("channel", "i", (F.round("value", 5) + F.lit(0.0)).alias("value"))

    return run


for _name, _make, _sql in _FILTERS:
    register(f"preset_{_name}", _sql)(_of_filter(_make))


@register("preset_energy_envelope", ORACLE_SQL["energy_envelope"])
def preset_energy_envelope(spark, d):
    done = Pipeline().add(presets.energy_envelope(20.0, 1000.0)).process(signal(spark, d))
    return done.select("channel", "i", (F.round("value", 2) + F.lit(0.0)).alias("value"))


@register("preset_rectifiers", f"WITH {SIG} SELECT channel, i, round(power(greatest(abs(value), 0), 2), 6) + 0.0 AS value FROM sig")
def preset_rectifiers(spark, d):
    return out(Pipeline().add([presets.rectifier("abs"), presets.rectifier("half"), presets.rectifier("square")]).process(signal(spark, d)))


@register("preset_peak_envelope", f"WITH {SIG} SELECT channel, i, round(abs(value), 6) + 0.0 AS value FROM sig")
def preset_peak_envelope(spark, d):
    return out(Pipeline().add(presets.peak_envelope()).process(signal(spark, d)))


@register(
    "preset_comb_enhance",
    f"WITH {SIG} SELECT a.channel, a.i, round(a.value + 0.5 * coalesce(b.value, 0), 6) + 0.0 AS value FROM sig a LEFT JOIN sig b ON b.channel = a.channel AND b.i = a.i - 20",
)
def preset_comb_enhance(spark, d):
    return out(Pipeline().add(presets.comb_enhance(50.0, 1000.0, 0.5)).process(signal(spark, d)))


@register("preset_common_average", ORACLE_SQL["common_average"])
def preset_common_average(spark, d):
    return standard_pipeline([presets.common_average(COLS)]).process(model.item_signal(spark, d)).select("i", *r6(*COLS))


@register("preset_common_median", ORACLE_SQL["common_median"])
def preset_common_median(spark, d):
    return standard_pipeline([presets.common_median(COLS)]).process(model.item_signal(spark, d)).select("i", *r6(*COLS))


@register("preset_changepoints", ORACLE_SQL["changepoints"])
def preset_changepoints(spark, d):
    op = presets.changepoint_detector("realtime", 1000.0, 150, hazard=0.05, threshold=0.2, distance=0.01, duration=0.012)
    return Pipeline().add(Op("scale", lambda x: x.withColumn("value", F.col("value") / 50))).add(op).process(signal(spark, d)).select("channel", "onset_idx", "offset_idx", *r6("probability"), "duration")


@register(
    "node_window",
    f"""WITH {SIG}, te AS (SELECT channel, i, value * value - lag(value) OVER w * lead(value) OVER w AS e FROM sig WINDOW w AS (PARTITION BY channel ORDER BY i)), tk AS (SELECT channel, i, coalesce(e, lead(e) OVER w, lag(e) OVER w) AS value FROM te WINDOW w AS (PARTITION BY channel ORDER BY i)),
ma AS (SELECT channel, i, avg(value) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS value FROM tk) SELECT channel, i, round(value, 6) + 0.0 AS value FROM ma WHERE i >= 30 AND i < 90""",
)
def node_window(spark, d):
    """A window of a processed signal, read with the neighbourhoods its operators declare."""
    node = ProcessingNode(signal(spark, d), 1000.0).add([presets.energy(), presets.moving_average(11)], "shape")
    return out(node.window(30, 90))


@register("node_process", f"WITH {SIG} SELECT channel, i, round(power(value - 20, 2), 6) + 0.0 AS value FROM sig")
def node_process(spark, d):
    """Two of a node's operators by their places; the one between them is left out."""
    shift = Op("shift", lambda x: x.withColumn("value", F.col("value") - 20))
    node = ProcessingNode(signal(spark, d), 1000.0).add(shift).add(presets.rectifier("half")).add(presets.rectifier("square"), "power")
    return out(node.process(ops=[0, 2]))
