"""Ready-made operators for pipelines: each returns an Op that declares its neighbourhood."""

from __future__ import annotations

from collections.abc import Callable

from oscilla.operators import filters, harmonics, kernels, neighbourhood, pointwise
from oscilla.plans.pipeline import Op


def energy(method: str = "classic") -> Op:
    return Op("energy", lambda d: neighbourhood.tkeo(d, method), 3 if method == "classic" else 4, {"method": method})


def rectifier(method: str = "abs") -> Op:
    return Op("rectifier", lambda d: pointwise.rectify(d, method), 0, {"method": method})


def normalizer(method: str = "zscore", by_channel: bool = False) -> Op:
    return Op("normalizer", lambda d: pointwise.normalize(d, method, ("channel",) if by_channel else ()), 0, {"method": method})


def moving_average(window: int, weights: list[float] | None = None, edge: str = "truncate") -> Op:
    run: Callable = (lambda d: neighbourhood.convolve(d, weights, align="edge")) if weights else (lambda d: neighbourhood.moving(d, window, edge=edge))
    return Op("moving average", run, window // 2, {"window": window})


def moving_rms(window: int, center: bool = True, edge: str = "truncate") -> Op:
    return Op("moving rms", lambda d: neighbourhood.moving(d, window, "rms", center, edge), window, {"window": window})


def exponential_average(alpha: float) -> Op:
    return Op("exponential average", lambda d: neighbourhood.exponential(d, alpha), 0, {"alpha": alpha})


def median(window: int) -> Op:
    size = window + 1 - window % 2  # even sizes act as the next odd one
    return Op("median", lambda d: neighbourhood.moving(d, size, "median"), size // 2, {"window": size})


def sinc(cutoff: float, fs: float, size: int = 31, shape: str = "hamming") -> Op:
    return Op("sinc", lambda d: neighbourhood.sinc_filter(d, cutoff, fs, size, shape), size // 2, {"cutoff": cutoff})


def comb_notch(frequency: float, fs: float, strength: float = 1.0) -> Op:
    return Op("comb notch", lambda d: neighbourhood.comb_notch(d, frequency, fs, strength), round(fs / frequency), {"frequency": frequency})


def comb_enhance(frequency: float, fs: float, strength: float = 1.0) -> Op:
    return Op("comb enhance", lambda d: neighbourhood.comb_enhance(d, frequency, fs, strength), round(fs / frequency), {"frequency": frequency})


def _filter(name: str, sos, zero_phase: bool = True) -> Op:
    return Op(name, lambda d: filters.apply(d, sos, zero_phase), len(filters.impulse(sos)), {"sections": len(sos)})


def lowpass(cutoff: float, fs: float, order: int = 4, family: str = "butter") -> Op:
    return _filter("lowpass", filters.design(family, "lowpass", cutoff, fs, order))


def highpass(cutoff: float, fs: float, order: int = 4, family: str = "butter") -> Op:
    return _filter("highpass", filters.design(family, "highpass", cutoff, fs, order))


def bandpass(low: float, high: float, fs: float, order: int = 4, family: str = "butter") -> Op:
    return _filter("bandpass", filters.design(family, "bandpass", (low, high), fs, order))


def notch(frequency: float, fs: float, q: float = 30.0) -> Op:
    return _filter("notch", filters.notch(frequency, fs, q))


def powerline(fs: float, frequency: float = 50.0) -> Op:
    return Op("powerline", lambda d: harmonics.remove_harmonics(d, fs, frequency), 0, {"frequency": frequency})


def common_average(columns: list[str], **options) -> Op:
    return Op("common average", lambda d: pointwise.common_reference(d, columns, "average", **options), 0)


def common_median(columns: list[str], **options) -> Op:
    return Op("common median", lambda d: pointwise.common_reference(d, columns, "median", **options), 0)


def smooth_envelope(cutoff: float, fs: float, method: str = "abs") -> list[Op]:
    return [rectifier(method), lowpass(cutoff, fs)]


def energy_envelope(cutoff: float, fs: float, method: str = "classic") -> list[Op]:
    return [energy(method), rectifier("abs"), lowpass(cutoff, fs)]


def hilbert_envelope(cutoff: float | None = None, fs: float = 1.0) -> list[Op]:
    return [Op("hilbert", kernels.hilbert_envelope)] + ([lowpass(cutoff, fs)] if cutoff else [])


def rms_envelope(window: int = 101) -> list[Op]:
    return [moving_rms(window)]


def peak_envelope() -> list[Op]:
    """Under the compatible definition the magnitude alone."""
    return [rectifier("abs")]


#: Fixed values of the changepoint detectors: hazard, threshold, fitted variance, least distance and least duration in seconds.
CHANGEPOINTS = {
    "sensitive": {"hazard": 0.005, "threshold": 0.2, "variance": True, "distance": 0.1, "duration": 0.01},
    "robust": {"hazard": 0.02, "threshold": 0.4, "variance": True, "distance": 0.2, "duration": 0.03},
    "realtime": {"hazard": 0.01, "threshold": 0.3, "variance": False, "distance": 0.1, "duration": 0.02},
}


def changepoint_detector(kind: str, fs: float, longest: int | None = None, **changed: float) -> Op:
    """An operator that gives events instead of samples; the last of its pipeline."""
    p = CHANGEPOINTS[kind] | changed
    run: Callable = lambda d: kernels.changepoints(d, p["hazard"], p["threshold"], int(p["distance"] * fs), bool(p["variance"]), fs, int(p["duration"] * fs), longest)
    return Op(f"{kind} changepoints", run, 0, dict(p))
