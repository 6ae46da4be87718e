"""Pipelines: groups of operators folded over a signal, all of it one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Op:
    """A named transformation of a signal, with the neighbourhood it looks at on either side."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    halo: int = 0
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df)

    def describe(self) -> dict:
        return {"name": self.name, "halo": self.halo, **self.params}


class Pipeline:
    """Ordered groups of operators."""

    def __init__(self) -> None:
        self.groups: dict[str, list[Op]] = {}

    def add(self, op: Op | list[Op], group: str = "default", position: int | None = None) -> Pipeline:
        held = self.groups.setdefault(group, [])
        more = op if isinstance(op, list) else [op]
        at = len(held) if position is None else position
        held[at:at] = more
        return self

    def group(self, name: str) -> list[Op]:
        return list(self.groups.get(name, []))

    def clear(self, name: str | None = None) -> None:
        if name is None:
            self.groups.clear()
        else:
            self.groups.pop(name, None)

    def remove(self, group: str, index: int) -> Op | None:
        held = self.groups.get(group, [])
        return held.pop(index) if -len(held) <= index < len(held) else None

    def ops(self, groups: list[str] | None = None) -> list[Op]:
        for g in groups or ():
            if g not in self.groups:
                raise KeyError(f"unknown group {g!r}")
        return [op for g, held in self.groups.items() if groups is None or g in groups for op in held]

    def process(self, df: DataFrame, fs: float = 1.0, start: float | None = None, end: float | None = None, unit: str = "seconds", groups: list[str] | None = None) -> DataFrame:
        """The slice [start, end) through all operators in order."""
        df = time_slice(df, fs, start, end, unit)
        for op in self.ops(groups):
            df = df.transform(op.transform)
        return df


def time_slice(df: DataFrame, fs: float, start: float | None, end: float | None, unit: str = "seconds") -> DataFrame:
    """Rows of the half-open range, as a predicate on the sample number that reaches the scan."""
    if unit not in ("seconds", "samples"):
        raise ValueError("unit is seconds or samples")
    scale = fs if unit == "seconds" else 1
    lo, hi = (None if x is None else int(x * scale) for x in (start, end))
    if (lo is not None and lo < 0) or (lo is not None and hi is not None and hi <= lo):
        raise ValueError("start must not be negative and must lie before end")
    if lo:
        df = df.where(F.col("i") >= lo)
    return df if hi is None else df.where(F.col("i") < hi)


class ProcessingNode:
    """A source bound to a pipeline, with a history of what was applied."""

    def __init__(self, source: DataFrame, fs: float, name: str = "node"):
        self.source, self.fs, self.name = source, fs, name
        self.pipeline = Pipeline()
        self.active = True
        self.history: list[tuple[datetime, str]] = []

    def _note(self, what: str) -> None:
        self.history.insert(0, (datetime.now(), what))

    def add(self, op: Op | list[Op], group: str = "default", position: int | None = None) -> ProcessingNode:
        self.pipeline.add(op, group, position)
        self._note(f"add {group}: " + ", ".join(o.name for o in (op if isinstance(op, list) else [op])))
        return self

    def remove(self, group: str, index: int) -> Op | None:
        gone = self.pipeline.remove(group, index)
        if gone:
            self._note(f"remove {group}: {gone.name}")
        return gone

    def process(self, groups: list[str] | None = None, ops: list[int] | None = None, persist: bool = False, return_info: bool = False):
        """Run groups, or single operators by their place; optionally keep intermediate results."""
        if not self.active:
            return (self.source, []) if return_info else self.source
        chosen = self.pipeline.ops(groups)
        chosen = chosen if ops is None else [chosen[k] for k in ops]
        df = self.source
        for op in chosen:
            df = df.transform(op.transform)
            df = df.persist() if persist else df
        self._note("process " + ", ".join(o.name for o in chosen))
        return (df, [o.describe() for o in chosen]) if return_info else df

    def window(self, start: int, end: int, groups: list[str] | None = None) -> DataFrame:
        """Samples start..end - 1 as the whole signal would give them, reading only these and the operators' neighbourhoods on either side.

        For operators that declare how far they look; statistics over a whole signal are not of that kind.
        """
        chosen = self.pipeline.ops(groups)
        reach = sum(op.halo for op in chosen)
        df = time_slice(self.source, 1, max(0, start - reach), end + reach, "samples")
        for op in chosen:
            df = df.transform(op.transform)
        return time_slice(df, 1, start, end, "samples")

    def describe(self) -> list[dict]:
        return [{"group": g, "position": k, **op.describe()} for g, held in self.pipeline.groups.items() for k, op in enumerate(held)]


def standard_pipeline(ops: list[Op], group: str = "default") -> Pipeline:
    return Pipeline().add(list(ops), group)
