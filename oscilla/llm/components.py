"""Connected components of an edge table, distributed: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.functions.components import settled_labels
from oscilla.llm import common


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge: comp is the least node reachable, however long the way.

    All steps are hash joins and map-side-combined minima; a hub with many edges is one side of a
    join that Spark may split.  Rounds are written to the shared folder.  No edges: no rows.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = common.materialize(both.union(both.select("y", "x")).distinct(), "edges")
    out = settled_labels(both, lambda df: common.materialize(df, "labels"), common.forget)
    common.forget(both)
    return out
