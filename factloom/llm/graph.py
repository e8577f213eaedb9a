"""Connected components of an edge table: the library's own, with the names the operators here use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is the smallest node reached.

    Null ends and loops are ignored; nodes without an edge don't appear; no edges give no rows.
    """
    e = edges.select(F.col(src).alias("source_id"), F.col(dst).alias("target_id"))
    return graph.components(e).withColumnRenamed("id", "node")
