"""Connected components of a distributed edge list.

Every node hooks to its least smaller neighbour, the resulting forest is
flattened by pointer jumping, and the edges are rewritten to the roots. Each
round at least halves the nodes that still have edges. The driver only asks
how many edges are left; as they only get fewer, a round's tables are written in
as many files as its edges need, not in one per shuffle partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_side, saved


#: Rows of a file.
ROWS_PER_FILE = 500_000


def _roots(of: DataFrame, column: str, parent: DataFrame, rows: int) -> DataFrame:
    """``column`` replaced by its root where it has one; ``parent`` has ``rows`` rows at most."""
    p = joined_side(parent.select(F.col("node").alias("__n"), F.col("root").alias("__r")), rows)
    return (of.join(p, of[column] == p["__n"], "left")
            .withColumn(column, F.coalesce("__r", column)).drop("__n", "__r"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that is not the smallest
    of its component; root is the smallest. Loops and repeats are harmless."""
    def clean(e: DataFrame) -> DataFrame:
        return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()

    out, e = None, saved(clean(edges), "edges")
    most = 0
    while n := e.count():
        files = math.ceil(n / ROWS_PER_FILE)
        most = max(most, files)
        parent = saved(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).coalesce(files), "parents")
        while True:
            up = joined_side(parent.select(F.col("node").alias("n2"), F.col("root").alias("r2")), n)
            flat = saved(parent.join(up, parent["root"] == up["n2"], "left").select(
                "node", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("moved")).coalesce(files), "parents")
            parent = flat.select("node", "root")
            if flat.filter("moved").isEmpty():
                break
        out = parent if out is None else saved(_roots(out, "root", parent, n).unionByName(parent).coalesce(most), "roots")
        e = saved(clean(_roots(_roots(e, "a", parent, n), "b", parent, n)).coalesce(files), "edges")
    return out if out is not None else e.select(F.col("b").alias("node"), F.col("a").alias("root"))
