"""Connected components of links, by alternating large-star and small-star steps.

Every step maps edges to edges by a grouped minimum and a salted join, so hubs are summed up before the
exchange, their edges are spread over tasks, and no neighbourhood or component is collected. Edges are written in the shared folder between
rounds; the driver only sees their number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.frames import discard, salted_join, saved, shared_dir

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted_join(both.where("v > u"), least, ["u"], "v").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = salted_join(edges, least, ["b"], "a")
    return linked.select(F.col("m").alias("a"), F.col("b")).unionByName(linked.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """``node`` and ``root``, the least node it is linked with, for every node of ``edges`` (long columns a and b).

    Loops, repeated edges and edges in either direction are allowed; null ends are left out. A node without
    an edge to another isn't listed. No edges give no rows.
    """
    folder = folder or shared_dir(edges.sparkSession)
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = saved(now, "round0", folder)
    seen = None
    for i in range(1, MAX_ROUNDS + 1):
        now = saved(_small_star(_large_star(now)), f"round{i}", folder)
        # A star forest stays as it is; the sums tell whether anything changed.
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges.sparkSession, f"{folder}/round{i - 1}")
        if tuple(mark) == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        seen = tuple(mark)
    raise RuntimeError(f"links haven't come to rest after {MAX_ROUNDS} rounds")


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the least node of their component under the links a[i]-b[i]."""
    out = np.arange(n)
    while True:
        least = np.minimum(out[a], out[b])
        new = out.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if np.array_equal(new, out):
            return out
        out = new
