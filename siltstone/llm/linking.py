"""From links between classes of equal items to one row per item."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import components, labels
from siltstone.llm.frames import few_files, salted_join

#: What a unit of comparison returns: (a, n, null) for n items linked with class a, (a, null, b) for an edge.
UNIT_SCHEMA = "a long, n long, b long"


def unit_rows(ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, pairs: bool = False) -> pa.Table:
    """The rows of a unit whose classes ``ids`` are linked at the positions x[i], y[i].

    The links themselves aren't returned (unless ``pairs``): their sums and a star per component are as many rows as classes.
    """
    none = lambda k: pa.array([None] * k, pa.int64())
    if pairs:
        a, b = ids[x], ids[y]
        return pa.table([pa.array(np.minimum(a, b)), none(len(a)), pa.array(np.maximum(a, b))], names=["a", "n", "b"])
    n = np.bincount(x, sizes[y], len(ids)) + np.bincount(y, sizes[x], len(ids))
    root = labels(x, y, len(ids))
    has, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(ids)))
    return pa.table(
        [
            pa.array(np.concatenate([ids[has], ids[moved]])),
            pa.chunked_array([pa.array(n[has].astype(np.int64)), none(len(moved))]),
            pa.chunked_array([none(len(has)), pa.array(ids[root[moved]])]),
        ],
        names=["a", "n", "b"],
    ).combine_chunks()


def resolve(items: DataFrame, key: str, members: DataFrame, classes: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """One row per item: key, ``n_links``, ``component_id`` and ``kept``.

    members: ``id`` and ``digest`` of the items that can link; classes: ``digest``, ``rep`` (the least key), ``node`` and ``size``; found: the
    units' rows, which call classes by their node. Nodes are 64-bit hashes of digests.
    """
    degree = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"), f"{folder}/components")
    # Components are known by a node; the least key of their classes names them.
    linked = classes.select("node", "rep").join(roots, "node").select("node", "rep", F.col("root").alias("top"))
    least = linked.groupBy("top").agg(F.min("rep").alias("root"))
    linked = salted_join(linked, least, ["top"], "node").select("node", "root").distinct()
    told = classes.select("digest", "node", "rep", "size").join(degree, "node", "left").join(linked, "node", "left")
    told = told.select("digest", "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("links"), F.coalesce("root", "rep").alias("root"))
    known = salted_join(members, told, ["digest"], "id").select("id", "links", "root", "rep")
    # Rows that share a key may belong to different classes: the most links and the least root hold.
    known = known.groupBy("id").agg(F.max("links").alias("links"), F.min("root").alias("root"), F.min("rep").alias("rep"))
    out = items.join(known, "id", "left")
    component = F.coalesce("root", "id")
    out = out.select(
        F.col("id").alias(key),
        F.coalesce("rep", "id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
    return few_files(out)
