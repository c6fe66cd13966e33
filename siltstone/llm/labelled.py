"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.frames import named


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, n: int, held_out: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows (text ``t``, label ``y``) outside the held-out fold; all if there are fewer.

    Which ones: those whose hashed key comes first, so the choice depends neither on order nor on
    partitions. Rows with a null key, text or label aren't used; a key labelled twice gives two rows.
    """
    own = labels.select(named(key).alias("k"), named(label).cast("double").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    own = own.where(fold(F.col("k"), n) != held_out)
    picked = own.orderBy(F.xxhash64(F.col("k").cast("string")), "k", "y").limit(max_rows)
    texts = docs.select(named(key).alias("k"), named(text).cast("string").alias("t")).where("t IS NOT NULL")
    # The picked keys and labels are at most max_rows small rows: a proven bound for the broadcast.
    return texts.join(F.broadcast(picked), "k").select("k", "t", "y")


#: Bytes of features to learn from, besides the bound on rows: texts may be of any length.
TRAIN_BYTES = 128 << 20


def within(made: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows of a sample whose ``size`` (bytes of features) add up to ``most`` at most, taken whole in the order of hashed keys ``k``.

    A key whose rows alone are more isn't learnt from. ``made`` is read twice: give a written table. At most one
    narrow row per sampled key comes to the driver.
    """
    h = F.xxhash64(F.col("k").cast("string"))
    sizes = made.select(h.alias("h"), size.alias("n")).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") <= most).toArrow()
    hashes, n = np.asarray(sizes["h"], np.int64), np.asarray(sizes["n"], np.int64)
    order = np.argsort(hashes)
    taken = hashes[order][np.cumsum(n[order]) <= most]
    told = made.sparkSession.createDataFrame(pa.table({"h": taken}))
    return made.withColumn("h", h).join(F.broadcast(told), "h").drop("h")


def collected(df: DataFrame, bag: str, dtype: type, width: int) -> tuple[pa.Table, list[np.ndarray]]:
    """A bounded frame on the driver, ordered by key ``k`` and label ``y``, and its lists ``bag`` as arrays of ``width`` columns.

    Arrow buffers are used as they come: no Python object per number.
    """
    table = df.toArrow()
    table = table.take(pc.sort_indices(table.select(["k", "y"]), sort_keys=[("k", "ascending"), ("y", "ascending")]))
    bags = []
    for chunk in table.column(bag).chunks:
        at, values = np.asarray(chunk.offsets), np.asarray(chunk.values)
        bags += [values[a:z].astype(dtype, copy=False).reshape(-1, width) for a, z in zip(at[:-1], at[1:], strict=True)]
    return table.drop_columns([bag]), bags
