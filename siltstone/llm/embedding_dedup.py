"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Two vectors collide on a random line if the projection of one lies within the window centred on that of the other; a
pair is verified by its exact cosine if it collides on at least ``least`` of ``projections`` lines. For a pair at the
threshold the number of collisions is binomial, so ``least`` is the largest count that it reaches with probability
``recall``; nearer pairs reach it more surely.

In many dimensions a window of one line holds a large share of all vectors (over a third in 64 dimensions), so
lists of collisions over the whole table would be longer than the list of all pairs. They are therefore gathered cell
by cell. A *tree* sorts the vectors on further lines, one after the other, and cuts each at zero, until a cell
holds about ``CELL`` of them. A pair at the threshold falls on the same side of a line with a probability that is known whatever
the data (1 - angle / pi), so the number of trees follows from the number of cuts: all but one in 1 / ``MISS`` pairs share a cell of some tree.
With ten times the vectors there are three or four more cuts and half again as many trees: work grows little faster than the table.

In a cell each line is sorted, the window of each query is found by binary search, and the members it holds are counted per pair.
A pair belongs to the first tree in which it shares a cell. Cells that hold more than a bounded number (vectors that lie
close together) are cut into blocks, and a pair of blocks is one unit. What leaves a unit is a number of links
per vector and one edge per linked vector, not the links. Equal vectors are one row with a count throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrays import expand
from siltstone.llm.frames import discard, map_batches, named, salted_join, saved, shared_dir, tidy
from siltstone.llm.linking import UNIT_SCHEMA, resolve, unit_rows

THRESHOLD = 0.95
PROJECTIONS = 16
WINDOW = 2.2
RECALL = 0.9999
#: Share of pairs at the threshold that may share no cell.
MISS = 1e-5
#: Vectors in a block of a large cell; cells are cut until they hold an eighth of that on average.
BLOCK = 4096
#: Queries whose collisions are counted together, and rows of cells dealt together.
TILE, DEALT = 512, 8192


def least_collisions(recall: float = RECALL, projections: int = PROJECTIONS, window: float = WINDOW) -> int:
    """The largest count that a pair at the threshold reaches with at least this probability."""
    p = math.erf(window / math.sqrt(2))
    total = 0.0
    for k in range(projections, -1, -1):
        total += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if total >= recall:
            return k
    return 0


def forest_size(n: int, cell: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Cuts of a tree and number of trees for n vectors."""
    cuts = max(0, math.ceil(math.log2(max(1, n) / max(1, cell))))
    together = (1 - math.acos(threshold) / math.pi) ** cuts
    return cuts, 1 if cuts == 0 else math.ceil(math.log(miss) / math.log1p(-together))


def lines(dim: int, projections: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    """Random directions, the same for every task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def cells_of(units: np.ndarray, cuts: int, trees: int) -> np.ndarray:
    """The cell of every vector in every tree: on which side of zero it lies on each of the tree's lines."""
    out = np.zeros((len(units), trees), np.int64)
    line = lines(units.shape[1], max(1, cuts * trees), seed=13)
    for t in range(trees):
        side = units @ line[:, t * cuts : (t + 1) * cuts] >= 0
        out[:, t] = side @ (1 << np.arange(cuts, dtype=np.int64))
    return out


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Rows with a usable vector: not null or zero, all components there and finite."""
    column = column.cast(pa.large_list(pa.float64()))
    at, valid = np.asarray(column.offsets), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
    for i in np.flatnonzero(valid).tolist():
        v = values[at[i] : at[i + 1]]
        if len(v) and np.isfinite(v).all() and v.any():
            yield i, v


def _units(bodies: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    v = np.frombuffer(b"".join(bodies), kind).astype(np.float64).reshape(len(bodies), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Usable rows with the digest of their vector (``id``, ``digest``), and one row per different vector:
    ``digest``, ``node`` (64 bits of it), ``rep`` (the least id), ``size``, ``dim`` and ``body`` (the components as they are stored, 4 or 8 bytes each)."""
    kind = kind_of(vectors, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, v in _vectors(b.column(1)):
                rows.append(i)
                out.append((hashlib.blake2b(v.tobytes(), digest_size=16).digest(), len(v), v.astype(kind).tobytes()))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.binary()), strict=True))], names=["id", "digest", "dim", "body"])

    usable = vectors.select(named(key).cast("long").alias("id"), named(vector).alias("v")).where("id IS NOT NULL").mapInArrow(tidy(run), "id long, digest binary, dim int, body binary")
    # All rows of a class agree in dim and body, so any of them will do.
    one = usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("dim").alias("dim"), F.first("body").alias("body"))
    return usable.select("id", "digest"), one.withColumn("node", F.xxhash64("digest"))


def kind_of(vectors: DataFrame, vector: str) -> str:
    """How components are stored: as single or as double precision numbers."""
    return "<f4" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector].dataType.containsNull) else "<f8"


def collisions(queries: np.ndarray, members: np.ndarray | None, window: float) -> np.ndarray:
    """On how many lines each query's window holds each member; without members, how often two queries collide (each pair in either order)."""
    own = members is None
    members = queries if own else members
    n, m = len(queries), len(members)
    out = np.zeros(n * m, np.int64)
    for k in range(queries.shape[1]):
        order = np.argsort(members[:, k], kind="stable")
        line = members[order, k]
        if own:  # in sorted order, what follows a query
            q, low = order, np.arange(1, n + 1)
            high = np.searchsorted(line, line + window, "right")
        else:
            q = np.arange(n)
            low, high = np.searchsorted(line, queries[:, k] - window, "left"), np.searchsorted(line, queries[:, k] + window, "right")
        count = high - low
        out += np.bincount(np.repeat(q * m, count) + order[np.repeat(low, count) + expand(count)], minlength=n * m)
    out = out.reshape(n, m)
    return out + out.T if own else out


def linked(a: np.ndarray, b: np.ndarray | None, threshold: float, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of unit vectors; within one block (b is None) each pair once."""
    own = b is None
    b = a if own else b
    line = lines(a.shape[1])
    on_a, on_b = a @ line, b @ line
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(a), TILE):
        for j in range(i if own else 0, len(b), TILE):
            alone = own and i == j
            x, y = np.nonzero(collisions(on_a[i : i + TILE], None if alone else on_b[j : j + TILE], window) >= least)
            if alone:
                x, y = x[x < y], y[x < y]
            x, y = x + i, y + j
            for s in range(0, len(x), 1 << 16):
                xs, ys = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                near = np.einsum("ij,ij->i", a[xs], b[ys]) >= threshold
                left.append(xs[near])
                right.append(ys[near])
    return np.concatenate(left), np.concatenate(right)


def class_links(one: DataFrame, kind: str, threshold: float = THRESHOLD, pairs: bool = False, folder: str | None = None, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """From the classes: rows (a, n, null) with the number n of vectors linked to a's class in one unit,
    and rows (a, null, b) that connect what is linked; with ``pairs`` a row (a, null, b) for every linked
    pair of classes instead. Classes are called by their ``node``. ``one`` is read several times and should be stored; ``kind`` is that of its bodies.
    """
    folder = folder or shared_dir(one.sparkSession)
    window, least = WINDOW * math.sqrt(2 - 2 * threshold), least_collisions(recall)
    shapes = {r.dim: forest_size(r.n, block // 8, threshold) for r in one.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}

    def place(dim: pa.Array, body: pa.Array) -> dict[str, pa.Array]:
        d, bodies = dim.to_numpy(), body.to_pylist()
        out: list = [None] * len(d)
        for k in np.unique(d).tolist():
            rows = np.flatnonzero(d == k)
            for r, c in zip(rows.tolist(), cells_of(_units([bodies[r] for r in rows], kind), *shapes[k]), strict=True):
                out[r] = c
        return {"cells": pa.array(out, pa.list_(pa.int64()))}

    placed = saved(map_batches(one, place, ["dim", "body"], {"cells": T.ArrayType(T.LongType())}, ["dim", "node", "size", "body"]), "placed", folder)
    each = placed.select("node", "dim", F.posexplode("cells").alias("tree", "cell"))
    cell = ["dim", "tree", "cell"]
    groups = each.groupBy(*cell).agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(*cell, F.ceil(F.col("many") / block).cast("int").alias("cuts"))
    member = saved(salted_join(each, groups, cell, "node"), "members", folder)
    deals = int(max(1, -(-member.where("cuts = 1").count() // DEALT)))
    deal = F.when(F.col("cuts") > 1, F.xxhash64(*cell)).otherwise(F.pmod(F.xxhash64(*cell), F.lit(deals)))
    units = member.select("node", "tree", "cell", deal.alias("deal"), F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("k"), (F.col("cuts") > 1).alias("big"))
    units = units.select("node", "tree", "cell", "deal", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "big")

    def unit(table: pa.Table) -> pa.Table:
        dim, tree, at, node, sizes, side = (np.asarray(table.column(c)).astype(np.int64) for c in ("dim", "tree", "cell", "node", "size", "own"))
        big, across = table.column("big")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
        order = np.lexsort((node, side, at, tree, dim))
        edge = np.flatnonzero(np.append(True, (np.diff(dim[order]) != 0) | (np.diff(tree[order]) != 0) | (np.diff(at[order]) != 0)))
        bodies, cells = table.column("body"), table.column("cells")
        out = []
        for a, z in zip(edge, [*edge[1:], len(order)], strict=True):
            rows = order[a:z]
            place = pa.array(rows)
            units = _units(bodies.take(place).to_pylist(), kind)
            split = int((side[rows] == side[rows[0]]).sum()) if big and across else 0
            if big and across:
                x, y = linked(units[:split], units[split:], threshold, window, least)
                y = y + split
            else:
                x, y = linked(units, None, threshold, window, least)
            if len(x):
                have = np.stack(cells.take(place).to_numpy())[:, : tree[rows[0]]]
                first = np.concatenate([~(have[x[s : s + (1 << 16)]] == have[y[s : s + (1 << 16)]]).any(1) for s in range(0, len(x), 1 << 16)])
                if first.any():
                    out.append(unit_rows(node[rows], sizes[rows], x[first], y[first], pairs))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, names=["a", "n", "b"])

    return units.join(placed, "node").groupBy("deal", "i", "j", "big").applyInArrow(unit, UNIT_SCHEMA)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: the key, ``n_links`` (other vectors with a cosine of at least the threshold), ``component_id``
    (the least key reachable by links, its own included) and ``kept`` (its own key is that).

    Found pairs are verified in double precision; a pair at the threshold shares a cell with probability 1 - ``MISS`` and is then found
    with probability ``recall``. Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different
    lengths, don't link. Keys are integers; a row with a null key links with nothing, has a null component
    and is kept. Each row counts as a vector: rows that share a key and a vector link with each other, and rows that share a key get the
    most links and the least component of them. Other columns are left out. An empty table gives none.
    """
    folder = shared_dir(vectors.sparkSession)
    members, one = classes(vectors, key, vector)
    one = saved(one, "classes", folder)
    found = saved(class_links(one, kind_of(vectors, vector), threshold, folder=folder, block=block, recall=recall), "links", folder)
    for used in ("placed", "members"):
        discard(vectors.sparkSession, f"{folder}/{used}")
    items = vectors.select(named(key).cast("long").alias("id"))
    return resolve(items, key, members, one.select("digest", "node", "rep", "size"), found, folder).drop("class_id")
