"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` tokens. Each passage is described by counts of its characters
and tokens, encoded by a layer, and gets a gated attention weight; the weighted sum of the encodings is
scored. Only the documents' labels are given: the attention learns which passages decide. The network is
trained in numpy on the driver with a bounded sample of labelled rows; scoring passes every passage of
every document, block by block, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrays import Block, blocks, range_hashes, ranges_of
from siltstone.llm.frames import discard, map_batches, saved, shared_dir
from siltstone.llm.labelled import TRAIN_BYTES, collected, labelled_sample, within

PASSAGE = 64
#: Labelled rows to learn from; every passage of each is used.
TRAIN_ROWS = 4096
#: Passages whose gradient is worked out at once.
TILE = 1 << 16
FEATURES = 18
HIDDEN, GATE = 16, 8
CUT = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WIDE = np.zeros(256, bool)
_WIDE[128:] = True
_MARK = ~(_UPPER | _LOWER | _DIGIT | _WIDE)
_MARK[:33] = False
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(","), ord(";"), ord(":")]] = True


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of a block, and for each row the range of its passages (one at least)."""
    data = block.data
    s, e = ranges_of(data > 32, block.offsets)
    row_at = np.searchsorted(s, block.offsets)
    count = np.diff(row_at)
    per_row = np.maximum(1, -(-count // PASSAGE))
    at = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros((at[-1], FEATURES), np.float32)
    if not len(s):
        return out, at
    row = np.repeat(np.arange(block.rows), count)
    part = at[row] + (np.arange(len(s)) - row_at[row]) // PASSAGE
    first = np.flatnonzero(np.diff(part, prepend=-1))
    where = part[first]

    def per_token(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask[data], out=sums[1:], dtype=np.int32)
        return sums[e] - sums[s]

    total = lambda x: np.add.reduceat(x.astype(np.float64), first)
    size = e - s
    upper, lower, digit, wide, mark = (per_token(m) for m in (_UPPER, _LOWER, _DIGIT, _WIDE, _MARK))
    same = np.zeros(len(s), bool)
    h = range_hashes(data, s, e)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, part))
    ph, pp = h[order], part[order]
    new = np.ones(len(h), bool)
    new[1:] = (ph[1:] != ph[:-1]) | (pp[1:] != pp[:-1])
    distinct = np.bincount(pp[new], minlength=at[-1])[where]
    last, before = data[e - 1], data[np.maximum(e - 2, 0)]
    odd_end = _MARK[last] & ~_STOP[last]
    n, chars = total(np.ones(len(s))), np.maximum(total(size), 1)
    letters = np.maximum(total(upper) + total(lower) + total(wide), 1)
    ended = np.append(first[1:], len(s))
    span = np.maximum(e[ended - 1] - s[first], 1)
    lines = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=lines[1:], dtype=np.int32)
    columns = [
        np.log1p(n) / 4,
        chars / n / 10,
        total(upper) / letters,
        total(digit) / chars,
        total(mark) / chars,
        total(wide) / letters,
        total((upper > 1) & (lower == 0)) / n,
        total(odd_end) / n,
        total(odd_end & (last == before) & (size > 2)) / n,
        total(mark == size) / n,
        total(same) / n,
        distinct / n,
        total(_STOP[last]) / n,
        total(size <= 3) / n,
        total(size >= 10) / n,
        total(size >= 24) / n,
        total((upper > 0) & (lower > 0)) / n,
        10 * (lines[e[ended - 1]] - lines[s[first]]) / span,
    ]
    out[where] = np.stack(columns, 1)
    return out, at


@dataclass
class Network:
    """Encoder, gated attention and scorer, with the means and spreads of the features."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of the bags: bag i has the instances at[i] to at[i + 1]."""
        w = self.weights
        x = (x - w["mean"]) / w["spread"]
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (v * u) @ w["a"]
        n = np.diff(at)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, at[:-1]), n))
        a /= np.repeat(np.add.reduceat(a, at[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, at[:-1])
        return z @ w["c"] + w["d"], {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "n": n}

    def gradient(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the summed log loss of the bags, by weight."""
        w = self.weights
        logit, f = self.forward(x, at)
        dl = 1 / (1 + np.exp(-logit)) - y
        dz = np.repeat(dl[:, None] * w["c"], f["n"], axis=0)
        da = (dz * f["h"]).sum(1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at[:-1]), f["n"]))
        dg = da[:, None] * w["a"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (f["v"] * f["u"]).T @ da, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, at)[0], -30, 30)))


def train(x: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Network:
    """Fit by Adam on the log loss of the bags. Without rows of both labels the score is the labels' mean."""
    rng = np.random.default_rng(seed)
    spread = x.std(0, dtype=np.float64) if len(x) else np.ones(FEATURES)
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
    w = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "a": init(GATE), "c": init(HIDDEN), "d": np.zeros(1)}
    fixed = {"mean": x.mean(0, dtype=np.float64) if len(x) else np.zeros(FEATURES), "spread": np.where(spread > 1e-4, spread, 1.0)}
    net = Network({**w, **fixed})
    if len(set(y.tolist())) < 2:
        mean = float(y.mean()) if len(y) else 0.5
        net.weights["c"] = np.zeros(HIDDEN)
        net.weights["d"] = np.array([np.log((mean + 1e-3) / (1 - mean + 1e-3))])
        return net
    m = {k: np.zeros_like(v) for k, v in w.items()}
    q = {k: np.zeros_like(v) for k, v in w.items()}
    # Whole rows of about TILE passages (or one row).
    runs = np.unique(np.append(np.searchsorted(at, np.arange(0, at[-1], TILE)), len(y)))
    for t in range(1, steps + 1):
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        for i, z in zip(runs[:-1], runs[1:], strict=True):
            for k, g in net.gradient(x[at[i] : at[z]], at[i : z + 1] - at[i], y[i:z]).items():
                grad[k] += g / len(y)
        lr = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in grad.items():
            g = g + decay * net.weights[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            q[k] = 0.99 * q[k] + 0.01 * g * g
            net.weights[k] = net.weights[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.99**t)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held_out: int = 2, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, seed: int = 7) -> Network:
    """A network fitted to at most ``max_rows`` labelled rows outside the held-out fold.

    Null texts, keys and labels aren't used. The driver gets the features of every passage of these rows, 72 bytes for
    64 tokens and at most ``max_bytes`` together; it works them off in runs of whole rows of about ``TILE`` passages.
    """

    def fn(texts: pa.Array) -> dict[str, pa.Array]:
        out = []
        for b in blocks(texts):
            x, at = passages(b)
            out += [x[at[i] : at[i + 1]].ravel() for i in range(b.rows)]
        return {"x": pa.array(out, pa.list_(pa.float32()))}

    sample = labelled_sample(docs, labels, key, text, label, folds, held_out, max_rows)
    made = map_batches(sample, fn, ["t"], {"x": T.ArrayType(T.FloatType())}, ["k", "y"]).select(F.col("k").cast("string").alias("k"), "y", "x")
    folder = shared_dir(docs.sparkSession)
    got, bags = collected(within(saved(made, folder=folder), 4 * F.size("x").cast("long"), max_bytes), "x", np.float32, FEATURES)
    discard(docs.sparkSession, folder)
    at = np.concatenate([[0], np.cumsum([len(v) for v in bags])]).astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return train(x, at, np.asarray(got["y"], np.float64), seed=seed)


def score(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None, output: str = "score") -> DataFrame:
    """The columns of ``keep`` (all by default) and ``score``, 0 to 1: how likely label 1 is for the whole text.

    A null or empty text is scored as one empty passage. Repeated rows score alike; an empty table gives
    none; a kept column named like the output gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net.weights)

    def fn(texts: pa.Array, model: Network) -> dict[str, pa.Array]:
        parts = [model.score(*passages(b)) for b in blocks(texts)]
        return {output: pa.array(np.concatenate(parts).astype(np.float64))}

    return map_batches(docs, fn, [text], {output: T.DoubleType()}, docs.columns if keep is None else keep, lambda: Network(shared.value))
