"""Benchmark decontamination by winnowing.

Words are the maximal runs of ASCII digits, letters and non-ASCII characters, with A-Z lower-cased.
Of every ``span - k + 1`` consecutive k-grams the one with the least hash is kept as a fingerprint
(the rightmost of equals), on both sides. A shared run of ``span`` words then holds the same kept
k-gram on both sides, so joining fingerprints and extending each hit word by word finds every one.

The benchmark is the small side of the join, but its size isn't trusted: its fingerprints are built
in blocks of ``block_bytes`` of item text, each block is broadcast by itself, and the documents pass
all blocks one after the other without a shuffle. No document's rows meet in one task, so hot
sources, copies and shared passages cost what their bytes cost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.arrays import Block, blocks, expand, grams, mix, ranges_of, words
from siltstone.llm.frames import fresh, map_batches, named, saved

K = 5
SPAN = 10
#: Bytes of item text in one broadcast block; the arrays made of it take about ten times that.
BLOCK_BYTES = 8 << 20
PAIRS_AT_ONCE = 1 << 18


def winnow(h: np.ndarray, ends: np.ndarray, k: int, span: int) -> np.ndarray:
    """Positions of the k-grams kept: of each window that lies in one row, the rightmost least hash.

    h: k-gram hashes by start; ends: for each word, the end of its row.
    """
    w, n = span - k + 1, len(h) - (span - k)
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for j in range(1, w):
        less = h[j : j + n] <= best
        np.copyto(best, h[j : j + n], where=less)
        np.copyto(at, np.arange(j, j + n), where=less)
    return np.unique(at[np.arange(n) + span <= ends[:n]])


@dataclass
class Index:
    """Fingerprints of one block of items: sorted hashes, each with a context and the items that hold it."""

    words: np.ndarray
    lengths: list[int]  # of short items: each is one window
    keys: dict[int, np.ndarray]  # by gram length (span stands for k-grams)
    at: dict[int, np.ndarray]  # word position of each entry
    first: dict[int, np.ndarray]  # start of the entry's item
    last: dict[int, np.ndarray]  # end of the entry's item
    items_at: dict[int, np.ndarray]  # CSR into items
    items: dict[int, np.ndarray]
    ids: list[str]
    sieve: dict[int, np.ndarray]


def _sieve(keys: np.ndarray) -> np.ndarray:
    bits = min(24, max(10, int(len(keys) * 16).bit_length()))
    out = np.zeros(1 << bits, dtype=bool)
    out[(keys & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def build_index(ids: list[str], texts: list[str | None], k: int = K, span: int = SPAN) -> Index:
    """The index of one block of items; items without words are left out."""
    data = pa.array([t or "" for t in texts], type=pa.string())
    parts, counts = [], []
    for b in blocks(data):
        w = words(b)
        parts.append(w.hashes)
        counts.append(w.counts())
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    row_at = np.concatenate([[0], np.cumsum(n)])
    row_end, item_of = np.repeat(row_at[1:], n), np.repeat(np.arange(len(n)), n)
    out = Index(h, sorted({int(x) for x in n if 0 < x < span}), {}, {}, {}, {}, {}, {}, ids, {})
    for length in [span, *out.lengths]:
        if length == span:
            g = grams(h, k)
            at = winnow(g, row_end, k, span)
        else:
            g = grams(h, length)
            at = row_at[:-1][n == length]
        if not len(at):
            continue
        key, item = g[at], item_of[at]
        # Entries with the same words around them behave alike: one entry, several items.
        around = np.zeros(len(at), np.uint64)
        if length == span:
            for j in range(k - span, span):
                ok = (at + j >= row_at[item]) & (at + j < row_end[at])
                around = mix(around + np.where(ok, h[np.clip(at + j, 0, len(h) - 1)], np.uint64(j + span)))
        order = np.lexsort((item, around, key))
        key, around, at, item = key[order], around[order], at[order], item[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (around[1:] != around[:-1])
        lead = np.flatnonzero(new)
        out.keys[length], out.at[length] = key[lead], at[lead]
        out.first[length], out.last[length] = row_at[item[lead]], row_at[item[lead] + 1]
        out.items_at[length], out.items[length] = np.append(lead, len(key)), item
        out.sieve[length] = _sieve(key)
    return out


def scan(block: Block, index: Index, k: int = K, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """For the rows of a block: words, per-word hit flags as a difference array, and (row, item) pairs found."""
    w = words(block)
    h, row_end, row_of = w.hashes, w.row_end(), w.row_of()
    row_begin = np.repeat(w.row_at[:-1], w.counts())
    edge = np.zeros(len(h) + 1, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for length, keys in index.keys.items():
        if length == span:
            g = grams(h, k)
            at = winnow(g, row_end, k, span)
        else:
            g = grams(h, length)
            at = np.flatnonzero(np.arange(len(g)) + length <= row_end[: len(g)])
        sieve = index.sieve[length]
        at = at[sieve[(g[at] & np.uint64(len(sieve) - 1)).astype(np.int64)]]
        lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
        ok = hi > lo
        at, lo, many = at[ok], lo[ok], (hi - lo)[ok]
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // PAIRS_AT_ONCE)) + 1
        for a, l, c in zip(np.split(at, cuts), np.split(lo, cuts), np.split(many, cuts), strict=True):
            d, e = np.repeat(a, c), np.repeat(l, c) + expand(c)
            i = index.at[length][e]
            size = k if length == span else length
            same = np.ones(len(d), bool)
            for j in range(size):
                same &= h[d + j] == index.words[i + j]
            left, right = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
            if length == span:
                go = same.copy()
                for j in range(1, span - k + 1):
                    go &= (d - j >= row_begin[d]) & (i - j >= index.first[length][e])
                    go &= h[np.maximum(d - j, 0)] == index.words[np.maximum(i - j, 0)]
                    left += go
                go = same.copy()
                for j in range(k, span):
                    go &= (d + j < row_end[d]) & (i + j < index.last[length][e])
                    go &= h[np.minimum(d + j, len(h) - 1)] == index.words[np.minimum(i + j, len(index.words) - 1)]
                    right += go
                same &= left + size + right >= span
            d, e, left, right = d[same], e[same], left[same], right[same]
            np.add.at(edge, d - left, 1)
            np.add.at(edge, d + size + right, -1)
            pairs = np.unique(np.stack([row_of[d], e]), axis=1) if len(d) else np.zeros((2, 0), np.int64)
            start = index.items_at[length][pairs[1]]
            per = index.items_at[length][pairs[1] + 1] - start
            found.append((np.repeat(pairs[0], per), index.items[length][np.repeat(start, per) + expand(per)]))
    return w.row_at, np.cumsum(edge[:-1]) > 0, row_of, found


OUTPUTS = {"n_words": T.LongType(), "n_hit": T.LongType(), "hit_spans": T.ArrayType(T.LongType()), "item_ids": T.ArrayType(T.StringType())}


def _merge(old: list[int] | None, new: list[int]) -> list[int]:
    """Two flat lists of word ranges (start, end, start, end ...) as one, sorted and joined."""
    both = sorted(zip((old or [])[::2] + new[::2], (old or [])[1::2] + new[1::2], strict=True))
    out: list[int] = []
    for a, b in both:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _pass(df: DataFrame, index: Broadcast, text: str, names: dict[str, str], k: int, span: int, keep: list[str], again: bool) -> DataFrame:
    spans_c, items_c = names["hit_spans"], names["item_ids"]

    def fn(col: pa.Array, *before: pa.Array) -> dict[str, pa.Array]:
        ix = index.value
        old = [a.to_pylist() for a in before]
        n_words, spans, items = [], [], []
        for b in blocks(col):
            row_at, hit, _, found = scan(b, ix, k, span)
            n_words.append(np.diff(row_at))
            # Runs of hit words, row by row.
            s, e = ranges_of(hit, row_at)
            row = np.searchsorted(row_at, s, "right") - 1
            rel = np.stack([s - row_at[row], e - row_at[row]], 1).ravel() if len(s) else np.zeros(0, np.int64)
            at = np.searchsorted(row, np.arange(b.rows + 1)) * 2
            pair = np.unique(np.concatenate([np.stack(f) for f in found], axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            it = np.searchsorted(pair[0], np.arange(b.rows + 1))
            for r in range(b.rows):
                mine, ids = rel[at[r] : at[r + 1]].tolist(), [ix.ids[x] for x in pair[1][it[r] : it[r + 1]]]
                if old:
                    mine, ids = _merge(old[0][b.first + r], mine), ids + list(old[1][b.first + r] or [])
                spans.append(mine)
                items.append(sorted(set(ids)))
        made = {
            "n_words": pa.array(np.concatenate(n_words), pa.int64()),
            "n_hit": pa.array([sum(x[1::2]) - sum(x[::2]) for x in spans], pa.int64()),
            "hit_spans": pa.array(spans, pa.list_(pa.int64())),
            "item_ids": pa.array(items, pa.list_(pa.string())),
        }
        return {names[o]: v for o, v in made.items()}

    return map_batches(df, fn, [text, *([spans_c, items_c] if again else [])], {names[o]: t for o, t in OUTPUTS.items()}, keep)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    prefix: str = "",
    k: int = K,
    span: int = SPAN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents with the words that occur in a benchmark item's window of ``span`` words.

    Adds, after the columns of ``keep`` (all by default), ``n_words``; ``n_hit``, how many of them are hit;
    ``hit_spans``: flat list of word
    ranges start, end, start, end ... that are hit, sorted and disjoint; ``item_ids``: the items found, as
    strings, sorted. ``prefix`` stands before these names; a kept column of the same name gives way.

    Items of fewer than ``span`` words are one window; items without words, and null texts, match
    nothing. Null or empty documents have no words and no hits. Repeated documents or items each count;
    an item id that comes twice is listed once. An empty benchmark leaves every list empty.
    Null item ids are listed as "null".
    """
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    spark = docs.sparkSession
    keep = [c for c in docs.columns] if keep is None else list(keep)
    names = {o: prefix + o for o in OUTPUTS}
    carried = fresh(docs, "_text")
    df = docs.select(*(named(c) for c in dict.fromkeys(keep) if c.lower() not in {x.lower() for x in names.values()}), named(text).alias(carried))
    inner = df.columns
    ids: list[str] = []
    texts: list[str] = []
    size = done = 0

    def flush(df: DataFrame) -> DataFrame:
        nonlocal ids, texts, size, done
        index = spark.sparkContext.broadcast(build_index(ids, texts, k, span))
        df = _pass(df, index, carried, names, k, span, inner, done > 0)
        ids, texts, size, done = [], [], 0, done + 1
        return saved(df, "passes") if done % 4 == 0 else df

    for r in items.select(named(item_id).cast("string").alias("i"), named(item_text).alias("t")).toLocalIterator():
        ids.append("null" if r.i is None else r.i)
        texts.append(r.t or "")
        size += len(texts[-1]) + 1
        if size >= block_bytes:
            df = flush(df)
    if ids or not done:
        df = flush(df)
    return df.select(*(named(c) for c in df.columns if c != carried))
