"""N-gram Jaccard join with a MinHash LSH forest.

A text's shingles are its runs of five words (all its words, if it has fewer); texts are linked if the
Jaccard similarity of their sets of shingles is at least 0.8.

Every different sequence of words gets a label of ``DEEPEST`` minimum hashes in each of ``TREES`` trees. Sorted labels
are a prefix trie: texts whose labels share a prefix stand together. A tree is descended from the longest prefix: texts
that share the whole label meet first, then the prefix is shortened level by level, and a level brings only the pairs that
didn't share a longer one. A text stops at the level at which a partner at the threshold has met it in some tree with the target
probability. That level depends on the text: a small set can only have a few similarities, and if the least one that links is well
above the threshold its prefixes stay longer. No text needs prefixes shorter than the level for the threshold itself
(``prefix_depth``), so texts are grouped by that prefix, and each group is a subtrie that one task descends.

A pair belongs to the first tree in which it meets, so it is looked at once. A first pass over the groups descends them by
signatures alone and keeps the texts that have a pair there; only these are sent their text, which the second pass verifies
by exact sets. What leaves it is sums and one edge per linked text. A group of more than a bounded size is cut into
blocks, and a pair of blocks is one unit. Components are made of verified links only. Equal sequences of words are one row with a count throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrays import Block, Words, blocks, expand, grams, mix, words
from siltstone.llm.frames import discard, give_back, named, salted_join, saved, shared_dir, small_batches, tidy
from siltstone.llm.linking import UNIT_SCHEMA, resolve, unit_rows

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEEPEST = 24, 8
RECALL = 0.9999
#: A block of a group: so many texts and words at most (or one text).
BLOCK_TEXTS, BLOCK_WORDS = 256, 500_000
#: Columns of the incidence matrix that are multiplied at once, times texts.
CELLS = 1 << 22
#: Rows of signatures in a unit of the first pass, and pairs looked at together.
SIGNED_ROWS, PAIRS = 8192, 1 << 15
#: Bits of a signature's second word that hold the number of shingles; the others hold the levels below the group's prefix.
SIZE_BITS = 16


def prefix_depth(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The prefix length at which a pair at the threshold meets in some tree with at least this probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def stops(recall: float = RECALL, threshold: float = THRESHOLD, most: int = 256) -> np.ndarray:
    """For a set of m shingles, m below ``most``, the level at which its prefixes needn't be shortened any more; last, for all larger sets.

    Of the similarities that a set of m can have, the least that reaches the threshold is what must be found.
    """
    out = np.full(most + 1, prefix_depth(recall, threshold), np.int8)
    for m in range(1, most):
        least = 1.0
        for other in range(1, int(m / threshold) + 2):
            common = np.arange(1, min(m, other) + 1)
            s = common / (m + other - common)
            s = s[s >= threshold - 1e-9]
            least = min(least, s.min(initial=1.0))
        out[m] = prefix_depth(recall, max(threshold, least))
    return out


def shingles(block: Block, size: int = SHINGLE, found: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of every row, the range of each row in them, and the words per row."""
    w = words(block) if found is None else found
    count = w.counts()
    g = grams(w.hashes, size)
    at = np.arange(len(g))
    inside = at + size <= w.row_end()[: len(g)]
    row = np.searchsorted(w.row_at, at[inside], "right") - 1
    hashes = g[inside]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        own = [mix(np.array([sum(int(x) * (i + 3) for i, x in enumerate(w.hashes[w.row_at[r] : w.row_at[r + 1]])) & (2**64 - 1)], np.uint64) + np.uint64(count[r])) for r in few]
        hashes, row = np.concatenate([hashes, *own]), np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        hashes, row = hashes[order], row[order]
    return hashes, np.searchsorted(row, np.arange(block.rows + 1)), count


def digests(w: Words, rows: np.ndarray) -> list[bytes]:
    """A digest of the sequence of words of each of these rows."""
    return [hashlib.blake2b(w.hashes[w.row_at[r] : w.row_at[r + 1]].tobytes(), digest_size=16).digest() for r in rows]


def tree_keys(hashes: np.ndarray, at: np.ndarray, depth: int, trees: int = TREES, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """For each row with shingles (others: zeros), in every tree, the hash of its label's first ``depth`` levels, and of the
    levels below it some bits each, the next level highest."""
    rng = np.random.default_rng(seed)
    n = len(at) - 1
    has = np.flatnonzero(np.diff(at))
    prefix, below = np.zeros((n, trees), np.uint64), np.zeros((n, trees), np.uint64)
    if not len(has):
        return prefix, below
    starts = at[:-1][has]
    bits = level_bits(depth)
    for t in range(trees):
        key = np.full(len(has), t, np.uint64)
        rest = np.zeros(len(has), np.uint64)
        for level in range(DEEPEST):
            multiplier, flip = rng.integers(0, 2**64, 2, dtype=np.uint64)
            key = mix(key ^ np.minimum.reduceat((hashes ^ flip) * (multiplier | np.uint64(1)), starts))
            if level == depth - 1:
                prefix[has, t] = key
            elif level >= depth:
                rest = rest << np.uint64(bits) | key >> np.uint64(64 - bits)
        below[has, t] = rest
    return prefix, below


def level_bits(depth: int) -> int:
    """Bits kept of each level below the group's prefix. They order the descent; two labels that agree in them by chance only meet a level early."""
    return (64 - SIZE_BITS) // max(1, DEEPEST - depth)


def signatures(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """``id``, ``digest`` of the sequence of words, ``n`` words and ``keys`` of the texts that have words.

    ``keys``: the prefix in each tree, then the levels below it in each tree together with the number of different shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1)):
                w = words(block)
                hashes, at, count = shingles(block, found=w)
                prefix, below = tree_keys(hashes, at, depth)
                rows = np.flatnonzero(count)
                size = np.array([len(np.unique(hashes[at[r] : at[r + 1]])) for r in rows], np.uint64)
                keys = np.concatenate([prefix[rows], below[rows] << np.uint64(SIZE_BITS) | np.minimum(size, np.uint64(2**SIZE_BITS - 1))[:, None]], 1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 2 * TREES), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(block.first + rows)), pa.array(digests(w, rows), pa.binary()), pa.array(count[rows]), lists], names=["id", "digest", "n", "keys"])

    small_batches(docs.sparkSession)
    source = docs.select(named(key).cast("long").alias("id"), named(text).cast("string").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return source.mapInArrow(tidy(run), "id long, digest binary, n long, keys array<long>")


class Forest:
    """The labels of some texts: ``keys`` as ``signatures`` gives them, a row per text."""

    def __init__(self, keys: np.ndarray, depth: int, stop_of: np.ndarray, threshold: float) -> None:
        self.prefix, below = keys[:, :TREES], keys[:, TREES:].view(np.uint64)
        self.depth, self.threshold = depth, threshold
        self.size = (below[:, 0] & np.uint64(2**SIZE_BITS - 1)).astype(np.int64)
        self.stop = stop_of[np.minimum(self.size, len(stop_of) - 1)].astype(np.int64)
        self.below = below >> np.uint64(SIZE_BITS)
        self.bits = level_bits(depth)

    def _cut(self, below: np.ndarray, level: int | np.ndarray) -> np.ndarray:
        """The levels below the group's prefix as far as ``level``."""
        return below >> np.asarray((DEEPEST - level) * self.bits, np.uint64)

    def _earlier(self, x: np.ndarray, y: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """Whether pairs meet in a tree before ``tree`` as well."""
        same = (self.prefix[x] == self.prefix[y]) & (np.arange(TREES) < tree[:, None])
        pair, t = np.nonzero(same)
        need = np.maximum(self.stop[x], self.stop[y])[pair]
        met = self._cut(self.below[x[pair], t], need) == self._cut(self.below[y[pair], t], need)
        out = np.zeros(len(x), bool)
        out[pair[met]] = True
        return out

    def pairs(self, rows: np.ndarray, tree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``rows`` of the pairs that first meet here, in runs: rows[i] is a text that stands in the group of its prefix in tree[i].

        Longest prefixes come first; at each shorter level only pairs that didn't share a longer one, of texts that go down to it.
        """
        n = len(rows)
        own = self.below[rows, tree]
        order = np.lexsort((own, self.prefix[rows, tree], tree))
        prefix, own, at_tree, row = self.prefix[rows, tree][order], own[order], tree[order], rows[order]
        end = np.arange(1, n + 1)  # after the last text that shares the longer prefix
        for level in range(DEEPEST, self.depth - 1, -1):
            cut = self._cut(own, level)
            edge = np.append((cut[1:] != cut[:-1]) | (prefix[1:] != prefix[:-1]) | (at_tree[1:] != at_tree[:-1]), True)
            stop = np.flatnonzero(edge)[np.searchsorted(np.flatnonzero(edge), np.arange(n))] + 1
            down = self.stop[row] <= level
            fresh = np.where(down, stop - end, 0)
            upto = np.concatenate([[0], np.cumsum(fresh)])
            begin = 0
            while begin < n:
                z = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PAIRS, "right")) - 1)
                count = fresh[begin:z]
                x = np.repeat(np.arange(begin, z), count)
                y = np.repeat(end[begin:z], count) + expand(count)
                begin = z
                small, large = np.minimum(self.size[row[x]], self.size[row[y]]), np.maximum(self.size[row[x]], self.size[row[y]])
                ok = down[y] & ((small >= self.threshold * large - 1e-9) | (large >= 2**SIZE_BITS - 1))
                x, y = x[ok], y[ok]
                ok = ~self._earlier(row[x], row[y], at_tree[x])
                if ok.any():
                    yield order[x[ok]], order[y[ok]], np.full(int(ok.sum()), level)
            # Texts that have stopped have no pairs at shorter levels; what others met so far ends here.
            end = stop


def _common(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles every two texts share, and how many each has."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    _, code = np.unique(hashes, return_inverse=True)
    code = np.unique(code.astype(np.int64) * n + row)  # each shingle once per text
    row, code = code % n, code // n
    size = np.bincount(row, minlength=n)
    shared = np.bincount(code)[code] > 1
    row, code = row[shared], code[shared]
    common = np.zeros((n, n), np.float32)
    start = np.flatnonzero(np.diff(code, prepend=-1))
    width = max(1, min(CELLS // n, len(start)))
    for c in range(0, len(start), width):
        a = start[c]
        z = start[c + width] if c + width < len(start) else len(code)
        m = np.zeros((n, width), np.float32)
        m[row[a:z], np.searchsorted(start, np.arange(a, z), "right") - 1 - c] = 1
        common += m @ m.T
    return common, size


def _node(classes: DataFrame) -> Column:
    return F.col("node" if "node" in classes.columns else "rep")


def memberships(classes: DataFrame, threshold: float, recall: float, folder: str, block_texts: int = BLOCK_TEXTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Which texts must be verified in which group: ``node``, ``n``, ``tree``, ``prefix``, ``own`` block, the blocks ``i`` and ``j`` of
    the unit, and ``big`` (the group has several blocks)."""
    depth, stop_of = prefix_depth(recall, threshold), stops(recall, threshold)
    label = classes.select(_node(classes).alias("node"), "n", F.posexplode(F.slice("keys", 1, TREES)).alias("tree", "prefix"))
    groups = label.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("words")).where("many > 1")
    cuts = F.ceil(F.greatest(F.col("many") / block_texts, F.least(F.col("words") / block_words, F.col("many")))).cast("int").alias("cuts")
    member = saved(salted_join(label, groups.select("tree", "prefix", cuts), ["tree", "prefix"], "node"), "members", folder)
    deals = int(max(1, -(-member.where("cuts = 1").count() // SIGNED_ROWS)))
    signed = member.where("cuts = 1").drop("cuts").join(classes.select(_node(classes).alias("node"), "keys"), "node")

    def descend(table: pa.Table) -> pa.Table:
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(table.num_rows, -1)
        wanted = np.zeros(table.num_rows, bool)
        forest = Forest(keys, depth, stop_of, threshold)
        for x, y, _ in forest.pairs(np.arange(table.num_rows), np.asarray(table.column("tree")).astype(np.int64)):
            wanted[x] = wanted[y] = True
        return table.select(["node", "n", "tree", "prefix"]).filter(pa.array(wanted))

    asked = signed.withColumn("deal", F.pmod(F.xxhash64("tree", "prefix"), F.lit(deals))).groupBy("deal").applyInArrow(descend, "node long, n long, tree int, prefix long")
    zero = F.lit(0)
    asked = asked.select("node", "n", "tree", "prefix", zero.alias("own"), zero.alias("i"), zero.alias("j"), F.lit(False).alias("big"))
    hot = member.where("cuts > 1").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    hot = hot.select("node", "n", "tree", "prefix", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), F.lit(True).alias("big"))
    return saved(asked.unionByName(hot), "asked", folder)


def class_links(docs: DataFrame, classes: DataFrame, key: str, text: str, threshold: float, folder: str, pairs: bool = False, block_texts: int = BLOCK_TEXTS, block_words: int = BLOCK_WORDS, recall: float = RECALL) -> DataFrame:
    """The units' rows between classes: see ``linking``. ``classes``: ``digest``, ``rep``, ``size``, ``n``, ``keys``, and ``node``, what a class
    is called (if there is none, it is called by its ``rep``)."""
    depth, stop_of = prefix_depth(recall, threshold), stops(recall, threshold)
    asked = memberships(classes, threshold, recall, folder, block_texts, block_words)
    # Groups of one block are dealt together, so that a task's unit has enough to do.
    total = asked.where("NOT big").agg(F.sum("n")).first()[0] or 0
    deals = int(max(1, -(-total // block_words)))
    one = classes.select(_node(classes).alias("node"), "rep", "digest", "size", "keys")
    deal = F.when(F.col("big"), F.xxhash64("tree", "prefix")).otherwise(F.pmod(F.xxhash64("tree", "prefix"), F.lit(deals)))
    placed = asked.withColumn("deal", deal).drop("n").join(one, "node")
    bodies = docs.select(named(key).cast("long").alias("rep"), named(text).cast("string").alias("t")).where("rep IS NOT NULL AND t IS NOT NULL")
    dealt = bodies.join(placed, "rep").drop("rep")

    def unit(table: pa.Table) -> pa.Table:
        tree, prefix, node = (np.asarray(table.column(c)).astype(np.int64) for c in ("tree", "prefix", "node"))
        hashes, at, own = [], [np.zeros(1, np.int64)], []
        for b in blocks(table.column("t")):
            w = words(b)
            h, a, _ = shingles(b, found=w)
            hashes.append(h)
            at.append(a[1:] + at[-1][-1])
            own += digests(w, np.arange(b.rows))
        hashes, at = np.concatenate(hashes), np.concatenate(at)
        # A key may stand with several texts, and with one of them several times.
        true = np.array([a == b for a, b in zip(own, table.column("digest").to_pylist(), strict=True)])
        order = np.lexsort((node, prefix, tree))
        order = order[true[order]]
        place = np.stack([tree[order], prefix[order], node[order]])
        order = order[np.append(True, (place[:, 1:] != place[:, :-1]).any(0))[: len(order)]]
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(table.num_rows, -1)
        sizes, side = (np.asarray(table.column(c)).astype(np.int64) for c in ("size", "own"))
        big, across = table.column("big")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
        forest = Forest(keys, depth, stop_of, threshold)
        edges = np.flatnonzero(np.append(True, (np.diff(tree[order]) != 0) | (np.diff(prefix[order]) != 0))[: len(order)])
        out = []
        for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[a:z]
            common = None
            for x, y, _ in forest.pairs(rows, tree[rows]):
                if big and across:
                    ok = side[rows[x]] != side[rows[y]]
                    x, y = x[ok], y[ok]
                if not len(x):
                    continue
                if common is None:
                    ranges = [hashes[at[r] : at[r + 1]] for r in rows]
                    common, different = _common(np.concatenate(ranges), np.concatenate([[0], np.cumsum([len(r) for r in ranges])]))
                both = common[x, y].astype(np.int64)
                near = both >= threshold * (different[x] + different[y] - both) - 1e-9
                if near.any():
                    out.append(unit_rows(node[rows], sizes[rows], x[near], y[near], pairs))
        give_back()
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, names=["a", "n", "b"])

    return dealt.groupBy("deal", "i", "j", "big").applyInArrow(unit, UNIT_SCHEMA)


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, block_texts: int = BLOCK_TEXTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: the key, ``class_id`` (the least key with the same sequence of words), ``n_links`` (other
    documents with a similarity of at least ``threshold``), ``component_id`` (the least key reachable by links,
    its own included) and ``kept`` (its own key is that).

    Words are runs of ASCII digits, letters and non-ASCII characters, A-Z lower-cased. Texts that are null or
    have no words link with nothing; texts of fewer than five words link with those of the same words.
    Keys are integers; a row with a null key links with nothing, has null ids and is kept. Rows that share a key
    each count as a document and get the most links and the least component of them. Found links are verified
    by their sets of shingles, which are compared by 64-bit hashes; a link at the threshold is found with probability ``recall``. Other columns are left out; an empty
    table gives none.
    """
    folder = shared_dir(docs.sparkSession)
    signed = saved(signatures(docs, key, text, prefix_depth(recall, threshold)), "signatures", folder)
    one = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    one = saved(one.withColumn("node", F.xxhash64("digest")), "classes", folder)
    found = saved(class_links(docs, one, key, text, threshold, folder, block_texts=block_texts, block_words=block_words, recall=recall), "links", folder)
    for used in ("members", "asked"):
        discard(docs.sparkSession, f"{folder}/{used}")
    items = docs.select(named(key).cast("long").alias("id"))
    return resolve(items, key, signed.select("id", "digest"), one, found, folder)
