"""The forest's descent: recall at the threshold, levels per text, cost of chains, keys that stand with several texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import jaccard_join as J
from siltstone.llm.arrays import blocks, mix
from siltstone.llm.frames import saved, shared_dir
from tests.llm.helpers import changed, prose

import pyarrow as pa


def signed(sets):
    """Keys of sets of numbers."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    prefix, below = J.tree_keys(mix(np.concatenate(sets).astype(np.uint64)), at, J.prefix_depth())
    return np.concatenate([prefix, below << np.uint64(J.SIZE_BITS) | np.diff(at).astype(np.uint64)[:, None]], 1).view(np.int64)


def met(keys, n):
    """Every pair that meets in some tree, with the tree and level; each once."""
    forest = J.Forest(keys, J.prefix_depth(), J.stops(), 0.8)
    rows, tree = np.tile(np.arange(n), J.TREES), np.repeat(np.arange(J.TREES), n)
    out = {}
    for x, y, level in forest.pairs(rows, tree):
        for a, b, t, d in zip(rows[x].tolist(), rows[y].tolist(), tree[x].tolist(), level.tolist(), strict=True):
            pair = (min(a, b), max(a, b))
            assert a != b and pair not in out and tree[x[0]] >= 0
            out[pair] = (t, d)
    return out


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    sets = []
    for i in range(1500):  # 80 of 100 in common: exactly the threshold
        base = rng.integers(0, 2**60, 100)
        sets += [base[:90], np.concatenate([base[:80], base[90:]])]
    found = met(signed(sets), len(sets))
    assert sum((2 * i, 2 * i + 1) in found for i in range(1500)) >= 1498


def test_pairs_are_those_that_share_a_prefix_down_to_their_level():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**60, 60)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 12) if i % 2 else 50)) for i in range(120)]
    keys = signed(sets)
    stop_of, depth, bits = J.stops(), J.prefix_depth(), J.level_bits(J.prefix_depth())
    below = keys[:, J.TREES :].view(np.uint64) >> np.uint64(J.SIZE_BITS)
    want = {}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            need = max(stop_of[len(sets[a])], stop_of[len(sets[b])])
            if min(len(sets[a]), len(sets[b])) < 0.8 * max(len(sets[a]), len(sets[b])):
                continue
            for t in range(J.TREES):
                if keys[a, t] != keys[b, t]:
                    continue
                level = max((d for d in range(depth, J.DEEPEST + 1) if int(below[a, t]) >> (J.DEEPEST - d) * bits == int(below[b, t]) >> (J.DEEPEST - d) * bits), default=0)
                if level >= need:
                    want[a, b] = (t, level)
                    break
    assert met(keys, len(sets)) == want and len(want) > 50


def test_levels_follow_the_size_of_the_set():
    stop_of = J.stops()
    assert stop_of[-1] == J.prefix_depth() == 5 and list(stop_of[1:4]) == [8, 8, 8] and stop_of[4] == 5 and stop_of[6] == 6
    assert (stop_of[1:] >= 5).all()


def chain(rng, n):
    """Texts of which each is 0.75 alike to the next, and to no other that much."""
    long = [f"w{rng.randrange(10**9)}" for _ in range(n * 15 + 200)]
    return [" ".join(long[15 * i : 15 * i + 109]) for i in range(n)]


def test_a_chain_costs_in_proportion_to_its_length(spark):
    cost = []
    for n in (150, 1200):
        docs = spark.createDataFrame(list(enumerate(chain(random.Random(n), n))), "doc_id long, text string")
        folder = shared_dir(spark)
        one = J.signatures(docs, "doc_id", "text", J.prefix_depth()).groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        cost.append(J.memberships(saved(one, "classes", folder), 0.8, J.RECALL, folder).count())
    assert cost[0] > 150 and cost[1] < 10 * cost[0]
    got = J.jaccard_join(docs).agg(F.sum("n_links"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (0, 1200)


def test_keys_that_stand_with_several_texts(spark):
    rng = random.Random(12)
    a, b = prose(rng, 200, 9000), prose(rng, 200, 9000)
    rows = [(1, a), (1, b), (2, changed(rng, a, 0.01)), (3, changed(rng, b, 0.01)), (1, a), (4, prose(rng, 100, 9000)), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.component_id, r.kept) for r in J.jaccard_join(docs).collect())
    assert got == [(1, 2, 1, True)] * 3 + [(2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 0, 4, True)]


def test_signatures_tell_sizes():
    block = next(blocks(pa.array(["a b c d e f", "x y", "a b c d e a b c d e"])))
    hashes, at, _ = J.shingles(block)
    assert [len(np.unique(hashes[i:z])) for i, z in zip(at[:-1], at[1:], strict=True)] == [2, 1, 5]
