"""Benchmark decontamination against brute force."""

import random

import numpy as np
import pytest

from siltstone.llm.arrays import grams
from siltstone.llm.decontaminate import decontaminate, winnow
from tests.llm.helpers import CLASHES, edge_docs, prose, words


def brute(text, items, span=10):
    w = words(text)
    hit, ids = set(), set()
    for i, t in items:
        v = words(t)
        n = min(span, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p : p + n]) in wins:
                hit.update(range(p, p + n))
                ids.add("null" if i is None else str(i))
    return len(w), len(hit), sorted(ids), hit


def check(spark, docs, items, **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate(d, b, keep=["doc_id"], **kw).collect():
        n, h, ids, hit = brute(docs[r.doc_id], items, kw.get("span", 10))
        assert (r.n_words, r.n_hit, r.item_ids) == (n, h, ids), docs[r.doc_id]
        spans = list(zip(r.hit_spans[::2], r.hit_spans[1::2], strict=True))
        assert {x for a, z in spans for x in range(a, z)} == hit and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])  # one broadcast block, many passes
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 25]), 60)) for i in range(25)] + [(99, None), (7, prose(rng, 12, 60)), (None, "an item without id but with some more words than ten in it")]
    docs = [None, "", "one"]
    for _ in range(150):
        parts = [prose(rng, rng.randint(0, 30), 60)]
        for _ in range(rng.randint(0, 3)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(v) + 1)
            parts += [" ".join(v[a : a + rng.randint(1, 25)]).upper(), prose(rng, rng.randint(0, 6), 60)]
        docs.append("  ".join(parts))
    docs += [docs[-1], docs[-1]]
    check(spark, docs, items, block_bytes=block_bytes)


def test_items_without_words_and_no_items(spark):
    check(spark, ["a b c", ""], [(1, ""), (2, None), (3, "!!")])
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(d, empty).collect()[0].n_hit == 0


def test_shared_passage_in_many_items_and_documents(spark):
    passage = "the very same passage of words that a great many of the items have in common"
    check(spark, [f"x{i} {passage} y{i}" for i in range(60)], [(i, f"q{i} {passage} r{i}") for i in range(60)])


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 50, 10).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 50, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 50, 7).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 50, rng.integers(0, 20)).astype(np.uint64), shared])
        kept = [{int(grams(x, 5)[p]) for p in winnow(grams(x, 5), np.full(len(x), len(x)), 5, 10)} for x in (a, b)]
        assert kept[0] & kept[1]


def test_edges(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, "same text here"), (2, "word5 and word6 and word7 and word8 and word9 and")], "item_id long, text string")
    out = decontaminate(docs, items)
    assert out.count() == docs.count() and set(out.columns) == {"doc_id", "text", *CLASHES}
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].n_words == 0 and got[7].item_ids == ["1"] and got[6].item_ids == ["2"]
    assert decontaminate(docs.limit(0), items).count() == 0
    pre = decontaminate(docs, items, prefix="x_")
    assert set(pre.columns) == {*docs.columns, "x_n_words", "x_n_hit", "x_hit_spans", "x_item_ids"}
