"""Near duplicates of embeddings and texts against brute force, and connected components."""

import random

import numpy as np
import pytest

from siltstone.llm import embedding_dedup as E
from siltstone.llm import jaccard_join as J
from siltstone.llm.components import components as connected
from siltstone.llm.components import labels
from siltstone.llm.frames import saved
from tests.llm.helpers import changed, components, edge_docs, edge_texts, prose, words


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((60, 40), (200, 150), (40, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(0, n // 3)]
        got = {r.node: r.root for r in connected(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
        want = components(range(n), links)
        touched = {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: want[x] for x in touched}
        if links:
            a, b = np.array(links).T
            assert labels(a, b, n).tolist() == [want[x] for x in range(n)]
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(rng, n, dim, spread):
    base = rng.standard_normal(dim)
    return [base + spread * np.linalg.norm(base) / np.sqrt(dim) * rng.standard_normal(dim) for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 40])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vectors = [*rng.standard_normal((150, 32))]
    for n, spread in ((60, 0.15), (10, 0.22), (2, 0.05), (3, 0.24)):
        vectors += near_copies(rng, n, 32, spread)
    vectors += [vectors[5]] * 30 + [3 * vectors[6], vectors[7] * -1]
    order = np.random.default_rng(1).permutation(len(vectors))
    vectors = [vectors[i] for i in order]
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, vectors[5][:16].tolist(), (2 * vectors[5][:16]).tolist()]
    rows = [(i, [float(x) for x in v], 3) for i, v in enumerate(vectors)] + [(1000 + i, v, 3) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")
    got = {r.vec_id: r for r in E.near_duplicates(df, block=block).collect()}
    u = np.stack(vectors)
    u /= np.linalg.norm(u, axis=1)[:, None]
    cos = u @ u.T
    assert not ((cos > 0.95 - 1e-9) & (cos < 0.95 + 1e-9)).any()
    links = [(i, j) for i, j in np.argwhere(cos >= 0.95).tolist() if i < j] + [(1006, 1007)]
    root = components(list(got), links)
    count = {k: 0 for k in got}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (count[k], root[k], root[k] == k) for k in got}
    assert len(links) > 1500


def test_embedding_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in E.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert E.near_duplicates(df.limit(0)).count() == 0
    assert E.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 1


def test_recall_is_calibrated():
    assert E.least_collisions(0.9999) == 12
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * side
    found = sum(len(E.linked(np.stack([x, y]), None, 0.95, E.WINDOW * np.sqrt(0.1), 12)[0]) for x, y in zip(a[:400], b[:400], strict=True))
    assert found >= 398
    shared = 1 - (1 - 0.8 ** J.prefix_depth()) ** J.TREES
    assert shared >= J.RECALL > 1 - (1 - 0.8 ** (J.prefix_depth() + 1)) ** J.TREES


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_jaccard(texts):
    sets = [shingle_set(t) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                links.append((j, i))
    return links


def corpus(rng):
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(60)] + ["one two", "One, two!", "two one", "a b c d", ""]
    for size, share in ((40, 0.007), (12, 0.014), (6, 0.02), (2, 0.01)):
        base = prose(rng, 150)
        texts += [changed(rng, base, share) for _ in range(size)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(30)]
    texts += [texts[70]] * 25 + [texts[71].upper()] * 3
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("blocks", [(256, 500_000), (7, 2_000)])
def test_jaccard_against_brute_force(spark, blocks):
    texts = corpus(random.Random(8))
    got = {r.doc_id: r for r in J.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_texts=blocks[0], block_words=blocks[1]).collect()}
    links = brute_jaccard(texts)
    root = components(range(len(texts)), links)
    count = [0] * len(texts)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (count[k], root[k], root[k] == k) for k in range(len(texts))}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(tuple(words(t)) or i, i)
    assert all(got[i].class_id == first[tuple(words(t)) or i] for i, t in enumerate(texts))
    assert len(links) > 800


def test_jaccard_edges(spark):
    texts = edge_texts()
    docs = edge_docs(spark, texts)
    got = J.jaccard_join(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[8].component_id == 7 and by[8].n_links == 1 and not by[8].kept and by[0].kept and by[1].n_links == 0 and by[None].kept
    assert J.jaccard_join(docs.limit(0)).count() == 0


def test_units_give_every_pair_if_asked(spark):
    texts = corpus(random.Random(9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = J.signatures(docs, "doc_id", "text", J.prefix_depth())
    one = saved(signed.groupBy("digest").agg(*(f for f in _class_columns())), "classes")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/pairs"
    pairs = {(r.a, r.b) for r in J.class_links(docs, one, "doc_id", "text", 0.8, folder, pairs=True).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(tuple(words(t)), i)
    reps = {i for w, i in first.items() if w}
    assert pairs == {(a, b) for a, b in brute_jaccard(texts) if a in reps and b in reps}


def _class_columns():
    from pyspark.sql import functions as F

    return F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys")
