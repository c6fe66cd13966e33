"""The classifiers against naive versions, document by document, and their registered queries."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import quality, queries, toxicity
from siltstone.llm.arrays import blocks
from tests.llm.helpers import edge_texts, prose

SF = "/root/testdata/sf0.001"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def samples():
    rng = random.Random(4)
    junk = "".join(rng.choice("aB3,. \n!?é-xyz;:#") for _ in range(6000))
    return [t or "" for t in edge_texts()] + [junk, prose(rng, 700), "Bad WORD WORD word!! ok?? end.\nNext Line", "x" * 30 + " " + "Aa" * 6]


def naive_passage(tokens, line_feeds, span):
    """The 18 numbers of a passage, from its tokens as bytes."""
    n, chars = len(tokens), max(1, sum(map(len, tokens)))
    kind = lambda t, ok: sum(map(ok, t))
    upper = [kind(t, lambda c: 65 <= c < 91) for t in tokens]
    lower = [kind(t, lambda c: 97 <= c < 123) for t in tokens]
    digit = [kind(t, lambda c: 48 <= c < 58) for t in tokens]
    wide = [kind(t, lambda c: c >= 128) for t in tokens]
    mark = [len(t) - u - l - d - w for t, u, l, d, w in zip(tokens, upper, lower, digit, wide, strict=True)]
    letters = max(1, sum(upper) + sum(lower) + sum(wide))
    stop = [t[-1] in b".,;:" for t in tokens]
    is_mark = lambda c: c > 32 and c < 128 and not chr(c).isalnum()
    odd = [is_mark(t[-1]) and not s for t, s in zip(tokens, stop, strict=True)]
    mean = lambda x: sum(x) / n
    return [
        np.log1p(n) / 4, chars / n / 10, sum(upper) / letters, sum(digit) / chars, sum(mark) / chars, sum(wide) / letters,
        mean([u > 1 and l == 0 for u, l in zip(upper, lower, strict=True)]), mean(odd), mean([o and len(t) > 2 and t[-1] == t[-2] for o, t in zip(odd, tokens, strict=True)]),
        mean([m == len(t) for m, t in zip(mark, tokens, strict=True)]), None, len(set(tokens)) / n, mean(stop), mean([len(t) <= 3 for t in tokens]), mean([len(t) >= 10 for t in tokens]),
        mean([len(t) >= 24 for t in tokens]), mean([u > 0 and l > 0 for u, l in zip(upper, lower, strict=True)]), 10 * line_feeds / max(1, span),
    ]


def naive_passages(text):
    found = list(re.finditer(rb"[^\x00-\x20]+", text.encode()))
    raw = text.encode()
    if not found:
        return [[0.0] * quality.FEATURES]
    out = []
    for i in range(0, len(found), quality.PASSAGE):
        own = found[i : i + quality.PASSAGE]
        a, z = own[0].start(), own[-1].end()
        row = naive_passage([m[0] for m in own], raw[a:z].count(b"\n"), z - a)
        before = [found[i - 1][0] if i else None] + [m[0] for m in own[:-1]]
        row[10] = sum(m[0] == p for m, p in zip(own, before, strict=True)) / len(own)
        out.append(row)
    return out


def test_passages_by_definition():
    texts = samples()
    for size in (1 << 20, 64):
        for block in blocks(pa.array(texts), size):
            x, at = quality.passages(block)
            for i in range(block.rows):
                want = np.array(naive_passages(texts[block.first + i]))
                assert np.allclose(x[at[i] : at[i + 1]], want, atol=1e-5), (block.first + i, np.argwhere(~np.isclose(x[at[i] : at[i + 1]], want, atol=1e-5))[:3])


def test_attention_by_definition_and_gradients():
    rng = np.random.default_rng(2)
    at = np.array([0, 3, 4, 9])
    x, y = rng.standard_normal((9, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    net = quality.train(x, at, y, steps=3)
    w = net.weights
    for i in range(3):
        h = [np.tanh((v - w["mean"]) / w["spread"] @ w["W"] + w["b"]) for v in x[at[i] : at[i + 1]]]
        gate = np.array([(np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"])))) @ w["a"] for v in h])
        weight = np.exp(gate) / np.exp(gate).sum()
        logit = sum(a * v for a, v in zip(weight, h, strict=True)) @ w["c"] + w["d"][0]
        assert np.isclose(net.score(x, at)[i], 1 / (1 + np.exp(-logit)))
    loss = lambda: float(np.sum(np.logaddexp(0, net.forward(x, at)[0]) - y * net.forward(x, at)[0]))
    grad = net.gradient(x, at, y)
    for name in ("W", "b", "V", "U", "a", "c", "d"):
        value = w[name]
        place = tuple(rng.integers(0, s) for s in value.shape)
        keep, step = value[place], 1e-5
        value[place] = keep + step
        up = loss()
        value[place] = keep - step
        down = loss()
        value[place] = keep
        assert np.isclose(grad[name][place], (up - down) / (2 * step), atol=1e-5), name


def test_training_in_runs_is_training_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 40))])
    x, y = rng.standard_normal((at[-1], quality.FEATURES)), (rng.random(40) < 0.5).astype(float)
    whole = quality.train(x, at, y, steps=20)
    monkeypatch.setattr(quality, "TILE", 7)
    assert all(np.allclose(whole.weights[k], v) for k, v in quality.train(x, at, y, steps=20).weights.items())


def test_a_very_long_labelled_text_is_learnt_from_whole(spark):
    good, bad = "A plain sentence, with an end. " * 4, "ZZZ### 999 !!! "
    rows = [(i, good * 20) for i in range(40)] + [(100 + i, good * 20_000 + bad * 4000 if i else bad * 40) for i in range(2)] + [(200 + i, bad * 40) for i in range(38)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k < 100 else 0) for k, _ in rows], "doc_id long, quality int")
    net = quality.fit(docs, labels)
    found = {r.doc_id: r.score for r in quality.score(docs, net, keep=["doc_id"]).collect()}
    assert all(found[k] > 0.7 for k in range(40)) and all(found[200 + i] < 0.7 for i in range(38)) and found[101] < 0.7


def test_convolutions_by_definition():
    texts = samples()
    rng = np.random.default_rng(6)
    features = [(f.rows[f.at[i] : f.at[i + 1]]) for b in blocks(pa.array(texts)) for f in [toxicity.features(b)] for i in range(b.rows)]
    small = [f for f in features if len(f) < 1200]
    y = (np.arange(len(small)) % 2).astype(float)
    net = toxicity.train(small, y, epochs=1)
    net.filters += rng.standard_normal(net.filters.shape).astype(np.float32) * 0.1
    got = net.forward(np.concatenate(small), np.concatenate([[0], np.cumsum([len(f) for f in small])]))[0]
    for rows, logit in zip(small, got, strict=True):
        words = [net.table[r].sum(0) for r in rows] + [np.zeros(toxicity.DIM)] * 3
        pooled, column = [], 0
        for width in toxicity.WIDTHS:
            filters = net.filters[:, column : column + width * toxicity.FILTERS]
            column += width * toxicity.FILTERS
            tops = [sum(words[p + j] @ filters[:, j * toxicity.FILTERS : (j + 1) * toxicity.FILTERS] for j in range(width)) for p in range(max(1, len(rows)))]
            pooled += list(np.max(tops, 0))
        assert np.isclose(np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.shift, logit, atol=1e-3)


@pytest.mark.parametrize("name,folds,part,label", [("op6_quality", 4, 2, "quality"), ("op8_toxicity", 3, 1, "toxic")])
def test_registered_queries(spark, name, folds, part, label):
    found = queries.queries()[name](spark, SF).collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in found) == sorted(docs)
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == part) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    told = [(r.predicted, known[r.doc_id]) for r in found if r.doc_id in known]
    assert np.mean([p == y for p, y in told]) > 0.85


def test_sums_over_many_matches(spark):
    from siltstone.llm.pii import find_pii

    text = "é call +12 345 678 901 now " * 9000
    got = find_pii(spark.createDataFrame([(text,)], "text string")).first().pii
    want = [(m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)]
    assert [(s.start, s.end) for s in got if s.kind == "phone"] == want and len(want) == 9000
