"""The pipeline's stages against brute-force versions, its contract, and the queries against their SQL."""

import base64
import hashlib
import os

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import quality, queries
from tests.llm.helpers import components
from tests.llm.test_decontaminate import brute
from tests.llm.test_links import brute_jaccard
from tests.llm.test_tokens_lines_warc import brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage as lists of rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_contract(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "tokens"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages):
    net = quality.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(stages[0], net).where(F.col("score") >= quality.CUT).collect()}
    assert rows(stages[1]) == {k: r for k, r in rows(stages[0]).items() if k in kept}


def test_lines_stage(stages):
    before = rows(stages[1])
    want = brute_lines([(k, r.text) for k, r in before.items()])
    got = rows(stages[2])
    for k, (text, _, dropped) in want.items():
        if dropped and not (text or "").strip():
            assert k not in got
        else:
            assert got[k].text == text and got[k].n_chars == (len(text) if dropped else before[k].n_chars)
    assert set(got) <= set(want)


def test_near_duplicate_stage(stages):
    before = sorted(rows(stages[2]).items())
    texts = [r.text for _, r in before]
    root = components(range(len(texts)), brute_jaccard(texts))
    assert set(rows(stages[3])) == {k for i, (k, _) in enumerate(before) if root[i] == i}


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows(stages[4])) == {k for k, r in rows(stages[3]).items() if not brute(r.text, items)[1]}


def test_token_stage(stages):
    path, pattern = queries.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts, got = rows(stages[4]), rows(stages[5])
    assert set(texts) == set(got)
    for k, r in got.items():
        ids = enc.encode_ordinary(texts[k].text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[k].text or "").encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1])


def test_stages_on_awkward_documents(spark):
    docs = spark.createDataFrame([(1, "", "en", "s", 0), (2, None, None, None, None), (None, "no id", "en", "s", 5), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars int")
    for name, f in corpus_pipeline.STAGES:
        if name == "quality":
            continue  # it may reject these
        out = f(spark, docs, SF)
        assert out.count() <= 5 and f(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in os.listdir(SF):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{SF}/{p}'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want))


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
