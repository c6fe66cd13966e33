"""Toxic texts found, and clean ones marked, in each language of the held-out fold."""

from pyspark.sql import functions as F

from siltstone.llm import toxicity
from siltstone.llm.labelled import fold

DATA = "/root/testdata/sf0.1"


def test_toxicity_by_language(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id", "lang"]).join(labels, "doc_id")
    rows = scored.where((fold(F.col("doc_id"), 3) == 1) & F.col("toxic").isNotNull()).select("lang", "toxic", (F.col("score") >= toxicity.CUT).alias("hit")).collect()
    got = {}
    for r in rows:
        n = got.setdefault((r.lang, r.toxic), [0, 0])
        n[0] += r.hit
        n[1] += 1
    assert got["en", 1][0] / got["en", 1][1] > 0.9 and got["en", 0][0] == 0
    # Languages with few labels have a cut of their own that finds most of theirs.
    for lang in ("fr", "de", "es"):
        assert got[lang, 1][0] / got[lang, 1][1] >= 0.8 and got[lang, 0][0] / got[lang, 0][1] < 0.05
