"""A corpus pipeline of five stages: quality, lines, near duplicates, benchmark leaks, tokens.

Every stage is a function of (spark, docs, sf_dir) and works on what its predecessor kept; ``run`` writes
each stage's result as Parquet in the shared folder and reads it again for the next. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import quality
from siltstone.llm.decontaminate import decontaminate
from siltstone.llm.frames import fresh, named, shared_dir
from siltstone.llm.jaccard_join import jaccard_join
from siltstone.llm.line_dedup import dedup_lines
from siltstone.llm.queries import encoded_digests


def _same(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order."""
    return df.select(*(named(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labelled rows of docs outside the held-out fold."""
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=4, held_out=2)
    score = fresh(docs, "_score")
    return _same(quality.score(docs, net, output=score).where(named(score) >= quality.CUT), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; one of which nothing is left goes.

    ``n_chars`` is counted anew where lines were dropped.
    """
    p = fresh(docs, "_d")
    found = dedup_lines(docs, keep=docs.columns, prefix=p)
    left, dropped = named(f"{p}text"), named(f"{p}n_dropped")
    found = found.where((dropped == 0) | F.coalesce(left, F.lit("")).rlike(r"[^\x00-\x20]"))
    changed = {"text": left, "n_chars": F.when(dropped > 0, F.length(left)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": left}
    return _same(found.withColumns(changed), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id."""
    kept = jaccard_join(docs).where("kept").select(F.col("doc_id").alias(k := fresh(docs, "_k")))
    # Rows that share a doc_id stay or go together; null ids are never grouped.
    return _same(docs.join(kept.where(F.col(k).isNotNull()).distinct(), named("doc_id") == F.col(k), "left").where(F.col(k).isNotNull() | named("doc_id").isNull()), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    p = fresh(docs, "_c")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix=p)
    return _same(found.where(named(f"{p}n_hit") == 0), docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each text's tokens, and the digest of what they decode to."""
    return encoded_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", encode_and_decode),
]

#: SQL can't express the classifier or the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pipeline as a registered query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """No SQL: see ``ORACLE_SQL``."""
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
