"""Inputs and brute-force versions that the tests of the training-data operators share."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use themselves, as extra columns of the input.
CLASHES = ["pii", "secrets", "ids", "decoded", "score", "n_words", "n_hit", "hit_spans", "item_ids", "n_lines", "n_dropped", "kept", "k", "t", "id", "rep", "digest", "_t", "_k", "_text", "a.b"]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def edge_texts() -> list[str | None]:
    """Null, empty, blank, short, non-ASCII, control characters, one very long, repeated ones."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    return [None, "", " \n\t ", "x", "éü \U0001f600 ß", "\x00\x01 a\x00b", long, "same text here", "same text here", "\n\n\n", "a" * 50_000, "1 " * 3000, "=" * 2000 + "\n" + "é" * 4000]


def edge_docs(spark, texts=None, clash: bool = True):
    """The texts with ids, among them a repeated and a null one, and clashing columns."""
    texts = edge_texts() if texts is None else texts
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, "row without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(7).alias(c) for c in CLASHES))
    return df


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    """n random words."""
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def changed(rng: random.Random, text: str, share: float) -> str:
    """The text with a share of its words replaced."""
    out = text.split()
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = f"new{rng.randrange(10_000)}"
    return " ".join(out)


def components(nodes, links) -> dict:
    """Least reachable node of every node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}
