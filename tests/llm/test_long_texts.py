"""The registered token query against the tokenizer itself, with texts of over a million characters."""

import base64
import hashlib
import random

import numpy as np
import tiktoken

from siltstone.llm.queries import op4_bpe, vocabulary
from tests.llm.helpers import prose


def test_registered_query_on_long_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "short", prose(rng, 6_000, 90_000), " ".join(prose(rng, 25_000, 90_000) for _ in range(7)), "a" * 70_000, "x " + " " * 80_000 + "y\n" * 9_000, "é\U0001f600ß " * 30_000]
    texts += [texts[4]] * 2 + [prose(rng, rng.randint(0, 50)) for _ in range(40)]
    assert max(len(t or "") for t in texts) > 1_000_000
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in op4_bpe(spark, f"file://{tmp_path}").collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
