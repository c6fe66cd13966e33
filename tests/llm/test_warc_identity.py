"""Records of rows that share keys, payloads or both, and of rows without a key."""

import hashlib
import base64
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import warc
from siltstone.llm.frames import shared_dir
from tests.llm.helpers import CLASHES, prose


def written(spark, rows, **options):
    folder = shared_dir(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(7).alias(c) for c in [*CLASHES, "key", "sha", "head", "again", "body"]))
    warc.write_warc(df.repartition(3), folder, **options)
    return warc.read_warc(spark, folder).collect()


@pytest.mark.parametrize("told_rows", [warc.TOLD_ROWS, 0])
def test_rows_that_share_keys_and_payloads(spark, told_rows):
    rng = random.Random(3)
    long, other = prose(rng, 16_000), prose(rng, 15_000)
    rows = [(1, "u", long), (1, "u", long), (1, "u", other), (1, "u", "aaa"), (1, "u", "bbb"), (5, "u", "aaa"), (5, "u", "ccc"), (4, "u", "ccc"), (4, "u", "ccc")]
    found = written(spark, rows, told_rows=told_rows)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    last = {}
    for k, _, t in rows:
        last[t] = max(k, last.get(t, k))
    want = sorted((k, digest(t), len(t), "response" if last[t] == k else "revisit", -1 if last[t] == k else last[t], t if last[t] == k else "") for k, _, t in rows)
    assert sorted((r.key, r.payload_digest, r.payload_bytes, r.record_type, -1 if r.refers_to is None else r.refers_to, bytes(r.payload or b"").decode()) for r in found) == want


def test_rows_without_a_key(spark):
    rows = [(None, "u", "x" * 90_000), (None, "v", "x" * 90_000), (None, "u", "y"), (3, "u", "y"), (None, None, None)]
    found = written(spark, rows, null_keys=True)
    told = sorted((r.key or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in found)
    assert told == [(0, "response", 0, 0), (0, "response", 0, 90_000), (0, "response", 0, 90_000), (0, "revisit", 3, 1), (3, "response", 0, 1)]


def test_names_of_other_writers(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    (tmp_path / "a.warc.gz").write_bytes(warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:12345678-0000-0000-0000-000000000000>")], block) + warc.END)
    assert [(r.key, bytes(r.payload)) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()] == [(None, b"hello")]
