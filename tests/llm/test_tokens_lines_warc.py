"""Tokens against the tokenizer itself, lines against brute force, archives by round trip."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken

from siltstone.llm import bpe, warc
from siltstone.llm.frames import shared_dir
from siltstone.llm.line_dedup import DEPTH, dedup_lines
from siltstone.llm.queries import vocabulary
from tests.llm.helpers import CLASHES, edge_docs, edge_texts, prose

PATH, PATTERN = vocabulary()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "é", "'s", "'", "1", "!!", "aaaa   ", "\t", "ß", "xxxxx", "s", "\U0001f600", "'re", "<|endoftext|>", "don't", " 12 "]


def test_stitching_in_one_process(reference):
    codec, rng = bpe.Codec(bpe.read_ranks(PATH), PATTERN), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80)))
        ids = bpe.encode_text(text, codec, rng.randint(4, 16), rng.randint(1, 6))
        assert ids.tolist() == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("chunk,overlap,deal", [(bpe.CHUNK, bpe.OVERLAP, bpe.DEAL), (40, 8, 40), (12, 2, 60)])
def test_encode_and_decode(spark, reference, chunk, overlap, deal):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += [texts[3]] * 20 + ["", None, " " * 100, "a" * 200, "\n" * 90 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = bpe.encode(df, PATH, PATTERN, keep=["doc_id"], chunk=chunk, overlap=overlap, deal=deal)
    rows = bpe.decode(found.withColumn("list", bpe.unpack(found.ids)), PATH).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        want = reference.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want == r.list and bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_token_edges(spark, reference):
    docs = edge_docs(spark)
    out = bpe.encode(docs, PATH, PATTERN)
    assert set(out.columns) == set(docs.columns) and out.count() == docs.count()
    texts = edge_texts()
    for r in out.where("doc_id IS NOT NULL").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(texts[r.doc_id] or "")
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def brute_lines(docs, min_docs=3, share=0.75):
    """Cleaned texts by the definition: docs is a list of (key, text)."""
    every = []
    for key, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            w = tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x00-\x20]+", line))
            if len(w) >= 3:
                every.append((key, n, (len(w), *w[:DEPTH]), w))
    docs_of, places = {}, {}
    for key, n, leaf, w in every:
        docs_of.setdefault((leaf, w), set()).add(key)
        places.setdefault((leaf, w), []).append((key, n))
    support = {}
    for (leaf, w), keys in docs_of.items():
        for p, t in enumerate(w):
            support[leaf, p, t] = support.get((leaf, p, t), 0) + len(keys)
    fits = {k for k in docs_of if sum(support[k[0], p, t] >= min_docs for p, t in enumerate(k[1])) >= share * len(k[1])}
    total, head = {}, {}
    for leaf, w in fits:
        total[leaf] = total.get(leaf, 0) + len(docs_of[leaf, w])
        head[leaf] = min(head.get(leaf, min(places[leaf, w])), min(places[leaf, w]))
    gone = {(k, n) for k, n, leaf, w in every if (leaf, w) in fits and total[leaf] >= min_docs and (k, n) != head[leaf]}
    out = {}
    for key, text in docs:
        lines = (text or "").split("\n")
        left = [x for n, x in enumerate(lines) if (key, n) not in gone]
        out[key] = (text if len(left) == len(lines) else "\n".join(left), len(lines) if text else 0, len(lines) - len(left))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    pool = [prose(rng, rng.randint(1, 12), 30) for _ in range(25)] + ["Posted by Ann on 2024-01-02 at 10:00", "Posted by Bob on 2023-11-30 at 9:15", "© all rights reserved", "a b", "x"]
    docs = []
    for i in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.randint(0, 12), 30) for _ in range(rng.randint(0, 6))]
        lines = [re.sub(r"w\d+$", f"w{rng.randrange(5)}", x) if rng.random() < 0.2 else x for x in lines]
        docs.append((i, "\n".join(lines).replace("w", "v", rng.randint(0, 1))))
    # Words without digits, so that not all are fields.
    docs = [(k, re.sub(r"([wv])(\d+)", lambda m: m[1] + "".join(chr(97 + int(c)) for c in m[2]), t)) for k, t in docs]
    docs += [(200 + i, f"first line of {i}\nPosted by Eve on 2022-{i:02d}-01 at 1:{i:02d}\n" + docs[3][1]) for i in range(20)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_lines(docs)
    assert {k: (r.text, r.n_lines, r.n_dropped) for k, r in got.items()} == want
    assert sum(x[2] for x in want.values()) > 100


def test_line_fields_generalise(spark):
    docs = [(i, f"Report number {i} of the daily news service\nown words {'abcdefghij'[i]} here and nothing else") for i in range(6)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped >= 1 and "Report" not in got[i].text for i in range(1, 6))


def test_line_edges(spark):
    docs = edge_docs(spark)
    out = dedup_lines(docs)
    assert set(out.columns) == {"doc_id", "text", *CLASHES} and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text is None and rows[0].n_lines == 0 and rows[1].text == "" and rows[None].text == "row without an id" and rows[9].text == "\n\n\n"
    assert dedup_lines(docs.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rng = random.Random(7)
    bodies = [None, "", "x", "é" * 5000, "WARC/1.1\r\n\r\n\r\n", prose(rng, 20_000), "0\r\n\r\n", "a\x00b"] + [prose(rng, rng.randint(0, 3000)) for _ in range(40)]
    bodies += [bodies[5]] * 6 + [bodies[2]] * 3
    rows = [(i, None if i % 7 == 0 else f"http://h/{i}\r\n", b) for i, b in enumerate(bodies)]
    folder = shared_dir(spark)
    warc.write_warc(pages(spark, rows).repartition(5), folder, segment_bytes=700)
    got = {r.key: r for r in warc.read_warc(spark, folder).collect()}
    last = {}
    for i, b in enumerate(bodies):
        last[(b or "").encode()] = i
    for i, b in enumerate(bodies):
        raw, r = (b or "").encode(), got[i]
        head = last[raw]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if head == i else ("revisit", head))
        assert (bytes(r.payload) if r.payload is not None else None) == (raw if head == i else None)
        assert r.url == ("" if i % 7 == 0 else f"http://h/{i}")
    assert len(got) == len(bodies)


def test_warc_small_payloads_are_all_responses(spark):
    folder = shared_dir(spark)
    warc.write_warc(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), folder, min_bytes=3)
    assert {r.key: r.refers_to for r in warc.read_warc(spark, folder).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_warc_edges(spark):
    folder = shared_dir(spark)
    warc.write_warc(pages(spark, []), folder)
    assert warc.read_warc(spark, folder).count() == 0
    with pytest.raises(Exception, match="without a key"):
        warc.write_warc(pages(spark, [(None, "u", "x")]), folder)


def test_warc_framing_is_checked():
    for body in (b"", b"a" * 20_000, b"0\r\n\r\n"):
        assert warc.unchunked(warc.chunked(body, 7)) == body
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\ntrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    records = [r + warc.END for k in (1, 2) for r in warc.records_of(k, "u", b"p" * 50 * k, None, 64)]
    raw = b"".join(records)
    for packed in (raw, gzip.compress(raw), b"".join(map(gzip.compress, records))):
        assert [r.headers["warc-type"] for r in warc.parse(packed)].count("response") == 2
    with pytest.raises(ValueError):
        list(warc.parse(raw[:-3]))


def test_warc_missing_segment_is_an_error(spark, tmp_path):
    records = [r + warc.END for r in warc.records_of(1, "u", b"p" * 500, None, 64)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records[:2] + records[3:])))
    with pytest.raises(Exception, match="don't make up"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()
