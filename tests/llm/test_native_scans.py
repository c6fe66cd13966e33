"""Personal data and secrets against plain regular expressions, and the pieces of the methods."""

import random
import re
import time

import pytest

from siltstone.llm.pii import KINDS, find_pii
from siltstone.llm.secret_scan import BASE_RULES, RULES, Rule, Scanner, find_secrets, trigram_query
from tests.llm.helpers import CLASHES, edge_docs


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def pii_base(text: str) -> list[tuple[int, int, str, int]]:
    """Base spans by the plain expressions."""
    out = []
    for rank, k in enumerate(k for k in KINDS if k.base):
        for m in re.finditer(k.plain, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if k.name == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k.name]
            if ok:
                out.append((m.start(), rank, k.name, m.end()))
    return sorted(out)


def random_text(rng: random.Random) -> str:
    parts = ["a", "b@c", ".", "d.e", "@", "_", "-", "+", "1", "23", "255", "256", "0", " ", "(", ")", "é", "\U0001f600", "x@y.z", "4111 1111 1111 1111", "1.2.3.4", "+1 (202) 555-0143", "DE89370400440532013000", "123-45-6789", "ssn ", "\n", "card "]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_pii_matches_plain_expressions(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(1500)]
    got = {r.doc_id: r.pii for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).collect()}
    base = {k.name for k in KINDS if k.base}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end, s.value) for s in got[i] if s.kind in base] == [(s, k, e, t[s:e]) for s, _, k, e in pii_base(t)], t
        assert [s.start for s in got[i]] == sorted(s.start for s in got[i])


def test_pii_checksums_and_context(spark):
    texts = ["IBAN DE89370400440532013000.", "IBAN DE89370400440532013001.", "ssn 123-45-6789", "part 123-45-6789", "1123-45-67899", "call +1 202 555 0143", "v +12025550143"]
    got = [[(s.kind, round(s.score, 3)) for s in r.pii] for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == [("iban", 1.0)] and got[1] == [] and got[2] == [("ssn", 0.6)] and got[3] == [] and got[4] == []
    assert got[5] == [("phone", 0.9)] and got[6] == [("phone", 0.6)]


def test_pii_long_runs_are_linear(spark):
    texts = ["1 2 3 4 " * 30_000, "9" * 200_000, "a" * 300_000 + "@", "1.2.3.4 " * 20_000, "+1" + " " * 100_000, "a@b.c" + ".c" * 50_000]
    got = [len(r.pii) for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [0, 0, 0, 20_000, 0, 1]


@pytest.mark.parametrize("find,output", [(find_pii, "pii"), (find_secrets, "secrets")])
def test_edges(spark, find, output):
    docs = edge_docs(spark)
    out = find(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and set(out.columns) == {"doc_id", "text", *CLASHES}
    assert all(r[output] == [] for r in rows if r.doc_id in (None, 0, 1, 2))
    assert find(docs.limit(0)).count() == 0


def secrets_plain(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    for rank, r in enumerate(BASE_RULES):
        for m in re.finditer(r.pattern, text, re.I | re.A if r.ignore_case else 0):
            if m.end(r.group) - m.start(r.group) >= r.min_len:
                out.append((m.start(), rank, r.kind, m.end()))
    return sorted(out)


def test_secrets_match_plain_expressions(spark):
    rng = random.Random(4)
    parts = ["token", "Api_Key", "apikey", "PASSWD", "secret", '"', "'", " ", ":", "=", "= ", "abc123", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "deadbeef", "é", "\U0001f600", "\n", "x", "ghp_" + "a" * 36]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    got = {r.doc_id: r.secrets for r in find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).collect()}
    base = {r.kind for r in BASE_RULES}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in got[i] if s.kind in base] == [(s, k, e) for s, _, k, e in secrets_plain(t)], t


def test_trigram_queries_hold_for_every_match():
    def holds(q, text: str) -> bool:
        if q is True:
            return True
        if isinstance(q, bytes):
            return q in text.lower().encode()
        return (all if q[0] == "and" else any)(holds(x, text) for x in q[1:])

    samples = {"assign": ["password=abcdef", "API_KEY: 'x1y2z3'", "apikey=aaaaaa"], "access": ["AKIA" + "A" * 16], "hex": ["0" * 24], "github": ["ghs_" + "Z" * 40], "slack": ["xoxb-1234567890"], "private_key": ["-----BEGIN RSA PRIVATE KEY-----"], "jwt": ["eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 5], "url_login": ["https://me:pw@"]}
    for r in RULES:
        q = trigram_query(r)
        assert (q is True) == (r.kind == "hex")
        for s in samples[r.kind]:
            assert r.compiled().search(s.encode()) and holds(q, f"..{s}..")
            assert q is True or not holds(q, "nothing of the kind")
    assert trigram_query(Rule("x", "ab+c?d")) is True
    assert trigram_query(Rule("x", "(abc|de[fg]h)xyz")) is not True
    assert Scanner(RULES).slots


def test_walks_find_what_the_patterns_find():
    rng = random.Random(5)
    parts = ["eyJ", "eyJ", ".", ".", "a" * 5, "b" * 7, "-_", " ", "é", "eyJ" + "c" * 10 + "." + "d" * 10 + ".", "eeyJ"]
    for rule in (r for r in RULES if r.walk):
        for _ in range(20_000):
            text = "".join(rng.choices(parts, k=rng.randrange(1, 14))).encode()
            plain = [m.span() for m in re.finditer(rule.pattern.encode(), text)]
            assert list(rule.matches(rule.compiled(), text)) == plain, text


def test_long_runs_take_time_in_proportion():
    # Beginning anew at each of the 700,000 places would take hours.
    for text in (b"eyJ" * 700_000, (b"eyJ" * 5 + b".") * 100_000 + b" "):
        began = time.monotonic()
        found = [list(r.matches(r.compiled(), text)) for r in RULES if r.kind == "jwt"]
        assert time.monotonic() - began < 20
        assert all(e - s > 20 for spans in found for s, e in spans)
