"""Lines that recur anywhere, short or in two documents only, against brute force; what doesn't recur stays."""

import random
import re

from siltstone.llm.line_dedup import DEPTH, dedup_lines
from tests.llm.helpers import edge_docs, prose


def brute_whole(docs, min_docs=3, share=0.75, min_same=2):
    """Cleaned texts by the definition of ``recurring_whole``."""
    places, docs_of, support = {}, {}, {}
    for key, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            if w := tuple(re.findall(r"[^\x00-\x20]+", line)):
                places.setdefault(w, []).append((key, n))
                docs_of.setdefault(w, set()).add(key)
    fields = {w: tuple(None if re.search("[0-9]", t) else t for t in w) for w in docs_of}
    leaf = {w: (len(w), f[:DEPTH]) for w, f in fields.items()}
    for w, f in fields.items():
        for p, t in enumerate(f):
            support.setdefault((leaf[w], p, t), set()).update(docs_of[w])
    group, members = {}, {}
    for w, f in fields.items():
        mask = tuple(t if t is not None and (p < DEPTH or len(support[leaf[w], p, t]) >= min_docs) else None for p, t in enumerate(f))
        if sum(t is not None for t in mask) >= share * len(w):
            group[w] = mask
            members.setdefault(mask, []).append(w)
    gone = set()
    for w in docs_of:
        own = members.get(group.get(w), [])
        if len(set().union(*(docs_of[x] for x in own))) >= min_docs:
            head = min(p for x in own for p in places[x])
        elif len(docs_of[w]) >= min_same:
            head = min(places[w])
        else:
            continue
        gone.update(p for p in places[w] if p != head)
    return {key: "\n".join(x for n, x in enumerate(text.split("\n")) if (key, n) not in gone) for key, text in docs}


def cleaned(spark, docs):
    return {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), whole=True).collect()}


def test_a_line_in_two_documents_goes_once(spark):
    line = "planted " + " ".join(f"word{c}" for c in "abcdefgh" * 8)
    assert cleaned(spark, [(1, f"own one\n{line}"), (2, f"{line}\nown two")]) == {1: f"own one\n{line}", 2: "own two"}


def test_lines_of_one_or_two_tokens_go(spark):
    docs = [(i, f"own {'abc'[i]} text\nLes.\nUnd äbe.\n\n今日はとても良い天気です。") for i in range(3)]
    assert cleaned(spark, docs) == {0: docs[0][1], 1: "own b text\n", 2: "own c text\n"}


def test_what_does_not_recur_stays(spark):
    numbers = [(1, "01 02 03.5"), (2, "11 12 13.5"), (3, "21 22 23.5")]
    assert cleaned(spark, numbers) == dict(numbers)
    fruit = [(1, "\n".join(f"You will need to buy {x}" for x in ("apples", "pears", "plums"))), (2, "else")]
    assert cleaned(spark, fruit) == dict(fruit)
    # Two passages of one leaf have a head each.
    a, b = "it was said of old that the sea rose", "it was said of young men who never slept"
    assert cleaned(spark, [(1, a), (2, f"{a}\n{b}"), (3, f"{b}\nend")]) == {1: a, 2: b, 3: "end"}


def test_whole_lines_against_brute_force(spark):
    rng = random.Random(16)
    pool = [prose(rng, rng.randint(1, 12), 30) for _ in range(25)] + ["a b", "x", "7 8 9"]
    docs = []
    for i in range(200):
        own = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.randint(0, 12), 6) for _ in range(rng.randint(1, 6))]
        text = re.sub(r"w(\d+)", lambda m: "w" + "".join(chr(97 + int(c)) for c in m[1]), "\n".join(own))
        docs.append((i, text + f"\nReport number {rng.randrange(50)} of the daily news service " + rng.choice(["am", "pm", f"at {i}"])))
    # Templates that one document makes up in part.
    docs += [(300 + i, "\n".join(f"to be had here only {c} with the rest" for c in ("abc", "de", "fgh", "a", "i")[i])) for i in range(5)]
    want = brute_whole(docs)
    assert cleaned(spark, docs) == want
    assert sum(want[k] != t for k, t in docs) > 100


def test_whole_edges(spark):
    docs = edge_docs(spark)
    rows = {r.doc_id: r for r in dedup_lines(docs, whole=True).collect()}
    assert rows[0].text is None and rows[None].text == "row without an id" and rows[9].text == "\n\n\n"
    assert dedup_lines(docs.limit(0), whole=True).count() == 0
