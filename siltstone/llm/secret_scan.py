r"""Secret scanning through a trigram inverted index.

Each rule is a regular expression over bytes. From its syntax tree a Boolean query over case-folded
trigrams is derived that every match must satisfy: literals and small classes multiply into exact
strings, alternation gives OR, sequence gives AND. Texts are indexed block by block: the postings of
the needed trigrams are bit sets over the rows of a block, the query intersects and unites them, and only
candidate rows are verified by the regular expression. A rule whose query is empty (no trigram is
mandatory, as for a run of hexadecimal digits) scans every row.

Blocks are independent, so there is no shuffle, and no key or source can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.arrays import LOWER, Block, blocks
from siltstone.llm.frames import map_batches

EXACT_MAX = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and don't overlap; one whose group is shorter than min_len is dropped.

    ``walk`` is for patterns that begin again at many places of one run: it has the pattern's matches in its
    group 1, and else takes up what no match can begin in, so that a run is read a bounded number of times.
    """

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 1
    ignore_case: bool = False
    walk: str | None = None

    def compiled(self) -> re.Pattern[bytes]:
        return re.compile((self.walk or self.pattern).encode(), re.I if self.ignore_case else 0)

    def matches(self, compiled: re.Pattern[bytes], text: bytes) -> Iterator[tuple[int, int]]:
        """Start and end of every match in a text, in bytes."""
        group = 1 if self.walk else self.group
        for m in compiled.finditer(text):
            if m.end(group) >= 0 and m.end(group) - m.start(group) >= self.min_len:
                yield m.span(1 if self.walk else 0)


# The patterns of the kinds of secrets.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    # What fails from the first eyJ of a run fails from each later one: the run's end and what follows are the same, the rest shorter.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", walk=r"(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+)|eyJ[A-Za-z0-9_-]*+"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._~-]{1,64}:[A-Za-z0-9._~%+-]{1,64}@"),
]
RULES = BASE_RULES + MORE_RULES

#: A query: True (anything may match), a trigram, or ("and" | "or", parts).
Query = bool | bytes | tuple


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[bytes]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, av in items:
        if op is C.LITERAL:
            out.add(bytes([av]).lower())
        elif op is C.RANGE and av[1] - av[0] < EXACT_MAX:
            out |= {bytes([c]).lower() for c in range(av[0], av[1] + 1)}
        else:
            return None
    return out if len(out) <= EXACT_MAX // 2 else None


def _derive(tree) -> tuple[set[bytes] | None, Query]:
    """The strings that a sequence can be, if few, else None and a query that holds for whatever it matches."""
    exact: set[bytes] | None = {b""}
    known: list[Query] = []

    def close() -> None:
        nonlocal exact
        if exact:
            known.append(_of_strings(exact))
        exact = {b""}

    open_end = True
    for op, av in tree:
        one: set[bytes] | None
        query: Query = True
        if op is C.LITERAL:
            one = {bytes([av]).lower()}
        elif op is C.IN:
            one = _class(av)
        elif op is C.SUBPATTERN:
            one, query = _derive(av[-1])
        elif op is C.BRANCH:
            arms = [_derive(t) for t in av[1]]
            if all(e is not None for e, _ in arms):
                one = set().union(*(e for e, _ in arms))
            else:
                one, query = None, _any([q if e is None else _of_strings(e) for e, q in arms])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, item = av
            one, query = _derive(item)
            if (low, high) == (0, 1) and one is not None:
                one = one | {b""}
            elif low == 0:
                one, query = None, True
            elif not (low == high == 1):
                query, one = query if one is None else _of_strings(one), None
        elif op is C.AT:
            continue
        else:
            one = None
        if one is not None and len(exact) * len(one) <= EXACT_MAX:
            exact = {a + b for a in exact for b in one}
            continue
        close()
        open_end = False
        if one is not None:
            exact = one
        else:
            known.append(query)
    if open_end:
        return exact, True
    close()
    return None, _all(known)


def trigram_query(rule: Rule) -> Query:
    """The Boolean query over lower-cased trigrams that holds for every text the rule matches; True if none is needed."""
    exact, query = _derive(_parser.parse(rule.pattern.encode(), re.I if rule.ignore_case else 0))
    return query if exact is None else _of_strings(exact)


def _trigrams(q: Query) -> set[bytes]:
    return set() if q is True else {q} if isinstance(q, bytes) else set().union(*map(_trigrams, q[1:]))


@dataclass
class Scanner:
    """Compiled rules, their queries, and the table from trigram to posting list."""

    rules: list[Rule]
    queries: list[Query] = field(init=False)
    slots: dict[bytes, int] = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.compiled = [r.compiled() for r in self.rules]
        self.queries = [trigram_query(r) for r in self.rules]
        self.slots = {t: i for i, t in enumerate(sorted(set().union(*map(_trigrams, self.queries))), 1)}
        self.table = np.zeros(1 << 24, dtype=np.uint8 if len(self.slots) < 256 else np.uint16)
        for t, i in self.slots.items():
            self.table[int.from_bytes(t, "big")] = i

    def postings(self, block: Block) -> np.ndarray:
        """Bit sets: which rows hold each needed trigram."""
        out = np.zeros((len(self.slots) + 1, block.rows), dtype=bool)
        low = LOWER[block.data].astype(np.int32)
        if len(low) >= 3:
            slot = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(slot)
            row = np.searchsorted(block.offsets, at, "right") - 1
            inside = at + 3 <= block.offsets[row + 1]
            out[slot[at[inside]], row[inside]] = True
        return out

    def rows(self, q: Query, bits: np.ndarray) -> np.ndarray:
        """The rows that satisfy a query."""
        if q is True:
            return np.ones(bits.shape[1], dtype=bool)
        if isinstance(q, bytes):
            return bits[self.slots[q]]
        parts = [self.rows(x, bits) for x in q[1:]]
        return np.logical_and.reduce(parts) if q[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, block: Block) -> list[list[tuple[int, int, int]]]:
        """For each row, (start, rule, end) of every match in code points, sorted."""
        bits = self.postings(block)
        found: dict[int, list[tuple[int, int, int]]] = {}
        texts: dict[int, bytes] = {}
        for k, (rule, pattern, q) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            for r in np.flatnonzero(self.rows(q, bits)).tolist():
                text = texts.get(r) or texts.setdefault(r, block.text(r))
                for start, end in rule.matches(pattern, text):
                    found.setdefault(r, []).append((start, k, end))
        for r, spans in found.items():
            text = texts[r]
            if not text.isascii():
                before = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                before = np.append(0, before)
                spans[:] = [(int(before[s]), k, int(before[e])) for s, k, e in spans]
            spans.sort()
        return [found.get(r, []) for r in range(block.rows)]


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None, output: str = "secrets") -> DataFrame:
    """The columns of ``keep`` (all by default) and the array ``secrets``: kind, start, end of every secret.

    Positions count code points from 0, the end is exclusive; spans are ordered by start, then by the
    order of the rules. A null or empty text has none (an empty array). Rows aren't compared with each
    other: repeated rows give repeated results, an empty table gives none. A kept column named like the
    output gives way to it.
    """
    rules = RULES if rules is None else rules

    def fn(texts: pa.Array, scanner: Scanner) -> dict[str, pa.Array]:
        out = []
        for b in blocks(texts):
            out += [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in scanner.scan(b)]
        return {output: pa.array(out, _ARROW_SPANS)}

    return map_batches(docs, fn, [text], {output: SPAN_TYPE}, docs.columns if keep is None else keep, lambda: Scanner(rules))
