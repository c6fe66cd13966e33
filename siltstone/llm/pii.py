r"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn for card numbers, mod-97 for bank accounts) and
bounds confirm them, and words near a span raise or lower its score. The text between matches comes from
``split`` with the same expression, so positions are running sums of lengths in code points, and the
words around a span are read from the pieces beside it. Running sums go by blocks of blocks, so a row's work is in proportion to its
text up to millions of matches; rows are independent and nothing is shuffled.

The expressions are written so that the JVM's matcher neither recurses nor rescans: repeated groups
are possessive, and a run that can't start a match is entered only at its start or where the last match
ended. They match the same spans as the plain forms beside them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.frames import fresh, named

BEFORE, AFTER = 48, 24
#: Running sums go by blocks of so many numbers, and by blocks of so many blocks.
SUM_BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    pattern: the expression run; plain: the same spans in plain form, for other engines; hint: cheap test
    of the text; score: without context; near: words nearby that raise it by 0.3; far: words that lower it by 0.3.
    """

    name: str
    pattern: str
    plain: str
    hint: str
    score: float
    near: str
    far: str
    base: bool


# Patterns, byte maxima and context words.
_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_VALID = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
KINDS = [
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "@", 0.8, "mail|contact|write|@", "example|noreply", True,
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]\.[0-9]++\.[0-9]", 0.6, r"\bip\b|address|host|server|login", "version|release|section", True,
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", r"[0-9]", 0.7, "card|visa|credit|payment|iban|account", "order|isbn|serial|tracking", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax", "version|score", True),
    Kind(
        "iban",
        r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        r"[A-Z][A-Z][0-9][0-9]", 0.9, "iban|bank|account|transfer", "serial|part", False,
    ),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9][0-9]-[0-9]", 0.3, r"\bssn\b|social security|taxpayer", "order|part|serial", False),
]
#: A span of a kind that isn't base is kept from this score on.
KEEP_SCORE = 0.5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, v: a + v)


def _by_blocks(numbers: Column) -> Column:
    """Sums of the blocks of an array that isn't empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / SUM_BLOCK).cast("int")), lambda b: _total(F.slice(numbers, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK))))


def _block_starts(numbers: Column) -> Column:
    """For each block of an array that isn't empty, the sum of all numbers before it."""

    def with_sums(sums: Column) -> Column:
        def with_larger(larger: Column) -> Column:
            def before(b: Column) -> Column:
                c = F.floor(b / SUM_BLOCK).cast("int")
                return _total(F.slice(larger, F.lit(1), c)) + _total(F.slice(sums, c * SUM_BLOCK + 1, b - c * SUM_BLOCK))

            return F.transform(F.sequence(F.lit(0), F.size(sums) - 1), before)

        return _let(_by_blocks(sums), with_larger)

    return _let(_by_blocks(numbers), with_sums)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _mod97(text: Column) -> Column:
    """The account number's digits (letters count as 10 to 35), its first four characters last, modulo 97."""
    bare = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, v: F.when(v >= 10, a * 100 + v).otherwise(a * 10 + v) % 97
    return F.aggregate(F.transform(F.split(turned, "(?<=.)(?=.)"), value), F.lit(0), lambda a, v: step(a, v))


def _confirmed(kind: str, s: Column) -> Column:
    """The checksum or bound of a kind."""
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    n = F.length(digits)
    match kind:
        case "ip":
            return s["value"].rlike(IP_VALID)
        case "card":
            return F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False))
        case "phone":
            return n.between(10, 15)
        case "iban":
            return _mod97(s["value"]) == 1
        case "ssn":
            return ~s["before"].rlike("[0-9-]$") & ~s["after"].rlike("^[0-9-]")
    return F.lit(True)


def _score(k: Kind, s: Column) -> Column:
    around = F.lower(F.concat(s["before"], F.lit(" | "), s["after"]))
    raised = F.when(around.rlike(k.near), F.lit(0.3)).otherwise(F.lit(0.0))
    lowered = F.when(around.rlike(k.far), F.lit(0.3)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(k.score) + raised - lowered))


def _spans(text: Column, k: Kind, rank: int) -> Column:
    """Array of start, rank, end, kind, value, score of the confirmed spans of one kind."""
    pattern = F.lit(k.pattern)

    def located(pair: Column) -> Column:
        m, p = pair["m"], pair["p"]
        cells = F.arrays_zip(m.alias("m"), F.slice(p, F.lit(1), F.size(m)).alias("p"), F.slice(p, F.lit(2), F.size(m)).alias("q"))

        def placed(zipped: Column) -> Column:
            steps = F.transform(zipped, lambda c: (F.length(c["m"]) + F.length(c["p"])).cast("long"))

            def with_steps(st: Column) -> Column:
                def with_starts(starts: Column) -> Column:
                    def one(c: Column, i: Column) -> Column:
                        b = F.floor(i / SUM_BLOCK).cast("int")
                        start = F.get(starts, b) + _total(F.slice(st, b * SUM_BLOCK + 1, i - b * SUM_BLOCK)) + F.length(c["p"])
                        return F.struct(
                            start.alias("start"),
                            F.lit(rank).alias("rank"),
                            (start + F.length(c["m"])).alias("end"),
                            F.lit(k.name).alias("kind"),
                            c["m"].alias("value"),
                            F.right(c["p"], F.lit(BEFORE)).alias("before"),
                            F.left(c["q"], F.lit(AFTER)).alias("after"),
                        )

                    return F.transform(zipped, one)

                return _let(_block_starts(st), with_starts)

            return _let(steps, with_steps)

        return _let(cells, placed)

    raw = _let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, k.pattern, -1).alias("p")), located)
    scored = F.transform(
        F.filter(raw, lambda s: _confirmed(k.name, s)),
        lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), _score(k, s).alias("score")),
    )
    kept = scored if k.base else F.filter(scored, lambda s: s["score"] >= KEEP_SCORE)
    hint = text.contains(k.hint) if len(k.hint) == 1 else text.rlike(k.hint)
    nothing = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:double>>")
    return F.when(hint & text.rlike(k.pattern), kept).otherwise(nothing)


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None, kinds: list[Kind] | None = None, output: str = "pii") -> DataFrame:
    """The columns of ``keep`` (all by default) and the array ``pii`` of kind, start, end, value, score.

    Positions count code points from 0, the end is exclusive; spans are ordered by start, then by the
    order of the kinds. Within a kind matches are leftmost and don't overlap; one that fails its checksum or
    bound is dropped and its text isn't searched again. Kinds that aren't base need a score of 0.5.
    A null or empty text has none. Repeated rows give repeated results; an empty table gives none. A kept
    column named like the output gives way to it.
    """
    kinds = KINDS if kinds is None else kinds
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != output.lower()]
    t = fresh(docs, "_t")
    parts = [fresh(docs, f"_k{i}") for i in range(len(kinds))]
    df = docs.select(*(named(c) for c in kept), F.coalesce(named(text).cast("string"), F.lit("")).alias(t))
    df = df.select(*(named(c) for c in kept), *(_spans(named(t), k, i).alias(parts[i]) for i, k in enumerate(kinds)))
    both = F.array_sort(F.concat(*(named(p) for p in parts)))
    out = F.transform(both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")))
    return df.select(*(named(c) for c in kept), out.alias(output))
