r"""Line deduplication with a log-template tree.

A line's tokens are its runs of bytes above the space; a token with an ASCII digit is a variable field. The
tree has a fixed depth: a line goes to the leaf of its token count and its first ``DEPTH`` tokens (fields
count as alike). In a leaf, a token is a constant of the template if it stands at its place in at least
``min_docs`` document lines, else a field; a line is an instance of the leaf's template if fields
make up at most a quarter of it. Templates with instances in at least ``min_docs`` document lines recur:
all their instances go, but for the first (least key, then least line number).

The leaf doesn't depend on the order of lines, unlike in an online parser, so the tree is built by
aggregation. ``recurring_whole`` is the same tree without the cuts of this rule: see there.

Lines are summed up by content before anything else: a line that a third of the documents
share is one row from then on. Only lines of leaves that hold different lines are looked at token by
token, once each. No leaf and no document group is collected into a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrays import Block, blocks, mix, ranges_of, token_hashes
from siltstone.llm.frames import few_files, fresh, map_batches, named, salted_join, saved, shared_dir, tidy

DEPTH = 4
MIN_TOKENS = 3
MIN_DOCS = 3
SHARE = 0.75
#: Of ``recurring_whole``: documents in which a line stands word for word.
MIN_SAME = 2
_FIELD = np.uint64(0x2A)


@dataclass
class Lines:
    """Lines of a block that have enough tokens: row, number in the row, leaf, hash of the content, tokens."""

    row: np.ndarray
    number: np.ndarray
    leaf: np.ndarray
    content: np.ndarray
    first: np.ndarray  # the first of its content in its row
    token_at: np.ndarray
    tokens: np.ndarray


def lines(block: Block, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, exact: bool = False) -> Lines:
    """The lines of every row of a block. ``exact``: contents differ if any token does, else fields are alike."""
    data = block.data
    s, e = ranges_of(data > 32, block.offsets)
    newlines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=newlines[1:])
    digits = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:], dtype=np.int32)
    row = np.searchsorted(block.offsets, s, "right") - 1
    number = newlines[s] - newlines[block.offsets[row]]
    plain = token_hashes(data, s, e)
    tokens = np.where(digits[e] > digits[s], _FIELD, plain)
    begin = np.ones(len(s), bool)
    begin[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(begin)
    count = np.diff(np.append(at, len(s)))
    place = np.arange(len(s)) - np.repeat(at, count)
    placed = mix(tokens ^ mix(place.astype(np.uint64) + np.uint64(1)))
    if len(at):
        total = mix(count.astype(np.uint64))
        leaf = mix(np.add.reduceat(np.where(place < depth, placed, np.uint64(0)), at) + total)
        content = mix(np.add.reduceat(mix(plain ^ mix(place.astype(np.uint64) + np.uint64(1))) if exact else placed, at) ^ total)
    else:
        leaf = content = np.zeros(0, np.uint64)
    ok = count >= min_tokens
    line_row, line_number = row[at][ok], number[at][ok]
    leaf, content = leaf[ok].view(np.int64), content[ok].view(np.int64)
    order = np.lexsort((line_number, content, line_row))
    first = np.ones(len(order), bool)
    first[order[1:]] = (content[order[1:]] != content[order[:-1]]) | (line_row[order[1:]] != line_row[order[:-1]])
    spans = np.stack([at[ok], (at + count)[ok]], 1) if len(at) else np.zeros((0, 2), np.int64)
    return Lines(line_row, line_number, leaf, content, first, spans, tokens.view(np.int64))


def _code(number: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One number for a line of a document: its place and content."""
    return mix(content.view(np.uint64) ^ mix(number.astype(np.uint64))).view(np.int64)


def whole_lines(block: Block) -> Lines:
    """Every line that isn't blank, told apart word for word."""
    return lines(block, min_tokens=1, exact=True)


def _tokens(find: Callable[[Block], Lines]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of texts and the contents wanted of each: the tokens of these."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(1).to_pylist()
            for block in blocks(b.column(0)):
                x = find(block)
                have = {(r, c): i for i, (r, c) in enumerate(zip(x.row.tolist(), x.content.tolist(), strict=True))}
                rows = []
                for r in range(block.rows):
                    for w in asked[block.first + r]:
                        i = have.get((r, w["c"]))
                        if i is not None:
                            a, z = x.token_at[i]
                            rows.append((w["leaf"], w["c"], w["docs"], x.tokens[a:z].tolist()))
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], names=["leaf", "c", "docs", "tokens"])

    return tidy(tokens)


def _codes(gone: DataFrame) -> DataFrame:
    """The lines ``k``, ``n``, ``c`` as a list of codes per document."""

    def code(n: pa.Array, c: pa.Array) -> dict[str, pa.Array]:
        return {"code": pa.array(_code(n.to_numpy(), c.to_numpy(zero_copy_only=False)))}

    return map_batches(gone, code, ["n", "c"], {"code": T.LongType()}, ["k"]).groupBy("k").agg(F.collect_set("code").alias("gone"))


def recurring(docs: DataFrame, key: str, text: str, min_docs: int = MIN_DOCS, share: float = SHARE, folder: str | None = None) -> DataFrame:
    """The lines to drop, per document: ``k`` and ``gone``, a list of line codes."""
    folder = folder or shared_dir(docs.sparkSession)
    kind = docs.schema[key].dataType
    own = docs.select(named(key).alias("k"), named(text).cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    schema = T.StructType([T.StructField("k", kind), T.StructField("n", T.LongType()), T.StructField("leaf", T.LongType()), T.StructField("c", T.LongType()), T.StructField("one", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1)):
                x = lines(block)
                keys = b.column(0).take(pa.array(block.first + x.row))
                yield pa.RecordBatch.from_arrays([keys, pa.array(x.number), pa.array(x.leaf), pa.array(x.content), pa.array(x.first.astype(np.int64))], names=schema.names)

    every = saved(own.mapInArrow(tidy(cut), schema), "lines", folder)
    kinds = every.groupBy("leaf", "c").agg(F.sum("one").alias("docs"), F.min(F.struct("k", "n")).alias("rep"))
    kinds = saved(kinds, "contents", folder)
    leaves = kinds.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count(F.lit(1)).alias("many")).where((F.col("total") >= min_docs) & (F.col("many") > 1)).select("leaf")
    mixed = salted_join(kinds, leaves, ["leaf"], "c")

    # Tokens of one line of each content, read from the document that has it.
    wanted = mixed.groupBy(F.col("rep.k").alias("k")).agg(F.collect_list(F.struct(F.col("rep.n").alias("n"), "leaf", "c", "docs")).alias("w"))
    token_schema = "leaf long, c long, docs long, tokens array<long>"
    found = own.join(wanted, "k").select("t", "w").mapInArrow(_tokens(lines), token_schema).dropDuplicates(["leaf", "c"])
    found = saved(found, "tokens", folder)
    each = found.select("leaf", "c", "docs", F.size("tokens").alias("size"), F.posexplode("tokens").alias("p", "token")).where(F.col("p") >= DEPTH)
    constants = each.groupBy("leaf", "p", "token").agg(F.sum("docs").alias("s")).where(F.col("s") >= min_docs).drop("s")
    rare = salted_join(each.where(F.col("docs") < min_docs), constants, ["leaf", "p", "token"], "c")
    rare = rare.groupBy("leaf", "c", "size").agg(F.count(F.lit(1)).alias("same")).where(F.col("same") + F.least(F.col("size"), F.lit(DEPTH)) >= share * F.col("size"))
    short = found.where((F.col("docs") < min_docs) & (F.size("tokens") * share <= DEPTH)).select("leaf", "c")
    instances = rare.select("leaf", "c").unionByName(short).distinct()
    instances = kinds.join(instances, ["leaf", "c"]).unionByName(kinds.where(F.col("docs") >= min_docs))
    heads = instances.groupBy("leaf").agg(F.min("rep").alias("head"), F.sum("docs").alias("total")).where(F.col("total") >= min_docs)
    told = salted_join(instances.select("leaf", "c"), heads.select("leaf", "head"), ["leaf"], "c")
    gone = salted_join(every, told, ["leaf", "c"], "k").where((F.col("k") != F.col("head.k")) | (F.col("n") != F.col("head.n"))).select("k", "n", "c")
    return _codes(gone)


def _in_enough(groups: DataFrame, members: DataFrame, on: list[str], every: DataFrame, min_docs: int) -> DataFrame:
    """Those ``groups`` of contents that stand in at least ``min_docs`` documents, each document counted once.

    ``docs`` and ``crowded`` are summed over the contents and ``most`` is the largest ``docs``: documents with one content of the
    leaf only are counted by sums, others are looked at only where they decide.
    """
    sure = (F.col("most") >= min_docs) | (F.col("docs") - F.col("crowded") >= min_docs)
    open_ = groups.where(~sure & (F.col("docs") >= min_docs)).select(*on)
    asked = salted_join(members.select(*on, "c"), open_, on, "c").select(*on, "c").distinct()
    crowd = salted_join(every.where("one = 1").select("leaf", "c", "k"), asked, ["leaf", "c"], "k")
    enough = crowd.select(*on, "k").distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return groups.where(sure).select(*on).unionByName(enough.select(*on))


def recurring_whole(docs: DataFrame, key: str, text: str, min_docs: int = MIN_DOCS, share: float = SHARE, min_same: int = MIN_SAME, folder: str | None = None) -> DataFrame:
    """As ``recurring``, for every line that isn't blank, however few tokens it has.

    A line that stands word for word in ``min_same`` documents recurs. A template is a leaf's constants with fields for the
    rest; a token with a digit is never a constant, and constants make up at least ``share`` of an instance. A template
    recurs if its instances stand in ``min_docs`` different documents (of rows that share a key, one may count). The first
    instance of each template stays, and of each other recurring line.
    """
    folder = folder or shared_dir(docs.sparkSession)
    kind = docs.schema[key].dataType
    own = docs.select(named(key).alias("k"), named(text).cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    schema = T.StructType([T.StructField("k", kind), *(T.StructField(c, T.LongType()) for c in ("n", "leaf", "c", "one", "crowded"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1)):
                x = whole_lines(block)
                keys = b.column(0).take(pa.array(block.first + x.row))
                at = np.flatnonzero(x.first)
                _, back, count = np.unique(mix(x.leaf[at].view(np.uint64) + mix(x.row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
                crowded = np.zeros(len(x.row), np.int64)
                crowded[at] = count[back] > 1
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(v) for v in (x.number, x.leaf, x.content, x.first.astype(np.int64), crowded))], names=schema.names)

    every = saved(own.mapInArrow(tidy(cut), schema), "lines", folder)
    kinds = every.groupBy("leaf", "c").agg(F.sum("one").alias("docs"), F.sum("crowded").alias("crowded"), F.min(F.struct("k", "n")).alias("rep"))
    kinds = saved(kinds, "contents", folder)
    leaves = kinds.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count(F.lit(1)).alias("many")).where((F.col("total") >= min_docs) & (F.col("many") > 1)).select("leaf")
    mixed = salted_join(kinds, leaves, ["leaf"], "c")
    wanted = mixed.groupBy(F.col("rep.k").alias("k")).agg(F.collect_list(F.struct("leaf", "c", "docs")).alias("w"))
    found = own.join(wanted, "k").select("t", "w").mapInArrow(_tokens(whole_lines), "leaf long, c long, docs long, tokens array<long>").dropDuplicates(["leaf", "c"])
    field = F.lit(int(_FIELD))
    lead = F.size(F.filter(F.slice("tokens", 1, DEPTH), lambda t: t != field))
    found = saved(found.drop("docs").join(kinds, ["leaf", "c"]).withColumn("lead", lead), "tokens", folder)

    each = found.select("leaf", "c", "docs", "crowded", F.posexplode("tokens").alias("p", "token")).where((F.col("p") >= DEPTH) & (F.col("token") != field))
    sums = [F.sum("docs").alias("docs"), F.sum("crowded").alias("crowded"), F.max("docs").alias("most")]
    place = ["leaf", "p", "token"]
    constants = _in_enough(each.groupBy(*place).agg(*sums), each, place, every, min_docs)
    same = salted_join(each, constants, place, "c").groupBy("leaf", "c").agg(F.count(F.lit(1)).alias("same"), F.bit_xor(F.xxhash64("p", "token")).alias("mask"))
    fits = found.join(same, ["leaf", "c"], "left").where(F.col("lead") + F.coalesce("same", F.lit(0)) >= share * F.size("tokens"))
    fits = saved(fits.select("leaf", F.xxhash64("leaf", "same", "mask").alias("template"), "c", "docs", "crowded", "rep"), "instances", folder)
    one = ["leaf", "template"]
    groups = fits.groupBy(*one).agg(*sums, F.min("rep").alias("head"))
    heads = groups.join(_in_enough(groups, fits, one, every, min_docs), one).select(*one, "head")
    told = saved(salted_join(fits.select(*one, "c"), heads, one, "c").select("leaf", "c", "head"), "told", folder)
    alone = kinds.where(F.col("docs") >= min_same).join(told.select("leaf", "c"), ["leaf", "c"], "left_anti").select("leaf", "c", F.col("rep").alias("head"))
    gone = salted_join(every, told.unionByName(alone), ["leaf", "c"], "k").where((F.col("k") != F.col("head.k")) | (F.col("n") != F.col("head.n")))
    return _codes(gone.select("k", "n", "c"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, prefix: str = "", min_docs: int = MIN_DOCS, share: float = SHARE, whole: bool = False) -> DataFrame:
    """The columns of ``keep`` (all but the text by default), and ``text``: the text without dropped lines, ``n_lines`` and
    ``n_dropped``. ``prefix`` stands before the three names; a kept column of such a name gives way.

    Lines end with a line feed; a text without dropped lines stays as it is, else the remaining lines are
    joined by line feeds. Lines of fewer than three tokens are never dropped, unless ``whole``, which drops what
    ``recurring_whole`` finds in place of ``recurring``. A null text stays null, with no
    lines; an empty text has none. Rows with a null key are neither compared nor changed. Each row counts
    as a document; of rows that share a key, each is checked line by line. Ties don't arise: the first
    instance is that of the least key and line number. An empty table gives none.
    """
    names = {o: prefix + o for o in ("text", "n_lines", "n_dropped")}
    kept = [c for c in dict.fromkeys(c for c in docs.columns if c != text) if c.lower() not in names.values()] if keep is None else list(keep)
    gone_c, t_c, k_c = fresh(docs, "_gone"), fresh(docs, "_t"), fresh(docs, "_k")
    find, gone = (whole_lines, recurring_whole) if whole else (lines, recurring)
    gone = gone(docs, key, text, min_docs, share).withColumnsRenamed({"k": k_c, "gone": gone_c})
    source = docs.select(*(named(c) for c in kept), named(key).alias(k_c), named(text).cast("string").alias(t_c))
    joined = source.join(gone, k_c, "left")

    def rewrite(texts: pa.Array, gone: pa.Array) -> dict[str, pa.Array]:
        drop = gone.to_pylist()
        null = texts.is_null().to_pylist()
        out, n_lines, n_dropped = [], [], []
        for block in blocks(texts):
            x = find(block) if any(drop[block.first : block.first + block.rows]) else None
            at = np.searchsorted(x.row, np.arange(block.rows + 1)) if x else None
            codes = _code(x.number, x.content) if x else None
            for r in range(block.rows):
                body, d = block.text(r), drop[block.first + r]
                parts = body.count(b"\n") + 1 if body else 0
                dropped = 0
                if d:
                    mine = set(x.number[at[r] : at[r + 1]][np.isin(codes[at[r] : at[r + 1]], d)].tolist())
                    if mine:
                        dropped = len(mine)
                        body = b"\n".join(p for i, p in enumerate(body.split(b"\n")) if i not in mine)
                out.append(None if null[block.first + r] else body.decode())
                n_lines.append(parts)
                n_dropped.append(dropped)
        made = {"text": pa.array(out, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        return {names[o]: v for o, v in made.items()}

    return few_files(map_batches(joined, rewrite, [t_c, gone_c], {names["text"]: T.StringType(), names["n_lines"]: T.LongType(), names["n_dropped"]: T.LongType()}, kept), 4)
