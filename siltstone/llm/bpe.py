r"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than ``chunk`` characters is cut into chunks that overlap; each is pre-tokenised by itself,
from its own first character, so its first boundaries may be wrong. Where the text is split depends only
on what follows a boundary: once two neighbours share a boundary in their overlap they agree from there on.
Stitching takes the first such boundary (*resynchronisation*) as the end of one piece and the start of the
next; where an overlap holds none (one pre-token longer than it) the two chunks are pre-tokenised again as
one. The last pre-token a chunk sees may be cut off by its end, so boundaries near it aren't trusted.
Pieces that begin and end at true boundaries are then encoded by the vocabulary's ranks. Decoding
concatenates the raw bytes of the tokens.

Every text goes this way. The chunks of a text of several are dealt over tasks to be pre-tokenised and meet again, in a
task that stitches and encodes them. A text of one chunk has no neighbour to be stitched with: it is its only piece, and
stays in the task that reads it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.frames import fresh, map_batches, named, tidy

CHUNK = 32_768
OVERLAP = 2_048
#: Texts of more characters have their chunks dealt over tasks: all of more than one chunk.
DEAL = CHUNK


def read_ranks(path: str) -> bytes:
    """The vocabulary file as it is (a line per token: base64, rank); its size is the vocabulary's."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.table, self.pattern = table, pattern
        n = max(table.values()) + 1
        self.size = np.zeros(n, np.int64)
        for token, i in table.items():
            self.size[i] = len(token)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(t for t, _ in sorted(table.items(), key=lambda x: x[1])), np.uint8)

    @cached_property
    def encoding(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=self.table, special_tokens={})

    @cached_property
    def split(self) -> regex.Pattern:
        return regex.compile(self.pattern)

    def encode_piece(self, piece: str) -> np.ndarray:
        """Ids of a text that begins and ends at boundaries."""
        return np.array(self.encoding.encode_ordinary(piece), np.uint32)

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens end."""
        return [m.end() for m in self.split.finditer(text)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of the tokens, one after the other."""
        size = self.size[ids]
        if not len(ids):
            return b""
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()


def chunk_ranges(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of the chunks of a text of n characters; each but the last goes on for ``overlap`` into the next."""
    starts = range(0, max(1, n), chunk)
    return [(s, min(n, s + chunk + overlap)) for s in starts]


def trusted(ends: list[int], start: int, stop: int, n: int) -> list[int]:
    """Boundaries of a chunk in the text's positions, without those that its end may have made.

    The pre-token at the end may go on behind it, and white space before it may have been split otherwise:
    the last two are left out unless the text ends there.
    """
    return [start + e for e in (ends if stop >= n else ends[:-2])]


def stitch(texts: list[str], ranges: list[tuple[int, int]], found: Sequence[list[int]], codec: Codec) -> list[tuple[int, int, int]]:
    """Pieces (chunk, start, end in the text) that tile the text at true boundaries.

    texts: the chunks; found: their trusted boundaries (not looked at if there is only one chunk). Where neighbours
    never agree, the text is pre-tokenised on from the last true boundary.
    """
    n = ranges[-1][1]
    cuts = [(0, 0)]  # (true boundary, chunk that goes on from it)
    current = found[0] if len(ranges) > 1 else []
    i = 0
    text_to = ranges[0][1]
    while i + 1 < len(ranges):
        nxt = found[i + 1]
        common = np.intersect1d(np.asarray(current, np.int64), np.asarray(nxt, np.int64))
        common = common[(common > cuts[-1][0]) & (common >= ranges[i + 1][0])]
        if len(common):
            cuts.append((int(common[0]), i + 1))
            current, text_to = nxt, ranges[i + 1][1]
        else:
            # No agreement: go on from the last true boundary over the next chunk as well.
            base = cuts[-1][0]
            text_to = ranges[i + 1][1]
            joined = _join(texts, ranges, base, text_to)
            current = trusted(codec.boundaries(joined), base, text_to, n)
        i += 1
    ends = [c for c, _ in cuts[1:]] + [n]
    return [(k, s, e) for (s, k), e in zip(cuts, ends, strict=True) if e > s or n == 0]


def _join(texts: list[str], ranges: list[tuple[int, int]], start: int, stop: int) -> str:
    """The text from start to stop out of overlapping chunks."""
    out, at = [], start
    for (s, e), t in zip(ranges, texts, strict=True):
        if e > at and s <= at and at < stop:
            out.append(t[at - s : min(e, stop) - s])
            at = min(e, stop)
    return "".join(out)


def _near_edges(ends: list[int], start: int, stop: int, overlap: int) -> list[int]:
    """Those boundaries of a chunk that a neighbour sees as well."""
    return [e for e in ends if e <= start + overlap or e >= stop - overlap]


def encode_chunks(texts: list[str], ranges: list[tuple[int, int]], found: Sequence[list[int]], codec: Codec) -> np.ndarray:
    """Ids of a whole text out of its chunks and their boundaries."""
    return np.concatenate([codec.encode_piece(_join(texts, ranges, s, e)) for _, s, e in stitch(texts, ranges, found, codec)])


def encode_text(text: str, codec: Codec, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a whole text, by chunks, in one process."""
    ranges = chunk_ranges(len(text), chunk, overlap)
    texts = [text[s:e] for s, e in ranges]
    found = [trusted(codec.boundaries(t), s, e, len(text)) for t, (s, e) in zip(texts, ranges, strict=True)] if len(ranges) > 1 else []
    return encode_chunks(texts, ranges, found, codec)


def _packed(parts: list[np.ndarray]) -> pa.Array:
    """Each row's ids as little-endian unsigned 32-bit integers, one after the other."""
    offsets = np.concatenate([[0], np.cumsum([4 * len(p) for p in parts])]).astype(np.int64)
    data = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None, output: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, deal: int = DEAL) -> DataFrame:
    """The columns of ``keep`` (all by default) and ``ids``: the token ids of every whole text, packed as
    little-endian unsigned 32-bit integers in a binary value (``unpack`` makes an array of them).

    ``vocabulary``: path of a file of ranks that the driver can read; it is broadcast (its size is that of the
    vocabulary, a few MB at most). No special tokens: their spellings are ordinary text. A null or
    empty text has no ids (an empty value). Repeated rows give repeated results; an empty table gives none;
    a kept column named like the output gives way to it. Rows come in no particular order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    keep = [c for c in dict.fromkeys(docs.columns if keep is None else keep) if c.lower() != output.lower()]
    t = fresh(docs, "_t")
    source = docs.select(*(named(c) for c in keep), F.coalesce(named(text).cast("string"), F.lit("")).alias(t))
    setup = lambda: Codec(shared.value, pattern)

    def whole(texts: pa.Array, own: Codec) -> dict[str, pa.Array]:
        return {output: _packed([encode_text(x, own, chunk, overlap) for x in texts.to_pylist()])}

    together = map_batches(source.where(F.length(t) <= deal), whole, [t], {output: T.BinaryType()}, keep, setup)

    # Chunks carry the number of their row, and the kept columns in the first of them.
    kept = [f"_kept_{i}" for i in range(len(keep))]
    rows = source.where(F.length(t) > deal).select(F.monotonically_increasing_id().alias("row"), F.col(t).alias("body"), *(named(c).alias(k) for c, k in zip(keep, kept, strict=True)))
    place = [T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "stop", "n")), T.StructField("body", T.StringType())]
    cut_schema = T.StructType([*place, *(T.StructField(k, rows.schema[k].dataType) for k in kept)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                body = b.column(1)[i].as_py()
                ranges = chunk_ranges(len(body), chunk, overlap)
                m = len(ranges)
                columns = [pa.array([b.column(0)[i].as_py()] * m, pa.int64()), pa.array(range(m), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*ranges, strict=True)), pa.array([len(body)] * m, pa.int64()), pa.array([body[s:e] for s, e in ranges], pa.string())]
                firsts = [b.column(j).take(pa.array([i] + [None] * (m - 1), pa.int64())) for j in range(2, 2 + len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *firsts], names=cut_schema.names)

    def mark(bodies: pa.Array, starts: pa.Array, stops: pa.Array, n: pa.Array, own: Codec) -> dict[str, pa.Array]:
        found = zip(bodies.to_pylist(), starts.to_pylist(), stops.to_pylist(), n.to_pylist(), strict=True)
        return {"ends": pa.array([_near_edges(trusted(own.boundaries(x), s, e, m), s, e, overlap) for x, s, e, m in found], pa.list_(pa.int64()))}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come text by text and in order."""
        own, held = setup(), []

        def encoded() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            texts, found = table.column("body").to_pylist(), table.column("ends").to_pylist()
            ranges = list(zip(table.column("start").to_pylist(), table.column("stop").to_pylist(), strict=True))
            ids = _packed([encode_chunks(texts, ranges, found, own)])
            return pa.RecordBatch.from_arrays([*(held[0].column(k).slice(0, 1) for k in kept), ids], names=[*kept, output])

        for b in batches:
            row = b.column("row").to_numpy()
            edges = np.flatnonzero(np.diff(row, prepend=row[0] - 1)).tolist() if len(row) else []
            for i, z in zip(edges, [*edges[1:], len(row)], strict=True):
                if held and held[0].column("row")[0].as_py() != row[i]:
                    yield encoded()
                    held.clear()
                held.append(b.slice(i, z - i))
        if held:
            yield encoded()

    dealt = rows.mapInArrow(tidy(cut), cut_schema).repartition(F.col("row"), F.col("part"))
    marked = map_batches(dealt, mark, ["body", "start", "stop", "n"], {"ends": T.ArrayType(T.LongType())}, ["row", "part", "start", "stop", "body", *kept], setup)
    met = marked.repartition("row").sortWithinPartitions("row", "part")
    joined = met.mapInArrow(tidy(join), T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in kept), T.StructField(output, T.BinaryType())]))
    return together.unionByName(joined.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), named(output)))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None, output: str = "decoded") -> DataFrame:
    """The columns of ``keep`` (all by default) and ``decoded``: the raw bytes of packed ids (null: none).

    The bytes need not be UTF-8 if the ids don't come from a text. An id outside the vocabulary raises an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def fn(packed: pa.Array, own: Codec) -> dict[str, pa.Array]:
        return {output: pa.array([own.decode(np.frombuffer(x or b"", "<u4")) for x in packed.to_pylist()], pa.binary())}

    return map_batches(df, fn, [ids], {output: T.BinaryType()}, df.columns if keep is None else keep, lambda: Codec(shared.value, "."))


def unpack(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    swapped = lambda i: F.concat(*(F.substring(ids, i * 4 + k, F.lit(1)) for k in (4, 3, 2, 1)))
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(swapped(i)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
