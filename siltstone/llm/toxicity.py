"""Toxicity by a convolutional text classifier.

Words are lower-cased and represented by the sum of hashed embeddings: of the whole word and of its
first 4, 6 and 8 bytes, so that inflected and compounded forms of a stem share what is learnt. Filters over
one, two and three words are max-pooled over the whole text and combined to a logit. Embeddings and filters
are trained in numpy, a network in a task, with a bounded sample of labelled rows; first estimates of the
embeddings come from document frequencies in the two classes. The logit at which a text counts as toxic is
calibrated for each language on logits of all rows, each from a network trained without it; the language is guessed from the text's
own frequent words, never read from a column.

Scoring passes every word of every text, block by block, without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrays import LOWER, WORD, Block, RangeHasher, blocks, mix, ranges_of
from siltstone.llm.frames import discard, map_batches, saved, shared_dir, tidy
from siltstone.llm.labelled import TRAIN_BYTES, collected, labelled_sample, within

#: Labelled rows to learn and calibrate from.
TRAIN_ROWS = 8192
BUCKETS = 1 << 16
PREFIXES = (4, 6, 8)
DIM = 8
WIDTHS, FILTERS = (1, 2, 3), 8
CUT = 0.7
#: Parts of the labelled rows, each scored by a network trained on the others.
PARTS = 4
#: An embedding is learnt only of what occurs in so many training texts.
SEEN = 3
SCORE_BLOCK = 512 << 10

# Frequent words by which a text's language is guessed.
FREQUENT = {
    "en": "the of and to in is that it for was on are as with be this by from or an",
    "fr": "le la les de des du et un une est dans que qui pour par sur pas au avec ou",
    "de": "der die das und ist nicht ein eine zu den von mit sich auf im dem als auch für an",
    "es": "el la los las de del y un una es en que no por con para su se al lo",
}
LANGUAGES = list(FREQUENT)


def _hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(RangeHasher(b)(np.array([0]), np.array([len(b)]))[0])


@dataclass
class Features:
    """Of a block: for each word four embedding rows; per row its range of words and its guessed language."""

    rows: np.ndarray
    at: np.ndarray
    language: np.ndarray


_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _frequent() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent words and, for each, which languages have it."""
    if "frequent" not in _tables:
        known: dict[int, np.ndarray] = {}
        for i, lang in enumerate(LANGUAGES):
            for w in FREQUENT[lang].split():
                known.setdefault(_hash(w), np.zeros(len(LANGUAGES), np.int64))[i] = 1
        keys = np.array(sorted(known), np.uint64)
        _tables["frequent"] = keys, np.stack([known[int(k)] for k in keys])
    return _tables["frequent"]


def features(block: Block) -> Features:
    """Hashed features of every word of a block. Language 4 stands for none."""
    s, e = ranges_of(WORD[block.data], block.offsets)
    at = np.searchsorted(s, block.offsets)
    hashes = RangeHasher(LOWER[block.data])
    whole = hashes(s, e)
    rows = np.empty((len(s), 1 + len(PREFIXES)), np.int32)
    rows[:, 0] = whole % np.uint64(BUCKETS)
    for i, n in enumerate(PREFIXES, 1):
        h = hashes(s, np.minimum(e, s + n))
        rows[:, i] = mix(h + np.uint64(i)) % np.uint64(BUCKETS) + np.uint64(i * BUCKETS)
    keys, which = _frequent()
    place = np.minimum(np.searchsorted(keys, whole), len(keys) - 1)
    hit = np.flatnonzero(keys[place] == whole)
    row = np.searchsorted(at, hit, "right") - 1
    votes = np.zeros((block.rows, len(LANGUAGES)), np.int64)
    np.add.at(votes, row, which[place[hit]])
    return Features(rows, at, np.where(votes.max(1, initial=0) > 0, votes.argmax(1), len(LANGUAGES)) if block.rows else np.zeros(0, np.int64))


@dataclass
class Network:
    """Embeddings, filters and output weights; ``cuts``: the logit from which a text of each language is toxic."""

    table: np.ndarray
    filters: np.ndarray  # DIM x (offset of width, filter)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))

    def forward(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits of texts, pooled values, where each maximum stands, and the words' embeddings.

        A text shorter than a filter is read as if zeros followed.
        """
        n, m = len(at) - 1, len(rows)
        # Zeros between the texts; windows begin at words (of an empty text at its first zero), so none reaches into the next text.
        pad = max(WIDTHS)
        x = np.zeros((m + n * pad, DIM), np.float32)
        place = np.arange(m) + np.repeat(np.arange(n), np.diff(at)) * pad
        for k in range(rows.shape[1]):
            x[place] += self.table[rows[:, k]]
        base = at[:-1] + np.arange(n) * pad
        begins = np.zeros(len(x), bool)
        begins[place] = begins[base] = True
        y = x @ self.filters
        pooled, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
        col = 0
        for i, w in enumerate(WIDTHS):
            z = y[:, col : col + FILTERS].copy()
            for j in range(1, w):
                z[:-j] += y[j:, col + j * FILTERS : col + (j + 1) * FILTERS]
            col += w * FILTERS
            z[~begins] = -np.inf
            top = np.maximum.reduceat(z, base) if n else z[:0]
            pooled[:, i * FILTERS : (i + 1) * FILTERS] = top
            if self._trace:
                ends = np.append(base[1:], len(x))
                for r in range(n):
                    where[r, i * FILTERS : (i + 1) * FILTERS] = base[r] + z[base[r] : ends[r]].argmax(0)
        active = np.maximum(pooled + self.bias, 0)
        return active @ self.out + self.shift, active, where, place

    _trace = False

    def logits(self, f: Features) -> np.ndarray:
        return self.forward(f.rows, f.at)[0].astype(np.float64)

    def scores(self, f: Features) -> np.ndarray:
        """0 to 1; the language's cut comes to lie at CUT."""
        z = self.logits(f) - self.cuts[f.language] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _first_table(bags: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Embeddings to begin with: one coordinate has how much likelier texts with the feature are toxic."""
    size = (1 + len(PREFIXES)) * BUCKETS
    count = np.zeros((2, size))
    for b, label in zip(bags, y, strict=True):
        count[int(label)][np.unique(b)] += 1
    total, prior = count.sum(0), y.mean()
    rate = (count[1] + 10 * prior) / (total + 10)
    odds = np.log(rate / (1 - rate)) - np.log(prior / (1 - prior))
    table = (0.02 * rng.standard_normal((size, DIM))).astype(np.float32)
    table[:, 0] = 0.5 * odds
    table[total < SEEN] = 0
    return table


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.03, seed: int = 7) -> Network:
    """Fit by adaptive gradient steps on the log loss. Without rows of both labels the logit is that of the mean."""
    rng = np.random.default_rng(seed)
    wide = sum(WIDTHS) * FILTERS
    size = (1 + len(PREFIXES)) * BUCKETS
    mean = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Network(np.zeros((size, DIM), np.float32), np.zeros((DIM, wide), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    net = Network(
        _first_table(bags, y, rng),
        (0.3 * rng.standard_normal((DIM, wide))).astype(np.float32),
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        np.full(len(WIDTHS) * FILTERS, 0.15, np.float32),
        float(np.log(mean / (1 - mean))) - 1.0,
    )
    net.filters[0] = np.abs(net.filters[0]) + 0.2
    learnable = np.any(net.table != 0, axis=1)
    net._trace = True
    squares = {k: np.full_like(getattr(net, k), 1e-3) for k in ("table", "filters", "bias", "out")}
    shift_square = 1e-3
    order = np.arange(len(bags))
    for _ in range(epochs):
        rng.shuffle(order)
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            rows = np.concatenate([bags[k] for k in own])
            at = np.concatenate([[0], np.cumsum([len(bags[k]) for k in own])])
            logit, active, where, place = net.forward(rows, at)
            d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - y[own]).astype(np.float32) / len(own)
            g_out = active.T @ d + 1e-4 * net.out
            g_pool = d[:, None] * net.out * (active > 0)
            g_bias = g_pool.sum(0)
            g_filters = 1e-4 * net.filters
            word_at = np.full(int(place[-1]) + 2 * max(WIDTHS) + 1 if len(place) else 1, -1, np.int64)
            word_at[place] = np.arange(len(rows))
            hit_words, hit_grads = [], []
            col = 0
            for k, w in enumerate(WIDTHS):
                for j in range(w):
                    pos = np.minimum(where[:, k * FILTERS : (k + 1) * FILTERS] + j, len(word_at) - 1)
                    word = word_at[pos]
                    r, f = np.nonzero(word >= 0)
                    picked = word[r, f]
                    grad = g_pool[r, k * FILTERS + f]
                    c = col + j * FILTERS + f
                    x = net.table[rows[picked]].sum(1)
                    np.add.at(g_filters.T, c, grad[:, None] * x)
                    hit_words.append(picked)
                    hit_grads.append(grad[:, None] * net.filters[:, c].T)
                col += w * FILTERS
            words, grads = np.concatenate(hit_words), np.concatenate(hit_grads)
            slots, back = np.unique(rows[words], return_inverse=True)
            g_table = np.zeros((len(slots), DIM), np.float32)
            np.add.at(g_table, back.reshape(-1, rows.shape[1]), grads[:, None, :])
            g_table[~learnable[slots]] = 0
            squares["table"][slots] += g_table**2
            net.table[slots] -= rate * g_table / np.sqrt(squares["table"][slots])
            for name, g in (("filters", g_filters), ("bias", g_bias), ("out", g_out)):
                squares[name] += g * g
                setattr(net, name, getattr(net, name) - rate * g / np.sqrt(squares[name]))
            g_shift = float(d.sum())
            shift_square += g_shift**2
            net.shift -= rate * g_shift / shift_square**0.5
    net._trace = False
    return net


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit between two neighbours from which calling toxic makes the fewest errors."""
    order = np.argsort(logit, kind="stable")
    z, t = logit[order], y[order]
    # Errors if all from position i on are called toxic.
    errors = np.concatenate([[0], np.cumsum(t == 1)]) + np.concatenate([np.cumsum((t == 0)[::-1])[::-1], [0]])
    edge = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
    least = np.flatnonzero(errors == errors.min())
    return float(edge[least[len(least) // 2]])


def unseen_logits(bags: list[np.ndarray], y: np.ndarray, part: np.ndarray, p: int, seed: int = 7) -> np.ndarray:
    """The logits of the texts of part ``p`` from a network trained on the other parts."""
    net = train([b for b, q in zip(bags, part, strict=True) if q != p], y[part != p], seed=seed)
    own = [bags[i] for i in np.flatnonzero(part == p)]
    return np.array([net.forward(b, np.array([0, len(b)]))[0][0] for b in own])


def train_all(spark: SparkSession, bags: list[np.ndarray], y: np.ndarray, part: np.ndarray, seed: int = 7) -> tuple[Network, np.ndarray]:
    """The network of all texts, and each text's logit from one trained without its part.

    One task trains one network. Each gets all texts, whose features are bounded, by broadcast.
    """
    parts = [int(p) for p in np.unique(part)]
    shared = spark.sparkContext.broadcast((bags, y, part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            own = shared.value
            made = train(own[0], own[1], seed=seed) if i == len(parts) else unseen_logits(*own, parts[i], seed)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(made)], pa.binary())], names=["id", "made"])

    tasks = spark.range(0, len(parts) + 1, 1, len(parts) + 1)
    made = {r.id: pickle.loads(r.made) for r in tasks.mapInArrow(tidy(run), "id long, made binary").collect()}
    shared.destroy()
    logit = np.zeros(len(bags))
    for i, p in enumerate(parts):
        logit[part == p] = made[i]
    return made[len(parts)], logit


def calibrate(net: Network, logit: np.ndarray, language: np.ndarray, y: np.ndarray, least: int = 5) -> None:
    """Set the cuts: of a language with at least that many rows of each label its own, else the one of all."""
    if not len(logit) or len(set(y.tolist())) < 2:
        return
    net.cuts[:] = best_cut(logit, y)
    for i in range(len(net.cuts)):
        own = language == i
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= least:
            net.cuts[i] = best_cut(logit[own], y[own])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_out: int = 1, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, seed: int = 7) -> Network:
    """A network fitted to at most ``max_rows`` labelled rows outside the held-out fold; the cuts are calibrated on all
    of them, by networks that each leave out a quarter. Null texts, keys and labels aren't used. The driver gets hashed words of these rows
    only, whole texts of at most ``max_bytes`` together (16 bytes a word).
    """

    def fn(texts: pa.Array) -> dict[str, pa.Array]:
        out, language = [], []
        for b in blocks(texts, SCORE_BLOCK):
            f = features(b)
            out += [f.rows[f.at[i] : f.at[i + 1]].ravel() for i in range(b.rows)]
            language.append(f.language)
        return {"x": pa.array(out, pa.list_(pa.int32())), "lang": pa.array(np.concatenate(language).astype(np.int32))}

    sample = labelled_sample(docs, labels, key, text, label, folds, held_out, max_rows)
    made = map_batches(sample, fn, ["t"], {"x": T.ArrayType(T.IntegerType()), "lang": T.IntegerType()}, ["k", "y"])
    part = (F.crc32(F.concat(F.lit("part:"), F.col("k").cast("string")).cast("binary")) % PARTS).cast("int").alias("part")
    folder = shared_dir(docs.sparkSession)
    made = saved(made.select(F.col("k").cast("string").alias("k"), "y", part, "lang", "x"), folder=folder)
    got, bags = collected(within(made, 4 * F.size("x").cast("long"), max_bytes), "x", np.int32, 1 + len(PREFIXES))
    discard(docs.sparkSession, folder)
    y, language, part = np.asarray(got["y"], np.float64), np.asarray(got["lang"], np.int64), np.asarray(got["part"], np.int64)
    if len(set(y.tolist())) < 2:
        return train(bags, y, seed=seed)
    net, logit = train_all(docs.sparkSession, bags, y, part, seed)
    calibrate(net, logit, language, y)
    return net


def score(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None, output: str = "score") -> DataFrame:
    """The columns of ``keep`` (all by default) and ``score``, 0 to 1: how likely the whole text is toxic.

    From 0.7 on it counts as toxic in its language. A null or empty text has no words and gets the
    score of that. Repeated rows score alike; an empty table gives none; a kept column named like the output
    gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def fn(texts: pa.Array) -> dict[str, pa.Array]:
        model = shared.value
        return {output: pa.array(np.concatenate([model.scores(features(b)) for b in blocks(texts, SCORE_BLOCK)]))}

    return map_batches(docs, fn, [text], {output: T.DoubleType()}, docs.columns if keep is None else keep)


def toxic(score: Column) -> Column:
    """1 if a score counts as toxic, else 0."""
    return (score >= CUT).cast("int")
