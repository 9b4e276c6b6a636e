"""Document quality from a linear-chain conditional random field over lines.

Every line with a word in it is labelled good or bad. A line's features are binned shares (symbols, capitals, digits,
repeated words, ...) of the line itself and of its two neighbours; transitions link the labels of neighbouring lines.
The forward-backward marginals of the lines, weighted by their lengths, add up to the document's score.

Defined cases: a text without words (null, empty, blanks only) gets the share of good documents among the labelled
ones; without labelled rows every score is 0.5; labels that are null or contradict each other count as bad or are
left out; repeated rows get equal scores; other columns are carried. Very long texts take no special path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelfill.llm.common import SpanHasher, as_bytes, byte_values, text_slices

BLOCK = 1 << 20
MAX_TRAINING_DOCS = 8000
SEGMENT = 128
UPPER, LOWER, DIGIT, SPACE, STOP, SYMBOL, QUOTE, WIDE = range(8)
KIND = np.full(256, QUOTE, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = UPPER, LOWER, DIGIT, WIDE
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[[ord(c) for c in ".,;:?"]] = STOP
KIND[[ord(c) for c in "#*$%&|<>!@^~=+_\\/{}[]"]] = SYMBOL
SHARE_EDGES = np.array([0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8])
LENGTH_EDGES = np.array([2, 4, 8, 16, 32, 64, 128, 256])
BINS = 10  # nine bins and one for a neighbour that is not there
FEATURES = 11


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of each line with a word (lines x FEATURES), its length in bytes, and the number of its text."""
    block = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind, hasher = KIND[block], SpanHasher()
    hasher.load(block, byte_values(6))
    ends = np.flatnonzero(block == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    solid = kind != SPACE
    edges = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    word_starts, word_ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    first = np.searchsorted(word_starts, np.append(starts, len(block)))
    words = np.diff(first)
    keep = words > 0
    starts, ends, text, words, first = starts[keep], ends[keep], text[keep], words[keep], first[:-1][keep]
    size = ends - starts
    counts = [np.diff(np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])[np.stack([starts, ends])], axis=0)[0] for k in range(8)]
    hashes = hasher.of(word_starts, word_ends)
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]))])
    repeats = again[first + words] - again[np.minimum(first + 1, len(again) - 1)]
    last_kind = kind[word_ends - 1] if len(word_ends) else np.zeros(0, np.uint8)
    closing = np.concatenate([[0], np.cumsum(last_kind == SYMBOL)])
    symbol_ends = closing[first + words] - closing[first]
    lone = np.concatenate([[0], np.cumsum((word_ends - word_starts == 1) & (last_kind == SYMBOL))])
    lone_symbols = lone[first + words] - lone[first]
    key = hasher.of(starts, ends) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seen = np.ones(len(key), bool)
    seen[np.unique(key, return_index=True)[1]] = False
    letters = counts[UPPER] + counts[LOWER] + 1
    shares = np.stack([counts[UPPER] / letters, counts[DIGIT] / size, counts[STOP] / size, counts[SYMBOL] / size, counts[QUOTE] / size,
                       counts[WIDE] / size, repeats / words, symbol_ends / words, lone_symbols / words], 1) if len(size) else np.zeros((0, 9))
    bins = np.concatenate([np.searchsorted(SHARE_EDGES, shares.ravel()).reshape(shares.shape),
                           np.searchsorted(LENGTH_EDGES, words)[:, None], seen[:, None]], 1)
    return bins.astype(np.uint8), size, text


def with_neighbours(bins: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """Features of the line itself, the one before and the one after: lines x 3 FEATURES, numbered across features."""
    same = sequence[1:] == sequence[:-1]
    before, after = np.full_like(bins, BINS - 1), np.full_like(bins, BINS - 1)
    before[1:][same], after[:-1][same] = bins[:-1][same], bins[1:][same]
    return np.concatenate([bins, before, after], 1) + BINS * np.arange(3 * FEATURES)


class Lattice:
    """Sequences laid side by side, the longest first; each step handles the sequences that are that long."""

    def __init__(self, sequence: np.ndarray):
        new = np.concatenate([[True], sequence[1:] != sequence[:-1]]) if len(sequence) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(sequence)))
        order = np.argsort(-self.sizes, kind="stable")
        self.starts, self.sizes = self.starts[order], self.sizes[order]
        self.alive = np.searchsorted(-self.sizes, -np.arange(self.sizes[0] if len(order) else 0), "left")

    def marginals(self, emission: np.ndarray, transition: np.ndarray, pairs: bool = False):
        """Share of the good label for each line, the log partition sum, and expected label pairs if asked for."""
        psi = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], 1)
        move, forward, total = np.exp(transition), np.empty_like(psi), 0.0
        for t, n in enumerate(self.alive):
            at = self.starts[:n] + t
            own = psi[at] * (forward[at - 1] @ move) if t else psi[at]
            norm = own.sum(1)
            forward[at] = own / norm[:, None]
            total += np.log(norm).sum()
        good, expected = np.empty(len(psi)), np.zeros((2, 2))
        back = np.ones((len(self.starts), 2))
        for t in range(len(self.alive) - 1, -1, -1):
            n = self.alive[t]
            at = self.starts[:n] + t
            both = forward[at] * back[:n]
            good[at] = both[:, 1] / both.sum(1)
            if t:
                ahead = psi[at] * back[:n]
                if pairs:
                    joint = forward[at - 1][:, :, None] * move * ahead[:, None, :]
                    expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                ahead = ahead @ move.T
                back[:n] = ahead / ahead.sum(1, keepdims=True)
        return good, total, expected


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted marginals of each text's lines."""
        bins, size, text = line_features(texts)
        good, _, _ = Lattice(text).marginals(self.emission(with_neighbours(bins, text)), self.transition)
        weight = np.bincount(text, size, len(texts))
        out = np.bincount(text, size * good, len(texts)) / np.maximum(weight, 1)
        return np.where(weight > 0, np.clip(out, 0, 1), self.prior)

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weights[:-1][features].sum(1) + self.weights[-1]


def fit(bins: np.ndarray, sequence: np.ndarray, label: np.ndarray, prior: float, penalty: float = 1.0, rounds: int = 60) -> Model:
    """Maximum penalised likelihood by a quasi-Newton search. ``label`` is that of the line's document."""
    features, lattice = with_neighbours(bins, sequence), Lattice(sequence)
    width, gold = 3 * FEATURES * BINS + 1, label.astype(float)
    inner = np.flatnonzero(sequence[1:] == sequence[:-1]) if len(sequence) else np.zeros(0, int)
    gold_pairs = np.bincount(2 * label[inner] + label[inner + 1], minlength=4).reshape(2, 2)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        own = Model(x[:width], x[width:].reshape(2, 2), prior)
        emission = np.clip(own.emission(features), -30, 30)
        good, total, pairs = lattice.marginals(emission, own.transition, pairs=True)
        value = total - (gold * emission).sum() - (gold_pairs * own.transition).sum() + penalty * (x ** 2).sum() / 2
        slope = np.bincount(features.ravel(), np.repeat(good - gold, features.shape[1]), width)
        slope[width - 1] = (good - gold).sum()
        return value, np.concatenate([slope, (pairs - gold_pairs).ravel()]) + penalty * x

    x = _minimised(loss, np.zeros(width + 4), rounds) if len(features) else np.zeros(width + 4)
    return Model(x[:width], x[width:].reshape(2, 2), prior)


def _minimised(loss: Callable, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    value, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = slope.copy(), []
        for s, y in reversed(steps):
            a = s @ way / (s @ y)
            way -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            way *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            way += (a - y @ way / (s @ y)) * s
        rate, drop = (1.0 if steps else 1 / max(1.0, np.abs(slope).sum())), slope @ way
        while True:
            new_value, new_slope = loss(x - rate * way)
            if new_value <= value - 1e-4 * rate * drop or rate < 1e-8:
                break
            rate /= 2
        if rate < 1e-8 or value - new_value < 1e-6 * abs(value):
            return x - rate * way if new_value < value else x
        step, change = -rate * way, new_slope - slope
        if step @ change > 1e-12:
            steps = [*steps, (step, change)][-memory:]
        x, value, slope = x + step, new_value, new_slope
    return x


def held_out() -> F.Column:
    """Rows kept out of training: the CRC-32 of the id's text is divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled documents outside the held-out fold, picked by the hash of their id.

    Executors turn the documents into line bins; only those come to the driver, in an amount bounded by ``max_docs``.
    """
    picked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in text_slices(column, BLOCK):
                bins, _, text = line_features([t or b"" for t in as_bytes(column.slice(lo, hi - lo))])
                at = np.searchsorted(text, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("quality").slice(lo, hi - lo),
                     pa.array([bins[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "quality", "bins"])

    rows = sorted((r["doc_id"], r["quality"], bytes(r["bins"])) for r in chosen.mapInArrow(featured, "doc_id long, quality int, bins binary").toLocalIterator())
    bins, sequence, label, number = [], [], [], 0
    for _, quality, raw in rows:
        own = np.frombuffer(raw, np.uint8).reshape(-1, FEATURES)
        bins.append(own)
        sequence.append(number + np.arange(len(own)) // SEGMENT)
        label.append(np.full(len(own), int(quality > 0)))
        number += len(own) // SEGMENT + 1
    prior = float(np.mean([q > 0 for _, q, _ in rows])) if rows else 0.5
    if not rows:
        bins, sequence, label = [np.zeros((0, FEATURES), np.uint8)], [np.zeros(0, int)], [np.zeros(0, int)]
    return fit(np.concatenate(bins), np.concatenate(sequence), np.concatenate(label), prior)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score``, 0 to 1, higher for better ones."""
    names = [c for c in docs.columns if c != "score"]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            parts = [model.scores([t or b"" for t in as_bytes(column.slice(lo, hi - lo))]) for lo, hi in text_slices(column, BLOCK)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate([*parts, np.zeros(0)]))], [*names, "score"])

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(score, schema)


def predicted(threshold: float = 0.3) -> F.Column:
    return (F.col("score") >= threshold).cast("int")
