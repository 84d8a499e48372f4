"""Quality score by a generalised additive model with pairwise interactions.

Every text becomes a row of surface statistics (`FEATURES`), computed over the whole text in
one Arrow pass and stored. The model is a lookup table per feature and per chosen pair of
features. Tables grow by cyclic boosting: in turn, each feature adds a shallow tree over its
bins, fitted to the current gradients; then the pairs with the largest gain do the same over
two features. A score is the sum of the tables' entries at a row's bins, so scoring is a
`searchsorted` and an addition per table over a whole batch.

The model is fitted on at most `TRAIN_ROWS` labelled rows, those whose id hashes lowest,
which bounds what the driver holds; statistics and scores cover all documents.

Defined cases: null and empty texts have statistics of zero and are scored like any row;
labels without quality are not used, and of several labels of an id each counts; without
both classes among the training rows every score is the share of the class there is (0.5
without rows); a null doc_id is hashed as an empty string and never labelled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map, chunks, held_out
from haulbook.session import materialize

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "distinct_pairs", "top_word", "same_as_before",
    "upper", "digit", "symbol", "other_byte", "space", "distinct_lines", "line_words", "end_marks",
    "capital_words", "long_words", "byte_entropy",
)
TRAIN_ROWS = 30_000
FOLDS, HELD_FOLD = 5, 0
ACCEPT = 0.3
BINS, CYCLES, PAIRS, PAIR_CYCLES, RATE = 32, 40, 6, 15, 0.2


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, n_words = len(raw), len(words)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    share = counts[counts > 0] / n
    letters = int(counts[65:91].sum() + counts[97:123].sum())
    other = int(counts[128:].sum())
    digits = int(counts[48:58].sum())
    spaces = int(counts[32] + counts[9:14].sum())
    capitals = sum(65 <= w[0] <= 90 for w in words)
    return [
        np.log1p(n), np.log1p(n_words), (n - spaces) / n_words, len(kinds) / n_words,
        len(set(zip(words, words[1:]))) / max(n_words - 1, 1), max(kinds.values()) / n_words,
        sum(map(bytes.__eq__, words, words[1:])) / n_words,
        int(counts[65:91].sum()) / max(letters, 1), digits / n, (n - letters - other - digits - spaces) / n,
        other / n, spaces / n, len(set(lines)) / len(lines), np.log1p(n_words / len(lines)),
        sum(w[-1] in b".!?" for w in words) / n_words, capitals / n_words,
        sum(len(w) > 14 for w in words) / n_words, float(-(share * np.log2(share)).sum()),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""

    def work(batches):
        for batch in chunks(batches, "text"):
            yield {"doc_id": batch.column("doc_id"), "features": [statistics(t) for t in batch.column("text").to_pylist()]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, features array<float>")


@dataclass
class Additive:
    """Bin edges of each feature, tables of single features and of pairs."""

    base: float
    edges: list[np.ndarray]
    singles: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for i, t in enumerate(self.singles):
            out += t[bins[:, i]]
        for i, j, t in self.pairs:
            out += t[bins[:, i], bins[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(self.bins(x))))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float = 5.0) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins by gradient and curvature."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]) if len(gain) else 0.0), at + 1


def _shallow(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree over ordered bins, as the value of each bin."""
    gain, cut = _best_cut(g, h)
    if not depth or gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_shallow(g[:cut], h[:cut], depth - 1), _shallow(g[cut:], h[cut:], depth - 1)])


def _shallow_pair(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A cut of one feature and a cut of the other on each side: gain and values."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        top_g, top_h = np.cumsum(a, axis=0)[:-1], np.cumsum(b, axis=0)[:-1]
        for cut in range(1, len(a)):
            gain, values = 0.0, np.zeros_like(a)
            for rows, sg, sh in ((slice(0, cut), top_g[cut - 1], top_h[cut - 1]), (slice(cut, None), a.sum(0) - top_g[cut - 1], b.sum(0) - top_h[cut - 1])):
                _, at = _best_cut(sg, sh)
                for cols in (slice(0, at), slice(at, None)):
                    s, c = sg[cols].sum(), sh[cols].sum()
                    gain += s * s / (c + 1)
                    values[rows, cols] = s / (c + 1)
            if gain > best[0]:
                best = gain, values.T if turn else values
    return best


def fit(x: np.ndarray, y: np.ndarray, cycles: int = CYCLES, pairs: int = PAIRS) -> Additive:
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Additive(float(np.log(share / (1 - share))), [np.zeros(0)] * width, [np.zeros(1)] * width, [])
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(width)]
    share = y.mean()
    model = Additive(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    bins, margin = model.bins(x), np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for i, table in enumerate(model.singles):
            g, h = (np.bincount(bins[:, i], weights=s, minlength=len(table)) for s in slopes())
            step = RATE * _shallow(g, h)
            table += step
            margin += step[bins[:, i]]
    # Interactions: what two features explain together beyond their own tables.
    coarse = [np.minimum(bins[:, i] * 8 // len(model.singles[i]), 7) for i in range(width)]
    g, h = slopes()
    gains = []
    for i in range(width):
        for j in range(i):
            cell = coarse[i] * 8 + coarse[j]
            gain, _ = _shallow_pair(*(np.bincount(cell, weights=s, minlength=64).reshape(8, 8) for s in (g, h)))
            gains.append((gain, i, j))
    model.pairs = [(i, j, np.zeros((len(model.singles[i]), len(model.singles[j])))) for _, i, j in sorted(gains)[::-1][:pairs]]
    for _ in range(PAIR_CYCLES):
        for i, j, table in model.pairs:
            n = table.shape[1]
            cell = bins[:, i] * n + bins[:, j]
            g, h = (np.bincount(cell, weights=s, minlength=table.size).reshape(table.shape) for s in slopes())
            step = RATE * _shallow_pair(g, h)[1]
            table += step
            margin += step[bins[:, i], bins[:, j]]
    return model


def sampled_labels(labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """doc_id and y of at most `most` labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where(~held_out(F.col("doc_id"), folds, fold))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)


def trained(feats: DataFrame, known: DataFrame) -> Additive:
    rows = feats.join(known, "doc_id").orderBy("doc_id", "y", "features").select("features", "y").toPandas()
    x = np.array(rows.features.tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows.y.to_numpy(dtype=np.float64))


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_FOLD, accept: float = ACCEPT, most: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    feats = materialize(features(docs), "quality-features")
    model = trained(feats, sampled_labels(labels, "quality", folds, fold, most))

    def work(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
            scores = model.scores(x)
            yield {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= accept).astype(np.int32)}

    scored = arrow_map(feats, work, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    # At most TRAIN_ROWS pairs of numbers: a bounded broadcast, so the texts are not shuffled.
    known = docs.sparkSession.createDataFrame(
        sampled_labels(labels, "quality", FOLDS, HELD_FOLD, TRAIN_ROWS).toPandas(), "doc_id long, y double"
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    model = trained(features(sample), known)

    def work(batches):
        for batch in chunks(batches, "text"):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=np.float32).astype(np.float64)
            good = model.scores(x.reshape(-1, len(FEATURES))) >= accept
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
