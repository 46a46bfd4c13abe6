"""Operator 10: quality classifier, a generalised additive model with pairwise interactions.

Each feature has a lookup table over quantile bins; the tables are learned by cyclic boosting: round after round, each
feature in turn gets a shallow tree (at most three leaves over its bins) fitted to the current residuals. Then the
pairs of features with the largest remaining gain get two-dimensional tables in the same way. A score is the sum of
one entry of each table, which is a vectorised gather and addition.

Fitting uses a bounded, documented sample of labelled rows (``max_rows``) on the driver; scoring covers every row.

Edge cases: a null or empty text has all-zero features and gets the score those have; extra columns are ignored; an
empty table gives an empty result; without any labelled row every score is 0.5, with one class only its prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import tidy
from .labelled import labelled_sample
from .stats import measured

MAX_ROWS, CUT = 20_000, 0.3


def _best_leaves(r: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    """Leaf values per bin of the best tree of at most two cuts for residual sums ``r`` and curvature sums ``h``."""
    n = len(r)

    def cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, -1
        cr, ch = np.cumsum(r[lo:hi]), np.cumsum(h[lo:hi])
        gain = cr[:-1] ** 2 / (ch[:-1] + lam) + (cr[-1] - cr[:-1]) ** 2 / (ch[-1] - ch[:-1] + lam) - cr[-1] ** 2 / (ch[-1] + lam)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    bounds = [0, n]
    for _ in range(2):
        gain, at = max(cut(lo, hi) for lo, hi in zip(bounds, bounds[1:], strict=False))
        if gain <= 1e-9:
            break
        bounds = sorted([*bounds, at])
    out = np.zeros(n)
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        out[lo:hi] = r[lo:hi].sum() / (h[lo:hi].sum() + lam)
    return out


@dataclass
class AdditiveModel:
    """``edges[f]`` cut feature f into bins; ``tables[f]`` and ``pair_tables`` hold the additive terms."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if not self.edges:
            return out
        b = self.bins(x)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[b[:, f] // self.coarse, b[:, g] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6,
    rate: float = 0.15, lam: float = 1.0,
) -> AdditiveModel:
    """Cyclic boosting of one table per feature, then of the ``n_pairs`` most useful pairs."""
    m = AdditiveModel()
    if not len(y):
        return m
    prior = (y.sum() + 0.5) / (len(y) + 1)
    m.intercept = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return m
    k = x.shape[1]
    m.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(k)]
    b = m.bins(x)
    size = [len(e) + 1 for e in m.edges]
    m.tables = [np.zeros(s) for s in size]
    z = np.full(len(y), m.intercept)

    def push() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(k):
            r, h = push()
            step = rate * _best_leaves(np.bincount(b[:, f], r, size[f]), np.bincount(b[:, f], h, size[f]), lam)
            m.tables[f] += step
            z += step[b[:, f]]
    c = b // m.coarse
    width = [(s - 1) // m.coarse + 1 for s in size]

    def grid(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, f] * width[g] + c[:, g], v, width[f] * width[g]).reshape(width[f], width[g])

    def best_cross(r: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The tree of one cut on either axis, crossed, with the largest gain."""
        best, out = 0.0, np.zeros(r.shape)
        whole = r.sum() ** 2 / (h.sum() + lam)
        for i in range(1, r.shape[0]):
            for j in range(1, r.shape[1]):
                parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
                sums = [(r[p].sum(), h[p].sum() + lam) for p in parts]
                gain = sum(s * s / t for s, t in sums) - whole
                if gain > best:
                    best, out = gain, np.zeros(r.shape)
                    for p, (s, t) in zip(parts, sums, strict=True):
                        out[p] = s / t
        return best, out

    r, h = push()
    ranked = sorted(((best_cross(grid(f, g, r), grid(f, g, h))[0], f, g) for f in range(k) for g in range(f + 1, k)), reverse=True)
    m.pairs = [(f, g) for gain, f, g in ranked[:n_pairs] if gain > 0]
    m.pair_tables = [np.zeros((width[f], width[g])) for f, g in m.pairs]
    for _ in range(pair_rounds):
        for t, (f, g) in zip(m.pair_tables, m.pairs, strict=True):
            r, h = push()
            step = rate * best_cross(grid(f, g, r), grid(f, g, h))[1]
            t += step
            z += step[c[:, f], c[:, g]]
    return m


def quality_scores(documents: DataFrame, model: AdditiveModel) -> DataFrame:
    """All columns of ``documents`` but text and clashing ones are dropped: doc_id and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, f = measured(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(f))], ["doc_id", "score"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id bigint, score double")


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``max_rows`` of them."""
    _, x, y = labelled_sample(documents, labels, "quality", max_rows, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return fit(x, y)


def accepted(documents: DataFrame, model: AdditiveModel, cut: float = CUT) -> DataFrame:
    """The rows of ``documents``, all columns kept, whose score is at least ``cut``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(measured(b)[1]) >= cut))

    return documents.mapInArrow(tidy(run), documents.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_scores(documents, train(documents, labels))
    return scores.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
