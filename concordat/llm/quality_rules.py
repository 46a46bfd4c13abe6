"""Operator 3: quality rules, an isolation forest over rule statistics.

Fixed rules reject a text of fewer than 50 words, or one of which more than half of the words stand in repeated
three-word windows. Every other text is judged by an isolation forest over the rule statistics: random cuts within the
box that all labelled rows span isolate rows labelled good; a statistic that never varies among good texts so still
gets cuts. The mean path length of a text gives its anomaly score, and texts above a calibrated threshold go.

Nothing is fitted on a sample: the box spans all labelled rows, Spark counts all good rows in every cell of the random
cuts, and the threshold is that of all labelled rows' scores. Only the box, the cells' counts (``trees`` x 2 ** ``depth`` at
most) and runs of at most ``HELD`` scores reach the driver. The threshold is the anomaly score that best separates the
labelled classes among those that reject at most ``max_loss`` of the texts labelled good. Every text is measured whole.

Edge cases: a null or empty text has no words and fails the base rules; extra columns are ignored; an empty table
gives an empty result; without labelled rows of both classes only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import drop_tables, tidy, written
from .stats import BASE, FEATURES, measured

TREES, DEPTH, MAX_LOSS = 120, 10, 0.002
HELD = 10_000  # scores that the driver sorts at once
MIN_WORDS, MAX_REPEAT = 50, 50
RULES = [
    FEATURES.index(x)
    for x in (
        "symbol", "exclaim", "pipe", "upper", "digit", "other", "dup_lines", "word_len", "sentence", "comma",
        "short_words", "long_words", "line_words",
    )
]


def _mean_depth(n: np.ndarray) -> np.ndarray:
    """Expected depth of a random binary tree over n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Complete binary trees in arrays: node i has the children 2i+1 and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    norm: float

    @classmethod
    def drawn(cls, lo: np.ndarray, hi: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> IsolationForest:
        """Random cuts within the box ``lo``..``hi``; path lengths come with ``counted``."""
        rng = np.random.default_rng(seed)
        n = 2 ** (depth + 1) - 1
        feature, cut = np.full((trees, n), -1), np.zeros((trees, n))
        for t in range(trees):
            stack = [(0, 0, lo, hi)]
            while stack:
                i, d, low, high = stack.pop()
                free = np.flatnonzero(high > low)
                if d == depth or not len(free):
                    continue
                f = rng.choice(free)
                at = rng.uniform(low[f], high[f])
                feature[t, i], cut[t, i] = f, at
                below, above = high.copy(), low.copy()
                below[f] = above[f] = at
                stack += [(2 * i + 1, d + 1, low, below), (2 * i + 2, d + 1, above, high)]
        return cls(feature, cut, np.zeros((trees, n)), 1.0)

    def counted(self, ends: np.ndarray) -> IsolationForest:
        """With path lengths from the number of rows that end in each node; nodes of fewer than two rows become leaves."""
        n = ends.astype(np.int64)
        for i in range(n.shape[1] - 1, 0, -1):
            n[:, (i - 1) // 2] += n[:, i]
        leaf = (self.feature < 0) | (n < 2)
        depth = np.floor(np.log2(np.arange(1, n.shape[1] + 1)))
        norm = float(_mean_depth(n[:1, 0])[0]) or 1.0
        return IsolationForest(np.where(leaf, -1, self.feature), self.cut, np.where(leaf, depth + _mean_depth(n), 0.0), norm)

    @classmethod
    def fit(cls, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> IsolationForest:
        """The forest of rows at hand."""
        forest = cls.drawn(lo, hi, trees, depth, seed)
        return forest.counted(forest.ends(x))

    def ends(self, x: np.ndarray) -> np.ndarray:
        """How many of the rows end in each node, trees x nodes."""
        return np.stack([np.bincount(at, minlength=self.feature.shape[1]) for at in self._walked(x)])

    def _walked(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The node in which each row ends, tree by tree."""
        rows = np.arange(len(x))
        for feature, cut in zip(self.feature, self.cut, strict=True):
            at = np.zeros(len(x), int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 1 + (x[rows, f] > cut[at]), at)
            yield at

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for rows that few cuts isolate."""
        total = np.zeros(len(x))
        for length, at in zip(self.length, self._walked(x), strict=True):
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


@dataclass
class QualityRules:
    forest: IsolationForest | None
    threshold: float

    def anomaly(self, f: np.ndarray) -> np.ndarray:
        return np.zeros(len(f)) if self.forest is None or not len(f) else self.forest.anomaly(f[:, RULES])


def calibrated(score: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The threshold: as low as ``max_loss`` of the good rows allows, then up into the widest gap below a bad row."""
    floor = np.quantile(score[good], 1 - max_loss)
    bad = score[~good & (score > floor)]
    return float((floor + bad.min()) / 2) if len(bad) else float("inf")


def _value_at(scores: DataFrame, k: int, held: int = HELD) -> float:
    """The score of rank k (from 0) among all of ``scores(score)``: a range is narrowed until it has few rows or one value."""
    below = 0
    while True:
        lo, hi, n = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
        if lo == hi:
            return lo
        if n <= held:
            return sorted(r[0] for r in scores.collect())[k - below]
        bins = scores.groupBy(F.least(F.floor((F.col("score") - lo) / (hi - lo) * 1000), F.lit(999)).alias("bin"))
        for r in sorted(bins.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()):
            if k < below + r["n"]:
                scores = scores.where(F.col("score").between(r["lo"], r["hi"]))
                break
            below += r["n"]


def calibrated_over(scores: DataFrame, n_good: int, max_loss: float = MAX_LOSS, held: int = HELD) -> float:
    """``calibrated`` over a table (score, label) with ``n_good`` rows of label 1."""
    good = scores.where("label = 1").select("score")
    at = (n_good - 1) * (1 - max_loss)
    k = int(at)
    floor = _value_at(good, k, held)
    if at > k:
        floor += (at - k) * (_value_at(good, k + 1, held) - floor)
    least = scores.where((F.col("label") != 1) & (F.col("score") > floor)).agg(F.min("score")).first()[0]
    return float("inf") if least is None else (floor + least) / 2


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rule statistics of texts that pass the base rules; the forest decides only on those."""
    for b in batches:
        _, x = measured(b)
        judged = (x[:, FEATURES.index("log_words")] >= np.log1p(MIN_WORDS)) & (100 * x[:, FEATURES.index("repeat_words")] <= MAX_REPEAT)
        ids = b.column("doc_id").filter(pa.array(judged, pa.bool_()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(list(x[judged][:, RULES]), pa.list_(pa.float64()))], ["doc_id", "f"])


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column("f").flatten().to_numpy().reshape(b.num_rows, len(RULES))


def train(documents: DataFrame, labels: DataFrame) -> QualityRules:
    spark = documents.sparkSession
    # a document labelled twice counts with its lower label
    of = labels.select("doc_id", F.col("quality").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = written(texts.mapInArrow(tidy(_judged), "doc_id bigint, f array<double>").join(of, "doc_id").select("label", "f"), "judged")
    good = F.col("label") == 1
    edges = [g(F.col("f")[i]) for g in (F.min, F.max) for i in range(len(RULES))]
    n, n_good, *edges = rows.agg(F.count("*"), F.count_if(good), *edges).first()
    if n_good < 8 or n_good == n:
        drop_tables(spark, [rows])
        return QualityRules(None, float("inf"))
    drawn = IsolationForest.drawn(*np.array(edges).reshape(2, -1))
    cuts = spark.sparkContext.broadcast(drawn)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cuts.value.feature.shape, np.int64)
        for b in batches:
            total += cuts.value.ends(_rows(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["node", "n"])

    counts = rows.where(good).select("f").mapInArrow(ends, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(drawn.feature.size, np.int64)
    total[counts["node"].to_numpy()] = counts["n"].to_numpy()
    forest = drawn.counted(total.reshape(drawn.feature.shape))
    shared = spark.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(shared.value.anomaly(_rows(b)))], ["label", "score"])

    scores = written(rows.mapInArrow(scored, "label int, score double"), "scores")
    threshold = calibrated_over(scores, n_good)
    drop_tables(spark, [rows, scores])
    return QualityRules(forest, threshold)


def apply_rules(documents: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per document: the five counts, ``base_failed``, ``anomaly`` and ``kept``."""
    shared = documents.sparkSession.sparkContext.broadcast(rules)
    names = ["doc_id", *BASE, "anomaly"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, f = measured(b)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(shared.value.anomaly(f))], names
            )

    out = documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"{x} bigint" for x in BASE) + ", anomaly double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") <= F.lit(rules.threshold)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = apply_rules(documents, train(documents, labels))
    return out.select("doc_id", *BASE, "base_failed", "kept", "anomaly")
