"""Crowd models: latent labels and annotator skill without gold.

The likelihood of an item depends only on its *pattern*, the set of (model, label) it got. Patterns are counted in one
shuffled aggregation, and posteriors come back by joining patterns to items. Every iteration is a pass over the counted
patterns that sums a few statistics (of a size given by models and labels) under the parameters of the last one. Up to
``LOCAL_PATTERNS`` patterns the passes run on the driver; more of them stay a written table, over which each pass is a
Spark job: tasks sum the statistics of their patterns, Spark adds them up, only parameters reach the driver. Both ways
use the same functions and give the same result. Beyond ``DENSE_WORKERS`` annotators, where parameters are too many for the
driver or a closure, they are tables: see ``crowd_keyed``, whose results are the same too.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from . import crowd_keyed

LOCAL_PATTERNS, DENSE_WORKERS = 200_000, 1_000


def patterned(votes: DataFrame, labels: list[str]) -> DataFrame:
    """(item_id, pattern): the sorted model=label entries of an item; labels outside the set are left out."""
    v = votes.where(F.col("label").isin(labels))
    return v.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "model", "label"))), "\x1f").alias("pattern"))


class Patterns:
    """Counted patterns as arrays: pattern p has votes (worker w, label a) at rows of ``at``; ``state`` is a number each."""

    def __init__(self, rows: pd.DataFrame, labels: list[str], workers: list[str]):
        self.labels, self.workers, self.names = labels, workers, rows["pattern"].tolist()
        self.count, self.state = rows["count"].to_numpy(float), rows["state"].to_numpy(float).copy()
        number = {w: i for i, w in enumerate(workers)}
        votes = [(p, *x.rsplit("=", 1)) for p, name in enumerate(self.names) for x in name.split("\x1f")]
        self.p = np.array([v[0] for v in votes], int)
        self.w = np.array([number[v[1]] for v in votes], int)
        self.a = np.array([labels.index(v[2]) for v in votes], int)

    def gather(self, per_vote: np.ndarray) -> np.ndarray:
        """Sums of per-vote rows by pattern."""
        out = np.zeros((len(self.count), per_vote.shape[1]))
        np.add.at(out, self.p, per_vote)
        return out

    def by_worker(self, per_vote: np.ndarray) -> np.ndarray:
        return np.bincount(self.w, per_vote * self.count[self.p], len(self.workers))

    def shares(self, weight: np.ndarray) -> np.ndarray:
        s = self.gather(np.eye(len(self.labels))[self.a] * weight[self.w][:, None])
        total = s.sum(1, keepdims=True)
        return s / np.where(total == 0, 1, total)


class LocalPatterns:
    """Passes over patterns that the driver holds."""

    def __init__(self, d: Patterns):
        self.d, self.labels, self.workers = d, d.labels, d.workers

    def sums(self, f: Callable[[Patterns], np.ndarray], largest: bool = False) -> np.ndarray:
        return f(self.d)

    def change(self, f: Callable[[Patterns], None]) -> None:
        f(self.d)

    def posteriors(self, f: Callable[[Patterns], np.ndarray], session) -> DataFrame:
        rows = _best(self.d, f(self.d))
        return session.createDataFrame(rows, BEST) if len(rows) else session.createDataFrame([], BEST)


class SparkPatterns:
    """Passes over patterns in a written table; a changed state is written as a new table."""

    def __init__(self, table: DataFrame, labels: list[str], workers: list[str]):
        self.table, self.labels, self.workers = table, labels, workers

    def _mapped(self, f: Callable[[Patterns], pd.DataFrame], schema: str) -> DataFrame:
        labels, workers = self.labels, self.workers

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield f(Patterns(b, labels, workers))

        return self.table.mapInPandas(run, schema)

    def sums(self, f: Callable[[Patterns], np.ndarray], largest: bool = False) -> np.ndarray:
        """``f`` of all patterns, added up over the tasks (or the largest of theirs)."""
        parts = self._mapped(lambda d: pd.DataFrame({"at": np.arange(len(v := f(d))), "v": v}), "at int, v double")
        out = parts.groupBy("at").agg((F.max if largest else F.sum)("v").alias("v")).toPandas()
        return out.sort_values("at")["v"].to_numpy()

    def change(self, f: Callable[[Patterns], None]) -> None:
        def changed(d: Patterns) -> pd.DataFrame:
            f(d)
            return pd.DataFrame({"pattern": d.names, "count": d.count.astype(int), "state": d.state})

        self.table = _written(self._mapped(changed, TABLE))

    def posteriors(self, f: Callable[[Patterns], np.ndarray], session) -> DataFrame:
        return self._mapped(lambda d: _best(d, f(d)), BEST)


TABLE, BEST = "pattern string, count bigint, state double", "pattern string, label string, prob double"


def _best(d: Patterns, post: np.ndarray) -> pd.DataFrame:
    """Each pattern's label and its probability; ties go to the first label."""
    best = np.round(post, 9).argmax(1)
    return pd.DataFrame({"pattern": d.names, "label": [d.labels[b] for b in best], "prob": post[np.arange(len(best)), best]})


def _written(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession, f"patterns-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(items: DataFrame, labels: list[str], local: int) -> LocalPatterns | SparkPatterns:
    """The patterns of ``items`` with their counts, on the driver if there are at most ``local``."""
    table = items.groupBy("pattern").agg(F.count("*").alias("count")).withColumn("state", F.lit(0.0))
    rows = table.limit(local + 1).toPandas()
    if len(rows) <= local:
        workers = sorted({x.rsplit("=", 1)[0] for name in rows["pattern"] for x in name.split("\x1f")})
        return LocalPatterns(Patterns(rows.sort_values("pattern"), labels, workers))
    table = _written(table)
    entry = F.explode(F.split("pattern", "\x1f"))
    models = table.select(entry.alias("e")).select(F.regexp_extract("e", "(?s)^(.*)=[^=]*$", 1).alias("w")).distinct().collect()
    return SparkPatterns(table, labels, sorted(r["w"] for r in models))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


Fitted = tuple[Callable[[Patterns], np.ndarray], np.ndarray]  # posterior by pattern, skill by worker


def dawid_skene(d: LocalPatterns | SparkPatterns, n_iter: int = 100, smoothing: float = 0.01, tol: float = 1e-6) -> Fitted:
    k, n = len(d.labels), len(d.workers)

    def by(prior: np.ndarray, conf: np.ndarray) -> Callable[[Patterns], np.ndarray]:
        return lambda x: softmax(np.log(prior) + x.gather(np.log(conf[x.w, :, x.a])))

    def statistics(x: Patterns, post: Callable[[Patterns], np.ndarray]) -> np.ndarray:
        t, conf = post(x), np.zeros((n, k, k))
        np.add.at(conf, (x.w, slice(None), x.a), t[x.p] * x.count[x.p][:, None])
        return np.concatenate(((t * x.count[:, None]).sum(0), [x.count.sum()], conf.ravel()))

    post: Callable[[Patterns], np.ndarray] = lambda x: x.shares(np.ones(n))
    for _ in range(n_iter):
        s = d.sums(lambda x, post=post: statistics(x, post))
        prior = (s[:k] + smoothing) / (s[k] + k * smoothing)
        conf = s[k + 1 :].reshape(n, k, k) + smoothing
        conf /= conf.sum(2, keepdims=True)
        last, post = post, by(prior, conf)
        if tol and d.sums(lambda x, last=last, post=post: np.array([np.abs(post(x) - last(x)).max(initial=0)]), largest=True)[0] < tol:
            break
    return post, (prior[None, :] * np.diagonal(conf, axis1=1, axis2=2)).sum(1)


def wawa(d: LocalPatterns | SparkPatterns) -> Fitted:
    n = len(d.workers)

    def statistics(x: Patterns) -> np.ndarray:
        best = x.shares(np.ones(n)).argmax(1)
        return np.concatenate((x.by_worker((best[x.p] == x.a).astype(float)), x.by_worker(np.ones(len(x.w)))))

    s = d.sums(statistics)
    skill = s[:n] / np.maximum(s[n:], 1)
    return lambda x: x.shares(skill), skill


def mace(d: LocalPatterns | SparkPatterns, n_iter: int = 50, smoothing: float = 0.5) -> Fitted:
    k, n = len(d.labels), len(d.workers)
    theta, xi, eye = np.full(n, 0.8), np.full((n, k), 1 / k), np.eye(k)

    def by(theta: np.ndarray, xi: np.ndarray) -> Callable[[Patterns], np.ndarray]:
        return lambda x: softmax(x.gather(np.log(theta[x.w][:, None] * eye[x.a] + ((1 - theta[x.w]) * xi[x.w, x.a])[:, None] + 1e-12)))

    def statistics(x: Patterns, theta: np.ndarray, xi: np.ndarray) -> np.ndarray:
        good = by(theta, xi)(x)[x.p, x.a] * theta[x.w] / (theta[x.w] + (1 - theta[x.w]) * xi[x.w, x.a] + 1e-12)
        spam = np.zeros((n, k))
        np.add.at(spam, (x.w, x.a), (1 - good) * x.count[x.p])
        return np.concatenate((x.by_worker(good), x.by_worker(np.ones(len(x.w))), spam.ravel()))

    for _ in range(n_iter):
        post = by(theta, xi)
        s = d.sums(lambda x, theta=theta, xi=xi: statistics(x, theta, xi))
        theta = np.clip((smoothing + s[:n]) / (2 * smoothing + s[n : 2 * n]), 0.01, 0.99)
        xi = s[2 * n :].reshape(n, k) + smoothing / k
        xi /= xi.sum(1, keepdims=True)
    return post, theta


def glad(d: LocalPatterns | SparkPatterns, n_iter: int = 30, rate: float = 0.1) -> Fitted:
    """``state`` of a pattern is the logarithm of its items' easiness.

    A gradient step is ``rate`` long, but no longer than a Newton step (the gradient over its curvature): sums over many
    items would overshoot otherwise. The fixed point doesn't depend on it.
    """
    k, n = len(d.labels), len(d.workers)
    eye = np.eye(k)

    def right(x: Patterns, alpha: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(alpha[x.w] * np.exp(x.state)[x.p], -30, 30)))

    def by(alpha: np.ndarray) -> Callable[[Patterns], np.ndarray]:
        def post(x: Patterns) -> np.ndarray:
            s = right(x, alpha)[:, None]
            return softmax(x.gather(np.log(np.where(eye[x.a] == 1, s, (1 - s) / (k - 1)) + 1e-12)))

        return post

    def stepped(x: Patterns, start: np.ndarray, steps: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each vote's label at the round's start, and the state after a step under each skill in ``steps``."""
        given, kept = by(start)(x)[x.p, x.a], x.state.copy()
        for alpha in steps:
            s, product = right(x, alpha), alpha[x.w] * np.exp(x.state)[x.p]
            slope = np.bincount(x.p, (given - s) * product, len(x.count)) - x.state
            curve = np.bincount(x.p, s * (1 - s) * product**2, len(x.count)) + 1
            x.state = np.clip(x.state + slope * np.minimum(rate, 1 / curve), -3, 3)
        after, x.state = x.state, kept
        return given, after

    def statistics(x: Patterns, start: np.ndarray, steps: tuple, alpha: np.ndarray) -> np.ndarray:
        """Slope and curvature of each skill, over the items of all patterns."""
        given, after = stepped(x, start, steps)
        kept, x.state = x.state, after
        s, b = right(x, alpha), np.exp(x.state)[x.p]
        x.state = kept
        return np.concatenate((x.by_worker((given - s) * b), x.by_worker(s * (1 - s) * b * b)))

    def advance(x: Patterns, start: np.ndarray, steps: tuple) -> None:
        x.state = stepped(x, start, steps)[1]

    alpha = np.ones(n)
    for i in range(n_iter):
        start, steps = alpha, ()
        for _ in range(5):
            s = d.sums(lambda x, start=start, steps=steps, alpha=alpha: statistics(x, start, steps, alpha))
            steps += (alpha,)
            alpha = alpha + (s[:n] - (alpha - 1)) * np.minimum(rate, 1 / (s[n:] + 1))
        if i + 1 < n_iter:  # the result is the posterior at the last round's start
            d.change(lambda x, start=start, steps=steps: advance(x, start, steps))
    return by(start), alpha


METHODS = {"dawid_skene": dawid_skene, "wawa": wawa, "mace": mace, "glad": glad}


def _many(votes: DataFrame, labels: list[str], most: int) -> bool:
    """Are there more than ``most`` annotators?"""
    return votes.where(F.col("label").isin(labels)).select("model").distinct().limit(most + 1).count() > most


class Crowd:
    """Votes that several crowd models are fitted to: counted once for all of them."""

    def __init__(self, votes: DataFrame, labels: list[str], local: int = LOCAL_PATTERNS, workers: int = DENSE_WORKERS, kept: bool = True):
        self.session, self.labels, self.keyed = votes.sparkSession, labels, None
        if _many(votes, labels, workers):
            self.keyed = crowd_keyed.Votes(votes, labels)
        else:
            items = patterned(votes, labels)
            self.items = _written(items) if kept else items
            self.counts = counted(self.items, labels, local)

    def _fitted(self, method: str, options: dict) -> tuple[LocalPatterns | SparkPatterns, Fitted]:
        d = copy.copy(self.counts)  # a model may change its patterns' state
        if isinstance(d, LocalPatterns):
            d.d = copy.copy(d.d)
        return d, METHODS[method](d, **options)

    def best(self, method: str, **options) -> DataFrame:
        """(item_id, label, prob); ties go to the first label."""
        if self.keyed:
            return crowd_keyed.labelled(crowd_keyed.METHODS[method](self.keyed, **options)[0], self.labels)
        if not self.counts.workers:
            return self.session.createDataFrame([], "item_id bigint, label string, prob double")
        d, (post, _) = self._fitted(method, options)
        of = d.posteriors(post, self.session)
        # few patterns have most of the items: a shuffle by pattern would bring these to one task
        return self.items.join(F.broadcast(of) if isinstance(d, LocalPatterns) else of, "pattern").select("item_id", "label", "prob")

    def skill(self, method: str, **options) -> DataFrame:
        """(model, skill)."""
        if self.keyed:
            return crowd_keyed.METHODS[method](self.keyed, **options)[1]
        workers = self.counts.workers
        skill = self._fitted(method, options)[1][1] if workers else []
        return self.session.createDataFrame([(w, float(s)) for w, s in zip(workers, skill, strict=True)], "model string, skill double")


def crowd_labels(votes: DataFrame, labels: list[str], method: str, local: int = LOCAL_PATTERNS, workers: int = DENSE_WORKERS, **options) -> DataFrame:
    """(item_id, label, prob) by a crowd model; ties go to the first label."""
    return Crowd(votes, labels, local, workers, kept=False).best(method, **options)


def worker_skill(votes: DataFrame, labels: list[str], method: str, local: int = LOCAL_PATTERNS, workers: int = DENSE_WORKERS, **options) -> DataFrame:
    """(model, skill) by a crowd model."""
    return Crowd(votes, labels, local, workers, kept=False).skill(method, **options)
