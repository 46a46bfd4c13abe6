"""The crowd models for any number of annotators: their parameters are tables, joined to the votes by key.

Nothing has the size of annotators on the driver or in a closure. A round is a few joins and sums: parameters are joined to
votes by annotator (and label), log-likelihoods are summed by item, statistics by annotator. Every round's result is written,
so no lineage grows. Annotators with more than a thousandth of all votes (a thousand at most) are joined by broadcast, the
others by a shuffle, so none meets in one task; sums combine before they are shuffled. The results are those of the passes
over patterns in ``crowd``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

HOT_SHARE = 1000


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, f"crowd-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Votes:
    """Distinct votes(item_id, model, a), a being the label's number; ``hot`` marks the votes of frequent annotators."""

    def __init__(self, votes: DataFrame, labels: list[str]):
        self.labels, self.k = labels, len(labels)
        number = F.when(F.lit(False), 0)
        for i, x in enumerate(labels):
            number = number.when(F.col("label") == x, i)
        v = votes.where(F.col("label").isin(labels)).select("item_id", "model", number.alias("a")).distinct()
        v = _kept(v, "votes")
        self.n = v.count()
        hot = v.groupBy("model").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > self.n).select("model", F.lit(True).alias("hot"))
        self.rows = _kept(v.join(F.broadcast(hot), "model", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "votes")
        self.hot = hot.select("model")
        self.items = self.rows.select("item_id").distinct().count()

    def joined(self, rows: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
        """Votes with parameters by model (and label)."""
        mine = F.broadcast(parameters.join(F.broadcast(self.hot), "model", "left_semi"))
        rest = parameters.join(F.broadcast(self.hot), "model", "left_anti")
        return rows.where("hot").join(mine, keys).unionByName(rows.where("NOT hot").join(rest, keys))

    def shares(self, weight: DataFrame | None = None) -> DataFrame:
        """(item_id, t0, t1, ...): each label's share of an item's votes, weighted by ``weight(model, s)`` if given."""
        v = self.rows.withColumn("s", F.lit(1.0)) if weight is None else self.joined(self.rows, weight, ["model"])
        g = v.groupBy("item_id").agg(F.sum("s").alias("all"), *[F.sum(F.when(F.col("a") == i, F.col("s")).otherwise(0.0)).alias(f"t{i}") for i in range(self.k)])
        return g.select("item_id", *[(F.col(f"t{i}") / F.when(F.col("all") == 0, 1.0).otherwise(F.col("all"))).alias(f"t{i}") for i in range(self.k)])

    def likely(self, rows: DataFrame, log: Callable[[int], Column], prior: list[float] | None = None) -> DataFrame:
        """Posteriors from each vote's log-likelihoods of the true labels."""
        t = [f"t{i}" for i in range(self.k)]
        l = rows.groupBy("item_id").agg(*[(F.sum(log(i)) + (math.log(prior[i]) if prior else 0.0)).alias(x) for i, x in enumerate(t)])
        top = F.greatest(*t)
        l = l.select("item_id", *[F.exp(F.col(x) - top).alias(x) for x in t])
        total = sum((F.col(x) for x in t[1:]), F.col(t[0]))
        return l.select("item_id", *[(F.col(x) / total).alias(x) for x in t])

    def of_label(self, prefix: str = "t") -> Column:
        """The vote's own label's entry of t0, t1, ..."""
        return F.element_at(F.array(*[F.col(f"{prefix}{i}") for i in range(self.k)]), F.col("a") + 1)


def dawid_skene(v: Votes, n_iter: int = 100, smoothing: float = 0.01, tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    k, post = v.k, _kept(v.shares(), "post")
    t = [f"t{i}" for i in range(k)]
    for _ in range(n_iter):
        sums = post.agg(*[F.sum(x).alias(x) for x in t]).first()
        prior = [(sums[x] + smoothing) / (v.items + k * smoothing) for x in t]
        by = v.rows.join(post, "item_id").groupBy("model", "a").agg(*[F.sum(x).alias(x) for x in t])
        whole = by.groupBy("model").agg(*[F.sum(x).alias(f"all{i}") for i, x in enumerate(t)])
        conf = by.join(whole, "model").select("model", "a", *[((F.col(f"t{i}") + smoothing) / (F.col(f"all{i}") + k * smoothing)).alias(f"c{i}") for i in range(k)])
        conf, whole = _kept(conf, "confusion"), _kept(whole, "totals")
        new = _kept(v.likely(v.joined(v.rows, conf, ["model", "a"]), lambda i: F.log(f"c{i}"), prior), "post")
        old, post = post, new
        moved = F.greatest(*[F.abs(F.col(x) - F.col(f"o{i}")) for i, x in enumerate(t)])
        if tol and post.join(old.toDF("item_id", *[f"o{i}" for i in range(k)]), "item_id").agg(F.max(moved)).first()[0] < tol:
            break
    # a label that an annotator never gave has the smoothing alone
    own = [F.coalesce(F.max(F.when(F.col("a") == i, F.col(f"c{i}"))), F.lit(smoothing) / (F.first(f"all{i}") + k * smoothing)) * prior[i] for i in range(k)]
    return post, conf.join(whole, "model").groupBy("model").agg(sum(own[1:], own[0]).alias("skill"))


def wawa(v: Votes) -> tuple[DataFrame, DataFrame]:
    t = [f"t{i}" for i in range(v.k)]
    best = F.array_position(F.array(*t), F.greatest(*t)) - 1
    skill = v.rows.join(v.shares().select("item_id", best.alias("best")), "item_id").groupBy("model").agg(F.avg((F.col("best") == F.col("a")).cast("double")).alias("skill"))
    skill = _kept(skill, "skill")
    return v.shares(skill.select("model", F.col("skill").alias("s"))), skill


def mace(v: Votes, n_iter: int = 50, smoothing: float = 0.5) -> tuple[DataFrame, DataFrame]:
    k = v.k
    theta = _kept(v.rows.select("model").distinct().select("model", F.lit(0.8).alias("theta")), "theta")
    # xi of labels that an annotator never gave is not needed, but counts in the sum to 1
    xi = _kept(v.rows.select("model", "a").distinct().select("model", "a", F.lit(1 / k).alias("xi")), "xi")
    for _ in range(n_iter):
        rows = v.joined(v.joined(v.rows, theta, ["model"]), xi, ["model", "a"])
        rows = rows.withColumn("g", (1 - F.col("theta")) * F.col("xi"))
        post = _kept(v.likely(rows, lambda i: F.log(F.when(F.col("a") == i, F.col("theta")).otherwise(0.0) + F.col("g") + 1e-12)), "post")
        good = v.of_label() * F.col("theta") / (F.col("theta") + F.col("g") + 1e-12)
        by = _kept(rows.join(post, "item_id").withColumn("good", good).groupBy("model", "a").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("spam"), F.count("*").alias("n")), "statistics")
        whole = by.groupBy("model").agg(F.sum("good").alias("good"), F.sum("spam").alias("all"), F.sum("n").alias("n"))
        share = F.least(F.greatest((smoothing + F.col("good")) / (2 * smoothing + F.col("n")), F.lit(0.01)), F.lit(0.99))
        theta = _kept(whole.select("model", share.alias("theta")), "theta")
        xi = _kept(by.select("model", "a", "spam").join(whole, "model").select("model", "a", ((F.col("spam") + smoothing / k) / (F.col("all") + smoothing)).alias("xi")), "xi")
    return post, theta.select("model", F.col("theta").alias("skill"))


def glad(v: Votes, n_iter: int = 30, rate: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """As in ``crowd``: ``state`` is the logarithm of an item's easiness, steps are no longer than a Newton step."""
    k = v.k
    alpha = _kept(v.rows.select("model").distinct().select("model", F.lit(1.0).alias("alpha")), "alpha")
    state = _kept(v.rows.select("item_id").distinct().select("item_id", F.lit(0.0).alias("state")), "state")
    right = 1 / (1 + F.exp(-F.least(F.greatest(F.col("alpha") * F.exp("state"), F.lit(-30.0)), F.lit(30.0))))
    step = lambda slope, curve: slope * F.least(F.lit(rate), 1 / (curve + 1))
    for _ in range(n_iter):
        rows = v.joined(v.rows, alpha, ["model"]).join(state, "item_id").withColumn("s", right)
        post = _kept(v.likely(rows, lambda i: F.log(F.when(F.col("a") == i, F.col("s")).otherwise((1 - F.col("s")) / (k - 1)) + 1e-12)), "post")
        given = _kept(v.rows.join(post, "item_id").select("item_id", "model", "a", "hot", v.of_label().alias("given")), "given")
        for _ in range(5):
            rows = _kept(v.joined(given, alpha, ["model"]).join(state, "item_id").withColumn("s", right), "step")
            b = F.exp("state")
            of_model = rows.groupBy("model").agg(F.first("alpha").alias("alpha"), F.sum((F.col("given") - F.col("s")) * b).alias("slope"), F.sum(F.col("s") * (1 - F.col("s")) * b * b).alias("curve"))
            product = F.col("alpha") * b
            of_item = rows.groupBy("item_id").agg(F.first("state").alias("state"), F.sum((F.col("given") - F.col("s")) * product).alias("slope"), F.sum(F.col("s") * (1 - F.col("s")) * product * product).alias("curve"))
            alpha = _kept(of_model.select("model", (F.col("alpha") + step(F.col("slope") - (F.col("alpha") - 1), F.col("curve"))).alias("alpha")), "alpha")
            moved = F.col("state") + step(F.col("slope") - F.col("state"), F.col("curve"))
            state = _kept(of_item.select("item_id", F.least(F.greatest(moved, F.lit(-3.0)), F.lit(3.0)).alias("state")), "state")
    return post, alpha.select("model", F.col("alpha").alias("skill"))


METHODS = {"dawid_skene": dawid_skene, "wawa": wawa, "mace": mace, "glad": glad}


def labelled(post: DataFrame, labels: list[str]) -> DataFrame:
    """(item_id, label, prob); ties, to nine digits, go to the first label."""
    t = [F.round(f"t{i}", 9) for i in range(len(labels))]
    best = F.array_position(F.array(*t), F.greatest(*t)).cast("int")
    return post.select("item_id", F.element_at(F.array(*[F.lit(x) for x in labels]), best).alias("label"), F.element_at(F.array(*[F.col(f"t{i}") for i in range(len(labels))]), best).alias("prob"))
