"""Routing: accept an item, arbitrate it, or hand it to a person.

Each rule is a CASE over one row per item; only escalated items reach a later stage, so costly annotators see few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import votes

STATUSES = ["consensus", "majority", "arbitrated", "need_human"]


@dataclass(frozen=True)
class RoutingPolicy:
    """``action`` for disagreements: review (accept clear votes), arbiter or human."""

    min_votes: int = 2
    action: str = "review"
    accept_threshold: float = 0.6
    arbiter_threshold: float = 0.7
    min_posterior: float = 0.0
    cascade: tuple[str, ...] = ()
    cascade_min_confidence: float = 0.0
    evidence_penalty: float = 0.5

    def __post_init__(self):
        if self.action not in ("review", "arbiter", "human"):
            raise ValueError(f"unknown action {self.action!r}")
        for x in (self.accept_threshold, self.arbiter_threshold, self.min_posterior, self.cascade_min_confidence):
            if not 0 <= x <= 1:
                raise ValueError("thresholds lie between 0 and 1")


def unanimity(ann: DataFrame) -> DataFrame:
    """item_id, valid, n_labels, first_label, mean_conf of valid votes; items without one have 0."""
    ok = F.col("error").isNull() & F.col("label").isNotNull()
    return ann.groupBy("item_id").agg(
        F.count_if(ok).alias("valid"), F.count_distinct(F.when(ok, F.col("label"))).alias("n_labels"),
        F.min(F.when(ok, F.col("label"))).alias("first_label"), F.avg(F.when(ok, F.col("confidence"))).alias("mean_conf"),
    )


def acceptable(policy: RoutingPolicy) -> Column:
    """A vote clear enough to be taken without unanimity."""
    return F.lit(policy.action == "review") & (F.col("total") >= policy.min_votes) & (F.col("agree") * 2 > F.col("total")) & (F.col("share") >= policy.accept_threshold)


def by_item(ann: DataFrame, weights: dict[str, float], evidence_penalty: float, first: tuple[str, ...] = ()) -> DataFrame:
    """All that routing asks of an item's votes, in one pass over them: two aggregations and no join.

    valid, n_labels, first_label, mean_conf of valid votes; label, agree, share, total of the weighted vote; calls; and
    tier1, a struct of the same kind over the votes of the models in ``first``.
    """
    ok = F.col("error").isNull() & F.col("label").isNotNull()
    early = F.col("model").isin(list(first)) if first else F.lit(False)
    n_conf = F.count(F.when(early, F.col("confidence")))
    t = ann.groupBy("item_id", F.when(ok, F.col("label")).alias("label")).agg(
        F.count("*").alias("cnt"), F.min("model_ord").alias("ord"), F.sum(votes.vote_score(weights, evidence_penalty)).alias("score"),
        F.sum("confidence").alias("conf"), F.count("confidence").alias("n_conf"),
        F.count_if(early).alias("asked1"), F.min(F.when(early, F.col("confidence"))).alias("least1"), F.sum(F.when(early, F.col("confidence"))).alias("conf1"), n_conf.alias("n_conf1"),
    )
    known = F.col("label").isNotNull()
    mine = lambda c: F.sum(F.when(known, F.col(c)))
    best = F.max(F.when(known, F.struct("score", (-F.col("ord")).alias("o"), "label", "cnt")))
    tier1 = F.struct(
        F.sum("asked1").alias("asked"), F.coalesce(mine("asked1"), F.lit(0)).alias("valid"), F.count_if(known & (F.col("asked1") > 0)).alias("n_labels"),
        F.min(F.when(F.col("asked1") > 0, F.col("label"))).alias("label"), F.min("least1").alias("least"), F.try_divide(F.sum("conf1"), F.sum("n_conf1")).alias("mean_conf"),
    )
    out = t.groupBy("item_id").agg(
        F.coalesce(mine("cnt"), F.lit(0)).alias("valid"), F.count("label").alias("n_labels"), F.min("label").alias("first_label"),
        F.try_divide(mine("conf"), mine("n_conf")).alias("mean_conf"), best.alias("best"), mine("score").alias("all"), mine("cnt").alias("total"), F.sum("cnt").alias("calls"), tier1.alias("tier1"),
    )
    return out.select("item_id", "valid", "n_labels", "first_label", "mean_conf", "best.label", F.col("best.cnt").alias("agree"), F.try_divide("best.score", "all").alias("share"), "total", "calls", "tier1")


def _decided(items: DataFrame, policy: RoutingPolicy) -> tuple[Column, Column, Column]:
    """Label, status and confidence of rows of ``by_item`` with arb_label and arb_conf."""
    consensus = (F.col("valid") >= policy.min_votes) & (F.col("n_labels") == 1)
    arbitrated = F.col("arb_label").isNotNull() & (F.col("arb_conf") >= policy.arbiter_threshold)
    accept = F.coalesce(acceptable(policy), F.lit(False))
    pick = lambda a, b, c, d: F.when(consensus, a).when(accept, b).when(arbitrated, c).otherwise(d)
    return (
        pick(F.col("first_label"), F.col("label"), F.col("arb_label"), F.coalesce("arb_label", "label")),
        pick(*[F.lit(x) for x in STATUSES]),
        pick(F.col("mean_conf"), F.col("share"), F.col("arb_conf"), F.coalesce("share", F.lit(0.0))),
    )


def _no_arbiter(items: DataFrame) -> DataFrame:
    return items.withColumn("arb_label", F.lit(None).cast("string")).withColumn("arb_conf", F.lit(None).cast("double"))


def route(ann: DataFrame, weights: dict[str, float], policy: RoutingPolicy, arbiter: DataFrame | None = None) -> DataFrame:
    """item_id, label, status, confidence. ``arbiter(item_id, arb_label, arb_conf)`` decides what votes don't.

    Unanimous valid votes give consensus; failed models don't break it. An item handed to a person carries the arbiter's
    label as a suggestion, or the vote's.
    """
    items = by_item(ann, weights, policy.evidence_penalty)
    items = _no_arbiter(items) if arbiter is None else items.join(arbiter, "item_id", "left")
    label, status, confidence = _decided(items, policy)
    return items.select("item_id", label.alias("label"), status.alias("status"), confidence.alias("confidence"))


def cascade(ann: DataFrame, weights: dict[str, float], policy: RoutingPolicy) -> DataFrame:
    """As ``route``, with a first tier: items on which its models all agree with enough confidence stop there.

    Adds ``tier`` (1 or 2) and ``calls`` (models asked). Both tiers come from one pass over the votes.
    """
    items = _no_arbiter(by_item(ann, weights, policy.evidence_penalty, policy.cascade))
    one = F.col("tier1")
    done = (one["asked"] == len(policy.cascade)) & (one["valid"] == one["asked"]) & (one["n_labels"] == 1) & (one["least"] >= policy.cascade_min_confidence)
    done = F.coalesce(done, F.lit(False))
    label, status, confidence = _decided(items, policy)
    return items.select(
        "item_id", F.when(done, one["label"]).otherwise(label).alias("label"), F.when(done, "consensus").otherwise(status).alias("status"),
        F.when(done, F.round(one["mean_conf"], 3)).otherwise(confidence).alias("confidence"),
        F.when(done, 1).otherwise(2).alias("tier"), F.when(done, one["asked"]).otherwise(F.col("calls")).alias("calls"),
    )


def gate(unanimous: DataFrame, voted: DataFrame, policy: RoutingPolicy) -> DataFrame:
    """Posterior gate: accept if the best label's probability is high enough; unanimous votes below it skip the review."""
    high = F.col("prob") >= policy.min_posterior
    one = (F.col("valid") >= policy.min_votes) & (F.col("n_labels") == 1)
    status = F.when(high & one, "consensus").when(high, "majority").otherwise("need_human")
    return unanimous.join(voted, "item_id").select("item_id", "label", "prob", status.alias("status"), (one & ~high).alias("skip_review"))


def merge_rounds(ann: DataFrame) -> DataFrame:
    """The vote after review where it is valid, otherwise the first one."""
    return ann.withColumn("error", F.when(F.col("label2").isNull(), F.col("error"))).withColumn("label", F.coalesce("label2", "label"))


def _answered(reply: str, replies: list[str]):
    """A vote after a round: the reply in its place if the item is open and the reply is valid."""

    def after(x: Column) -> Column:
        take = F.col("open") & x[reply].isNotNull()
        return F.struct(F.when(take, x[reply]).otherwise(x["label"]).alias("label"), F.when(~take, x["error"]).alias("error"), *[x[c].alias(c) for c in replies])

    return after


def debate(ann: DataFrame, replies: list[str], min_votes: int = 2) -> DataFrame:
    """Rounds of review over columns ``replies``: a failed reply keeps the old vote, unanimous items stop early.

    Gives item_id, rounds (those held), valid, n_labels. An item's few votes are one array, so no round shuffles.
    """
    held = ann.groupBy("item_id").agg(F.collect_list(F.struct("label", "error", *replies)).alias("v")).withColumn("rounds", F.lit(0))
    good = lambda: F.filter("v", lambda x: x["error"].isNull() & x["label"].isNotNull())
    state = lambda d: d.withColumn("valid", F.size(good()).cast("bigint")).withColumn("n_labels", F.size(F.array_distinct(F.transform(good(), lambda x: x["label"]))).cast("bigint"))
    for r in replies:
        held = state(held).withColumn("open", ~((F.col("valid") >= min_votes) & (F.col("n_labels") == 1)))
        held = held.withColumn("v", F.transform("v", _answered(r, replies))).withColumn("rounds", F.col("rounds") + F.col("open").cast("int"))
    return state(held).select("item_id", "rounds", "valid", "n_labels")
