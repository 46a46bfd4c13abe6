"""Votes: from several annotations of an item to one label.

Inputs are tidy: one row per (item_id, model) with model_ord, label, confidence, error and evidence_ok. A vote is valid
if it has a label and no error. Every vote is one aggregation by (item, label), which combines before the shuffle, and
one window over an item's few labels; ties end with the order of the models, so results don't depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(ann: DataFrame) -> DataFrame:
    return ann.where(F.col("error").isNull() & F.col("label").isNotNull())


def literal_map(values: dict[str, float], key: Column, default: float) -> Column:
    """A small lookup as CASE, which stays in generated code."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def best(tally: DataFrame, *order: Column, by: str = "item_id") -> DataFrame:
    return tally.withColumn("_rk", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rk = 1").drop("_rk")


def tally(ann: DataFrame, label: str = "label") -> DataFrame:
    """cnt, conf and first model of each label of each item, and the item's number of valid votes."""
    t = ann.groupBy("item_id", F.col(label).alias("label")).agg(F.count("*").alias("cnt"), F.sum("confidence").alias("conf"), F.min("model_ord").alias("first_ord"))
    return t.withColumn("valid", F.sum("cnt").over(Window.partitionBy("item_id")))


def majority(ann: DataFrame) -> DataFrame:
    """item_id, label, cnt, conf, valid: most votes, then the most confidence, then the first model."""
    return best(tally(valid(ann)), F.desc("cnt"), F.desc("conf"), F.asc("first_ord")).drop("first_ord")


def vote_score(weights: dict[str, float], evidence_penalty: float) -> Column:
    """A vote's weight x confidence, less where its evidence was refuted."""
    weight = literal_map(weights, F.col("model"), 1.0) * F.greatest("confidence", F.lit(0.05))
    return weight * F.when(F.col("evidence_ok").eqNullSafe(False), evidence_penalty).otherwise(1.0)


def weighted(ann: DataFrame, weights: dict[str, float], evidence_penalty: float = 0.5) -> DataFrame:
    """item_id, label, share, agree, total: sums of weight x confidence, less where evidence was refuted."""
    score = vote_score(weights, evidence_penalty)
    t = valid(ann).groupBy("item_id", "label").agg(F.count("*").alias("cnt"), F.min("model_ord").alias("first_ord"), F.sum(score).alias("score"))
    item = Window.partitionBy("item_id")
    t = t.withColumn("all", F.sum("score").over(item)).withColumn("total", F.sum("cnt").over(item))
    return best(t, F.desc("score"), F.asc("first_ord")).select("item_id", "label", (F.col("score") / F.col("all")).alias("share"), F.col("cnt").alias("agree"), "total")


def both(ann: DataFrame, weights: dict[str, float], evidence_penalty: float = 0.5) -> DataFrame:
    """item_id, majority, weighted: the labels of both votes from one pass over an item's votes."""
    t = valid(ann).groupBy("item_id", "label").agg(F.count("*").alias("cnt"), F.sum("confidence").alias("conf"), F.min("model_ord").alias("first_ord"), F.sum(vote_score(weights, evidence_penalty)).alias("score"))
    item = Window.partitionBy("item_id")
    t = t.withColumn("m", F.row_number().over(item.orderBy(F.desc("cnt"), F.desc("conf"), "first_ord"))).withColumn("w", F.row_number().over(item.orderBy(F.desc("score"), "first_ord")))
    return t.groupBy("item_id").agg(F.max(F.when(F.col("m") == 1, F.col("label"))).alias("majority"), F.max(F.when(F.col("w") == 1, F.col("label"))).alias("weighted"))


def split_labels(text: Column) -> Column:
    """The parts of a multi-label text: separators | ; , and their wide forms, trimmed, empty ones dropped."""
    parts = F.split(F.translate(text, ";；,，、", "|||||"), r"\|")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def canonical(parts: Column, labels: list[str]) -> Column:
    """Distinct labels in configured order, unknown ones last, joined by |."""
    known = F.array(*[F.lit(x) for x in labels])
    rest = F.array_sort(F.array_except(parts, known))
    return F.array_join(F.concat(F.filter(known, lambda x: F.array_contains(parts, x)), rest), "|")


def multilabel(ann: DataFrame, labels: list[str], weights: dict[str, float], evidence_penalty: float = 0.5) -> DataFrame:
    """item_id, label, share, agree, total: labels with more than half of the voters' weight, else the best one."""
    w = literal_map(weights, F.col("model"), 1.0) * F.greatest("confidence", F.lit(0.05)) * F.when(F.col("evidence_ok").eqNullSafe(False), evidence_penalty).otherwise(1.0)
    v = valid(ann).withColumn("w", w).withColumn("parts", F.array_distinct(split_labels(F.col("label"))))
    totals = v.groupBy("item_id").agg(F.sum("w").alias("all"), F.count("*").alias("total"))
    each = v.select("item_id", "w", "model_ord", F.explode("parts").alias("part")).groupBy("item_id", "part").agg(F.sum("w").alias("score"), F.min("model_ord").alias("first_ord"))
    each = each.join(totals, "item_id").withColumn("frac", F.col("score") / F.col("all"))
    each = each.withColumn("rk", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("frac"), "first_ord", "part")))
    kept = F.max(F.when(F.col("frac") > 0.5, 1).otherwise(0)).over(Window.partitionBy("item_id"))
    each = each.withColumn("in", F.when(kept == 1, F.col("frac") > 0.5).otherwise(F.col("rk") == 1))
    picked = each.groupBy("item_id", "total").agg(
        F.collect_set(F.when(F.col("in"), F.col("part"))).alias("picked"), F.min(F.greatest(F.col("frac"), 1 - F.col("frac"))).alias("share")
    )
    picked = picked.withColumn("label", canonical(F.col("picked"), labels))
    same = v.select("item_id", canonical(F.col("parts"), labels).alias("voted")).join(picked.select("item_id", "label"), "item_id")
    agree = same.where("voted = label").groupBy("item_id").agg(F.count("*").alias("agree"))
    return picked.join(agree, "item_id", "left").select("item_id", "label", "share", F.coalesce("agree", F.lit(0)).alias("agree"), "total")


def jury(ann: DataFrame) -> DataFrame:
    """item_id, label, confidence: the majority, with failures counted in the denominator."""
    size = ann.groupBy("item_id").agg(F.count("*").alias("size"))
    return majority(ann).join(size, "item_id").select("item_id", "label", F.round(F.col("cnt") / F.col("size"), 3).alias("confidence"))


def disagreement(ann: DataFrame) -> DataFrame:
    """item_id, n_labels, n_failed, disagree: more than one label, or any failed vote."""
    ok = F.col("error").isNull() & F.col("label").isNotNull()
    t = ann.groupBy("item_id").agg(F.count_distinct(F.when(ok, F.col("label"))).alias("n_labels"), F.count_if(~ok).alias("n_failed"))
    return t.withColumn("disagree", (F.col("n_labels") > 1) | (F.col("n_failed") > 0))


def posterior(ann: DataFrame, prior: dict[str, float], confusion: DataFrame, evidence_penalty: float = 0.5) -> DataFrame:
    """(item_id, label, prob): naive Bayes over valid votes; ``confusion(model, true, pred, p)``.

    Models without a matrix are ignored; a refuted vote counts with power ``evidence_penalty``.
    """
    power = F.when(F.col("evidence_ok").eqNullSafe(False), evidence_penalty).otherwise(1.0)
    votes = valid(ann).select("item_id", "model", F.col("label").alias("pred"), power.alias("power"))
    log = votes.join(F.broadcast(confusion), ["model", "pred"]).groupBy("item_id", F.col("truth").alias("label")).agg(
        F.sum(F.col("power") * F.log(F.greatest("p", F.lit(1e-9)))).alias("ll")
    )
    log = log.withColumn("ll", F.col("ll") + F.log(F.greatest(literal_map(prior, F.col("label"), 0.0), F.lit(1e-9))))
    item = Window.partitionBy("item_id")
    log = log.withColumn("e", F.exp(F.col("ll") - F.max("ll").over(item)))
    return log.select("item_id", "label", (F.col("e") / F.sum("e").over(item)).alias("prob"))
