"""Sampling, splits and queues. Random choices order rows by a hash of seed and id, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, by the least hashes: a top-n per partition, then of those."""
    return rows.withColumn("_lot", lot(seed, key)).orderBy("_lot", key).limit(n).drop("_lot")


def per_label(rows: DataFrame, n: int, key: str, label: str, seed: int = 0) -> DataFrame:
    """At most n rows of each label."""
    w = Window.partitionBy(label).orderBy(lot(seed, key), key)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _placed(rows: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """``rows`` with ``_rn``, the place in the label's order by lot, and ``_n``, the label's size.

    The place is counted within the first three digits of the lot, with the sizes of the parts before; so a label that
    holds most rows is dealt over 4,096 groups.
    """
    r = rows.withColumn("_lot", lot(seed, key)).withColumn("_part", F.left("_lot", F.lit(3)))
    w = Window.partitionBy("_label")
    c = r.groupBy(F.col(label).alias("_label"), F.col("_part").alias("_of")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.select("_label", "_of", before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    own = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_lot", key))
    r = r.withColumn("_own", own).join(c, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_of")))
    return r.withColumn("_rn", F.col("_before") + F.col("_own")).drop("_lot", "_part", "_label", "_of", "_before", "_own")


def split(rows: DataFrame, ratio: float, key: str, label: str, seed: int = 0) -> DataFrame:
    """Column ``part``: dev for round(n * ratio) rows of each label (half to even; 1 to n - 1 where n > 1), else test."""
    n = F.col("_n")
    size = F.bround(n * ratio, 0)
    size = F.when(n >= 2, F.least(F.greatest(size, F.lit(1)), n - 1)).otherwise(size)
    return _placed(rows, key, label, seed).withColumn("part", F.when(F.col("_rn") <= size, "dev").otherwise("test")).drop("_rn", "_n")


def allocation(rows: DataFrame, n: int, label: str) -> DataFrame:
    """(label, size): n rows shared out in proportion, largest remainders first, ties by label."""
    c = rows.groupBy(label).agg(F.count("*").alias("have"))
    every = Window.partitionBy(F.lit(0))  # one row per label
    exact = F.col("have") * float(n) / F.sum("have").over(every)
    c = c.withColumn("exact", exact).withColumn("size", F.floor("exact").cast("bigint"))
    c = c.withColumn("left", n - F.sum("size").over(every)).withColumn("rk", F.row_number().over(every.orderBy(F.desc(F.round(F.col("exact") - F.col("size"), 9)), label)))
    return c.select(label, "have", F.least("have", F.col("size") + (F.col("rk") <= F.col("left")).cast("bigint")).alias("size"))


def take(rows: DataFrame, n: int, key: str, label: str, seed: int = 0) -> DataFrame:
    placed = _placed(rows, key, label, seed).join(allocation(rows, n, label).select(label, "size"), label)
    return placed.where("_rn <= size").select(rows.columns)


def uncertainty(valid_votes: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, score): scattered labels and low confidence score high; fewer than two votes score 1."""
    t = valid_votes.groupBy("item_id", "label").agg(F.count("*").alias("c"), F.sum("confidence").alias("s"))
    t = t.groupBy("item_id").agg(F.max("c").alias("top"), F.sum("c").alias("n"), F.sum("s").alias("s"))
    score = F.round((1 - F.col("top") / F.col("n")) * 0.65 + (1 - F.col("s") / F.col("n")) * 0.35, 4)
    return items.select("item_id").distinct().join(t, "item_id", "left").select("item_id", F.when(F.coalesce("n", F.lit(0)) < 2, 1.0).otherwise(score).alias("score"))


def reasons(valid_votes: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, reason): in words, why an item stands where it does in a queue by uncertainty."""
    t = valid_votes.groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"), F.round(F.avg("confidence") * 100).cast("int").alias("pct"))
    t = items.select("item_id").distinct().join(t, "item_id", "left")
    some = F.when(F.col("k") > 1, F.format_string("%d models gave %d labels, mean confidence %d%%", "n", "k", "pct")).otherwise(F.format_string("models agree, mean confidence %d%%", "pct"))
    return t.select("item_id", F.when(F.coalesce("n", F.lit(0)) < 2, "fewer than 2 valid answers").otherwise(some).alias("reason"))


def suspects(valid_votes: DataFrame, gold: DataFrame, min_agree: int = 2, min_conf: float = 0.75) -> DataFrame:
    """Items on which several confident votes agree on a label that isn't gold."""
    v = valid_votes.join(gold, "item_id")
    t = v.groupBy("item_id", "gold", "label").agg(F.count("*").alias("agree"), F.sum("confidence").alias("s"), F.min("model_ord").alias("o"))
    t = t.withColumn("n", F.sum("agree").over(Window.partitionBy("item_id"))).where("label <> gold").withColumn("mean", F.col("s") / F.col("agree"))
    t = t.withColumn("rk", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("agree"), F.desc("mean"), "o"))).where("rk = 1")
    t = t.where((F.col("n") >= min_agree) & (F.col("agree") >= min_agree) & (F.col("mean") >= min_conf))
    return t.select("item_id", "gold", F.col("label").alias("suspect"), "agree", "n", F.round("mean", 3).alias("mean_conf"), F.round(F.col("agree") / F.col("n") * F.col("mean"), 3).alias("score"))
