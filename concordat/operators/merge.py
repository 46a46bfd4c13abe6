"""Merging tables of examples, reviews and checkpoints: keep-first, append, upsert, anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each key; a top-1 per group needs no sort of whole groups in one task before others combine."""
    others = [c for c in rows.columns if c != by]
    first = rows.groupBy(by).agg(F.min(F.struct(order, *[c for c in others if c != order])).alias("r"))
    return first.select(by, *[F.col(f"r.{c}").alias(c) for c in others]).select(rows.columns)


def append(have: DataFrame, new: DataFrame) -> DataFrame:
    """``have`` and the rows of ``new(seq, text, label)`` whose trimmed text it lacks, first of equal ones; column ``is_new``."""
    t = new.withColumn("text", F.trim("text")).withColumn("label", F.trim("label")).where("text <> '' AND label <> ''")
    fresh = keep_first(t, "text", "seq").join(have.select(F.trim("text").alias("text")).distinct(), "text", "left_anti")
    return have.select("text", "label", F.lit(False).alias("is_new")).unionByName(fresh.select("text", "label", F.lit(True).alias("is_new")))


def upsert(have: DataFrame, new: DataFrame) -> DataFrame:
    """(text, label, action): kept, added, updated or unchanged; the last of equal new texts counts."""
    w = Window.partitionBy("text").orderBy(F.desc("seq"))
    n = new.withColumn("text", F.trim("text")).where("text <> ''").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("text", F.col("label").alias("new"))
    j = have.select(F.trim("text").alias("text"), F.col("label").alias("old")).join(n, "text", "full")
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return j.select("text", F.coalesce("new", "old").alias("label"), action.alias("action"))


def criteria_changes(old: DataFrame, new: DataFrame, old_rules: DataFrame, new_rules: DataFrame) -> DataFrame:
    """(part, name, change, n) between two versions of criteria: labels(name, place, definition, examples), rules(rule).

    Examples are compared for labels that both versions have, in n; the order of labels is one row, if the labels that both
    have stand in another order. Null definitions and examples count as empty.
    """
    empty = lambda c, none: F.coalesce(F.col(c), none)
    a = old.select("name", F.col("place").alias("pa"), empty("definition", F.lit("")).alias("da"), empty("examples", F.array()).alias("ea"), F.lit(True).alias("in_a"))
    b = new.select("name", F.col("place").alias("pb"), empty("definition", F.lit("")).alias("db"), empty("examples", F.array()).alias("eb"), F.lit(True).alias("in_b"))
    j = a.join(b, "name", "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    more, less = F.size(F.filter("eb", lambda x: ~F.array_contains("ea", x))), F.size(F.filter("ea", lambda x: ~F.array_contains("eb", x)))
    row = lambda part, change, n: F.struct(F.lit(part).alias("part"), F.lit(change).alias("change"), n.cast("bigint").alias("n"))
    found = F.array(
        row("label", "added", F.col("in_a").isNull().cast("int")), row("label", "removed", F.col("in_b").isNull().cast("int")),
        row("definition", "changed", (both & (F.col("da") != F.col("db"))).cast("int")), row("examples", "added", F.when(both, more).otherwise(0)), row("examples", "removed", F.when(both, less).otherwise(0)),
    )
    labels = j.select("name", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select("x.part", "name", "x.change", "x.n")
    every = Window.partitionBy(F.lit(0))  # a row a label
    moved = j.where(both).withColumn("moved", F.row_number().over(every.orderBy("pa", "name")) != F.row_number().over(every.orderBy("pb", "name"))).where("moved").limit(1)
    order = moved.select(F.lit("order").alias("part"), F.lit("labels").alias("name"), F.lit("changed").alias("change"), F.lit(1).cast("bigint").alias("n"))
    one = lambda df, change: df.distinct().select(F.lit("rule").alias("part"), F.col("rule").alias("name"), F.lit(change).alias("change"), F.lit(1).cast("bigint").alias("n"))
    return labels.union(order).union(one(new_rules.join(old_rules, "rule", "left_anti"), "added")).union(one(old_rules.join(new_rules, "rule", "left_anti"), "removed"))
