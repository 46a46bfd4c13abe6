"""Search over sets of rules: many variants are scored in one pass over the tuning rows, the winner once on held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

Variant = tuple[str, ...]


def accuracies(rows: DataFrame, rules: dict[str, Column], variants: list[Variant], gold: str, otherwise: str) -> dict[Variant, tuple[int, int]]:
    """(rows, right ones) of each variant by one aggregation. A variant's rules apply in order, the first that fits decides;
    a rule is a column that gives a label or null, ``otherwise`` is the label where none fits. Rows without gold don't count."""
    said = {name: rows_column(name) for name in rules}
    kept = rows.where(F.col(gold).isNotNull()).select(F.col(gold).alias("_gold"), *[c.alias(said[name]) for name, c in rules.items()])
    right = [F.count_if(F.coalesce(*[F.col(said[r]) for r in v], F.lit(otherwise)) == F.col("_gold")).alias(f"v{i}") for i, v in enumerate(variants)]
    got = kept.agg(F.count("*").alias("n"), *right).first()
    return {v: (got["n"], got[f"v{i}"]) for i, v in enumerate(variants)}


def rows_column(name: str) -> str:
    return f"_rule_{name}"


def proposals(rules: list[str], base: Variant) -> list[Variant]:
    """The variants next to ``base``: one rule less, one more at either end."""
    less = [tuple(r for r in base if r != x) for x in base]
    more = [v for x in rules if x not in base for v in ((*base, x), (x, *base))]
    return list(dict.fromkeys([*less, *more]))


def search(tuning: DataFrame, held_out: DataFrame, rules: dict[str, Column], base: Variant, gold: str, otherwise: str, rounds: int = 10) -> DataFrame:
    """(round, rules, n, correct, accuracy, part, winner) of all variants tried.

    Each round scores all variants next to the best so far in one pass and goes on from the best of them, the first of equals,
    if it is right more often; else the search ends. Held-out rows are read once, for the starting rules and the winner. The
    rounds' figures are a written table, a row a variant.
    """
    spark = tuning.sparkSession
    path = shared_dir(spark, "rule-search")
    schema = "round int, rules string, n bigint, correct bigint, part string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    scores = accuracies(tuning, rules, [base], gold, otherwise)
    write([(0, ",".join(base), *scores[base], "tuning")])
    best = base
    for r in range(1, rounds + 1):
        tried = [v for v in proposals(list(rules), best) if v not in scores]
        if not tried:
            break
        new = accuracies(tuning, rules, tried, gold, otherwise)
        scores |= new
        write([(r, ",".join(v), *new[v], "tuning") for v in tried])
        top = max(tried, key=lambda v: new[v][1])
        if new[top][1] <= scores[best][1]:
            break
        best = top
    final = accuracies(held_out, rules, list(dict.fromkeys([base, best])), gold, otherwise)
    write([(-1, ",".join(v), *x, "held out") for v, x in final.items()])
    share = F.when(F.col("n") > 0, F.round(F.col("correct") / F.col("n"), 6))
    return spark.read.schema(schema).parquet(path).withColumn("accuracy", share).withColumn("winner", F.col("rules") == ",".join(best))
