"""Evaluation: accuracy, agreement and error tables over labels and gold."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """n, right_ and accuracy of label against gold by groups; a missing label is wrong."""
    right = F.count_if(F.col("label") == F.col("gold"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), right.alias("right_"), rate(right, F.count("*")).alias("accuracy"))


def f1_parts(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp and fn of every class, from ``rows(label, gold)``: (label, gold) pairs are counted in one pass, then each count
    goes to its gold class and to its label's class. A null label is a miss of its gold class."""
    c = rows.groupBy(*by, "label", "gold").agg(F.count("*").alias("n"))
    right, none = F.col("label").eqNullSafe(F.col("gold")), F.lit(0).cast("bigint")
    one = lambda cls, tp, fp, fn: F.struct(F.col(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    n = F.col("n")
    of_gold = one("gold", F.when(right, n).otherwise(none), none, F.when(right, none).otherwise(n))
    of_label = one("label", none, F.when(right, none).otherwise(n), none)
    each = c.select(*by, F.explode(F.array(of_gold, of_label)).alias("x")).select(*by, "x.*").where("class IS NOT NULL")
    return each.groupBy(*by, "class").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])


def fleiss_kappa(valid_votes: DataFrame, n_models: int) -> DataFrame:
    """One row: n items that all models labelled, and kappa (null under 2 items or models; 1 if chance agreement is 1)."""
    c = valid_votes.groupBy("item_id", "label").agg(F.count("*").alias("c"))
    items = c.groupBy("item_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).where(F.col("m") == n_models)
    total = items.agg(F.count("*").alias("n"), F.sum((F.col("sq") - F.lit(n_models)).cast("double") / (n_models * (n_models - 1))).alias("p"))
    per = c.join(items.select("item_id"), "item_id", "left_semi").groupBy("label").agg(F.sum("c").alias("k"))
    sq = per.agg(F.sum(F.col("k").cast("double") * F.col("k").cast("double")).alias("sq"))
    t = total.crossJoin(sq)  # one row each
    pe = F.col("sq") / (F.col("n") * n_models) / (F.col("n") * n_models)
    pbar = F.col("p") / F.col("n")
    kappa = F.when(F.col("n") < 1, None).when(pe >= 1, 1.0).otherwise((pbar - pe) / (1 - pe))
    return t.select("n", F.round(kappa, 6).alias("kappa"))


def log_odds_weight(acc: Column, k: int) -> Column:
    """A model's vote weight from its accuracy among k labels."""
    a = F.least(F.greatest(acc, F.lit(1.0 / k + 0.01)), F.lit(0.99))
    return F.round(F.greatest(F.log(a * (k - 1) / (1 - a)), F.lit(0.05)), 3)


def shares(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """n and share of each value (null as its own) within groups."""
    t = rows.groupBy(*by, F.coalesce(column, F.lit("(none)")).alias(column)).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*[F.col(b) for b in by] or [F.lit(0)])), 6))


#: Changes between two runs that alert (fixed values).
HUMAN_UP, AUTO_DOWN, ACC_DOWN, LABELS_MOVED = 0.08, 0.10, 0.05, 0.15


def drift(runs: DataFrame) -> DataFrame:
    """``runs(run, human_rate, auto_rate, acc, criteria, tv)`` with alerts against the run before, and whether both had the
    same criteria; one row a run, so one window over all is small."""
    w = Window.partitionBy(F.lit(0)).orderBy("run")
    rise = lambda c: F.round(F.col(c) - F.lag(c).over(w), 6)
    return runs.withColumns({
        "human_up": rise("human_rate") >= HUMAN_UP, "auto_down": rise("auto_rate") <= -AUTO_DOWN, "acc_down": rise("acc") <= -ACC_DOWN,
        "labels_moved": F.col("tv") >= LABELS_MOVED, "same_criteria": F.col("criteria") == F.lag("criteria").over(w),
    })


#: By how much Stirling's formula falls short of log n! for small n; beyond, four terms of its series do.
_SHORT = [0.0] + [math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) for n in range(1, 16)]
TERMS, LARGE = 1_000, 50_000  # terms that the sum of a tail takes at most, and the count beyond which it isn't summed


def _fold(n: int, start: dict[str, Column], step: Callable[[dict[str, Column], Column], dict[str, Column]], out: str) -> Column:
    """``n`` steps over named numbers, in constant memory."""
    struct = lambda x: F.struct(*[v.alias(k) for k, v in x.items()])
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), struct(start), lambda a, i: struct(step({k: a[k] for k in start}, i)), lambda a: a[out])


def _short(n: Column) -> Column:
    x = F.greatest(n, F.lit(1.0))
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return F.when(n < 16, F.element_at(F.array(*[F.lit(v) for v in _SHORT]), (F.least(n, F.lit(15.0)) + 1).cast("int"))).otherwise(series)


def _deviance(d: Column, m: Column) -> Column:
    """m/2 ((1-d) log(1-d) + (1+d) log(1+d)), without loss of digits for small d."""
    low = F.when(d >= 1, 0.0).otherwise((1 - d) * F.log1p(F.when(d < 1, -d)))
    return m / 2 * (low + (1 + d) * F.log1p(d))


def normal_tail(w: Column) -> Column:
    """P(Z > w) of a standard normal Z for w >= 0: the series of the distribution function near 0, a continued fraction beyond."""
    density = F.exp(-w * w / 2) / math.sqrt(2 * math.pi)
    near = _fold(60, {"t": w, "s": w}, lambda a, i: {"t": a["t"] * w * w / (2 * i + 1), "s": a["s"] + a["t"] * w * w / (2 * i + 1)}, "s")
    far = _fold(60, {"f": w}, lambda a, i: {"f": w + (61 - i) / F.greatest(a["f"], F.lit(1e-300))}, "f")
    return F.when(w < 3, 0.5 - density * near).otherwise(density / far)


def mcnemar(a_only: Column, b_only: Column) -> Column:
    """Two-sided p of discordant counts: twice the lower binomial tail at 1/2, at most 1; 1 without any.

    The tail is the probability of the smaller count, from its deviance, times the sum of the ratios of those below it. Beyond
    ``LARGE`` counts, where that sum gets long, it is the saddlepoint tail with the continuity correction (Lugannani and Rice,
    1980; Daniels, 1987), whose relative error falls with the counts (some 1e-6 there).
    """
    m, k = (a_only + b_only).cast("double"), F.least(a_only, b_only).cast("double")
    d = (m - 2 * k) / m
    at_k = F.exp(-_deviance(d, m) + _short(m) - _short(k) - _short(m - k)) * F.when(k == 0, 1.0).otherwise(F.sqrt(m / (2 * math.pi * k * (m - k))))
    step = lambda a, i: {"t": a["t"] * F.greatest(k - i + 1, F.lit(0.0)) / (m - k + i), "s": a["s"] + a["t"] * F.greatest(k - i + 1, F.lit(0.0)) / (m - k + i)}
    summed = at_k * _fold(TERMS, {"t": F.lit(1.0), "s": F.lit(1.0)}, step, "s")
    e = (m - 2 * k - 1) / m  # half a count nearer to the middle
    w = F.sqrt(2 * _deviance(e, m))
    # log((1+e)/(1-e)) is the saddlepoint, 2 sinh of its half is 2e / sqrt(1-e*e)
    u = 2 * e / F.sqrt(1 - e * e) * F.sqrt(m * (1 - e * e)) / 2
    saddle = normal_tail(w) + F.exp(-w * w / 2) / math.sqrt(2 * math.pi) * (1 / u - 1 / w)
    return F.when(m == 0, 1.0).when(2 * k + 1 >= m, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(m > LARGE, saddle).otherwise(summed)))
