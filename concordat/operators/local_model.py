"""A local annotator: TF-IDF of character n-grams and words with logistic regression, by Spark's own library."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def char_grams(text, lo: int = 2, hi: int = 4):
    """Character n-grams within words padded by a blank on both sides, as an array with repeats."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    starts = lambda p, n: F.sequence(F.lit(1), F.length(p) - n + 1)
    of = lambda p, n: F.when(F.length(p) >= n, F.transform(starts(p, n), lambda i: F.substr(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[F.flatten(F.transform(padded, lambda p, n=n: of(p, n))) for n in range(lo, hi + 1)])


def features(rows: DataFrame) -> DataFrame:
    """Column ``grams``: character n-grams within words, and words."""
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: F.length(w) >= 2)
    return rows.withColumn("grams", F.concat(char_grams(F.col("text"), 2, 3), words))


def fit(train: DataFrame, n_features: int = 1 << 14, c: float = 4.0):
    """``train(grams, label double)``; classes are balanced by weight."""
    n, w = train.count(), Window.partitionBy("label")
    k = max(1, train.select("label").distinct().count())
    weighted = train.withColumn("weight", F.lit(n / k) / F.count("*").over(w))
    steps = [HashingTF(inputCol="grams", outputCol="tf", numFeatures=n_features), IDF(inputCol="tf", outputCol="x")]
    lr = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=30)
    return Pipeline(stages=[*steps, lr]).fit(weighted)


def gain(rows: DataFrame, sizes: list[int], base: int) -> DataFrame:
    """(k, n_train, n_rest, accuracy) on the rows never trained on, after adding k labelled rows to ``base``.

    ``rows(seq, text, label)``; rows are taken in the order of a hash of seq.
    """
    spark = rows.sparkSession
    order = rows.select("seq").orderBy(F.md5(F.col("seq").cast("string")), "seq").limit(base + max(sizes)).collect()
    rank = {r[0]: i for i, r in enumerate(order)}
    ranks = F.broadcast(spark.createDataFrame(sorted(rank.items()), "seq bigint, rank int"))
    f = features(rows.join(ranks, "seq").select("rank", "text", F.col("label").cast("double").alias("label"))).drop("text")
    path = shared_dir(spark, "train")
    f.coalesce(1).write.parquet(path)  # few rows, read by every pass of every fit
    f = spark.read.schema(f.schema).parquet(path)
    models = [fit(f.where(F.col("rank") < base + k).select("grams", "label")) for k in [0, *sizes]]
    # the other rows are read once: features and term counts are the same for all models
    rest = features(rows.join(ranks, "seq", "left_anti").select("text", F.col("label").cast("double").alias("label"))).drop("text")
    rest = models[0].stages[0].transform(rest).drop("grams")
    for i, (_, idf, lr) in enumerate(m.stages for m in models):
        rest = idf.setOutputCol(f"x{i}").transform(rest)
        rest = lr.setFeaturesCol(f"x{i}").setPredictionCol(f"p{i}").setRawPredictionCol("").setProbabilityCol("").transform(rest)
    r = rest.agg(F.count("*"), *[F.avg((F.col(f"p{i}") == F.col("label")).cast("double")) for i in range(len(models))]).first()
    out = [(k, base + k, r[0], round(r[1 + i] or 0.0, 6)) for i, k in enumerate([0, *sizes])]
    return spark.createDataFrame(out, "k int, n_train int, n_rest bigint, accuracy double")
