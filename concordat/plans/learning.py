"""Queries that fit something, which SQL can't express: curves, aggregators, a local model, a diverse queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import annotator, calibration, crowd, local_model, sampling, text_neighbours, votes
from ..operators import rule_search as rule_searches
from ..operators.metrics import rate
from ..sources.shared import kept, shared_dir
from ..sources.tables import LABELS, annotations, gold, table
from .calibration import crossfit, crossfit_weighted, points
from .registry import query


@query()
def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.curves(points(spark, sf_dir)).where("method = 'isotonic'").select("model", "lo", "hi", "value")


@query()
def platt_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.curves(points(spark, sf_dir)).where("method = 'platt'").select("model", "a", "b")


@query()
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = calibration.report(points(spark, sf_dir).withColumnRenamed("item_id", "key"))
    return r.withColumns({c: F.round(c, 6) for c in ("accuracy", "mean_conf", "ece_before", "ece_after")})


@query()
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a calibration file holds for each model: chosen method, accuracy and number of points."""
    return calibration_report(spark, sf_dir).select("model", "method", "accuracy", "n")


@query()
def compare_aggregators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each model, vote and crowd model, best first, over all items with gold; no label is wrong.

    What needs gold is fitted without the item's fold: the weights of models, their confusion, and that with calibrated
    confidence.
    """
    ann, g = annotations(spark, sf_dir), gold(spark, sf_dir)
    models = crowd.Crowd(votes.valid(ann), LABELS)
    each = {"majority": votes.majority(ann), "weighted": crossfit_weighted(spark, sf_dir), "posterior": crossfit(spark, sf_dir), "calibrated": crossfit(spark, sf_dir, use_confidence=True)}
    each |= {m: models.best(m) for m in crowd.METHODS}
    rows = ann.select("item_id", F.col("model").alias("strategy"), F.when(F.col("error").isNull(), F.col("label")).alias("label"))
    for name, labels in each.items():
        rows = rows.unionByName(labels.select("item_id", F.lit(name).alias("strategy"), "label"))
    right = rows.join(g, "item_id").groupBy("strategy").agg(F.count_if(F.col("label") == F.col("gold")).alias("r"))
    n = g.join(ann.select("item_id").distinct(), "item_id", "left_semi").agg(F.count("*").alias("n"))
    acc = right.crossJoin(n).select("strategy", "n", rate(F.col("r"), F.col("n")).alias("accuracy"))  # one row a strategy
    return acc.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("accuracy"), "strategy")))


RULES = ("letters", "distinct", "capitals")


def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, text and the labels that simple ``RULES`` give to the quality of labelled documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    share = lambda p: F.length(F.regexp_replace("text", p, "")) / F.greatest(F.length("text"), F.lit(1))
    words = F.split("text", r"\s+")
    rules = {"letters": share("[^A-Za-z ]+") >= 0.8, "distinct": F.size(F.array_distinct(words)) / F.size(words) >= 0.5, "capitals": share("[^A-Z]+") < 0.06}
    return d.select(F.col("doc_id").alias("item_id"), "text", F.array(*[F.when(rules[m], "1").otherwise("0") for m in RULES]).alias("labels"))


@query()
def active_queue(spark: SparkSession, sf_dir: str, alike: float = 0.9) -> DataFrame:
    """The most uncertain items first; an item too similar to one chosen before comes after all chosen ones.

    The greedy choice holds for any number of items. Of equal texts only the first can be chosen, as all others are like
    what it is like, and it. Texts are read by the rules once, and equal ones are told by their SHA-256.
    """
    ruled = kept(rule_labels(spark, sf_dir), "ruled")
    v = ruled.select("item_id", F.posexplode("labels").alias("model_ord", "label")).withColumns({"confidence": F.lit(0.75), "error": F.lit(None).cast("string")})
    score = sampling.uncertainty(votes.valid(v), ruled.select("item_id")).join(ruled.groupBy("item_id").agg(F.min("text").alias("text")), "item_id")
    order = F.struct((-F.col("score")).alias("s"), F.col("item_id").cast("string").alias("i"))
    score = kept(score.withColumn("order", order).withColumn("of", F.sha2("text", 256)), "queue")
    first = score.groupBy("of").agg(F.min_by("item_id", "order").alias("item_id")).select("item_id")
    held = text_neighbours.held_back(score.join(first, "item_id", "left_semi").select(F.col("item_id").alias("id"), "order", "text"), alike)
    chosen = first.join(held.withColumnRenamed("id", "item_id"), "item_id", "left_anti").withColumn("chosen", F.lit(True))
    out = score.drop("text", "of").join(chosen, "item_id", "left").withColumn("similar", F.col("chosen").isNull())
    return out.orderBy("similar", "order").select("item_id", "score", "similar")


@query()
def local_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the local model on the rest as labelled documents are added."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.groupBy("doc_id").agg(F.min_by("text", F.struct("text", "quality")).alias("text"), F.min_by("quality", F.struct("text", "quality")).alias("quality"))
    return local_model.gain(d.select(F.col("doc_id").alias("seq"), "text", F.col("quality").alias("label")), [20, 50], 30)


def quality_rules() -> dict[str, Column]:
    """Rules on a document's text that give a quality label or nothing."""
    words = F.split("text", r"\s+")
    share = lambda p: F.length(F.regexp_replace("text", p, "")) / F.greatest(F.length("text"), F.lit(1))
    return {
        "short": F.when(F.size(words) < 50, "0"), "repeats": F.when(F.size(F.array_distinct(words)) / F.size(words) < 0.3, "0"), "signs": F.when(share("[^#*$%&|<>]") > 0.02, "0"),
        "capitals": F.when(share("[^A-Z]") > 0.06, "0"), "sentences": F.when(F.regexp_count("text", F.lit(r"[.!?]\s")) >= 3, "1"), "long": F.when(F.size(words) >= 200, "1"),
    }


@query()
def rule_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for rules of quality, from one rule on; two thirds of the labelled documents tune, the others are held out."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("string").alias("gold"))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").join(labels, "doc_id")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return rule_searches.search(rows.where(~out), rows.where(out), quality_rules(), ("long",), "gold", "0")


KEYWORDS = {"rules": [["###", "bad"], ["!!", "bad"]], "otherwise": "good"}


@query("""SELECT doc_id AS item_id, CASE WHEN contains(t, '###') OR contains(t, '!!') THEN 'bad' ELSE 'good' END AS label, CAST(CASE WHEN contains(t, '###') OR contains(t, '!!') THEN 0.9 ELSE 0.6 END AS double) AS confidence,
CASE WHEN contains(t, '###') THEN 'keyword ###' WHEN contains(t, '!!') THEN 'keyword !!' ELSE 'none' END AS reason FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def annotate_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword annotator asked about all documents, after a third of them has filled its reply cache."""
    items, cache = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"), shared_dir(spark, "replies")
    annotator.annotate(items.where("item_id % 3 = 0"), ["good", "bad"], cache, "keyword", KEYWORDS)
    return annotator.annotate(items, ["good", "bad"], cache, "keyword", KEYWORDS).drop("error")
