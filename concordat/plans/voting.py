"""Queries over votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import votes
from ..sources.tables import ANN_SQL, GOLD_SQL, LABELS, MAJORITY_SQL, WEIGHT_SQL, WEIGHTED_SQL, WEIGHTS, annotations, gold, table
from .registry import query


@query(f"WITH {ANN_SQL}, {MAJORITY_SQL} SELECT item_id, label, cnt, conf, valid FROM maj")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.majority(annotations(spark, sf_dir))


@query(f"WITH {ANN_SQL}, {WEIGHTED_SQL} SELECT item_id, label, round(share, 6) AS share, agree, total FROM wv")
def vote_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.weighted(annotations(spark, sf_dir), WEIGHTS).withColumn("share", F.round("share", 6))


# multi-label votes: an order's line flags and statuses as sets of labels, one vote per model
_FLAGS = "CASE WHEN l_linenumber <> 5 THEN CASE l_partkey % 4 WHEN 0 THEN concat(l_returnflag, '; ', l_linestatus) WHEN 1 THEN concat(l_linestatus, '|', l_returnflag) ELSE l_returnflag END END"


@query(f"""
WITH v AS (
  SELECT l_orderkey AS item_id, concat('m', CAST(l_suppkey % 4 AS varchar)) AS model, CAST(l_suppkey % 4 AS int) AS model_ord,
    l_quantity / 64.0 AS confidence, CASE l_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS evidence_ok, {_FLAGS} AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1),
ok AS (SELECT *, CAST({WEIGHT_SQL} AS double) * greatest(confidence, 0.05) * CASE WHEN evidence_ok = false THEN 0.5 ELSE 1.0 END AS w,
    list_distinct(list_transform(string_split(replace(label, ';', '|'), '|'), lambda x: trim(x))) AS parts FROM v WHERE label IS NOT NULL),
tot AS (SELECT item_id, sum(w) AS aw, count(*) AS total FROM ok GROUP BY item_id),
each AS (SELECT item_id, part, sum(w) AS score, min(model_ord) AS first_ord FROM (SELECT item_id, w, model_ord, unnest(parts) AS part FROM ok) GROUP BY item_id, part),
fr AS (SELECT e.*, score / aw AS frac, total, row_number() OVER (PARTITION BY e.item_id ORDER BY score / aw DESC, first_ord, part) AS rk,
    max(CASE WHEN score / aw > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY e.item_id) AS any_kept FROM each e JOIN tot USING (item_id)),
pick AS (SELECT item_id, total, min(greatest(frac, 1 - frac)) AS share,
    string_agg(part, '|' ORDER BY CASE part WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 WHEN 'F' THEN 3 ELSE 4 END)
      FILTER (WHERE (any_kept = 1 AND frac > 0.5) OR (any_kept = 0 AND rk = 1)) AS label FROM fr GROUP BY item_id, total),
voted AS (SELECT item_id, (SELECT string_agg(p, '|' ORDER BY CASE p WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 WHEN 'F' THEN 3 ELSE 4 END)
    FROM (SELECT unnest(parts) AS p)) AS voted FROM ok)
SELECT p.item_id, p.label, round(p.share, 6) AS share, (SELECT count(*) FROM voted d WHERE d.item_id = p.item_id AND d.voted = p.label) AS agree, p.total FROM pick p
""")
def vote_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", F.col("l_suppkey") % 4).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part = F.col("l_partkey") % 3
    kind = F.col("l_partkey") % 4
    flags = F.when(kind == 0, F.concat_ws("; ", "l_returnflag", "l_linestatus")).when(kind == 1, F.concat_ws("|", "l_linestatus", "l_returnflag")).otherwise(F.col("l_returnflag"))
    v = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(
        F.col("l_orderkey").alias("item_id"), F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model"),
        (F.col("l_suppkey") % 4).cast("int").alias("model_ord"), (F.col("l_quantity") / 64.0).alias("confidence"),
        F.when(part == 0, False).when(part == 1, True).alias("evidence_ok"), F.when(F.col("l_linenumber") != 5, flags).alias("label"),
        F.lit(None).cast("string").alias("error"),
    )
    return votes.multilabel(v, [*LABELS, "F", "O"], WEIGHTS).withColumn("share", F.round("share", 6))


@query(f"WITH {ANN_SQL} SELECT item_id, label, count(*) AS votes FROM ann WHERE label IS NOT NULL AND error IS NULL GROUP BY item_id, label")
def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.valid(annotations(spark, sf_dir)).groupBy("item_id", "label").agg(F.count("*").alias("votes"))


@query(f"""WITH {ANN_SQL}, {MAJORITY_SQL}
SELECT m.item_id, m.label, round(CAST(m.cnt AS double) / s.size, 3) AS confidence FROM maj m JOIN (SELECT item_id, count(*) AS size FROM ann GROUP BY item_id) s USING (item_id)""")
def jury_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.jury(annotations(spark, sf_dir))


_RUNS = """runs AS (
  SELECT l_orderkey AS item_id, concat('m', CAST(l_suppkey % 2 AS varchar)) AS model,
    CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS run,
    CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS label, l_quantity / 64.0 AS confidence FROM lineitem)"""


@query(f"""WITH {_RUNS},
t AS (SELECT item_id, model, label, count(*) AS cnt, sum(confidence) AS conf, min(run) AS first_run FROM runs WHERE label IS NOT NULL GROUP BY item_id, model, label),
n AS (SELECT item_id, model, count(*) AS n_runs FROM runs GROUP BY item_id, model),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id, model ORDER BY cnt DESC, conf DESC, first_run) AS rk FROM t)
SELECT n.item_id, n.model, b.label, CASE WHEN b.label IS NULL THEN 0.0 ELSE CAST(b.cnt AS double) / n_runs END AS confidence, n_runs FROM n
LEFT JOIN (SELECT * FROM b WHERE rk = 1) b ON n.item_id = b.item_id AND n.model = b.model""")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated samples of one model: its most frequent label, with all runs in the denominator."""
    order = Window.partitionBy("item_id", "model").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    runs = table(spark, sf_dir, "lineitem").withColumn("item_id", F.col("l_orderkey")).withColumn("model", F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string")))
    runs = runs.withColumn("run", F.row_number().over(order)).select(
        "item_id", "model", "run", F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")).alias("label"), (F.col("l_quantity") / 64.0).alias("confidence")
    )
    n = runs.groupBy("item_id", "model").agg(F.count("*").alias("n_runs"))
    t = runs.where("label IS NOT NULL").groupBy("item_id", "model", "label").agg(F.count("*").alias("cnt"), F.sum("confidence").alias("conf"), F.min("run").alias("first_run"))
    top = t.withColumn("rk", F.row_number().over(Window.partitionBy("item_id", "model").orderBy(F.desc("cnt"), F.desc("conf"), "first_run"))).where("rk = 1")
    out = n.join(top, ["item_id", "model"], "left")
    return out.select("item_id", "model", "label", F.when(F.col("label").isNull(), 0.0).otherwise(F.col("cnt") / F.col("n_runs")).alias("confidence"), "n_runs")


@query(f"""WITH {ANN_SQL}
SELECT item_id, n_labels, n_failed FROM (
  SELECT item_id, count(DISTINCT CASE WHEN error IS NULL THEN label END) AS n_labels,
    count(*) FILTER (WHERE error IS NOT NULL OR label IS NULL) AS n_failed FROM ann GROUP BY item_id) WHERE n_labels > 1 OR n_failed > 0""")
def disagreement_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.disagreement(annotations(spark, sf_dir)).where("disagree").drop("disagree")


@query(f"""WITH {ANN_SQL}, {GOLD_SQL}, {MAJORITY_SQL}, j AS (SELECT cnt, label, gold FROM maj JOIN gold USING (item_id))
SELECT need, count(*) AS n, count(*) FILTER (WHERE cnt >= need) AS n_auto,
  round(CAST(count(*) FILTER (WHERE cnt >= need) AS double) / count(*), 6) AS coverage,
  round(CAST(count(*) FILTER (WHERE cnt >= need AND label = gold) AS double) / nullif(count(*) FILTER (WHERE cnt >= need), 0), 6) AS auto_acc,
  round(CAST(count(*) FILTER (WHERE cnt >= need AND label = gold) + count(*) FILTER (WHERE cnt < need) AS double) / count(*), 6) AS with_human
FROM j, (SELECT unnest([1, 2, 3, 4]) AS need) GROUP BY need""")
def agreement_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept items whose top label has at least ``need`` votes; the rest goes to people."""
    j = votes.majority(annotations(spark, sf_dir)).join(gold(spark, sf_dir), "item_id")
    j = j.withColumn("need", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    auto, right = F.count_if(F.expr("cnt >= need")), F.count_if(F.expr("cnt >= need AND label = gold"))
    return j.groupBy("need").agg(
        F.count("*").alias("n"), auto.alias("n_auto"), F.round(auto / F.count("*"), 6).alias("coverage"),
        F.round(F.try_divide(right, auto), 6).alias("auto_acc"), F.round((right + F.count("*") - auto) / F.count("*"), 6).alias("with_human"),
    )


_PRIOR = {"A": 0.5, "N": 0.3, "R": 0.2}
_DIAG = {"m0": 0.7, "m1": 0.6, "m2": 0.8}


@query(f"""WITH {ANN_SQL},
conf AS (SELECT model, t AS true_label, p AS pred, CASE WHEN t = p THEN d ELSE (1 - d) / 2 END AS pr
  FROM (VALUES ('m0', CAST(0.7 AS double)), ('m1', 0.6), ('m2', 0.8)) m(model, d), (VALUES ('A'), ('N'), ('R')) x(t), (VALUES ('A'), ('N'), ('R')) y(p)),
ll AS (SELECT item_id, true_label AS label, sum(CASE WHEN evidence_ok = false THEN 0.5 ELSE 1.0 END * ln(greatest(pr, 1e-9))) AS ll
  FROM ann a JOIN conf c ON a.model = c.model AND a.label = c.pred WHERE a.error IS NULL GROUP BY item_id, true_label),
lp AS (SELECT item_id, label, ll + ln(CASE label WHEN 'A' THEN CAST(0.5 AS double) WHEN 'N' THEN 0.3 ELSE 0.2 END) AS ll FROM ll),
e AS (SELECT item_id, label, exp(ll - max(ll) OVER (PARTITION BY item_id)) AS e FROM lp)
SELECT item_id, label, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS prob FROM e""")
def vote_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(m, t, p, d if t == p else (1 - d) / 2) for m, d in _DIAG.items() for t in LABELS for p in LABELS]
    confusion = spark.createDataFrame(rows, "model string, truth string, pred string, p double")
    return votes.posterior(annotations(spark, sf_dir), _PRIOR, confusion).withColumn("prob", F.round("prob", 6))
