"""Queries that compare labels with gold and with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, routing, votes
from ..operators.metrics import rate
from ..operators.routing import STATUSES
from ..sources.tables import ANN_SQL, GOLD_SQL, LABELS, MAJORITY_SQL, MODELS, WEIGHTS, annotations, gold, table
from .registry import query
from .routing import BASE, routed

FULL = f"{BASE}, {MAJORITY_SQL}"
OK = "error IS NULL AND label IS NOT NULL"
STRATEGY_SQL = f"""{FULL}, strat AS (
  SELECT item_id, model AS strategy, CASE WHEN error IS NULL THEN label END AS label FROM ann
  UNION ALL SELECT item_id, 'majority', label FROM maj UNION ALL SELECT item_id, 'weighted', label FROM wv
  UNION ALL SELECT item_id, 'system', label FROM routed), sg AS (SELECT strategy, label, gold FROM strat JOIN gold USING (item_id))"""


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, strategy, label, gold) of each model, both votes and the routed system."""
    ann = annotations(spark, sf_dir)
    models = ann.select("item_id", F.col("model").alias("strategy"), F.when(F.col("error").isNull(), F.col("label")).alias("label"))
    pair = F.explode(F.array(*[F.struct(F.lit(x).alias("strategy"), F.col(x).alias("label")) for x in ("majority", "weighted")]))
    out = models.unionByName(votes.both(ann, WEIGHTS).select("item_id", pair.alias("x")).select("item_id", "x.*"))
    out = out.unionByName(routed(spark, sf_dir).select("item_id", F.lit("system").alias("strategy"), "label"))
    return out.join(gold(spark, sf_dir), "item_id")


@query(f"""{STRATEGY_SQL} SELECT strategy, count(*) AS n, count(*) FILTER (WHERE label = gold) AS right_,
  round(CAST(count(*) FILTER (WHERE label = gold) AS double) / count(*), 6) AS accuracy FROM sg GROUP BY strategy""")
def eval_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(strategies(spark, sf_dir), "strategy")


@query(f"""WITH {ANN_SQL}, {GOLD_SQL} SELECT model, count(*) AS called, count(*) FILTER (WHERE {OK}) AS answered,
  round(CAST(count(*) FILTER (WHERE {OK} AND label = gold) AS double) / count(*), 6) AS accuracy,
  round(avg(confidence) FILTER (WHERE {OK}), 6) AS mean_confidence FROM ann JOIN gold USING (item_id) GROUP BY model""")
def eval_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called but failed counts as wrong, not called doesn't count."""
    j = annotations(spark, sf_dir).join(gold(spark, sf_dir), "item_id")
    ok = F.expr(OK)
    return j.groupBy("model").agg(
        F.count("*").alias("called"), F.count_if(ok).alias("answered"), rate(F.count_if(ok & (F.col("label") == F.col("gold"))), F.count("*")).alias("accuracy"),
        F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("mean_confidence"),
    )


@query(f"""{STRATEGY_SQL}, ns AS (SELECT gold AS class, count(*) AS n FROM gold GROUP BY gold)
SELECT s.strategy, ns.class, ns.n, round(CAST(count(*) FILTER (WHERE sg.label = sg.gold) AS double) / ns.n, 6) AS recall
FROM (SELECT DISTINCT strategy FROM sg) s CROSS JOIN ns LEFT JOIN sg ON sg.strategy = s.strategy AND sg.gold = ns.class GROUP BY s.strategy, ns.class, ns.n""")
def eval_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by gold label; an item that a strategy doesn't have is a miss."""
    sg = strategies(spark, sf_dir)
    n = gold(spark, sf_dir).groupBy(F.col("gold").alias("class")).agg(F.count("*").alias("n"))
    hits = sg.groupBy("strategy", F.col("gold").alias("class")).agg(F.count_if(F.col("label") == F.col("gold")).alias("hits"))
    return hits.join(F.broadcast(n), "class").select("strategy", "class", "n", rate(F.col("hits"), F.col("n")).alias("recall"))


@query(f"""{FULL}, ub AS (SELECT item_id, bool_or(label = gold) AS any_right FROM ann JOIN gold USING (item_id) WHERE {OK} GROUP BY item_id)
SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE status <> 'need_human') AS double) / count(*), 6) AS coverage,
  round(CAST(count(*) FILTER (WHERE status <> 'need_human' AND label = gold) AS double) / count(*) FILTER (WHERE status <> 'need_human'), 6) AS auto_accuracy,
  round(CAST(count(*) FILTER (WHERE label = gold OR status = 'need_human') AS double) / count(*), 6) AS with_human,
  round(CAST(count(*) FILTER (WHERE any_right) AS double) / count(*), 6) AS upper_bound
FROM routed JOIN gold USING (item_id) LEFT JOIN ub USING (item_id)""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir)
    ub = votes.valid(annotations(spark, sf_dir)).join(g, "item_id").groupBy("item_id").agg(F.bool_or(F.col("label") == F.col("gold")).alias("any_right"))
    j = routed(spark, sf_dir).join(g, "item_id").join(ub, "item_id", "left")
    auto, right, n = F.col("status") != "need_human", F.col("label") == F.col("gold"), F.count("*")
    return j.agg(
        n.alias("n"), rate(F.count_if(auto), n).alias("coverage"), rate(F.count_if(auto & right), F.count_if(auto)).alias("auto_accuracy"),
        rate(F.count_if(right | ~auto), n).alias("with_human"), rate(F.count_if("any_right"), n).alias("upper_bound"),
    )


@query(f"{FULL} SELECT item_id, label, gold, status FROM routed JOIN gold USING (item_id) WHERE label IS DISTINCT FROM gold")
def error_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = routed(spark, sf_dir).join(gold(spark, sf_dir), "item_id")
    return j.where(~F.col("label").eqNullSafe(F.col("gold"))).select("item_id", "label", "gold", "status")


@query(f"{FULL} SELECT gold, coalesce(label, '(none)') AS predicted, count(*) AS n FROM routed JOIN gold USING (item_id) GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = routed(spark, sf_dir).join(gold(spark, sf_dir), "item_id")
    return j.groupBy("gold", F.coalesce("label", F.lit("(none)")).alias("predicted")).agg(F.count("*").alias("n"))


@query(f"""WITH {ANN_SQL}, c AS (SELECT item_id, label, count(*) AS c FROM ann WHERE {OK} GROUP BY item_id, label),
it AS (SELECT item_id, sum(c * c) AS sq FROM c GROUP BY item_id HAVING sum(c) = 4),
t AS (SELECT count(*) AS n, sum(CAST(sq - 4 AS double) / 12) / count(*) AS pbar FROM it),
pe AS (SELECT sum(CAST(k AS double) * k) AS sq FROM (SELECT label, sum(c) AS k FROM c WHERE item_id IN (SELECT item_id FROM it) GROUP BY label))
SELECT n, round(CASE WHEN sq / (n * 4) / (n * 4) >= 1 THEN 1.0 ELSE (pbar - sq / (n * 4) / (n * 4)) / (1 - sq / (n * 4) / (n * 4)) END, 6) AS kappa FROM t, pe""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fleiss_kappa(votes.valid(annotations(spark, sf_dir)), len(MODELS))


@query(f"""{STRATEGY_SQL}, cl AS (SELECT DISTINCT strategy, gold AS class FROM sg),
p AS (SELECT strategy, label AS class, count(*) AS pred, count(*) FILTER (WHERE label = gold) AS tp FROM sg WHERE label IS NOT NULL GROUP BY ALL),
t AS (SELECT strategy, gold AS class, count(*) AS tr FROM sg GROUP BY ALL)
SELECT cl.strategy, count(*) AS classes, round(avg(CASE WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 2.0 * tp / (pred + tr) END), 6) AS macro_f1
FROM cl JOIN t USING (strategy, class) LEFT JOIN p USING (strategy, class) GROUP BY cl.strategy""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean F1 over the labels that gold has; 0 where nothing is right."""
    parts = metrics.f1_parts(strategies(spark, sf_dir), "strategy").where("tp + fn > 0")
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return parts.groupBy("strategy").agg(F.count("*").alias("classes"), F.round(F.avg(f1), 6).alias("macro_f1"))


_SETS = """
p AS (SELECT l_orderkey AS item_id, list_distinct(list(l_returnflag)) AS pred FROM lineitem GROUP BY l_orderkey),
g AS (SELECT l_orderkey AS item_id, list_distinct(list(CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_partkey % 2 = 0 THEN 'A' ELSE 'R' END)) AS gold FROM lineitem GROUP BY l_orderkey),
s AS (SELECT len(list_intersect(pred, gold)) AS tp, len(pred) AS np, len(gold) AS ng FROM p JOIN g USING (item_id))"""


@query(f"""WITH {_SETS} SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE tp = np AND tp = ng) AS double) / count(*), 6) AS exact,
  round(2.0 * CAST(sum(tp) AS double) / CAST(sum(np) + sum(ng) AS double), 6) AS micro_f1,
  round(CAST(sum(np + ng - 2 * tp) AS double) / (count(*) * 3), 6) AS hamming FROM s""")
def multilabel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match, micro F1 (0 where undefined) and Hamming loss of label sets over three labels."""
    li = table(spark, sf_dir, "lineitem")
    true = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_partkey") % 2 == 0, "A").otherwise("R")
    s = li.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("pred"), F.collect_set(true).alias("gold"))
    s = s.select(F.size(F.array_intersect("pred", "gold")).alias("tp"), F.size("pred").alias("np"), F.size("gold").alias("ng"))
    n = F.count("*")
    return s.agg(
        n.alias("n"), rate(F.count_if(F.expr("tp = np AND tp = ng")), n).alias("exact"),
        F.coalesce(rate(2 * F.sum("tp"), F.sum("np") + F.sum("ng")), F.lit(0.0)).alias("micro_f1"), rate(F.sum(F.expr("np + ng - 2 * tp")), n * len(LABELS)).alias("hamming"),
    )


@query("""SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE a.r_name = b.r_name) AS double) / count(*), 6) AS level1,
  round(CAST(count(*) FILTER (WHERE a.n_name = b.n_name) AS double) / count(*), 6) AS level2
FROM customer c JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) a ON c.c_nationkey = a.n_nationkey
JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) b ON (c.c_custkey * 7) % 25 = b.n_nationkey""")
def level1_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level labels region/nation: accuracy of the parent and of the whole label."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lab = nation.select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("label"))
    c = table(spark, sf_dir, "customer").select("c_nationkey", ((F.col("c_custkey") * 7) % 25).alias("guess"))
    j = c.join(F.broadcast(lab.withColumnRenamed("label", "gold")), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    j = j.join(F.broadcast(lab), F.col("guess") == F.col("n_nationkey"))
    parent = lambda c: F.substring_index(c, "/", 1)
    n = F.count("*")
    return j.agg(n.alias("n"), rate(F.count_if(parent("label") == parent("gold")), n).alias("level1"), rate(F.count_if(F.col("label") == F.col("gold")), n).alias("level2"))


@query(f"""WITH {ANN_SQL} SELECT a.model AS model_a, b.model AS model_b, count(*) AS n,
  round(100.0 * CAST(count(*) FILTER (WHERE a.label = b.label) AS double) / count(*), 6) AS agreement
FROM (SELECT * FROM ann WHERE {OK}) a JOIN (SELECT * FROM ann WHERE {OK}) b ON a.item_id = b.item_id AND a.model_ord <= b.model_ord GROUP BY ALL""")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By pairs of models, from one row per item: its votes are few, so the pairs are made without a join."""
    v = votes.valid(annotations(spark, sf_dir)).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("model", "label"))).alias("v"))
    a = v.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b")).where("a.model <= b.model")
    same = F.count_if(F.col("a.label") == F.col("b.label"))
    return a.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(F.count("*").alias("n"), F.round(100.0 * same / F.count("*"), 6).alias("agreement"))


@query(f"""WITH {ANN_SQL} SELECT model, count(*) FILTER (WHERE label = 'A') AS "A", count(*) FILTER (WHERE label = 'N') AS "N", count(*) FILTER (WHERE label = 'R') AS "R"
FROM ann WHERE {OK} GROUP BY model""")
def model_label_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.valid(annotations(spark, sf_dir)).groupBy("model").pivot("label", LABELS).agg(F.count("label")).fillna(0, LABELS)


@query(f"""{FULL} SELECT s.status, count(r.item_id) AS n, round(CAST(count(r.item_id) AS double) / (SELECT count(*) FROM routed), 6) AS share
FROM (VALUES ('consensus'), ('majority'), ('arbitrated'), ('need_human')) s(status) LEFT JOIN routed r USING (status) GROUP BY s.status""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statuses, those without an item too."""
    n = routed(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string").join(n, "status", "left").fillna(0, ["n"])
    from pyspark.sql import Window

    return every.withColumn("share", F.round(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))), 6))  # four rows


@query(f"""WITH {ANN_SQL}, {GOLD_SQL}, m AS (SELECT model, CAST(count(*) FILTER (WHERE {OK} AND label = gold) AS double) / count(*) AS acc FROM ann JOIN gold USING (item_id) GROUP BY model)
SELECT model, round(acc, 6) AS accuracy, round(greatest(ln(least(greatest(acc, 1.0 / 3 + 0.01), 0.99) * 2 / (1 - least(greatest(acc, 1.0 / 3 + 0.01), 0.99))), 0.05), 3) AS weight FROM m""")
def model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = annotations(spark, sf_dir).join(gold(spark, sf_dir), "item_id")
    acc = j.groupBy("model").agg((F.count_if(F.expr(OK + " AND label = gold")) / F.count("*")).alias("acc"))
    return acc.select("model", F.round("acc", 6).alias("accuracy"), metrics.log_odds_weight(F.col("acc"), len(LABELS)).alias("weight"))


@query("""SELECT n, p, round(1.96 * sqrt(greatest(p * (1 - p), 1e-9) / n), 6) AS half_width
FROM (SELECT unnest([50, 100, 200, 400, 1000]) AS n), (SELECT CAST(unnest([0.6, 0.7, 0.8, 0.9]) AS double) AS p)""")
def ci_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (50, 100, 200, 400, 1000)])).alias("n"))
    t = n.select("n", F.explode(F.array(*[F.lit(x) for x in (0.6, 0.7, 0.8, 0.9)])).alias("p"))
    return t.withColumn("half_width", F.round(1.96 * F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-9)) / F.col("n")), 6))


@query("""WITH l AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE trim(text) <> '' GROUP BY quality)
SELECT lab.label, coalesce(l.n, 0) AS n, l.n IS NULL AS missing, coalesce(l.n, 0) < 30 AS scarce FROM (SELECT unnest([0, 1, 2]) AS label) lab LEFT JOIN l ON l.quality = lab.label""")
def train_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable labelled texts for each configured label, with what is missing or scarce."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").where(F.trim("text") != ""), "doc_id")
    n = rows.groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(0,), (1,), (2,)], "label int").join(n, "label", "left")
    return every.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"), (F.coalesce("n", F.lit(0)) < 30).alias("scarce"))


@query(f"""{FULL}, s AS (SELECT m.cnt, m.valid, m.label, gold FROM maj m JOIN gold USING (item_id))
SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE label = gold) AS double) / count(*), 6) AS majority_acc,
  round(CAST(count(*) FILTER (WHERE cnt = valid) AS double) / count(*), 6) AS consensus_rate,
  round(CAST(count(*) FILTER (WHERE cnt = valid AND label = gold) AS double) / count(*) FILTER (WHERE cnt = valid), 6) AS consensus_acc,
  round(CAST(count(*) FILTER (WHERE cnt < valid AND label = gold) AS double) / count(*) FILTER (WHERE cnt < valid), 6) AS split_acc FROM s""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = votes.majority(annotations(spark, sf_dir)).join(gold(spark, sf_dir), "item_id")
    n, right, one = F.count("*"), F.col("label") == F.col("gold"), F.col("cnt") == F.col("valid")
    return s.agg(
        n.alias("n"), rate(F.count_if(right), n).alias("majority_acc"), rate(F.count_if(one), n).alias("consensus_rate"),
        rate(F.count_if(one & right), F.count_if(one)).alias("consensus_acc"), rate(F.count_if(~one & right), F.count_if(~one)).alias("split_acc"),
    )


@query(f"""WITH {ANN_SQL}, {GOLD_SQL}, x AS (SELECT item_id, max(CASE WHEN model = 'm0' THEN label END) = max(gold) AS a, max(CASE WHEN model = 'm1' THEN label END) = max(gold) AS b
  FROM ann JOIN gold USING (item_id) WHERE {OK} AND model IN ('m0', 'm1') AND item_id < 2000 GROUP BY item_id HAVING count(*) = 2),
d AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only FROM x),
r AS (SELECT *, a_only + b_only AS m, least(a_only, b_only) AS k FROM d)
SELECT a_only, b_only, round(CASE WHEN m = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2.0))) FROM range(0, 1000000) t(i) WHERE i <= k)) END, 4) AS p FROM r""".replace(" AND item_id < 2000", ""))
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = votes.valid(annotations(spark, sf_dir)).where("model IN ('m0', 'm1')").join(gold(spark, sf_dir), "item_id")
    right = F.col("label") == F.col("gold")
    x = j.groupBy("item_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("model") == "m0", right)).alias("a"), F.max(F.when(F.col("model") == "m1", right)).alias("b")).where("n = 2")
    d = x.agg(F.count_if(F.expr("a AND NOT b")).alias("a_only"), F.count_if(F.expr("b AND NOT a")).alias("b_only"))
    return d.withColumn("p", F.round(metrics.mcnemar(F.col("a_only"), F.col("b_only")), 4))
