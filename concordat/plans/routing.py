"""Queries over routing decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing, votes
from ..operators.routing import RoutingPolicy
from ..sources.tables import ANN_SQL, GOLD_SQL, WEIGHTED_SQL, WEIGHTS, annotations, gold, table
from .registry import query

UNANIMITY_SQL = """
una AS (SELECT item_id, count(*) FILTER (WHERE error IS NULL AND label IS NOT NULL) AS valid,
  count(DISTINCT CASE WHEN error IS NULL THEN label END) AS n_labels, min(CASE WHEN error IS NULL THEN label END) AS first_label,
  avg(CASE WHEN error IS NULL AND label IS NOT NULL THEN confidence END) AS mean_conf FROM ann GROUP BY item_id)"""
ACCEPT = "coalesce(total >= 2 AND agree * 2 > total AND share >= 0.6, false)"
ROUTE_SQL = f"""
routed AS (SELECT u.item_id,
  CASE WHEN valid >= 2 AND n_labels = 1 THEN first_label ELSE w.label END AS label,
  CASE WHEN valid >= 2 AND n_labels = 1 THEN 'consensus' WHEN {ACCEPT} THEN 'majority' ELSE 'need_human' END AS status,
  CASE WHEN valid >= 2 AND n_labels = 1 THEN mean_conf ELSE coalesce(share, 0.0) END AS confidence
  FROM una u LEFT JOIN wv w ON u.item_id = w.item_id)"""
BASE = f"WITH {ANN_SQL}, {GOLD_SQL}, {WEIGHTED_SQL}, {UNANIMITY_SQL}, {ROUTE_SQL}"


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(annotations(spark, sf_dir), WEIGHTS, RoutingPolicy())


@query(f"{BASE} SELECT item_id, label, status, round(confidence, 6) AS confidence FROM routed")
def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(f"""{BASE} SELECT status, count(*) AS n, count(*) FILTER (WHERE label = gold) AS right_,
  round(CAST(count(*) FILTER (WHERE label = gold) AS double) / count(*), 6) AS accuracy FROM routed JOIN gold USING (item_id) GROUP BY status""")
def eval_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = routed(spark, sf_dir).join(gold(spark, sf_dir), "item_id")
    right = F.count_if(F.col("label") == F.col("gold"))
    return j.groupBy("status").agg(F.count("*").alias("n"), right.alias("right_"), F.round(right / F.count("*"), 6).alias("accuracy"))


@query(f"""WITH {ANN_SQL},
t1 AS (SELECT item_id, count(*) AS asked, count(*) FILTER (WHERE error IS NULL AND label IS NOT NULL) AS valid,
  count(DISTINCT CASE WHEN error IS NULL THEN label END) AS n, min(label) AS label, min(confidence) AS least, avg(confidence) AS mean_conf
  FROM ann WHERE model IN ('m0', 'm1') GROUP BY item_id),
done AS (SELECT * FROM t1 WHERE asked = 2 AND valid = 2 AND n = 1 AND least >= 0.2),
ann2 AS (SELECT * FROM ann WHERE item_id NOT IN (SELECT item_id FROM done)),
{WEIGHTED_SQL.replace("FROM ann ", "FROM ann2 ")}, {UNANIMITY_SQL.replace("FROM ann ", "FROM ann2 ")}, {ROUTE_SQL},
calls AS (SELECT item_id, count(*) AS calls FROM ann2 GROUP BY item_id)
SELECT item_id, label, 'consensus' AS status, round(mean_conf, 3) AS confidence, 1 AS tier, asked AS calls FROM done
UNION ALL SELECT item_id, label, status, round(confidence, 6), 2, calls FROM routed JOIN calls USING (item_id)""")
def cascade_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = RoutingPolicy(cascade=("m0", "m1"), cascade_min_confidence=0.2)
    return routing.cascade(annotations(spark, sf_dir), WEIGHTS, policy).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {ANN_SQL}, {WEIGHTED_SQL}, {UNANIMITY_SQL}
SELECT item_id, label, round(share, 6) AS prob,
  CASE WHEN share >= 0.55 AND valid >= 2 AND n_labels = 1 THEN 'consensus' WHEN share >= 0.55 THEN 'majority' ELSE 'need_human' END AS status,
  (valid >= 2 AND n_labels = 1 AND NOT share >= 0.55) AS skip_review FROM una JOIN wv USING (item_id)""")
def posterior_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ann = annotations(spark, sf_dir)
    voted = votes.weighted(ann, WEIGHTS).select("item_id", "label", F.col("share").alias("prob"))
    return routing.gate(routing.unanimity(ann), voted, RoutingPolicy(min_posterior=0.55)).withColumn("prob", F.round("prob", 6))


_ARBITER_SQL = """
arb AS (SELECT o_orderkey AS item_id, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS arb_label, (o_orderkey % 16) / 16.0 AS arb_conf FROM orders)"""


@query(f"""WITH {ANN_SQL}, {WEIGHTED_SQL}, {UNANIMITY_SQL}, {_ARBITER_SQL}
SELECT u.item_id,
  CASE WHEN valid >= 2 AND n_labels = 1 THEN first_label WHEN arb_label IS NOT NULL AND arb_conf >= 0.7 THEN arb_label ELSE coalesce(arb_label, w.label) END AS label,
  CASE WHEN valid >= 2 AND n_labels = 1 THEN 'consensus' WHEN arb_label IS NOT NULL AND arb_conf >= 0.7 THEN 'arbitrated' ELSE 'need_human' END AS status,
  round(CASE WHEN valid >= 2 AND n_labels = 1 THEN mean_conf WHEN arb_label IS NOT NULL AND arb_conf >= 0.7 THEN arb_conf ELSE coalesce(share, 0.0) END, 6) AS confidence
FROM una u LEFT JOIN wv w ON u.item_id = w.item_id LEFT JOIN arb a ON u.item_id = a.item_id""")
def arbitrate_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 4
    arbiter = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.when(k == 0, "A").when(k == 1, "N").when(k == 2, "R").alias("arb_label"), ((F.col("o_orderkey") % 16) / 16.0).alias("arb_conf")
    )
    return routing.route(annotations(spark, sf_dir), WEIGHTS, RoutingPolicy(action="arbiter"), arbiter).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {ANN_SQL}
SELECT item_id, min(CASE label WHEN 'R' THEN 'closed' ELSE 'open' END) AS parent, count(DISTINCT label) AS children FROM ann
WHERE error IS NULL AND label IS NOT NULL GROUP BY item_id
HAVING count(DISTINCT CASE label WHEN 'R' THEN 'closed' ELSE 'open' END) = 1 AND count(DISTINCT label) > 1""")
def level1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose votes share the parent label but not the child."""
    full = F.when(F.col("label") == "R", "closed/R").otherwise(F.concat(F.lit("open/"), F.col("label")))
    v = votes.valid(annotations(spark, sf_dir)).withColumn("label", full).withColumn("parent", F.substring_index("label", "/", 1))
    t = v.groupBy("item_id").agg(F.min("parent").alias("parent"), F.count_distinct("parent").alias("p"), F.count_distinct("label").alias("children"))
    return t.where("p = 1 AND children > 1").drop("p")


_MERGED_SQL = "(SELECT item_id, model, model_ord, coalesce(label2, label) AS label, confidence, CASE WHEN label2 IS NULL THEN error END AS error, evidence_ok FROM ann)"


@query(f"""WITH {ANN_SQL}, r2 AS {_MERGED_SQL}
SELECT item_id, model, label, error FROM r2""")
def round2_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.merge_rounds(annotations(spark, sf_dir)).select("item_id", "model", "label", "error")


_STATE = "SELECT item_id, count(*) FILTER (WHERE error IS NULL AND label IS NOT NULL) >= 2 AND count(DISTINCT CASE WHEN error IS NULL THEN label END) = 1 AS done FROM {} GROUP BY item_id"
_STEP = """SELECT v.item_id, v.model, CASE WHEN NOT done AND {r} IS NOT NULL THEN {r} ELSE label END AS label,
  CASE WHEN NOT done AND {r} IS NOT NULL THEN NULL ELSE error END AS error, label2, label3, rounds + CASE WHEN done THEN 0 ELSE 1 END AS rounds
  FROM {v} v JOIN {s} s ON v.item_id = s.item_id"""


@query(f"""WITH {ANN_SQL},
r0 AS (SELECT item_id, model, label, error, label2, CASE WHEN model_ord = 0 THEN NULL ELSE first_value(label) OVER (PARTITION BY item_id ORDER BY model_ord) END AS label3, 0 AS rounds FROM ann),
s0 AS ({_STATE.format("r0")}), r1 AS ({_STEP.format(r="label2", v="r0", s="s0")}),
s1 AS ({_STATE.format("r1")}), r2 AS ({_STEP.format(r="label3", v="r1", s="s1")})
SELECT item_id, max(rounds) AS rounds, count(*) FILTER (WHERE error IS NULL AND label IS NOT NULL) AS valid,
  count(DISTINCT CASE WHEN error IS NULL THEN label END) AS n_labels FROM r2 GROUP BY item_id""")
def debate_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.first("label").over(Window.partitionBy("item_id").orderBy("model_ord"))
    ann = annotations(spark, sf_dir).withColumn("label3", F.when(F.col("model_ord") != 0, first))
    return routing.debate(ann, ["label2", "label3"])
