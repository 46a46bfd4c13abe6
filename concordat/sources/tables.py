"""Views of the driver's tables as annotation data.

``annotations``: one vote per item (order) and model (supplier modulo 4), from ``lineitem``. Some votes failed (error
set, label null), some were checked for evidence (null: not asked). ``label2`` is the vote after a review round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ["A", "N", "R"]
MODELS = ["m0", "m1", "m2", "m3"]
#: Weights that are exact in binary, so that sums are equal in any order.
WEIGHTS = {"m0": 1.5, "m1": 1.0, "m2": 0.75}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT_PARTS = 8  # shuffle partitions for each split of a scan (at most 128 MB of files, some 4 million votes)


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key``, over more partitions as the table grows, so that a task's part doesn't."""
    n = SPLIT_PARTS * rows.rdd.getNumPartitions()
    return rows.repartition(n, key) if n >= 64 else rows.repartition(key)  # Spark merges small parts only of the latter


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, model, model_ord, label, confidence, error, evidence_ok, label2, out_tokens.

    Votes are dealt by item, so whatever is counted by item afterwards needs no further shuffle.
    """
    w = Window.partitionBy("l_orderkey", F.col("l_suppkey") % 4).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    failed = F.col("l_linenumber") == 5
    part = F.col("l_partkey") % 3
    return (
        by_key(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(
            F.col("l_orderkey").alias("item_id"),
            F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model"),
            (F.col("l_suppkey") % 4).cast("int").alias("model_ord"),
            F.when(~failed, F.col("l_returnflag")).alias("label"),
            (F.col("l_quantity") / 64.0).alias("confidence"),
            F.when(failed, F.lit("timeout")).alias("error"),
            F.when(part == 0, False).when(part == 1, True).alias("evidence_ok"),
            F.when(F.col("l_partkey") % 7 == 0, None).when(F.col("l_partkey") % 5 == 0, "A").when(F.col("l_partkey") % 5 == 1, "N").otherwise(F.col("l_returnflag")).alias("label2"),
            F.col("l_quantity").cast("int").alias("out_tokens"),
        )
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, gold: the order's status as a label."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(s == "F", "A").when(s == "O", "N").otherwise("R").alias("gold"))


#: The same views as common table expressions.
ANN_SQL = """
ann AS (
  SELECT l_orderkey AS item_id, concat('m', CAST(l_suppkey % 4 AS varchar)) AS model, CAST(l_suppkey % 4 AS int) AS model_ord,
    CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS label, l_quantity / 64.0 AS confidence,
    CASE WHEN l_linenumber = 5 THEN 'timeout' END AS error,
    CASE l_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS evidence_ok,
    CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'A' WHEN l_partkey % 5 = 1 THEN 'N' ELSE l_returnflag END AS label2,
    CAST(l_quantity AS int) AS out_tokens
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)"""
GOLD_SQL = """
gold AS (SELECT o_orderkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS gold FROM orders)"""
WEIGHT_SQL = "CASE model WHEN 'm0' THEN 1.5 WHEN 'm1' THEN 1.0 WHEN 'm2' THEN 0.75 ELSE 1.0 END"
#: Majority of valid votes: most votes, then most confidence, then first model.
MAJORITY_SQL = """
maj AS (SELECT item_id, label, cnt, conf, valid FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cnt DESC, conf DESC, first_ord) AS rk,
    CAST(sum(cnt) OVER (PARTITION BY item_id) AS bigint) AS valid
  FROM (SELECT item_id, label, count(*) AS cnt, sum(confidence) AS conf, min(model_ord) AS first_ord
        FROM ann WHERE label IS NOT NULL AND error IS NULL GROUP BY item_id, label)) WHERE rk = 1)"""
#: Weighted vote with an evidence penalty of one half.
WEIGHTED_SQL = f"""
wv AS (SELECT item_id, label, score / total AS share, cnt AS agree, valid AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first_ord) AS rk,
    sum(score) OVER (PARTITION BY item_id) AS total, CAST(sum(cnt) OVER (PARTITION BY item_id) AS bigint) AS valid
  FROM (SELECT item_id, label, count(*) AS cnt, min(model_ord) AS first_ord,
          sum(CAST({WEIGHT_SQL} AS double) * greatest(confidence, 0.05) * CASE WHEN evidence_ok = false THEN 0.5 ELSE 1.0 END) AS score
        FROM ann WHERE label IS NOT NULL AND error IS NULL GROUP BY item_id, label)) WHERE rk = 1)"""
