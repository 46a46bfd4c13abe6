"""Queries over stored runs, criteria versions and parameter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import votes
from ..sources import runs
from ..sources.shared import shared_dir
from ..sources.tables import ANN_SQL, annotations, table
from .evaluation import OK
from .evaluation import model_weights as weights
from .learning import calibration_fit
from .registry import ORACLE_SQL, query


@query(f"""WITH {ANN_SQL}, k AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run FROM ann WHERE model = 'm0')
SELECT run, CASE run WHEN 'even' THEN 'results' ELSE 'eval' END AS kind, count(*) AS n FROM k GROUP BY run""")
def run_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs are written and one deleted; what is found is counted."""
    root = shared_dir(spark, "runs")
    v = annotations(spark, sf_dir).where("model = 'm0'").select("item_id", "label")
    runs.write_run(v.where("item_id % 2 = 0"), root, "even")
    runs.write_run(v.where("item_id % 2 = 1"), root, "odd", "eval")
    runs.write_run(v, root, "gone")
    runs.delete_run(spark, root, "gone")
    found = runs.list_runs(spark, root).select("run", "kind")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").schema("item_id bigint").json(root).select(F.col("_metadata.file_path").alias("p"))
    n = rows.groupBy(F.regexp_extract("p", "/([^/]+)/[a-z]+\\.jsonl/", 1).alias("run")).agg(F.count("*").alias("n"))
    return found.join(n, "run")


@query("SELECT n_name AS run, concat('model ', n_name) AS model, n_regionkey AS samples, CAST(NULL AS varchar) AS api_key FROM nation WHERE n_nationkey < 3")
def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of runs are written without their keys and read back."""
    root = shared_dir(spark, "runs")
    for r in table(spark, sf_dir, "nation").where("n_nationkey < 3").select("n_name", "n_regionkey").collect():  # three runs
        runs.write_meta(spark, root, r["n_name"], {"models": [{"name": f"model {r['n_name']}", "api_key": "x"}], "jury": [{"api_key": "y"}], "samples": r["n_regionkey"]})
    m = runs.read_meta(spark, root, "run string, models array<struct<name: string, api_key: string>>, samples bigint").select("run", "models", "samples")
    return m.select("run", F.col("models")[0]["name"].alias("model"), "samples", F.col("models")[0]["api_key"].alias("api_key"))


@query(ORACLE_SQL["model_weights"])
def weights_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.saved(weights(spark, sf_dir), shared_dir(spark, "weights"))


@query()
def calibration_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.saved(calibration_fit(spark, sf_dir), shared_dir(spark, "calibration"))


_HASH = """left(sha256(concat('{"name":"', r_name, '","description":"d","labels":["A","N"],"rules":"', CASE WHEN r_regionkey % 2 = 0 THEN 'strict' ELSE 'loose' END, '"}')), 8)"""


@query(f"""WITH h AS (SELECT r_regionkey AS k, r_name, {_HASH} AS hash FROM region)
SELECT k AS run, hash, CASE WHEN k < 3 THEN concat('v', k) ELSE hash END AS version FROM h""")
def criteria_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria saved twice have one version; runs find theirs by hash, others keep the hash."""
    path = shared_dir(spark, "versions")
    rules = F.when(F.col("r_regionkey") % 2 == 0, "strict").otherwise("loose")
    c = table(spark, sf_dir, "region").withColumn("hash", runs.criteria_hash(F.col("r_name"), F.lit("d"), F.array(F.lit("A"), F.lit("N")), rules))
    for last, name in ((2, "v"), (3, "w")):
        runs.save_versions(c.where(F.col("r_regionkey") < last + (name == "v")).where("r_regionkey < 3").select("hash", F.concat(F.lit(name), F.col("r_regionkey").cast("string")).alias("version")), path)
    return runs.with_version(c.select(F.col("r_regionkey").alias("run"), "hash"), spark.read.parquet(path))


@query("""SELECT n_nationkey AS run, concat_ws(', ', CASE WHEN n_nationkey % 2 = 0 THEN 'm0 / m1' ELSE 'm0' END, CASE WHEN n_regionkey = 1 THEN 'similar examples' END,
  CASE WHEN n_nationkey % 3 = 0 THEN 'cascade of m0 + m2' END, CASE WHEN n_regionkey > 1 THEN concat(n_regionkey, ' samples each') END,
  CASE n_nationkey % 4 WHEN 0 THEN 'people settle disagreement' WHEN 1 THEN 'an arbiter settles disagreement' WHEN 2 THEN 'models review disagreement' END,
  CASE WHEN n_nationkey % 4 = 2 AND n_regionkey > 1 THEN concat('up to ', n_regionkey, ' rounds') END) AS strategy FROM nation""")
def run_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    models = F.when(k % 2 == 0, F.array(F.lit("m0"), F.lit("m1"))).otherwise(F.array(F.lit("m0")))
    cascade = F.when(k % 3 == 0, F.array(F.lit("m0"), F.lit("m2")))
    action = F.when(k % 4 == 0, "human").when(k % 4 == 1, "arbiter").when(k % 4 == 2, "review")
    return table(spark, sf_dir, "nation").select(k.alias("run"), runs.strategy(models, r == 1, cascade, r, action, r).alias("strategy"))


@query(f"""WITH {ANN_SQL}, c AS (SELECT item_id, label, count(*) AS n, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, sum(confidence) DESC, min(model_ord)) AS rk, count(*) OVER (PARTITION BY item_id) AS labels
  FROM ann WHERE {OK} GROUP BY item_id, label)
SELECT c.item_id, 'm1' AS advocate, c.label AS against, c.n AS backers FROM c WHERE rk = 1 AND labels > 1""")
def devils_advocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who argues against which label where models disagree: the arbiter, here none, else the first model that isn't local (m0 is)."""
    v = annotations(spark, sf_dir)
    split = votes.valid(v).groupBy("item_id").agg(F.count_distinct("label").alias("labels")).where("labels > 1").select("item_id")
    maj = votes.majority(v).select("item_id", F.col("label").alias("against")).join(split, "item_id", "left_semi")
    backers = votes.valid(v).groupBy("item_id", F.col("label").alias("against")).agg(F.count("*").alias("backers"))
    return maj.join(backers, ["item_id", "against"]).select("item_id", F.lit("m1").alias("advocate"), "against", "backers")
