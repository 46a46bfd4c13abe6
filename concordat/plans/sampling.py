"""Queries that choose rows: samples, splits, queues and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sampling, votes
from ..sources.tables import ANN_SQL, GOLD_SQL, annotations, gold, table
from .registry import query
from .routing import BASE, routed

OK = "error IS NULL AND label IS NOT NULL"


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY md5(concat('0|', CAST(doc_id AS varchar))), doc_id LIMIT 40")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "documents"), 40, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("""WITH r AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY md5(concat('1|', CAST(doc_id AS varchar))), doc_id) AS rn FROM labels)
SELECT doc_id, quality, CASE WHEN rn <= CASE WHEN n >= 2 THEN least(greatest(round_even(n * 0.66, 0), 1), n - 1) ELSE round_even(n * 0.66, 0) END THEN 'dev' ELSE 'test' END AS part FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "labels"), 0.66, "doc_id", "quality", 1).select("doc_id", "quality", "part")


@query("""WITH c AS (SELECT lang, count(*) AS have, count(*) * CAST(100 AS double) / (SELECT count(*) FROM documents) AS exact FROM documents GROUP BY lang),
a AS (SELECT lang, have, CAST(floor(exact) AS bigint) AS size, 100 - sum(CAST(floor(exact) AS bigint)) OVER () AS left_, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, lang) AS rk FROM c),
s AS (SELECT lang, least(have, size + CASE WHEN rk <= left_ THEN 1 ELSE 0 END) AS size FROM a)
SELECT d.doc_id, d.lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('2|', CAST(doc_id AS varchar))), doc_id) AS rn FROM documents) d JOIN s USING (lang) WHERE rn <= size""")
def stratified_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.take(table(spark, sf_dir, "documents"), 100, "doc_id", "lang", 2).select("doc_id", "lang")


@query("""SELECT doc_id, lang, CASE WHEN length(t) > 150 THEN concat(left(t, 150), '…') ELSE t END AS clipped FROM (
  SELECT doc_id, lang, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('0|', CAST(doc_id AS varchar))), doc_id) AS rn FROM documents) WHERE rn <= 25""")
def per_label_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import clip

    return sampling.per_label(table(spark, sf_dir, "documents"), 25, "doc_id", "lang").select("doc_id", "lang", clip(F.col("text"), 150).alias("clipped"))


_UNC = f"""t AS (SELECT item_id, max(c) AS top, CAST(sum(c) AS bigint) AS n, sum(s) AS s FROM (SELECT item_id, label, count(*) AS c, sum(confidence) AS s FROM ann WHERE {OK} GROUP BY item_id, label) GROUP BY item_id),
unc AS (SELECT i.item_id, CASE WHEN coalesce(n, 0) < 2 THEN 1.0 ELSE round((1 - CAST(top AS double) / n) * 0.65 + (1 - s / n) * 0.35, 4) END AS score FROM (SELECT DISTINCT item_id FROM ann) i LEFT JOIN t USING (item_id))"""


@query(f"WITH {ANN_SQL}, {_UNC} SELECT item_id, score FROM unc")
def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    ann = annotations(spark, sf_dir)
    return sampling.uncertainty(votes.valid(ann), ann)


@query(f"""{BASE}, {_UNC}, d AS (SELECT item_id, count(DISTINCT label) > 1 AS split FROM ann WHERE {OK} GROUP BY item_id),
j AS (SELECT r.item_id, r.label IS DISTINCT FROM gold AS wrong, row_number() OVER (ORDER BY coalesce(split, false) DESC, score DESC, CAST(r.item_id AS varchar)) AS rk FROM routed r JOIN gold USING (item_id) JOIN unc USING (item_id) LEFT JOIN d USING (item_id))
SELECT k, count(*) FILTER (WHERE wrong AND rk <= k) AS hits, count(*) FILTER (WHERE wrong) AS errors,
  round(CAST(count(*) FILTER (WHERE wrong AND rk <= k) AS double) / count(*) FILTER (WHERE wrong), 4) AS recall, round(CAST(k * count(*) FILTER (WHERE wrong) AS double) / count(*), 2) AS by_chance
FROM j, (SELECT unnest([10, 20, 30, 50]) AS k) GROUP BY k""")
def audit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors found among the first k items of the audit order; only the 50 first are ranked."""
    ann = annotations(spark, sf_dir)
    v = votes.valid(ann)
    split = v.groupBy("item_id").agg((F.count_distinct("label") > 1).alias("split"))
    j = routed(spark, sf_dir).join(gold(spark, sf_dir), "item_id").join(sampling.uncertainty(v, ann), "item_id").join(split, "item_id", "left")
    j = j.select("item_id", (~F.col("label").eqNullSafe(F.col("gold"))).alias("wrong"), "score", F.coalesce("split", F.lit(False)).alias("split"))
    top = j.orderBy(F.desc("split"), F.desc("score"), F.col("item_id").cast("string")).limit(50)
    top = top.withColumn("rk", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("split"), F.desc("score"), F.col("item_id").cast("string"))))
    top = top.withColumn("k", F.explode(F.array(*[F.lit(x) for x in (10, 20, 30, 50)]))).where("rk <= k")
    hits = top.groupBy("k").agg(F.count_if("wrong").alias("hits"))
    all_ = j.agg(F.count_if("wrong").alias("errors"), F.count("*").alias("n"))
    return hits.crossJoin(all_).select("k", "hits", "errors", F.round(F.col("hits") / F.col("errors"), 4).alias("recall"), F.round(F.col("k") * F.col("errors") / F.col("n"), 2).alias("by_chance"))


@query(f"""WITH {ANN_SQL}, {GOLD_SQL}, t AS (SELECT item_id, gold, label, count(*) AS agree, sum(confidence) AS s, min(model_ord) AS o FROM ann JOIN gold USING (item_id) WHERE {OK} GROUP BY ALL),
u AS (SELECT *, CAST(sum(agree) OVER (PARTITION BY item_id) AS bigint) AS n, s / agree AS mean FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY agree DESC, mean DESC, o) AS rk FROM u WHERE label <> gold)
SELECT item_id, gold, label AS suspect, agree, n, round(mean, 3) AS mean_conf, round(CAST(agree AS double) / n * mean, 3) AS score FROM w WHERE rk = 1 AND agree >= 2 AND mean >= 0.5""")
def noise_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.suspects(votes.valid(annotations(spark, sf_dir)), gold(spark, sf_dir), min_conf=0.5)


@query(f"""{BASE}, {_UNC}, x AS (SELECT item_id, count(DISTINCT CASE WHEN error IS NULL THEN label END) > 1 OR count(*) FILTER (WHERE error IS NOT NULL OR label IS NULL) > 0 AS dis FROM ann GROUP BY item_id),
spot AS (SELECT item_id FROM routed WHERE status = 'consensus' ORDER BY md5(concat('0|', CAST(item_id AS varchar))), item_id LIMIT 30)
SELECT 'need_human' AS scope, item_id, CAST(NULL AS double) AS score FROM routed WHERE status = 'need_human' UNION ALL SELECT 'disagree', item_id, NULL FROM x WHERE dis UNION ALL SELECT 'spot', item_id, NULL FROM spot
UNION ALL SELECT 'active', item_id, score FROM unc UNION ALL SELECT 'all', item_id, NULL FROM routed""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by scope of review; the active scope's order is by falling score, then by id as text."""
    r, ann = routed(spark, sf_dir), annotations(spark, sf_dir)
    one = lambda df, scope: df.select(F.lit(scope).alias("scope"), "item_id", F.lit(None).cast("double").alias("score"))
    out = one(r.where("status = 'need_human'"), "need_human").unionByName(one(votes.disagreement(ann).where("disagree"), "disagree"))
    out = out.unionByName(one(sampling.sample(r.where("status = 'consensus'"), 30, "item_id"), "spot")).unionByName(one(r, "all"))
    return out.unionByName(sampling.uncertainty(votes.valid(ann), ann).select(F.lit("active").alias("scope"), "item_id", "score"))


@query(f"""WITH {ANN_SQL}, t AS (SELECT i.item_id, count(v.label) AS n, count(DISTINCT v.label) AS k, CAST(round(avg(v.confidence) * 100) AS int) AS pct
FROM (SELECT DISTINCT item_id FROM ann) i LEFT JOIN (SELECT * FROM ann WHERE {OK}) v USING (item_id) GROUP BY i.item_id)
SELECT item_id, CASE WHEN n < 2 THEN 'fewer than 2 valid answers' WHEN k > 1 THEN concat(n, ' models gave ', k, ' labels, mean confidence ', pct, '%') ELSE concat('models agree, mean confidence ', pct, '%') END AS reason FROM t""")
def queue_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ann = annotations(spark, sf_dir)
    return sampling.reasons(votes.valid(ann), ann)


@query(f"""WITH {ANN_SQL}, p AS (SELECT item_id, string_agg(DISTINCT label, '|' ORDER BY label) AS pair, count(DISTINCT label) AS n FROM ann WHERE {OK} GROUP BY item_id),
r AS (SELECT item_id, pair, row_number() OVER (PARTITION BY pair ORDER BY item_id) AS rn, min(item_id) OVER (PARTITION BY pair) AS seen FROM p WHERE n > 1)
SELECT item_id, pair, rn AS pass FROM r ORDER BY rn, seen LIMIT 20""")
def disagreement_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin over the sets of labels that items disagree on; no set gives more rows than the limit."""
    p = votes.valid(annotations(spark, sf_dir)).groupBy("item_id").agg(F.array_sort(F.collect_set("label")).alias("l")).where(F.size("l") > 1)
    p = p.select("item_id", F.array_join("l", "|").alias("pair"))
    first = p.groupBy("pair").agg(F.min("item_id").alias("seen"))  # one row a set of labels
    r = p.withColumn("pass", F.row_number().over(Window.partitionBy("pair").orderBy("item_id"))).where("pass <= 20")
    return r.join(F.broadcast(first), "pair").orderBy("pass", "seen").limit(20).select("item_id", "pair", "pass")


@query("SELECT doc_id, lang FROM documents WHERE trim(text) <> '' ORDER BY doc_id LIMIT 25")
def limit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.trim("text") != "").orderBy("doc_id").limit(25).select("doc_id", "lang")


@query("""SELECT l_suppkey % 10 AS variant, round(avg(CASE WHEN l_returnflag = 'A' THEN CAST(1 AS double) ELSE 0 END), 6) AS dev_acc FROM lineitem GROUP BY 1 ORDER BY round(avg(CASE WHEN l_returnflag = 'A' THEN CAST(1 AS double) ELSE 0 END), 6) DESC, 1 LIMIT 1""")
def pick_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant of the best dev accuracy, the first of equal ones."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("variant")).agg(F.round(F.avg((F.col("l_returnflag") == "A").cast("double")), 6).alias("dev_acc"))
    return t.orderBy(F.desc("dev_acc"), "variant").limit(1)
