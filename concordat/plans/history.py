"""Queries over runs, reviews, caches and example tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge, metrics, votes
from ..operators.metrics import rate
from ..sources.tables import ANN_SQL, annotations, gold, table
from .registry import query
from .routing import BASE, routed

OK = "error IS NULL AND label IS NOT NULL"
REVIEW_SQL = "rev AS (SELECT o_orderkey AS item_id, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS human FROM orders WHERE o_orderkey % 7 = 0)"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    return table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("item_id"), F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("human"))


@query(f"{BASE} SELECT item_id, label, gold FROM routed JOIN gold USING (item_id)")
def gold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).join(gold(spark, sf_dir), "item_id").select("item_id", "label", "gold")


@query(f"{BASE}, {REVIEW_SQL} SELECT item_id, r.label AS machine_label, status, coalesce(human, '') AS human_label, coalesce(human, r.label) AS final_label, CASE WHEN human IS NULL THEN 'model' ELSE 'human' END AS source FROM routed r LEFT JOIN rev USING (item_id)")
def merged_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = routed(spark, sf_dir).join(reviews(spark, sf_dir), "item_id", "left")
    return j.select("item_id", F.col("label").alias("machine_label"), "status", F.coalesce("human", F.lit("")).alias("human_label"), F.coalesce("human", "label").alias("final_label"), F.when(F.col("human").isNull(), "model").otherwise("human").alias("source"))


@query(f"""{BASE}, {REVIEW_SQL} SELECT status, count(*) AS n, count(*) FILTER (WHERE r.label = human) AS agree, count(*) FILTER (WHERE r.label IS DISTINCT FROM human) AS changed,
  round(CAST(count(*) FILTER (WHERE r.label = human) AS double) / count(*), 6) AS agreement FROM routed r JOIN rev USING (item_id) GROUP BY status""")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = routed(spark, sf_dir).join(reviews(spark, sf_dir), "item_id")
    same = F.coalesce(F.col("label") == F.col("human"), F.lit(False))
    return j.groupBy("status").agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.count_if(~same).alias("changed"), rate(F.count_if(same), F.count("*")).alias("agreement"))


@query("""WITH done AS (SELECT o_orderkey AS item_id, max_by(o_orderpriority, o_orderdate) AS state FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_orderkey)
SELECT o_orderkey AS item_id, coalesce(state, 'todo') AS state FROM orders LEFT JOIN done ON item_id = o_orderkey""")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resumed run: finished items from the checkpoint, the others (an anti-join) to do, in one table."""
    o = table(spark, sf_dir, "orders")
    done = o.where("o_custkey % 3 = 0").groupBy(F.col("o_orderkey").alias("item_id")).agg(F.max_by("o_orderpriority", "o_orderdate").alias("state"))
    items = o.select(F.col("o_orderkey").alias("item_id"))
    todo = items.join(done, "item_id", "left_anti").withColumn("state", F.lit("todo"))
    return done.unionByName(todo)


_KEY = "sha256(concat_ws(chr(31), 'p', model, CAST(item_id AS varchar)))"


@query(f"""WITH {ANN_SQL}, k AS (SELECT model, out_tokens, {_KEY} AS key FROM ann), cache AS (SELECT DISTINCT key FROM k WHERE substr(key, 1, 1) < '8')
SELECT model, count(*) AS calls, count(c.key) AS hits, CAST(sum(CASE WHEN c.key IS NULL THEN out_tokens ELSE 0 END) AS bigint) AS paid_tokens, CAST(sum(CASE WHEN c.key IS NOT NULL THEN out_tokens ELSE 0 END) AS bigint) AS saved_tokens
FROM k LEFT JOIN cache c USING (key) GROUP BY model""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls answered from the reply cache, by a join on the hash of what would be asked."""
    k = annotations(spark, sf_dir).withColumn("key", T.chain_hash(F.lit("p"), F.col("model"), F.col("item_id").cast("string"))).select("model", "out_tokens", "key")
    cache = k.where(F.substring("key", 1, 1) < "8").select("key").distinct().withColumn("hit", F.lit(True))
    j = k.join(cache, "key", "left")
    return j.groupBy("model").agg(
        F.count("*").alias("calls"), F.count("hit").alias("hits"), F.sum(F.when(F.col("hit").isNull(), F.col("out_tokens")).otherwise(0)).alias("paid_tokens"), F.sum(F.when(F.col("hit"), F.col("out_tokens")).otherwise(0)).alias("saved_tokens")
    )


@query("""SELECT sha256(t) AS h, min(doc_id) AS first_id FROM (SELECT trim(text) AS t, doc_id FROM documents) d WHERE t NOT IN (SELECT trim(text) FROM documents WHERE doc_id % 4 = 0) GROUP BY t""")
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts without a cached vector."""
    d = table(spark, sf_dir, "documents").select(F.sha2(F.trim("text"), 256).alias("h"), "doc_id")
    cached = d.where("doc_id % 4 = 0").select("h").distinct()
    return d.join(cached, "h", "left_anti").groupBy("h").agg(F.min("doc_id").alias("first_id"))


_WEEK = "CAST(date_diff('day', DATE '1970-01-05', CAST(ts AS date)) // 7 AS int)"
_RUNS_SQL = f"""runs AS (SELECT {_WEEK} AS run, event_type AS label, user_id, value FROM events),
rs AS (SELECT run, count(*) AS n, round(CAST(count(*) FILTER (WHERE value < 20) AS double) / count(*), 6) AS human_rate, round(avg(CASE WHEN event_type_ok THEN CAST(1 AS double) ELSE 0 END), 6) AS acc FROM (SELECT run, value, user_id % 3 > 0 AS event_type_ok FROM runs) GROUP BY run)"""


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as runs, one a week."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-05")) / 7).cast("int")
    return table(spark, sf_dir, "events").select(week.alias("run"), F.col("event_type").alias("label"), "user_id", "value")


@query(f"WITH {_RUNS_SQL} SELECT run, label, count(*) AS n, round(CAST(count(*) AS double) / CAST(sum(count(*)) OVER (PARTITION BY run) AS double), 6) AS share FROM runs GROUP BY run, label")
def label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shares(weekly(spark, sf_dir), "label", "run")


_TV = f"""{_RUNS_SQL}, sh AS (SELECT run, label, CAST(count(*) AS double) / CAST(sum(count(*)) OVER (PARTITION BY run) AS double) AS share FROM runs GROUP BY run, label),
tv AS (SELECT run, round(sum(d) / 2, 6) AS tv FROM (SELECT coalesce(a.run, b.run + 1) AS run, abs(coalesce(a.share, 0) - coalesce(b.share, 0)) AS d FROM sh a FULL JOIN sh b ON a.run = b.run + 1 AND a.label = b.label) WHERE run IN (SELECT run + 1 FROM runs) AND run IN (SELECT run FROM runs) GROUP BY run)"""


@query(f"WITH {_TV} SELECT run, tv FROM tv")
def tv_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation between the label shares of a run and the one before."""
    sh = weekly(spark, sf_dir).groupBy("run", "label").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("run")))
    d = sh.select("run", "label", F.col("share").alias("v")).unionByName(sh.select(F.col("run") + 1, "label", -F.col("share")).toDF("run", "label", "v"))
    known = sh.select("run").distinct()
    t = d.groupBy("run", "label").agg(F.sum("v").alias("v")).groupBy("run").agg(F.round(F.sum(F.abs("v")) / 2, 6).alias("tv"))
    return t.join(known, "run", "left_semi").join(known.select((F.col("run") + 1).alias("run")), "run", "left_semi")


@query(f"""WITH {_TV}, l AS (SELECT run, human_rate, round(1 - human_rate, 6) AS auto_rate, acc, md5(CAST(run // 3 AS varchar)) AS criteria, lag(human_rate) OVER (ORDER BY run) AS ph, lag(acc) OVER (ORDER BY run) AS pa, lag(run) OVER (ORDER BY run) AS pr FROM rs)
SELECT run, human_rate, auto_rate, acc, round(human_rate - ph, 6) >= 0.08 AS human_up, round(human_rate - ph, 6) >= 0.10 AS auto_down, round(pa - acc, 6) >= 0.05 AS acc_down, tv >= 0.15 AS labels_moved, criteria = md5(CAST(pr // 3 AS varchar)) AS same_criteria FROM l JOIN tv USING (run)""")
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the one before; the criteria change every third week, and then moves may come from them."""
    r = weekly(spark, sf_dir).groupBy("run").agg(rate(F.count_if(F.col("value") < 20), F.count("*")).alias("human_rate"), F.round(F.avg((F.col("user_id") % 3 > 0).cast("double")), 6).alias("acc"))
    r = r.withColumn("auto_rate", F.round(1 - F.col("human_rate"), 6)).withColumn("criteria", F.md5(F.floor(F.col("run") / 3).cast("string")))
    return metrics.drift(r.join(tv_distance(spark, sf_dir), "run", "left")).where("tv IS NOT NULL").select("run", "human_rate", "auto_rate", "acc", "human_up", "auto_down", "acc_down", "labels_moved", "same_criteria")


@query(f"""WITH {ANN_SQL}, v AS (SELECT item_id, model, label FROM ann WHERE {OK}), c AS (SELECT item_id FROM v GROUP BY item_id HAVING count(DISTINCT model) = 4)
SELECT item_id, max(label) FILTER (WHERE model = 'm0') AS m0, max(label) FILTER (WHERE model = 'm1') AS m1, max(label) FILTER (WHERE model = 'm2') AS m2, max(label) FILTER (WHERE model = 'm3') AS m3 FROM v WHERE item_id IN (SELECT item_id FROM c) GROUP BY item_id""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that every run has, one column a run: one aggregation instead of a join per run."""
    names = [f"m{i}" for i in range(4)]
    g = votes.valid(annotations(spark, sf_dir)).groupBy("item_id").agg(F.count_distinct("model").alias("n"), *[F.max(F.when(F.col("model") == m, F.col("label"))).alias(m) for m in names])
    return g.where("n = 4").drop("n")


@query(f"""{BASE}, pr AS (SELECT item_id, model, (40 + item_id % 50) * 0.5 + out_tokens AS units, label2, CASE model WHEN 'm0' THEN 2.0 WHEN 'm1' THEN 4.0 WHEN 'm2' THEN 8.0 ELSE 0.0 END AS price FROM ann),
c AS (SELECT item_id, count(*) FILTER (WHERE model <> 'm3') AS c1, count(*) FILTER (WHERE model <> 'm3' AND label2 IS NOT NULL) AS c2, CAST(sum(units * price) AS double) / 1e6 AS k1, CAST(coalesce(sum(units * price) FILTER (WHERE label2 IS NOT NULL), 0) AS double) / 1e6 AS k2 FROM pr GROUP BY item_id),
j AS (SELECT r.item_id, r.status, r.label, gold, status <> 'need_human' AS auto, c1 + CASE WHEN status <> 'consensus' THEN c2 ELSE 0 END AS calls, k1 + CASE WHEN status <> 'consensus' THEN k2 ELSE 0 END AS cost FROM routed r JOIN c USING (item_id) LEFT JOIN gold USING (item_id))
SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE auto) AS double) / count(*), 6) AS auto_rate, count(*) FILTER (WHERE NOT auto) AS human, CAST(sum(calls) AS bigint) AS llm_calls,
  round(CAST(sum(calls) AS double) / count(*), 6) AS calls_per_item, round(sum(cost), 6) AS cost, count(gold) AS gold_n, round(CAST(count(*) FILTER (WHERE label = gold) AS double) / count(gold), 6) AS acc,
  round(CAST(count(*) FILTER (WHERE auto AND label = gold) AS double) / count(*) FILTER (WHERE auto AND gold IS NOT NULL), 6) AS auto_acc,
  round(CAST(count(*) FILTER (WHERE gold IS NOT NULL AND (NOT auto OR label = gold)) AS double) / count(gold), 6) AS with_human FROM j""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's totals: calls, cost and accuracy. m3 is local and costs nothing; reviews happen where the first round disagrees."""
    ann = annotations(spark, sf_dir)
    spent = ((40 + F.col("item_id") % 50) * 0.5 + F.col("out_tokens")) * _price(F.col("model")) / 1e6
    paid = F.col("model") != "m3"
    c = ann.groupBy("item_id").agg(
        F.count_if(paid).alias("c1"), F.count_if(paid & F.col("label2").isNotNull()).alias("c2"), F.sum(spent).alias("k1"), F.sum(F.when(F.col("label2").isNotNull(), spent).otherwise(0.0)).alias("k2")
    )
    j = routed(spark, sf_dir).join(c, "item_id", "left").join(gold(spark, sf_dir), "item_id", "left")
    again = F.col("status") != "consensus"
    j = j.withColumn("calls", F.col("c1") + F.when(again, F.col("c2")).otherwise(0)).withColumn("spent", F.col("k1") + F.when(again, F.col("k2")).otherwise(0.0))
    auto, right, known = F.col("status") != "need_human", F.col("label") == F.col("gold"), F.col("gold").isNotNull()
    return j.agg(
        F.count("*").alias("n"), rate(F.count_if(auto), F.count("*")).alias("auto_rate"), F.count_if(~auto).alias("human"), F.sum("calls").alias("llm_calls"), rate(F.sum("calls"), F.count("*")).alias("calls_per_item"),
        F.round(F.sum("spent"), 6).alias("cost"), F.count("gold").alias("gold_n"), rate(F.count_if(right), F.count("gold")).alias("acc"),
        rate(F.count_if(auto & right), F.count_if(auto & known)).alias("auto_acc"), rate(F.count_if(known & (~auto | right)), F.count("gold")).alias("with_human"),
    )


_EX_SQL = "ex AS (SELECT doc_id AS seq, text, lang AS label FROM documents WHERE doc_id % 3 <> 0), nw AS (SELECT doc_id AS seq, text, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS label FROM documents WHERE doc_id % 2 = 0)"


def _examples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", F.col("lang").alias("label"))
    return d.where("seq % 3 <> 0"), d.where("seq % 2 = 0").withColumn("label", F.when(F.col("seq") % 5 == 0, "xx").otherwise(F.col("label")))


@query("SELECT min(doc_id) AS seq, arg_min(lang, doc_id) AS label, md5(text) AS h FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY text")
def load_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples: allowed labels, the first row of each text."""
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr", "de")).select(F.col("doc_id").alias("seq"), F.md5("text").alias("h"), F.col("lang").alias("label"))
    return merge.keep_first(d, "h", "seq")


@query(f"WITH {_EX_SQL} SELECT md5(text) AS h, label, false AS is_new FROM ex UNION ALL SELECT md5(trim(text)), arg_min(label, seq), true FROM nw WHERE trim(text) NOT IN (SELECT trim(text) FROM ex) GROUP BY trim(text)")
def examples_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    have, new = _examples(spark, sf_dir)
    return merge.append(have, new).select(F.md5("text").alias("h"), "label", "is_new")


_UP = """h AS (SELECT trim(text) AS text, arg_min(label, seq) AS old FROM ex GROUP BY trim(text)), n AS (SELECT trim(text) AS text, arg_max(label, seq) AS new FROM {nw} GROUP BY trim(text)),
up AS (SELECT coalesce(h.text, n.text) AS text, coalesce(new, old) AS label, CASE WHEN new IS NULL THEN 'kept' WHEN old IS NULL THEN 'added' WHEN old = new THEN 'unchanged' ELSE 'updated' END AS action FROM h FULL JOIN n ON h.text = n.text)"""


@query(f"WITH {_EX_SQL}, {_UP.format(nw='nw')} SELECT md5(text) AS h, label, action FROM up")
def examples_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    have, new = _examples(spark, sf_dir)
    return merge.upsert(merge.keep_first(have.withColumn("text", F.trim("text")), "text", "seq"), new).select(F.md5("text").alias("h"), "label", "action")


@query(f"WITH {_EX_SQL}, rv AS (SELECT * FROM nw WHERE label IN ('en', 'fr', 'de', 'es')), {_UP.format(nw='rv')} SELECT action, count(*) AS n FROM up GROUP BY action")
def ingest_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows with an allowed label, upserted; counts by action."""
    have, new = _examples(spark, sf_dir)
    up = merge.upsert(merge.keep_first(have.withColumn("text", F.trim("text")), "text", "seq"), new.where(F.col("label").isin("en", "fr", "de", "es")))
    return up.groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_EX_SQL} SELECT is_new, count(*) AS n FROM (SELECT false AS is_new FROM ex UNION ALL SELECT true FROM (SELECT DISTINCT trim(text) FROM nw WHERE trim(text) NOT IN (SELECT trim(text) FROM ex))) GROUP BY is_new")
def gold_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    have, new = _examples(spark, sf_dir)
    return merge.append(have, new).groupBy("is_new").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS overlap FROM documents WHERE doc_id % 5 = 0 AND trim(text) IN (SELECT trim(text) FROM documents WHERE doc_id % 5 <> 0)")
def train_eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("t"))
    return d.where("doc_id % 5 = 0").join(d.where("doc_id % 5 <> 0").select("t"), "t", "left_semi").agg(F.count("*").alias("overlap"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 5 = 0)")
def train_minus_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.where("doc_id % 5 <> 0").join(d.where("doc_id % 5 = 0").select("text"), "text", "left_anti").select("doc_id")


@query("""WITH a AS (SELECT n_name AS name, n_regionkey % 2 AS def FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS name, n_regionkey % 3 AS def FROM nation WHERE n_nationkey >= 5)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.def <> b.def""")
def criteria_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels added, removed or defined anew between two versions of the criteria."""
    n = table(spark, sf_dir, "nation")
    a = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 2).alias("x"))
    b = n.where("n_nationkey >= 5").select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 3).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return a.join(b, "name", "full").select("name", change.alias("change")).where("change IS NOT NULL")


@query(f"""WITH {ANN_SQL} SELECT item_id, max(coalesce(CASE WHEN error IS NULL THEN label END, concat('error: ', error))) FILTER (WHERE model = 'm0') AS m0_r1, max(round(confidence, 2)) FILTER (WHERE model = 'm0' AND error IS NULL) AS m0_conf, max(label2) FILTER (WHERE model = 'm0') AS m0_r2,
  max(coalesce(CASE WHEN error IS NULL THEN label END, concat('error: ', error))) FILTER (WHERE model = 'm1') AS m1_r1, max(round(confidence, 2)) FILTER (WHERE model = 'm1' AND error IS NULL) AS m1_conf, max(label2) FILTER (WHERE model = 'm1') AS m1_r2 FROM ann WHERE model IN ('m0', 'm1') GROUP BY item_id""")
def wide_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column group per model."""
    ann = annotations(spark, sf_dir).where("model IN ('m0', 'm1')")
    ok = F.col("error").isNull()
    cell = F.when(ok, F.col("label")).otherwise(F.concat(F.lit("error: "), F.left("error", F.lit(40))))
    p = ann.groupBy("item_id").pivot("model", ["m0", "m1"]).agg(F.max(cell).alias("r1"), F.max(F.when(ok, F.round("confidence", 2))).alias("conf"), F.max("label2").alias("r2"))
    return p


@query(f"""{BASE}, arb AS (SELECT o_orderkey AS item_id, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS arbiter FROM orders)
SELECT r.item_id, r.label AS suggestion, string_agg(concat(a.model, '=', coalesce(CASE WHEN a.error IS NULL THEN a.label END, 'failed')), ' | ' ORDER BY a.model_ord) AS opinions,
coalesce(string_agg(concat(a.model, '=', a.label2), ' | ' ORDER BY a.model_ord) FILTER (WHERE a.label2 IS NOT NULL), '') AS review, coalesce(arbiter, '') AS arbiter FROM routed r JOIN ann a USING (item_id) LEFT JOIN arb USING (item_id) WHERE status = 'need_human' GROUP BY r.item_id, r.label, arbiter""")
def need_human_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items for people: what is suggested, what each model said, also that it failed, what it said on review, and the arbiter."""
    need = routed(spark, sf_dir).where("status = 'need_human'").select("item_id", F.col("label").alias("suggestion"))
    said = F.coalesce(F.when(F.col("error").isNull(), F.col("label")), F.lit("failed"))
    line = lambda x: F.array_sort(F.collect_list(x))
    op = annotations(spark, sf_dir).groupBy("item_id").agg(
        line(F.struct("model_ord", F.concat_ws("=", "model", said).alias("t"))).alias("o"), line(F.when(F.col("label2").isNotNull(), F.struct("model_ord", F.concat_ws("=", "model", "label2").alias("t")))).alias("r")
    )
    k = F.col("o_custkey") % 4
    arbiter = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(k == 0, "A").when(k == 1, "N").when(k == 2, "R").alias("arbiter"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), " | ")
    return need.join(op, "item_id").join(arbiter, "item_id", "left").select("item_id", "suggestion", text("o").alias("opinions"), text("r").alias("review"), F.coalesce("arbiter", F.lit("")).alias("arbiter"))


_PRICE_SQL = "CASE model WHEN 'm0' THEN 2.0 WHEN 'm1' THEN 4.0 WHEN 'm2' THEN 8.0 ELSE 0.0 END"


@query(f"""WITH {ANN_SQL}, k AS (SELECT model, error, out_tokens, 40 + item_id % 50 AS in_tokens, substr({_KEY}, 1, 1) < '8' AS hit, ((40 + item_id % 50) * 0.5 + out_tokens) * {_PRICE_SQL} / 1e6 AS cost FROM ann)
SELECT model, count(*) AS asked, count(*) FILTER (WHERE hit) AS cache_hits, count(*) FILTER (WHERE NOT hit) AS calls, count(*) FILTER (WHERE NOT hit AND error IS NOT NULL) AS errors,
CAST(sum(CASE WHEN hit THEN 0 ELSE in_tokens END) AS bigint) AS in_tokens, CAST(sum(CASE WHEN hit THEN 0 ELSE out_tokens END) AS bigint) AS out_tokens,
round(CAST(sum(CASE WHEN hit THEN 0 ELSE cost END) AS double), 6) AS cost, round(CAST(sum(CASE WHEN hit THEN cost ELSE 0 END) AS double), 6) AS saved FROM k GROUP BY model""")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, cache hits, errors, tokens, cost and what the cache saved, by model; a prompt has 40 tokens and those of its item."""
    k = annotations(spark, sf_dir).withColumn("key", T.chain_hash(F.lit("p"), F.col("model"), F.col("item_id").cast("string"))).withColumn("in_tokens", 40 + F.col("item_id") % 50)
    k = k.select("model", "error", "in_tokens", "out_tokens", "key", T.cost(F.col("in_tokens"), F.col("out_tokens"), _price(F.col("model")) / 2, _price(F.col("model"))).alias("cost"))
    k = k.join(k.where(F.substring("key", 1, 1) < "8").select("key").distinct().withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    new = lambda c: F.sum(F.when(F.col("hit"), 0).otherwise(F.col(c)))
    return k.groupBy("model").agg(
        F.count("*").alias("asked"), F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("calls"), F.count_if(~F.col("hit") & F.col("error").isNotNull()).alias("errors"),
        new("in_tokens").alias("in_tokens"), new("out_tokens").alias("out_tokens"), F.round(new("cost"), 6).alias("cost"), F.round(F.sum(F.when(F.col("hit"), F.col("cost")).otherwise(0.0)), 6).alias("saved"),
    )


def _price(model):
    return votes.literal_map({"m0": 2.0, "m1": 4.0, "m2": 8.0}, model, 0.0)


@query(f"""WITH {ANN_SQL} SELECT model, count(*) AS calls, count(*) FILTER (WHERE error IS NOT NULL) AS errors, CAST(sum(out_tokens) AS bigint) AS out_tokens, round(CAST(sum(out_tokens) AS double) * {_PRICE_SQL} / 1e6, 6) AS cost FROM ann GROUP BY model""")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = annotations(spark, sf_dir).groupBy("model").agg(F.count("*").alias("calls"), F.count("error").alias("errors"), F.sum("out_tokens").alias("out_tokens"))
    return g.withColumn("cost", F.round(T.cost(F.lit(0), F.col("out_tokens"), F.lit(0.0), _price(F.col("model"))), 6))


#: Tokens of a prompt without its text, of an opinion, of an answer (fixed value) and of an arbiter's answer; prices of the arbiter.
PROMPT_TOKENS, OPINION_TOKENS, OUT_TOKENS, ARBITER_OUT, ARBITER_PRICE = 200, 60, 50, 512, 16.0


@query(f"""WITH d AS (SELECT doc_id, CAST({PROMPT_TOKENS} + floor(length(text) * CAST(0.35 AS double)) AS bigint) + 1 AS tok FROM documents WHERE text IS NOT NULL),
k AS (SELECT model, tok, substr(sha256(concat_ws(chr(31), 'p', model, CAST(doc_id AS varchar))), 1, 1) < '8' AS hit FROM d, (SELECT unnest(['m0', 'm1', 'm2']) AS model)),
r AS (SELECT model, count(*) FILTER (WHERE NOT hit) AS miss, count(*) FILTER (WHERE hit) AS cached, CAST(coalesce(sum(tok) FILTER (WHERE NOT hit), 0) AS double) AS tin FROM k GROUP BY model),
n AS (SELECT CAST(count(*) AS double) AS n, CAST(sum(tok) AS double) / count(*) AS avg_in FROM d), s AS (SELECT CAST(unnest([0.0, 0.25, 1.0]) AS double) AS rate),
o AS (SELECT rate, model, miss * share + n * rate AS calls, cached * share AS hits, tin * share + n * rate * (avg_in + {2 * OPINION_TOKENS}) AS tin, CAST({OUT_TOKENS} AS double) AS per_call, {_PRICE_SQL} AS price FROM r, n, (SELECT *, 1.0 AS one FROM s) JOIN (SELECT unnest(['m0', 'm1', 'm2']) AS m2, unnest([false, false, true]) AS later) x ON true JOIN LATERAL (SELECT CASE WHEN later THEN rate ELSE 1.0 END AS share) y ON true WHERE m2 = model
UNION ALL SELECT rate, 'arbiter', n * rate * 2, 0, n * rate * 2 * (avg_in + {3 * OPINION_TOKENS}), {ARBITER_OUT}, {ARBITER_PRICE} FROM n, s)
SELECT rate, model, CAST(round(calls) AS bigint) AS calls, CAST(round(hits) AS bigint) AS cached, CAST(round(tin) AS bigint) AS in_tokens, CAST(round(calls * per_call) AS bigint) AS out_tokens, round((tin * price / 2 + calls * per_call * price) / 1e6, 6) AS cost FROM o""")
def estimate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost of a run if no, some or all items disagree. What the reply cache has costs nothing; m0 and m1 see
    all items, m2 what escalates; reviews, devil's advocate and arbiter (two calls of one model) see what disagrees."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", (T.estimate_tokens(F.col("text")) + PROMPT_TOKENS).alias("tok"))
    k = d.withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("m0", "m1", "m2")])))
    hit = F.substring(T.chain_hash(F.lit("p"), F.col("model"), F.col("doc_id").cast("string")), 1, 1) < "8"
    r = k.groupBy("model").agg(F.count_if(~hit).alias("miss"), F.count_if(hit).alias("cached"), F.sum(F.when(hit, 0).otherwise(F.col("tok"))).cast("double").alias("tin"), F.count("*").cast("double").alias("n"), F.avg("tok").alias("avg_in"))
    r = r.withColumn("rate", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 1.0)])))
    share, again = F.when(F.col("model") == "m2", F.col("rate")).otherwise(1.0), F.col("n") * F.col("rate")
    row = lambda model, calls, hits, tin, out, price: F.struct(model.alias("model"), calls.alias("calls"), hits.alias("cached"), tin.alias("tin"), F.lit(float(out)).alias("out"), price.alias("price"))
    own = row(F.col("model"), F.col("miss") * share + again, F.col("cached") * share, F.col("tin") * share + again * (F.col("avg_in") + 2 * OPINION_TOKENS), OUT_TOKENS, _price(F.col("model")))
    arbiter = row(F.lit("arbiter"), 2 * again, F.lit(0.0), 2 * again * (F.col("avg_in") + 3 * OPINION_TOKENS), ARBITER_OUT, F.lit(ARBITER_PRICE))
    o = r.select("rate", F.explode(F.when(F.col("model") == "m0", F.array(own, arbiter)).otherwise(F.array(own))).alias("o")).select("rate", "o.*")
    whole = lambda c: F.round(c).cast("bigint")
    cost = F.round(T.cost(F.col("tin"), F.col("calls") * F.col("out"), F.col("price") / 2, F.col("price")), 6)
    return o.select("rate", "model", whole(F.col("calls")).alias("calls"), whole(F.col("cached")).alias("cached"), whole(F.col("tin")).alias("in_tokens"), whole(F.col("calls") * F.col("out")).alias("out_tokens"), cost.alias("cost"))


_CRITERIA = """
va AS (SELECT n_name AS name, n_nationkey AS place, n_regionkey % 2 AS def, coalesce((SELECT list(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 2 = 0), []) AS ex FROM nation WHERE n_nationkey < 20),
vb AS (SELECT n_name AS name, 100 - n_nationkey AS place, n_regionkey % 3 AS def, coalesce((SELECT list(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 3 = 0), []) AS ex FROM nation WHERE n_nationkey >= 5),
lab AS (SELECT coalesce(a.name, b.name) AS name, a.name IS NULL AS new, b.name IS NULL AS gone, a.def <> b.def AS def, len(list_filter(b.ex, lambda x: NOT list_contains(a.ex, x))) AS more, len(list_filter(a.ex, lambda x: NOT list_contains(b.ex, x))) AS less FROM va a FULL JOIN vb b ON a.name = b.name)"""


@query(f"""WITH {_CRITERIA}, o AS (SELECT a.name, row_number() OVER (ORDER BY a.place) AS pa, row_number() OVER (ORDER BY b.place) AS pb FROM va a JOIN vb b ON a.name = b.name)
SELECT 'label' AS part, name, 'added' AS change, CAST(1 AS bigint) AS n FROM lab WHERE new UNION ALL SELECT 'label', name, 'removed', 1 FROM lab WHERE gone UNION ALL SELECT 'definition', name, 'changed', 1 FROM lab WHERE def
UNION ALL SELECT 'examples', name, 'added', more FROM lab WHERE NOT new AND NOT gone AND more > 0 UNION ALL SELECT 'examples', name, 'removed', less FROM lab WHERE NOT new AND NOT gone AND less > 0
UNION ALL SELECT DISTINCT 'order', 'labels', 'changed', CAST(1 AS bigint) FROM o WHERE pa <> pb
UNION ALL SELECT 'rule', r_name, CASE WHEN r_regionkey = 0 THEN 'removed' ELSE 'added' END, 1 FROM region WHERE r_regionkey IN (0, 4)""")
def criteria_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that differs between two versions of criteria: labels, definitions, examples, the order of labels, rules."""
    n, s, r = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))

    def version(rows: DataFrame, place, modulus: int, every: int) -> DataFrame:
        ex = s.where(F.col("s_suppkey") % every == 0).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list("s_suppkey").alias("ex"))
        none = F.array().cast("array<bigint>")
        return rows.join(ex, "n_nationkey", "left").select(F.col("n_name").alias("name"), place.alias("place"), (F.col("n_regionkey") % modulus).cast("string").alias("definition"), F.coalesce("ex", none).alias("examples"))

    old = version(n.where("n_nationkey < 20"), F.col("n_nationkey"), 2, 2)
    new = version(n.where("n_nationkey >= 5"), 100 - F.col("n_nationkey"), 3, 3)
    rules = lambda where: r.where(where).select(F.col("r_name").alias("rule"))
    return merge.criteria_changes(old, new, rules("r_regionkey < 4"), rules("r_regionkey >= 1"))
