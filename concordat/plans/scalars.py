"""Queries over scalar text and label functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import votes
from ..sources.tables import ANN_SQL, annotations, table
from .registry import query

_ML = "concat(l_returnflag, CASE l_partkey % 3 WHEN 0 THEN '; ' WHEN 1 THEN '，' ELSE '|' END, l_linestatus, '、 ', l_returnflag, ';')"
_PARTS = "list_filter(list_transform(string_split(replace(replace(replace(replace(replace({}, ';', '|'), '；', '|'), ',', '|'), '，', '|'), '、', '|'), '|'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH r AS (SELECT DISTINCT {_ML} AS raw FROM lineitem), p AS (SELECT raw, {_PARTS.format("raw")} AS parts FROM r)
SELECT raw, array_to_string(list_concat(list_filter(['A', 'N', 'R'], lambda x: list_contains(parts, x)), list_sort(list_distinct(list_filter(parts, lambda x: NOT list_contains(['A', 'N', 'R'], x))))), '|') AS label,
  CASE WHEN len(list_filter(parts, lambda x: NOT list_contains(['A', 'N', 'R', 'F'], x))) = 0 THEN true ELSE false END AS valid FROM p""")
def multilabel_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-label texts in canonical order, and whether all their parts are known labels."""
    k = F.col("l_partkey") % 3
    sep = F.when(k == 0, "; ").when(k == 1, "，").otherwise("|")
    r = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", sep, "l_linestatus", F.lit("、 "), "l_returnflag", F.lit(";")).alias("raw")).distinct()
    parts = votes.split_labels(F.col("raw"))
    return r.select("raw", votes.canonical(parts, ["A", "N", "R"]).alias("label"), F.forall(parts, lambda p: p.isin("A", "N", "R", "F")).alias("valid"))


@query("""WITH n AS (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation WHERE n_nationkey < 12),
r AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN concat(' "', n_name, '" ') WHEN 1 THEN lower(n_name) WHEN 2 THEN concat('it is ', n_name, ' I think') ELSE concat(n_name, ' or else') END AS raw FROM nation),
v AS (SELECT k, raw, trim(raw, concat(' ', chr(9), chr(10), '"''“”‘’「」『』[]【】')) AS v FROM r)
SELECT k, raw, CASE WHEN list_contains(names, v) THEN v WHEN len(list_filter(names, lambda x: lower(x) = lower(v))) > 0 THEN list_filter(names, lambda x: lower(x) = lower(v))[-1]
  WHEN len(list_filter(names, lambda x: contains(v, x))) = 1 THEN list_filter(names, lambda x: contains(v, x))[1] END AS label FROM v, n""")
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 4
    labels = [r[0] for r in n.where("n_nationkey < 12").orderBy("n_nationkey").select("n_name").collect()]  # a configured set
    raw = F.when(k == 0, F.concat(F.lit(' "'), "n_name", F.lit('" '))).when(k == 1, F.lower("n_name")).when(k == 2, F.concat(F.lit("it is "), "n_name", F.lit(" I think"))).otherwise(F.concat("n_name", F.lit(" or else")))
    return n.select(F.col("n_nationkey").alias("k"), raw.alias("raw")).withColumn("label", T.normalize_label(F.col("raw"), labels))


@query(f"""WITH {ANN_SQL}, r AS (SELECT item_id, model, label, CAST(round(confidence * 100) AS int) AS pct, item_id % 4 AS kind FROM ann WHERE label IS NOT NULL)
SELECT item_id, model, CASE WHEN kind = 3 THEN NULL ELSE label END AS label, CASE WHEN kind = 3 THEN 0.5 WHEN kind = 0 THEN CASE WHEN pct > 1 THEN pct / CAST(100 AS double) ELSE pct END ELSE pct / CAST(100 AS double) END AS confidence,
  CASE WHEN kind = 3 THEN '' WHEN kind = 2 THEN 'as "said" above' ELSE 'because' END AS reason FROM r""")
def parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of four shapes: a percentage after thinking, plain JSON, JSON broken by inner quotes, and no JSON at all."""
    a = annotations(spark, sf_dir).where("label IS NOT NULL").withColumn("pct", F.round(F.col("confidence") * 100).cast("int")).withColumn("kind", F.col("item_id") % 4)
    share = F.format_string("%.2f", F.col("pct") / 100.0)
    reply = (
        F.when(F.col("kind") == 0, F.format_string('<think>maybe {"label": "X"}</think>\n{"label": "%s", "confidence": %d, "reason": "because"}', "label", "pct"))
        .when(F.col("kind") == 1, F.format_string('Sure: {"label": "%s", "confidence": %s, "reason": "because"} done', "label", share))
        .when(F.col("kind") == 2, F.format_string('{"label": "%s", "confidence": %s, "reason": "as "said" above"}', "label", share))
        .otherwise(F.lit("I cannot tell"))
    )
    label, confidence, reason = T.reply_fields(F.col("reply"))
    return a.withColumn("reply", reply).select("item_id", "model", label.alias("label"), confidence.alias("confidence"), reason.alias("reason"))


@query(f"""WITH {ANN_SQL} SELECT item_id, model, round(exp(greatest(-(model_ord + 1) / CAST(8 AS double) - (out_tokens % 5) / CAST(10 AS double), -50)), 4) AS prob FROM ann WHERE label IS NOT NULL""")
def label_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a label from the log-probabilities of the tokens that overlap it; the label falls into two tokens."""
    a = annotations(spark, sf_dir).where("label IS NOT NULL").withColumn("label", F.concat("label", F.lit("x")))
    lp1, lp2 = -(F.col("model_ord") + 1) / 8.0, -(F.col("out_tokens") % 5) / 10.0
    token = lambda t, lp: F.struct(t.alias("t"), lp.alias("lp"))
    tokens = F.array(token(F.lit('{"label": "'), F.lit(-3.0)), token(F.left("label", F.lit(1)), lp1), token(F.lit("x"), lp2), token(F.lit('", "confidence": 1}'), F.lit(-7.0)))
    text = F.concat(F.lit('{"label": "'), "label", F.lit('", "confidence": 1}'))
    return a.select("item_id", "model", T.token_probability(tokens, text).alias("prob"))


@query("""WITH q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN concat('"', substr(text, 3, 20), '"') WHEN 1 THEN concat(substr(text, 3, 10), '……', substr(text, 21, 10)) WHEN 2 THEN concat('zz', substr(text, 3, 12)) ELSE 'x' END AS quote FROM documents),
f AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS body, trim(regexp_replace(quote, '\\s+', '', 'g'), '"''“”‘’「」『』….。') AS q FROM q)
SELECT doc_id, length(q) >= 2 AND len(list_filter(list_filter(string_split_regex(q, '…+|\\.{3,}'), lambda p: p <> ''), lambda p: NOT contains(body, p))) = 0 AS ok FROM f""")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    part = lambda at, n: F.substring("text", at, n)
    quote = F.when(k == 0, F.concat(F.lit('"'), part(3, 20), F.lit('"'))).when(k == 1, F.concat(part(3, 10), F.lit("……"), part(21, 10))).when(k == 2, F.concat(F.lit("zz"), part(3, 12))).otherwise(F.lit("x"))
    return d.select("doc_id", T.evidence_ok(quote, F.col("text")).alias("ok"))


@query("""WITH c AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\x{3000}-\\x{303f}\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ff00}-\\x{ffef}]', '', 'g')) AS cjk FROM documents)
SELECT doc_id, CAST(floor(cjk * CAST(0.7 AS double) + (n - cjk) * CAST(0.35 AS double)) AS bigint) + 1 AS tokens FROM c""")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, md5(regexp_replace(text, 'tion|ing|th', '[label]', 'g')) AS h FROM documents")
def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.mask_labels(F.col("text"), ["th", "ing", "tion"])).alias("h"))


_TWO_LEVELS = ["a/1", "b/1", "a/2", "c/1", "b/2", "c/2"]


@query(f"""WITH s AS (SELECT doc_id, list_transform(list_sort(list_transform({_TWO_LEVELS}, lambda l: concat(md5(concat('m0|', CAST(doc_id AS varchar), '|', l)), l))), lambda x: substr(x, 33)) AS l FROM documents),
p AS (SELECT doc_id, l, list_transform(l, lambda x: substr(x, 1, 1)) AS p FROM s)
SELECT doc_id, list_transform(list_sort(list_transform(range(1, len(l) + 1), lambda i: {{'first': list_position(p, p[i]), 'i': i, 'l': l[i]}})), lambda x: x.l) AS labels FROM p""")
def label_shuffle_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level labels in an order of their own for each document, those of a parent together."""
    order = F.array_sort(F.array(*[F.struct(F.md5(F.concat(F.lit("m0|"), F.col("doc_id").cast("string"), F.lit(f"|{x}"))).alias("h"), F.lit(x).alias("x")) for x in _TWO_LEVELS]))
    return table(spark, sf_dir, "documents").select("doc_id", T.grouped_order(F.transform(order, lambda o: o["x"])).alias("labels"))


@query("""SELECT doc_id, list_transform(list_sort(list_transform(['A', 'N', 'R', 'F'], lambda l: concat(md5(concat('m0|', CAST(doc_id AS varchar), '|', l)), l))), lambda x: substr(x, 33)) AS labels FROM documents""")
def label_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation of the labels that is fixed by model and item."""
    key = lambda x: F.concat(F.md5(F.concat(F.lit("m0|"), F.col("doc_id").cast("string"), F.lit("|"), x)), x)
    order = F.array_sort(F.transform(F.array(*[F.lit(x) for x in "ANRF"]), key))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(order, lambda x: F.substr(x, F.lit(33))).alias("labels"))


@query("SELECT doc_id, left(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), 2000) AS text, length(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')) > 2000 AS cut FROM documents")
def doc_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace("text", "\n{3,}", "\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.left(t, F.lit(2000)).alias("text"), (F.length(t) > 2000).alias("cut"))


@query("SELECT doc_id, left(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), 40000) AS text, length(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')) > 40000 AS cut FROM documents")
def doc_truncate_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut where the feature cuts them."""
    t = F.regexp_replace("text", "\n{3,}", "\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.left(t, F.lit(40000)).alias("text"), (F.length(t) > 40000).alias("cut"))


@query("SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, min(doc_id) AS seq FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 4 GROUP BY 1")
def prep_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "documents").select(t.alias("text"), "doc_id").where(F.length("text") >= 4).groupBy("text").agg(F.min("doc_id").alias("seq"))


@query("SELECT coalesce(nullif(CASE WHEN doc_id % 10 = 0 THEN '' ELSE CAST(doc_id AS varchar) END, ''), concat('row', CAST(doc_id + 1 AS varchar))) AS id, md5(text) AS h FROM documents WHERE trim(text) <> ''")
def scan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with an id, or their row number where it is empty; blank texts dropped after numbering."""
    d = table(spark, sf_dir, "documents")
    given = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("doc_id").cast("string"))
    return d.where(F.trim("text") != "").select(F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit("row"), (F.col("doc_id") + 1).cast("string"))).alias("id"), F.md5("text").alias("h"))


@query("""SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5(concat('m0|7|', CAST(doc_id AS varchar))), 1, 8)) AS bigint) / CAST(4294967296 AS double) < 0.8 THEN CASE WHEN contains(text, '###') OR contains(text, '!!') THEN 'bad' ELSE 'good' END
  ELSE CASE WHEN contains(text, '###') OR contains(text, '!!') THEN 'good' ELSE 'bad' END END AS label FROM documents""")
def mock_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mock annotator: a keyword rule, wrong for a fixed share of items drawn by hash."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("m0|7|"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    bad = F.col("text").contains("###") | F.col("text").contains("!!")
    return table(spark, sf_dir, "documents").select("doc_id", F.when((u < 0.8) == bad, "bad").otherwise("good").alias("label"))


@query("SELECT doc_id, concat('Labels: A, N, R', chr(10), 'Text: ', CASE WHEN length(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) > 300 THEN concat(left(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 300), '…') ELSE trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) END) AS prompt FROM documents")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Labels: A, N, R\nText: "), T.clip(F.col("text"), 300)).alias("prompt"))


@query(f"WITH {ANN_SQL} SELECT item_id, count(*) AS n, CAST(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS bigint) AS ok FROM ann GROUP BY item_id")
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested result records as JSON lines and back."""
    rec = F.struct("model", "label", "confidence", "error")
    nested = annotations(spark, sf_dir).groupBy("item_id").agg(F.array_sort(F.collect_list(rec)).alias("round1"))
    lines = nested.select(F.to_json(F.struct("item_id", "round1")).alias("line"))
    schema = "item_id bigint, round1 array<struct<model: string, label: string, confidence: double, error: string>>"
    back = lines.select(F.from_json("line", schema).alias("r")).select("r.*")
    return back.select("item_id", F.size("round1").cast("bigint").alias("n"), F.size(F.filter("round1", lambda x: x["error"].isNull())).cast("bigint").alias("ok"))


_TASK, _RULES = "Sort documents by language.", ["the body decides, not the title", "names don't count"]
_DEFINITIONS = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}
_CLIP_SQL = "CASE WHEN length(trim(regexp_replace({t}, '[ \\t\\n\\r]+', ' ', 'g'))) > 300 THEN concat(left(trim(regexp_replace({t}, '[ \\t\\n\\r]+', ' ', 'g')), 300), '…') ELSE trim(regexp_replace({t}, '[ \\t\\n\\r]+', ' ', 'g')) END"


@query(f"""WITH d AS (SELECT doc_id, text, lang, list_transform(list_sort(list_transform({list(_DEFINITIONS)}, lambda l: concat(md5(concat('m0|', CAST(doc_id AS varchar), '|', l)), l))), lambda x: substr(x, 33)) AS o FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, list(x ORDER BY o) AS ex FROM (SELECT a.doc_id, b.doc_id AS o, concat('[', b.lang, '] ', {_CLIP_SQL.format(t="b.text")}) AS x FROM d a JOIN d b ON b.doc_id IN (a.doc_id - 1, a.doc_id - 2) WHERE b.lang IS NOT NULL) GROUP BY doc_id),
f AS (SELECT d.*, coalesce(ex, []) AS ex FROM d LEFT JOIN e USING (doc_id))
SELECT doc_id, md5(concat('# Task', chr(10), '{_TASK}', chr(10), chr(10), '# Labels', chr(10), array_to_string(list_transform(o, lambda x: concat('## ', x, chr(10), CASE x WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' ELSE 'French' END)), chr(10) || chr(10)), chr(10), chr(10),
'# Rules', chr(10), '1. {_RULES[0]}', chr(10), '2. {_RULES[1].replace("'", "''")}', chr(10), chr(10), CASE WHEN len(ex) = 0 THEN '' ELSE concat('# Examples', chr(10), array_to_string(list_transform(range(1, len(ex) + 1), lambda i: concat(i, '. ', ex[i])), chr(10)), chr(10), chr(10)) END,
CASE WHEN doc_id % 2 = 0 THEN concat('# Other opinions', chr(10), 'm1: ', coalesce(lang, 'none'), chr(10), chr(10)) ELSE '' END, '# Text', chr(10), '<text>', chr(10), text, chr(10), '</text>', chr(10), chr(10),
'# Answer', chr(10), '{{"label": "...", "confidence": 0..1, "reason": "..."}}', chr(10), 'label is one of: ', array_to_string(o, ' / '))) AS h FROM f""")
def prompt_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prompts: labels in the item's own order, rules, the two documents before as examples, an opinion on every other one."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    order = F.array_sort(F.array(*[F.struct(F.md5(F.concat(F.lit("m0|"), F.col("doc_id").cast("string"), F.lit(f"|{x}"))).alias("h"), F.lit(x).alias("x")) for x in _DEFINITIONS]))
    near = d.where("lang IS NOT NULL").select(F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 2)).alias("doc_id"), F.struct(F.col("doc_id").alias("o"), "text", F.col("lang").alias("label")).alias("e"))
    near = near.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("examples"))  # two rows a document at most, but for repeated ids
    d = d.join(near, "doc_id", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<struct<o:bigint,text:string,label:string>>")))
    opinions = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("m1: "), F.coalesce("lang", F.lit("none"))))).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", F.md5(T.guide_prompt(_TASK, _DEFINITIONS, F.transform(order, lambda o: o["x"]), _RULES, F.col("examples"), opinions, F.col("text"))).alias("h"))
