"""Queries that calibrate confidences and search thresholds."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibration, routing, votes
from ..operators.metrics import log_odds_weight, rate
from ..sources.shared import kept
from ..sources.tables import ANN_SQL, GOLD_SQL, LABELS, annotations, gold
from .registry import query

OK = "error IS NULL AND label IS NOT NULL"
POINTS_SQL = f"pts AS (SELECT model, confidence AS x, label = gold AS y FROM ann JOIN gold USING (item_id) WHERE {OK})"
FOLD_SQL = "CAST((CAST(CAST(('0x' || substr(md5(CAST(item_id AS varchar)), 1, 16)) AS ubigint) % 5 AS int) * CAST(18446744073709551616 % 5 AS int) + CAST(CAST(('0x' || substr(md5(CAST(item_id AS varchar)), 17, 16)) AS ubigint) % 5 AS int)) % 5 AS int)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes.valid(annotations(spark, sf_dir)).join(gold(spark, sf_dir), "item_id")
    return v.select("item_id", "model", F.col("confidence").alias("x"), (F.col("label") == F.col("gold")).alias("y"))


_BINS = "SELECT model, least(CAST(floor(x * {n}) AS int), {last}) AS bin, count(*) AS n, avg(x) AS mean_conf, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS accuracy FROM pts GROUP BY ALL"


@query(f"WITH {ANN_SQL}, {GOLD_SQL}, {POINTS_SQL}, b AS ({_BINS.format(n=10, last=9)}) SELECT model, CAST(sum(n) AS bigint) AS n, round(CAST(sum(n * abs(mean_conf - accuracy)) AS double) / CAST(sum(n) AS double), 6) AS ece FROM b GROUP BY model")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.ece(points(spark, sf_dir), 10, "model")


@query(f"WITH {ANN_SQL}, {GOLD_SQL}, {POINTS_SQL}, b AS ({_BINS.format(n=5, last=4)}) SELECT model, bin, n, round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy FROM b")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.reliability(points(spark, sf_dir), 5, "model").withColumns({c: F.round(c, 6) for c in ("mean_conf", "accuracy")})


_CONF_SQL = f"""
mv AS (SELECT item_id, model, label, gold, {FOLD_SQL} AS fold FROM ann JOIN gold USING (item_id) WHERE {OK}),
lab AS (SELECT unnest(['A', 'N', 'R']) AS l), mods AS (SELECT DISTINCT model FROM mv)"""


@query(f"""WITH {ANN_SQL}, {GOLD_SQL}, {_CONF_SQL},
g AS (SELECT model, a.l AS truth, b.l AS pred, 1.0 + (SELECT count(*) FROM mv v WHERE v.model = m.model AND v.gold = a.l AND v.label = b.l) AS c FROM mods m, lab a, lab b)
SELECT model, truth, pred, round(CAST(c AS double) / CAST(sum(c) OVER (PARTITION BY model, truth) AS double), 6) AS p FROM g""")
def confusion_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes.valid(annotations(spark, sf_dir)).join(gold(spark, sf_dir), "item_id")
    return calibration.fit_confusion(v, LABELS).withColumn("p", F.round("p", 6))


@query(f"WITH {GOLD_SQL} SELECT item_id, {FOLD_SQL} AS fold FROM gold")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).select("item_id", calibration.fold_of(F.col("item_id"), 5).alias("fold"))


CROSSFIT_SQL = f"""WITH {ANN_SQL}, {GOLD_SQL}, {_CONF_SQL}, folds AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
n AS (SELECT model, fold, gold, label, count(*) AS c FROM mv GROUP BY ALL),
g AS (SELECT f.fold, m.model, a.l AS truth, b.l AS pred, 1.0 + coalesce((SELECT sum(c) FROM n WHERE n.model = m.model AND n.gold = a.l AND n.label = b.l AND n.fold <> f.fold), 0) AS c FROM folds f, mods m, lab a, lab b),
cf AS (SELECT fold, model, truth, pred, CAST(c AS double) / CAST(sum(c) OVER (PARTITION BY fold, model, truth) AS double) AS p FROM g),
gi AS (SELECT gold, {FOLD_SQL} AS fold, count(*) AS c FROM gold WHERE item_id IN (SELECT item_id FROM ann) GROUP BY ALL),
pr AS (SELECT f.fold, l.l AS truth, CAST((coalesce((SELECT sum(c) FROM gi WHERE gi.fold <> f.fold AND gi.gold = l.l), 0) + 1) AS double) / CAST((SELECT sum(c) FROM gi WHERE gi.fold <> f.fold) + 3 AS double) AS p FROM folds f, lab l),
ll AS (SELECT v.item_id, v.gold, v.fold, cf.truth, sum(ln(cf.p)) AS ll FROM mv v JOIN cf ON v.fold = cf.fold AND v.model = cf.model AND v.label = cf.pred GROUP BY ALL),
lp AS (SELECT item_id, gold, ll.truth, ll + ln(pr.p) AS ll FROM ll JOIN pr ON ll.fold = pr.fold AND ll.truth = pr.truth),
e AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY item_id)) AS e FROM lp),
s AS (SELECT item_id, gold, truth, e / sum(e) OVER (PARTITION BY item_id) AS prob FROM e),
cross_ AS (SELECT item_id, prob, label = gold AS correct, label FROM (SELECT item_id, gold, truth AS label, prob, row_number() OVER (PARTITION BY item_id ORDER BY round(prob, 9) DESC, truth) AS rk FROM s) WHERE rk = 1)"""


def crossfit(spark: SparkSession, sf_dir: str, use_confidence: bool = False) -> DataFrame:
    """(item_id, label, prob, correct): posteriors by matrices fitted without the item's fold.

    A fold's counts are all counts less its own, so the votes are counted once for all folds. With ``use_confidence`` a
    model's chance of being right is scaled for each vote by its calibrated confidence over the model's accuracy, both by
    points of other folds.
    """
    v = votes.valid(annotations(spark, sf_dir)).join(gold(spark, sf_dir), "item_id").withColumn("fold", calibration.fold_of(F.col("item_id"), 5))
    n = v.groupBy("fold", "model", F.col("gold").alias("truth"), F.col("label").alias("pred")).agg(F.count("*").alias("c"))
    cell = ["model", "truth", "pred"]
    grid = n.select("model").distinct()
    for c, values in (("truth", LABELS), ("pred", LABELS), ("fold", list(range(5)))):
        grid = grid.withColumn(c, F.explode(F.array(*[F.lit(x) for x in values])))
    n = grid.join(n, ["fold", *cell], "left").fillna(0, ["c"])
    n = n.withColumn("c", F.sum("c").over(Window.partitionBy(*cell)) - F.col("c") + 1.0)
    confusion = n.select("fold", *cell, (F.col("c") / F.sum("c").over(Window.partitionBy("fold", "model", "truth"))).alias("p"))
    items = gold(spark, sf_dir).join(annotations(spark, sf_dir).select("item_id").distinct(), "item_id", "left_semi")
    g = items.groupBy(calibration.fold_of(F.col("item_id"), 5).alias("fold"), F.col("gold").alias("truth")).agg(F.count("*").alias("c"))
    every = spark.createDataFrame([(f, x) for f in range(5) for x in LABELS], "fold int, truth string").join(g, ["fold", "truth"], "left").fillna(0, ["c"])
    every = every.withColumn("o", F.sum("c").over(Window.partitionBy("truth")) - F.col("c"))
    prior = every.select("fold", "truth", ((F.col("o") + 1) / (F.sum("o").over(Window.partitionBy("fold")) + 3)).alias("prior"))
    # one row an item throughout: a column for each label
    wide = lambda df, c, *by, log=F.log: df.groupBy(*by).agg(*[F.max(F.when(F.col("truth") == x, log(c))).alias(f"{c}{i}") for i, x in enumerate(LABELS)])
    if use_confidence:
        right = confusion.where("truth = pred").select("fold", "model", "truth", F.col("p").alias("d"))
        cells = wide(confusion, "p", "fold", "model", "pred", log=F.col).join(wide(right, "d", "fold", "model", log=F.col), ["fold", "model"])
        scales = kept(calibration.crossfit_scales(v.select("model", "fold", F.col("item_id").alias("key"), F.col("confidence").alias("x"), (F.col("label") == F.col("gold")).alias("y"))), "scales")
        ll = v.select("item_id", "gold", "fold", "model", F.col("label").alias("pred"), F.round("confidence", 4).alias("x"))
        ll = ll.join(F.broadcast(cells), ["fold", "model", "pred"]).join(scales, ["fold", "model", "x"], "left")
        ll = ll.withColumns({f"p{i}": F.log(F.greatest(calibration.scaled(F.col(f"p{i}"), F.col(f"d{i}"), F.col("scale"), F.col("pred") == x), F.lit(1e-9))) for i, x in enumerate(LABELS)})
    else:
        ll = v.select("item_id", "gold", "fold", "model", F.col("label").alias("pred")).join(F.broadcast(wide(confusion, "p", "fold", "model", "pred")), ["fold", "model", "pred"])
    ll = ll.groupBy("item_id", "gold", "fold").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(LABELS))]).join(F.broadcast(wide(prior, "prior", "fold")), "fold")
    ll = ll.select("item_id", "gold", *[(F.col(f"p{i}") + F.col(f"prior{i}")).alias(f"l{i}") for i in range(len(LABELS))])
    e = [F.exp(F.col(f"l{i}") - F.greatest(*[f"l{j}" for j in range(len(LABELS))])) for i in range(len(LABELS))]
    s = ll.select("item_id", "gold", *[x.alias(f"e{i}") for i, x in enumerate(e)])
    share = [F.col(f"e{i}") / reduce(add, [F.col(f"e{j}") for j in range(len(LABELS))]) for i in range(len(LABELS))]
    best = F.array_min(F.array(*[F.struct((-F.round(p, 9)).alias("r"), F.lit(x).alias("label"), p.alias("prob")) for x, p in zip(LABELS, share, strict=True)]))
    s = s.select("item_id", "gold", best.alias("b")).select("item_id", "gold", "b.label", "b.prob")
    return s.select("item_id", "label", "prob", (F.col("label") == F.col("gold")).alias("correct"))


def crossfit_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, label): votes by confidence times a weight from the model's accuracy on other folds, where failures are wrong."""
    a = annotations(spark, sf_dir).join(gold(spark, sf_dir), "item_id").withColumn("fold", calibration.fold_of(F.col("item_id"), 5))
    right = F.count_if(F.col("error").isNull() & (F.col("label") == F.col("gold")))
    n = a.groupBy("fold", "model").agg(F.count("*").alias("n"), right.alias("r"))
    n = n.select("model").distinct().withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(5)]))).join(n, ["fold", "model"], "left").fillna(0, ["n", "r"])
    others = lambda c: F.sum(c).over(Window.partitionBy("model")) - F.col(c)
    weights = n.select("fold", "model", log_odds_weight(others("r") / F.greatest(others("n"), F.lit(1)), len(LABELS)).alias("weight"))
    score = F.round(F.sum(F.col("weight") * F.greatest("confidence", F.lit(0.05))), 9)  # sums don't depend on the order of the votes
    t = votes.valid(a).join(F.broadcast(weights), ["fold", "model"]).groupBy("item_id", "label").agg(score.alias("score"), F.min("model_ord").alias("first_ord"))
    return votes.best(t, F.desc("score"), F.asc("first_ord")).select("item_id", "label")


@query(f"{CROSSFIT_SQL} SELECT item_id, label, round(prob, 6) AS prob, correct FROM cross_")
def crossfit_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossfit(spark, sf_dir).withColumn("prob", F.round("prob", 6))


GRID = [round(0.3 + 0.01 * i, 2) for i in range(50)]
CURVE_SQL = f"""{CROSSFIT_SQL}, grid AS (SELECT CAST(round(0.3 + 0.01 * i, 2) AS double) AS threshold FROM range(50) t(i)),
curve AS (SELECT threshold, count(*) FILTER (WHERE round(prob, 6) >= threshold) AS n_auto, round(CAST(count(*) FILTER (WHERE round(prob, 6) >= threshold) AS double) / count(*), 6) AS coverage,
  round(CAST(count(*) FILTER (WHERE round(prob, 6) >= threshold AND correct) AS double) / nullif(count(*) FILTER (WHERE round(prob, 6) >= threshold), 0), 6) AS accuracy FROM cross_, grid GROUP BY threshold)"""


@query(f"{CURVE_SQL} SELECT threshold, n_auto, coverage, accuracy FROM curve")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.coverage_curve(crossfit_posteriors(spark, sf_dir), GRID)


@query(f"{CURVE_SQL} SELECT threshold, n_auto, coverage, accuracy FROM curve WHERE accuracy >= 0.3 ORDER BY coverage DESC, accuracy DESC, threshold LIMIT 1")
def pick_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the largest coverage with enough accuracy."""
    return coverage_curve(spark, sf_dir).where("accuracy >= 0.3").orderBy(F.desc("coverage"), F.desc("accuracy"), "threshold").limit(1)


A_GRID, B_GRID = [round(0.5 + 0.05 * i, 2) for i in range(11)], [round(0.05 * i, 2) for i in range(21)]
_SIM_SQL = f"""WITH {ANN_SQL}, {GOLD_SQL},
r2 AS (SELECT item_id, model, model_ord, coalesce(label2, label) AS label, confidence, CASE WHEN label2 IS NULL THEN error END AS error, evidence_ok FROM ann),
una AS (SELECT item_id, count(*) FILTER (WHERE {OK}) AS valid, count(DISTINCT CASE WHEN error IS NULL THEN label END) AS n_labels, min(CASE WHEN error IS NULL THEN label END) AS first_label FROM ann GROUP BY item_id),
sc AS (SELECT item_id, label, count(*) AS cnt, min(model_ord) AS fo, sum(greatest(confidence, 0.05)) AS score FROM r2 WHERE {OK} GROUP BY item_id, label),
wv AS (SELECT * FROM (SELECT item_id, label, score / sum(score) OVER (PARTITION BY item_id) AS share, cnt * 2 > sum(cnt) OVER (PARTITION BY item_id) AS major, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, fo) AS rk FROM sc) WHERE rk = 1),
arb AS (SELECT o_orderkey AS item_id, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS al, (o_orderkey % 16) / 16.0 AS ac FROM orders),
base AS (SELECT u.item_id, valid >= 2 AND n_labels = 1 AS auto, first_label = gold AS auto_ok, CASE WHEN valid > 0 AND major THEN share END AS share, w.label = gold AS rev_ok, CASE WHEN al IS NOT NULL THEN ac END AS ac, al = gold AS arb_ok
  FROM una u JOIN gold g USING (item_id) LEFT JOIN wv w USING (item_id) LEFT JOIN arb a USING (item_id)),
grid AS (SELECT CAST(round(0.5 + 0.05 * i, 2) AS double) AS accept_threshold, CAST(round(0.05 * j, 2) AS double) AS arbiter_threshold FROM range(11) a(i), range(21) b(j)),
f AS (SELECT accept_threshold, arbiter_threshold, CASE WHEN auto THEN auto_ok WHEN share >= accept_threshold THEN rev_ok WHEN ac >= arbiter_threshold THEN arb_ok END AS ok,
  auto OR coalesce(share >= accept_threshold, false) OR coalesce(ac >= arbiter_threshold, false) AS taken FROM base, grid)
SELECT accept_threshold, arbiter_threshold, count(*) FILTER (WHERE taken) AS n_auto, round(CAST(count(*) FILTER (WHERE taken) AS double) / count(*), 6) AS coverage,
  round(CAST(count(*) FILTER (WHERE taken AND ok) AS double) / nullif(count(*) FILTER (WHERE taken), 0), 6) AS accuracy FROM f GROUP BY ALL"""


@query(_SIM_SQL)
def simulate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every pair of accept and arbiter thresholds on logged votes, without asking any model again.

    Items are first counted by the grid cells that they reach, so the grid multiplies counts, not items.
    """
    from .routing import table

    ann = annotations(spark, sf_dir)
    una = routing.unanimity(ann).select("item_id", "valid", "n_labels", "first_label")
    reviewed = routing.merge_rounds(ann).withColumn("evidence_ok", F.lit(True))
    vote = votes.weighted(reviewed, {}).select("item_id", F.col("label").alias("vl"), F.when(F.col("agree") * 2 > F.col("total"), F.col("share")).alias("share"))
    k = F.col("o_custkey") % 4
    arb = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(k == 0, "A").when(k == 1, "N").when(k == 2, "R").alias("al"), ((F.col("o_orderkey") % 16) / 16.0).alias("ac"))
    b = una.join(gold(spark, sf_dir), "item_id").join(vote, "item_id", "left").join(arb, "item_id", "left")
    reach = lambda x, grid: F.coalesce(F.aggregate(F.array(*[F.lit(g) for g in grid]), F.lit(0), lambda n, g: n + (x >= g).cast("int")), F.lit(0))
    b = b.select(
        ((F.col("valid") >= 2) & (F.col("n_labels") == 1)).alias("auto"), (F.col("first_label") == F.col("gold")).alias("auto_ok"),
        reach(F.when(F.col("valid") > 0, F.col("share")), A_GRID).alias("i"), (F.col("vl") == F.col("gold")).alias("rev_ok"),
        reach(F.when(F.col("al").isNotNull(), F.col("ac")), B_GRID).alias("j"), (F.col("al") == F.col("gold")).alias("arb_ok"),
    )
    cells = b.groupBy("auto", "auto_ok", "i", "rev_ok", "j", "arb_ok").agg(F.count("*").alias("n"))
    g = cells.withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(len(A_GRID))))).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(len(B_GRID)))))
    rev, arbited = F.col("i") >= F.col("a"), F.col("j") >= F.col("b")
    taken = F.col("auto") | rev | arbited
    ok = F.when(F.col("auto"), F.col("auto_ok")).when(rev, F.col("rev_ok")).when(arbited, F.col("arb_ok"))
    value = lambda grid, i: F.element_at(F.array(*[F.lit(x) for x in grid]), F.col(i))
    out = g.groupBy(value(A_GRID, "a").alias("accept_threshold"), value(B_GRID, "b").alias("arbiter_threshold")).agg(
        F.sum(F.when(taken, F.col("n")).otherwise(0)).alias("n_auto"), F.sum("n").alias("all"), F.sum(F.when(taken & ok, F.col("n")).otherwise(0)).alias("right_")
    )
    return out.select("accept_threshold", "arbiter_threshold", "n_auto", rate(F.col("n_auto"), F.col("all")).alias("coverage"), rate(F.col("right_"), F.col("n_auto")).alias("accuracy"))


@query()
def calibration_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic and Platt curves by model; pooling and Newton steps are not SQL, so tests compare with plain Python."""
    return calibration.curves(points(spark, sf_dir))
