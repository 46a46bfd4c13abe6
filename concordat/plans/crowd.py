"""Queries over crowd models, with SQL that unrolls the first iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crowd, votes
from ..sources.tables import ANN_SQL, LABELS, annotations
from .registry import query


_V = f"""WITH {ANN_SQL}, v AS (SELECT item_id, model, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS a FROM ann WHERE error IS NULL AND label IS NOT NULL),
ks AS (SELECT unnest([0, 1, 2]) AS k), items AS (SELECT DISTINCT item_id FROM v), mods AS (SELECT DISTINCT model FROM v),
t0 AS (SELECT i.item_id, k, CAST(count(v.a) AS double) / (SELECT count(*) FROM v x WHERE x.item_id = i.item_id) AS t FROM items i CROSS JOIN ks LEFT JOIN v ON v.item_id = i.item_id AND v.a = k GROUP BY i.item_id, k)"""
_TOP = "SELECT item_id, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS label, round(t, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(t, 9) DESC, k) AS rk FROM {t}) WHERE rk = 1"
_SOFT = "{new} AS (SELECT item_id, k, e / sum(e) OVER (PARTITION BY item_id) AS t FROM (SELECT item_id, k, exp(l - max(l) OVER (PARTITION BY item_id)) AS e FROM {old}))"


def _ds_sql(n: int) -> str:
    parts = [_V]
    for i in range(n):
        parts += [
            f"pr{i} AS (SELECT k, (sum(t) + 0.01) / ((SELECT count(*) FROM items) + 0.03) AS p FROM t{i} GROUP BY k)",
            f"cm{i} AS (SELECT m.model, ks.k, l.k AS a, 0.01 + coalesce(x.s, 0) AS c FROM mods m CROSS JOIN ks CROSS JOIN ks l LEFT JOIN (SELECT model, k, a, sum(t) AS s FROM v JOIN t{i} USING (item_id) GROUP BY model, k, a) x ON x.model = m.model AND x.k = ks.k AND x.a = l.k)",
            f"cf{i} AS (SELECT model, k, a, CAST(c AS double) / sum(CAST(c AS double)) OVER (PARTITION BY model, k) AS p FROM cm{i})",
            f"l{i} AS (SELECT v.item_id, cf.k, max(ln(pr.p)) + sum(ln(cf.p)) AS l FROM v JOIN cf{i} cf ON v.model = cf.model AND v.a = cf.a JOIN pr{i} pr ON pr.k = cf.k GROUP BY v.item_id, cf.k)",
            _SOFT.format(new=f"t{i + 1}", old=f"l{i}"),
        ]
    return ",\n".join(parts)


@query(f"{_ds_sql(3)} {_TOP.format(t='t3')}")
def dawid_skene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three iterations, which SQL can unroll."""
    v = votes.valid(annotations(spark, sf_dir))
    return crowd.crowd_labels(v, LABELS, "dawid_skene", n_iter=3).withColumn("prob", F.round("prob", 6))


@query()
def dawid_skene_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.crowd_labels(votes.valid(annotations(spark, sf_dir)), LABELS, "dawid_skene")


@query(f"""{_V}, best AS (SELECT item_id, k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(t, 9) DESC, k) AS rk FROM t0) WHERE rk = 1),
skill AS (SELECT model, avg(CASE WHEN k = a THEN CAST(1 AS double) ELSE 0 END) AS s FROM v JOIN best USING (item_id) GROUP BY model),
w AS (SELECT v.item_id, v.a AS k, sum(s) AS s FROM v JOIN skill USING (model) GROUP BY v.item_id, v.a),
t1 AS (SELECT item_id, k, s / sum(s) OVER (PARTITION BY item_id) AS t FROM w) {_TOP.format(t='t1')}""")
def wawa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.crowd_labels(votes.valid(annotations(spark, sf_dir)), LABELS, "wawa").withColumn("prob", F.round("prob", 6))


def _mace_sql(n: int) -> str:
    parts = [_V, "th0 AS (SELECT model, CAST(0.8 AS double) AS th FROM mods)", "xi0 AS (SELECT model, k AS a, 1.0 / CAST(3 AS double) AS x FROM mods, ks)"]
    for i in range(n):
        parts += [
            f"vv{i} AS (SELECT v.*, th, (1 - th) * x AS g FROM v JOIN th{i} USING (model) JOIN xi{i} USING (model, a))",
            f"l{i} AS (SELECT item_id, k, sum(ln(CASE WHEN a = k THEN th ELSE 0 END + g + 1e-12)) AS l FROM vv{i}, ks GROUP BY item_id, k)",
            _SOFT.format(new=f"p{i}", old=f"l{i}"),
            f"gd{i} AS (SELECT model, a, t * th / (th + g + 1e-12) AS good FROM vv{i} v JOIN p{i} p ON v.item_id = p.item_id AND v.a = p.k)",
            f"th{i + 1} AS (SELECT model, least(greatest((0.5 + sum(good)) / (1.0 + count(*)), 0.01), 0.99) AS th FROM gd{i} GROUP BY model)",
            f"sp{i} AS (SELECT m.model, ks.k AS a, CAST(0.5 AS double) / 3 + coalesce(s, 0) AS s FROM mods m CROSS JOIN ks LEFT JOIN (SELECT model, a, sum(1 - good) AS s FROM gd{i} GROUP BY model, a) x ON x.model = m.model AND x.a = ks.k)",
            f"xi{i + 1} AS (SELECT model, a, s / sum(s) OVER (PARTITION BY model) AS x FROM sp{i})",
        ]
    return ",\n".join(parts)


@query(f"{_mace_sql(3)} {_TOP.format(t='p2')}")
def mace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three iterations; the posterior is the one before the last update of the models."""
    return crowd.crowd_labels(votes.valid(annotations(spark, sf_dir)), LABELS, "mace", n_iter=3).withColumn("prob", F.round("prob", 6))


@query(f"""{_V}, l0 AS (SELECT item_id, k, sum(ln(CASE WHEN a = k THEN 1 / (1 + exp(-1.0)) ELSE (1 - 1 / (1 + exp(-1.0))) / 2 END + 1e-12)) AS l FROM v, ks GROUP BY item_id, k),
{_SOFT.format(new='p0', old='l0')} {_TOP.format(t='p0')}""")
def glad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first posterior; the gradient steps are tested against plain Python."""
    return crowd.crowd_labels(votes.valid(annotations(spark, sf_dir)), LABELS, "glad", n_iter=1).withColumn("prob", F.round("prob", 6))


@query()
def mace_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACE with the operator's own number of iterations."""
    return crowd.crowd_labels(votes.valid(annotations(spark, sf_dir)), LABELS, "mace")


@query()
def glad_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GLAD with the operator's own number of iterations, difficulty and skill included."""
    return crowd.crowd_labels(votes.valid(annotations(spark, sf_dir)), LABELS, "glad")


@query()
def crowd_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill of each model by each converged crowd model."""
    models, out = crowd.Crowd(votes.valid(annotations(spark, sf_dir)), LABELS, kept=False), None
    for m in crowd.METHODS:
        part = models.skill(m).select(F.lit(m).alias("method"), "model", F.round("skill", 6).alias("skill"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""{_ds_sql(3)}, ds AS ({_TOP.format(t='t3')}),
maj AS (SELECT item_id, label, cnt FROM (SELECT item_id, label, count(*) AS cnt, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, sum(confidence) DESC, min(model_ord)) AS rk
  FROM ann WHERE error IS NULL AND label IS NOT NULL GROUP BY item_id, label) WHERE rk = 1)
SELECT m.item_id, m.label AS vote_label, ds.label AS crowd_label, round(ds.prob, 3) AS prob, m.label = ds.label AS same FROM maj m JOIN ds USING (item_id)""")
def ds_vs_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority vote beside three iterations of Dawid-Skene, which SQL can unroll."""
    return _beside_vote(spark, sf_dir, dawid_skene(spark, sf_dir))


@query()
def ds_vs_pipeline_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority vote beside converged Dawid-Skene."""
    return _beside_vote(spark, sf_dir, dawid_skene_converged(spark, sf_dir))


def _beside_vote(spark: SparkSession, sf_dir: str, ds: DataFrame) -> DataFrame:
    ds = ds.select("item_id", F.col("label").alias("crowd_label"), F.round("prob", 3).alias("prob"))
    j = votes.majority(annotations(spark, sf_dir)).select("item_id", F.col("label").alias("vote_label")).join(ds, "item_id")
    return j.withColumn("same", F.col("vote_label") == F.col("crowd_label"))
