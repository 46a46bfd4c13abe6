"""Crowd models with parameters in tables against the passes over patterns, and many annotators."""

import random

import pytest

from concordat.operators import crowd, crowd_keyed

LABELS = ["A", "N", "R"]


def votes(spark, items=60, workers=7, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(items):
        truth = rnd.choice(LABELS)
        for w in range(workers):
            if rnd.random() < 0.7:
                rows.append((i, f"m={w}", truth if rnd.random() < 0.5 + 0.06 * w else rnd.choice(LABELS)))
    rows += rows[:10] + [(900, "m=0", "other"), (901, "m=1", "A")]
    return spark.createDataFrame(rows, "item_id bigint, model string, label string")


@pytest.mark.parametrize("hot", [1000, 0])
@pytest.mark.parametrize("method, options", [("dawid_skene", {"n_iter": 4, "tol": 0}), ("wawa", {}), ("mace", {"n_iter": 2}), ("glad", {"n_iter": 1})])
def test_same_as_patterns(spark, monkeypatch, method, options, hot):
    """``hot`` 0: no annotator counts as frequent, so all are joined by shuffling."""
    monkeypatch.setattr(crowd_keyed, "HOT_SHARE", hot)
    v = votes(spark)
    a = {r[0]: r[1:] for r in crowd.crowd_labels(v, LABELS, method, **options).collect()}
    b = {r[0]: r[1:] for r in crowd.crowd_labels(v, LABELS, method, workers=0, **options).collect()}
    assert a.keys() == b.keys() and 901 in a and 900 not in a
    for i in a:
        assert a[i][0] == b[i][0] and a[i][1] == pytest.approx(b[i][1], abs=1e-7)
    if hot:
        s = {r[0]: r[1] for r in crowd.worker_skill(v, LABELS, method, **options).collect()}
        t = {r[0]: r[1] for r in crowd.worker_skill(v, LABELS, method, workers=0, **options).collect()}
        assert s == pytest.approx(t, abs=1e-7)


def test_many_annotators(spark):
    """100,000 annotators, three votes each, and one with as many as all others: more labels are right than by majority."""
    n = 100_000
    v = spark.range(3 * n).selectExpr("id % 60000 AS item_id", f"concat('w', id % {n}) AS model", "CASE WHEN crc32(cast(id AS string)) % 10 < 7 THEN 'A' ELSE 'N' END AS label")
    v = v.unionByName(spark.range(60_000).selectExpr("id AS item_id", "'hot' AS model", "'A' AS label"))
    out = crowd.crowd_labels(v, ["A", "N"], "dawid_skene", n_iter=1, tol=0)
    assert out.count() == 60_000 and out.where("label = 'A'").count() > 45_000


def test_nothing_to_count(spark):
    v = votes(spark).where("false")
    assert crowd.crowd_labels(v, LABELS, "mace").count() == 0 and crowd.worker_skill(v, LABELS, "mace").count() == 0
