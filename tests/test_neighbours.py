"""Nearest vectors in tiles, and posteriors without a row for each label."""

import numpy as np
import pytest
from conftest import SF

from concordat.operators import neighbours
from concordat.plans.calibration import crossfit
from concordat.plans.catalogue import QUERIES


def test_tiles_keep_the_best(spark, monkeypatch):
    """Tiles and blocks of few rows, copies whose ties go by id, and a vector of length 0."""
    monkeypatch.setattr(neighbours, "TILE", 4)
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 6))
    v[7], v[30:36] = 0, v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(3)
    got = {(r["query"], r["rank"]): (r["neighbour"], r["sim"]) for r in neighbours.by_cosine(rows, rows.where("vec_id % 3 = 0"), 5).collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for q in range(0, 40, 3):
        sims = sorted((-round(float(unit[q] @ unit[j]), 9), j) for j in range(40) if j != q)[:5]
        assert [got[q, r][0] for r in range(1, 6)] == [j for _, j in sims]
    assert len(got) == 14 * 5


def test_crossfit_has_a_row_an_item(spark):
    plan = crossfit(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(item_id" not in plan


@pytest.mark.parametrize("most", [0, 8])
def test_every_row_as_query(spark, monkeypatch, most):
    """By the grid and by broadcast blocks, with rows that have no neighbour in their own part and vectors that aren't finite."""
    for name, x in {"MOST_BLOCKS": most, "TILE": 4, "BLOCK": 7, "PART": 9, "GRID_BLOCK": 11}.items():
        monkeypatch.setattr(neighbours, name, x)
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(50, 3)))
    v[9] = np.nan
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {(r["query"], r["rank"]): (r["neighbour"], r["sim"]) for r in neighbours.by_cosine(rows, rows, 6).collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    assert len(got) == 49 * 6
    for q in set(range(50)) - {9}:
        sims = sorted((-round(float(unit[q] @ unit[j]), 9), j) for j in range(50) if j not in (q, 9))[:6]
        assert [got[q, r][0] for r in range(1, 7)] == [j for _, j in sims]


def test_label_hit_asks_every_vector(spark):
    """Before, every fiftieth vector only."""
    assert QUERIES["knn_label_hit"](spark, SF).first()["n"] == spark.read.parquet(f"{SF}/embeddings.parquet").count()
