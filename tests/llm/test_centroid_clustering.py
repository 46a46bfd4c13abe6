"""Yinyang passes against measuring every distance."""

import hashlib

import numpy as np
import pytest

from concordat.llm import centroid_clustering as cc
from concordat.llm.queries import QUERIES


def plain(rows, k=cc.CENTROIDS, rounds=cc.ROUNDS, dim=cc.DIM):
    """(vec_id, cluster, distance, ...) of kept rows in Python's integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    packed = lambda v: np.array(v, "<i4" if all(-(2**31) < x < 2**31 for x in v) else "<i8").tobytes()
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", packed(r[1])))
    at = [list(v) for _, v in order[:k]]
    for r in range(rounds + 1):
        found = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(at)) for _, v in kept]
        if r < rounds:
            for j in range(len(at)):
                mine = [v for (_, v), f in zip(kept, found, strict=True) if f[1] == j]
                if mine:
                    at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    fits = lambda x: x if x is not None and x < 2**63 else None
    inertia = {j: fits(sum(f[0] for f in found if f[1] == j)) for j in {f[1] for f in found}}
    total = fits(sum(f[0] for f in found))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, f[1], fits(f[0]), inertia[f[1]], total, digest[f[1]]) for (i, _), f in zip(kept, found, strict=True)), key=str)


def run(spark, path, rows, extra=False):
    schema = "vec_id bigint, embedding array<float>" + (", cluster string, V int" if extra else "")
    spark.createDataFrame([(*r, "x", 1) if extra else r for r in rows], schema).repartition(3).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r) for r in QUERIES["op11_centroid_clustering"](spark, str(path)).collect()), key=str)


def test_small_numbers_and_ties(spark, tmp_path):
    """Few distinct components: many vectors lie as near to several centroids."""
    rnd = np.random.default_rng(3)
    rows = [(int(i), (rnd.integers(-2, 3, 64) / 256 * (rnd.random(64) < 0.1)).astype(np.float32).tolist()) for i in range(700)]
    rows += rows[:40] + [(900 + i, rows[5][1]) for i in range(200)]
    assert run(spark, tmp_path, rows, True) == plain(rows)


def test_clustered_and_unfit(spark, tmp_path):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 64))
    rows = [(i, (centres[i % 12] + 0.3 * rnd.normal(size=64)).astype(np.float32).tolist()) for i in range(400)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63]
    rows += [(1000 + i, v) for i, v in enumerate(bad)] + [(None, rows[3][1]), (7, rows[9][1])]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_large_numbers(spark, tmp_path):
    """Beyond the range where doubles are exact, and a distance that no long holds."""
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.normal(size=64) * 10.0 ** rnd.integers(0, 8)).astype(np.float32).tolist()) for i in range(90)]
    assert run(spark, tmp_path, rows) == plain(rows)
    rows.append((500, [float(np.float32(3e12))] * 64))
    rows.append((501, [-float(np.float32(3e12))] * 64))
    got = run(spark, tmp_path, rows)
    assert got == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few(spark, tmp_path, n):
    rows = [(i, [float(i + j) for j in range(64)]) for i in range(n)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_bounds_hold_and_save_work():
    """After each pass every bound holds, and the filters measure fewer distances than there are."""
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(40, 64)) * 300
    a = (centres[rnd.integers(0, 40, 3000)] + 60 * rnd.normal(size=(3000, 64))).astype(np.int64)
    at = a[:40].copy()
    group = cc.grouped(at)
    c = cc.Centroids(at, group, np.zeros(40))
    cluster, upper, lower = cc.first_pass(a, c)
    for _ in range(5):
        new = np.array([a[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else at[j] for j in range(40)])
        moved = cc.roots(cc.pair_distances(new, at, True)) * (1 + cc.SLACK)
        at = new
        c = cc.Centroids(at, group, moved)
        cluster, upper, lower, measured = cc.later_pass(a, cluster, upper, lower, c)
        d = cc.all_distances(a, at, True)
        assert (cluster == d.argmin(1)).all()
        far = np.sqrt(d.astype(float))
        assert (upper >= far[np.arange(3000), cluster]).all()
        far[np.arange(3000), cluster] = np.inf
        for g, m in enumerate(c.members):
            assert (lower[:, g] <= far[:, m].min(1)).all()
        assert measured < 0.5 * d.size
