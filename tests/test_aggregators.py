"""The comparison of aggregators against plain Python: folds, weights, confusion and calibrated confidence."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from conftest import SF

from concordat.operators import calibration
from concordat.plans.catalogue import QUERIES
from concordat.sources.tables import LABELS, annotations, gold


def fold(i):
    return int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 5


def curve(points):
    """A function of confidence, fitted to (id, confidence, right)."""
    rows = pd.DataFrame([(round(x, 4), float(y), 1.0, zlib.crc32(str(i).encode()) % 2) for i, x, y in points], columns=["x", "y", "n", "half"])
    method, c = calibration.choose_curve(rows.groupby(["x", "half"], as_index=False).sum())
    return lambda x: round(float(calibration.apply_curve(method, c, pd.Series([round(x, 4)]).to_numpy())[0]), 4)


def plain(spark):
    g = {r["item_id"]: r["gold"] for r in gold(spark, SF).collect()}
    ann = defaultdict(list)
    for r in annotations(spark, SF).where("item_id IS NOT NULL").collect():
        ann[r["item_id"]].append(r)
    items = [i for i in ann if i in g]
    models = sorted({r["model"] for i in items for r in ann[i]})
    ok = lambda r: r["error"] is None and r["label"] is not None
    out = {m: {} for m in ("weighted", "posterior", "calibrated")}
    scaled = 0
    for f in range(5):
        train = [i for i in items if fold(i) != f]
        prior = {k: (sum(g[i] == k for i in train) + 1) / (len(train) + 3) for k in LABELS}
        weight, confusion, acc, curves = {}, {}, {}, {}
        for m in models:
            mine = [(i, r) for i in train for r in ann[i] if r["model"] == m]
            valid = [(i, r) for i, r in mine if ok(r)]
            a = sum(r["label"] == g[i] for i, r in valid) / max(1, len(mine))
            a = min(max(a, 1 / 3 + 0.01), 0.99)
            weight[m] = round(max(math.log(a * 2 / (1 - a)), 0.05), 3)
            n = Counter((g[i], r["label"]) for i, r in valid)
            confusion[m] = {(k, x): (n[k, x] + 1) / (sum(n[k, y] for y in LABELS) + 3) for k in LABELS for x in LABELS}
            points = [(i, r["confidence"], r["label"] == g[i]) for i, r in valid]
            acc[m] = sum(y for *_, y in points) / len(points)
            if len(points) >= 10:
                curves[m] = curve(points)
        for i in (x for x in items if fold(x) == f):
            valid = sorted((r for r in ann[i] if ok(r)), key=lambda r: r["model_ord"])
            if not valid:
                continue
            score = {}
            for r in valid:
                score[r["label"]] = score.get(r["label"], 0) + weight[r["model"]] * max(r["confidence"], 0.05)
            out["weighted"][i] = max(score, key=lambda k: round(score[k], 9))
            for name in ("posterior", "calibrated"):
                log = {k: math.log(prior[k]) for k in LABELS}
                for r in valid:
                    p, x = confusion[r["model"]], r["label"]
                    for k in LABELS:
                        like = p[k, x]
                        if name == "calibrated" and r["model"] in curves and acc[r["model"]]:
                            d = min(max(p[k, k] * curves[r["model"]](r["confidence"]) / acc[r["model"]], 0.01), 0.99)
                            like, scaled = d if k == x else (1 - d) * p[k, x] / max(1 - p[k, k], 1e-9), scaled + 1
                        log[k] += math.log(max(like, 1e-9))
                e = {k: math.exp(v - max(log.values())) for k, v in log.items()}
                out[name][i] = max(LABELS, key=lambda k, e=e: round(e[k] / sum(e.values()), 9))
    assert scaled
    return {name: round(sum(labels.get(i) == g[i] for i in items) / len(items), 6) for name, labels in out.items()}, len(items)


def test_compare_aggregators(spark):
    """Before, weights were fixed and no confidence was calibrated, and items that a model had not seen didn't count."""
    want, n = plain(spark)
    got = {r["strategy"]: r for r in QUERIES["compare_aggregators"](spark, SF).collect()}
    assert {r["n"] for r in got.values()} == {n}
    assert {name: got[name]["accuracy"] for name in want} == want
    assert sorted(r["place"] for r in got.values()) == list(range(1, len(got) + 1))


@pytest.mark.parametrize("right", [0, 4])
def test_no_scale_without_points(spark, right):
    """Under 10 points or without a right one in the other folds there is no scale."""
    rows = [("few", i % 5, i, 0.5, True) for i in range(11)] + [("wrong", i % 5, i, 0.5 + i % 2 / 4, i < right) for i in range(40)]
    points = spark.createDataFrame(rows, "model string, fold int, key long, x double, y boolean")
    got = {(r["model"], r["fold"], r["x"]): r["scale"] for r in calibration.crossfit_scales(points).collect()}
    assert set(got) == ({("wrong", f, x) for f in range(5) for x in (0.5, 0.75)} if right else set())
