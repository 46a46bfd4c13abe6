"""Rule search against trying everything, merging of scanned lines against a plain loop, curves against their definitions."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from concordat.operators import calibration, reshape, rule_search



def rules():
    return {"a": F.when(F.col("x") % 2 == 0, "1"), "b": F.when(F.col("x") % 3 == 0, "0"), "c": F.when(F.col("x") > 40, "1"), "d": F.when(F.col("x") < 12, "0")}


PLAIN = {"a": lambda x: "1" if x % 2 == 0 else None, "b": lambda x: "0" if x % 3 == 0 else None, "c": lambda x: "1" if x > 40 else None, "d": lambda x: "0" if x < 12 else None}


def plain_score(rows, variant):
    return sum(next((y for r in variant if (y := PLAIN[r](x)) is not None), "0") == g for x, g in rows if g is not None)


def test_rule_search(spark):
    rnd = random.Random(1)
    truth = lambda x: next((y for r in "dca" if (y := PLAIN[r](x)) is not None), "0")
    rows = [(x, truth(x) if rnd.random() < 0.9 else rnd.choice("01")) for x in range(60)] + [(3, None)]
    df = spark.createDataFrame(rows, "x int, gold string")
    out = rule_search.search(df, df.where("x % 4 = 0"), rules(), ("b",), "gold", "0").collect()
    for r in out:
        some = rows if r["part"] == "tuning" else [x for x in rows if x[0] % 4 == 0]
        assert (r["n"], r["correct"]) == (sum(g is not None for _, g in some), plain_score(some, r["rules"].split(",") if r["rules"] else []))
    best, tried = ("b",), {("b",): plain_score(rows, ("b",))}  # the same search, plainly
    while new := [v for v in rule_search.proposals(list(PLAIN), best) if v not in tried]:
        tried |= {v: plain_score(rows, v) for v in new}
        top = max(new, key=tried.get)
        if tried[top] <= tried[best]:
            break
        best = top
    assert {r["rules"] for r in out if r["winner"]} == {",".join(best)}
    assert {tuple(r["rules"].split(",")) if r["rules"] else () for r in out if r["part"] == "tuning"} == set(tried)
    every = [v for n in range(5) for v in itertools.permutations(PLAIN, n)]
    assert max(plain_score(rows, v) for v in every) == tried[best]
    assert sum(r["part"] == "held out" for r in out) == len({("b",), best})


def test_rule_search_without_rows(spark):
    df = spark.createDataFrame([], "x int, gold string")
    out = rule_search.search(df, df, rules(), (), "gold", "0").collect()
    assert all(r["n"] == 0 and r["accuracy"] is None for r in out)


def test_merged_lines(spark):
    rnd = random.Random(6)
    rows = []
    for page in range(12):
        top = 0.0
        for _ in range(rnd.randint(0, 25)):
            top += rnd.choice([0.0, 5.0, 12.0, 20.0, 31.0])
            rows.append((page, top, top + rnd.choice([2.0, 10.0, 18.0]), rnd.choice([0.0, 50.0]), rnd.choice(["abc", "  ", "d e", "x", None]), rnd.choice([0.4, 0.5, 0.9, None])))
    rows += rows[:6]
    want = {}
    for page in range(12):
        kept = sorted((t, b, x, s.strip()) for p, t, b, x, s, score in rows if p == page and s and s.strip() and (1.0 if score is None else score) >= 0.5)
        parts, end, height = [], None, 16.0
        for t, b, _, s in kept:
            if end is not None and t - end > max(0.8 * height, 10):
                parts.append("")
            if end is None:
                parts.append("")
            parts[-1] += s
            end, height = b, max(b - t, 8.0)
        for i, p in enumerate(parts, 1):
            want[page, i] = p
    df = spark.createDataFrame(rows, "page int, top double, bottom double, left double, text string, score double")
    got = {(r["page"], r["n"]): r["text"] for r in reshape.merged_lines(df).collect()}
    assert {k: v.replace(" ", "") for k, v in got.items()} == {k: v.replace(" ", "") for k, v in want.items()} and len(got) > 20
    assert reshape.merged_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_is_the_least_squares_fit(seed):
    """The definition: each point's value is the largest, over starts up to it, of the least mean over ends from it on."""
    rng = np.random.default_rng(seed)
    m = 25
    x, n = np.arange(m) / m, rng.integers(1, 6, m).astype(float)
    y = np.array([rng.integers(0, k + 1) for k in n], float)
    mean = lambda i, j: y[i : j + 1].sum() / n[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(p, m)) for i in range(p + 1)) for p in range(m)]
    base = y.sum() / n.sum()
    for lo, hi, value in calibration.pav(x, y, n):
        inside = (x >= lo) & (x <= hi)
        assert np.ptp(np.array(want)[inside]) < 1e-12
        assert value == pytest.approx((y[inside].sum() + 2 * base) / (n[inside].sum() + 2))
        assert y[inside].sum() / n[inside].sum() == pytest.approx(want[int(np.flatnonzero(inside)[0])])


def test_choice_of_a_curve():
    """None where confidences are right; else the curve whose error over both halves is least, computed row by row."""
    rng = np.random.default_rng(2)
    x = np.round(rng.random(400), 2)
    rows = pd.DataFrame({"x": x, "y": (rng.random(400) < x**3).astype(float), "n": 1.0, "half": rng.integers(0, 2, 400)})
    method, curve = calibration.choose_curve(rows)
    error = {}
    for m in ("isotonic", "platt"):
        error[m] = 0.0
        for h in (0, 1):
            train, test = rows[rows["half"] == h].groupby("x", as_index=False)[["y", "n"]].sum(), rows[rows["half"] != h]
            f = calibration.pav if m == "isotonic" else calibration.platt
            c = f(*(train[k].to_numpy() for k in ("x", "y", "n")))
            error[m] += sum((calibration.apply_curve(m, c, np.array([a]))[0] - b) ** 2 for a, b in zip(test["x"], test["y"], strict=True))
    assert method == min(error, key=error.get) and curve
    right = pd.DataFrame({"x": [0.25, 0.75], "y": [25.0, 75.0], "n": [100.0, 100.0], "half": [0, 1]})
    assert calibration.choose_curve(right)[0] == "none"
