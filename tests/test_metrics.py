"""McNemar's p at any count."""

import math

import pytest
from pyspark.sql import functions as F

from concordat.operators.metrics import normal_tail
from concordat.operators.metrics import mcnemar as p_of


def exact(a, b):
    m, k = a + b, min(a, b)
    if m == 0:
        return 1.0
    return min(1.0, 2 * float(sum(math.comb(m, i) for i in range(k + 1)) / (1 << m))) if m <= 1000 else min(1.0, 2 * math.fsum(math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) - m * math.log(2)) for i in range(max(0, k - 40000), k + 1)))


def got(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a bigint, b bigint")
    return [r[0] for r in df.select("i", p_of(F.col("a"), F.col("b")).alias("p")).orderBy("i").select("p").collect()]


def test_small_and_summed(spark):
    pairs = [(a, b) for a in (0, 1, 2, 5, 17, 40, 300) for b in (0, 1, 3, 16, 41, 333)] + [(1000, 1000), (990, 1010), (1100, 900), (2000, 0), (1, 1999), (24000, 25900), (24950, 25000)]
    for p, (a, b) in zip(got(spark, pairs), pairs, strict=True):
        assert p == pytest.approx(exact(a, b), rel=1e-8, abs=1e-300), (a, b)


def test_large(spark):
    """The tail by saddlepoint against the sum, then counts that no array could hold."""
    pairs = [(25_000, 25_400), (30_000, 30_001), (50_000, 51_500), (100_000, 100_700), (40_000, 60_000)]
    for p, (a, b) in zip(got(spark, pairs), pairs, strict=True):
        assert p == pytest.approx(exact(a, b), rel=2e-5, abs=1e-300), (a, b)
    p = got(spark, [(3 * 10**9, 3 * 10**9), (3 * 10**9, 3 * 10**9 + 150_000), (3 * 10**9, 3 * 10**9 + 400_000), (1, 3 * 10**9)])
    assert p[0] == 1.0 and p[3] == 0.0
    z = [149_999 / math.sqrt(6e9 + 150_000), 399_999 / math.sqrt(6e9 + 400_000)]
    assert p[1:3] == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z], rel=1e-4)


def test_normal_tail(spark):
    w = [0.0, 0.3, 1.0, 2.5, 2.99, 3.0, 4.0, 8.0, 20.0]
    rows = spark.createDataFrame(list(enumerate(w)), "i int, w double").select("i", normal_tail(F.col("w")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in rows] == pytest.approx([math.erfc(x / math.sqrt(2)) / 2 for x in w], rel=1e-9)
