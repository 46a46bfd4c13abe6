"""Steps that several queries share are done once, and nothing large is moved twice."""

import re

from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from concordat.operators import crowd, local_model, reshape
from concordat.plans.crowd import crowd_skill
from concordat.sources.tables import LABELS, annotations, by_key


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_are_dealt_once(spark):
    assert plan(annotations(spark, SF).groupBy("item_id").agg(F.max("label"))).count("Exchange") == 1


def test_parts_grow_with_the_table(spark):
    usual = by_key(spark.range(100), "id")
    assert "REPARTITION_BY_COL" in plan(usual)
    assert by_key(spark.range(0, 1000, 1, 20), "id").rdd.getNumPartitions() == 160


def test_patterns_are_no_shuffle_key(spark):
    v = spark.createDataFrame([(i, f"m{j}", "A" if (i + j) % 3 else "N") for i in range(30) for j in range(3)], "item_id bigint, model string, label string")
    p = plan(crowd.crowd_labels(v, LABELS, "wawa"))
    assert "BroadcastHashJoin" in p and "hashpartitioning(pattern" not in p


def test_patterns_are_counted_once(spark, monkeypatch):
    calls, real = [], crowd.counted
    monkeypatch.setattr(crowd, "counted", lambda *a: calls.append(1) or real(*a))
    assert crowd_skill(spark, SF).count() == 16
    assert len(calls) == 1


def test_gain_reads_texts_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} words {i}", i % 2) for i in range(200)], "seq bigint, text string, label int").coalesce(2)
    rows = rows.withColumn("text", F.udf(tell, StringType()).asNondeterministic()("text"))
    got = [tuple(r) for r in local_model.gain(rows, [20, 50], 30).collect()]
    assert [x[:3] for x in got] == [(0, 30, 120), (20, 50, 120), (50, 80, 120)] and seen.value <= 2 * 200


def test_paragraph_texts_are_moved_once(spark):
    b = spark.createDataFrame([(d, i, i // 2, "Running header" if i % 4 == 0 else f"some words of line {i} of {d}", i == 1) for d in range(3) for i in range(20)], "doc bigint, pos int, page int, text string, heading boolean")
    out = reshape.paragraphs(b, min_chars=5)
    assert len(re.findall(r"Exchange hashpartitioning\(doc#\d+L, \d+\), REPARTITION", plan(out))) == 1
    assert not re.search(r"SortMergeJoin \[doc#\d+L, flat", plan(out))
    assert {r["text"] for r in out.collect()}.isdisjoint({"Running header"}) and out.count() == 3 * 14
