"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math

import pytest

from concordat.llm import (
    decontamination,
    html_extraction,
    jaccard_join,
    language_id,
    quality_classifier,
    quality_rules,
    source_mixing,
    suffix_dedup,
    token_counts,
    url_filters,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, sig long, tokens string, lo long, _lo string, mix_slot int, item_id long, n int"
LONG = "abc def ghi jkl " * 20_000
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG), (6, "x" * 100_000), (7, "same text " * 30), (7, "same text " * 30),
    (8, "same text " * 30), (None, "same text " * 30), (None, None), (9, "Ünïcödé 日本語   text " * 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i else None, "a" if (i or 0) % 2 else None, 0, 0.5, 1, 2, "t", 3, "l", 4, 5, 6) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_tokens(docs, empty):
    v = token_counts.Vocabulary((("▁", -1.0), ("▁one", -2.0), ("o", -3.0), ("a", -3.0)), False)
    got = {r[0]: r[1] for r in token_counts.token_counts(docs, v).collect() if r[0]}
    assert (got[1], got[2], got[4]) == (0, 0, 1) and got[5] > 0
    assert token_counts.token_counts(empty, v).count() == 0


def test_quality(docs, empty, labels):
    model = quality_classifier.train(docs, labels)
    rows = quality_classifier.quality_scores(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r[1] <= 1 for r in rows)
    assert quality_classifier.accepted(docs, model).columns == docs.columns
    assert quality_classifier.quality_scores(empty, quality_classifier.train(empty, labels)).count() == 0
    rules = quality_rules.train(docs, labels)
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, rules).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"] and got[7]["base_failed"]
    assert quality_rules.apply_rules(empty, rules).count() == 0


def test_more_languages_than_a_word_has_bits(spark):
    """Every language of the training rows is learned, the rarest ones too."""
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26) + "qxz"[i % 3]
    rows = [(i, f"l{i:03}", f"{word(i)}{word(i + 1)} {word(i)} " * (3 + 130 - i)) for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = language_id.learn(docs)
    assert filters.langs == [r[1] for r in rows]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, filters).collect()}
    assert got == {i: x for i, x, _ in rows}


def test_language(docs, empty):
    filters = language_id.learn(docs.where("doc_id <> 9"))
    got = {r[0]: r for r in language_id.identify(docs, filters).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[4]["lang_pred"] == "en"
    none = language_id.learn(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, filters).count() == 0


def test_suffix(docs, empty):
    rows = suffix_dedup.digest(docs, suffix_dedup.lost_ranges(docs)).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert got[1]["n_bytes"] == 0 and got[7]["n_removed"] == 290 and got[8]["n_removed"] == 300 and got[6]["n_removed"] == 100_000 - 1
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id IS NULL").count() == 2
    assert suffix_dedup.digest(empty, suffix_dedup.lost_ranges(empty)).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "same text " * 5), (2, None), (3, ""), (4, "short"), (1, "same text " * 5)], "item_id long, text string")
    got = {(r[0], r[1]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(7, 1), (8, 1)}
    left = decontamination.uncontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>a &amp; b<br>c</p><<>><p"), (3, "u", "no markup"), (None, "u", "<article><p>x")], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extraction.extract(pages).collect()]
    assert got[0] == (1, "", 0) and got[1] == (2, "", 0) and got[3][1] == "no markup" and got[4][1] == "x"
    assert got[2][1].startswith("a & b c")


def test_urls_of_many_path_lengths(spark):
    """Full URLs of 600 path lengths, none within another, all listed but for one."""
    paths = [(i, f"/{i:03}" + "p" * i) for i in range(600)]
    pages = spark.createDataFrame([(i, f"http://a.com{p}") for i, p in paths], "page_id long, url string")
    listed = spark.createDataFrame([(f"a.com{p}",) for i, p in paths if i], "entry string")
    rules = spark.createDataFrame([], "entry string, action string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.url_verdicts(pages, rules, listed).collect()}
    assert got == {i: "block" if i else "allow" for i, _ in paths}


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "nothing"), (3, "HTTP://A.Com"), (4, "http://x.spam.com/"), (4, "http://x.spam.com/"), (None, "http://a.b.net/es/x?y")], "page_id long, url string")
    rules = spark.createDataFrame([("net/es/", "block"), ("net/es/", "allow"), (None, "block")], "entry string, action string")
    listed = spark.createDataFrame([("spam.com/",), ("spam.com/",), (None,)], "entry string")
    got = sorted(tuple(r) for r in url_filters.url_verdicts(pages, rules, listed).collect() if r[0])
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.com", "", None, "allow"), *[(4, "x.spam.com", "/", None, "block")] * 2]
    null = url_filters.url_verdicts(pages, rules, listed).where("page_id IS NULL").first()
    assert (null["rule"], null["verdict"]) == ("net/es/", "block")
    assert url_filters.url_verdicts(pages.limit(0), rules, listed).count() == 0


def test_jaccard(docs, empty):
    rows = [tuple(r) for r in jaccard_join.linked_components(docs).collect()]
    assert len(rows) == len(ROWS)
    got = {r[0]: r[1:] for r in rows if r[0]}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[4] == (1, 4) and got[7] == got[8] == (2, 7) and got[5] == (4, 5)
    assert sorted(r[1:] for r in rows if r[0] is None) == [(0, None), (2, 7)] or sorted((r[1], r[2] or 0) for r in rows if r[0] is None) == [(0, 0), (2, 7)]
    kept = jaccard_join.first_of_groups(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id IS NULL").count() == 2
    assert jaccard_join.linked_components(empty).count() == 0


def test_mixing(docs, empty):
    out = source_mixing.mixed(docs)
    assert sorted(r["mix_position"] for r in out.collect()) == list(range(len(ROWS)))
    assert out.columns == [f"{c}_before" if c == "mix_slot" else c for c in docs.columns] + list(source_mixing.COLUMNS)
    more = source_mixing.mixed(docs.withColumn("mix_own", docs.n).withColumn("mix_slot_before", docs.n))
    assert {"mix_own", "mix_slot_before", "mix_slot_before_"} <= set(more.columns) and {r["mix_slot_before_"] for r in more.collect()} == {4}
    assert source_mixing.mixed(docs, keep=["doc_id"]).columns == ["doc_id", *source_mixing.COLUMNS]
    assert source_mixing.mixed(empty).count() == 0
    tail = source_mixing.mixed(docs, {"a": 1.0}, block=1).where("mix_source IS NULL").agg({"mix_slot": "min"}).first()[0]
    assert tail == docs.where("source = 'a'").count()


def test_quantiles():
    assert math.isfinite(quality_classifier.fit(__import__("numpy").zeros((0, 3)), __import__("numpy").zeros(0)).intercept)
