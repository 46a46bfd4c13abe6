"""Edge rows of the operators, and the fitted ones against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.operators import calibration, crowd, merge, metrics, neighbours, reshape, routing, sampling, votes
from concordat.operators.routing import RoutingPolicy

ANN = "item_id long, model string, model_ord int, label string, confidence double, error string, evidence_ok boolean"


@pytest.fixture(scope="module")
def ann(spark):
    rows = [
        (1, "a", 0, "x", 0.5, None, None), (1, "b", 1, "y", 0.5, None, None),  # tie in count and confidence: first model
        (2, "a", 0, "x", 0.25, None, None), (2, "b", 1, "y", 0.5, None, None),  # tie broken by confidence
        (3, "a", 0, None, 0.9, "timeout", None), (3, "b", 1, "y", 0.0, None, None),  # a failed vote, confidence 0
        (4, "a", 0, None, 0.9, "timeout", None),  # no valid vote
        (5, "a", 0, "x", 1.0, None, False), (5, "b", 1, "y", 0.75, None, None),  # refuted evidence halves
        (6, "a", 0, "x", 0.5, None, None), (6, "b", 1, "x", 0.5, None, True), (6, "c", 2, None, 0.5, "bad", None),
    ]
    return spark.createDataFrame(rows, ANN)


def by_id(df, *columns):
    return {r["item_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_majority(ann):
    assert by_id(votes.majority(ann), "label") == {1: "x", 2: "y", 3: "y", 5: "x", 6: "x"}


def test_weighted(ann):
    got = by_id(votes.weighted(ann, {}), "label", "share", "agree", "total")
    assert got[5][0] == "y" and got[3] == ("y", 1.0, 1, 1) and got[1][0] == "x" and got[6][2:] == (2, 2)


def test_jury_counts_failures(ann):
    assert by_id(votes.jury(ann), "confidence")[6] == pytest.approx(0.667)


def test_routing(ann):
    got = by_id(routing.route(ann, {}, RoutingPolicy()), "label", "status")
    assert got[6] == ("x", "consensus") and got[1] == ("x", "need_human") and got[4] == (None, "need_human")
    with pytest.raises(ValueError):
        RoutingPolicy(action="other")
    with pytest.raises(ValueError):
        RoutingPolicy(accept_threshold=2)


def test_disagreement_counts_failures(ann):
    got = by_id(votes.disagreement(ann), "disagree")
    assert got[6] and got[3] and got[1]


def test_empty(spark, ann):
    none = ann.limit(0)
    assert votes.majority(none).count() == votes.weighted(none, {}).count() == routing.route(none, {}, RoutingPolicy()).count() == 0
    assert metrics.fleiss_kappa(none, 2).first()["kappa"] is None
    assert crowd.crowd_labels(none, ["x", "y"], "mace").count() == 0


def test_kappa_of_full_agreement(spark):
    v = spark.createDataFrame([(i, m, "x") for i in range(4) for m in "ab"], "item_id long, model string, label string")
    assert metrics.fleiss_kappa(v, 2).first()["kappa"] == 1.0


@pytest.mark.parametrize(("a", "b"), [(0, 0), (1, 0), (3, 9), (8, 8), (40, 900)])
def test_mcnemar(spark, a, b):
    m, k = a + b, min(a, b)
    want = 1.0 if not m else min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m)
    got = spark.range(1).select(metrics.mcnemar(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))).first()[0]
    assert got == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_fold_is_md5(spark):
    import hashlib

    got = spark.range(200).select("id", calibration.fold_of(F.col("id"), 7).alias("f")).collect()
    assert all(r["f"] == int(hashlib.md5(str(r["id"]).encode()).hexdigest(), 16) % 7 for r in got)


def test_ece_last_bin_closed(spark):
    p = spark.createDataFrame([(1.0, True), (0.95, False)], "x double, y boolean")
    assert calibration.ece(p).first()["ece"] == pytest.approx(0.475)


def test_pav():
    blocks = calibration.pav(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 0, 3, 4]), np.array([2.0, 2, 4, 4]))
    assert [b[:2] for b in blocks] == [(0.1, 0.2), (0.3, 0.3), (0.4, 0.4)]
    values = [b[2] for b in blocks]
    assert values == sorted(values)
    got = calibration.apply_curve("isotonic", blocks, np.array([0.05, 0.25, 0.99]))
    assert list(got) == [values[0], values[1], values[2]]


def test_platt_recovers():
    rng = np.random.default_rng(0)
    x = rng.uniform(0.05, 0.95, 4000)
    p = 1 / (1 + np.exp(-(0.5 * np.log(x / (1 - x)) + 0.4)))
    a, b = calibration.platt(x, (rng.uniform(size=4000) < p).astype(float), np.ones(4000))
    assert abs(a - 0.5) < 0.1 and abs(b - 0.4) < 0.1


def plain_dawid_skene(rows, labels, n_iter):
    items, workers = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    t = {i: [sum(r[0] == i and r[2] == k for r in rows) for k in labels] for i in items}
    t = {i: [c / sum(v) for c in v] for i, v in t.items()}
    for _ in range(n_iter):
        prior = [(sum(t[i][k] for i in items) + 0.01) / (len(items) + 0.01 * len(labels)) for k in range(len(labels))]
        conf = {}
        for w in workers:
            for k in range(len(labels)):
                row = [0.01 + sum(t[i][k] for i, v, a in rows if v == w and a == x) for x in labels]
                conf[w, k] = [c / sum(row) for c in row]
        for i in items:
            s = [math.log(prior[k]) + sum(math.log(conf[w, k][labels.index(a)]) for j, w, a in rows if j == i) for k in range(len(labels))]
            e = [math.exp(x - max(s)) for x in s]
            t[i] = [x / sum(e) for x in e]
    return {i: max(v) for i, v in t.items()}


def test_dawid_skene(spark):
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 3, 60)
    rows = [(i, f"w{w}", "xyz"[truth[i] if rng.uniform() < 0.5 + w / 8 else rng.integers(0, 3)]) for i in range(60) for w in range(4) if rng.uniform() < 0.9]
    df = spark.createDataFrame([(int(i), w, a) for i, w, a in rows], "item_id long, model string, label string")
    got = {r["item_id"]: r["prob"] for r in crowd.crowd_labels(df, list("xyz"), "dawid_skene", n_iter=6, tol=0).collect()}
    want = plain_dawid_skene(rows, list("xyz"), 6)
    assert got == pytest.approx(want, abs=1e-9)


def plain_posterior(rows, labels, log_likelihood):
    out = {}
    for i in {r[0] for r in rows}:
        s = [sum(log_likelihood(i, w, a, k) for j, w, a in rows if j == i) for k in labels]
        e = [math.exp(x - max(s)) for x in s]
        out[i] = {k: x / sum(e) for k, x in zip(labels, e, strict=True)}
    return out


def plain_mace(rows, labels, n_iter):
    """Item by item, as the reference states it."""
    workers = {r[1] for r in rows}
    theta, xi = dict.fromkeys(workers, 0.8), {(w, a): 1 / len(labels) for w in workers for a in labels}
    for _ in range(n_iter):
        post = plain_posterior(rows, labels, lambda i, w, a, k: math.log(theta[w] * (a == k) + (1 - theta[w]) * xi[w, a] + 1e-12))
        good = [(w, a, post[i][a] * theta[w] / (theta[w] + (1 - theta[w]) * xi[w, a] + 1e-12)) for i, w, a in rows]
        for w in workers:
            own = [(a, g) for v, a, g in good if v == w]
            theta[w] = min(max((0.5 + sum(g for _, g in own)) / (1 + len(own)), 0.01), 0.99)
            mass = {k: 0.5 / len(labels) + sum(1 - g for a, g in own if a == k) for k in labels}
            xi |= {(w, k): m / sum(mass.values()) for k, m in mass.items()}
    return {i: max(p.values()) for i, p in post.items()}


def plain_glad(rows, labels, n_iter, rate=0.1):
    """Item by item, as the reference states it."""
    alpha, logb = {r[1]: 1.0 for r in rows}, {r[0]: 0.0 for r in rows}
    right = lambda i, w: 1 / (1 + math.exp(-max(min(alpha[w] * math.exp(logb[i]), 30), -30)))
    for _ in range(n_iter):
        post = plain_posterior(rows, labels, lambda i, w, a, k: math.log((right(i, w) if a == k else (1 - right(i, w)) / (len(labels) - 1)) + 1e-12))
        for _ in range(5):
            up_a, up_b = {w: 1 - x for w, x in alpha.items()}, {i: -x for i, x in logb.items()}
            for i, w, a in rows:
                gap, b = post[i][a] - right(i, w), math.exp(logb[i])
                up_a[w] += gap * b
                up_b[i] += gap * alpha[w] * b
            alpha = {w: x + rate * up_a[w] for w, x in alpha.items()}
            logb = {i: max(min(x + rate * up_b[i], 3.0), -3.0) for i, x in logb.items()}
    return {i: max(p.values()) for i, p in post.items()}


@pytest.mark.parametrize(("name", "plain", "n_iter"), [("mace_converged", plain_mace, 50), ("glad_converged", plain_glad, 30)])
def test_registered_crowd_models_run_to_the_end(spark, monkeypatch, name, plain, n_iter):
    from concordat.plans import crowd as plans

    rng = np.random.default_rng(3)
    rows = [(i, f"w{w}", "ANR"[i % 3 if rng.uniform() < 0.5 + w / 10 else rng.integers(0, 3)]) for i in range(12) for w in range(4)]
    df = spark.createDataFrame(rows, "item_id long, model string, label string")
    monkeypatch.setattr(plans, "annotations", lambda *_: df)
    monkeypatch.setattr(plans.votes, "valid", lambda x: x)
    got = {r["item_id"]: r["prob"] for r in plans.__dict__[name](spark, "").collect()}
    assert got == pytest.approx(plain(rows, list("ANR"), n_iter), abs=1e-6)


def test_glad_and_mace_rank_workers(spark):
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 3, 300)
    right = (0.95, 0.8, 0.7, 0.6, 0.4)
    rows = [(int(i), f"w{w}", "xyz"[truth[i] if rng.uniform() < right[w] else rng.integers(0, 3)]) for i in range(300) for w in range(5)]
    df = spark.createDataFrame(rows, "item_id long, model string, label string")
    for method in crowd.METHODS:
        skill = {r["model"]: r["skill"] for r in crowd.worker_skill(df, ["x", "y", "z"], method).collect()}
        assert skill["w0"] > skill["w2"] > skill["w4"]


@pytest.mark.parametrize("method", ["dawid_skene", "wawa", "mace", "glad"])
def test_crowd_models_over_many_patterns(spark, method):
    """The same labels and skills whether patterns are on the driver or stay in a table."""
    rng = np.random.default_rng(5)
    rows = [(i, f"w={w}", "xyz"[i % 3 if rng.uniform() < 0.5 + w / 10 else rng.integers(0, 3)]) for i in range(40) for w in range(4) if rng.uniform() < 0.8]
    df = spark.createDataFrame(rows, "item_id long, model string, label string")
    options = {} if method == "wawa" else {"n_iter": 3}
    by_local = [{r[0]: (r[1], r[2]) for r in crowd.crowd_labels(df, list("xyz"), method, local=n, **options).collect()} for n in (1000, 0)]
    assert {i: x[0] for i, x in by_local[0].items()} == {i: x[0] for i, x in by_local[1].items()} and len(by_local[0]) == len({r[0] for r in rows})
    assert [x[1] for _, x in sorted(by_local[0].items())] == pytest.approx([x[1] for _, x in sorted(by_local[1].items())], abs=1e-9)
    skills = [{r[0]: r[1] for r in crowd.worker_skill(df, list("xyz"), method, local=n, **options).collect()} for n in (1000, 0)]
    assert skills[0] == pytest.approx(skills[1], abs=1e-9)


def test_glad_at_any_size(spark):
    """Skills stay in order and finite when the same votes come many times."""
    rng = np.random.default_rng(6)
    truth = rng.integers(0, 3, 4000)
    rows = [(int(i), f"w{w}", "xyz"[truth[i] if rng.uniform() < 0.9 - w / 5 else rng.integers(0, 3)]) for i in range(4000) for w in range(4)]
    skill = {r[0]: r[1] for r in crowd.worker_skill(spark.createDataFrame(rows, "item_id long, model string, label string"), list("xyz"), "glad").collect()}
    assert 10 > skill["w0"] > skill["w1"] > skill["w2"] > skill["w3"] > -1


def test_token_estimate_of_wide_characters(spark):
    df = spark.createDataFrame([("、。！？",), ("漢字䷀a",), ("",), ("abcdefghij",)], "t string")
    assert [r[0] for r in df.select(T.estimate_tokens(F.col("t"))).collect()] == [3, 3, 1, 4]


def test_labels(spark):
    r = spark.createDataFrame([("“Refund”",), ("refund",), ("it is Refund now",), ("Refund or Return",), ("other",), (None,)], "v string")
    got = [x[0] for x in r.select(T.normalize_label(F.col("v"), ["Refund", "Return"])).collect()]
    assert got == ["Refund", "Refund", "Refund", None, None, None]


def test_replies(spark):
    texts = ['{"label": "a", "confidence": 85}', '<think>{"label": "z"}</think>{"label": "b", "confidence": "0.3"}', '{"label": "c", "reason": "he "said" so"}', "nothing", '{"label": "d", "confidence": 500}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    label, confidence, reason = T.reply_fields(F.col("t"))
    got = [tuple(r) for r in df.select(label, confidence, reason).collect()]
    assert got == [("a", 0.85, ""), ("b", 0.3, ""), ("c", 0.5, 'he "said" so'), (None, 0.5, ""), ("d", 1.0, "")]


def test_tokens_of_cjk(spark):
    got = spark.createDataFrame([("中文ab",), ("",)], "t string").select(T.estimate_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [int(2 * 0.7 + 2 * 0.35) + 1, 1]


def test_transcripts(spark):
    df = spark.createDataFrame([(1, "hello\nuser: hi\n and more\n客服：ok\nnote http://x"), (2, " "), (3, "just text\ngoes on")], "id long, text string")
    got = [(r["id"], r["role"], r["text"]) for r in reshape.transcript_turns(df).orderBy("id", "turn").collect()]
    assert (1, "agent", "ok") in got and (3, "text", "just text\ngoes on") in got and (1, "note http", "//x") in got


def test_sessions(spark):
    rows = [(1, 0, "user", "aaaa", "2", "l"), (1, 1, "agent", "bb", "10", "l"), (2, 0, "user", "x" * 50, None, "l"), (2, 1, "user", "y" * 50, "1", "m"), (3, 0, "user", " ", None, None)]
    df = spark.createDataFrame(rows, "session_id long, seq long, role string, text string, time string, label string")
    got = {r["session_id"]: r for r in reshape.sessions(df, 60).collect()}
    assert got[1]["text"] == "agent: bb\nuser: aaaa" and got[1]["label"] == "l"  # times sort as text
    assert got[2]["omitted"] == 1 and got[2]["label"] is None and 3 not in got


def test_headings(spark):
    df = spark.createDataFrame([("第三章 风险",), ("1. Overview",), ("A sentence。",), ("",), ("x" * 50,)], "t string")
    assert [r[0] for r in df.select(reshape.is_heading(F.col("t"))).collect()] == [True, True, False, False, False]


def test_upsert(spark):
    have = spark.createDataFrame([("a", "x"), ("b", "y")], "text string, label string")
    new = spark.createDataFrame([(1, " a ", "z"), (2, "b", "y"), (3, "c", "q"), (4, "c", "r"), (5, " ", "s")], "seq long, text string, label string")
    got = {r["text"]: (r["label"], r["action"]) for r in merge.upsert(have, new).collect()}
    assert got == {"a": ("z", "updated"), "b": ("y", "unchanged"), "c": ("r", "added")}
    assert sorted(r["text"] for r in merge.append(have, new).where("is_new").collect()) == ["c"]


def test_split_and_take(spark):
    rows = spark.createDataFrame([(i, "a" if i < 7 else "b" if i < 9 else "c") for i in range(10)], "id long, label string")
    n = {(r["label"], r["part"]): r["count"] for r in sampling.split(rows, 0.5, "id", "label").groupBy("label", "part").count().collect()}
    assert n[("a", "dev")] == 4 and n[("b", "dev")] == 1 and n.get(("c", "dev"), 0) == 0  # halves round to even
    assert sampling.take(rows, 5, "id", "label").count() == 5


def test_cosine_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(40)], "vec_id long, embedding array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in neighbours.by_cosine(df, df.where("vec_id < 10"), 4).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(10):
        s = unit @ unit[q]
        s[q] = -9
        assert [got[q, r] for r in range(1, 5)] == list(np.argsort(-s)[:4])
    assert neighbours.by_cosine(df, df.limit(0), 4).count() == 0


def test_documents_are_cut_at_40000(spark, tmp_path):
    from concordat.plans.catalogue import QUERIES

    texts = ["a" * n for n in (1, 2_001, 40_000, 40_001)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["cut"]) for r in QUERIES["doc_truncate_full"](spark, str(tmp_path)).collect()}
    assert got == {i: (t[:40_000], len(t) > 40_000) for i, t in enumerate(texts)}
