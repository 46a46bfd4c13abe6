"""The operators against brute force, round trips, other libraries and held-out labels."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from concordat.llm import (
    decontamination,
    jaccard_join,
    language_id,
    quality_classifier,
    quality_rules,
    source_mixing,
    suffix_dedup,
)
from concordat.llm.html_extraction import main_text
from concordat.llm.queries import ORACLE_SQL, QUERIES
from concordat.llm.stats import measure
from concordat.llm.token_counts import Counter, Vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    order = lambda rows: sorted(rows, key=lambda r: tuple(str(x) for x in r))
    assert order(tuple(r[c] for c in names) for r in df.collect()) == order(cursor.fetchall())


def components(texts, percent=75):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("frequent", [32, 1])
def test_jaccard(documents, texts, frequent):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.linked_components(documents, frequent=frequent).collect()}
    assert got == components(texts)


def test_jaccard_of_near_copies(spark):
    """Chains and groups of near copies beside a passage that all share, with every shingle frequent."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    shared = [word() for _ in range(25)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(40 + 10 * g)]
        for _ in range(9):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w + shared if g % 2 else w)))
    rows += [(len(rows) + k, " ".join(shared[: 3 + k])) for k in range(20)]
    want = components(dict(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in (32, 4, 1):
        got = {r[0]: (r[1], r[2]) for r in jaccard_join.linked_components(df, frequent=frequent).collect()}
        assert got == want


def test_jaccard_of_long_copies(spark):
    """One text of 20,000 words, copied 40 times with few or many edits; its signatures grow like its words."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(3000)}" for _ in range(20_000)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range((i % 8) * 120):
            w[rnd.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.linked_components(df, frequent=4).collect()}
    want = components(dict(rows))
    assert got == want and 1 < len({c for _, c in want.values()}) < 40
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 20_000).astype(np.uint64))
    for n in (20, 300, 5_000, 20_000):
        made = sum(len(jaccard_join._combined(h[:n], n // 4 + 1, jaccard_join._classes(start, 75))) for start in jaccard_join._ranges(n, 75))
        assert made < 4 * n


@pytest.mark.parametrize("percent", [50, 90])
def test_jaccard_at_other_thresholds(spark, percent):
    rnd = random.Random(percent)
    rows = []
    for g in range(10):
        base = [rnd.choice("abcdefgh") for _ in range(12 + 9 * g)]
        for _ in range(8):
            w = list(base)
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = rnd.choice("xyz")
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.linked_components(df, percent=percent, frequent=2).collect()}
    assert got == components(dict(rows), percent)
    with pytest.raises(ValueError):
        jaccard_join.linked_components(df, percent=40)


def removal(texts, n=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            else:
                seen.add(b[k : k + n])
        kept = bytes(c for c, r in zip(b, gone, strict=True) if not r)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix(documents, texts, hot):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.digest(documents, suffix_dedup.lost_ranges(documents, hot)).collect()}
    assert got == removal(texts)


def test_suffix_periodic(spark):
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abc é") for _ in range(150))
    rows = [(i, ("ab" * rnd.randrange(90)) + passage[rnd.randrange(40) :] + "z" * rnd.randrange(120) + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (suffix_dedup.HOT, 3):
        got = {r[0]: tuple(r)[1:] for r in suffix_dedup.digest(df, suffix_dedup.lost_ranges(df, hot)).collect()}
        assert got == removal(dict(rows))


@given(st.lists(st.tuples(st.integers(0, 4), st.text("ab", min_size=6, max_size=10)), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_columns(parts):
    """Every window of 6 around an anchor of 2, at every column, for anchors at all offsets."""
    parts = [(o, p[: o + 6]) for o, p in parts]  # a segment's last window starts at its anchor or before
    off, segs = np.array([o for o, _ in parts]), [p.encode() for _, p in parts]
    lost = suffix_dedup.lost_windows(off, segs, 6, 2)
    windows = [{4 - o + j: s[j : j + 6] for j in range(len(s) - 5) if 4 - o + j <= 4} for o, s in zip(off.tolist(), segs, strict=True)]
    for i, own in enumerate(windows):
        for column in range(5):
            assert lost[i, column] == (column in own and any(w.get(column) == own[column] for w in windows[:i]))


def test_stats(texts):
    sample = [*list(texts.values())[:80], "", " \n ", "a b a b a b\n\na b\na b\n#*$%&|<>"]
    base, _ = measure([t.encode() for t in sample])
    for t, got in zip(sample, base, strict=True):
        w = WORD.findall(t)
        full = [x for x in t.split("\n") if WORD.search(x)]
        tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) for k in range(3) if tri[tuple(w[i : i + 3])] > 1}
        assert list(got) == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(cover)]


def test_tokens(texts):
    """The counts of a library's unigram model over the same pieces."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = "/opt/tokenizers/piece_bpe_32k.model"
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(len(sp))]
    library = Tokenizer(models.Unigram(pieces, 0, True))
    counter = Counter(Vocabulary.load(path))
    for t in [*list(texts.values())[:60], "é𐍈 \n\t日本語日本   a  b", "  ", "▁ a"]:
        assert counter.count(t) == len(library.encode("▁" + t.replace(" ", "▁")).ids)


@given(st.text("abc ", max_size=12))
@settings(max_examples=150, deadline=None)
def test_token_ties(text):
    """Equal scores: of the best paths to each place the one with the longest last piece stays."""
    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, "abc": -3.0, "bc": -2.0, "▁": -1.0, "▁a": -2.0}
    got = Counter(Vocabulary(tuple(pieces.items()), True)).count(text)
    if not text:
        assert got == 0
        return
    s, unknown = "▁" + text.replace(" ", "▁"), -13.0
    best = [(0.0, 0)]
    for end in range(1, len(s) + 1):
        top = None
        for start in range(max(0, end - 3), end):  # longest first, replaced only by strictly more
            p = s[start:end]
            score = pieces.get(p, unknown if len(p) == 1 else None)
            if score is not None and (top is None or best[start][0] + score > top[0]):
                top = (best[start][0] + score, best[start][1] + 1)
        best.append(top)
    assert got == best[-1][1]


def test_decontamination(spark, documents, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = dict(bench.collect())
    flat = lambda t: " ".join(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)))
    got = {(r[0], r[1]): r for r in decontamination.contaminated(documents, bench).collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in items.items() if flat(b) in flat(t)}
    assert exact <= set(got)
    for (d, i), r in got.items():
        found = texts[d].encode()[r["start"] : r["end"]].decode(errors="replace")
        assert (flat(found) == flat(items[i])) == (r["edits"] == 0)
    blocks = {(r[0], r[1]) for r in decontamination.contaminated(documents, bench, block_chars=2000).collect()}
    assert blocks == set(got)


def distance(a, b):
    """Least edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_by_edits(spark):
    """Passages with up to the budget's edits, and more, against the full edit distance."""
    rnd = random.Random(11)
    letters = "abcdefghij "
    item = "".join(rnd.choice(letters) for _ in range(200)).strip()
    rows = []
    for k in range(40):
        w = list(item)
        for _ in range(k // 2):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice([[], [rnd.choice(letters)], [w[at], rnd.choice(letters)]])
        rows.append((k, "".join(rnd.choice(letters) for _ in range(300)) + "".join(w) + "tail " * 9))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r[0]: r["edits"] for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    flat = lambda t: re.sub(" +", " ", t)
    budget = int(decontamination.GramIndex.build([(1, item)]).budget[0])
    assert budget >= 9
    want = {i: d for i, t in rows if (d := distance(flat(item), flat(t))) <= budget}
    assert got == want and 5 < len(want) < 35


def test_decontamination_across_pieces():
    """Passages with wide blanks at and around the border of two pieces of a long text."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    index = decontamination.GramIndex.build([(1, " ".join(words))])
    wide = (" " * 60).join(words).encode()
    for at in (0, 5_000, decontamination.PIECE - len(wide) - 10, decontamination.PIECE - 1_000, decontamination.PIECE - 1, decontamination.PIECE):
        text = (b"xy z" * (at // 4 + 1))[:at] + b" " + wide + b" tail"
        assert decontamination.matches([b"other", text], index) == [(1, 1, 0, at + 1, at + 1 + len(wide))]


def test_decontamination_of_common_phrases():
    """Thousands of short items with one phrase, and periodic items and texts: bounded work, right results."""
    rnd = random.Random(4)
    phrase = "the common phrase of all "
    items = [(i, phrase + "".join(rnd.choice("abcdefghij") for _ in range(20))) for i in range(3_000)]
    index = decontamination.GramIndex.build(items)
    text = (phrase + "and more words " + items[77][1] + " ") * 8
    assert [r[:3] for r in decontamination.matches([text.encode()], index)] == [(0, 77, 0)]
    periodic = decontamination.GramIndex.build([(1, "ab" * 150), (2, "ab" * 60 + "x" + "ab" * 60)])
    got = decontamination.matches([b"ab" * 30_000, b"zz" + b"ab" * 149, b"cd" * 500], periodic)
    assert [r[:3] for r in got] == [(0, 1, 0), (0, 2, 1), (1, 1, 2), (1, 2, 1)]


@given(st.text("ab ", min_size=24, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.sampled_from(["", "c", "ab"])), max_size=2), st.text("abd ", max_size=30))
@settings(max_examples=150, deadline=None)
def test_banded_alignment(item, edits, around):
    """The least edits within the budget, as the full table gives them."""
    index = decontamination.GramIndex.build([(1, item)])
    if index is None:
        return
    w = list(index.patterns[0].decode())
    for at, new in edits:
        if at < len(w):
            w[at] = new
    text = around + "".join(w) + around
    flat = re.sub(" +", " ", text)
    d = distance(index.patterns[0].decode(), flat)
    got = decontamination.matches([text.encode()], index)
    assert [r[2] for r in got] == ([d] if d <= index.budget[0] else [])


def test_schedule():
    """Every block within its window, and less than one block off at every slot."""
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.97, "b": 0.01, "c": 0.01, "d": 0.01}, {str(i): i + 1.0 for i in range(23)}):
        share = source_mixing.shares(weights, 500)
        assert sum(share.values()) == 500
        slots = source_mixing.period_slots(share)
        order = {t: s for s, ts in slots.items() for t in ts}
        assert sorted(order) == list(range(500))
        served = dict.fromkeys(share, 0)
        for t in range(500):
            j = served[order[t]]
            assert j * 500 // share[order[t]] <= t < -(-(j + 1) * 500 // share[order[t]])
            served[order[t]] += 1
            assert all(abs(served[s] - (t + 1) * share[s] / 500) < 1 for s in share)


def test_mix(spark, documents):
    out = source_mixing.mixed(documents, block=2).select("doc_id", "mix_source", "mix_block", "mix_phase", "mix_slot", "mix_position").toPandas()
    assert sorted(out.mix_position) == list(range(len(out))) and sorted(out.doc_id) == sorted(r[0] for r in documents.select("doc_id").collect())
    sizes = out.mix_source.value_counts().to_dict()
    share = source_mixing.shares({s: math.sqrt(n) for s, n in sizes.items()}, source_mixing.PERIOD)
    slots = {}
    for p in source_mixing.phases({s: -(-n // 2) for s, n in sizes.items()}, share):
        done = dict(p.done)
        for t in range(p.length):  # the plain way: slot by slot
            s = next(s for s, ts in p.slots.items() if t % p.period in ts)
            slots[s, done[s]] = p.base + t
            done[s] += 1
    got = {(r.mix_source, r.mix_block): r.mix_slot for r in out.itertuples()}
    assert got == slots


@pytest.mark.parametrize("weights", [{"a": 2.0, "b": 1.0}, {"a": 0.9999, "b": 0.0001}, {"a": math.sqrt(2), "b": math.sqrt(3), "c": math.sqrt(5)}])
def test_schedule_follows_the_weights(weights):
    """Less than one block off the target weights, not rounded ones, over far more slots than a period."""
    blocks = {s: math.ceil(40_000 * w / sum(weights.values())) for s, w in weights.items()}
    p = source_mixing.phases(blocks, source_mixing.shares(weights, source_mixing.PERIOD))[0]
    assert p.length > 30_000
    at = np.arange(1, p.length + 1)
    for s, w in weights.items():
        starts = np.zeros(p.period)
        starts[p.slots[s]] = 1
        served = np.cumsum(starts[np.arange(p.length) % p.period])
        assert np.abs(served - at * w / sum(weights.values())).max() < 1


def test_mix_follows_the_weights(spark):
    docs = spark.range(90_000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 3 < 2 THEN 'a' ELSE 'b' END AS source")
    out = source_mixing.mixed(docs, {"a": 2.0, "b": 1.0}, block=4).select("mix_source", "mix_slot", "mix_phase", "mix_position").toPandas()
    assert sorted(out.mix_position) == list(range(90_000))
    one = out[out.mix_phase == 0].drop_duplicates("mix_slot").sort_values("mix_slot")
    served = (one.mix_source == "a").cumsum().to_numpy()
    assert len(one) > 20_000 and np.abs(served - np.arange(1, len(one) + 1) * 2 / 3).max() < 1


def test_held_out(spark):
    """Held-out accuracy of the learned operators at the middle size."""
    sf = "/root/testdata/sf0.01"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    langs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    q = [r for r in QUERIES["op10_quality_classifier"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in q]) >= 0.95
    k = [r for r in QUERIES["op3_quality_rules"](spark, sf).collect() if not r["base_failed"] and r["doc_id"] in labels]
    assert np.mean([r["kept"] == (labels[r["doc_id"]] == 1) for r in k]) >= 0.97
    lang = [r for r in QUERIES["op4_language_id"](spark, sf).collect() if r["held_out"] and langs[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in lang]) >= 0.97


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header>Site <a href=/>Home</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy &amp; save</div><article><h1>Head &amp; line</h1><p>First   long paragraph with\n words and <b>bold</b> ones, long enough.<p>Second paragraph, <a href=x>linked</a> as well, with more words.</p>
<aside>Related things</aside><form><input>Search</form><p>End.</p><div id="comments"><p>A reader says hello there.</p></div></article><footer>&copy; us</footer></body></html>"""


def test_forest_against_a_recursive_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality_rules.RULES)))
    forest = quality_rules.IsolationForest.fit(x, x.min(0), x.max(0), trees=20)

    def depth(t, row, i=0):
        f = forest.feature[t, i]
        return forest.length[t, i] if f < 0 else depth(t, row, 2 * i + (2 if row[f] > forest.cut[t, i] else 1))

    want = [2 ** (-np.mean([depth(t, row) for t in range(20)]) / forest.norm) for row in x]
    assert forest.anomaly(x) == pytest.approx(want, abs=1e-12)
    score, good = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.8, 0.9]), np.array([1, 1, 1, 1, 1, 0, 0], bool)
    assert 0.5 <= quality_rules.calibrated(score, good) < 0.8


def test_kept_by_rules(spark, documents):
    """``kept`` is the base rules and the walk's verdict, document by document."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    text = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in quality_rules.apply_rules(documents, rules).collect():
        base, f = measure([text[r["doc_id"]].encode()])
        failed = base[0][0] < 50 or 100 * base[0][4] > 50 * base[0][0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and rules.anomaly(f)[0] <= rules.threshold)


def test_additive_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    m = quality_classifier.fit(x, y, rounds=20, pair_rounds=20)
    for row, got in zip(x[:60], m.score(x[:60]), strict=True):
        b = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges, strict=True)]
        raw = m.intercept + sum(t[i] for t, i in zip(m.tables, b, strict=True))
        raw += sum(t[b[f] // m.coarse][b[g] // m.coarse] for (f, g), t in zip(m.pairs, m.pair_tables, strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-12)
    assert m.pairs[0] == (0, 1) and np.mean((m.score(x) >= 0.5) == y) > 0.9


@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(1, 4)), min_size=1, max_size=9))
@settings(max_examples=100, deadline=None)
def test_best_leaves_start_with_the_best_cut(bins):
    """The first cut is the best of all; a second one only adds to the gain."""
    r, h = (np.array(v, float) for v in zip(*bins, strict=True))
    gain = lambda cuts: sum(r[i:j].sum() ** 2 / (h[i:j].sum() + 1) for i, j in zip([0, *cuts], [*cuts, len(r)], strict=True))
    best = max([gain([c]) for c in range(1, len(r))], default=gain([]))
    leaves = quality_classifier._best_leaves(r, h, 1.0)
    cuts = [i for i in range(1, len(r)) if leaves[i] != leaves[i - 1]]
    assert len(cuts) <= 2 and gain(cuts) >= max(best, gain([])) - 1e-6


def test_language_masks_against_plain_sets(spark):
    rows = [(1, "x", "abra cadabra abra"), (2, "y", "simsala bim bam bra"), (3, "z", "hokus pokus bra"), (5, "y", "bim bim")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = language_id.learn(docs, min_share=0.0)
    sets = {k: set(language_id.grams([t.encode() for _, lang, t in rows if lang == k])[1].tolist()) for k in "xyz"}
    every = np.array(sorted(set().union(*sets.values())), np.uint64)
    mask = filters.masks(every)[0]
    for h, m in zip(every.tolist(), mask.tolist(), strict=True):
        for i, k in enumerate(filters.langs):
            assert h not in sets[k] or m >> i & 1
    chance = sum(int(m).bit_count() for m in mask) - sum(len(s) for s in sets.values())
    assert 0 <= chance <= 2 and (filters.false_rate < 0.01).all()
    evidence = filters.evidence([b"abra cadabra", b"bim bam", b"pokus"])
    assert evidence.argmax(1).tolist() == [0, 1, 2] and evidence.sum(1) == pytest.approx(1)


def test_html():
    assert main_text(PAGE) == "Head & line\nFirst long paragraph with words and bold ones, long enough.\nSecond paragraph, linked as well, with more words.\nEnd."
    plain = "<body><ul><li><a>a</a><li><a>b</a></ul>" + "".join(f"<p>{'words and words ' * 20}{i}</p>" for i in range(5)) + "<p><a>x</a></p></body>"
    assert main_text(plain).count("\n") == 4


def test_every_article_is_kept():
    """An article of short lines beside one of long ones; boilerplate inside and outside stays out."""
    long = "".join(f"<p>{'many words in a row ' * 20}{i}</p>" for i in range(4))
    short = "<article><h2>Update</h2><ul><li>One</li><li>Two</li></ul><div class='share'>Share</div></article>"
    got = main_text(f"<body><nav>Menu</nav><article>{long}</article>{short}<footer>End</footer></body>").split("\n")
    assert len(got) == 7 and got[-3:] == ["Update", "One", "Two"]


def test_pages_without_marks(spark):
    """Clusters find the same text where no element marks the article."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = [h for h in pages if h]
    assert len(pages) > 20
    for h in pages:
        assert main_text(re.sub("</?article[^>]*>", "", h)) == main_text(h)


def test_clusters_decide_about_articles():
    """Cards marked as articles don't take the place of a long text outside them."""
    body = "".join(f"<p>{'many words in a row ' * 20}{i}</p>" for i in range(6))
    cards = "".join(f"<article><a href=x>Card {i}</a></article>" for i in range(3))
    got = main_text(f"<body><div>{cards}</div><div>{body}</div></body>").split("\n")
    assert len(got) == 6 and all(x.startswith("many words") for x in got)


MARKUP = ["<p>", "</p>", "<![foo[", "<![ x", "<![%foo;[", "]]>", "<!--", "-->", "<!", "<?", "</", "<", ">", "&", "&#", "&#x41;", "&amp", "<article>", "</article>",
          "<div class='ad'>", "</div>", "<script>", "</script>", "<a href=\"", "<br/>", "text", " words here ", "\n", "<![CDATA[", "é", "\0", "<!DOCTYPE", "<!ELEMENT x [", "<textarea>", "<table><td>"]


@given(st.lists(st.sampled_from(MARKUP), max_size=25))
@settings(max_examples=1500, deadline=None)
def test_any_markup(parts):
    assert isinstance(main_text("".join(parts)), str)


def test_broken_markup():
    for x in ("<![foo[x]]>", "<![ x", "<![%foo;[", "<!--"):
        assert main_text(f"<p>a</p>{x}").startswith("a") and "<!" not in main_text(f"<p>a</p>{x}")
    assert main_text("<p>a</p><![foo[x]]><p>b</p>") == "a\nb" and main_text("<p>x<!--") == "x"


def test_pages(spark):
    """The article of every page of the table, cut out by its marks."""
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["op7_html_extraction"](spark, SF).collect()}
    for i, h in pages.items():
        parts = re.split(r"</?(?:p|h1|h2)>", h[h.find("<article>") + 9 : h.find("</article>")])
        flat = (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts)
        assert got[i] == "\n".join(x for x in flat if x)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [r["mix_position"] for r in rows] == list(range(len(rows)))


def test_pipeline_of_empty_tables(spark, tmp_path):
    """Empty documents, labels or benchmark, and columns that clash with the stages' own."""
    import corpus_pipeline

    read = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = read["documents"].limit(60).selectExpr("*", "1 AS mix_slot", "doc_id AS node", "text AS seg")
    for empty in (("documents",), ("labels", "benchmark")):
        folder = f"{tmp_path}/{'-'.join(empty)}"
        for t, df in (read | {"documents": docs}).items():
            (df.limit(0) if t in empty else df).write.parquet(f"{folder}/{t}.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.count() == 0 if "documents" in empty else 0 < out.count() <= 60
        assert {"node", "seg", "mix_slot_before", "mix_slot"} <= set(out.columns)


LONG = "\n".join(f"<div>{'Some long sentence of an article that goes on. ' * 9}{i}</div>" for i in range(6))


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar">', '<div class="post no-comments">', '<div class="legal news">', '<form id="aspnetForm">'])
def test_html_wrappers(wrapper):
    """A class word on what holds the article loses nothing of it, and what stands beside it stays out."""
    tag = wrapper[1:].split()[0]
    around = lambda x: f'<body><nav><a href="x">Home</a></nav>{x}<div class="comments">{"A reader says so. " * 9}</div><footer>us</footer></body>'
    assert main_text(around(f"{wrapper}{LONG}</{tag}>")) == main_text(around(f"<div>{LONG}</div>"))
    assert main_text(around(f"{wrapper}{LONG}</{tag}>")).count("\n") == 5


def test_html_clusters_decide(spark):
    """Without marks, class words and boilerplate elements the clusters alone find the article; with no threshold they don't."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    bare = lambda p: re.sub(r"</?(article|main|nav|footer|aside|header|form)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", re.sub(r'\s(class|id|role)="[^"]*"', "", p))
    got = want = off = 0
    for p in pages:
        lines = main_text(p).split("\n")
        found, every = (main_text(bare(p), **k).split("\n") for k in ({}, {"threshold": lambda x: -1.0}))
        want += sum(map(len, lines))
        got += sum(len(x) for x in found if x in lines)
        off += sum(len(x) for x in every if x not in lines) > sum(len(x) for x in found if x not in lines)
    assert got >= 0.9 * want and off >= 0.5 * len(pages)


def test_html_threshold_matters(spark):
    """With article marks taken away, switching the threshold off lets lowered lines in, nearly everywhere."""
    pages = [re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sum(main_text(p, threshold=lambda x: -1.0) != main_text(p) for p in pages) > 0.9 * len(pages)


def test_html_deep_and_long():
    deep = "<div>" * 3000 + "text in the deep " * 50 + "</div>" * 3000
    assert main_text(deep).startswith("text in the deep")
    long = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(4000))
    assert main_text(long).count("\n") == 3999


@pytest.mark.parametrize("weighted", [False, True])
def test_mixing_pools(spark, monkeypatch, weighted):
    """More sources than one schedule takes: every row once, in one order, each source within two blocks of its weight."""
    monkeypatch.setattr(source_mixing, "MAX_SOURCES", 8)
    rnd = random.Random(4)
    sizes = {f"s{i}": rnd.randint(1, 9) for i in range(40)} | {"big": 300, None: 7}
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {f"s{i}": 1.0 + i % 3 for i in range(0, 40, 2)} | {"big": 5.0} if weighted else None
    out = source_mixing.mixed(docs, weights, block=2).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in out] == list(range(len(rows))) and len({r["doc_id"] for r in out}) == len(rows)
    assert all(r["mix_source"] == r["source"] for r in out)
    slots = sorted({(r["mix_slot"], r["mix_source"] or "", r["mix_block"]) for r in out})
    assert [s for s, *_ in slots] == list(range(len(slots)))
    by = {}
    for _, s, j in slots:
        assert by.setdefault(s, 0) == j
        by[s] += 1
    w = {s or "": math.sqrt(n) if weights is None else weights.get(s, 0.0) for s, n in sizes.items()}
    total, served = sum(w.values()), dict.fromkeys(w, 0)
    for t, (_, s, _) in enumerate(slots, 1):  # until the first source runs out
        served[s] += 1
        assert all(abs(served[x] - t * w[x] / total) < 2 for x in w)
        if served[s] == by[s]:
            break
    if weights:
        last = max(t for t, s, _ in slots if w[s] > 0)
        assert all(w[s] > 0 for t, s, _ in slots if t <= last)


def test_short_benchmark_items(spark):
    docs = spark.createDataFrame([(1, "The  Cat\tsat."), (2, "concatenate"), (3, "cat"), (4, "a b"), (5, None), (6, "x" * 2_000_000 + " cat")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " the cat "), (11, "cat"), (12, "CAT"), (13, ""), (14, None), (15, "é"), (16, ".")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"], r["start"], r["end"]) for r in decontamination.contaminated(docs, bench).collect()}
    far = 2_000_001
    assert got == {(1, 10, 0, 0, 8), (1, 11, 0, 5, 8), (1, 12, 0, 5, 8), (3, 11, 0, 0, 3), (3, 12, 0, 0, 3), (1, 16, 0, 12, 13), (6, 11, 0, far, far + 3), (6, 12, 0, far, far + 3)}
    assert {r["doc_id"] for r in decontamination.uncontaminated(docs, bench).collect()} == {2, 4, 5}


def test_pairs_of_open_lists_leave_a_task_once():
    """However many lists two members share, with other members or the same ones, and over any cut into batches."""
    rng = np.random.default_rng(5)
    sets = [frozenset(range(100)), frozenset(range(2, 102)), frozenset(range(500, 600)), frozenset(range(1, 101))]
    comp = [0, 1, 2, 0]
    masks = np.zeros((4, jaccard_join.MASK_WORDS * 64), bool)
    for i, x in enumerate(sets):
        masks[i, [7 * y % masks.shape[1] for y in x]] = True
    words = np.packbits(masks, axis=1, bitorder="little").view(np.int64)
    assert (words < 0).any()  # the highest bit of a word counts as any other
    rows = []
    for sig in range(200):
        for rank, i in enumerate(sorted([0, *(rng.permutation(3)[: rng.integers(1, 4)] + 1).tolist()]), 1):
            rows.append((sig, i, 100, 0, comp[i], rank, *words[i].tolist()))
    names = ["sig", "node", "n", "pos", "comp", "rank", *(f"mask{i}" for i in range(jaccard_join.MASK_WORDS))]
    table = pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
    for size in (3, 50, 1000):
        out = pa.Table.from_batches(jaccard_join._across(8, 75)(iter(table.to_batches(size))))
        assert list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)) == [(0, 1), (1, 3)]


def test_pairs_of_open_lists_leave_once_whatever_the_tasks(spark, monkeypatch):
    """Lists with other first members, and parts of one list, lie in several tasks; each pair still leaves once, none is lost."""
    monkeypatch.setattr(jaccard_join, "PART", 5)
    rng = np.random.default_rng(6)
    lists = [sorted(rng.permutation(60)[: rng.integers(20, 50)].tolist()) for _ in range(40)]
    rows = [(sig, node, 100, 0, node % 7, len(x), rank) for sig, x in enumerate(lists) for rank, node in enumerate(x, 1)]
    ranked = spark.createDataFrame(rows, "sig long, node long, n int, pos int, comp long, members long, rank int")
    words = [f"0L AS mask{i}" for i in range(jaccard_join.MASK_WORDS)]
    names = ["sig", "node", "n", "pos", "comp", "rank", "part", "home", "least", *(f"mask{i}" for i in range(jaccard_join.MASK_WORDS))]
    for leaders in (1, 64):  # in parts of 8 members, and all compared
        parts = jaccard_join._in_parts(ranked, leaders)
        assert (parts.agg({"part": "max"}).first()[0] > 0) == (leaders == 1)
        dealt = parts.join(jaccard_join._first_lists(ranked), "node").selectExpr("*", *words).select(names)
        dealt = dealt.repartition(16, "sig", "part").sortWithinPartitions("sig", "part", "rank")
        got = [tuple(r) for r in dealt.mapInArrow(jaccard_join._across(leaders, 75), "a long, b long").collect()]
        first = {}
        for sig, x in enumerate(lists):
            for i, b in enumerate(x):
                for rank, a in enumerate(x[:i], 1):
                    first.setdefault((a, b), (sig, rank))
        want = {(a, b) for (a, b), (_, rank) in first.items() if a % 7 != b % 7 and rank <= leaders}
        assert set(got) >= want and all(a % 7 != b % 7 for a, b in got)
        if leaders == 64:
            assert set(got) == want
        known = {r["node"]: set(r["least"]) for r in jaccard_join._first_lists(ranked).collect()}
        seen = collections.Counter(p for p in got if known[p[0]] & known[p[1]])
        assert max(seen.values()) == 1


def test_jaccard_in_parts(spark, monkeypatch):
    """Groups that share frequent passages without a link, their open lists in parts of a few members."""
    monkeypatch.setattr(jaccard_join, "PART", 4)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    base = [word() for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(dict(rows))
    assert len({c for _, c in want.values()}) > 5
    for frequent in (32, 2):
        assert {r[0]: (r[1], r[2]) for r in jaccard_join.linked_components(df, frequent=frequent).collect()} == want


def test_rules_are_fitted_on_all_labelled_rows(spark):
    """More labelled rows than the 10,000 that once were the limit: forest and threshold are those of all of them."""
    text = "concat_ws(' ', transform(sequence(1, 60 + id % 40), i -> concat(if(id % 9 = 0, 'W#', 'w'), conv(abs(hash(id, i)) % 5000, 10, 16), if(i % (5 + id % 4) = 0, ',', ''))))"
    docs = spark.range(12_000).selectExpr("id AS doc_id", f"{text} AS text")
    labels = spark.range(12_000).selectExpr("id AS doc_id", "if(id % 9 = 0, 0, 1) AS quality")
    rules = quality_rules.train(docs, labels)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    x = measure([r["text"].encode() for r in rows])[1][:, quality_rules.RULES]
    good = np.array([r["quality"] == 1 for r in rows])
    forest = quality_rules.IsolationForest.fit(x[good], x.min(0), x.max(0))
    assert (rules.forest.feature == forest.feature).all() and rules.forest.length == pytest.approx(forest.length)
    assert rules.threshold == pytest.approx(quality_rules.calibrated(forest.anomaly(x), good), abs=1e-12)


def test_threshold_over_a_table(spark):
    rng = np.random.default_rng(9)
    score = np.round(rng.random(900), 2)
    good = rng.random(900) < 0.8
    scores = spark.createDataFrame([(float(s), int(g)) for s, g in zip(score, good, strict=True)], "score double, label int")
    for loss in (0.0, 0.013, 0.5):
        assert quality_rules.calibrated_over(scores, int(good.sum()), loss, 20) == pytest.approx(quality_rules.calibrated(score, good, loss), abs=1e-12)


def test_batches_of_a_task_are_small():
    """A large batch of Spark's is worked through in parts, in order and whole."""
    from concordat.llm._text import BATCH_ROWS, tidy

    sizes = []
    run = tidy(lambda batches: (sizes.append(b.num_rows) or b for b in batches))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], ["x"])
    assert pa.Table.from_batches(run(iter([batch])))["x"].to_pylist() == list(range(10_000)) and max(sizes) <= BATCH_ROWS
