"""The trie against one built in memory."""

import hashlib
import random
import re
import zlib

import pytest

from concordat.llm import conversation_trie as ct
from concordat.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    conv = {c: [x[1:] for x in sorted(v)] for c, v in conv.items()}
    members = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        s = tuple(conv.get(base, [])[:h] + v[h:])
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append((c, len(s) == d))
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        words = len(WORD.findall(p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c, e in members[p] if e)))
        out[p] = (
            min(c for c, _ in members[p]), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(members[p]), len(kids),
            sum(out[k][5] for k in kids) if kids else 1, (len(members[p]) - 1) * words + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def run(spark, path, rows):
    rows = [(*r, "x", 1) for r in rows]
    random.Random(1).shuffle(rows)
    schema = "conv_id bigint, turn bigint, role string, text string, depth string, NODE int"
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    df = QUERIES["op12_conversation_trie"](spark, str(path))
    assert dict(df.dtypes) | {"ends_sha256": "bigint"} == dict.fromkeys(df.columns, "bigint")
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_random(spark, tmp_path):
    """Few distinct turns, so conversations share much; null and equal turns, null roles and texts, repeated rows, absent blocks."""
    rnd = random.Random(2)
    rows = []
    for c in [x for x in range(-45, 260) if x % 7] + [10**15, 10**15 + 1]:
        for t in range(rnd.randint(1, 6)):
            rows.append((c, rnd.choice([None, t, t, t, 0]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a b", "a\tb  c\n", "", None, "é ü"])))
    rows += rows[:20] + [(None, 1, "user", "nobody's")]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_copies_chains_and_one_hot_conversation(spark, tmp_path):
    """Copies of a conversation of some length, one conversation with a third of all rows, and conversations left without turns."""
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 115) for t in range(7)]
    rows += [(c, t, "user", f"turn {t}") for c in (120, 121, 122) for t in range(9)]
    rows += [(40, t, "user", f"own {t % 5}") for t in range(150)]
    rows += [(c, 0, "user", "lost") for c in range(201, 220)]
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(7, None, None, None)], [(20, 0, "a", "x y"), (20, 1, "b", "z")]])
def test_few(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("run_length", [2, 3, 1 << 16])
def test_ends(spark, monkeypatch, run_length):
    """Digests of nodes over several ranges and runs."""
    rnd = random.Random(8)
    rows = [(d, n, c) for d, n, k in [(0, 5, 700), (1, 5, 1), (1, 6, 2), (2, 6, 40), (9, 1, 300), *[(3, i, rnd.randint(1, 4)) for i in range(80)]] for c in rnd.sample(range(10**6), k)]
    rnd.shuffle(rows)
    ends = spark.createDataFrame(rows, "depth int, node bigint, conv_id bigint")
    monkeypatch.setattr(ct, "RUN", run_length)  # in the driver; workers read it from the pickled function's module
    batches = [ct._batch("depth node conv_id", sorted(rows)[lo : lo + 97]) for lo in range(0, len(rows), 97)]
    runs = [b for b in ct._runs(iter(batches))]
    assert sum(b.num_rows for b in runs) > 80
    got = {(r["depth"], r["node"]): r["ends_sha256"] for r in ct.ends_digests(ends).collect()}
    want = {}
    for d, n, c in sorted(rows):
        want.setdefault((d, n), []).append(str(c))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
    streamed = {}
    for b in runs:
        for r in b.to_pylist():
            if r["ends_sha256"]:
                streamed[r["depth"], r["node"]] = r["ends_sha256"]
    again = ct._streamed(iter([ct.pa.RecordBatch.from_pylist([r for b in runs for r in b.to_pylist() if r["ids"] is not None])]))
    for b in again:
        streamed |= {(r["depth"], r["node"]): r["ends_sha256"] for r in b.to_pylist()}
    assert streamed == got


def test_turns_of_nodes(spark):
    table = spark.createDataFrame([(1, 0, "user", "hello there"), (2, 0, "user", "hello there"), (2, 1, None, "bye")], "conv_id bigint, turn bigint, role string, text string")
    nodes = ct.trie(*ct.rebuilt(table)).join(ct.turn_texts(table), "digest", "left")
    assert all((r["text"] is None) == (r["depth"] == 0) for r in nodes.collect())
