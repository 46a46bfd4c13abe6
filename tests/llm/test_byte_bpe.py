"""Byte-level BPE against the library whose ids it must give, and round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from concordat.llm import byte_bpe
from concordat.llm.queries import QUERIES

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def library(ranks, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ranks_of(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    ranks = ranks_of(request.param)
    return byte_bpe.Encoder(byte_bpe.Vocabulary.load(public_tokenizers.path(request.param), public_tokenizers.PATTERN)), library(ranks)


def v_name(v, i):
    return {n: t for t, n in v.tokens.items()}[i]


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_pieces(pair):
    mine, theirs = pair
    rnd, tokens = random.Random(5), list(mine.vocabulary.tokens)
    for k in range(8000):
        raw = (
            bytes(rnd.choice(b"abeinrst") for _ in range(rnd.randint(1, 40))),
            b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 8))),
            bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 30))),
            bytes([rnd.choice(b"aA= -")]) * rnd.randint(1, 200) + b"-" * rnd.randint(0, 9),
        )[k % 4]
        assert mine.piece(raw) == theirs._encode_single_piece(raw), raw


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_texts(text):
    mine, theirs = test_texts.pair
    assert ids(mine.text(text)) == theirs.encode_ordinary(text)


test_texts.pair = (
    byte_bpe.Encoder(byte_bpe.Vocabulary.load(public_tokenizers.path(FILES[0]), public_tokenizers.PATTERN)),
    library(ranks_of(FILES[0])),
)


def test_small_vocabularies():
    """Invented ranks with many merges of the same letters, with and without tokens that lower ranks never make."""
    rnd, kinds = random.Random(9), [0, 0]
    for _ in range(300):
        tokens = {bytes([i]) for i in range(256)}
        order = [bytes([i]) for i in range(256)]
        for _ in range(rnd.choice([3, 4, 6, 25])):  # merges of what is there, as training makes them
            t = rnd.choice([x for x in order if set(x) <= set(b"ab")]) + rnd.choice([x for x in order if set(x) <= set(b"ab")])
            if t not in tokens:
                tokens.add(t)
                order.append(t)
        if rnd.random() < 0.2:
            order.append(b"bab" * 5)  # its halves are missing
        ranks = {t: i for i, t in enumerate(dict.fromkeys(order))}
        mine, theirs = byte_bpe.Encoder(byte_bpe.Vocabulary.of(ranks, r"[\s\S]+")), library(ranks, r"[\s\S]+")
        for _ in range(60):
            raw = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 24)))
            assert mine.piece(raw) == theirs._encode_single_piece(raw), (ranks, raw)
        assert mine.piece(b"bab" * 5) == theirs._encode_single_piece(b"bab" * 5)
        kinds[bool(mine.vocabulary.whole)] += 1
    assert min(kinds) > 50


def test_caches_do_not_change_ids(monkeypatch, pair):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "KEPT_PAIRS", 2)
    mine, theirs = byte_bpe.Encoder(pair[0].vocabulary), pair[1]
    text = "one two three unheardofword two one zzqxj three four " * 5
    assert ids(mine.text(text)) == theirs.encode_ordinary(text)


def test_long_piece_is_linear(pair):
    mine, theirs = pair
    raw = b"abcab" * 40_000
    got = mine.piece(raw)
    assert b"".join(mine.name[i] for i in got) == raw
    head = mine.piece(raw[:2000])
    assert head == theirs._encode_single_piece(raw[:2000])


def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, SF).collect()}
    theirs = library(ranks_of(FILES[0]))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = theirs.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_edges(spark, tmp_path):
    none = hashlib.sha256(b"").hexdigest()
    texts = [None, "", " ", "\x00\x1c a\r\n\n  b", "é" * 50_000, "x" * 120_000, "same", "same", "🙂🙃 日本語 <|endoftext|>"]
    rows = [(i if i != 6 else None, t, "en", b"old") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, IDS binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[0][1:] == by[1][1:] == (0, none, none)
    assert by[None][1:] == by[7][1:]
    theirs = library(ranks_of(FILES[0]))
    for i, t in enumerate(texts):
        if t and i != 6:
            assert by[i]["n_tokens"] == len(theirs.encode_ordinary(t))
            assert by[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    v = byte_bpe.Vocabulary.load(public_tokenizers.path(FILES[0]), public_tokenizers.PATTERN)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    both = byte_bpe.decoded(byte_bpe.encoded(table, v), v)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    assert both.where("coalesce(text, '') <> cast(decoded AS string)").count() == 0
    assert both.exceptAll(byte_bpe.encoded(table, v, decode=True).select(both.columns)).count() == 0
    assert byte_bpe.encoded(table.limit(0), v).count() == 0
    odd = spark.sql("SELECT cast(null AS binary) AS ids UNION ALL SELECT X'ffffffff41000000' UNION ALL SELECT X''")
    assert {r[1] for r in byte_bpe.decoded(odd, v).collect()} == {None, v_name(v, 65), b""}
