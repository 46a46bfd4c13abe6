"""Operator 13: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over strings finds all vocabulary tokens in a
piece of text, the longest for each place. Tokens are laid from left to right: the longest at a place is tried first, then
the longest of its own prefixes, and so on. A token may follow another only if the two, merged alone, would stay these two;
that answer is memoised by pair. Where none fits, the last token is taken back and its place marked as a dead end, so each
place is left at most once and the work is linear in the bytes of a piece. Exactly one sequence has only compatible
neighbours: the one that merging the pair of lowest rank over and over ends with.

*Compatible.* Merging undoes itself uniquely: every token made by merges has one last merge, ``halves``. Two neighbours
stay apart unless, in undoing the younger of the two step by step, a merge across the border turns up that has a lower
rank than what was undone, so would have come first. This holds for ranks in which each token is what its own bytes merge
to by lower ranks alone, as in every trained vocabulary (both rank files at hand). Ranks with a token for which it doesn't
hold are taken too, but merged plainly, in time that grows with the square of a piece.

A text is cut into pieces by the pattern, each piece is encoded alone; a worker keeps the ids of pieces it has seen lately,
up to a fixed number.

Edge cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded each; an empty table gives
an empty result. Added columns replace columns of the same name, in any case, that the table has already. Ids that the
vocabulary lacks decode to no bytes; null ids decode to null.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_PIECES, KEPT_PAIRS, KEPT_CHARS, OUT_BYTES = 150_000, 300_000, 64, 4 << 20
RANKS = "byte_bpe_multi_50k.tiktoken"


def merged(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merging of the adjacent pair of lowest rank (the first of equals), used to find how tokens are made."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and (below is None or r < below)]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with their ids (ranks), the halves of each id's last merge, and the pattern; some ten thousand tokens, small
    enough to broadcast. ``halves[id]`` is None for single bytes; tokens that lower ranks never make are in ``whole`` only."""

    tokens: dict[bytes, int]
    halves: dict[int, tuple[int, int] | None]
    whole: dict[bytes, int]
    pattern: str

    @property
    def digest(self) -> str:
        return hashlib.sha256(repr((sorted((self.tokens | self.whole).items()), self.pattern)).encode()).hexdigest()

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        tokens, halves, whole = {}, {}, {}
        for token, rank in ranks.items():
            parts = [token] if len(token) == 1 else merged(token, ranks, rank)
            if len(parts) == 1:
                tokens[token], halves[rank] = rank, None
            elif len(parts) == 2:
                tokens[token], halves[rank] = rank, (ranks[parts[0]], ranks[parts[1]])
            else:
                whole[token] = rank
        return cls(tokens, halves, whole, pattern)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a token in base64 and its rank on each line."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return cls.of(ranks, pattern)


class Encoder:
    """Encodes pieces and texts; one per Python worker and vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        top = max(v.tokens.values(), default=-1) + 1
        self.size, self.shorter, self.name = [0] * top, [-1] * top, [b""] * top
        for token, i in v.tokens.items():
            self.automaton.add_word(token.decode("latin-1"), i)
            self.size[i], self.name[i] = len(token), token
            self.shorter[i] = next((j for n in range(len(token) - 1, 0, -1) if (j := v.tokens.get(token[:n])) is not None), -1)
        self.automaton.make_automaton()
        self.ranks = v.tokens | v.whole
        self.pieces = regex.compile(v.pattern)
        self.decode = _decoder(v)
        self.known: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}
        self.seen_before: dict[str, bytes] = {}

    def compatible(self, key: int) -> bool:
        """Do the tokens a and b of ``key = a << 32 | b`` stay apart when their bytes are merged?"""
        if len(self.known) >= KEPT_PAIRS:
            self.known.clear()
        answer = self.known[key] = self._apart(key >> 32, key & 0xFFFFFFFF)
        return answer

    def _apart(self, a: int, b: int) -> bool:
        halves, name, tokens, limit = self.vocabulary.halves, self.name, self.vocabulary.tokens, None
        while True:
            across = tokens.get(name[a] + name[b])
            if across is not None and (limit is None or across < limit):
                return False  # this merge would have come before the one that was undone last
            left, right = halves[a], halves[b]
            if left is None and right is None:
                return True
            # undo the younger of the two; of equals the right one, as merges of one rank go from left to right
            if right is None or (left is not None and a > b):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def piece(self, raw: bytes) -> list[int]:
        """The ids of a piece."""
        v = self.vocabulary
        i = self.ranks.get(raw)
        if i is not None:
            return [i]
        if v.whole:
            return [self.ranks[p] for p in merged(raw, self.ranks)]
        n, size, shorter, known = len(raw), self.size, self.shorter, self.known
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - size[i]] = i  # ends rise, so the last of a start is its longest
        out: list[int] = []
        open_, at, i, last = [True] * (n + 1), 0, longest[0], -1
        while at < n:
            while i >= 0:
                end = at + size[i]
                if open_[end]:
                    if last < 0:
                        break
                    fits = known.get(last << 32 | i)
                    if fits is None:
                        fits = self.compatible(last << 32 | i)
                    if fits:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, last, i = end, i, longest[end]
            elif out:
                open_[at] = False
                at -= size[last]
                out.pop()
                i, last = shorter[last], out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks single bytes of this text")
        return out

    def text(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        seen, out = self.seen, []
        for p in self.pieces.findall(text):
            ids = seen.get(p)
            if ids is None:
                ids = self.seen_before.get(p)
                if ids is None:
                    found = self.piece(p.encode())
                    ids = struct.pack(f"<{len(found)}I", *found)
                if len(seen) >= KEPT_PIECES:  # what was in use lately stays at hand
                    self.seen_before, self.seen = seen, {}
                    seen = self.seen
                if len(p) <= KEPT_CHARS:
                    seen[p] = ids
            out.append(ids)
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder_for(key: str, vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of a vocabulary; it stays for the next task, the last vocabulary's only."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _decoder(vocabulary: Vocabulary) -> Callable[[bytes | None], bytes | None]:
    name = {i: t for t, i in (vocabulary.tokens | vocabulary.whole).items()}.get
    none = b""
    return lambda packed: None if packed is None else b"".join([name(i, none) for i in np.frombuffer(packed, "<u4").tolist()])


def _with_binary(table: DataFrame, source: str, kind: str, targets: list[str], make: Callable[[], Callable]) -> DataFrame:
    """``table`` with binary columns: the tuple that a function, made once per task, gives of a ``source`` value. Rows leave
    in batches of a few megabytes of values."""
    out = [c for c in table.columns if c.lower() not in {t.lower() for t in targets}]
    schema = table.select(*[F.col(f"`{c}`") for c in out]).schema
    for t in targets:
        schema = schema.add(t, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            lo, held, size = 0, [], 0
            for hi, x in enumerate(b.column("_value").cast(kind), 1):
                held.append(f(x.as_py()))
                size += sum(len(v or b"") for v in held[-1])
                if size >= OUT_BYTES or hi == b.num_rows:
                    values = [pa.array([r[k] for r in held], pa.binary()) for k in range(len(targets))]
                    yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[: len(out)]], *values], [*out, *targets])
                    lo, held, size = hi, [], 0

    return table.select(*[F.col(f"`{c}`") for c in out], F.col(f"`{source}`").alias("_value")).mapInArrow(run, schema)


def encoded(documents: DataFrame, vocabulary: Vocabulary, text: str = "text", decode: bool = False) -> DataFrame:
    """The documents with ``ids``: the ids of the whole text, packed as little-endian unsigned 32-bit integers. With
    ``decode`` also ``decoded``, the bytes that the ids stand for, in the same pass."""
    shared, key = documents.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.digest

    def make():
        encoder = encoder_for(key, shared.value)
        if not decode:
            return lambda t: (encoder.text(t),)

        def both(t: str | None) -> tuple[bytes, bytes]:
            ids = encoder.text(t)
            return ids, encoder.decode(ids)

        return both

    return _with_binary(documents, text, "string", ["ids", "decoded"][: 1 + decode], make)


def decoded(table: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """The table with ``decoded``: the bytes that packed ids stand for."""
    shared = table.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        decode = _decoder(shared.value)
        return lambda packed: (decode(packed),)

    return _with_binary(table, ids, "binary", ["decoded"], make)


def op13_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document the number of ids of its whole text, the digest of the packed ids and that of the bytes they decode to."""
    if rank_file is None or pattern is None:
        import public_tokenizers

        rank_file, pattern = rank_file or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    vocabulary = Vocabulary.load(rank_file, pattern)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(documents, vocabulary, decode=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
