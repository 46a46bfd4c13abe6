"""Operator 6: benchmark decontamination by the q-gram lemma.

A passage that matches a pattern of m bytes with at most k edits shares at least m + 1 - q * (k + 1) of its q-grams, and
all of them lie on neighbouring diagonals (text place minus pattern place). Texts and benchmark items are compared in
lower case (A-Z) with white space as single blanks. For every document the shared q-grams are counted per pattern in
overlapping diagonal bands of twice the budget, in slices of bounded size; bands that reach the bound are verified by
banded alignment (only the diagonals of the band and a budget to either side, many bands at a time), which gives the
number of edits and the place of the passage. The budget is ``EDITS`` of the pattern's length, for short items so much
less that the bound stays at ``LEAST`` q-grams.

Result: the best passage of each item in each document, that with the fewest edits, of these the first. So once an exact
passage is found, later bands of the same document and item aren't aligned.

The benchmark is the stated query set: it is worked through in blocks of at most ``BLOCK_CHARS`` characters, each
broadcast with its q-gram index against all documents, so what is broadcast is bounded; of several blocks each result is
written before the next begins. Items longer than ``PATTERN`` bytes are cut into overlapping patterns, of which one is
enough. Long texts are scanned in pieces that overlap after white space is reduced.

Items of fewer than q bytes, which have no q-gram, are found by an Aho-Corasick automaton, without edits and only where no
letter or digit stands next to them.

Edge cases: null or empty texts and items never match; an item of fewer than 2 * q + ``LEAST`` - 1 bytes is found only
without edits; repeated rows give repeated results only if their doc_id differs; a null
doc_id is kept by ``uncontaminated`` and not searched; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import LOWER, SPACE, chunks, if_few, mix, texts_of, tidy, written

Q, EDITS, PATTERN, BLOCK_CHARS, PIECE, LEAST = 16, 0.05, 400, 4_000_000, 1 << 18, 4
TABLE_BITS = 22
WORD = np.zeros(256, bool)  # ASCII letters and digits, and bytes of other characters
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
ENTRIES, CELLS = 1 << 19, 1 << 18  # of shared q-grams, and of a row of alignments, held at a time


def normalised(raw: np.ndarray, after_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single blanks, and the place of each in ``raw``."""
    space = SPACE[raw]
    keep = np.flatnonzero(~(space & np.concatenate(([after_space], space[:-1])))) if len(raw) else np.zeros(0, np.int64)
    return np.where(space[keep], np.uint8(32), LOWER[raw[keep]]), keep


def grams(a: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on."""
    if len(a) < Q:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(a) - 7,), "<u8", np.ascontiguousarray(a), strides=(1,)).astype(np.uint64)
    return mix(words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:])


@dataclass
class GramIndex:
    """The q-grams of a block of patterns: sorted hashes, and for each the patterns and places where it stands."""

    items: np.ndarray
    patterns: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    hashes: np.ndarray
    key: np.ndarray  # gram * number of patterns + pattern, rising
    place: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> GramIndex | None:
        ids, patterns = [], []
        for i, text in items:
            a, _ = normalised(np.frombuffer(text.encode().strip(), np.uint8))
            step = PATTERN // 2
            cuts = range(0, max(1, len(a) - PATTERN + step), step) if len(a) > PATTERN else [0]
            for at in cuts:
                part = a[at : at + PATTERN] if len(a) > PATTERN else a
                if len(part) >= Q:
                    ids.append(i)
                    patterns.append(part.tobytes())
        if not patterns:
            return None
        m = np.array([len(p) for p in patterns])
        budget = np.minimum((m * EDITS).astype(np.int64), np.maximum(0, (m + 1 - LEAST) // Q - 1))
        g = [grams(np.frombuffer(p, np.uint8)) for p in patterns]
        h = np.concatenate(g)
        who, place = np.repeat(np.arange(len(g)), [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])
        order = np.argsort(h, kind="stable")
        hashes, gram = np.unique(h[order], return_inverse=True)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return cls(np.array(ids), patterns, budget, m + 1 - Q * (budget + 1), hashes, gram * len(g) + who[order], place[order], table)

    def bands(self, a: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pattern, band) of a joined text where the bound is reached; a band is two widths of diagonals."""
        h = grams(a)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        k = np.searchsorted(self.hashes, h[at])
        ok = (self.hashes[np.minimum(k, len(self.hashes) - 1)] == h[at]) & (doc[at] == doc[at + Q - 1])
        at, k = at[ok], k[ok]
        todo = [(0, len(self.patterns))] if len(at) else []
        while todo:
            lo, hi = todo.pop()
            first, last = (np.searchsorted(self.key, k * len(self.patterns) + p) for p in (lo, hi))
            total = np.cumsum(last - first)
            if total[-1] > ENTRIES and hi - lo > 4:
                todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
            elif total[-1]:
                yield self._counted(at, doc, first, last, total)

    def _counted(self, at: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = np.zeros((0, 4), np.int64)
        cuts = [0, *np.searchsorted(total, np.arange(ENTRIES, total[-1], ENTRIES), "right").tolist(), len(at)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            n = last[i:j] - first[i:j]
            entry = np.repeat(first[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, here = self.key[entry] % len(self.patterns), np.repeat(at[i:j], n)
            band = (here - self.place[entry]) // (self.budget[who] + 1)
            # each diagonal is in two bands of two widths: [b, b + 2) and [b - 1, b + 1)
            d = doc[here]
            d, who, band = np.concatenate((held[:, 0], d, d)), np.concatenate((held[:, 1], who, who)), np.concatenate((held[:, 2], band, band - 1))
            weight = np.concatenate((held[:, 3], np.ones(2 * len(here), np.int64)))
            order = np.lexsort((band, who, d))
            d, who, band, weight = d[order], who[order], band[order], weight[order]
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (who[1:] != who[:-1]) | (band[1:] != band[:-1])))) if len(d) else np.zeros(0, np.int64)
            held = np.stack((d[new], who[new], band[new], np.add.reduceat(weight, new) if len(new) else new), axis=1)
        held = held[held[:, 3] >= self.bound[held[:, 1]]]
        return held[:, 0], held[:, 1], held[:, 2]


def align(patterns: list[bytes], budget: np.ndarray, a: np.ndarray, diagonals: np.ndarray, widths: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(edits, start, end) of the best match of each pattern along its band of the text ``a``; edits -1 beyond its budget.

    Band x has the diagonals ``diagonals[x]`` (text place minus pattern place) and ``widths[x]`` - 1 more; its text is
    ``a[lo[x]:hi[x]]``. All bands advance together, one pattern byte a round; a cell holds edits * 2**32 + start.
    """
    out = np.full((len(patterns), 3), -1, np.int64)
    m = np.fromiter(map(len, patterns), np.int64, len(patterns))
    order = np.lexsort((-m, widths))
    at = 0
    while at < len(order):
        live = order[at : at + max(1, CELLS // int(widths[order[min(len(order) - 1, at + 255)]]) if at + 255 < len(order) else len(order))]
        at += len(live)
        w = int(widths[live].max())
        steps = np.arange(w, dtype=np.int64)
        letters = np.zeros((len(live), int(m[live].max())), np.uint8)
        for r, x in enumerate(live):
            letters[r, : m[x]] = np.frombuffer(patterns[x], np.uint8)
        cell = diagonals[live, None] + steps  # starts; outside the text they cost as much as a missing byte
        cell = np.clip(cell, lo[live, None], hi[live, None]) + np.where(steps < widths[live, None], 0, 1 << 60)
        for i in range(letters.shape[1]):
            place = diagonals[live, None] + i + steps
            inside = (place >= lo[live, None]) & (place < hi[live, None])
            same = inside & (a[np.minimum(np.maximum(place, 0), len(a) - 1)] == letters[:, i, None])
            up = np.concatenate((cell[:, 1:], np.full((len(live), 1), 1 << 60)), axis=1) + (1 << 32)
            cell = np.minimum(cell + (~same).astype(np.int64) * (1 << 32), up)
            cell = np.minimum.accumulate(cell - (steps << 32), axis=1) + (steps << 32)
            least = cell.min(axis=1)
            done = m[live] == i + 1
            for r in np.flatnonzero(done & (least >> 32 <= budget[live])):
                end = int(cell[r].argmin()) + i + 1 + diagonals[live[r]]
                out[live[r]] = least[r] >> 32, least[r] & 0xFFFFFFFF, min(end, hi[live[r]])
            stay = ~done & (least >> 32 <= budget[live])
            if not stay.all() and (done.any() or i % 8 == 0):
                live, letters, cell = live[stay], letters[stay], cell[stay]
                if not len(live):
                    break
    return out


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text of each byte, its place there, start of each text's bytes) of reduced texts, about PIECE at a time."""
    short = [d for d, t in enumerate(texts) if len(t) < PIECE]
    for ids, part in chunks(short, [texts[d] for d in short], PIECE):
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        a, place = normalised(raw)
        start = np.searchsorted(place, first)
        of = np.repeat(np.arange(len(part)), np.diff(start))
        yield a, np.array(ids)[of], place - first[of], start
    for d, t in enumerate(texts):
        if len(t) >= PIECE:
            raw, tail, tail_place = np.frombuffer(t, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int64)
            for at in range(0, len(raw), PIECE):
                a, place = normalised(raw[at : at + PIECE], bool(at and SPACE[raw[at - 1]]))
                a, place = np.concatenate((tail, a)), np.concatenate((tail_place, place + at))
                yield a, np.full(len(a), d), place, np.array([0, len(a)])
                tail, tail_place = a[-2 * PATTERN :], place[-2 * PATTERN :]


def matches(texts: list[bytes], index: GramIndex) -> list[tuple[int, int, int, int, int]]:
    """(document, item, edits, start, end) of the best passage of each item in each text; places are bytes."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, doc, place, first in _pieces(texts):
        if len(a) < Q:
            continue
        part_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for part, who, band in index.bands(a, part_of):
            k = index.budget[who]
            start, items, docs = band * (k + 1) - k, index.items[who], doc[first[part]]
            order = np.lexsort((start, items, docs))
            new = np.concatenate(([True], (np.diff(docs[order]) != 0) | (np.diff(items[order]) != 0))) if len(order) else np.zeros(0, bool)
            nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            turn = np.log2(nth + 1).astype(np.int64)  # 1, 2, 4 ... bands of an item in a text
            for r in range(int(turn.max(initial=-1)) + 1):
                x = [i for i in order[turn == r] if best.get((int(docs[i]), int(items[i])), (1,))[0]]
                if not x:
                    continue
                found = align([index.patterns[p] for p in who[x]], k[x], a, start[x], 4 * k[x] + 2, first[part[x]], first[part[x] + 1])
                for i, (edits, lo, hi) in zip(x, found.tolist(), strict=True):
                    if edits >= 0:
                        got = (edits, int(place[lo]), int(place[max(lo, hi - 1)]) + 1)
                        key = (int(docs[i]), int(items[i]))
                        best[key] = min(best.get(key, got), got)
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


class ShortItems:
    """Items without a q-gram: an automaton over their reduced bytes as Latin-1 characters."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: dict[str, list[int]] = {}
        for i, text in items:
            a, _ = normalised(np.frombuffer(text.encode().strip(), np.uint8))
            if 0 < len(a) < Q:
                self.items.setdefault(a.tobytes().decode("latin-1"), []).append(i)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for t, ids in self.items.items():
            out.add_word(t, (len(t), ids))
        out.make_automaton()
        return out


def short_matches(texts: list[bytes], automaton: ahocorasick.Automaton) -> list[tuple[int, int, int, int, int]]:
    """As ``matches``: (document, item, 0, start, end) of the first place of each short item in each text."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for a, doc, place, first in _pieces(texts):
        if not len(a):
            continue
        joins = WORD[a]
        # a neighbour counts if it is of the same text
        edge = np.zeros(len(a) + 1, bool)
        edge[first[(first > 0) & (first <= len(a))]] = edge[0] = edge[-1] = True
        for end, (n, ids) in automaton.iter(a.tobytes().decode("latin-1")):
            start = end + 1 - n
            if doc[start] != doc[end] or joins[start] and not edge[start] and joins[start - 1] or joins[end] and not edge[end + 1] and joins[end + 1]:
                continue
            for i in ids:
                best.setdefault((int(doc[start]), i), (int(place[start]), int(place[end]) + 1))
    return [(d, i, 0, *v) for (d, i), v in sorted(best.items())]


def contaminated(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the passages of benchmark items found in documents."""
    spark = documents.sparkSession
    items = benchmark.select("item_id", "text").dropna().withColumn("n", F.length("text"))
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_chars))
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = "doc_id bigint, item_id bigint, edits bigint, start bigint, end bigint"
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").distinct()
        pairs = [(r[0], r[1]) for r in block.orderBy("item_id", "text").collect()]
        index, short = GramIndex.build(pairs), ShortItems(pairs)
        if index is None and not short.items:
            continue
        shared = spark.sparkContext.broadcast((index, short))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, short = shared.value
            automaton = short.automaton() if short.items else None
            for b in batches:
                texts = texts_of(b)
                rows = matches(texts, index) if index else []
                rows += short_matches(texts, automaton) if automaton else []
                ids = b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [pa.array([r[j] for r in rows], pa.int64()) for j in range(1, 5)]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "edits", "start", "end"])

        part = texts.mapInArrow(tidy(run), schema)
        if blocks > 1:
            part = written(part, "passages")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` without a benchmark passage, all columns kept."""
    found = written(contaminated(documents, benchmark).select("doc_id").distinct(), "found")
    return documents.join(if_few(found), "doc_id", "left_anti").select(documents.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(documents, benchmark)
