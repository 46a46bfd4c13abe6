"""Operator 8: n-gram Jaccard self-join with token-combination prefixes.

A document's set holds its distinct word shingles. Shingles are ordered globally, rare ones first, and two linked sets
must share a signature of their prefixes: a rare shingle counts alone, a frequent one only combined with another of the
same class. The number of classes grows with the sets: pairs whose larger set has 16 to 63, 64 to 255, 256 to 1023 ...
shingles use classes in proportion, so a class has a few shingles of a prefix and a set's signatures grow like its
shingles, not like their square; a set whose partners may fall into the next range gives signatures for both. Prefixes are
extended until they survive as many missing shingles as the threshold allows, counting x for x rare ones and x - 1 for x
of one frequent class; so linked sets share at least one signature, whatever the order. Sets under 16 shingles index the
shingles of their plain prefix alone.

1. One pass over the texts gives each document's set size and a fingerprint of its set, and packed runs of sorted
   shingle hashes by hash range. Each range is merged alone: hashes found twice, and those found more than ``FREQUENT``
   times, go into two filters of fixed size. The filters only decide the order and skip shingles found once; false
   positives cost time, never links.
2. A second pass emits (signature, set). Lists of rare signatures have at most ``FREQUENT`` members; others are salted.
   Copies of a set within a task give its signatures once.
3. Each list's least member leads it. A pair of leader and member is dropped if sizes, positions or the sets' 1024-bit
   masks (a bit set in one mask only is a missing shingle) rule the link out; for what is left the texts are read, and
   after a bound from 16-bit codes of the shingles the rest is verified exactly on whole sets. Links make components.
   Lists of two, and those whose members are all in one component, are done; the others go on with 8, 128, 2048 ...
   further leaders against members of other components, again through sizes, positions and whole masks, until every pair
   of a list is compared or connected. Tasks stream the lists, long ones in parts, and a pair comes from the first list that
   both members are in, however many they share. No list is gathered in a task.

Fingerprints of sets and shingles have 64 bits. Result: one row per document with the least doc_id of its component.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing, their own doc_id is the
component; equal sets always link; repeated rows stay repeated; extra columns are ignored; a null doc_id keeps its row,
and gets the least non-null doc_id of its component (null if there is none, or if the set is empty). ``percent`` below 50
is refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import BROADCAST_ROWS, Chunk, chunks, drop_tables, if_few, mix, release_shuffles, texts_of, tidy, written
from .components import components
from .seen_filters import PACKED, RUN, SeenFilters, packed, range_bits_for

SHINGLE, PERCENT = 5, 75
FREQUENT, SALTS, MASK_WORDS = 32, 16, 16
PLAIN, STEP = 16, 4  # sets under PLAIN shingles index single ones; each size range ends at STEP times its start
STEP_OF_CLASSES = np.uint64(0x9FB21C651E98DF25)


def token_sets(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted."""
    doc, h = c.shingles(size)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
        doc, h = doc[new], h[new]
    return doc, h


def set_keys(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint of each set: the wrapping sum of its mixed hashes."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))))
    first = np.searchsorted(doc, np.arange(n + 1))
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def set_masks(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x MASK_WORDS words with a bit for each shingle."""
    bits = np.zeros((n, MASK_WORDS * 64), bool)
    bits[doc, (h % np.uint64(MASK_WORDS * 64)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _pass_one(size: int, range_bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("mask", pa.list_(pa.int64())), *PACKED])

    def runs(held: list[np.ndarray]) -> pa.RecordBatch:
        columns = packed(held, range_bits)
        k = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(k, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))] + columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, seen = [], 0, set()
        for b in batches:
            for ids, texts in chunks(b.column("doc_id").to_pylist(), texts_of(b)):
                doc, h = token_sets(Chunk(texts, lower=True), size)
                n, k = np.bincount(doc, minlength=len(texts)), len(texts)
                keys = set_keys(doc, h, k)
                at = np.arange(0, MASK_WORDS * k + 1, MASK_WORDS, dtype=np.int32)
                mask = pa.ListArray.from_arrays(pa.array(at), pa.array(set_masks(doc, h, k).reshape(-1)))
                own = [pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(keys), mask]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(k, t) for _, t in PACKED)], schema=schema)
                held.append(h[_unseen(keys, seen)[doc]])
                kept += len(held[-1])
                if kept >= RUN:
                    yield runs(held)
                    held, kept = [], 0
        if kept:
            yield runs(held)

    return run


def _unseen(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets are new; ``seen`` holds those before in this task and is brought up to date."""
    out = np.zeros(len(keys), bool)
    for i, x in enumerate(keys.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _ranges(n: int, percent: int) -> list[int]:
    """Where the size ranges start in which a set of ``n`` shingles may be linked: that of the larger set counts."""
    start, out = PLAIN, []
    while start <= n * 100 // percent:
        if n < start * STEP:
            out.append(start)
        start *= STEP
    return out


def _classes(start: int, percent: int) -> int:
    """So many that the least set of the range's pairs still shares twice as many shingles as there are classes."""
    return max(1, start * percent * percent // 20_000)


def _combined(h: np.ndarray, need: int, classes: int) -> np.ndarray:
    """Pair signatures of the extended prefix of a set: ``h`` has its frequent shingles in order."""
    kind = (mix(h) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    sorted_kind = kind[order]
    nth = np.empty(len(h), np.int64)
    nth[order] = np.arange(len(h)) - np.searchsorted(sorted_kind, sorted_kind)
    upto = int(np.searchsorted(np.cumsum(nth > 0), need)) + 1
    salt = np.uint64(int(STEP_OF_CLASSES) * classes % (1 << 64))
    order = order[order < upto]
    x, kind = h[order], kind[order]
    out = [np.zeros(0, np.uint64)]
    for lag in range(1, len(x)):
        same = np.flatnonzero(kind[lag:] == kind[:-lag])
        if not len(same):
            break
        out.append(mix(x[same] * np.uint64(3) + x[same + lag] + salt))
    return np.concatenate(out)


def _signatures(size: int, percent: int, shared):
    names = ["sig", "node", "n", "pos", "hot"]

    def of_chunk(texts: list[bytes], filters: SeenFilters, seen: set[int]) -> list[np.ndarray]:
        doc, h = token_sets(Chunk(texts, lower=True), size)
        n = np.bincount(doc, minlength=len(texts))
        key = set_keys(doc, h, len(texts))
        new = _unseen(key, seen)[doc]
        doc, h = doc[new], h[new]
        freq = filters.holds(filters.often, h)
        order = np.lexsort((h, freq, doc))
        doc, h, freq = doc[order], h[order], freq[order]
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        rank = np.arange(len(h)) - first[doc]
        need = n - (percent * n + 99) // 100 + 1
        rare = np.bincount(doc[~freq], minlength=len(texts))
        single = np.flatnonzero((rank < need[doc]) & (~freq | (n[doc] < PLAIN)))
        single = single[filters.holds(filters.twice, h[single])]
        parts = [(h[single], doc[single], rank[single], freq[single])]
        for d in np.flatnonzero((first[1:] > first[:-1]) & (rare < need)):
            for start in _ranges(int(n[d]), percent):
                s = _combined(h[first[d] + rare[d] : first[d + 1]], need[d] - rare[d], _classes(start, percent))
                parts.append((s, np.full(len(s), d), np.zeros(len(s), np.int64), np.ones(len(s), bool)))
        sig, d, pos, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        return [sig.view(np.int64), key[d], n[d].astype(np.int32), pos.astype(np.int32), hot]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = texts_of(b)
            for _, part in chunks(texts, texts):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in of_chunk(part, shared.value, seen)], names)

    return run


def _tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column("node").to_pylist()
            for part, texts in chunks(nodes, texts_of(b)):
                doc, h = token_sets(Chunk(texts, lower=True), size)
                at = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                same = pa.array(set_keys(doc, h, len(texts)) == np.array(part, np.int64))  # not so if rows share a doc_id
                short = (h >> np.uint64(48)).astype("<u2")  # sorted, as h is within a document
                codes = pa.array([short[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), codes, pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["node", "codes", "tokens"]).filter(same)

    return run


def _by_masks(percent: int, n: str, n2: str, mask: str, mask2: str):
    """Can two sets of n and n2 shingles link: those whose bit the other mask lacks are not shared.

    Words of a mask are columns mask0, mask1 ..., so the test is plain generated code.
    """
    missing = lambda x, y: reduce(add, [F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{i}")))) for i in range(MASK_WORDS)])
    n, n2 = F.col(n).cast("long"), F.col(n2).cast("long")
    shared = F.least(n - missing(mask, mask2), n2 - missing(mask2, mask))
    return (100 + percent) * shared >= percent * (n + n2)


def _words(name: str) -> list:
    return [F.col("mask")[i].alias(f"{name}{i}") for i in range(MASK_WORDS)]


def _by_codes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
                found = lambda p, q: int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append((100 + percent) * min(found(x, y), found(y, x)) >= percent * (len(x) + len(y)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Verifier:
    """Verifies pairs (a, b) on whole sets; keeps the sets it has read for later rounds."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, size: int, percent: int):
        self.texts, self.nodes, self.size, self.percent = texts, nodes, size, percent
        self.sets: DataFrame | None = None
        self.tables: list[DataFrame] = []

    def _joined(self, pairs: DataFrame, column: str) -> DataFrame:
        """The pairs with a column of both their sets, ta and tb; only sets that some pair needs are moved."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        ends = F.broadcast(ends) if pairs.count() <= BROADCAST_ROWS // 2 else ends.distinct()
        used = self.sets.join(ends, "node", "left_semi")
        of = lambda x: used.select(F.col("node").alias(x), F.col(column).alias(f"t{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b")

    def likely(self, pairs: DataFrame) -> DataFrame:
        of = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), *_words(f"m{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(_by_masks(self.percent, "na", "nb", "ma", "mb")).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """``pairs``: those that the masks allow."""
        pairs = written(pairs, "likely")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        chosen = written(self.nodes.join(wanted, "node", "left_semi").select("node", "doc_id"), "chosen")
        new = written(self.texts.join(if_few(chosen), "doc_id").mapInArrow(tidy(_tokens(self.size)), "node bigint, codes binary, tokens array<bigint>"), "tokens")
        self.sets = new if self.sets is None else self.sets.unionByName(new)
        near = written(self._joined(pairs, "codes").mapInArrow(_by_codes(self.percent), "a bigint, b bigint"), "near")
        both = self._joined(near, "tokens")
        linked = (100 + self.percent) * F.size(F.array_intersect("ta", "tb")) >= self.percent * (F.size("ta") + F.size("tb"))
        self.tables += [pairs, chosen, new, near]
        return written(both.where(linked).select("a", "b"), "links")


def _may_link(percent: int):
    """Length and position bounds on two members of a list: columns n, pos and n2, pos2."""
    n, pos, n2, pos2 = (F.col(x).cast("long") for x in ("n", "pos", "n2", "pos2"))
    shared = F.least(n - pos, n2 - pos2)  # what is left from the first common shingle on; pairs pass position 0
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & ((100 + percent) * (shared + F.least(pos, pos2)) >= percent * (n + n2))


HELD = 1 << 16  # pairs that are tested, or held back to be made distinct, at once
LEAST, NO_LIST = 16, np.int64((1 << 63) - 1)  # so many first lists of a member are known to all its rows
PART = 4_096  # members of an open list that a part of it has, besides copies of the leaders


class _Pairs:
    """Pairs that a task gives, each once as long as few are held."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
        self.n += len(a)
        if self.n > 2 * HELD:  # sorted only once HELD more have come
            self.held = [self._distinct()]
            self.n = len(self.held[0])
            if self.n > HELD:
                yield self.batch()

    def _distinct(self) -> np.ndarray:
        x = np.concatenate([np.zeros((0, 2), np.int64), *self.held])
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        return x[np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1)))] if len(x) else x

    def batch(self) -> pa.RecordBatch:
        out = self._distinct()
        self.held, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])


def _least(b: pa.RecordBatch) -> np.ndarray:
    """The rows' column ``least`` as a table of LEAST columns; without that column nothing is known of other lists."""
    out = np.full((b.num_rows, LEAST), NO_LIST)
    if "least" in b.schema.names:
        lists = b.column("least")
        out[np.arange(LEAST) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()
    return out


def _elsewhere(x: np.ndarray, y: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Is the first list that two members share, as far as their ``least`` show it, another one than ``sig``."""
    shared = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x != NO_LIST)
    return shared.any(axis=1) & (x[np.arange(len(x)), shared.argmax(axis=1)] != sig)


def _across(leaders: int, percent: int):
    """Pairs of a list's first ``leaders`` members and later ones of other components that sizes, positions and masks allow.

    Rows come by list, part of it and rank; every part of a long list has copies of its leaders (``home`` is false). A pair is
    given in the first list that both are in, so it leaves once, however many lists and tasks share it; if it has no leader
    there yet, its turn comes in a later round. ``least`` has the first lists of a member; should two members share none of
    these, each list gives the pair. Only the leaders of a part are held.
    """
    columns = ["sig", "node", "n", "pos", "comp", "rank"]

    def rows_of(b: pa.RecordBatch) -> list[np.ndarray]:
        rows = [b.column(x).to_numpy().astype(np.int64) for x in columns]
        names = b.schema.names
        part = b.column("part").to_numpy() if "part" in names else np.zeros(b.num_rows, np.int64)
        home = b.column("home").to_numpy(zero_copy_only=False) if "home" in names else np.ones(b.num_rows, bool)
        mask = np.stack([b.column(f"mask{i}").to_numpy() for i in range(MASK_WORDS)], axis=1).view(np.uint64)  # bits of signed words would be those of their amount
        return [*rows, part, home, mask, _least(b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = _Pairs(), None
        for b in batches:
            if not b.num_rows:
                continue
            rows = rows_of(b)
            if held is not None and (held[0][0], held[6][0]) == (rows[0][0], rows[6][0]):  # the list goes on
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            sig, node, n, pos, comp, rank, part, home, mask, least = rows
            first = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]))))
            start = np.repeat(first, np.diff(np.append(first, len(sig))))
            lead = np.add.reduceat((rank <= leaders).astype(np.int64), first)
            # a member meets the leaders before it
            count = np.where(home, np.minimum(np.repeat(lead, np.diff(np.append(first, len(sig)))), np.arange(len(sig)) - start), 0)
            total, at = np.cumsum(count), 0
            while at < len(sig):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, "right")))
                c = count[at:stop]
                i = np.repeat(np.arange(at, stop), c)
                j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + start[i]
                at = stop
                apart = comp[i] != comp[j]
                i, j = i[apart], j[apart]
                fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                fits &= (100 + percent) * (np.minimum(n[i] - pos[i], n[j] - pos[j]) + np.minimum(pos[i], pos[j])) >= percent * (n[i] + n[j])
                i, j = i[fits], j[fits]
                missing = lambda p, q: np.bitwise_count(mask[p] & ~mask[q]).sum(1, dtype=np.int64)  # noqa: B023, E731
                fits = (100 + percent) * np.minimum(n[i] - missing(i, j), n[j] - missing(j, i)) >= percent * (n[i] + n[j])
                i, j = i[fits], j[fits]
                here = ~_elsewhere(least[i], least[j], sig[i])
                yield from out.add(node[i[here]], node[j[here]])
            last = slice(int(first[-1]), int(first[-1] + lead[-1]))
            held = [x[last].copy() for x in rows] if lead[-1] else None
            if held is not None:
                held[7][:] = False  # as a copy of leaders that were members in their batch
        yield out.batch()

    return run


def _first_lists(ranked: DataFrame) -> DataFrame:
    """(node, least): the first LEAST lists of each member of ``ranked``."""
    return ranked.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LEAST).alias("least"))


def _in_parts(ranked: DataFrame, leaders: int) -> DataFrame:
    """Members of open lists with their part of the list; the leaders of a list of several parts are copied to the others."""
    size = max(PART, 8 * leaders)
    d = ranked.withColumns({"parts": F.expr(f"cast((members - 1) div {size} + 1 AS int)"), "home": F.lit(True)})
    d = d.withColumn("part", F.pmod("rank", "parts").cast("int"))
    copies = d.where((F.col("rank") <= leaders) & (F.col("parts") > 1)).withColumn("home", F.lit(False))
    copies = copies.withColumn("part", F.explode(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part"))))
    return d.unionByName(copies).drop("parts", "members")


def linked_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``."""
    if percent < 50:
        raise ValueError("percent below 50")
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    range_bits = range_bits_for(documents.count())
    first = written(texts.mapInArrow(tidy(_pass_one(size, range_bits)), "doc_id bigint, n int, node bigint, mask array<bigint>, part int, v binary, c binary"), "sets")
    shared = spark.sparkContext.broadcast(SeenFilters.build(first.where("part IS NOT NULL"), range_bits, frequent))
    docs = written(first.where("part IS NULL").select("doc_id", "n", "node"), "documents")
    # one document of each distinct set
    nodes = first.where("part IS NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "n", "mask")).alias("d"))
    nodes = written(nodes.select("node", "d.*"), "nodes")
    drop_tables(spark, [first])

    # lists: every member but the least one, which is its leader
    rows = texts.mapInArrow(tidy(_signatures(size, percent, shared)), "sig bigint, node bigint, n int, pos int, hot boolean")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod("node", F.lit(SALTS))).otherwise(0).cast("int"))
    order = Window.partitionBy("sig", "salt").orderBy("node", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.first(F.struct("node", "n", "pos")).over(order)
    place = Window.partitionBy("sig", "salt").orderBy("node", "pos")

    def lead(d: DataFrame) -> DataFrame:
        """Members with their list's leader; ``pair``: the member is its list's only one besides the leader."""
        d = d.withColumns({"head": head, "before": F.lag("node").over(place), "after": F.lead("node").over(place)})
        d = d.where("NOT before <=> node").withColumn("pair", F.expr("NOT hot AND before = head.node AND after IS NULL"))
        return d.drop("before", "after")

    level = written(lead(rows).where("hot OR head.node <> node"), "lists")
    tops = level.where("hot AND head.node = node").drop("head", "pair").withColumn("salt", F.lit(0))
    lists = level.where("head.node <> node").unionByName(lead(tops).where("head.node <> node"))
    lists = lists.select("sig", "node", "n", "pos", F.col("head.node").alias("node2"), F.col("head.n").alias("n2"), F.col("head.pos").alias("pos2"))
    release_shuffles(spark)
    pairs = written(lists.where(_may_link(percent)).select(F.col("node2").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    verifier = _Verifier(texts, nodes, size, percent)
    links = verifier.links(verifier.likely(pairs))
    release_shuffles(spark)
    old = [pairs, level, nodes]
    comp = components(links)
    # all pairs with a leader are compared; go on with lists whose other members are in several components
    rest = level.where("head.node <> node AND NOT pair").select("sig", "node", "n", "pos").unionByName(level.where("hot AND head.node = node").select("sig", "node", "n", "pos"))
    leaders, in_list = 8, Window.partitionBy("sig").orderBy("node", "pos")
    while True:
        placed = rest.join(if_few(comp), "node", "left").select("sig", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"))
        of_list = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("who"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("who2")]
        # of lists with the same members one is enough, as no list's positions rule out a link
        open_lists = placed.groupBy("sig").agg(*of_list).where("lo <> hi").groupBy("members", "who", "who2").agg(F.min("sig").alias("sig")).select("sig", "members")
        ranked = written(placed.join(open_lists, "sig").withColumn("rank", F.row_number().over(in_list)), "open")
        old += [ranked]
        if ranked.isEmpty():
            break
        dealt = _in_parts(ranked, leaders).join(nodes.select("node", *_words("mask")).join(_first_lists(ranked), "node"), "node")
        dealt = dealt.repartition("sig", "part").sortWithinPartitions("sig", "part", "rank")
        more = dealt.mapInArrow(tidy(_across(leaders, percent)), "a bigint, b bigint").distinct()
        found = verifier.links(more)
        if not found.isEmpty():
            links = written(links.union(found), "links")
            comp = components(links)
        rest = ranked.where(F.col("rank") > leaders).select("sig", "node", "n", "pos")
        leaders *= 16

    placed = docs.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "comp", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )
    out = written(out, "components")
    drop_tables(spark, [*old, *verifier.tables, links, docs])
    return out


def first_of_groups(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` that are their group's first (least doc_id); other columns are kept."""
    groups = linked_components(documents, size, percent)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    return documents.join(keep, "doc_id", "left_semi").unionByName(documents.where("doc_id IS NULL")).select(documents.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM sides UNION SELECT r.doc_id, l.b FROM reach r JOIN sides l ON r.other = l.a),
least_ AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT sh.doc_id, CAST(len(sh.s) AS bigint) AS n_shingles, least(sh.doc_id, coalesce(m, sh.doc_id)) AS component_id FROM sh LEFT JOIN least_ l ON l.doc_id = sh.doc_id
"""
