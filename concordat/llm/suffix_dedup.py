"""Operator 5: removal of repeated passages by column-wise multi-document suffix sorting.

A byte goes if a 100-byte string that covers it also starts earlier (in a smaller doc_id, or earlier in the same
document). Equal strings are found by a collection Burrows-Wheeler transform that is built column by column:

1. Each 100-byte window has an *anchor*, the least hash among its 20-byte strings (the leftmost of equal ones). Equal
   windows have equal anchors at equal offsets. Consecutive windows with one anchor form a segment of at most 180 bytes;
   a document falls into about one segment per 41 bytes. A first pass over the texts gathers, as packed runs, which
   anchors occur twice, into a filter of fixed size; false positives cost time only.
2. A second pass emits a key (anchor, fingerprint of the segment, place) for each segment whose anchor may occur twice.
   A combining aggregation finds the first of equal segments; all others are lost whole. However often a passage occurs,
   it so leaves one segment, and only anchors with several distinct segments go on, with their bytes.
3. Shuffled and sorted by anchor, the segments are the sequential external files that a task reads. It works on runs of
   whole anchors, all segments laid with their anchors in one column. Round by round, from the last column to the first,
   one symbol of every segment is inserted: the new suffix order is the stable counting sort of the old order by the
   symbols (the transform's LF mapping), and the common prefix of two neighbours is one more than the least common
   prefix between their places in the old order. Neighbours with 100 common symbols form a class; all its members but
   the earliest lose that window. An anchor with more than ``HOT`` distinct segments would make an unbounded group; its
   windows are compared by fingerprint instead.
4. The lost windows of each document are merged and cut out.

Edge cases: null counts as empty; texts under 100 bytes lose nothing; matches never cross documents; a null doc_id's
row is kept whole and takes no part; repeated rows with one doc_id must be equal, and count once; extra columns are
ignored by the digest and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import BYTE_CODE, chunks, drop_tables, mix, powers, release_shuffles, texts_of, tidy, written
from .seen_filters import RUN, SeenFilters, packed, range_bits_for

LENGTH, ANCHOR, HOT = 100, 20, 100_000
PIECE, BATCH = 1 << 20, 20_000
SPREAD = LENGTH - ANCHOR  # an anchor starts 0..SPREAD bytes after its window

SEGMENT = "anchor bigint, doc_id bigint, start bigint, off int, seg binary"


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, start, windows, anchor offset, anchor, bytes, place in bytes) of all segments, a piece of the texts at a time.

    Long texts are worked through in pieces that overlap by LENGTH - 1 bytes, so memory is bounded.
    """
    piece, size = [], 0
    for d, t in enumerate(texts):
        for at in range(0, max(0, len(t) - LENGTH + 1), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            piece.append((d, at, part))
            size += len(part)
            if size >= PIECE:
                yield _segments(piece)
                piece, size = [], 0
    if piece:
        yield _segments(piece)


def _segments(piece: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(p[2] for p in piece), np.uint8)
    lens = np.array([len(p[2]) for p in piece])
    first = np.concatenate(([0], np.cumsum(lens)))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[raw] * powers(len(raw)))))
    h = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * powers(len(raw), True)[: len(raw) - ANCHOR + 1])
    place = np.arange(len(h), dtype=np.uint64)
    low = (h & ~np.uint64((1 << 23) - 1)) | place  # pieces are far shorter than 2**23
    width = 1
    while 2 * width <= SPREAD + 1:  # minima over 2, 4, 8 ... places
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width <= SPREAD:
        rest = SPREAD + 1 - width
        low = np.minimum(low[:-rest], low[rest:])
    anchor = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
    valid = np.zeros(len(anchor), bool)
    for lo, hi in zip(first, first[1:], strict=False):
        valid[lo : hi - LENGTH + 1] = True
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~valid[:-1])) & valid
    at = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.concatenate(((anchor[1:] != anchor[:-1]) | ~valid[1:], [True]))) + 1
    which = np.searchsorted(first, at, "right") - 1
    doc = np.array([p[0] for p in piece])[which]
    start = at - first[which] + np.array([p[1] for p in piece])[which]
    return doc, start, stop - at, anchor[at] - at, h[anchor[at]], raw, at


def _anchor_runs(range_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], 0
        for b in batches:
            for *_, h, _, _ in segments(texts_of(b)):
                held.append(h)
                kept += len(h)
                if kept >= RUN:
                    yield pa.RecordBatch.from_arrays(packed(held, range_bits), ["part", "v", "c"])
                    held, kept = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays(packed(held, range_bits), ["part", "v", "c"])

    return run


def _keys(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for doc, start, n, off, h, raw, at in segments(texts_of(b)):
                keep = np.flatnonzero(shared.value.holds(shared.value.twice, h))
                lo, size = at[keep], n[keep] + LENGTH - 1
                prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[raw] * powers(len(raw)))))
                print_ = mix((prefix[lo + size] - prefix[lo]) * powers(len(raw) + 1, True)[lo] + (size * 128 + off[keep]).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[keep].view(np.int64)), pa.array(print_.view(np.int64)), pa.array(ids[doc[keep]]), pa.array(start[keep]), pa.array(off[keep].astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["anchor", "print", "doc_id", "start", "off", "size"],
                )

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with their lists of segments to one row per segment."""
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        for parts, texts in chunks(list(zip(ids, b.column("parts").to_pylist(), strict=True)), texts_of(b)):
            rows = [(p["anchor"], i, p["start"], p["off"], t[p["start"] : p["start"] + p["size"]]) for (i, ps), t in zip(parts, texts, strict=True) for p in ps]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "doc_id", "start", "off", "seg"])


def lost_windows(off: np.ndarray, segs: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """For segments in order of preference: lost[i, j], the window at column j of segment i starts in an earlier segment.

    Column ``length - anchor`` is where every anchor starts. One symbol per segment is inserted each round.
    """
    n, left = len(segs), length - anchor
    width = left + length
    lens = np.fromiter(map(len, segs), np.int64, n)
    columns = np.zeros((n, width), np.uint16)  # 0: the segment has no symbol there
    row = np.repeat(np.arange(n), lens)
    place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(left - off, lens)
    columns[row, place] = np.frombuffer(b"".join(segs), np.uint8).astype(np.uint16) + 1
    columns = np.ascontiguousarray(columns.T)
    lost = np.zeros((width, n), bool)
    order, common = np.arange(n), np.zeros(n + 1, np.uint8)  # the last entry closes ranges that end with the table
    for j in range(width - 1, -1, -1):
        symbol = columns[j][order]
        to = np.argsort(symbol, kind="stable")
        order, symbol = order[to], symbol[to]
        new = np.zeros(n + 1, np.uint8)
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
        if len(same):
            bounds = np.empty(2 * len(same), np.int64)
            bounds[0::2], bounds[1::2] = to[same - 1] + 1, to[same] + 1
            new[same] = np.minimum(np.minimum.reduceat(common, bounds)[0::2] + 1, length)
        common = new
        if j <= left and (common >= length).any():
            first = np.flatnonzero(common[:n] < length)
            best = np.minimum.reduceat(order, first)
            lost[j, order] = order != np.repeat(best, np.diff(np.append(first, n)))
    return lost.T


def _lost_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by anchor, doc_id, start; gives (doc_id, lo, hi), byte ranges that are lost."""

    def solved(table: pa.Table) -> pa.RecordBatch:
        doc, start = table["doc_id"].to_numpy(), table["start"].to_numpy()
        off = table["off"].to_numpy().astype(np.int64)
        # preference among segments of one anchor: document, then place of the anchor
        order = np.lexsort((start + off, doc))
        new = np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)))
        order = order[new]  # a repeated row's segments count once
        segs = table["seg"].to_pylist()
        lost = lost_windows(off[order], [segs[i] for i in order])
        edge = np.diff(np.pad(lost, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        k = order[i]
        base = start[k] - (SPREAD - off[k])
        return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(base + lo), pa.array(base + hi - 1 + LENGTH)], ["doc_id", "lo", "hi"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BATCH:
            table = pa.Table.from_batches(held)
            a = table["anchor"].to_numpy()
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
            if cut:
                yield solved(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield solved(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two fingerprints of each window of a segment, with its place."""
    for b in batches:
        w1, w2, doc, place = [], [], [], []
        for d, s, seg in zip(b.column("doc_id").to_pylist(), b.column("start").to_pylist(), b.column("seg").to_pylist(), strict=True):
            for i in range(len(seg) - LENGTH + 1):
                h = hashlib.blake2b(seg[i : i + LENGTH], digest_size=16).digest()
                w1.append(int.from_bytes(h[:8], "little", signed=True))
                w2.append(int.from_bytes(h[8:], "little", signed=True))
                doc.append(d)
                place.append(s + i)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (w1, w2, doc, place)], ["w1", "w2", "doc_id", "place"])


def lost_ranges(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, lo, hi): byte ranges of each document that a repeated window covers; they may overlap."""
    spark = documents.sparkSession
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    range_bits = range_bits_for(documents.count())
    runs = texts.select("text").mapInArrow(tidy(_anchor_runs(range_bits)), "part int, v binary, c binary")
    shared = spark.sparkContext.broadcast(SeenFilters.build(runs, range_bits, hot))
    keys = texts.mapInArrow(tidy(_keys(shared)), "anchor bigint, print bigint, doc_id bigint, start bigint, off int, size int")
    keys = written(keys, "keys")
    first = keys.groupBy("anchor", "print").agg(F.min(F.struct("doc_id", "start", "off", "size")).alias("f"), F.count("*").alias("n"))
    first = written(first, "first")
    release_shuffles(spark)
    # equal segments: all but the first are lost whole
    of = first.where("n > 1").select("anchor", "print", F.col("f.doc_id").alias("d"), F.col("f.start").alias("s"))
    copies = keys.join(of, ["anchor", "print"]).where("doc_id <> d OR start <> s")
    copies = written(copies.select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi")), "ranges")
    # anchors with several distinct segments
    several = written(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    drop_tables(spark, [keys])
    chosen = first.select("anchor", "f.*").join(several.where(F.col("n") <= hot).select("anchor"), "anchor", "left_semi")
    rest = _with_bytes(texts, chosen).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    tables = [copies, written(rest.mapInArrow(tidy(_lost_runs), "doc_id bigint, lo bigint, hi bigint"), "ranges")]
    release_shuffles(spark)
    often = several.where(F.col("n") > hot).select("anchor")
    if not often.isEmpty():
        segs = _with_bytes(texts, first.select("anchor", "f.*").join(often, "anchor", "left_semi"))
        windows = written(segs.select("doc_id", "start", "seg").mapInArrow(_windows, "w1 bigint, w2 bigint, doc_id bigint, place bigint"), "windows")
        least = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "place")).alias("f"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "f")
        again = windows.join(least, ["w1", "w2"]).where("doc_id <> f.doc_id OR place <> f.place").select("doc_id", "place").distinct()
        # neighbouring windows are one range; a document has no more windows than bytes
        run = F.col("place") - F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
        runs = again.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("place").alias("lo"), (F.max("place") + LENGTH).alias("hi"))
        tables.append(written(runs.select("doc_id", "lo", "hi"), "ranges"))
        drop_tables(spark, [windows])
    drop_tables(spark, [first, several])
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _with_bytes(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows SEGMENT of the places in ``chosen``: one list per document, as long as its text allows."""
    lists = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "off", "size")).alias("parts"))
    return texts.join(lists, "doc_id").mapInArrow(tidy(_bytes), SEGMENT)


def merged(lo: np.ndarray, hi: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Sorted maximal runs of the union of ranges, within 0..n."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(np.minimum(hi[order], n))
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(lo) - 1)
    return [(int(a), int(b)) for a, b in zip(lo[at], hi[last], strict=True) if b > a]


def cut_out(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in runs:
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def _joined(documents: DataFrame, ranges: DataFrame) -> DataFrame:
    """``documents`` with two more columns at the end, the starts and ends of their ranges, under names that are free."""
    lo, hi = (next(x for x in (f"{n}{'_' * k}" for k in range(len(documents.columns) + 1)) if x not in documents.columns) for n in ("lo", "hi"))
    # one list per document, at most a range per 41 bytes of its text
    lists = ranges.groupBy("doc_id").agg(F.collect_list("lo").alias(lo), F.collect_list("hi").alias(hi))
    return documents.join(lists, "doc_id", "left").select(*documents.columns, lo, hi)


def _runs_of(b: pa.RecordBatch, texts: list[bytes]) -> Iterator[list[tuple[int, int]]]:
    for t, lo, hi in zip(texts, b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
        yield merged(np.array(lo, np.int64), np.array(hi, np.int64), len(t)) if lo else []


def digest(documents: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            size, gone, spans, sha = [], [], [], []
            for t, runs in zip(texts, _runs_of(b, texts), strict=True):
                size.append(len(t))
                gone.append(sum(hi - lo for lo, hi in runs))
                spans.append(len(runs))
                sha.append(hashlib.sha256(cut_out(t, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(sha, pa.string())], names)

    rows = _joined(documents.select("doc_id", F.col("text").cast("binary").alias("text")), ranges)
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated passages cut out of ``text``, all columns kept.

    Bytes of a character that is cut in part go with it. A document of which only white space is left goes.
    """
    rows = _joined(documents, lost_ranges(documents))
    schema, names = documents.schema, documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").to_pylist()
            raw = [(t or "").encode() for t in text]
            cut = [cut_out(t, r).decode("utf-8", "ignore") if r else x for x, t, r in zip(text, raw, _runs_of(b, raw), strict=True)]
            keep = pa.array([x is None or x == t or bool(x.strip()) for x, t in zip(cut, text, strict=True)])
            columns = [pa.array(cut, pa.string()) if x == "text" else b.column(x) for x in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return rows.mapInArrow(tidy(run), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(documents, lost_ranges(documents))
