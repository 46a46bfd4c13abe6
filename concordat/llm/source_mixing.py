"""Operator 9: mixing sources to target weights by Pfair scheduling.

Every source's documents, in an order given by a hash, form blocks of ``BLOCK`` rows. A source of weight w (a share of
1) has its block j released at slot floor(j / w) and due by ceil((j + 1) / w); each slot takes the released block with the
earliest deadline. All windows are then met, so at every slot each source has been served less than one block more or
less than its target weight. Weights are taken as they are, by exact rational numbers, and every block of a phase is
scheduled by its own window; no period is repeated.

When a source runs out, a new phase starts with the weights of the others; nothing is dropped. Default weights follow the
square root of the sources' sizes. One task writes the schedule, one row a block, in memory bound by the number of
sources; the driver holds the sources' sizes only.

More than ``MAX_SOURCES`` sources are dealt to at most that many pools by a hash. Pools are scheduled like sources, a pool's
weight being the sum of its sources', and each pool's slots are scheduled among its sources, one task a pool. Within a
phase a source is then served less than two blocks more or less than its target (less than one for each level). The weight
of a source that has run out goes to the others of its pool until these have run out; ``mix_phase`` counts the pools' phases.

A document's index in its source is counted in hash buckets with an offset by bucket, so that no source, however large,
is sorted in one task.

Edge cases: a null source is a source of its own; a weight of 0 or a source without weight comes after all others;
repeated rows and null ids are scheduled like others; an empty table gives an empty result; extra columns are kept by
``mixed``, those with the name of a new column under that name and ``_before``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import written

COLUMNS = ("mix_source", "mix_block", "mix_phase", "mix_slot", "mix_position")
BLOCK, PERIOD, MAX_SOURCES, BUCKET_ROWS, PLAN_ROWS = 16, 1000, 1000, 4_000, 8_192
RANGE_BITS = 12  # buckets in a range of buckets, whose sizes are added up first


def shares(weights: dict[str, float], period: int) -> dict[str, Fraction]:
    """The weights scaled to sum to ``period``, not rounded."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w * period / total for s, w in exact.items()}


def order(share: dict[str, Fraction]) -> Iterator[str]:
    """The source of each slot without end, earliest deadline first."""
    exact = {s: Fraction(w) for s, w in share.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    d, t = sum(whole.values()), 0
    waiting = [(0, s, 0) for s in sorted(whole)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    while True:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * d // whole[s]), s, j))
        _, s, j = heapq.heappop(ready)  # never empty: by the windows each slot has a released block
        yield s
        heapq.heappush(waiting, ((j + 1) * d // whole[s], s, j + 1))
        t += 1


def period_slots(share: dict[str, Fraction]) -> dict[str, list[int]]:
    """For each source the slots of its blocks in the first ``sum(share)`` slots."""
    out: dict[str, list[int]] = {s: [] for s in share}
    for t, s in enumerate(islice(order(share), int(sum(share.values())))):
        out[s].append(t)
    return out


def placed(blocks: dict[str, int], groups: list[dict[str, float]]) -> Iterator[tuple[int, str, int, int]]:
    """(phase, source, block, slot) of all ``blocks``, by slot; a group of weights starts when the one before is through."""
    slot = number = 0
    for group in groups:
        live = {s: w for s, w in group.items() if blocks[s] > 0}
        done = dict.fromkeys(live, 0)
        while live:
            for s in order(live):
                yield number, s, done[s], slot
                done[s] += 1
                slot += 1
                if done[s] == blocks[s]:
                    del live[s]
                    break
            number += 1


@dataclass
class Phase:
    """From ``base`` on, source s's blocks from ``done[s]`` on take ``slots``; ``period`` is the whole ``length``."""

    number: int
    base: int
    length: int
    period: int
    done: dict[str, int]
    slots: dict[str, list[int]]


def phases(blocks: dict[str, int], share: dict[str, float]) -> list[Phase]:
    """The phases until all ``blocks`` are placed, with every slot; for small tables and tests."""
    out: list[Phase] = []
    for number, s, block, slot in placed(blocks, [share]):
        if number == len(out):
            out.append(Phase(number, slot, 0, 0, {}, {}))
        p = out[-1]
        p.length = p.period = slot - p.base + 1
        p.done.setdefault(s, block)
        p.slots.setdefault(s, []).append(slot - p.base)
    return out


def _kept_names(columns: list[str]) -> dict[str, str]:
    """Each column's name beside the new ones."""
    out: dict[str, str] = {}
    for c in columns:
        name = f"{c}_before" if c in COLUMNS else c
        while name != c and name in columns:
            name += "_"
        out[c] = name
    return out


def _groups(weights: dict[str, float]) -> list[dict[str, float]]:
    """Sources with a weight, then those without, which share alike."""
    return [{s: w for s, w in weights.items() if w > 0}, {s: 1.0 for s, w in weights.items() if not w > 0}]


def _scheduled(spark: SparkSession, sizes: dict[str, int], weights: dict[str, float] | None, block: int) -> DataFrame:
    """mix_source, mix_block, mix_phase, mix_slot and _start (the rows before the slot) of every block."""
    weights = {s: math.sqrt(n) for s, n in sizes.items()} if weights is None else {s: weights.get(s, 0.0) for s in sizes}
    blocks, groups = {s: -(-n // block) for s, n in sizes.items()}, _groups(weights)

    def plan(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a slot's rows start after all rows of earlier slots: full blocks but for the last one of each source
        missing, every = 0, placed(blocks, groups)
        while part := list(islice(every, PLAN_ROWS)):
            start = []
            for _, s, j, slot in part:
                start.append(slot * block - missing)
                if j == blocks[s] - 1:
                    missing += blocks[s] * block - sizes[s]
            number, source, j, slot = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(j, pa.int64()), pa.array(number, pa.int32()), pa.array(slot, pa.int64()), pa.array(start, pa.int64())], ["mix_source", "mix_block", "mix_phase", "mix_slot", "_start"])

    return spark.range(0, 1, 1, 1).mapInArrow(plan, "mix_source string, mix_block bigint, mix_phase int, mix_slot bigint, _start bigint")


def _pooled(counts: DataFrame, weights: dict[str, float] | None, block: int) -> tuple[DataFrame, int]:
    """The same schedule of ``counts(mix_source, _n)`` by pools of sources, and the size of the largest source."""
    spark = counts.sparkSession
    weight = F.sqrt("_n")
    if weights is not None:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "mix_source string, _w double")
        counts, weight = counts.join(given, "mix_source", "left"), F.coalesce("_w", F.lit(0.0))
    pools = max(1, min(MAX_SOURCES // 2, -(-2 * counts.count() // MAX_SOURCES)))  # of sources with a weight, and of others
    some = F.when(weight > 0, 0).otherwise(1)
    pool = (some * pools + F.pmod(F.xxhash64("mix_source"), F.lit(pools))).cast("int")
    dealt = counts.select("mix_source", "_n", pool.alias("_pool"), F.when(weight > 0, weight).otherwise(1.0).alias("_w"), F.ceil(F.col("_n") / block).alias("_b"))
    about = dealt.groupBy("_pool").agg(F.sum("_b").alias("b"), F.sum("_w").alias("w"), F.max("_n").alias("most")).collect()  # a row a pool
    blocks = {str(r["_pool"]): r["b"] for r in about}
    groups = [{str(r["_pool"]): r["w"] for r in about if (r["_pool"] >= pools) == late} for late in (False, True)]

    def top(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = placed(blocks, groups)
        while part := list(islice(every, PLAN_ROWS)):
            number, who, j, slot = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(map(int, who), pa.int32()), pa.array(j, pa.int64()), pa.array(number, pa.int32()), pa.array(slot, pa.int64())], ["_pool", "_turn", "mix_phase", "mix_slot"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, mine, last = ["mix_source", "mix_block", "_pool", "_turn", "_missing"], [], None

        def out() -> Iterator[pa.RecordBatch]:
            size, n = {r[1]: r[2] for r in mine}, {r[1]: r[4] for r in mine}
            every = placed(n, [{r[1]: r[3] for r in mine}])
            while part := list(islice(every, PLAN_ROWS)):
                _, who, j, turn = zip(*part, strict=True)
                missing = [n[s] * block - size[s] if k == n[s] - 1 else 0 for s, k in zip(who, j, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(j, pa.int64()), pa.array([last] * len(j), pa.int32()), pa.array(turn, pa.int64()), pa.array(missing, pa.int64())], names)

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("_pool", "mix_source", "_n", "_w", "_b")), strict=True):
                if r[0] != last:
                    if mine:
                        yield from out()
                    mine, last = [], r[0]
                mine.append(r)
        if mine:
            yield from out()

    each = dealt.repartition(2 * pools, "_pool").sortWithinPartitions("_pool", "mix_source").mapInArrow(within, "mix_source string, mix_block bigint, _pool int, _turn bigint, _missing bigint")
    slots = spark.range(0, 1, 1, 1).mapInArrow(top, "_pool int, _turn bigint, mix_phase int, mix_slot bigint")
    found = written(each.hint("merge").join(slots, ["_pool", "_turn"]), "schedule").withColumn("_range", F.shiftright("mix_slot", RANGE_BITS))
    # rows missing from the blocks before: by ranges of slots, then within each
    before = lambda w, c: F.coalesce(F.sum("_missing").over(w.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = found.groupBy("_range").agg(F.sum("_missing").alias("_missing")).withColumn("_wide", F.shiftright("_range", RANGE_BITS))
    wide = ranges.groupBy("_wide").agg(F.sum("_missing").alias("_missing"))
    wide = wide.select("_wide", before(Window.partitionBy(F.lit(0)), "_wide").alias("_far"))  # a row for 2 ** 24 blocks
    ranges = ranges.join(wide, "_wide").select("_range", (F.col("_far") + before(Window.partitionBy("_wide"), "_range")).alias("_so_far"))
    found = found.withColumn("_near", before(Window.partitionBy("_range"), "mix_slot")).join(ranges, "_range")
    start = F.col("mix_slot") * block - F.col("_so_far") - F.col("_near")
    return found.select("mix_source", "mix_block", "mix_phase", "mix_slot", start.alias("_start")), max(r["most"] for r in about)


def mixed(documents: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with mix_source, mix_block (of its source), mix_phase, mix_slot and mix_position.

    ``keep``: the columns that go with the places, all by default; others don't travel. ``mix_position`` numbers all rows of the mix: blocks by slot, rows in a block by their order in the source.
    """
    spark = documents.sparkSession
    own = [F.col(f"`{c}`").alias(name) for c, name in _kept_names(documents.columns if keep is None else keep).items()]
    source = F.coalesce("source", F.lit("\0null"))
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = documents.select(F.struct(*own).alias("_row"), F.col("doc_id").alias("_id"), source.alias("mix_source"), key.alias("_key"))
    counts = rows.groupBy("mix_source").agg(F.count("*").alias("_n"))
    few = counts.limit(MAX_SOURCES + 1).collect()
    if len(few) > MAX_SOURCES:
        schedule, largest = _pooled(written(counts, "sources"), weights, block)
    else:
        sizes = {r[0]: r[1] for r in few}
        schedule, largest = _scheduled(spark, sizes, weights, block), max(sizes.values(), default=1)
    # index of each row in its source: rank in a bucket of its hash plus the sizes of the buckets before
    buckets = 1 << max(0, math.ceil(math.log2(max(1, largest / BUCKET_ROWS))))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_key", 64 - int(math.log2(buckets))) if buckets > 1 else F.lit(0).cast("bigint"))
    count = rows.groupBy("mix_source", "_bucket").agg(F.count("*").alias("_n"))
    # offsets by ranges of buckets, then within each range, so that no task adds up all of a source's buckets
    upto = lambda w: w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.shiftright("_bucket", RANGE_BITS)
    ranges = count.groupBy("mix_source", wide.alias("_bucket")).agg(F.sum("_n").alias("_n"))
    ranges = ranges.select("mix_source", F.col("_bucket").alias("_range"), F.coalesce(F.sum("_n").over(upto(Window.partitionBy("mix_source"))), F.lit(0)).alias("_start"))
    count = count.withColumn("_range", wide).join(ranges, ["mix_source", "_range"])
    within = F.coalesce(F.sum("_n").over(upto(Window.partitionBy("mix_source", "_range"))), F.lit(0))
    count = count.select("mix_source", "_bucket", "_n", (F.col("_start") + within).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("mix_source", "_bucket").orderBy(F.shiftleft("_key", int(math.log2(buckets))), "_id"))
    # the places of each bucket's blocks; the schedule's size is unknown to the planner, so it must not be broadcast
    first = F.floor(F.col("_offset") / block)
    spans = count.select("mix_source", "_bucket", "_offset", F.explode(F.sequence(first, F.floor((F.col("_offset") + F.col("_n") - 1) / block))).alias("mix_block"))
    place = F.struct("mix_block", "mix_phase", "mix_slot", "_start")
    places = spans.join(schedule.hint("merge"), ["mix_source", "mix_block"]).groupBy("mix_source", "_bucket").agg(F.first("_offset").alias("_offset"), F.array_sort(F.collect_list(place)).alias("_places"))
    rows = rows.withColumn("_rank", rank).join(places.hint("merge"), ["mix_source", "_bucket"])
    rows = rows.withColumn("_index", F.col("_offset") + F.col("_rank") - 1)
    at = F.element_at("_places", (F.floor(F.col("_index") / block) - first + 1).cast("int"))
    out = rows.withColumn("_at", at).withColumn("mix_position", F.col("_at._start") + F.col("_index") % block)
    null_source = F.when(F.col("mix_source") != "\0null", F.col("mix_source"))
    return out.select("_row.*", null_source.alias("mix_source"), "_at.mix_block", "_at.mix_phase", "_at.mix_slot", "mix_position")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "mix_source", "mix_block", "mix_phase", "mix_slot", "mix_position")
