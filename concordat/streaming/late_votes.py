"""Votes that come late: an item is decided at a quorum or at its deadline, whichever comes first in event time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_dir

BUCKETS = 1_024
OUT = "item_id bigint, label string, n_votes int, reason string, decided_us bigint"


def decision(votes: list[list], quorum: int, wait_us: int) -> tuple[int, str, int, str]:
    """(time, label, votes counted, reason) for votes [time, model, label] of one item.

    Votes count in the order of time, then model, a model's first one only, while they come before the deadline, which is
    ``wait_us`` after the first. The item is decided by the vote that gives a label ``quorum`` votes, or else at the deadline
    by the label with most votes, of equals the one voted for first.
    """
    votes = sorted(votes)
    deadline, counts, models = votes[0][0] + wait_us, {}, set()
    for at, model, label in votes:
        if at >= deadline:
            break
        if model in models:
            continue
        models.add(model)
        counts[label] = counts.get(label, 0) + 1
        if counts[label] == quorum:
            return at, label, len(models), "quorum"
    return deadline, max(counts, key=counts.get), len(models), "deadline"  # the first of equals: they stand in order


def late_votes(votes: DataFrame, quorum: int, wait: timedelta, late: str, keep: timedelta, buckets: int = BUCKETS) -> DataFrame:
    """Decisions (``OUT``) on a stream of votes(item_id, model, label, ts).

    An item's votes are its state; items are dealt by a hash to ``buckets`` keyed states, as a call for each item costs far
    more than the item's votes. ``buckets`` must stay the same while a run goes on. An item has a timer at the time of its
    decision as far as is known, a bucket one at the least of its items' timers. It fires once the watermark (the latest time
    seen less ``late``) has passed it, so all votes up to there have come and the decision is the same in whatever order and
    batches they did. What is left is a mark until when the item is closed, ``keep`` after the decision: votes before that are
    dropped, later ones open the item anew, and without any the mark goes. Votes behind the watermark are dropped. Null items,
    models, labels and times are left out.
    """
    wait_us, keep_us = wait // timedelta(microseconds=1), keep // timedelta(microseconds=1)

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items = {i: x for i, *x in json.loads(state.get[0])} if state.exists else {}  # item: [timer, closed, votes]
        passed, out, came = state.getCurrentWatermarkMs(), [], set()
        for f in frames:
            for i, *vote in zip(*(f[c].tolist() for c in ("item_id", "us", "model", "label")), strict=True):
                items.setdefault(i, [0, 0, []])[2].append(vote)
                came.add(i)
        for i in [i for i, x in items.items() if i in came or x[0] < passed]:
            _, closed, held = items[i]
            held = [v for v in held if not closed or v[0] >= closed]
            while held:
                at, label, n, reason = decision(held, quorum, wait_us)
                if -(-at // 1000) >= passed:  # timers stand at whole milliseconds
                    break
                out.append((i, label, n, reason, at))
                closed = at + keep_us
                held = [v for v in held if v[0] >= closed]
            timer = -(-(at if held else closed) // 1000)
            if held or timer >= passed:
                items[i] = [timer, closed, held]
            else:
                del items[i]
        if items:
            state.update((json.dumps([(i, *x) for i, x in items.items()]),))
            state.setTimeoutTimestamp(max(min(x[0] for x in items.values()), passed + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["item_id", "label", "n_votes", "reason", "decided_us"])

    rows = votes.where("item_id IS NOT NULL AND model IS NOT NULL AND label IS NOT NULL AND ts IS NOT NULL")
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int").alias("bucket")
    of = lambda c, kind: F.col(c).cast(kind).alias(c)
    rows = rows.withWatermark("ts", late).select(bucket, of("item_id", "bigint"), of("model", "string"), of("label", "string"), "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("bucket").applyInPandasWithState(handle, OUT, "items string", "append", GroupStateTimeout.EventTimeTimeout)


def replayed(rows: DataFrame, ts: str, slices: int) -> DataFrame:
    """A table as a stream of ``slices`` batches in the order of ``ts``; each slice is one job's files."""
    spark: SparkSession = rows.sparkSession
    path = shared_dir(spark, "replay")
    bounds = rows.agg(F.percentile_approx(ts, [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    edges = [None, *sorted(set(bounds)), None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = rows.where(F.lit(True) if lo is None else F.col(ts) > lo).where(F.lit(True) if hi is None else F.col(ts) <= hi)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
