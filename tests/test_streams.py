"""Streams that keep state against the same decisions over the whole table, with failures in mid-stream."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import SF

from concordat.plans.catalogue import ORACLE_SQL, QUERIES
from concordat.streaming import late_votes, windows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "item_id bigint, model string, label string, ts timestamp"


def votes(n, seed):
    rnd = random.Random(seed)
    rows = []
    for item in range(n):
        first = rnd.randint(0, 200)
        for _ in range(rnd.randint(1, 7)):
            rows.append((item, f"m{rnd.randint(0, 4)}", rnd.choice("AB"), START + timedelta(hours=first + rnd.randint(0, 60))))
    return rows


def slices(spark, path, rows, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n] if n == 1 else rows[i * len(rows) // n : (i + 1) * len(rows) // n], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return late_votes.late_votes(s, 2, timedelta(hours=24), "12 hours", timedelta(days=30))


def expected(rows, late=timedelta(hours=12)):
    by = {}
    for i, m, x, t in rows:
        if None not in (i, m, x, t):
            by.setdefault(i, []).append([int(t.timestamp() * 1e6), m, x])
    end = max(v[0] for x in by.values() for v in x) - late // timedelta(microseconds=1)
    out = {i: late_votes.decision(v, 2, 24 * 3600 * 10**6) for i, v in by.items()}
    return sorted((i, x, n, r, at) for i, (at, x, n, r) in out.items() if at < end)


def test_decision():
    assert late_votes.decision([[5, "b", "Y"], [0, "a", "X"], [5, "a", "Y"]], 2, 10) == (10, "X", 2, "deadline")
    assert late_votes.decision([[0, "a", "X"], [9, "b", "X"], [10, "c", "Y"]], 2, 10) == (9, "X", 2, "quorum")
    assert late_votes.decision([[0, "a", "X"], [10, "b", "X"]], 2, 10) == (10, "X", 1, "deadline")
    assert late_votes.decision([[0, "a", "X"], [0, "b", "Y"]], 3, 10) == (10, "X", 2, "deadline")


def test_out_of_order_within_the_watermark(spark, tmp_path):
    """Votes come up to some hours out of order, in six batches; nulls are left out and repeated votes count once."""
    rows = votes(60, 3)
    rows += rows[:15]
    rnd = random.Random(4)
    rows.sort(key=lambda r: (r[3] + timedelta(hours=rnd.randint(0, 11)), r[:3]))
    rows = [(None, "m", "A", START), (1, None, "A", START), (1, "m", None, START), (1, "m", "A", None), *rows]
    slices(spark, f"{tmp_path}/in", rows, 6)
    got = sorted(tuple(r) for r in windows.run_to_table(stream(spark, f"{tmp_path}/in"), "late", "append", f"file://{tmp_path}/out").collect())
    assert got == expected(rows) and len(got) > 40
    assert {r[3] for r in got} == {"quorum", "deadline"}


def test_items_share_keyed_states(spark, tmp_path):
    """Three keyed states hold all items, and decisions are the same."""
    rows = sorted(votes(40, 5), key=lambda r: (r[3], r[:3]))
    slices(spark, f"{tmp_path}/in", rows, 3)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = late_votes.late_votes(s, 2, timedelta(hours=24), "12 hours", timedelta(days=30), buckets=3)
    got = sorted(tuple(r) for r in windows.run_to_table(out, "late", "append", f"file://{tmp_path}/out").collect())
    assert got == expected(rows) and len(got) > 20


def test_restart_in_mid_stream(spark, tmp_path, monkeypatch):
    """The run dies while a batch is written; another run goes on from the checkpoint, and no item is lost or decided twice."""
    rows = sorted(votes(50, 8), key=lambda r: (r[3], r[:3]))
    slices(spark, f"{tmp_path}/in", rows, 5)
    out, real, calls = f"file://{tmp_path}/out", spark.createDataFrame, []

    def dies(*a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(spark, "createDataFrame", dies, raising=False)
    with pytest.raises(Exception, match="lost"):
        windows.run_to_table(stream(spark, f"{tmp_path}/in"), "late", "append", out)
    monkeypatch.undo()
    before = windows.progress(spark, out).count()
    got = sorted(tuple(r) for r in windows.run_to_table(stream(spark, f"{tmp_path}/in"), "late", "append", out).collect())
    assert got == expected(rows)
    p = windows.progress(spark, out).collect()
    assert before == 2 and len(p) == len({r["batch"] for r in p}) >= 5 and sum(r["n"] for r in p) == len(got)


def test_closed_items_expire(spark, tmp_path):
    """Votes on a closed item are dropped; after the mark has expired the item opens anew."""
    day = timedelta(days=1)
    rows = [(1, "a", "A", START), (1, "b", "A", START + day / 4), (1, "c", "B", START + day / 2), (2, "a", "B", START + 3 * day)]
    rows += [(1, "d", "B", START + 4 * day), (2, "b", "B", START + 60 * day), (3, "a", "A", START + 61 * day), (1, "a", "B", START + 70 * day), (3, "b", "A", START + 90 * day)]
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = [(r[0], r[1], r[3]) for r in windows.run_to_table(stream(spark, f"{tmp_path}/in"), "late", "append", f"file://{tmp_path}/out").collect()]
    assert sorted(got) == [(1, "A", "quorum"), (1, "B", "deadline"), (2, "B", "deadline"), (2, "B", "deadline"), (3, "A", "deadline")]


def test_query(spark, duck):
    got = sorted(tuple(r) for r in QUERIES["stream_late_votes"](spark, SF).select("item_id", "label", "n_votes", "reason", "decided_us").collect())
    assert got == sorted(duck.execute(f"SELECT item_id, label, n_votes, reason, decided_us FROM ({ORACLE_SQL['stream_late_votes']})").fetchall())
    assert {r[3] for r in got} == {"quorum", "deadline"}
