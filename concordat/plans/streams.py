"""Streaming queries, run over what the tables hold now."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import late_votes, windows
from .registry import query

#: The table's times have no zone; event time must, so they are read as UTC in any session.
AS_UTC = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"


_EVENTS = "WITH e AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS date)) AS bigint) AS day FROM events)"


@query(f"{_EVENTS} SELECT day, event_type AS label, count(*) AS n FROM e WHERE (day + 1) * 86400000000 <= (SELECT max(epoch_us(ts)) - 2 * 86400000000 FROM events) GROUP BY ALL")
def stream_label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark, two days behind the latest event, has passed; later days are still open. Rows behind the
    watermark are dropped (none here, as the replay is in order)."""
    e = late_votes.replayed(table(spark, sf_dir, "events").select(F.expr(AS_UTC).alias("ts"), "event_type"), "ts", 3)
    t = windows.run_to_table(windows.label_shares(e, "ts", "event_type", "1 day", "2 days"), "label-shares", "append")
    return t.select(F.floor(F.unix_seconds("w.start") / 86400).cast("bigint").alias("day"), "label", "n")


@query(f"{_EVENTS} SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS bigint) AS v, day FROM e) GROUP BY user_id")
def stream_first_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reply of a day to each key. Equal keys are less than a day apart, which is the watermark, so state lives for a
    day and no reply comes twice; rows behind the watermark are dropped (none here, as the replay is in order)."""
    day = F.floor(F.unix_micros("ts") / 86400000000)
    e = table(spark, sf_dir, "events").withColumn("ts", F.expr(AS_UTC)).select("user_id", "ts", F.concat_ws("|", "user_id", "event_type", F.floor("value"), day).alias("key"))
    e = late_votes.replayed(e, "ts", 3)
    t = windows.run_to_table(windows.first_replies(e, "key", "ts", "1 day"), "first-replies", "append")
    return t.groupBy("user_id").agg(F.count("*").alias("n"))


QUORUM, WAIT_HOURS = 2, 6


@query(f"""{_EVENTS}, v AS (SELECT user_id * 100000 + day AS item_id, event_id % 4 AS model, event_type AS label, epoch_us(ts) AS us FROM e),
f AS (SELECT *, min(us) OVER (PARTITION BY item_id) + {WAIT_HOURS} * 3600000000 AS deadline, row_number() OVER (PARTITION BY item_id, model ORDER BY us, label) AS nth FROM v),
c AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY item_id, label ORDER BY us, model) AS k FROM f WHERE us < deadline AND nth = 1 WINDOW w AS (PARTITION BY item_id ORDER BY us, model)),
q AS (SELECT item_id, min(n) FILTER (WHERE k = {QUORUM}) AS hit, count(*) AS n, min(deadline) AS deadline FROM c GROUP BY item_id),
m AS (SELECT item_id, label FROM (SELECT item_id, label, count(*) AS k, min(n) AS first FROM c GROUP BY item_id, label) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC, first) = 1),
d AS (SELECT q.item_id, CASE WHEN hit IS NULL THEN m.label ELSE c.label END AS label, CAST(CASE WHEN hit IS NULL THEN q.n ELSE hit END AS int) AS n_votes,
CASE WHEN hit IS NULL THEN 'deadline' ELSE 'quorum' END AS reason, CASE WHEN hit IS NULL THEN q.deadline ELSE c.us END AS decided_us FROM q JOIN m USING (item_id) LEFT JOIN c ON c.item_id = q.item_id AND c.n = q.hit)
SELECT * FROM d WHERE decided_us < (SELECT max(us) // 1000 * 1000 - 3600000000 FROM v)""")
def stream_late_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, a user's day each, decided at two equal votes or six hours after the first vote, replayed in four batches; items
    whose decision the watermark (an hour behind the last vote) hasn't passed are still open. An item's mark expires a day
    after its decision, when no vote on that day can come."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.expr(AS_UTC))
    day = F.floor(F.unix_micros("ts") / 86400000000)
    rows = rows.select((F.col("user_id") * 100000 + day).alias("item_id"), (F.col("event_id") % 4).cast("string").alias("model"), F.col("event_type").alias("label"), "ts")
    votes = late_votes.replayed(rows, "ts", 4)
    return windows.run_to_table(late_votes.late_votes(votes, QUORUM, timedelta(hours=WAIT_HOURS), "1 hour", timedelta(days=1)), "late-votes", "append")
