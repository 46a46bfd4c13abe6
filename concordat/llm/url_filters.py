"""Operator 2: URL filters, a blocked Bloom filter in front of an exact hash join.

Listed entries are canonical URLs ``host/path-prefix``: rules (allow or block) and a plain block list. A URL is looked
up by its *expressions*, every host suffix joined with its path cut to each length that an entry has. A Bloom filter
whose bits for one key all fall into one 512-bit block drops the expressions that are surely not listed; the rest goes
to an exact hash join with the list, which removes the false positives. The longest matching rule decides; without a
rule, a match with the block list blocks, anything else is allowed.

The filter has some twelve bits an entry, within bounds (``blocks`` x 64 bytes, 16 MB at most, built by a shuffled bit-or),
and is broadcast; beyond that bound more URLs pass it and the join drops them. A list counted as small is broadcast too. A
longer one is joined by shuffling, but for entries with more than a thousandth of the hits (a thousand at most), which are
broadcast, so that a rule for a whole domain doesn't send its URLs to one task. Paths are cut to every length that an entry
has, up to their own. The join runs on distinct URLs, so repeated URLs cost one row.

Edge cases: null or a string without ``://``: empty host and path, no rule, allowed. Repeated rows stay repeated. An
entry listed twice counts once; of a rule listed with both actions, block wins. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import written

BLOCKS, MOST_BLOCKS, KEY_BITS, BITS, HOT_SHARE = 1 << 12, 1 << 18, 12, 6, 1000
BROADCAST_ENTRIES = 50_000  # of some hundred bytes each
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Hosts of the default block list, subdomains included.
BLOCKED_HOSTS = ["ads-track.example.com", "adult-x.example.net", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple:
    """Columns host and path of a URL column; both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _places(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and in-block bit mask (eight 64-bit words) of each key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    block = (h & np.uint64(blocks - 1)).astype(np.int64)
    mask = np.zeros((len(keys), 8), np.uint64)
    rows = np.arange(len(keys))
    g = h >> np.uint64(10)
    for i in range(BITS):
        bit = (g >> np.uint64(9 * i)) & np.uint64(511)
        mask[rows, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block, mask


def blocks_for(n: int) -> int:
    """How many blocks a filter of n keys gets: a power of two."""
    return min(MOST_BLOCKS, max(BLOCKS, 1 << max(0, n * KEY_BITS // 512).bit_length()))


def build_filter(listed: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """The filter of column ``entry`` as blocks x 8 words; at most that many rows reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, mask = _places(b.column("entry").to_pylist(), blocks)
            row, word = np.nonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array(block[row] * 8 + word), pa.array(mask[row, word].view(np.int64))], ["at", "bits"])

    got = listed.select("entry").dropna().mapInArrow(bits, "at bigint, bits bigint").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(blocks * 8, np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out.reshape(blocks, 8)


def _joined(hits: DataFrame, listed: DataFrame, few: bool) -> DataFrame:
    """Hits with their entries: by broadcast if these are few or hit by many URLs, the others by shuffling."""
    if few:
        return hits.join(F.broadcast(listed), "entry")
    hits = written(hits, "hits")
    often = hits.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > hits.count()).select("entry")
    hot = listed.join(F.broadcast(often), "entry", "left_semi")
    rest = hits.join(F.broadcast(often), "entry", "left_anti")
    return hits.join(F.broadcast(hot), "entry").unionByName(rest.join(listed, "entry"))


def url_verdicts(pages: DataFrame, rules: DataFrame, blocklist: DataFrame, blocks: int | None = None, few: int = BROADCAST_ENTRIES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row. ``rules(entry, action)``, ``blocklist(entry)``."""
    listed = rules.select("entry", F.col("action").alias("action"), F.lit(True).alias("is_rule")).unionByName(
        blocklist.select("entry", F.lit("block").alias("action"), F.lit(False).alias("is_rule"))
    ).dropna(subset=["entry"]).groupBy("entry", "is_rule").agg(F.max("action").alias("action"))
    spark = pages.sparkSession
    lengths = [r[0] for r in listed.select(F.length(F.regexp_extract("entry", "^[^/]*(.*)$", 1))).distinct().collect()]
    n = listed.count()
    shared = spark.sparkContext.broadcast((build_filter(listed, blocks or blocks_for(n)), sorted(lengths)))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cuts = shared.value
        for b in batches:
            urls, keys = [], []
            for i, (host, path) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)):
                parts = host.split(".")
                ends = [path[:n] for n in cuts[: bisect_right(cuts, len(path))]]
                for j in range(len(parts)):
                    suffix = ".".join(parts[j:])
                    for p in ends:
                        urls.append(i)
                        keys.append(suffix + p)
            if not keys:
                continue
            block, mask = _places(keys, len(table))
            hit = np.flatnonzero(((table[block] & mask) == mask).all(1))
            yield pa.RecordBatch.from_arrays(
                [b.column("host").take(pa.array([urls[k] for k in hit], pa.int64())), b.column("path").take(pa.array([urls[k] for k in hit], pa.int64())), pa.array([keys[k] for k in hit], pa.string())],
                ["host", "path", "entry"],
            )

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hits = rows.where("host <> ''").select("host", "path").distinct().mapInArrow(possible, "host string, path string, entry string")
    size = F.when(F.col("is_rule"), F.length("entry"))
    found = _joined(hits, listed, n <= few).groupBy("host", "path").agg(
        F.max_by(F.when(F.col("is_rule"), F.col("entry")), size).alias("rule"),
        F.max_by(F.when(F.col("is_rule"), F.col("action")), size).alias("action"),
        F.max(~F.col("is_rule")).alias("on_list"),
    )
    verdict = F.coalesce("action", F.when(F.col("on_list"), "block"), F.lit("allow"))
    return rows.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "entry string, action string")
    blocklist = spark.createDataFrame([(f"{h}/",) for h in BLOCKED_HOSTS], "entry string")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, blocklist)


_CASE = "\n".join(
    f"  WHEN (host = '{e.split('/', 1)[0]}' OR ends_with(host, '.{e.split('/', 1)[0]}')) AND starts_with(path, '/{e.split('/', 1)[1]}') THEN '{e}'"
    for e, _ in sorted(RULES, key=lambda r: -len(r[0]))
)
OP2_SQL = f"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, CASE
{_CASE}
  END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ({", ".join(f"'{e}'" for e, a in RULES if a == "block")}) THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN starts_with(path, '/') AND ({" OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)}) THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""
