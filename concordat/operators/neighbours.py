"""Nearest labelled examples, exactly: a stated set of queries in blocks, or every row, against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, TILE = 2_000, 1_024  # queries and rows of one product
MOST_BLOCKS = 8  # blocks of queries that are broadcast one by one
PART, GRID_BLOCK, MOST_TASKS = 1 << 14, 1 << 15, 4_000  # rows and queries of a cell of the grid on average
SLACK = 1e-9  # a product is rounded to nine digits
FOUND = "query bigint, neighbour bigint, sim double"


def _units(c: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, scaled to length 1."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    n = np.unique(c.value_lengths().to_numpy(zero_copy_only=False))
    if c.null_count or len(n) > 1:
        raise ValueError("vectors of several lengths")
    v = c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


class _Best:
    """The k rows most similar to each of some queries among those seen so far, ties by key."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int):
        self.ids, self.unit, self.k = ids, unit, k
        self.row, self.id, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)  # the k-th best so far

    def see(self, ids: np.ndarray, unit: np.ndarray) -> None:
        k, s = self.k, self.unit @ unit.T
        enough, new = self.least - SLACK, np.flatnonzero(self.least == -np.inf)
        if len(ids) > k + 1 and len(new):  # the query itself may be one of the rows
            some = np.where(np.isfinite(s[new]), s[new], -np.inf)
            enough[new] = np.partition(some, -k - 1, axis=1)[:, -k - 1] - SLACK
        r, c = np.nonzero(s >= enough[:, None])
        r, c = (x[(self.ids[r] != ids[c]) & np.isfinite(s[r, c])] for x in (r, c))
        if not len(r):
            return
        row, found = np.concatenate([self.row, r]), np.concatenate([self.id, ids[c]])
        sim = np.concatenate([self.sim, np.round(s[r, c], 9)])
        order = np.lexsort((found, -sim, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, nth = order[nth < k], row[nth < k], nth[nth < k]
        self.row, self.id, self.sim = row, found[order], sim[order]
        self.least[row[nth == k - 1]] = self.sim[nth == k - 1]

    def columns(self) -> list[pa.Array]:
        return [pa.array(self.ids[self.row], pa.int64()), pa.array(self.id, pa.int64()), pa.array(self.sim, pa.float64())]


def by_cosine(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, neighbour, sim, rank): the k rows most similar to each query, itself left out, ties by key.

    A few blocks of ``BLOCK`` queries are broadcast to all rows. More queries are dealt to larger blocks and rows to parts in
    one shuffled grid, so the plan doesn't grow with them. Either way a task compares ``TILE`` rows at a time with a block,
    which bounds its memory, and keeps only its own k best of each query, so what leaves it is k rows per query.
    """
    spark = rows.sparkSession
    n = queries.count()
    if not n:
        return spark.createDataFrame([], "query bigint, neighbour bigint, sim double, rank int")
    blocks = -(-n // BLOCK)
    found = _by_broadcast(rows, queries, k, key, vector, blocks) if blocks <= MOST_BLOCKS else _by_grid(rows, queries, k, key, vector, n)
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _by_broadcast(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, blocks: int) -> DataFrame:
    out = rows.sparkSession.createDataFrame([], FOUND)
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vector).toArrow()
        if not part.num_rows:
            continue
        shared = rows.sparkSession.sparkContext.broadcast((part[key].to_numpy(), _units(part[vector])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Best(*shared.value, k)
            for x in (b.slice(at, TILE) for b in batches for at in range(0, b.num_rows, TILE)):
                best.see(x.column(key).to_numpy(), _units(x.column(vector)))
            yield pa.RecordBatch.from_arrays(best.columns(), ["query", "neighbour", "sim"])

        out = out.unionByName(rows.select(key, vector).mapInArrow(run, FOUND))
    return out


def _by_grid(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, n: int) -> DataFrame:
    parts, blocks = -(-rows.count() // PART), -(-n // GRID_BLOCK)
    dealt = lambda df, n, name, other, m: df.select(
        F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
    )

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        tiles = [mine.slice(at, TILE) for at in range(0, mine.num_rows, TILE)]
        out = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query", "neighbour", "sim"])]
        for at in range(0, theirs.num_rows, BLOCK):
            asked = theirs.slice(at, BLOCK)
            found = _Best(asked["id"].to_numpy(), _units(asked["v"]), k)
            for x in tiles:
                found.see(x["id"].to_numpy(), _units(x["v"]))
            out.append(pa.table(found.columns(), ["query", "neighbour", "sim"]))
        return pa.concat_tables(out)

    # groups meet by a hash, so some more tasks than groups share them out
    tasks = min(2 * max(parts, 1) * blocks, MOST_TASKS)
    left, right = dealt(rows, max(parts, 1), "part", "block", blocks), dealt(queries, blocks, "block", "part", max(parts, 1))
    cells = left.repartition(tasks, "part", "block").groupBy("part", "block").cogroup(right.repartition(tasks, "part", "block").groupBy("part", "block"))
    return cells.applyInArrow(best, FOUND)
