"""Operator 11: k-means assignment with Yinyang grouping of the centroids.

Centroids are clustered into groups once (ten to a group on average, by a few rounds of k-means over the first centroids).
Each vector keeps its centroid, an upper bound of the distance to it and, for each group, one lower bound of the distance
to the group's other centroids. When the centroids move, bounds widen by how far they moved, and

* a vector whose upper bound is below all lower bounds keeps its centroid (global filter, before and after the upper bound
  is made exact);
* otherwise only groups whose lower bound isn't above the distance are looked at (group filter), and of those only centroids
  that the old bound less their own movement doesn't rule out are measured (scan of the surviving centroids).

A bound rules out only what is *strictly* farther, with a margin far above rounding errors, and distances that decide are
whole numbers, exact; so results are those of measuring every distance, ties included.

Components are whole numbers. Sums of a cluster change only by the vectors that moved, so after the first round only those
are summed. Vectors and their bounds are a written table per round; nothing but k centroids, their sums and their movements
passes through the driver, and a lost executor costs the rows of its tasks.

Edge cases: vectors of another length, null vectors and those with a null, NaN or infinite component are left out. Of rows
with equal ids each counts; the first centroids come from the least hashes, equal ones by the vector, null ids last. Fewer
vectors than k give as many centroids. Components beyond 2**53 in 256ths count as 2**53. A squared distance, or a sum of
them, that doesn't fit a long is null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import drop_tables, written

DIM, CENTROIDS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, 2
PER_GROUP, GROUP_ROUNDS, BLOCK = 10, 5, 1 << 15
LARGEST, NARROW = 1 << 53, 1 << 21  # a component at most; below NARROW sums of products are exact in doubles
SLACK = 1e-9  # of bounds; roots and sums of doubles err by some 1e-15
BOUNDS = "vec_id bigint, v binary, before int, cluster int, upper double, lower binary"


def whole_vectors(table: DataFrame, dim: int, scale: int, vector: str = "embedding") -> DataFrame:
    """vec_id and v: the components as floor(scale * x), packed in four or eight bytes each; unfit vectors left out."""
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fit = table.where((F.size(x) == dim) & ~bad).select("vec_id", x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.floor(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * scale)
            a = np.clip(a, -float(LARGEST), float(LARGEST)).astype("<i8")
            wide = (np.abs(a) >= 1 << 31).any(axis=1)
            packed = [(r if w else r.astype("<i4")).tobytes() for r, w in zip(a, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "v"])

    return fit.mapInArrow(run, "vec_id bigint, v binary")


def unpacked(packed: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of 64-bit integers."""
    if all(len(p) == 4 * dim for p in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(-1, dim).astype(np.int64)
    return np.stack([np.frombuffer(p, "<i4" if len(p) == 4 * dim else "<i8").astype(np.int64) for p in packed])


def narrow(*arrays: np.ndarray) -> bool:
    return all(not a.size or (a.max() < NARROW and a.min() > -NARROW) for a in arrays)


def all_distances(a: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of every row of ``a`` to every row of ``c``; ``exact`` says that doubles suffice, otherwise they
    are Python's integers of any size."""
    if exact:
        x, y = a.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    x, y = a.astype(object), c.astype(object)
    return np.array([[((r - s) ** 2).sum() for s in y] for r in x], object).reshape(len(a), len(c))


def pair_distances(a: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of rows of ``a`` to the rows of ``c`` beside them."""
    if exact:
        return ((a - c) ** 2).sum(1)
    out = np.empty(len(a), object)
    for i, (r, s) in enumerate(zip(a.astype(object), c.astype(object), strict=True)):
        out[i] = ((r - s) ** 2).sum()
    return out


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass(frozen=True)
class Centroids:
    """What a pass needs to know: positions, group of each, how far each moved since the last pass (rounded up)."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @property
    def members(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == g) for g in range(int(self.group.max()) + 1)]


def grouped(at: np.ndarray, per_group: int = PER_GROUP) -> np.ndarray:
    """A group number for each centroid, every group with a member, by k-means over the centroids."""
    n = max(1, math.ceil(len(at) / per_group))
    x = at.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    label = np.zeros(len(x), int)
    for _ in range(GROUP_ROUNDS):
        label = np.array([int(np.argmin(((r - centres) ** 2).sum(1))) for r in x])
        centres = np.array([x[label == g].mean(0) if (label == g).any() else centres[g] for g in range(n)])
    return np.unique(label, return_inverse=True)[1]


def first_pass(a: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bounds by group) of each row, measuring all distances."""
    d = all_distances(a, c.at, narrow(a, c.at))
    cluster = d.argmin(1)  # the first of equals
    rows = np.arange(len(a))
    far = roots(d)
    upper = far[rows, cluster] * (1 + SLACK)
    far[rows, cluster] = np.inf
    lower = np.stack([far[:, m].min(1) for m in c.members], 1) * (1 - SLACK)
    return cluster.astype(np.int64), upper, lower


def later_pass(a: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the last pass's outcome, by the filters; also the number of distances that were measured."""
    members, old, exact = c.members, lower, narrow(a, c.at)
    most = np.array([c.moved[m].max() for m in members])
    lower = old - most[None, :]
    lower = lower * (1 - SLACK * np.sign(lower))
    cluster, upper = cluster.copy(), (upper + c.moved[cluster]) * (1 + SLACK)
    rest = np.flatnonzero(upper >= lower.min(1))
    measured = len(rest)
    if not len(rest):
        return cluster, upper, lower, measured
    d = pair_distances(a[rest], c.at[cluster[rest]], exact)
    upper[rest] = roots(d) * (1 + SLACK)
    open_ = upper[rest] >= lower[rest].min(1)
    rest, d = rest[open_], d[open_]
    if not len(rest):
        return cluster, upper, lower, measured
    start, start_d, limit = cluster[rest].copy(), d.copy(), upper[rest].copy()
    best, best_d = start.copy(), d.copy()
    seen: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g, m in enumerate(members):
        look = np.flatnonzero(limit >= lower[rest, g])
        if not len(look):
            continue
        # of each centroid of the group a lower bound, then the distance of those that the bound doesn't rule out
        bound = old[rest[look], g][:, None] - c.moved[m][None, :]
        bound = bound * (1 - SLACK * np.sign(bound))
        own = start[look][:, None] == m[None, :]
        row, col = np.nonzero((bound <= limit[look][:, None]) & ~own)
        e = pair_distances(a[rest[look[row]]], c.at[m[col]], exact)
        measured += len(row)
        bound[row, col] = roots(e) * (1 - SLACK)
        bound[own] = np.inf
        if exact:
            order = np.lexsort((m[col], e, row))
        else:
            order = np.array(sorted(range(len(row)), key=lambda i: (row[i], e[i], m[col[i]])), int)
        r, e, j = look[row[order]], e[order], m[col[order]]
        first = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.zeros(0, bool)
        r, e, j = r[first], e[first], j[first]
        nearer = (e < best_d[r]) | ((e == best_d[r]) & (j < best[r]))
        best[r[nearer]], best_d[r[nearer]] = j[nearer], e[nearer]
        seen.append((g, look, bound, m))
    for g, look, bound, m in seen:
        bound[best[look][:, None] == m[None, :]] = np.inf  # the bound is over the other centroids
        lower[rest[look], g] = bound.min(1)
    left = np.flatnonzero(best != start)  # the centroid that was left is one of its group's others now
    g = c.group[start[left]]
    lower[rest[left], g] = np.minimum(lower[rest[left], g], roots(start_d[left]) * (1 - SLACK))
    cluster[rest], upper[rest] = best, roots(best_d) * (1 + SLACK)
    return cluster, upper, lower, measured


def assigned(state: DataFrame, c: Centroids, dim: int) -> DataFrame:
    """One pass over all vectors; ``state`` is the last pass's outcome, or vec_id and v alone for the first pass."""
    first = "cluster" not in state.columns
    n_groups = len(c.members)
    shared = state.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                a = unpacked(b.column("v").to_pylist(), dim)
                if first:
                    before = pa.nulls(b.num_rows, pa.int32())
                    cluster, upper, lower = first_pass(a, c)
                else:
                    before = b.column("cluster")
                    was = np.frombuffer(b"".join(b.column("lower").to_pylist()), "<f8").reshape(-1, n_groups)
                    cluster, upper, lower, _ = later_pass(a, before.to_numpy().astype(np.int64), b.column("upper").to_numpy(), was, c)
                bounds = [r.tobytes() for r in np.ascontiguousarray(lower, "<f8")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), before, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(bounds, pa.binary())],
                    ["vec_id", "v", "before", "cluster", "upper", "lower"],
                )

    return state.mapInArrow(run, BOUNDS)


def _moves(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the sums of components and the sizes of the clusters changed by in a pass. Each task sums the vectors that
    moved, Spark adds up the tasks' rows, and at most k rows come to the driver."""
    at, kind = [f"s{i}" for i in range(dim)], pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            a = unpacked(b.column("v").to_pylist(), dim)
            for sign, name in ((1, "cluster"), (-1, "before")):
                label = b.column(name).fill_null(-1).to_numpy()
                for j in np.unique(label[label >= 0]):
                    part = a[label == j]
                    sizes[j] += sign * len(part)
                    sums[j] += sign * (part if narrow(part) else part.astype(object)).sum(0).astype(object)
        some = [j for j in range(k) if sizes[j] or sums[j].any()]
        columns = [pa.array([Decimal(int(sums[j][i])) for j in some], kind) for i in range(dim)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sizes[some], pa.int64()), *columns], ["cluster", "n", *at])

    part = state.where("before IS NULL OR before <> cluster").select("v", "before", "cluster")
    part = part.mapInArrow(run, "cluster int, n bigint, " + ", ".join(f"{c} decimal(38,0)" for c in at))
    sums, sizes = np.zeros((k, dim), object), np.zeros(k, object)
    for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in at]).collect():
        sums[r["cluster"]], sizes[r["cluster"]] = [int(r[c]) for c in at], int(r["n"])
    return sums, sizes


def clusters(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: int = SALT) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster of the last pass; the centroids that it measured against, k rows of whole numbers)."""
    spark = table.sparkSession
    state = written(whole_vectors(table, dim, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = state.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not seeds:
        return state.select("vec_id", "v", F.lit(0).alias("cluster")), np.zeros((0, dim), np.int64)
    at = unpacked([bytes(r["v"]) for r in seeds], dim)
    k, group = len(at), grouped(at)
    sums, sizes, moved = np.zeros((k, dim), object), np.zeros(k, object), np.zeros(k)
    for r in range(rounds + 1):
        before, state = state, written(assigned(state, Centroids(at, group, moved), dim), "bounds")
        drop_tables(spark, [before])
        if r == rounds:
            break
        change = _moves(state, k, dim)
        sums, sizes = sums + change[0], sizes + change[1]
        new = np.array([[x // sizes[j] for x in sums[j]] if sizes[j] else at[j] for j in range(k)], np.int64).reshape(k, dim)
        moved = roots(pair_distances(new, at, narrow(new, at))) * (1 + SLACK)
        at = new
    return state.select("vec_id", "v", "cluster"), at


def distances(found: DataFrame, at: np.ndarray) -> DataFrame:
    """vec_id, cluster and the exact squared distance to its centroid (null if it doesn't fit a long)."""
    dim = at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = []
            if b.num_rows:
                a, c = unpacked(b.column("v").to_pylist(), dim), at[b.column("cluster").to_numpy()]
                d = [int(x) if x < 1 << 63 else None for x in pair_distances(a, c, narrow(a, c))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return found.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kept vector its cluster, distance, the inertia of the cluster and of all, and its centroid's digest."""
    found, at = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    measured = distances(found, at)
    whole = "CASE WHEN count(*) = count(distance) THEN try_cast(sum(cast(distance AS decimal(38,0))) AS bigint) END"
    inertia = {r[0]: r[1] for r in measured.groupBy("cluster").agg(F.expr(whole)).collect()}  # at most k rows
    total = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    rows = [(j, x, total, digests[j]) for j, x in sorted(inertia.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return measured.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same by measuring every distance in each of the passes."""
    out = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
FROM embeddings WHERE len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIM}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id), v) - 1 AS INTEGER) AS j, v AS c
FROM kept QUALIFY j < {CENTROIDS})"""
    ]
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT r, vec_id, v, unnest(m) FROM (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v,
min({{'d': list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, c)])::BIGINT, 'j': j}}) AS m FROM kept, c{r} GROUP BY r))""")
        if r < ROUNDS:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT j, coalesce(new.c, old.c) AS c FROM c{r} old LEFT JOIN (
SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
FROM (SELECT j, unnest(v) AS x, unnest(range({DIM})) AS i FROM a{r}) GROUP BY j, i) GROUP BY j) new USING (j))""")
    return ",\n".join(out) + f"""
SELECT vec_id, a.j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.j = c.j"""


OP11_SQL = _sql()
