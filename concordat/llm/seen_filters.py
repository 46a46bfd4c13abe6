"""Filters of fixed size over 64-bit hashes: which are found at least twice in a whole table, and which often.

Hashes travel as packed runs: sorted, cut by hash range, as differences of 32-bit values. Each range is merged in its own
group; a hash found many times in one task counts as one entry there, so no group depends on how often a hash occurs.
Only the filters, of fixed size, reach the driver. False positives only cost time wherever these filters are used.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import mix

FILTER_BITS, OFTEN_BITS, RUN = 1 << 27, 1 << 23, 1 << 20
PACKED = [("part", pa.int32()), ("v", pa.binary()), ("c", pa.binary())]


def range_bits_for(n_rows: int) -> int:
    """Ranges grow with the table: about one for 400 documents."""
    return min(20, max(6, math.ceil(math.log2(max(1, n_rows) / 400 + 1))))


def _pack(v: np.ndarray) -> bytes:
    """Differences of sorted 32-bit values, their bytes grouped by significance, which compresses well."""
    d = np.diff(v, prepend=np.zeros(1, v.dtype)).astype("<u4")
    return d.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    d = np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)
    return np.cumsum(d, dtype=np.uint32)


def packed(held: list[np.ndarray], range_bits: int) -> list[pa.Array]:
    """Columns part, v, c of the hashes in ``held``."""
    h, count = np.unique(np.concatenate(held), return_counts=True)
    part = (h >> np.uint64(64 - range_bits)).astype(np.int64)
    v = (h >> np.uint64(32 - range_bits)).astype(np.uint32)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(at[1:], len(h))
    return [
        pa.array(part[at], pa.int32()),
        pa.array([_pack(v[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()),
        pa.array([np.minimum(count[i:j], 65535).astype("<u2").tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()),
    ]


class SeenFilters:
    """``twice`` and ``often`` hold one block of bits per hash range; ``n_often`` is the number of hashes in ``often``."""

    def __init__(self, range_bits: int, twice: np.ndarray, often: np.ndarray, n_often: int = 0):
        self.range_bits, self.twice, self.often, self.n_often = range_bits, twice, often, n_often

    @staticmethod
    def places(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        w = mix(v.astype(np.uint64))
        return (w & np.uint64(bits - 1)).astype(np.int64), ((w >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)

    @classmethod
    def block(cls, v: np.ndarray, bits: int) -> bytes:
        out = np.zeros(bits, bool)
        for at in cls.places(v, bits):
            out[at] = True
        return np.packbits(out).tobytes()

    def holds(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        block = (h >> np.uint64(64 - self.range_bits)).astype(np.int64)
        bits = table.shape[1] * 8
        ok = np.ones(len(h), bool)
        for at in self.places((h >> np.uint64(32 - self.range_bits)).astype(np.uint32), bits):
            ok &= (table[block, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return ok

    @classmethod
    def build(cls, runs: DataFrame, range_bits: int, often: int, filter_bits: int = FILTER_BITS, often_bits: int = OFTEN_BITS) -> SeenFilters:
        """From the packed runs (part, v, c) of a whole table; ``often``: found more than so many times."""
        twice_bits, many_bits = max(64, filter_bits >> range_bits), max(64, often_bits >> range_bits)

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            v = np.concatenate([_unpack(x) for x in rows["v"]])
            c = np.concatenate([np.frombuffer(x, "<u2") for x in rows["c"]]).astype(np.int64)
            order = np.argsort(v, kind="stable")
            v, c = v[order], c[order]
            at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            v, c = v[at], np.add.reduceat(c, at)
            many = v[c > often]
            return pd.DataFrame({"part": [rows["part"].iloc[0]], "twice": [cls.block(v[c > 1], twice_bits)], "often": [cls.block(many, many_bits)], "n": [len(many)]})

        merged = runs.select("part", "v", "c").groupBy("part").applyInPandas(merge, "part int, twice binary, often binary, n bigint")
        out = cls(range_bits, np.zeros((1 << range_bits, twice_bits // 8), np.uint8), np.zeros((1 << range_bits, many_bits // 8), np.uint8))
        for r in merged.toLocalIterator():
            out.twice[r["part"]], out.often[r["part"]] = np.frombuffer(r["twice"], np.uint8), np.frombuffer(r["often"], np.uint8)
            out.n_often += r["n"]
        return out
