"""A bounded sample of labelled documents with their features, for fitting a model on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import FEATURES, measured


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, max_rows: int, only: Column | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, features, label) of at most ``max_rows`` labelled documents, those with the least hash of the id.

    ``only`` restricts the rows of ``labels``. A document labelled twice counts once, with its lower label; null ids
    and labels are left out. What reaches the driver is bounded by ``max_rows`` x ``len(FEATURES)`` numbers.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    if only is not None:
        rows = rows.where(only)
    chosen = (
        rows.groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, f = measured(b)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(list(f), pa.list_(pa.float64()))], ["doc_id", "label", "f"]
            )

    got = texts.mapInArrow(features, "doc_id bigint, label int, f array<double>").toArrow().sort_by("doc_id")
    f = np.array(got["f"].to_pylist(), float).reshape(-1, len(FEATURES))
    return got["doc_id"].to_numpy(), f, got["label"].to_numpy().astype(int)
