"""Text vectors by a provider of one's own, kept in a cache table so that no text is asked for twice.

A provider is registered by name: a factory that gets the settings and gives a function of a list of texts to a list of
vectors. It is set up once in each Python worker and called with ``BATCH`` texts at a time; a call that fails is repeated,
and texts whose calls fail to the end stay out of the cache. Texts are known by the SHA-256 of their trimmed form.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[list[float]]]
Factory = Callable[[dict], Provider]

BATCH, TRIES, PAUSE = 10, 3, 0.2  # texts in a call (fixed value), calls until it counts as failed, seconds before the second
CACHE = "h string, v array<double>, call string"
PROVIDERS: dict[str, Factory] = {}
_live: dict[str, Provider] = {}


def register(name: str, factory: Factory) -> None:
    PROVIDERS[name] = factory


def provider_of(key: str, factory: Factory, settings: dict) -> Provider:
    """The worker's provider; a key names a provider with its settings."""
    if key not in _live:
        _live[key] = factory(settings)
    return _live[key]


def called(provider: Provider, texts: list[str]) -> list[list[float]] | None:
    for turn in range(TRIES):
        try:
            out = provider(texts)
            if len(out) == len(texts):
                return out
        except Exception:  # a provider may fail in any way of its own
            if turn + 1 == TRIES:
                return None
        time.sleep(PAUSE * 2**turn)
    return None


def texts_of(rows: DataFrame, text: str = "text") -> DataFrame:
    """(h, text): the distinct trimmed texts, without blank ones."""
    t = F.trim(F.col(text))
    return rows.where(t != "").select(F.sha2(t, 256).alias("h"), t.alias("text")).groupBy("h").agg(F.min("text").alias("text"))


def embedded(rows: DataFrame, cache: str, name: str, settings: dict | None = None, text: str = "text") -> DataFrame:
    """(h, v) of the texts of ``rows``; those that the table at ``cache`` lacks are asked for and added to it, each once."""
    spark, settings = rows.sparkSession, settings or {}
    factory, key = PROVIDERS[name], f"{name} {json.dumps(settings, sort_keys=True)}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache)
    wanted = texts_of(rows, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider, task, n = provider_of(key, factory, settings), TaskContext.get().taskAttemptId(), 0
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                some = b.slice(at, BATCH)
                found = called(provider, some.column("text").to_pylist())
                n += 1
                if found is not None:
                    call = pa.array([f"{task}-{n}"] * some.num_rows)
                    yield pa.RecordBatch.from_arrays([some.column("h"), pa.array(found, pa.list_(pa.float64())), call], ["h", "v", "call"])

    wanted.join(known.select("h"), "h", "left_anti").mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    now = spark.read.schema(CACHE).parquet(cache)
    return now.join(wanted.select("h"), "h", "left_semi").select("h", "v")


def letters(settings: dict) -> Provider:
    """A provider without a model: how often each letter of ``settings['of']`` stands in a text."""
    of = settings.get("of", "abcdefgh")
    return lambda texts: [[float(t.count(c)) for c in of] for t in texts]


register("letters", letters)
