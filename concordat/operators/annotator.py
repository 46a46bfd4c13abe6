"""Calls of an annotator: what was asked before comes from a reply cache, the rest is asked, put back and parsed.

An annotator is registered like an embedding provider: a factory of a function from prompts to replies, set up once a worker,
called with some prompts at a time, repeated when it fails. A prompt is known by the hash of the annotator's name, its
settings and its text, so equal prompts are asked once. Prompts whose calls fail to the end have an error and aren't cached.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .embedder import BATCH, Factory, called, provider_of

CACHE = "key string, response string"
ANNOTATORS: dict[str, Factory] = {}


def register(name: str, factory: Factory) -> None:
    ANNOTATORS[name] = factory


def prompt_of(text: Column, labels: list[str]) -> Column:
    return F.concat(F.lit(f"Labels: {', '.join(labels)}\nText: "), text)


def answered(prompts: DataFrame, cache: str, name: str, settings: dict | None = None) -> DataFrame:
    """(key, response) of ``prompts(key, prompt)``; those that the table at ``cache`` lacks are asked for and added to it."""
    spark, settings = prompts.sparkSession, settings or {}
    factory, live = ANNOTATORS[name], f"annotator {name} {json.dumps(settings, sort_keys=True)}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    wanted = prompts.groupBy("key").agg(F.min("prompt").alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = provider_of(live, factory, settings)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                some = b.slice(at, BATCH)
                found = called(chat, some.column("prompt").to_pylist())
                if found is not None:
                    yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(found, pa.string())], ["key", "response"])

    known = spark.read.schema(CACHE).parquet(cache).select("key")
    wanted.join(known, "key", "left_anti").mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    return spark.read.schema(CACHE).parquet(cache).join(wanted.select("key"), "key", "left_semi")


def annotate(items: DataFrame, labels: list[str], cache: str, name: str, settings: dict | None = None) -> DataFrame:
    """(item_id, label, confidence, reason, error) of ``items(item_id, text)``; an item without a reply, or whose label isn't
    one of ``labels``, has an error and no label. Null texts count as empty."""
    key = T.chain_hash(F.lit(name), F.lit(json.dumps(settings or {}, sort_keys=True)), F.col("prompt"))
    asked = items.select("item_id", prompt_of(F.coalesce("text", F.lit("")), labels).alias("prompt")).withColumn("key", key)
    replies = answered(asked.select("key", "prompt"), cache, name, settings)
    label, confidence, reason = T.reply_fields(F.col("response"))
    out = asked.select("item_id", "key").join(replies, "key", "left").select("item_id", "response", T.normalize_label(label, labels).alias("label"), confidence.alias("confidence"), reason.alias("reason"))
    known = F.col("label").isin(labels)
    error = F.when(F.col("response").isNull(), "no reply").when(~F.coalesce(known, F.lit(False)), "no label")
    return out.select("item_id", F.when(known, F.col("label")).alias("label"), F.when(known, F.col("confidence")).alias("confidence"), F.when(F.col("response").isNotNull(), F.col("reason")).alias("reason"), error.alias("error"))


def keyword(settings: dict):
    """An annotator without a model: the label of the first keyword that a text holds, else a last one."""
    rules, otherwise = settings["rules"], settings["otherwise"]

    def one(prompt: str) -> str:
        text = prompt.partition("\nText: ")[2]
        word, label = next(((w, x) for w, x in rules if w in text), ("", otherwise))
        return "I see. " + json.dumps({"label": label, "confidence": 90 if word else 60, "reason": f"keyword {word}" if word else "none"})

    return lambda prompts: [one(p) for p in prompts]


register("keyword", keyword)
