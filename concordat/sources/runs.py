"""Stores of runs, criteria and fitted parameters as tables and JSON in a folder that all share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the files that make a run, and the setting that never leaves the machine.
RECORDS = ("results", "eval")
SECRET = "api_key"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_run(records: DataFrame, root: str, run: str, kind: str = "results") -> None:
    """Records of a run as JSON lines in ``root/run/kind.jsonl``; a run without records has no file and isn't listed."""
    records.write.mode("overwrite").json(f"{root}/{run}/{kind}.jsonl")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, kind, changed, files) of all runs under ``root``, newest first; only names and times are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    name = rf"/([^/]+)/({'|'.join(RECORDS)})\.jsonl(?:/part-[^/]*)?$"
    files = files.select(F.regexp_extract("path", name, 1).alias("run"), F.regexp_extract("path", name, 2).alias("kind"), "modificationTime").where("kind <> ''")
    return files.groupBy("run", "kind").agg(F.max("modificationTime").alias("changed"), F.count("*").alias("files")).orderBy(F.desc("changed"), "run")


def delete_run(spark: SparkSession, root: str, run: str) -> bool:
    """Remove a run's folder; False if there is none. A name can't lead out of ``root``."""
    if not run or "/" in run or run in (".", ".."):
        raise ValueError(f"{run!r} is not the name of a run")
    fs, p = _path(spark, f"{root}/{run}")
    return bool(fs.exists(p)) and bool(fs.delete(p, True))


def without_secrets(value):
    """Settings without keys named ``SECRET``, at any depth: models, arbiter and jury alike."""
    if isinstance(value, dict):
        return {k: without_secrets(v) for k, v in value.items() if k != SECRET}
    return [without_secrets(v) for v in value] if isinstance(value, list) else value


def write_meta(spark: SparkSession, root: str, run: str, meta: dict) -> None:
    """One line of JSON per run in ``root/run/meta``; a note added later is a new version of the line."""
    line = json.dumps({"run": run} | without_secrets(meta), ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{run}/meta")


def read_meta(spark: SparkSession, root: str, schema: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root)
    return lines.select(F.from_json("value", schema).alias("m")).select("m.*")


def saved(table: DataFrame, path: str) -> DataFrame:
    """Write a small table of parameters (weights, calibration) as JSON lines and read it back."""
    table.write.mode("overwrite").json(path)
    return table.sparkSession.read.schema(table.schema).json(path)


def criteria_hash(name: Column, description: Column, labels: Column, rules: Column) -> Column:
    """First 8 hex digits of sha256 over the criteria as JSON."""
    return F.left(F.sha2(F.to_json(F.struct(name.alias("name"), description.alias("description"), labels.alias("labels"), rules.alias("rules"))), 256), F.lit(8))


def save_versions(criteria: DataFrame, path: str) -> None:
    """Append ``criteria(hash, version)`` to the table of versions; a hash that is there is left as it is, with its first version."""
    spark = criteria.sparkSession
    fs, p = _path(spark, path)
    new = criteria.groupBy("hash").agg(F.min("version").alias("version"))
    if fs.exists(p):
        new = new.join(spark.read.schema(new.schema).parquet(path), "hash", "left_anti")
    new.write.mode("append").parquet(path)


def with_version(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """``runs`` with the version of their criteria ``hash``; unknown ones keep the hash in its place."""
    return runs.join(versions, "hash", "left").withColumn("version", F.coalesce("version", "hash"))


def strategy(models: Column, fewshot: Column, cascade: Column, samples: Column, action: Column, rounds: Column) -> Column:
    """A sentence on how a run decides, from its settings."""
    what = F.when(action == "human", "people settle disagreement").when(action == "arbiter", "an arbiter settles disagreement").when(action == "review", "models review disagreement")
    return F.concat_ws(
        ", ", F.array_join(models, " / "), F.when(fewshot, "similar examples"), F.when(F.size(cascade) > 0, F.concat(F.lit("cascade of "), F.array_join(cascade, " + "))),
        F.when(samples > 1, F.concat(samples.cast("string"), F.lit(" samples each"))), what, F.when((action == "review") & (rounds > 1), F.concat(F.lit("up to "), rounds.cast("string"), F.lit(" rounds"))),
    )
