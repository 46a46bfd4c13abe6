"""Readers and writers of items, results, caches and example files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import office

ANNOTATION = "struct<model: string, label: string, confidence: double, reason: string, error: string, prob: double, evidence: string, evidence_ok: boolean>"
RESULT = f"id string, text string, label string, status string, confidence double, note string, gold string, round1 array<{ANNOTATION}>, round2 array<{ANNOTATION}>, arbiter {ANNOTATION}"


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if all files of a path are valid, else GBK."""
    bad = spark.read.format("binaryFile").load(path).where("NOT is_valid_utf8(content)")
    return "UTF-8" if bad.isEmpty() else "GBK"


def read_items(spark: SparkSession, path: str, text: str = "text", key: str = "id", label: str | None = None) -> DataFrame:
    """(seq, id, text, label) of a CSV or JSON-lines path, or of the first sheets of workbooks.

    seq numbers all rows in file order, also blank ones; rows with blank text then go; an empty id is replaced by seq.
    """
    place = ["_metadata.file_path", F.monotonically_increasing_id()]
    if path.rstrip("/").endswith(".xlsx"):
        raw, place = office.table_of(office.sheet_rows(office.files(spark, path), first_only=True)), ["_path", "_row"]
        raw = raw.repartitionByRange(*place)
    elif path.rstrip("/").endswith((".jsonl", ".json")):
        raw = spark.read.option("primitivesAsString", True).json(path)
    else:
        raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding_of(spark, path))
    missing = [c for c in (text, *([label] if label else [])) if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing[0]!r}; it has {raw.columns}")
    rows = raw.withColumn("_at", F.struct(*place))
    parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    before = parts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per partition
    numbered = rows.withColumn("p", F.spark_partition_id()).withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("_at")))
    seq = F.col("before") + F.col("rn")
    given = F.nullif(F.trim(F.col(key)), F.lit("")) if key in raw.columns else F.lit(None).cast("string")
    out = numbered.join(before, "p").select(seq.alias("seq"), F.coalesce(given, seq.cast("string")).alias("id"), F.col(text).alias("text"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"))
    return out.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def _place():
    """Order of lines by file, part of the file, then place in that part (ids rise within a part)."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result records, one JSON object per line; broken lines (a run cut off) are left out, the last record of an id wins."""
    r = spark.read.schema(RESULT).option("mode", "DROPMALFORMED").json(path).withColumn("_at", _place())
    last = r.groupBy("id").agg(F.max_by(F.struct(*[c for c in r.columns if c != "_at"]), "_at").alias("r"))
    return last.select("r.*").where("id IS NOT NULL")


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_wide(annotations: DataFrame, models: list[str], path: str) -> None:
    """A CSV with one column group per model: label or error, and confidence."""
    cell = F.when(F.col("error").isNull(), F.col("label")).otherwise(F.concat(F.lit("error: "), F.left("error", F.lit(40))))
    p = annotations.groupBy("item_id").pivot("model", models).agg(F.max(cell).alias("r1"), F.max(F.round("confidence", 2)).alias("conf"))
    p.write.mode("overwrite").csv(path, header=True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, response, in_tok, out_tok, prob) of a reply cache; the last line of a key wins, broken lines are left out."""
    c = spark.read.schema("key string, response string, in_tok int, out_tok int, prob double").option("mode", "DROPMALFORMED").json(path)
    c = c.where("key IS NOT NULL").withColumn("_at", _place())
    return c.groupBy("key").agg(F.max_by(F.struct("response", "in_tok", "out_tok", "prob"), "_at").alias("r")).select("key", "r.*")
