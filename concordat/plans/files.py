"""Queries that write files of a table's rows and read them back through the file readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, office
from ..sources.shared import shared_dir
from ..sources.tables import ANN_SQL, annotations, table
from .registry import query

BOOK_ROWS, SHEET_ROWS = 400, 150


def packed(rows: DataFrame, make) -> DataFrame:
    """(path, content): one file for each batch of rows, made by ``make`` of a list of row tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BOOK_ROWS):
                some = [tuple(r.values()) for r in b.slice(at, BOOK_ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([str(some[0][0])]), pa.array([make(some)], pa.binary())], ["path", "content"])

    out = rows.mapInArrow(run, "path string, content binary")
    path = shared_dir(rows.sparkSession, "office")
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def _book(rows: list[tuple]) -> bytes:
    head = ["id", "text", "label"]
    sheets = {f"part {k // SHEET_ROWS}": [head, *[list(r) for r in rows[k : k + SHEET_ROWS]]] for k in range(0, len(rows), SHEET_ROWS)}
    return office.workbook(sheets)


@query("SELECT CAST(doc_id AS varchar) AS id, text, lang AS label FROM documents")
def xlsx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as workbooks of several sheets, read back by sheet; the first row of each is its head."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    rows = office.sheet_rows(packed(d, _book)).where("row > 1")
    return rows.select(*[F.try_element_at("cells", F.lit(i + 1)).alias(c) for i, c in enumerate(("id", "text", "label"))])


def _letter(rows: list[tuple]) -> bytes:
    """One document of a row: the id as a heading, its lines as paragraphs, language and source as a table."""
    paragraphs, tables = [], []
    for doc_id, text, lang, source in rows:
        paragraphs += [(f"document {doc_id}", True), *[(x, False) for x in (text or "").split("\n")]]
        tables.append([["lang", lang or ""], ["source", source or ""]])
    return office.document(paragraphs, tables)


@query("""WITH l AS (SELECT 'document ' || doc_id AS t, true AS heading FROM documents
UNION ALL SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9)) AS t, false FROM documents
UNION ALL SELECT unnest([CASE WHEN lang IS NULL OR lang = '' THEN 'lang' ELSE 'lang | ' || lang END, CASE WHEN source IS NULL OR source = '' THEN 'source' ELSE 'source | ' || source END]), false FROM documents)
SELECT t AS text, heading, count(*) AS n FROM l WHERE t <> '' GROUP BY ALL""")
def docx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as DOCX files, read back as blocks; how often each block stands."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return office.docx_blocks(packed(d, _letter)).groupBy("text", "heading").agg(F.count("*").alias("n"))


@query(f"WITH {ANN_SQL} SELECT CAST(item_id AS varchar) AS id, list({{'model': model, 'label': label, 'confidence': round(confidence, 6), 'error': error}} ORDER BY model)::VARCHAR AS votes FROM ann GROUP BY item_id")
def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes written as a result log of JSON lines in two runs, the second of which writes every third item anew, and read back:
    the last record of an item counts."""
    ann = annotations(spark, sf_dir)
    vote = F.struct("model", "label", F.round("confidence", 6).alias("confidence"), "error")
    items = ann.groupBy(F.col("item_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(vote)).alias("round1"))
    path = shared_dir(spark, "results")
    old = items.where("cast(id AS bigint) % 3 = 0").select("id", F.lit("old").alias("label"), F.array().cast(items.schema["round1"].dataType).alias("round1"))
    files.write_results(old, f"{path}/1-first")
    files.write_results(items, f"{path}/2-second")
    back = files.read_results(spark, f"{path}/*")
    one = lambda x: F.concat(F.lit("{'model': "), x["model"], F.lit(", 'label': "), F.coalesce(x["label"], F.lit("NULL")), F.lit(", 'confidence': "), x["confidence"].cast("string"), F.lit(", 'error': "), F.coalesce(x["error"], F.lit("NULL")), F.lit("}"))
    return back.select("id", F.concat(F.lit("["), F.array_join(F.transform("round1", one), ", "), F.lit("]")).alias("votes"))
