"""Queries that retrieve similar labelled examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import embedder, neighbours, text_neighbours
from ..operators.metrics import rate
from ..sources.shared import shared_dir
from ..sources.tables import table
from .registry import query

_KNN = """v AS (SELECT vec_id, label, CAST(embedding AS double[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, a.label AS ql, b.label AS nl, round(list_inner_product(a.e, b.e) / a.norm / b.norm, 9) AS sim FROM n a JOIN n b ON a.vec_id <> b.vec_id{asked}),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS int) AS rank FROM s)"""
_KNN, _KNN_ALL = _KNN.format(asked=" WHERE a.vec_id % 50 = 0"), _KNN.format(asked="")


@query(f"WITH {_KNN} SELECT query, neighbour, round(sim, 6) AS sim, rank FROM k WHERE rank <= 6")
def knn_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every fiftieth vector, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return neighbours.by_cosine(e, e.where("vec_id % 50 = 0"), 6).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {_KNN_ALL}, c AS (SELECT query, ql, nl, count(*) AS n, min(rank) AS first_rank FROM k WHERE rank <= 6 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, first_rank) AS rk FROM c)
SELECT count(*) AS n, count(*) FILTER (WHERE ql = nl) AS hits, round(CAST(count(*) FILTER (WHERE ql = nl) AS double) / count(*), 6) AS hit_rate FROM b WHERE rk = 1""")
def knn_label_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the neighbours' most frequent label is a vector's own, over all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    e = vectors.select("vec_id", "label")
    k = neighbours.by_cosine(vectors, vectors, 6).join(e.toDF("neighbour", "nl"), "neighbour")
    c = k.groupBy("query", "nl").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    b = c.withColumn("rk", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "first_rank"))).where("rk = 1").join(e.toDF("query", "ql"), "query")
    hit = F.count_if(F.col("ql") == F.col("nl"))
    return b.agg(F.count("*").alias("n"), hit.alias("hits"), rate(hit, F.count("*")).alias("hit_rate"))


@query()
def knn_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every fiftieth document, against all documents; SQL is too slow for it on whole texts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return text_neighbours.by_tfidf(d, d.where("id % 50 = 0"), 6)


@query("""WITH t AS (SELECT DISTINCT trim(text) AS t FROM documents WHERE trim(text) <> '')
SELECT sha256(t) AS h, [CAST(length(t) - length(replace(t, c, '')) AS double) FOR c IN ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']] AS v FROM t""")
def embed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts: a quarter of the documents fills the cache, then all are asked for."""
    d, cache = table(spark, sf_dir, "documents"), shared_dir(spark, "embeddings")
    embedder.embedded(d.where("doc_id % 4 = 0"), cache, "letters")
    return embedder.embedded(d, cache, "letters")
