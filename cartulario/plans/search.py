"""Queries on retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulario.operators import search as ops
from cartulario.plans.base import Catalogue
from cartulario.plans.scalar import fold_sql
from cartulario.session import table

CATALOGUE = Catalogue()
TERMS = ["nulidad", "contrato", "multa"]


def _text(column: str = "text"):
    return {"texto": F.col(column)}


def bm25_sql(source: str, every: bool = False) -> str:
    """BM25 of TERMS over a subquery with doc, and the token lists t (text) and s (title, weight 3)."""
    tf = [f"(len(list_filter(t, lambda x: x = '{w}')) + 3.0 * len(list_filter(s, lambda x: x = '{w}')))" for w in TERMS]
    df = [f"count(*) FILTER (list_contains(t, '{w}') OR list_contains(s, '{w}'))" for w in TERMS]
    parts = [
        f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * {x} * 2.2 / ({x} + 1.2 * (0.25 + 0.75 * (len(t) + len(s)) / a))" for i, x in enumerate(tf)
    ]
    glue = " AND " if every else " OR "
    return f"""b AS ({source}), st AS (SELECT count(*) AS n, avg(len(t) + len(s)) AS a, {", ".join(f"{x} AS d{i}" for i, x in enumerate(df))} FROM b),
               sc AS (SELECT doc, {" + ".join(parts)} AS puntaje FROM b, st WHERE {glue.join(f"{x} > 0" for x in tf)})"""


_DOCS = f"""SELECT doc_id AS doc, coalesce(regexp_extract_all({fold_sql("text")}, '[a-z0-9]+'), []) AS t, CAST([] AS VARCHAR[]) AS s FROM documents"""
_TITLED = f"""SELECT doc_id AS doc, coalesce(regexp_extract_all({fold_sql("text")}, '[a-z0-9]+'), []) AS t,
                     coalesce(regexp_extract_all({fold_sql("titulo")}, '[a-z0-9]+'), []) AS s FROM documents"""


@CATALOGUE.query(f"WITH {bm25_sql(_DOCS)} SELECT doc, round(puntaje, 6) AS puntaje FROM sc")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold one of three terms, with their score."""
    out = ops.bm25(table(spark, sf_dir, "documents"), "doc_id", _text(), {}, TERMS)
    return out.withColumn("puntaje", F.round("puntaje", 6))


@CATALOGUE.query(f"WITH {bm25_sql(_TITLED)} SELECT doc, round(puntaje, 6) AS puntaje FROM sc")
def bm25_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with titles that weigh three times."""
    fields = {"texto": F.col("text"), "titulo": F.col("titulo")}
    out = ops.bm25(table(spark, sf_dir, "documents"), "doc_id", fields, {"titulo": 3.0}, TERMS)
    return out.withColumn("puntaje", F.round("puntaje", 6))


@CATALOGUE.query(
    f"""WITH {bm25_sql(_DOCS)}, al AS (SELECT doc FROM b WHERE {" AND ".join(f"list_contains(t, '{w}')" for w in TERMS)})
        SELECT doc, round(puntaje, 6) AS puntaje FROM sc WHERE doc IN (FROM al) OR NOT EXISTS (FROM al) ORDER BY round(puntaje, 9) DESC, doc LIMIT 50"""
)
def bm25_all_then_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents with all terms, or with any if none has all."""
    out = ops.all_then_any(table(spark, sf_dir, "documents"), "doc_id", _text(), {}, TERMS, 50)
    return out.withColumn("puntaje", F.round("puntaje", 6))


@CATALOGUE.query(
    f"""WITH w AS (SELECT doc_id AS doc, unnest(regexp_extract_all({fold_sql("text")}, '[a-z0-9]+')) AS termino FROM documents)
        SELECT termino, count(*) AS veces, count(DISTINCT doc) AS documentos FROM w GROUP BY termino"""
)
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index by term."""
    p = ops.postings(table(spark, sf_dir, "documents"), "doc_id", _text())
    return p.groupBy("termino").agg(F.sum("tf").alias("veces"), F.count(F.lit(1)).alias("documentos"))


@CATALOGUE.query(
    f"""SELECT doc_id AS doc, a AS aguja FROM documents, (SELECT unnest(['prescripcion', 'camino', 'llave']) AS a) WHERE contains({fold_sql("text")}, a)"""
)
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a needle, accents aside."""
    return ops.substring_search(table(spark, sf_dir, "documents"), "doc_id", "text", ["prescripción", "camino", "llave", "el"])


@CATALOGUE.query(
    f"""WITH f AS (SELECT n, {fold_sql("titulo")} AS t FROM entrada WHERE length(titulo) >= 3),
        g AS (SELECT DISTINCT n, substr(t, i, 3) AS trigrama FROM (SELECT n, t, unnest(range(1, length(t) - 1)) AS i FROM f))
        SELECT trigrama, count(*) AS documentos FROM g GROUP BY trigrama"""
)
def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of entries by trigram."""
    return ops.trigram_index(table(spark, sf_dir, "entrada"), "n", "titulo").groupBy("trigrama").agg(F.count(F.lit(1)).alias("documentos"))


_DENSE = """SELECT q.vec_id AS consulta, b.vec_id AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS coseno
            FROM embeddings q JOIN embeddings b ON b.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0"""


@CATALOGUE.query(f"SELECT *, CAST(row_number() OVER (PARTITION BY consulta ORDER BY coseno DESC, doc) AS INTEGER) AS rango FROM ({_DENSE}) QUALIFY rango <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every twentieth."""
    e = table(spark, sf_dir, "embeddings")
    return ops.dense_top(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)


@CATALOGUE.query(
    f"""WITH {bm25_sql(_DOCS)}, l AS (SELECT doc, row_number() OVER (ORDER BY round(puntaje, 9) DESC, doc) AS r FROM sc QUALIFY r <= 100),
        v AS (SELECT b.vec_id AS doc, row_number() OVER (ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS r
              FROM embeddings q JOIN embeddings b ON q.vec_id = 0 AND b.vec_id <> 0 QUALIFY r <= 100)
        SELECT coalesce(v.doc, l.doc) AS doc, CAST(v.r AS INTEGER) AS rango_a, CAST(l.r AS INTEGER) AS rango_b,
               round(coalesce(0.6 / (60 + v.r), 0) + coalesce(0.4 / (60 + l.r), 0), 9) AS puntaje FROM v FULL JOIN l ON v.doc = l.doc"""
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector ranking and a text ranking of a hundred each, fused."""
    e = table(spark, sf_dir, "embeddings")
    dense = ops.dense_top(e.filter("vec_id = 0"), e, "vec_id", "embedding", 100)
    text = ops.bm25(table(spark, sf_dir, "documents"), "doc_id", _text(), {}, TERMS).orderBy(F.desc(F.round("puntaje", 9)), "doc").limit(100)
    # The window holds the hundred rows of the report.
    text = text.withColumn("rango", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("puntaje", 9)), "doc")))
    return ops.fused(dense, text, "doc", "rango").withColumn("puntaje", F.round("puntaje", 9))


@CATALOGUE.query(
    f"""WITH w AS (SELECT id, {fold_sql("doctrina")} AS x, list_distinct(list_filter(regexp_extract_all({fold_sql("doctrina")}, '[a-z0-9]+'), lambda w: length(w) >= 3)) AS d FROM sentencias_judiciales),
        c AS (SELECT id, x, d, len(list_intersect(d, ['nulidad', 'contrato', 'costas'])) AS k FROM w)
        SELECT id AS doc, round(10 * k / (len(d) + 3 - k) + CASE WHEN contains(x, 'nulidad contrato costas') THEN 5.0 ELSE 0.0 END, 6) AS puntaje FROM c WHERE k > 0"""
)
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings by the overlap of their words with a query's."""
    out = ops.word_overlap(table(spark, sf_dir, "sentencias_judiciales"), "id", "doctrina", "nulidad contrato costas")
    return out.withColumn("puntaje", F.round("puntaje", 6))


@CATALOGUE.query()
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the ruling captions."""
    return ops.hash_embedding(table(spark, sf_dir, "sentencias_judiciales"), "id", "caratula", 64)


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
