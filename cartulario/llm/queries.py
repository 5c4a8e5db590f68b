"""Queries of the operators in this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.llm.bpe import count_tokens, encode_texts
from cartulario.llm.canonical import map_to_canonical
from cartulario.llm.chunking import split_oversized, unit_count
from cartulario.llm.mixture import mix_sources, scheduled_shares
from cartulario.llm.neighbours import nearest, set_aside
from cartulario.llm.readability import reading_levels
from cartulario.llm.scans import repair_scans
from cartulario.session import table


def _limits(spark: SparkSession, sf_dir: str) -> list:
    """The two rows of limits: parameters of the plan; incomplete rows set no limit."""
    names = ["tabla", "campo", "unidad", "maximo", "solape"]
    return table(spark, sf_dir, "limites_trozo").select(*names).dropna().distinct().orderBy("tabla", "campo").collect()


def p1_trozos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text over its limit."""
    parts = []
    for limit in _limits(spark, sf_dir):
        pieces = split_oversized(table(spark, sf_dir, limit.tabla), "id", limit.campo, limit.unidad, limit.maximo, limit.solape)
        parts.append(pieces.select(F.lit(limit.tabla).alias("tabla"), F.lit(limit.campo).alias("campo"), *pieces.columns))
    if not parts:
        return spark.createDataFrame([], "tabla string, campo string, id long, pieza int, piezas int, desde int, hasta int, solape int, texto string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that were cut: those over their limit."""
    return p1_trozos(spark, sf_dir).filter((F.col("pieza") == 1) & (F.col("piezas") > 1)).select("tabla", "campo", "id")


def p1_cobertura(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text that was cut whether its pieces make it up again, keep the limit, and share no more than the overlap."""
    pieces = p1_trozos(spark, sf_dir)
    parts = []
    for limit in _limits(spark, sf_dir):
        size = lambda c, unit=limit.unidad: unit_count(c, unit)
        own = pieces.filter((F.col("tabla") == limit.tabla) & (F.col("campo") == limit.campo))
        keeps = (size(F.col("texto")) <= limit.maximo) & (size(F.left("texto", F.col("solape"))) <= limit.solape)
        # Pieces of a text of the largest size go through one state each; digests of cores are put together in order, not the texts.
        by_text = own.groupBy("tabla", "campo", "id").agg(
            F.every(keeps).alias("dentro"), F.max("piezas").alias("piezas"), F.count(F.lit(1)).alias("filas"), F.sum(F.length("texto") - F.col("solape")).alias("largo"), F.max("hasta").alias("hasta"),
            F.array_sort(F.collect_list(F.struct("pieza", F.substr("texto", F.col("solape") + 1).alias("t")))).alias("c"),
        )
        whole = table(spark, sf_dir, limit.tabla).select("id", F.md5(limit.campo).alias("__md5"), F.length(limit.campo).alias("__largo"))
        joined = by_text.join(whole, "id").withColumn("__again", F.md5(F.array_join(F.transform("c", lambda x: x["t"]), "")))
        rebuilt = (F.col("__again") == F.col("__md5")) & (F.col("largo") == F.col("__largo")) & (F.col("hasta") == F.col("__largo")) & (F.col("filas") == F.col("piezas"))
        parts.append(joined.select("tabla", "campo", "id", rebuilt.alias("entero"), "dentro"))
    if not parts:
        return spark.createDataFrame([], "tabla string, campo string, id long, entero boolean, dentro boolean")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p3_vecinos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every usable vector."""
    return nearest(table(spark, sf_dir, "articulos_vectorial"), per_cell=600)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least 0.70 of which one is among the five nearest of the other."""
    near = nearest(table(spark, sf_dir, "articulos_vectorial"), least=0.70)
    return near.select(F.least("id", "vecino").alias("id_a"), F.greatest("id", "vecino").alias("id_b")).distinct()


def p3_apartados(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that cannot be compared, with the reason."""
    return set_aside(table(spark, sf_dir, "articulos_vectorial"))


def p4_valores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed court, room and subject with the entry it means and how many edits away it is."""
    rulings = table(spark, sf_dir, "sentencias_judiciales")
    return map_to_canonical(rulings, "id", ["tribunal", "sala", "materia"], table(spark, sf_dir, "catalogo_canonico"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value with its entry or ``sin_clave``."""
    return p4_valores(spark, sf_dir).select("id", "campo", "clave")


def p6_textos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents and definitions of the institution cards as readable paragraphs."""
    cards = table(spark, sf_dir, "doctrina_instituciones")
    return repair_scans(cards, "id", ["contenido", "definicion"], ["obra", "autor"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of scan noise in each text."""
    return p6_textos(spark, sf_dir).select("id", "campo", F.explode("tipos").alias("tipo"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share in the scheduled mixture."""
    return p8_cuotas(spark, sf_dir).filter("limitada").select("source")


def p8_cuotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target share of each source and its actual share in the scheduled mixture."""
    sizes = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return scheduled_shares(sizes, "doc_id", "source", "tokens", table(spark, sf_dir, "mezcla_objetivos"))


def p8_mezcla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: each use of a document with its turn."""
    sizes = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mix_sources(sizes, "doc_id", "source", "tokens", table(spark, sf_dir, "mezcla_objetivos"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_niveles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty and level of every Spanish prose text."""
    return reading_levels(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "niveles_muestra"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every Spanish prose text."""
    return p9_niveles(spark, sf_dir).select("doc_id", "nivel")


QUERIES = {"p1_found": p1_found, "p1_trozos": p1_trozos, "p1_cobertura": p1_cobertura, "p3_found": p3_found, "p3_vecinos": p3_vecinos, "p3_apartados": p3_apartados, "p4_found": p4_found, "p4_valores": p4_valores, "p6_found": p6_found, "p6_textos": p6_textos, "p7_ids": p7_ids, "p8_found": p8_found, "p8_cuotas": p8_cuotas, "p8_mezcla": p8_mezcla, "p9_found": p9_found, "p9_niveles": p9_niveles}

_COMPARABLE = """
        SELECT id, dimension, vector::DOUBLE[] AS v FROM articulos_vectorial
        WHERE vector IS NOT NULL AND len(vector) = dimension AND len(vector) > 0
          AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(vector, lambda x: x <> 0)) > 0"""

_OVER = """
        SELECT 'doctrina_instituciones' AS tabla, 'contenido' AS campo, id FROM doctrina_instituciones
        WHERE len(regexp_extract_all(contenido, '[^ \\t\\n\\r\\f]+')) >
              (SELECT maximo FROM limites_trozo WHERE tabla = 'doctrina_instituciones' AND campo = 'contenido')
        UNION ALL
        SELECT 'articulos_vectorial', 'texto', id FROM articulos_vectorial
        WHERE length(texto) > (SELECT maximo FROM limites_trozo WHERE tabla = 'articulos_vectorial' AND campo = 'texto')"""

SQL = {
    "p1_cobertura": f"SELECT *, true AS entero, true AS dentro FROM ({_OVER})",
    "p3_found": f"""
        WITH u AS ({_COMPARABLE}),
        s AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.v, b.v), 9) AS s
              FROM u a JOIN u b ON a.dimension = b.dimension AND a.id <> b.id),
        r AS (SELECT x, y FROM s WHERE s >= 0.7
              QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 5)
        SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r""",
    "p3_apartados": """
        SELECT id, CASE WHEN vector IS NULL THEN 'nulo'
                        WHEN coalesce(len(vector) <> dimension, true) THEN 'dimension'
                        WHEN len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'no_finito'
                        ELSE 'cero' END AS motivo
        FROM articulos_vectorial
        WHERE id NOT IN (SELECT id FROM (""" + _COMPARABLE + """))""",
    "p1_found": _OVER,
}
