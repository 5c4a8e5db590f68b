"""Queries on records, segments and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions import records, segments
from cartulario.operators.heavy_keys import folded
from cartulario.plans.base import Catalogue
from cartulario.plans.scalar import fold_sql
from cartulario.session import table
from cartulario.sinks.files import numbered, partition_of, upserted

CATALOGUE = Catalogue()


@CATALOGUE.query(
    """SELECT id, CASE WHEN trim(sala) <> '' THEN sala END AS sala, CASE WHEN trim(materia) <> '' THEN materia END AS materia,
              coalesce(CASE WHEN trim(caratula) <> '' THEN caratula END, CASE WHEN trim(materia) <> '' THEN materia END, CASE WHEN trim(rol) <> '' THEN rol END) AS nombre FROM sentencias_judiciales"""
)
def rec_without_empties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings without blank values, under the first name that is filled."""
    s = table(spark, sf_dir, "sentencias_judiciales").select("id", "sala", "materia", "caratula", "rol")
    return records.without_empties(s).select("id", "sala", "materia", records.first_filled(F.col("caratula"), F.col("materia"), F.col("rol")).alias("nombre"))


@CATALOGUE.query(
    """SELECT n AS origen, 'id' AS campo, id AS destino FROM entrada WHERE regexp_matches(id, '^(?:cs|tc|ta|doc):')
       UNION ALL SELECT n, 'rol', 'rol:' || rol FROM entrada WHERE rol IS NOT NULL"""
)
def rec_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier that stands in a field of an entry."""
    e = table(spark, sf_dir, "entrada").select("n", "id", "titulo", F.concat(F.lit("rol:"), F.col("rol")).alias("rol"))
    return records.references(e, "n", ("cs", "tc", "ta", "doc", "rol"))


@CATALOGUE.query(
    """SELECT n, CASE WHEN titulo IS NULL THEN 'sin_titulo' WHEN fecha IS NULL THEN 'sin_fecha' WHEN coalesce(NOT (bytes > 500), true) THEN 'corto' END AS motivo,
              concat_ws(',', CASE WHEN col <> lower(col) THEN 'col_mayuscula' END, CASE WHEN era IS NULL THEN 'sin_era' END) AS marcas FROM entrada"""
)
def rec_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each entry breaks, and its quality marks."""
    e = table(spark, sf_dir, "entrada")
    rules = {"sin_titulo": F.col("titulo").isNotNull(), "sin_fecha": F.col("fecha").isNotNull(), "corto": F.col("bytes") > 500}
    found = records.marks(sin_era=F.col("era").isNull(), col_mayuscula=F.col("col") != F.lower("col"))
    return records.with_reasons(e, rules).select("n", "motivo", F.array_join(found, ",").alias("marcas"))


@CATALOGUE.query(
    f"""WITH x AS (SELECT id, {fold_sql("doctrina")} AS t FROM sentencias_judiciales),
        s AS (SELECT id, contains(t, 'empleador')::INT + contains(t, 'despido')::INT AS l, contains(t, 'contrato')::INT + contains(t, 'arrendatario')::INT + contains(t, 'perjuicios')::INT AS c,
                     contains(t, 'recurrido')::INT + contains(t, 'fiscalizador')::INT AS a FROM x)
        SELECT id, CASE WHEN greatest(l, c, a) > 0 THEN CASE greatest(l, c, a) WHEN l THEN 'laboral' WHEN c THEN 'civil' ELSE 'administrativo' END END AS rama FROM s"""
)
def rec_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch of law whose keywords a ruling holds most of."""
    words = {"laboral": ["empleador", "despido"], "civil": ["contrato", "arrendatario", "perjuicios"], "administrativo": ["recurrido", "fiscalizador"]}
    return table(spark, sf_dir, "sentencias_judiciales").select("id", records.scored_labels(F.col("doctrina"), words).alias("rama"))


@CATALOGUE.query(
    """WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)art[íi]culos?\\s+(\\d+)\\s+del\\s+(código\\s+(?:de\\s+)?\\p{L}+(?:\\s+de\\s+\\p{L}+)?|cpr)', 1)) AS articulo,
                    unnest(regexp_extract_all(text, '(?i)art[íi]culos?\\s+(\\d+)\\s+del\\s+(código\\s+(?:de\\s+)?\\p{L}+(?:\\s+de\\s+\\p{L}+)?|cpr)', 2)) AS codigo FROM documents)
       SELECT doc_id AS id, lower(codigo) AS codigo, articulo, count(*) AS veces FROM p GROUP BY 1, 2, 3"""
)
def seg_article_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of codes that documents refer to."""
    return segments.article_mentions(table(spark, sf_dir, "documents"), "doc_id", "text")


@CATALOGUE.query(
    """WITH h AS (SELECT doc_id, list_slice(regexp_extract_all(text, '(?m)^#{1,3} +[^\\n]+'), 1, 80) AS l FROM documents), x AS (SELECT doc_id, unnest(range(len(l))) AS orden, unnest(l) AS t FROM h)
       SELECT doc_id AS id, CAST(orden AS INTEGER) AS orden, CAST(length(regexp_extract(t, '^#+')) AS INTEGER) AS nivel, trim(regexp_replace(t, '^#+ +', '')) AS titulo FROM x"""
)
def seg_section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of documents with their levels."""
    return segments.section_index(table(spark, sf_dir, "documents"), "doc_id", "text")


@CATALOGUE.query()
def seg_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institution cards cut at their second-level headings."""
    return segments.sections(table(spark, sf_dir, "doctrina_instituciones"), "id", "contenido")


#: Parts between blank lines, or lines if there is but one part, numbered, without list marks and numbers at their start.
PARAGRAPHS_SQL = r"""pa AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\r?\n[ \t]*\r?\n'), lambda p: regexp_matches(p, '\S')) AS b, list_filter(regexp_split_to_array(text, '\r?\n'), lambda p: regexp_matches(p, '\S')) AS l FROM documents),
       pb AS (SELECT id, CASE WHEN len(b) > 1 THEN b ELSE l END AS p FROM pa), pc AS (SELECT id, unnest(p) AS p, CAST(generate_subscripts(p, 1) AS INTEGER) AS orden FROM pb),
       pp AS (SELECT id, orden, regexp_replace(regexp_replace(p, '^\s*(?:[-*•]|\d+[.)°]|[a-z]\))\s+', ''), '^\s+|\s+$', '', 'g') AS parrafo FROM pc)"""


@CATALOGUE.query(f"WITH {PARAGRAPHS_SQL} SELECT * FROM pp")
def seg_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the documents."""
    return segments.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")


@CATALOGUE.query(
    r"""WITH l AS (SELECT id, k, lineas[k] AS l FROM (SELECT id, lineas, unnest(range(1, len(lineas) + 1)) AS k FROM
                 (SELECT id, string_split(replace(contenido, chr(13) || chr(10), chr(10)), chr(10)) AS lineas FROM doctrina_instituciones WHERE contenido IS NOT NULL))),
       m AS (SELECT *, count(*) OVER (PARTITION BY id, trim(l, ' ')) AS n FROM l)
       SELECT id, coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (NOT (length(trim(l, ' ')) BETWEEN 6 AND 89 AND n >= 3) AND NOT regexp_matches(l, '^\s*\d{1,4}\s*$')), '') AS texto FROM m GROUP BY id"""
)
def seg_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents without lines that run through them."""
    return segments.without_running_lines(table(spark, sf_dir, "doctrina_instituciones"), "id", "contenido", 3)


@CATALOGUE.query("SELECT n, CASE WHEN ruta LIKE 'corpus_cs/%/%' THEN 'cs-' || split_part(ruta, '/', 2) ELSE replace(split_part(ruta, '/', 1), 'corpus_', '') END AS particion FROM entrada")
def snk_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition to which each file is written."""
    return table(spark, sf_dir, "entrada").select("n", partition_of(F.col("ruta")).alias("particion"))


@CATALOGUE.query(
    """SELECT rol, id FROM (SELECT rol, id, row_number() OVER (PARTITION BY rol ORDER BY cosechado_en DESC, id DESC) AS k FROM sentencias_judiciales WHERE rol IS NOT NULL) WHERE k = 1"""
)
def snk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of rulings after later harvests replaced earlier ones."""
    s = table(spark, sf_dir, "sentencias_judiciales").select("rol", "id", "cosechado_en").filter("rol IS NOT NULL")
    odd, even = s.filter("id % 2 = 1"), s.filter("id % 2 = 0")
    newest = [F.desc("cosechado_en"), F.desc("id")]
    first = upserted(odd.limit(0), odd, ["rol"], newest)
    both = first.join(even.select("rol"), "rol", "left_semi").unionByName(even)
    return upserted(first, both, ["rol"], newest).select("rol", "id")


@CATALOGUE.query("SELECT n, 'ent-' || lpad(CAST(row_number() OVER (ORDER BY n) AS VARCHAR), 8, '0') AS id_serie FROM entrada")
def snk_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries under consecutive numbers."""
    return numbered(table(spark, sf_dir, "entrada").select("n"), [F.col("n")], "ent-", 8)


@CATALOGUE.query(
    """SELECT lower(trim(d.source)) AS source, count(*) AS textos, count(e.n) AS con_entrada FROM documents d LEFT JOIN (SELECT DISTINCT rol AS causa, 1 AS n FROM sentencias_judiciales WHERE rol IS NOT NULL) e ON e.causa = d.causa GROUP BY 1"""
)
def rec_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source belong to a known ruling."""
    known = table(spark, sf_dir, "sentencias_judiciales").select(F.col("rol").alias("causa")).filter("causa IS NOT NULL").distinct().withColumn("n", F.lit(1))
    d = table(spark, sf_dir, "documents").select(folded("source").alias("source"), "causa").join(known, "causa", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("textos"), F.count("n").alias("con_entrada"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
