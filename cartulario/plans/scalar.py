"""Queries on column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions import dates, ids, text
from cartulario.plans.base import Catalogue
from cartulario.session import table

CATALOGUE = Catalogue()
_FOLD = f"translate(lower({{0}}), '{text.ACCENTED}', '{text.PLAIN}')"


def fold_sql(column: str) -> str:
    """The SQL of ``fold``."""
    return _FOLD.format(column)


@CATALOGUE.query(
    f"""SELECT n, {fold_sql("titulo")} AS plegado,
               regexp_replace(regexp_replace({fold_sql("titulo")}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS lema,
               coalesce(len(regexp_extract_all({fold_sql("titulo")}, '[a-z0-9]+')), 0) AS fichas
        FROM entrada"""
)
def fn_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded titles, slugs and token counts."""
    t = F.col("titulo")
    return table(spark, sf_dir, "entrada").select("n", text.fold(t).alias("plegado"), text.slug(t).alias("lema"), F.size(text.tokens(t)).cast("long").alias("fichas"))


@CATALOGUE.query("SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS blob FROM documents WHERE text IS NOT NULL")
def fn_git_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of documents."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.git_blob_id(F.col("text")).alias("blob"))


#: Every stretch that may be a date, in order, each tried in the three ways; the first that is one within the years counts.
_MONTH = "list_position(['" + "','".join(dates.MONTHS) + "'], regexp_extract(c, ' de ([a-z]+) ', 1))"
_TRIED = f"""CASE WHEN regexp_matches(c, '^\\d{{4}}[-/.]') THEN try_strptime(regexp_replace(c, '[/.]', '-', 'g'), '%Y-%m-%d')
        WHEN regexp_matches(c, '^\\d{{1,2}}[-/.]') THEN try_strptime(regexp_replace(c, '[/.]', '-', 'g'), '%d-%m-%Y')
        ELSE try_strptime(right(c, 4) || '-' || {_MONTH} || '-' || regexp_extract(c, '^\\d+'), '%Y-%m-%d') END"""
_STRETCH = "\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}|\\d{1,2}[-/.]\\d{1,2}[-/.]\\d{4}|\\d{1,2}\\s*[°º]?\\s+de\\s+[a-z]+\\s+del?\\s+\\d{4}"


@CATALOGUE.query(
    f"""WITH x AS (SELECT 'entrada' AS tabla, n AS id, lower(fecha) AS f FROM entrada
                  UNION ALL SELECT 'sentencias_judiciales', id, lower(fecha) FROM sentencias_judiciales
                  UNION ALL SELECT 'documents', doc_id, lower(fecha) FROM documents
                  UNION ALL SELECT 'texto', id, 'nº 45-6: en talca, a ' || coalesce(lower(fecha), '31/02/2020') || ' y 1° de enero del 2020' FROM sentencias_judiciales)
        SELECT tabla, id, strftime(list_filter(list_transform(regexp_extract_all(f, '{_STRETCH}'), lambda c: {_TRIED}), lambda d: d IS NOT NULL AND year(d) BETWEEN 1900 AND 2100)[1], '%Y-%m-%d') AS fecha FROM x"""
)
def fn_iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of three tables in one form, and dates amid other words."""
    within = F.concat(F.lit("N° 45-6: en Talca, a "), F.coalesce("fecha", F.lit("31/02/2020")), F.lit(" y 1° de enero del 2020"))
    parts = [table(spark, sf_dir, "sentencias_judiciales").select(F.lit("texto").alias("tabla"), "id", dates.iso_date(within).alias("fecha"))]
    for name, key in (("entrada", "n"), ("sentencias_judiciales", "id"), ("documents", "doc_id")):
        parts.append(table(spark, sf_dir, name).select(F.lit(name).alias("tabla"), F.col(key).alias("id"), dates.iso_date(F.col("fecha")).alias("fecha")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@CATALOGUE.query(
    """SELECT o_orderkey, CAST((SELECT count(*) FROM range(o_orderdate::DATE + INTERVAL 1 DAY, o_orderdate::DATE + INTERVAL (o_orderkey % 40 + 1) DAY, INTERVAL 1 DAY) r(d)
                         WHERE dayofweek(d) NOT IN (0, 6) AND month(d) * 100 + day(d) NOT IN (101, 501, 521, 620, 716, 815, 918, 919, 1031, 1101, 1208, 1225)) AS INTEGER) AS habiles FROM orders"""
)
def fn_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working days within a term that depends on the order."""
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 40).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.business_days(start, end).alias("habiles"))


@CATALOGUE.query(
    """WITH d AS (SELECT c_custkey, list_reverse(list_transform(string_split(CAST(c_custkey AS VARCHAR), ''), lambda x: CAST(x AS INTEGER))) AS f FROM customer),
       s AS (SELECT c_custkey, 11 - list_sum(list_transform(f, lambda x, i: x * ((i - 1) % 6 + 2))) % 11 AS r FROM d)
       SELECT c_custkey, CASE r WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(r AS VARCHAR) END AS digito FROM s"""
)
def fn_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits of customer keys."""
    return table(spark, sf_dir, "customer").select("c_custkey", ids.check_digit(F.col("c_custkey")).alias("digito"))


@CATALOGUE.query(
    f"""SELECT id, 'autor:' || array_to_string(list_sort(list_distinct(list_filter(string_split(
               regexp_replace({fold_sql("autor")}, '[^a-z0-9]+', '_', 'g'), '_'), lambda w: w <> ''))), '_') AS persona FROM doctrina_instituciones
        WHERE regexp_matches({fold_sql("autor")}, '[a-z0-9]')"""
)
def fn_person_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of authors."""
    out = table(spark, sf_dir, "doctrina_instituciones").select("id", ids.person_id(F.col("autor")).alias("persona"))
    return out.filter(F.col("persona").isNotNull())


@CATALOGUE.query(
    """WITH r AS (SELECT id, regexp_extract(upper(trim(rol)), '^([A-Z])-\\d+-\\d{4}$', 1) AS l FROM sentencias_judiciales)
       SELECT id, CASE l WHEN 'C' THEN 'civil' WHEN 'P' THEN 'penal' WHEN 'L' THEN 'laboral' WHEN 'T' THEN 'tutela'
                         WHEN 'R' THEN 'reclamacion' WHEN 'F' THEN 'familia' END AS clase FROM r"""
)
def fn_role_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of procedure by role."""
    return table(spark, sf_dir, "sentencias_judiciales").select("id", ids.role_class(F.col("rol")).alias("clase"))


@CATALOGUE.query(
    """SELECT id, 'cs:' || regexp_extract(fallo_rector, '^CS 0*(\\d{1,7}-\\d{4})$', 1) AS fallo FROM doctrina_instituciones
       WHERE regexp_matches(fallo_rector, '^CS \\d{1,7}-\\d{4}$')"""
)
def fn_supreme_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading rulings of institution cards as identifiers."""
    out = table(spark, sf_dir, "doctrina_instituciones").select("id", ids.supreme_id(F.col("fallo_rector")).alias("fallo"))
    return out.filter(F.col("fallo").isNotNull())


@CATALOGUE.query(
    """SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[correo]', 'g') AS texto FROM documents WHERE contains(text, '@')"""
)
def fn_mask_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with e-mail addresses masked."""
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", text.mask_emails(F.col("text")).alias("texto"))


@CATALOGUE.query(
    """SELECT id, CAST(strpos(x, 'notificacion') AS INTEGER) AS lugar,
              substr(doctrina, greatest(strpos(x, 'notificacion') - 40, 1), strpos(x, 'notificacion') - greatest(strpos(x, 'notificacion') - 40, 1) + 12 + 40) AS pasaje
       FROM (SELECT id, doctrina, """
    + fold_sql("doctrina")
    + """ AS x FROM sentencias_judiciales) WHERE strpos(x, 'notificacion') > 0"""
)
def fn_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage around a term in each ruling that holds it."""
    d = F.col("doctrina")
    out = table(spark, sf_dir, "sentencias_judiciales").select(
        "id", F.position(F.lit("notificacion"), text.fold(d)).alias("lugar"), text.passage(d, "notificación", 40).alias("pasaje")
    )
    return out.filter("lugar > 0")


@CATALOGUE.query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS linea FROM documents),
       t AS (SELECT doc_id, trim(linea) AS s FROM l)
       SELECT doc_id, count(*) AS titulos FROM t
       WHERE length(s) BETWEEN 4 AND 110 AND NOT regexp_matches(s, '[.;:,]$')
         AND (regexp_matches(s, '(?i)^(?:#+ |cap[íi]tulo |t[íi]tulo |secci[óo]n |libro |art[íi]culo |[ivxlc]+\\.|\\d+[.)])')
              OR (length(regexp_replace(s, '[^\\p{L}]', '', 'g')) > 0
                  AND length(regexp_replace(s, '[^\\p{Lu}]', '', 'g')) * 10 > length(regexp_replace(s, '[^\\p{L}]', '', 'g')) * 8))
       GROUP BY doc_id"""
)
def fn_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that read as headings, by document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("linea"))
    return lines.filter(text.heading_like(F.col("linea"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("titulos"))


@CATALOGUE.query()
def fn_norm_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed norm with its identifier."""
    from cartulario.operators.packed_values import unpack

    values = unpack(table(spark, sf_dir, "sentencias_judiciales"), "id", "normas")
    return values.select("id", "posicion", ids.norm_id(F.col("valor")).alias("norma"))


@CATALOGUE.query()
def fn_legal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised article texts with a summary and a size estimate."""
    t = text.legal_text(F.col("texto"))
    return table(spark, sf_dir, "articulos_vectorial").select("id", t.alias("texto"), text.summary(t, 600).alias("resumen"), text.token_estimate(t).alias("fichas"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
