"""Queries on joins by names and rules, citations in prose, and the parts of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions import anatomy
from cartulario.functions.cites import cited
from cartulario.operators import names as ops
from cartulario.plans.base import Catalogue
from cartulario.plans.scalar import fold_sql
from cartulario.session import spread, table

CATALOGUE = Catalogue()


def _words_sql(column: str) -> str:
    return f"array_to_string(regexp_extract_all({fold_sql(column)}, '[a-z0-9]+'), '  ')"


@CATALOGUE.query(
    f"""WITH t AS (SELECT id, ' ' || {_words_sql("concat_ws(' ', tribunal, materia, caratula)")} || ' ' AS x FROM sentencias_judiciales), n AS (SELECT clave, {_words_sql("nombre")} AS w FROM catalogo_canonico),
        h AS (SELECT id, clave AS nombre_id, CAST((length(x) - length(replace(x, ' ' || w || ' ', ''))) // (length(w) + 2) AS INTEGER) AS veces FROM t, n WHERE length(w) >= 5)
        SELECT * FROM h WHERE veces > 0"""
)
def names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts, rooms and subjects of the reference list that rulings name in full."""
    s = table(spark, sf_dir, "sentencias_judiciales").select("id", F.concat_ws(" ", "tribunal", "materia", "caratula").alias("x"))
    return ops.names_in_text(s, "id", "x", table(spark, sf_dir, "catalogo_canonico"), "clave", "nombre")


_RULES = [("despido", "materia:laboral", "trata_de"), ("trabajo", "materia:laboral", "trata_de"), ("agua", "materia:ambiental", "trata_de"), ("mina", "norma:codigo-mineria", "aplica"), ("alimentos", "materia:familia", "trata_de")]


@CATALOGUE.query(
    f"""WITH r AS (SELECT * FROM (VALUES {", ".join(map(str, _RULES))}) v(k, dst, rel)) SELECT DISTINCT s.id AS src, r.dst, r.rel FROM sentencias_judiciales s JOIN r ON contains({fold_sql("s.materia")}, r.k)"""
)
def rule_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from rulings to subjects and norms by keyword rules."""
    rules = spark.createDataFrame(_RULES, "palabra string, dst string, rel string")
    return ops.rule_edges(table(spark, sf_dir, "sentencias_judiciales"), "id", "materia", rules)


@CATALOGUE.query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem),
       a AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY k) FILTER (k <= 3) AS l, count(*) AS n FROM r GROUP BY 1)
       SELECT o_orderkey, coalesce(l, '') AS adjuntos, coalesce(n, 0) AS total FROM orders LEFT JOIN a ON l_orderkey = o_orderkey"""
)
def attached_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their first three lines, and how many there are."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    out = ops.attached(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", lines, "l_orderkey", ["l_linenumber", "l_partkey"], 3)
    return out.select("o_orderkey", F.array_join(F.transform("adjuntos", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("adjuntos"), "total")


_BATCH = ["tc:11", "nada:7", "cs:1-2025", "tc:11", "cs:6-2021"]


@CATALOGUE.query(
    f"""WITH w AS (SELECT CAST(unnest(range(0, {len(_BATCH)})) AS INTEGER) AS lugar, unnest({_BATCH}) AS pedido), f AS (SELECT id, min(titulo) AS valor FROM entrada GROUP BY id)
        SELECT lugar, pedido, valor, f.id IS NULL AS falta FROM w LEFT JOIN f ON f.id = w.pedido"""
)
def batch_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a batch of ids in their order, each looked up once."""
    e = table(spark, sf_dir, "entrada").groupBy("id").agg(F.min("titulo").alias("titulo"))
    return ops.batch_resolved(_BATCH, e, "id", "titulo")


_PREFIXES = ["sala", "tribunal", "recurso", "norma", "organo"]


@CATALOGUE.query(
    f"""WITH m AS (SELECT DISTINCT split_part(id, ':', 2) AS nombre FROM referencia WHERE n % 3 = 0), c AS (SELECT nombre, unnest({_PREFIXES}) || ':' || trim(regexp_replace({fold_sql("nombre")}, '[^a-z0-9]+', '-', 'g'), '-') AS id, unnest(range(0, {len(_PREFIXES)})) AS o FROM m),
        h AS (SELECT nombre, id, o + 1 AS orden FROM c WHERE id IN (SELECT id FROM referencia))
        SELECT nombre, id, CAST(orden AS INTEGER) AS orden FROM h UNION ALL SELECT nombre, id, 0 FROM c WHERE o = 0 AND nombre NOT IN (SELECT nombre FROM h)"""
)
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names of the dictionary may stand for."""
    r = table(spark, sf_dir, "referencia")
    named = r.filter("n % 3 = 0").select(F.get(F.split("id", ":"), F.lit(1)).alias("nombre"))
    return ops.candidate_ids(named, "nombre", r, "id", _PREFIXES)


_TERMS = ["cognoscibilidad", "vicio", "contenido"]


@CATALOGUE.query(
    f"""WITH x AS (SELECT id, coalesce({fold_sql("institucion")}, '') AS t, coalesce({fold_sql("definicion")}, '') AS b FROM doctrina_instituciones)
        SELECT id, {" + ".join(f"CAST(contains(b, '{w}') AS INT) * 2 + CAST(contains(t, '{w}') AS INT) * 10 + CAST(starts_with(t, '{w}') AS INT) * 5" for w in _TERMS)} + CAST(contains(t, '{" ".join(_TERMS)}') AS INT) * 25 AS puntos
        FROM x WHERE puntos > 0 ORDER BY puntos DESC, id LIMIT 50"""
)
def catalogue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty cards with most points for three words."""
    return ops.catalogue_hits(table(spark, sf_dir, "doctrina_instituciones"), "id", "institucion", "definicion", _TERMS, 50)


_ASKED = ["vicio", "proporcionalidades", "norma", "zzzz"]
_FIELDS = {"titulo": ("institucion", 14.0), "texto": ("definicion", 5.0), "obra": ("obra", 2.5)}


def _field_search_sql() -> str:
    lists = ", ".join(f"list_distinct(coalesce(regexp_extract_all({fold_sql(c)}, '[a-z0-9]+'), [])) AS l{i}" for i, (c, _) in enumerate(_FIELDS.values()))
    every = " || ".join(f"l{i}" for i in range(len(_FIELDS)))
    has = lambda a, w: f"list_contains({a}, '{w}')"
    starts = lambda a, w: f"len(list_filter({a}, lambda x: starts_with(x, '{w[:4]}'))) > 0"
    counts = ", ".join(f"count(*) FILTER ({has(f'({every})', w)}) AS n{i}, count(*) FILTER ({starts(f'({every})', w)}) AS p{i}" for i, w in enumerate(_ASKED))
    parts = []
    for i, w in enumerate(_ASKED):
        n = f"CASE WHEN n{i} > 0 THEN n{i} ELSE p{i} END"
        weight = " + ".join(f"CASE WHEN CASE WHEN n{i} > 0 THEN {has(f'l{j}', w)} ELSE {starts(f'l{j}', w)} END THEN {k}::DOUBLE ELSE 0 END" for j, (_, k) in enumerate(_FIELDS.values()))
        parts.append(f"greatest(ln(1 + (al - ({n}) + 0.5::DOUBLE) / (({n}) + 0.5::DOUBLE)), 0.5::DOUBLE) * ({weight}) * CASE WHEN n{i} > 0 THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END")
    return f"WITH x AS (SELECT id, {lists} FROM doctrina_instituciones), s AS (SELECT count(*) AS al, {counts} FROM x) SELECT id, CAST(round_even(({' + '.join(parts)}) * 100, 0) AS BIGINT) AS puntos FROM x, s WHERE puntos > 0"


@CATALOGUE.query(_field_search_sql())
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards by weighted fields; a word that no card holds is looked up by its beginning."""
    return ops.field_search(spread(table(spark, sf_dir, "doctrina_instituciones").select("id", "institucion", "definicion", "obra")), "id", _FIELDS, _ASKED)


@CATALOGUE.query(
    f"""WITH q AS (SELECT unnest(['7', 'La Cognoscibilidad del vicio redhibitorio', 'stricto sensu', 'mutatis mutandis', 'nada de nada']) AS q), n AS (SELECT CAST(id AS VARCHAR) AS id, institucion, {fold_sql("institucion")} AS l, {fold_sql("definicion")} AS d, tokens_aprox AS g FROM doctrina_instituciones),
        s AS (SELECT q, id, institucion, g, CASE WHEN id = q THEN 1 WHEN l = {fold_sql("q")} THEN 2 WHEN contains(l, {fold_sql("q")}) THEN 3 WHEN contains(d, {fold_sql("q")}) THEN 4 END AS paso FROM n, q)
        SELECT q AS consulta, paso, id FROM s WHERE paso IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY paso, coalesce(g, 0) DESC, length(institucion), id) = 1"""
)
def resolved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card that each of five queries means, by the first way that finds any."""
    d = table(spark, sf_dir, "doctrina_instituciones")
    nodes = d.select(F.col("id").cast("string").alias("id"), F.col("institucion").alias("etiqueta"), "definicion")
    degree = d.select(F.col("id").cast("string").alias("nodo"), F.col("tokens_aprox").alias("grado"))
    parts = [ops.resolved_node(nodes, q, degree).select(F.lit(q).alias("consulta"), "paso", "id") for q in ("7", "La Cognoscibilidad del vicio redhibitorio", "stricto sensu", "mutatis mutandis", "nada de nada")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@CATALOGUE.query(
    """WITH x AS (SELECT id, unnest(regexp_extract_all(regexp_replace(normas, '\\s+', ' ', 'g'), 'Ley N° (\\d{2}\\.\\d{3})', 1)) AS l FROM sentencias_judiciales) SELECT DISTINCT id, 'norma:ley-' || replace(l, '.', '') AS ley FROM x"""
)
def cite_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The laws that the packed norms of rulings cite, found by the grammar of prose."""
    found = cited(spread(table(spark, sf_dir, "sentencias_judiciales").select("id", "normas")), "id", "normas")
    return found.filter("destino LIKE 'norma:ley-%'").select("id", F.regexp_extract("destino", r"^(norma:ley-\d+)", 1).alias("ley")).distinct()


@CATALOGUE.query()
def cite_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms with their articles that documents and cards cite."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("text").alias("t"))
    c = table(spark, sf_dir, "doctrina_instituciones").select(F.concat(F.lit("inst:"), "id").alias("id"), F.concat_ws("\n", "contenido", "concordancias").alias("t"))
    return cited(d.unionByName(c), "id", "t")


@CATALOGUE.query()
def cite_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings that cards and documents cite."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("text").alias("t"))
    c = table(spark, sf_dir, "doctrina_instituciones").select(F.concat(F.lit("inst:"), "id").alias("id"), F.concat_ws("\n", "contenido", "fallo_rector").alias("t"))
    return cited(d.unionByName(c), "id", "t", "roles")


_KINDS = {"corpus_cs": "cs", "corpus_tc": "tc", "corpus_ta": "ta", "corpus_doc": "doc"}


@CATALOGUE.query(
    """WITH x AS (SELECT n, ruta, blob, bytes, coalesce('# ' || trim(titulo), 'sin título') AS t, split_part(ruta, '/', 1) AS f, titulo FROM entrada)
       SELECT coalesce(CASE f WHEN 'corpus_cs' THEN 'cs' WHEN 'corpus_tc' THEN 'tc' WHEN 'corpus_ta' THEN 'ta' WHEN 'corpus_doc' THEN 'doc' END, 'archivo') || ':' || replace(regexp_replace(regexp_replace(ruta, '^[^/]*/', ''), '\\.md$', ''), ' ', '_') AS id,
              coalesce(CASE f WHEN 'corpus_cs' THEN 'cs' WHEN 'corpus_tc' THEN 'tc' WHEN 'corpus_ta' THEN 'ta' WHEN 'corpus_doc' THEN 'doc' END, 'archivo') AS col, ruta, blob, bytes, 'md' AS formato, trim(titulo) AS titulo
       FROM x WHERE titulo IS NOT NULL AND regexp_matches(ruta, '\\.md$')"""
)
def base_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the inventory as entries, by their folder and first heading."""
    e = table(spark, sf_dir, "entrada").filter("titulo IS NOT NULL AND ruta LIKE '%.md'").select("ruta", "blob", "bytes", F.concat(F.lit("texto antes\n# "), F.trim("titulo"), F.lit("\n\ncuerpo")).alias("texto"))
    return anatomy.base_entry(e, _KINDS)


@CATALOGUE.query(
    """SELECT id, regexp_replace(regexp_replace(trim(rol), '(?i)^(rol\\s*)?(n[°º]\\s*)?', ''), '\\.', '', 'g') AS rol, CAST(nullif(regexp_extract(regexp_replace(rol, '\\.', '', 'g'), '-(\\d{4})$', 1), '') AS INTEGER) AS era, nullif(trim(materia, ' '), '-') AS recurso, 2 AS ministros
       FROM sentencias_judiciales WHERE rol IS NOT NULL AND regexp_matches(rol, '^[A-Z0-9.-]+$') AND regexp_matches(materia, '^[^*\\n\\r\\t· ]*[A-Za-z][^*\\n\\r\\t· ]*$')"""
)
def supreme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of rulings, written as files and read again as rows."""
    s = table(spark, sf_dir, "sentencias_judiciales").filter(F.col("rol").rlike(r"^[A-Z0-9.-]+$") & F.col("materia").rlike("^[^*\n\r\t· ]*[A-Za-z][^*\n\r\t· ]*$"))
    card = F.concat(F.lit("# Caso\n- **Tribunal:** CS · **Rol:** "), "rol", F.lit(" · **Era:** —\n- **Recurso:** "), "materia", F.lit("\n- **Ministros:** Ana Uno, Luis Dos\n---\npie"))
    return s.select("id", anatomy.supreme_row(card).alias("r")).select("id", "r.rol", "r.era", "r.recurso", F.size("r.ministros").alias("ministros"))


@CATALOGUE.query(
    """SELECT n, CASE n % 4 WHEN 1 THEN n + 1 ELSE n END AS rol, CASE n % 4 WHEN 0 THEN 'documento_nombrado' WHEN 1 THEN 'rol_propio' WHEN 2 THEN 'documento' ELSE 'encabezado' END AS fuente, n % 4 = 1 AS desalineada
       FROM entrada WHERE n >= 10"""
)
def constitutional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose number stands in the document, in the body, in the link or in the header only."""
    n = F.col("n").cast("string")
    link = F.when(F.col("n") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("- **Documento oficial:** https://x.y/ver.php?id="), n, F.lit("\n")))
    body = F.when(F.col("n") % 4 == 0, F.concat(F.lit("Vistos, sobre el documento "), n)).when(F.col("n") % 4 == 1, F.concat(F.lit("En la causa Rol N° "), (F.col("n") + 1).cast("string"), F.lit(" se ve"))).otherwise("sin número")
    text = F.concat(F.lit("# T\n- **Rol:** "), n, F.lit(" · **Fecha:** 2020-01-02\n"), link, F.lit("\n---\n"), body)
    return table(spark, sf_dir, "entrada").filter("n >= 10").select("n", anatomy.constitutional_row(text).alias("r")).select("n", "r.rol", "r.fuente", "r.desalineada")


@CATALOGUE.query(
    """SELECT n, (n % 3 + 1) || 'ta' AS tribunal, 'r-' || (n % 900 + 1) || '-2020' AS rol, 's-' || (n % 70 + 1) || '-2021' AS acumulados, n % 5 = 0 AS sintesis, n % 2 = 0 AS tiene_texto FROM entrada"""
)
def environmental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of environmental rulings with roles in the card and in the name."""
    n = F.col("n")
    ordinal = F.when(n % 3 == 0, "Primer").when(n % 3 == 1, "Segundo").otherwise("Tercer")
    path = F.concat(F.lit("ta/"), F.when(n % 5 == 0, "sintesis-").otherwise("fallo-"), F.lit("S-"), (n % 70 + 1).cast("string"), F.lit("-2021.md"))
    text = F.concat(F.lit("- **Tribunal:** "), ordinal, F.lit(" Tribunal Ambiental\n- **Rol:** R-"), (n % 900 + 1).cast("string"), F.lit("-2020 · **Fecha:** 03/05/2021\n---\n"), F.when(n % 2 == 0, F.repeat(F.lit("texto "), 400)).otherwise("breve"))
    return table(spark, sf_dir, "entrada").select("n", anatomy.environmental_row(path, text).alias("r")).select("n", "r.tribunal", "r.rol", F.array_join("r.acumulados", ",").alias("acumulados"), "r.sintesis", "r.tiene_texto")


@CATALOGUE.query(
    f"""WITH x AS (SELECT cuerpo_legal, 'norma:' || trim(regexp_replace({fold_sql("cuerpo_legal")}, '[^a-z0-9]+', '-', 'g'), '-') AS padre, unnest(regexp_extract_all(texto, '(?im)^\\s*art(?:[íi]culo|\\.)\\s+(\\d{{1,4}}(?:\\s+(?:bis|ter|qu[áa]ter))?)\\b', 1)) AS n FROM articulos_vectorial),
        y AS (SELECT padre, cuerpo_legal, regexp_replace(trim(regexp_replace({fold_sql("n")}, '\\s+', ' ', 'g')), ' ', '-') AS n FROM x)
        SELECT padre || ':' || n AS nodo, padre, min('Artículo ' || replace(n, '-', ' ') || ' · ' || cuerpo_legal) AS etiqueta FROM y WHERE padre IS NOT NULL GROUP BY 1, 2"""
)
def article_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article nodes of the bodies of law, by the headings in their texts."""
    return anatomy.article_nodes(table(spark, sf_dir, "articulos_vectorial").filter("cuerpo_legal IS NOT NULL"), "id", "cuerpo_legal", "texto").filter("nodo IS NOT NULL")


@CATALOGUE.query(
    r"""WITH x AS (SELECT id, 'El ' || (id % 28 + 1) || ' de mayo de 2020 pagó $' || (id % 900 + 100) || '.000 a 12.345.' || (100 + id % 900) || '-K, y luego UF 12,5.' || chr(10) || coalesce(doctrina, '') || chr(10) || 'breve 01/02/2020' AS t FROM sentencias_judiciales)
        SELECT id, CAST(len(list_distinct(regexp_extract_all(t, '\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b|\b\d{1,2} de [a-záéíóú]+ de \d{4}\b'))) AS INTEGER) AS fechas, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\$ ?\d{1,3}(?:\.\d{3})*|\b\d{1,3}(?:\.\d{3})+ pesos\b|\bUF ?\d+(?:[.,]\d+)*'))), '|') AS montos,
               regexp_extract(t, '12\.345\.\d{3}-K') AS rut, 1 AS hechos FROM x"""
)
def case_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, amounts, tax numbers and dated facts of rulings."""
    i = F.col("id")
    text = F.concat(F.lit("El "), (i % 28 + 1).cast("string"), F.lit(" de mayo de 2020 pagó $"), (i % 900 + 100).cast("string"), F.lit(".000 a 12.345."), (100 + i % 900).cast("string"), F.lit("-K, y luego UF 12,5.\n"), F.coalesce("doctrina", F.lit("")), F.lit("\nbreve 01/02/2020"))
    e = table(spark, sf_dir, "sentencias_judiciales").select("id", anatomy.case_entities(text).alias("e"))
    return e.select("id", F.size("e.fechas").alias("fechas"), F.array_join(F.array_sort("e.montos"), "|").alias("montos"), F.get("e.rut", F.lit(0)).alias("rut"), F.size("e.hechos").alias("hechos"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
