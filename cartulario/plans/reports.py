"""Queries on reports, choices and identities of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions.fields import norm_label
from cartulario.functions.text import fold, tokens
from cartulario.operators import reports as ops
from cartulario.operators.search import bm25
from cartulario.plans.base import Catalogue
from cartulario.plans.scalar import fold_sql
from cartulario.session import table

CATALOGUE = Catalogue()


@CATALOGUE.query(
    """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, (o_orderpriority = '1-URGENT') DESC, o_totalprice DESC, o_orderkey) AS k FROM orders)
       WHERE k = 1 ORDER BY (o_orderstatus = 'F') DESC, (o_orderpriority = '1-URGENT') DESC, o_totalprice DESC, o_orderkey LIMIT 25"""
)
def distinct_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five orders of different customers, the finished, urgent and dear ones first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    order = [F.desc(F.col("o_orderstatus") == "F"), F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return ops.distinct_sample(o, "o_custkey", order, 25).select("o_orderkey", "o_custkey")


@CATALOGUE.query(
    "SELECT n, id FROM (SELECT n, id, row_number() OVER (PARTITION BY id ORDER BY ingresado_en DESC, n DESC) AS k FROM entrada) WHERE k <= 1 OR n IN (SELECT origen FROM cita WHERE n > 2)"
)
def pruned_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivery of each entry, and those that are still cited from."""
    e = table(spark, sf_dir, "entrada").select("n", "id", "ingresado_en")
    used = table(spark, sf_dir, "cita").filter("n > 2 AND origen IS NOT NULL").select(F.col("origen").alias("n"))
    return ops.pruned_revisions(e, "id", [F.desc("ingresado_en"), F.desc("n")], 1, "n", used).select("n", "id")


@CATALOGUE.query(
    """WITH x AS (SELECT n, id, ruta || '/' || n || '.md' AS p, n % 3 = 0 AS s FROM entrada), a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, p) AS k FROM x),
       b AS (SELECT *, CASE WHEN k = 1 THEN id WHEN s THEN id || ':sintesis' ELSE id || ':' || n END AS m FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY k, p) AS j FROM b)
       SELECT n, CASE WHEN j > 1 THEN m || '-' || j ELSE m END AS id_unico, CASE WHEN k > 1 THEN id END AS id_base FROM c"""
)
def resolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one id told apart, syntheses last."""
    e = table(spark, sf_dir, "entrada").select("n", "id", F.concat("ruta", F.lit("/"), "n", F.lit(".md")).alias("p"))
    return ops.resolved_ids(e, "id", "p", F.col("n") % 3 == 0).select("n", "id_unico", "id_base")


@CATALOGUE.query(
    """WITH x AS (SELECT o_custkey, year(o_orderdate) * 1000 + dayofyear(o_orderdate) AS y, o_orderkey % 4 AS d, o_orderkey % 3 AS v FROM orders), w AS (SELECT *, lag(d) OVER (PARTITION BY o_custkey ORDER BY y, d, v) AS a FROM x)
       SELECT o_custkey, count(*) AS titulos, count(*) FILTER (a IS NOT NULL AND v <> a) AS quiebres, 1998000 - min(y) >= 4000 AS cubre FROM w GROUP BY 1"""
)
def chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a customer's orders: breaks between one and the next, and how far back they go."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") * 1000 + F.dayofyear("o_orderdate")).alias("y"), (F.col("o_orderkey") % 4).alias("d"), (F.col("o_orderkey") % 3).alias("v"))
    return ops.chain_audit(o, "o_custkey", "y", "d", "v", 1998000, 4000)


@CATALOGUE.query(
    f"""WITH a AS (SELECT id, 0 AS f, n AS l FROM entrada WHERE contains({fold_sql("titulo")}, 'jorquiel')), b AS (SELECT r.id, 1, min(c.origen) FROM cita c JOIN referencia r ON r.n = c.destino WHERE r.id LIKE 'cs:%' GROUP BY 1),
        c AS (SELECT id, 2, n FROM entrada WHERE ruta LIKE '%/2024/%'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
        SELECT id, CAST(f AS INTEGER) AS fuente, l AS lugar FROM u WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, l) = 1 ORDER BY f, l, id LIMIT 150"""
)
def ordered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by title, then by citation, then by path, each once."""
    e = table(spark, sf_dir, "entrada")
    titled = e.filter(F.contains(fold(F.col("titulo")), F.lit("jorquiel"))).select("id", F.col("n").alias("lugar"))
    r = table(spark, sf_dir, "referencia").filter("id LIKE 'cs:%'").select("id", F.col("n").alias("destino"))
    cited = table(spark, sf_dir, "cita").select("destino", "origen").join(r, "destino").groupBy("id").agg(F.min("origen").alias("lugar")).filter("lugar IS NOT NULL")
    return ops.ordered_candidates([titled, cited, e.filter("ruta LIKE '%/2024/%'").select("id", F.col("n").alias("lugar"))], "id", 150)


_SIGNALS = {"laboral": ("despido", "trabajo", "sindicato"), "civil": ("contrato", "arriendo", "dano"), "penal": ("delito", "hurto", "imputado")}


def _signals_sql() -> str:
    counts = ", ".join(f"{' + '.join(f'CAST(contains(t, {w!r}) AS INT)' for w in words)} AS s{i}" for i, words in enumerate(_SIGNALS.values()))
    names = list(_SIGNALS)
    return f"""WITH x AS (SELECT doc_id, coalesce({fold_sql("text")}, '') AS t FROM documents), y AS (SELECT doc_id, {counts} FROM x), z AS (SELECT *, greatest(s0, s1, s2) AS m FROM y)
        SELECT doc_id, CASE WHEN m = 0 THEN NULL WHEN s0 = m THEN '{names[0]}' WHEN s1 = m THEN '{names[1]}' ELSE '{names[2]}' END AS materia, m AS senales,
               CASE WHEN m = 0 THEN 'sin señales' WHEN CAST(s0 = m AS INT) + CAST(s1 = m AS INT) + CAST(s2 = m AS INT) > 1 THEN 'empate' WHEN m = 1 THEN 'una sola señal' END AS aviso FROM z"""


@CATALOGUE.query(_signals_sql())
def elected_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject of each document by its signals, with a warning where they are weak."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(fold(F.col("text")), F.lit("")).alias("t"))
    signals = {m: sum((F.contains("t", F.lit(w)).cast("int") for w in words), F.lit(0)) for m, words in _SIGNALS.items()}
    return ops.elected(d, "doc_id", signals)


_QUESTIONS = ["vicio redhibitorio contenido", "proporcionalidad stricto sensu", "zzzz", "responsabilidad del estado"]


@CATALOGUE.query(
    f"""WITH q AS (SELECT unnest({_QUESTIONS}) AS pregunta), k AS (SELECT id, list_distinct(regexp_extract_all({fold_sql("institucion")}, '[a-z0-9]+')) AS w FROM doctrina_instituciones), s AS (SELECT pregunta, id, len(list_intersect(w, string_split(pregunta, ' '))) AS c FROM q, k)
        SELECT pregunta, id, CAST(c AS BIGINT) AS comunes FROM s WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY pregunta ORDER BY c DESC, id) = 1"""
)
def question_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card that shares most words with each of four questions."""
    known = table(spark, sf_dir, "doctrina_instituciones").select("id", tokens(F.col("institucion")).alias("w"))
    return ops.best_overlap(spark.createDataFrame([(q,) for q in _QUESTIONS], "q string"), "q", known, "id", "w")


@CATALOGUE.query(
    """WITH x AS (SELECT c.origen, r.id, sum(c.n) AS p FROM cita c JOIN referencia r ON r.n = c.destino WHERE r.id LIKE 'norma:%' AND c.origen IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY origen ORDER BY p DESC, id) AS k FROM x)
       SELECT origen, string_agg(CASE WHEN id = 'norma:cpr' THEN 'Constitución Política de la República' ELSE id END, '; ' ORDER BY k) AS etiquetas FROM k WHERE k <= 8 GROUP BY 1"""
)
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight norms that each entry cites most, the constitution written out."""
    r = table(spark, sf_dir, "referencia").filter("id LIKE 'norma:%'").select("id", F.col("n").alias("destino"))
    c = table(spark, sf_dir, "cita").filter("origen IS NOT NULL").select("origen", "destino", "n").join(r, "destino").groupBy("origen", "id").agg(F.sum("n").alias("p"))
    return ops.top_labels(c, "origen", "id", "p", F.when(F.col("id") == "norma:cpr", norm_label(F.col("id"))).otherwise(F.col("id")), 8)


@CATALOGUE.query(
    """WITH u AS (SELECT trim(rol) AS rol, id AS archivo, 0 AS i, id AS o FROM sentencias_judiciales WHERE rol IS NOT NULL UNION ALL SELECT trim(rol), n, 1, n FROM entrada WHERE rol IS NOT NULL)
       SELECT rol, archivo FROM u QUALIFY row_number() OVER (PARTITION BY rol ORDER BY i DESC, o DESC) = 1"""
)
def last_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which record each role leads to, over two tables: the later table and row win."""
    s = table(spark, sf_dir, "sentencias_judiciales").filter("rol IS NOT NULL").select(F.trim("rol").alias("rol"), F.col("id").alias("archivo"))
    e = table(spark, sf_dir, "entrada").filter("rol IS NOT NULL").select(F.trim("rol").alias("rol"), F.col("n").alias("archivo"))
    return ops.last_written([s, e], "rol", "archivo")


@CATALOGUE.query(
    """WITH p AS (SELECT e.n, e.id, e.ruta, 'corpus_' || split_part(e.id, ':', 1) || '/' || split_part(e.rol, '-', 2) || '/' || split_part(e.rol, '-', 1) || '.md' AS esperada FROM entrada e WHERE e.rol IS NOT NULL AND e.id LIKE 'cs:%')
       SELECT p.n, esperada, count(i.n) AS archivos FROM p LEFT JOIN entrada i ON i.ruta = p.esperada GROUP BY 1, 2"""
)
def role_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path that a ruling's role leads to, and how many files of the inventory have it."""
    e = table(spark, sf_dir, "entrada")
    part = lambda c, i: F.get(F.split(c, "-"), F.lit(i))
    made = F.concat(F.lit("corpus_"), F.substring_index("id", ":", 1), F.lit("/"), F.coalesce(part("rol", 1), F.lit("")), F.lit("/"), part("rol", 0), F.lit(".md"))
    wanted = e.filter("rol IS NOT NULL AND id LIKE 'cs:%'").select("n", made.alias("esperada"))
    there = e.groupBy(F.col("ruta").alias("esperada")).agg(F.count("n").alias("archivos"))
    return wanted.join(there, "esperada", "left").select("n", "esperada", F.coalesce("archivos", F.lit(0).cast("long")).alias("archivos"))


_BM = ["nulidad", "contrato"]


@CATALOGUE.query(
    f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({fold_sql("text")}, '[a-z0-9]+'), []) AS t, lower(trim(source)) AS s, length(text) > 600 AS largo FROM documents),
        st AS (SELECT count(*) AS n, avg(len(t)) AS a, {", ".join(f"count(*) FILTER (list_contains(t, '{w}')) AS d{i}" for i, w in enumerate(_BM))} FROM d),
        x AS (SELECT doc_id, s, largo, {" + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * len(list_filter(t, lambda z: z = '{w}')) * 2.2 / (len(list_filter(t, lambda z: z = '{w}')) + 1.2 * (0.25 + 0.75 * len(t) / a))" for i, w in enumerate(_BM))} AS p FROM d, st)
        SELECT doc_id, largo, round(p, 6) AS puntaje FROM x WHERE p > 0 AND s IN ('dictamen', 'folleto', 'fallo') ORDER BY largo DESC, round(p, 9) DESC, doc_id LIMIT 40"""
)
def faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best documents of some sources for two words, those with a whole text first."""
    d = table(spark, sf_dir, "documents")
    hits = bm25(d, "doc_id", {"texto": F.col("text")}, {}, _BM).withColumnRenamed("doc", "doc_id")
    kept = d.filter(F.lower(F.trim("source")).isin("dictamen", "folleto", "fallo")).select("doc_id", (F.length("text") > 600).alias("largo"))
    return hits.join(kept, "doc_id").orderBy(F.desc("largo"), F.desc(F.round("puntaje", 9)), "doc_id").limit(40).select("doc_id", "largo", F.round("puntaje", 6).alias("puntaje"))


@CATALOGUE.query(
    """WITH a AS (SELECT id AS alias, regexp_replace(id, ':[^:]*$', '') AS destino FROM referencia WHERE id LIKE '%:%:%') SELECT r.n, coalesce(a.destino, r.id) AS id FROM referencia r LEFT JOIN a ON a.alias = r.id"""
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the dictionary with parts of norms replaced by the whole, by a table of aliases."""
    from cartulario.functions.ids import parent_id
    from cartulario.operators.relational import alias_resolved

    r = table(spark, sf_dir, "referencia").select("n", "id")
    aliases = r.select(F.col("id").alias("alias"), parent_id(F.col("id")).alias("destino")).filter("destino IS NOT NULL").distinct()
    return alias_resolved(r, "id", aliases, "alias", "destino").select("n", "id")


@CATALOGUE.query(
    """SELECT c_custkey, (floor(abs(c_acctbal)) + 0.5)::DOUBLE * sign(c_acctbal) AS monto FROM customer WHERE abs(c_acctbal) >= 1"""
)
def written_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written with dots and a comma, read again as numbers."""
    from cartulario.functions.ids import spanish_number

    whole = F.floor(F.abs("c_acctbal")).cast("string")
    text = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.regexp_replace(whole, r"(\d)(?=(?:\d{3})+$)", "$1."), F.lit(",5"))
    return table(spark, sf_dir, "customer").filter("abs(c_acctbal) >= 1").select("c_custkey", spanish_number(text).alias("monto"))


@CATALOGUE.query("SELECT s_suppkey, concat_ws(' ', s_suppkey, s_name, s_nationkey) AS texto FROM supplier")
def flattened_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of suppliers but one as a text."""
    from cartulario.functions.records import flattened

    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return s.select("s_suppkey", flattened(s, ("s_acctbal",)).alias("texto"))


@CATALOGUE.query(
    """SELECT id, numero, count(*) AS veces FROM (SELECT id, unnest(regexp_extract_all(texto, '(?im)^art(?:[íi]culo|\\.)\\s+(\\d+)', 1)) AS numero FROM articulos_vectorial) GROUP BY 1, 2"""
)
def article_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of laws cut at their article headings."""
    from cartulario.functions.segments import articles

    a = articles(table(spark, sf_dir, "articulos_vectorial"), "id", "texto")
    return a.groupBy("id", "numero").agg(F.count(F.lit(1)).alias("veces"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
