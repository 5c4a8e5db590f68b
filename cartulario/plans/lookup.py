"""Queries on resolution and lookup, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions.ids import id_kind, person_id
from cartulario.functions.segments import paragraphs
from cartulario.functions.text import slug
from cartulario.operators import graph, lookup
from cartulario.operators.heavy_keys import folded
from cartulario.operators.packed_values import unpack
from cartulario.plans.base import Catalogue
from cartulario.plans.graph import _EDGES, citation_edges
from cartulario.plans.records import PARAGRAPHS_SQL
from cartulario.plans.scalar import fold_sql
from cartulario.session import table

CATALOGUE = Catalogue()


@CATALOGUE.query(
    """WITH w AS (SELECT n, id || ':' || (n % 3) AS pedido FROM referencia WHERE id LIKE 'norma:%'),
       c AS (SELECT pedido, 0 AS nivel, pedido AS k FROM w UNION ALL SELECT pedido, 1, regexp_replace(pedido, ':[^:]*$', '') FROM w
             UNION ALL SELECT pedido, 2, regexp_replace(regexp_replace(pedido, ':[^:]*$', ''), ':[^:]*$', '') FROM w),
       h AS (SELECT pedido, nivel, k FROM c WHERE k IN (SELECT id FROM referencia) QUALIFY row_number() OVER (PARTITION BY pedido ORDER BY nivel) = 1)
       SELECT w.n, w.pedido, h.k AS resuelto, CAST(h.nivel AS INTEGER) AS nivel FROM w LEFT JOIN h ON h.pedido = w.pedido"""
)
def nearest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of norms resolved to the nearest identifier that is known."""
    ref = table(spark, sf_dir, "referencia")
    wanted = ref.filter("id LIKE 'norma:%'").select("n", F.concat("id", F.lit(":"), (F.col("n") % 3).cast("string")).alias("pedido"))
    return lookup.nearest_known(wanted, "pedido", ref, "id")


def _key_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({fold_sql(f'trim({text})')}, '^(articulos?|arts?\\.?)\\s*(n[°º]\\s*)?', ''), '[°º]|[.,;:\\s-]+$', '', 'g'), '\\s+', ' ', 'g'))"


_WANTED = ["Artículo 12.-", "528", "art. 802", "1958 bis", "19", "99999"]


@CATALOGUE.query(
    f"""WITH a AS (SELECT id, {_key_sql("articulo_id")} AS k, {fold_sql("texto")} AS t FROM articulos_vectorial), w AS (SELECT pedido, {_key_sql("pedido")} AS q FROM (SELECT unnest({_WANTED}) AS pedido)),
        g AS (SELECT pedido, id, CASE WHEN k = q THEN 4 WHEN starts_with(k, q || ' ') THEN 3 WHEN starts_with(k, q) THEN 2 WHEN contains(t, 'articulo ' || q) THEN 1 END AS grado FROM a, w)
        SELECT pedido, id, grado FROM g WHERE grado IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pedido ORDER BY grado DESC, id) = 1"""
)
def tiered_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles asked for by number in several ways of writing, by the best way that finds any."""
    return lookup.tiered_articles(table(spark, sf_dir, "articulos_vectorial"), "id", "articulo_id", "texto", _WANTED)


@CATALOGUE.query(
    """WITH f AS (SELECT id, rol, cosechado_en, CASE WHEN trim(sala) <> '' THEN sala END AS s FROM sentencias_judiciales WHERE rol IS NOT NULL),
       p AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY rol ORDER BY cosechado_en, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f)
       SELECT id, rol, coalesce(s, b) AS sala, CASE WHEN s IS NULL AND b IS NOT NULL THEN 'sala' ELSE '' END AS heredados FROM p"""
)
def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings whose missing room is known from an earlier harvest."""
    s = table(spark, sf_dir, "sentencias_judiciales").select("id", "rol", "sala", "cosechado_en").filter("rol IS NOT NULL")
    out = lookup.carried_forward(s, ["rol"], [F.col("cosechado_en"), F.col("id")], ["sala"])
    return out.select("id", "rol", "sala", F.array_join("heredados", ",").alias("heredados"))


@CATALOGUE.query(
    """WITH e AS (SELECT n, 1 AS paso, 0 AS peso FROM entrada WHERE id = 'cs:1126-2025'),
       u AS (SELECT n, paso, peso FROM e UNION ALL SELECT origen, 2, CAST(sum(n) AS BIGINT) FROM cita WHERE destino IN (SELECT n FROM referencia WHERE id = 'cs:1126-2025') GROUP BY origen),
       b AS (SELECT n, paso, peso FROM u QUALIFY row_number() OVER (PARTITION BY n ORDER BY paso, peso DESC) = 1)
       SELECT b.n, x.id, paso, CAST(peso AS BIGINT) AS peso FROM b JOIN entrada x ON x.n = b.n ORDER BY paso, peso DESC, x.id, b.n LIMIT 100"""
)
def orchestrated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ruling looked up by its role: itself, then who cites it."""
    e, r, c = (table(spark, sf_dir, t) for t in ("entrada", "referencia", "cita"))
    return lookup.orchestrated(e.select("n", "id", "titulo"), r, c.select("destino", "origen", "n"), "Rol N° 1.126-2025", 100)


@CATALOGUE.query(f"SELECT n, id, 3 AS paso, CAST(0 AS BIGINT) AS peso FROM entrada WHERE list_contains(regexp_extract_all({fold_sql('titulo')}, '[a-z0-9]+'), 'jorquiel') ORDER BY id, n LIMIT 500")
def orchestrated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for words of a title."""
    e, r, c = (table(spark, sf_dir, t) for t in ("entrada", "referencia", "cita"))
    return lookup.orchestrated(e.select("n", "id", "titulo"), r, c.select("destino", "origen", "n"), "Jorquiel", 500)


@CATALOGUE.query()
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three passages on notifications and costs in each document."""
    return lookup.passages(table(spark, sf_dir, "documents"), "doc_id", "text", ["notificación", "costas"], 120)


@CATALOGUE.query(
    f"""WITH {PARAGRAPHS_SQL}, f AS (SELECT id, orden, {fold_sql("parrafo")} AS t FROM pp),
        s AS (SELECT id, orden, (CAST(contains(t, 'nulidad') AS INT) + CAST(contains(t, 'contrato') AS INT)) * 15 + CAST(contains(t, 'nulidad del contrato') AS INT) * 60 + CAST(regexp_matches(t, 'resuelve|declara|confirmado') AS INT) * 20
                     + CAST(regexp_matches(t, '\\bart(?:iculo|\\.)\\s*\\d+') AS INT) * 15 AS puntaje FROM f)
        SELECT id, orden, puntaje FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY puntaje DESC, orden) = 1"""
)
def ranked_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph of each document that says most about nullity."""
    p = paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lookup.ranked_paragraphs(p, "id", "parrafo", "orden", ["nulidad", "contrato"], "nulidad del contrato", ["resuelve", "declara", "confirmado"])


@CATALOGUE.query(
    f"""WITH t AS (SELECT id, {fold_sql("doctrina")} AS x FROM sentencias_judiciales),
        h AS (SELECT id, x, list_transform(regexp_extract_all(x, '[a-z0-9]+'), lambda w: regexp_replace(w, '(es|s)$', '')) AS l FROM t WHERE x IS NOT NULL)
        SELECT id, CASE WHEN contains(x, 'nulidad de contratos') THEN 2 ELSE 1 END AS grado FROM h WHERE contains(x, 'nulidad de contratos') OR (list_contains(l, 'nulidad') AND list_contains(l, 'contrato'))"""
)
def stem_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings that hold a phrase or its words."""
    return lookup.stem_score(table(spark, sf_dir, "sentencias_judiciales"), "id", "doctrina", "nulidad de contratos")


@CATALOGUE.query(
    """WITH u AS (SELECT obra AS k, institucion AS v, 0 AS o, 'fichas' AS fuente FROM doctrina_instituciones UNION ALL SELECT caratula, materia, 1, 'fallos' FROM sentencias_judiciales),
       d AS (SELECT *, sha256(v) AS h FROM u WHERE k IS NOT NULL AND v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha256(v) ORDER BY o, k) = 1)
       SELECT k AS nombre_base, v, fuente, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY o, h) = 1 THEN k ELSE k || '-' || h[1:8] END AS nombre FROM d"""
)
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of two tables without repetitions, under names that differ."""
    a = table(spark, sf_dir, "doctrina_instituciones").select(F.col("obra").alias("nombre_base"), F.col("institucion").alias("v")).dropna()
    b = table(spark, sf_dir, "sentencias_judiciales").select(F.col("caratula").alias("nombre_base"), F.col("materia").alias("v")).dropna()
    return lookup.merged_sources({"fichas": a, "fallos": b}, "nombre_base", "v")


@CATALOGUE.query(
    """SELECT count(*) AS fichas, min(tokens_aprox) AS minimo, quantile_disc(tokens_aprox, 0.5) AS mediana, max(tokens_aprox) AS maximo, round(avg(tokens_aprox), 4) AS media,
              count(*) FILTER (tokens_aprox > 500) AS sobre_500, count(*) FILTER (tokens_aprox > 1000) AS sobre_1000 FROM doctrina_instituciones WHERE tokens_aprox > 0"""
)
def token_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of institution cards."""
    d = table(spark, sf_dir, "doctrina_instituciones").filter("tokens_aprox > 0")
    return d.agg(
        F.count(F.lit(1)).alias("fichas"), F.min("tokens_aprox").alias("minimo"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY tokens_aprox)").cast("long").alias("mediana"), F.max("tokens_aprox").alias("maximo"),
        F.round(F.avg("tokens_aprox"), 4).alias("media"), F.count_if(F.col("tokens_aprox") > 500).alias("sobre_500"), F.count_if(F.col("tokens_aprox") > 1000).alias("sobre_1000"),
    )


@CATALOGUE.query(
    f"""WITH {_EDGES}, p AS (SELECT DISTINCT src, dst FROM e)
        SELECT p.src AS nodo, split_part(r.id, ':', 1) AS tipo, count(*) AS vecinos FROM p JOIN referencia r ON 2 * r.n + 1 = p.dst GROUP BY 1, 2"""
)
def neighbour_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct neighbours of each entry by kind."""
    kinds = table(spark, sf_dir, "referencia").select((F.col("n") * 2 + 1).alias("dst"), id_kind(F.col("id")).alias("tipo"))
    e = citation_edges(spark, sf_dir).select("src", "dst").distinct().join(kinds, "dst")
    return e.groupBy(F.col("src").alias("nodo"), "tipo").agg(F.count(F.lit(1)).alias("vecinos"))


@CATALOGUE.query(
    """WITH t AS (SELECT area, obra, count(*) AS n FROM doctrina_instituciones GROUP BY 1, 2), a AS (SELECT area, sum(n) AS total FROM t GROUP BY 1),
       r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, obra) AS k FROM t)
       SELECT r.area, CAST(total AS BIGINT) AS total, string_agg(obra, '; ' ORDER BY k) AS obras FROM r JOIN a ON a.area IS NOT DISTINCT FROM r.area WHERE k <= 3 GROUP BY 1, 2"""
)
def area_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three works with most cards of each area."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "doctrina_instituciones").groupBy("area", "obra").agg(F.count(F.lit(1)).alias("n"))
    total = t.groupBy(F.col("area").alias("__a")).agg(F.sum("n").alias("total"))
    best = t.withColumn("k", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("n"), "obra"))).filter("k <= 3")
    lists = best.groupBy("area").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "obra"))), lambda x: x["obra"]), "; ").alias("obras"))
    return lists.join(total, F.col("area").eqNullSafe(F.col("__a"))).select("area", "total", "obras")


@CATALOGUE.query(
    f"""WITH n AS (SELECT id, 'obra:' || regexp_replace(regexp_replace({fold_sql("obra")}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS obra,
                     'autor:' || array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace({fold_sql("autor")}, '[^a-z0-9]+', '_', 'g'), '_'), lambda w: w <> ''))), '_') AS autor,
                     'inst:' || regexp_replace(regexp_replace({fold_sql("institucion")}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS inst, fallo_rector FROM doctrina_instituciones),
        e AS (SELECT inst AS src, obra AS dst, 'tratada_en' AS rel FROM n UNION ALL SELECT obra, autor, 'escrita_por' FROM n
              UNION ALL SELECT inst, 'cs:' || regexp_extract(fallo_rector, '^CS (\\d+-\\d+)$', 1), 'fallo_rector' FROM n WHERE regexp_matches(fallo_rector, '^CS \\d{{1,7}}-\\d{{4}}$'))
        SELECT src, dst, rel, count(*) AS peso FROM e WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3"""
)
def card_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of institution cards: institutions, works, authors and leading rulings."""
    from cartulario.functions.ids import supreme_id

    d = table(spark, sf_dir, "doctrina_instituciones")
    work, inst = F.concat(F.lit("obra:"), slug(F.col("obra"))), F.concat(F.lit("inst:"), slug(F.col("institucion")))
    ends = F.array(
        F.struct(inst.alias("src"), work.alias("dst"), F.lit("tratada_en").alias("rel")),
        F.struct(work.alias("src"), person_id(F.col("autor")).alias("dst"), F.lit("escrita_por").alias("rel")),
        F.struct(inst.alias("src"), supreme_id(F.col("fallo_rector")).alias("dst"), F.lit("fallo_rector").alias("rel")),
    )
    return graph.accumulated(d.select(F.inline(ends), F.lit(1).cast("long").alias("peso")))


@CATALOGUE.query()
def norm_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings to the norms that are packed in them, and parts of norms to the whole."""
    from cartulario.functions.ids import norm_id, parent_id

    values = unpack(table(spark, sf_dir, "sentencias_judiciales"), "id", "normas").select(F.concat(F.lit("fallo:"), F.col("id")).alias("src"), norm_id(F.col("valor")).alias("dst"))
    cites = values.select("src", "dst", F.lit("cita_norma").alias("rel"))
    parts = values.select(F.col("dst").alias("src"), parent_id(F.col("dst")).alias("dst"), F.lit("parte_de").alias("rel")).distinct()
    return graph.accumulated(cites.unionByName(parts).withColumn("peso", F.lit(1).cast("long")))


@CATALOGUE.query(
    """WITH c AS (SELECT lower(trim(col)) AS col, n, ingresado_en, row_number() OVER (PARTITION BY id ORDER BY ingresado_en DESC, n DESC) AS k FROM entrada)
       SELECT col, count(*) FILTER (k = 1) AS vigentes, count(*) FILTER (k > 1) AS reemplazadas, max(ingresado_en) AS ultima FROM c GROUP BY col"""
)
def freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in force and replaced ones by collection, with the last arrival."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "entrada").select(folded("col").alias("col"), "id", "n", "ingresado_en")
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ingresado_en"), F.desc("n")))
    return e.withColumn("k", k).groupBy("col").agg(F.count_if(F.col("k") == 1).alias("vigentes"), F.count_if(F.col("k") > 1).alias("reemplazadas"), F.max("ingresado_en").alias("ultima"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
