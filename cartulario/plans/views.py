"""Queries on views and upkeep of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions.ids import id_kind
from cartulario.functions.text import fold
from cartulario.operators import graph, views
from cartulario.plans.base import Catalogue
from cartulario.plans.graph import _BOTH, _CORPUS, _EDGES, citation_edges, corpus_edges
from cartulario.plans.scalar import fold_sql
from cartulario.session import materialize, table

CATALOGUE = Catalogue()
_NODES = "nn AS (SELECT DISTINCT nodo, split_part(nodo, ':', 1) AS tipo FROM (SELECT src AS nodo FROM cx UNION ALL SELECT dst FROM cx))"


def _nodes(edges: DataFrame) -> DataFrame:
    n = edges.select(F.explode(F.array("src", "dst")).alias("nodo")).distinct()
    return n.select("nodo", F.col("nodo").alias("etiqueta"), id_kind(F.col("nodo")).alias("tipo"))


_WANTED = ["cs:1-2025", "norma:cpr:19", "tc:11", "nada:1"]


@CATALOGUE.query(
    f"""WITH {_BOTH}, {_NODES}, w AS (SELECT unnest({_WANTED}) AS nodo), v AS (SELECT w.nodo, cu.b AS v, split_part(cu.b, ':', 1) AS tipo FROM w JOIN cu ON cu.a = w.nodo),
        r AS (SELECT *, row_number() OVER (PARTITION BY nodo, tipo ORDER BY v) AS k, count(*) OVER (PARTITION BY nodo, tipo) AS c FROM v),
        l AS (SELECT nodo, tipo, c, tipo || ' (' || c || '): ' || string_agg(v, ', ' ORDER BY k) FILTER (k <= 12) AS linea FROM r GROUP BY nodo, tipo, c),
        f AS (SELECT nodo, CAST(sum(c) AS BIGINT) AS grado, string_agg(linea, chr(10) ORDER BY tipo) AS ficha FROM l GROUP BY nodo)
        SELECT w.nodo, nn.nodo AS etiqueta, coalesce(grado, 0) AS grado, coalesce(ficha, '') AS ficha FROM w LEFT JOIN nn ON nn.nodo = w.nodo LEFT JOIN f ON f.nodo = w.nodo"""
)
def node_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of three nodes and of one that there is not."""
    e = materialize(corpus_edges(spark, sf_dir))
    return views.node_cards(e, _nodes(e), spark.createDataFrame([(w,) for w in _WANTED], "nodo string"))


@CATALOGUE.query(
    f"""WITH {_EDGES}, x AS (SELECT src AS nodo FROM e UNION ALL SELECT dst FROM e), k AS (SELECT nodo, count(*) AS g FROM x GROUP BY nodo ORDER BY g DESC, nodo LIMIT 250)
        SELECT src, dst, rel, peso FROM e WHERE src IN (SELECT nodo FROM k) AND dst IN (SELECT nodo FROM k)"""
)
def top_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among the 250 nodes of most edges."""
    e = citation_edges(spark, sf_dir)
    return views.top_cut(e, graph.degrees(e).select("nodo", F.col("grado").alias("puntaje")), 250)[1].select("src", "dst", "rel", "peso")


@CATALOGUE.query(
    f"""WITH {_EDGES}, g AS (SELECT nodo, count(*) AS grado FROM (SELECT src AS nodo FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), l AS (SELECT nodo, nodo % 40 AS comunidad, grado, CASE nodo % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS tipo FROM g),
        s AS (SELECT comunidad, count(*) AS nodos FROM l GROUP BY 1 ORDER BY nodos DESC, comunidad LIMIT 12), t AS (SELECT comunidad, tipo FROM (SELECT comunidad, tipo, count(*) AS c FROM l WHERE tipo IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY comunidad ORDER BY c DESC, tipo) = 1),
        r AS (SELECT comunidad, nodo, row_number() OVER (PARTITION BY comunidad ORDER BY grado DESC, nodo) AS k FROM l)
        SELECT s.comunidad, nodos, tipo, (SELECT string_agg(nodo, ',' ORDER BY k) FROM r WHERE r.comunidad = s.comunidad AND k <= 4) AS representantes FROM s LEFT JOIN t ON t.comunidad = s.comunidad"""
)
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve largest of forty groups of nodes, with their kind and their first four nodes."""
    g = graph.degrees(citation_edges(spark, sf_dir)).select("nodo", "grado")
    labels = g.select("nodo", (F.col("nodo") % 40).alias("comunidad"))
    kinds = g.select("nodo", F.when(F.col("nodo") % 3 == 0, "a").when(F.col("nodo") % 3 == 1, "b").alias("tipo"))
    return views.community_summary(labels, g, kinds, 12, 4).withColumn("representantes", F.array_join(F.col("representantes").cast("array<string>"), ","))


@CATALOGUE.query(
    f"""WITH {_EDGES}, n AS (SELECT DISTINCT src AS nodo FROM e WHERE src % 5 = 0), l AS (SELECT DISTINCT dst AS nodo, dst % 7 AS comunidad FROM e WHERE dst % 3 <> 0),
        v AS (SELECT n.nodo, comunidad, sum(peso) AS w FROM n JOIN e ON e.src = n.nodo JOIN l ON l.nodo = e.dst GROUP BY 1, 2), b AS (SELECT nodo, comunidad FROM v QUALIFY row_number() OVER (PARTITION BY nodo ORDER BY w DESC, comunidad) = 1)
        SELECT n.nodo, coalesce(comunidad, n.nodo) AS comunidad FROM n LEFT JOIN b ON b.nodo = n.nodo"""
)
def voted_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of new entries by those of what they cite."""
    e = citation_edges(spark, sf_dir)
    labels = e.filter("dst % 3 <> 0").select(F.col("dst").alias("nodo")).distinct().withColumn("comunidad", F.col("nodo") % 7)
    return views.voted_community(e, labels, e.filter("src % 5 = 0").select(F.col("src").alias("nodo")))


@CATALOGUE.query(
    f"""WITH c AS (SELECT 's' || id AS nodo, trim(rol) AS r, split_part({fold_sql("caratula")}, ' ', 1) || ' ' || fecha AS t FROM sentencias_judiciales), k AS (SELECT id, trim(rol) AS r, split_part({fold_sql("titulo")}, ' ', 1) || ' ' || fecha AS t FROM entrada),
        f AS (SELECT DISTINCT nodo, id, 0 AS o, 'rol' AS regla FROM c JOIN k USING (r) WHERE r <> '' UNION SELECT DISTINCT nodo, id, 1, 'parte y fecha' FROM c JOIN k USING (t) WHERE t <> ''),
        b AS (SELECT * FROM f QUALIFY o = min(o) OVER (PARTITION BY nodo)) SELECT nodo, id, regla, CASE WHEN count(*) OVER (PARTITION BY nodo) = 1 THEN 'alias' ELSE 'puente' END AS como FROM b"""
)
def inferred_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings that are entries of the map by role, or else by party and date; several make bridges."""
    s = table(spark, sf_dir, "sentencias_judiciales").select(F.concat(F.lit("s"), "id").alias("nodo"), "rol", "caratula", "fecha")
    e = table(spark, sf_dir, "entrada").select("id", F.col("rol").alias("r"), "titulo", "fecha")
    first = lambda c: F.concat(F.substring_index(fold(c), " ", 1), F.lit(" "), "fecha")
    rules = [("rol", F.trim("rol"), F.trim("r")), ("parte y fecha", first("caratula"), first("titulo"))]
    alias, bridge = views.inferred_aliases(s, e, rules)
    return alias.withColumn("como", F.lit("alias")).unionByName(bridge.withColumn("como", F.lit("puente")))


@CATALOGUE.query(
    """WITH a AS (SELECT p_partkey AS clave, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS nombre, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS marca FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS clave, 'N' || p_partkey AS nombre, p_type AS marca FROM part WHERE p_partkey % 2 = 0)
       SELECT coalesce(a.clave, b.clave) AS clave, coalesce(CASE WHEN trim(a.nombre) <> '' THEN a.nombre END, b.nombre) AS nombre, coalesce(a.marca, b.marca) AS marca FROM a FULL JOIN b ON a.clave = b.clave"""
)
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose missing fields are filled from a second source."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    a = p.filter("p_partkey % 5 <> 0").select(k.alias("clave"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("nombre"), F.when(k % 4 != 0, F.col("p_brand")).alias("marca"))
    b = p.filter("p_partkey % 2 = 0").select(k.alias("clave"), F.concat(F.lit("N"), k).alias("nombre"), F.col("p_type").alias("marca"))
    return views.merged_nodes(a, b, "clave")


@CATALOGUE.query(
    f"""WITH {_CORPUS}, p AS (SELECT DISTINCT src, dst FROM cx), b AS (SELECT src AS nodo, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM p), t AS (SELECT nodo, string_agg('- ' || dst, chr(10) ORDER BY k) AS bloque FROM b WHERE k <= 5 GROUP BY nodo)
        SELECT nodo, bloque, sha256(bloque) AS huella, NOT starts_with(nodo, 'tc:') AS cambia FROM t"""
)
def relation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"See also" blocks of all nodes; those of one collection were there before."""
    e = materialize(corpus_edges(spark, sf_dir))
    none = spark.createDataFrame([], "nodo string, huella string")
    old = views.relation_blocks(e.filter("src LIKE 'tc:%'"), _nodes(e), none, 5).select("nodo", "huella")
    return views.relation_blocks(e, _nodes(e), old, 5)


@CATALOGUE.query(
    f"""WITH {_CORPUS}, d AS (SELECT DISTINCT src, dst, rel FROM cx), k AS (SELECT nodo, row_number() OVER (ORDER BY dist, nodo) - 1 AS k FROM (SELECT 'tc:11' AS nodo, 0 AS dist UNION SELECT dst, 1 FROM d WHERE src = 'tc:11' AND dst <> 'tc:11') ORDER BY dist, nodo LIMIT 20),
        b AS (SELECT string_agg('  n' || k || '["' || CASE WHEN length(nodo) > 40 THEN nodo[1:39] || '…' ELSE nodo END || '"]', chr(10) ORDER BY k) AS t FROM k),
        a AS (SELECT string_agg('  n' || x.k || ' -->|' || rel || '| n' || y.k, chr(10) ORDER BY x.k, y.k, rel) AS t FROM d JOIN k x ON x.nodo = d.src JOIN k y ON y.nodo = d.dst)
        SELECT concat_ws(chr(10), 'graph LR', b.t, a.t) AS diagrama FROM a, b"""
)
def mermaid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagram of a ruling and what it cites."""
    e = materialize(corpus_edges(spark, sf_dir))
    near = e.filter("src = 'tc:11' AND dst <> 'tc:11'").select(F.col("dst").alias("nodo")).distinct().withColumn("distancia", F.lit(1))
    nodes = spark.createDataFrame([("tc:11", 0)], "nodo string, distancia int").unionByName(near).withColumn("etiqueta", F.col("nodo"))
    return views.mermaid(nodes, e, 20)


@CATALOGUE.query(
    """SELECT doc_id, CASE WHEN n > 4000 THEN 'cortado' ELSE 'entero' END AS como FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '["\\\\\\x00-\\x1f\\x7f]')) WHERE n < 4000 OR n > 4100"""
)
def limited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON rows that fit a cap, the longer ones cut."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNull() | ~F.col("text").rlike(r"[\"\\\x00-\x1f\x7f]")).filter("coalesce(length(text), 0) < 4000 OR length(text) > 4100")
    rows = views.limited_rows(d.select("doc_id", "text"), 4080)
    return rows.select(F.get_json_object("salida", "$.doc_id").cast("long").alias("doc_id"), F.when(F.col("paso") == 0, "entero").otherwise("cortado").alias("como"))


@CATALOGUE.query(
    "SELECT lower(trim(col)) AS fuente, max(ingresado_en) AS ultimo, epoch_us(TIMESTAMP '2026-01-15 12:00:00') - epoch_us(max(ingresado_en)) < 90 * 24 * 60 * 60000000::BIGINT AS en_movimiento FROM entrada GROUP BY 1"
)
def moving_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections that changed within ninety days of a moment."""
    return views.moving_sources(table(spark, sf_dir, "entrada"), F.lower(F.trim("col")), "ingresado_en", F.lit("2026-01-15 12:00:00"), 90 * 24 * 60)


@CATALOGUE.query(
    """WITH s AS (SELECT n, blob, ingresado_en AS r FROM entrada WHERE n % 4 <> 0), v AS (SELECT n, CASE WHEN n % 3 = 0 THEN 'x' || blob ELSE blob END AS b FROM entrada WHERE n % 5 <> 0),
       j AS (SELECT coalesce(s.n, v.n) AS n, s.n AS sn, v.n AS vn, blob, b, r FROM s FULL JOIN v ON s.n = v.n),
       k AS (SELECT *, CASE WHEN sn IS NULL THEN 'nuevo' WHEN epoch_us(TIMESTAMP '2026-01-15 12:00:00') - epoch_us(r) < 1000 * 3600000000::BIGINT THEN 'vigente' WHEN vn IS NULL THEN 'inalcanzable' WHEN blob = b THEN 'igual' ELSE 'cambiado' END AS accion FROM j)
       SELECT n, CASE WHEN accion IN ('nuevo', 'cambiado') THEN b ELSE blob END AS blob, CASE WHEN accion IN ('nuevo', 'cambiado', 'igual') THEN TIMESTAMP '2026-01-15 12:00:00' ELSE r END AS revisado_en, accion FROM k"""
)
def revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies against what a source shows, those checked lately left alone."""
    e = table(spark, sf_dir, "entrada")
    state = e.filter("n % 4 <> 0").select("n", "blob", F.col("ingresado_en").alias("revisado_en"))
    seen = e.filter("n % 5 <> 0").select("n", F.when(F.col("n") % 3 == 0, F.concat(F.lit("x"), "blob")).otherwise(F.col("blob")).alias("blob"))
    out = views.revalidated(state, seen, "n", F.lit("2026-01-15 12:00:00"), 1000)
    return out.withColumn("revisado_en", F.col("revisado_en").cast("timestamp_ntz"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
