"""Queries on graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions.ids import parent_id
from cartulario.operators import graph as ops
from cartulario.operators.heavy_keys import folded
from cartulario.plans.base import Catalogue
from cartulario.session import materialize, table

CATALOGUE = Catalogue()
#: Who cites what: entries are even numbers, what is cited odd ones.
_EDGES = """e AS (SELECT 2 * origen AS src, 2 * destino + 1 AS dst, lower(regexp_replace(rel, '^\\s+|\\s+$', '', 'g')) AS rel, CAST(sum(n) AS BIGINT) AS peso
             FROM cita WHERE destino IS NOT NULL AND origen IS NOT NULL AND rel IS NOT NULL GROUP BY 1, 2, 3)"""
_WAYS = f"{_EDGES}, u AS (SELECT a, b, CAST(sum(peso) AS BIGINT) AS peso FROM (SELECT src AS a, dst AS b, peso FROM e UNION ALL SELECT dst, src, peso FROM e) GROUP BY 1, 2)"
#: The corpus as a graph of canonical ids: entries to what they cite, parts of norms to the whole.
_CORPUS = """cx AS (SELECT e.id AS src, r.id AS dst, lower(regexp_replace(c.rel, '^\\s+|\\s+$', '', 'g')) AS rel, CAST(sum(c.n) AS BIGINT) AS peso
               FROM cita c JOIN entrada e ON e.n = c.origen JOIN referencia r ON r.n = c.destino
               WHERE c.rel IS NOT NULL AND e.id IS NOT NULL AND r.id IS NOT NULL AND e.id <> r.id GROUP BY 1, 2, 3
               UNION ALL SELECT DISTINCT id, regexp_replace(id, ':[^:]*$', ''), 'parte_de', CAST(1 AS BIGINT) FROM referencia WHERE id LIKE '%:%:%')"""
_BOTH = f"{_CORPUS}, cu AS (SELECT a, b, CAST(sum(peso) AS BIGINT) AS peso FROM (SELECT src AS a, dst AS b, peso FROM cx UNION ALL SELECT dst, src, peso FROM cx) GROUP BY 1, 2)"


def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table of citations."""
    c = table(spark, sf_dir, "cita").filter("destino IS NOT NULL AND origen IS NOT NULL AND rel IS NOT NULL")
    e = c.select((F.col("origen") * 2).alias("src"), (F.col("destino") * 2 + 1).alias("dst"), folded("rel").alias("rel"), F.col("n").alias("peso"))
    return ops.accumulated(e)


def corpus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to what they cite, by canonical ids, and parts of norms to the whole."""
    e = table(spark, sf_dir, "entrada").select(F.col("n").alias("origen"), F.col("id").alias("src"))
    r = table(spark, sf_dir, "referencia").select(F.col("n").alias("destino"), F.col("id").alias("dst"))
    c = table(spark, sf_dir, "cita").filter("rel IS NOT NULL").select("origen", "destino", folded("rel").alias("rel"), F.col("n").alias("peso"))
    cited = ops.accumulated(c.join(e, "origen").join(r, "destino").select("src", "dst", "rel", "peso"))
    parts = r.select(F.col("dst").alias("src"), parent_id(F.col("dst")).alias("dst"), F.lit("parte_de").alias("rel"), F.lit(1).cast("long").alias("peso"))
    return cited.unionByName(parts.filter("dst IS NOT NULL").distinct())


@CATALOGUE.query(f"WITH {_EDGES} SELECT * FROM e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulated weighted edges."""
    return citation_edges(spark, sf_dir)


@CATALOGUE.query(
    f"""WITH {_EDGES}, x AS (SELECT src AS nodo, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e)
        SELECT nodo, CAST(sum(i) AS BIGINT) AS entrada, CAST(sum(o) AS BIGINT) AS salida, CAST(sum(i + o) AS BIGINT) AS grado FROM x GROUP BY nodo"""
)
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of all nodes."""
    return ops.degrees(citation_edges(spark, sf_dir))


@CATALOGUE.query(
    f"""WITH {_EDGES}, n AS (SELECT count(*) AS nodos FROM (SELECT src FROM e UNION SELECT dst FROM e)), m AS (SELECT count(*) AS aristas FROM (SELECT DISTINCT src, dst FROM e))
        SELECT nodos, aristas, round(aristas / (nodos * (nodos - 1)), 12) AS densidad FROM n, m"""
)
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges and density."""
    return ops.graph_totals(citation_edges(spark, sf_dir)).withColumn("densidad", F.round("densidad", 12))


@CATALOGUE.query(
    f"""WITH {_EDGES}, x AS (SELECT src AS nodo, rel, 'sale' AS sentido, dst AS vecino, peso FROM e UNION ALL SELECT dst, rel, 'entra', src, peso FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY nodo, rel, sentido ORDER BY peso DESC, vecino) AS k, count(*) OVER (PARTITION BY nodo, rel, sentido) AS total FROM x)
        SELECT nodo, rel, sentido, total, string_agg(vecino, ',' ORDER BY k) AS vecinos FROM r WHERE k <= 5 GROUP BY 1, 2, 3, 4"""
)
def neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five heaviest neighbours by relation and direction."""
    return ops.neighbour_lists(citation_edges(spark, sf_dir), 5).withColumn("vecinos", F.array_join(F.col("vecinos").cast("array<string>"), ","))


@CATALOGUE.query(
    f"""WITH {_WAYS}, k AS (SELECT a, b FROM u QUALIFY row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) <= 30),
        one AS (SELECT DISTINCT b AS nodo FROM k WHERE a IN (7, 9, 11)), two AS (SELECT DISTINCT b AS nodo FROM k WHERE a IN (FROM one)),
        three AS (SELECT DISTINCT b AS nodo FROM k WHERE a IN (FROM two)),
        x AS (SELECT unnest([7, 9, 11]) AS nodo, 0 AS distancia UNION ALL SELECT nodo, 1 FROM one UNION ALL SELECT nodo, 2 FROM two UNION ALL SELECT nodo, 3 FROM three)
        SELECT nodo, min(distancia) AS distancia FROM x GROUP BY nodo"""
)
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is within three steps of three cited norms, thirty neighbours a node."""
    seeds = spark.createDataFrame([(7,), (9,), (11,)], "nodo long")
    return ops.ego(citation_edges(spark, sf_dir), seeds, 3, 30)


_TARGETS = ("norma:cpr:19", "norma:codigo-civil", "norma:codigo-trabajo", "cs:1-2025", "cs:6-2021", "tc:11", "nada:0")


@CATALOGUE.query(
    f"""WITH {_CORPUS}, d AS (SELECT DISTINCT src, dst FROM cx), w AS (SELECT unnest({list(_TARGETS)}) AS nodo),
        p AS (SELECT w.nodo, d.src AS mid FROM w JOIN d ON d.dst = w.nodo),
        m AS (SELECT * FROM p UNION ALL SELECT w.nodo, d.dst FROM w JOIN d ON d.src = w.nodo WHERE w.nodo NOT IN (SELECT nodo FROM p)),
        f AS (SELECT DISTINCT m.nodo, d.dst AS far FROM m JOIN d ON d.src = m.mid WHERE d.dst <> m.nodo),
        k AS (SELECT nodo, (SELECT count(*) FROM m WHERE m.nodo = w.nodo) AS directos,
                     (SELECT count(*) FROM f WHERE f.nodo = w.nodo AND NOT EXISTS (SELECT 1 FROM m WHERE m.nodo = f.nodo AND m.mid = f.far)) AS cascada FROM w)
        SELECT nodo, directos, cascada, CASE WHEN directos + cascada >= 8 THEN 'ALTO' WHEN directos + cascada >= 3 THEN 'MEDIO' ELSE 'BAJO' END AS nivel FROM k"""
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes of three norms and three rulings touch."""
    return ops.blast_radius(corpus_edges(spark, sf_dir), spark.createDataFrame([(t,) for t in _TARGETS], "nodo string"))


def _levels_sql(seed: str, hops: int) -> str:
    steps = [f"WITH {_BOTH}, l0 AS (SELECT '{seed}' AS nodo, CAST(NULL AS VARCHAR) AS previo)"]
    seen = "SELECT nodo FROM l0"
    for i in range(1, hops + 1):
        steps.append(f"l{i} AS (SELECT b AS nodo, min(a) AS previo FROM cu WHERE a IN (SELECT nodo FROM l{i - 1}) AND b NOT IN ({seen}) GROUP BY b)")
        seen += f" UNION ALL SELECT nodo FROM l{i}"
    return ", ".join(steps)


@CATALOGUE.query(_levels_sql("norma:cpr:19", 9) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT nodo, {i} AS distancia, previo FROM l{i}" for i in range(10)) + ")")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from a norm, with the way back."""
    return ops.distances(corpus_edges(spark, sf_dir), "norma:cpr:19")


_PATHS = [("cs:1-2025", "cs:6-2021"), ("norma:cpr:19", "norma:codigo-trabajo"), ("cs:7-2024", "norma:cpr")]


def _paths_sql() -> str:
    """Paths of up to six steps that grow as in the operator: of each node the first three stay."""
    parts = []
    for k, (a, b) in enumerate(_PATHS):
        steps = [f"p{k}_0 AS (SELECT '{a}' AS nodo, ['{a}'] AS camino)"]
        seen = f"SELECT nodo FROM p{k}_0"
        for i in range(1, 7):
            steps.append(f"""p{k}_{i} AS (SELECT cu.b AS nodo, list_append(p.camino, cu.b) AS camino FROM p{k}_{i - 1} p JOIN cu ON cu.a = p.nodo
                WHERE cu.b NOT IN ({seen}) AND NOT EXISTS (SELECT 1 FROM p{k}_{i - 1} q WHERE q.nodo = '{b}')
                QUALIFY row_number() OVER (PARTITION BY cu.b ORDER BY list_append(p.camino, cu.b)) <= 3)""")
            seen += f" UNION ALL SELECT nodo FROM p{k}_{i}"
        found = " UNION ALL ".join(f"SELECT camino FROM p{k}_{i} WHERE nodo = '{b}'" for i in range(1, 7))
        steps.append(f"f{k} AS (SELECT '{a} > {b}' AS entre, camino, CAST(row_number() OVER (ORDER BY camino) AS INTEGER) AS orden FROM ({found}))")
        parts.append(", ".join(steps))
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(len(_PATHS)))
    return f"""WITH {_BOTH}, {", ".join(parts)}, z AS ({every}), s AS (SELECT entre, orden, camino, unnest(range(1, len(camino))) AS i FROM z),
        t AS (SELECT entre, orden, i, coalesce((SELECT min(rel) FROM cx WHERE src = camino[i] AND dst = camino[i + 1]),
              (SELECT 'es_' || min(rel) || '_de' FROM cx WHERE src = camino[i + 1] AND dst = camino[i])) AS r FROM s)
        SELECT z.entre, z.orden, array_to_string(camino, ' > ') AS camino, (SELECT string_agg(r, ',' ORDER BY i) FROM t WHERE t.entre = z.entre AND t.orden = z.orden) AS relaciones FROM z"""


@CATALOGUE.query(_paths_sql())
def all_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three shortest ways between three pairs of nodes, with what each step says."""
    edges = materialize(corpus_edges(spark, sf_dir))
    parts = [ops.all_shortest_paths(edges, a, b).select(F.lit(f"{a} > {b}").alias("entre"), "orden", F.array_join("camino", " > ").alias("camino"), F.array_join("relaciones", ",").alias("relaciones")) for a, b in _PATHS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _rank_sql(rounds: int, restart: str, before: str, ways: str) -> str:
    steps = [f"""WITH {before}, l AS (SELECT src, dst, CAST(sum(peso) AS DOUBLE) AS p FROM {ways} GROUP BY 1, 2), o AS (SELECT src, sum(p) AS s FROM l GROUP BY 1),
        v AS (SELECT src AS nodo FROM l UNION SELECT dst FROM l), z AS (SELECT count(*) AS n FROM v), b AS (SELECT nodo, {restart} AS r FROM v, z), k0 AS (SELECT nodo, r AS x FROM b)"""]
    for i in range(rounds):
        steps.append(f"""m{i} AS (SELECT coalesce(sum(x), 0) AS loose FROM k{i} WHERE nodo NOT IN (SELECT src FROM o)),
        c{i} AS (SELECT l.dst, sum(x * p / s) AS y FROM l JOIN o USING (src) JOIN k{i} ON k{i}.nodo = l.src GROUP BY 1),
        k{i + 1} AS (SELECT b.nodo, 0.15 * r + 0.85 * (coalesce(y, 0) + loose * r) AS x FROM b LEFT JOIN c{i} ON c{i}.dst = b.nodo, m{i})""")
    return ", ".join(steps) + f" SELECT nodo, round(x, 10) AS puntaje FROM k{rounds}"


@CATALOGUE.query(_rank_sql(8, "1.0::DOUBLE / n", _CORPUS, "cx"))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of the corpus, eight rounds (as many as the SQL; the operator itself stops by a tolerance)."""
    return ops.pagerank(corpus_edges(spark, sf_dir), 8, cut=4, tolerance=None).withColumn("puntaje", F.round("puntaje", 10))


@CATALOGUE.query(
    _rank_sql(
        6, "CASE WHEN nodo IN ('cs:6-2021', 'tc:11') THEN 1.0::DOUBLE / (SELECT count(*) FROM v WHERE nodo IN ('cs:6-2021', 'tc:11')) ELSE 0 END",
        _BOTH + """, r1 AS (SELECT unnest(['cs:6-2021', 'tc:11']) AS nodo UNION SELECT b FROM cu WHERE a IN ('cs:6-2021', 'tc:11')), r2 AS (SELECT nodo FROM r1 UNION SELECT b FROM cu WHERE a IN (SELECT nodo FROM r1))""",
        "(SELECT a AS src, b AS dst, peso FROM cu WHERE a IN (SELECT nodo FROM r2) AND b IN (SELECT nodo FROM r2))",
    )
)
def personal_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank from two rulings, six rounds, over edges both ways within two steps of them."""
    seeds = spark.createDataFrame([("cs:6-2021",), ("tc:11",)], "nodo string")
    return ops.personal_pagerank(corpus_edges(spark, sf_dir), seeds, 2, 6, tolerance=None).withColumn("puntaje", F.round("puntaje", 10))


@CATALOGUE.query(
    f"""WITH {_EDGES}, b AS (SELECT src, dst, 'curado' AS capa FROM e WHERE rel = 'normas' UNION ALL SELECT src, dst, 'mapa' FROM e WHERE rel <> 'normas'),
        x AS (SELECT src AS nodo, capa FROM b UNION ALL SELECT dst, capa FROM b) SELECT nodo, count(*) AS grado, count(*) FILTER (capa = 'curado') AS curado FROM x GROUP BY nodo"""
)
def curated_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in all layers and in the curated one."""
    e = citation_edges(spark, sf_dir).withColumn("capa", F.when(F.col("rel") == "normas", "curado").otherwise("mapa"))
    return ops.curated_degrees(e, "capa", "curado")


def _label_sql(rounds: int) -> str:
    steps = [f"WITH {_WAYS}, g0 AS (SELECT DISTINCT a AS nodo, a AS c FROM u)"]
    for i in range(rounds):
        steps.append(f"""h{i} AS (SELECT u.a, g.c, sum(peso) AS w FROM u JOIN g{i} g ON g.nodo = u.b GROUP BY 1, 2),
        j{i} AS (SELECT a, c FROM h{i} QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, c) = 1),
        g{i + 1} AS (SELECT g.nodo, CASE WHEN g.nodo % 2 = {i % 2} THEN j.c ELSE g.c END AS c FROM g{i} g JOIN j{i} j ON j.a = g.nodo)""")
    return ", ".join(steps) + f" SELECT nodo, c AS comunidad FROM g{rounds}"


@CATALOGUE.query(_label_sql(4))
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by spreading labels, four rounds."""
    return ops.communities(citation_edges(spark, sf_dir), 4, F.pmod(F.col("nodo"), F.lit(2)))


@CATALOGUE.query(
    f"""WITH {_EDGES}, b AS (SELECT * FROM e WHERE rel = 'normas'), l AS (SELECT * FROM e WHERE rel <> 'normas'),
        f AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.src = l.src AND b.dst = l.dst) AND src IN (SELECT src FROM b) AND dst IN (SELECT dst FROM e))
        SELECT src, dst, rel, peso, 'curado' AS capa FROM b UNION ALL
        SELECT src, dst, string_agg(DISTINCT rel, '+' ORDER BY rel), max(peso), 'mapa' FROM f GROUP BY src, dst"""
)
def layer_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of norms as the curated graph, other relations laid over it."""
    e = citation_edges(spark, sf_dir)
    base = e.filter("rel = 'normas'")
    known = base.select(F.col("src").alias("nodo")).unionByName(e.select(F.col("dst").alias("nodo"))).distinct()
    return ops.overlay(base, e.filter("rel <> 'normas'"), known)


@CATALOGUE.query(
    _label_sql(4).replace(" SELECT nodo, c AS comunidad FROM g4", "")
    + """, y AS (SELECT u.peso, p.c AS x, q.c AS z FROM u JOIN g4 p ON p.nodo = u.a JOIN g4 q ON q.nodo = u.b), t AS (SELECT sum(peso)::DOUBLE AS m2, sum(peso) FILTER (x = z)::DOUBLE AS d FROM y),
        k AS (SELECT sum(w * w) AS k2 FROM (SELECT sum(peso)::DOUBLE AS w FROM y GROUP BY x)) SELECT round(d / m2 - k2 / (m2 * m2), 9) AS modularidad FROM t, k"""
)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the communities part the graph."""
    e = citation_edges(spark, sf_dir)
    return ops.modularity(e, ops.communities(e, 4, F.pmod(F.col("nodo"), F.lit(2)))).withColumn("modularidad", F.round("modularidad", 9))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
