"""Queries on joins, windows, aggregations and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulario.functions.ids import id_kind
from cartulario.functions.text import word_count
from cartulario.operators import relational as ops
from cartulario.operators.heavy_keys import folded
from cartulario.plans.base import Catalogue
from cartulario.session import table

CATALOGUE = Catalogue()


@CATALOGUE.query(
    """SELECT lower(trim(source)) AS source, lang, count(*) AS textos, count(DISTINCT text) AS distintos,
              CAST(sum(coalesce(len(regexp_extract_all(text, '\\S+')), 0)) AS BIGINT) AS palabras, CAST(sum(n_chars) AS BIGINT) AS caracteres
       FROM documents GROUP BY 1, 2"""
)
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, words and characters by source and language."""
    d = table(spark, sf_dir, "documents").select(folded("source").alias("source"), "lang", F.xxhash64("text").alias("h"), "text", "n_chars")
    return d.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("textos"), F.countDistinct(F.when(F.col("text").isNotNull(), F.col("h"))).alias("distintos"),
        F.sum(word_count(F.col("text"))).alias("palabras"), F.sum("n_chars").alias("caracteres"),
    )


@CATALOGUE.query(
    """WITH d AS (SELECT n FROM referencia WHERE id LIKE 'norma:codigo%' OR id LIKE 'norma:cpr%')
       SELECT e.id, e.n, CAST(sum(c.n) AS BIGINT) AS peso, count(DISTINCT c.destino) AS destinos
       FROM cita c JOIN d ON c.destino = d.n JOIN entrada e ON e.n = c.origen
       WHERE lower(trim(c.rel)) = 'normas' GROUP BY e.id, e.n ORDER BY peso DESC, e.id, e.n LIMIT 200"""
)
def ranked_citers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred entries that cite codes and the constitution most."""
    ref = table(spark, sf_dir, "referencia").filter("id LIKE 'norma:codigo%' OR id LIKE 'norma:cpr%'").select(F.col("n").alias("destino"))
    cita = table(spark, sf_dir, "cita").filter(folded("rel") == "normas").select("destino", "origen", F.col("n").alias("veces"))
    cited = cita.join(ref, "destino", "left_semi").groupBy("origen", "destino").agg(F.sum("veces").alias("veces"))
    total = cited.groupBy("origen").agg(F.sum("veces").alias("peso"), F.count(F.lit(1)).alias("destinos"))
    entries = table(spark, sf_dir, "entrada").select("n", "id")
    out = total.join(entries, F.col("origen") == F.col("n")).select("id", "n", "peso", "destinos")
    return out.orderBy(F.desc("peso"), "id", "n").limit(200)


@CATALOGUE.query(
    """SELECT r.id, count(*) AS filas, count(DISTINCT c.origen) AS citantes, CAST(sum(c.n) AS BIGINT) AS veces
       FROM cita c JOIN referencia r ON r.n = c.destino GROUP BY r.id"""
)
def citer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and by how many each identifier is cited."""
    cita = table(spark, sf_dir, "cita").filter("destino IS NOT NULL")
    fine = cita.groupBy("destino", "origen").agg(F.count(F.lit(1)).alias("filas"), F.sum("n").alias("veces"))
    total = fine.groupBy("destino").agg(F.sum("filas").alias("filas"), F.count("origen").alias("citantes"), F.sum("veces").alias("veces"))
    return total.join(table(spark, sf_dir, "referencia"), F.col("destino") == F.col("n")).select("id", "filas", "citantes", "veces")


@CATALOGUE.query(
    """SELECT split_part(r.id, ':', 1) AS tipo, r.id, lower(trim(e.col)) AS col, CAST(sum(c.n) AS BIGINT) AS veces
       FROM cita c JOIN referencia r ON r.n = c.destino JOIN entrada e ON e.n = c.origen GROUP BY 1, 2, 3"""
)
def entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every entity by the collection that they come from."""
    cita = table(spark, sf_dir, "cita").filter("destino IS NOT NULL").groupBy("destino", "origen").agg(F.sum("n").alias("veces"))
    entries = table(spark, sf_dir, "entrada").select(F.col("n").alias("origen"), folded("col").alias("col"))
    by = cita.join(entries, "origen").groupBy("destino", "col").agg(F.sum("veces").alias("veces"))
    ref = table(spark, sf_dir, "referencia").select(F.col("n").alias("destino"), "id")
    return by.join(ref, "destino").select(id_kind(F.col("id")).alias("tipo"), "id", "col", "veces")


@CATALOGUE.query(
    """SELECT lower(trim(col)) AS col, era, grouping(lower(trim(col))) AS sin_col, grouping(era) AS sin_era, count(*) AS entradas, CAST(sum(bytes) AS BIGINT) AS bytes
       FROM entrada GROUP BY CUBE (lower(trim(col)), era) HAVING count(*) > 0"""
)
def collection_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and bytes by collection and era, with all subtotals."""
    e = table(spark, sf_dir, "entrada").select(folded("col").alias("col"), "era", "bytes")
    return e.cube("col", "era").agg(
        F.grouping("col").cast("long").alias("sin_col"), F.grouping("era").cast("long").alias("sin_era"), F.count(F.lit(1)).alias("entradas"), F.sum("bytes").alias("bytes")
    )


@CATALOGUE.query(
    """WITH c AS (SELECT tribunal, materia, count(*) AS n FROM sentencias_judiciales WHERE materia IS NOT NULL GROUP BY 1, 2)
       SELECT tribunal, materia, n AS veces FROM c QUALIFY row_number() OVER (PARTITION BY tribunal ORDER BY n DESC, materia) = 1"""
)
def most_frequent_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject that each court has most often."""
    return ops.most_frequent(table(spark, sf_dir, "sentencias_judiciales"), ["tribunal"], "materia")


@CATALOGUE.query(
    """SELECT id, rol, cosechado_en FROM sentencias_judiciales WHERE rol IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY rol ORDER BY cosechado_en, id) = 1"""
)
def first_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ruling as first harvested."""
    s = table(spark, sf_dir, "sentencias_judiciales").select("id", "rol", "cosechado_en").filter("rol IS NOT NULL")
    return ops.first_wins(s, ["rol"], [F.col("cosechado_en"), F.col("id")])


@CATALOGUE.query(
    """WITH r AS (SELECT n, id, row_number() OVER (PARTITION BY id ORDER BY ingresado_en, n) AS k FROM entrada)
       SELECT n, CASE WHEN k > 1 THEN id || '-' || k ELSE id END AS id_unico, CASE WHEN k > 1 THEN id END AS id_base FROM r"""
)
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries under unique identifiers; files delivered again get a suffix."""
    e = table(spark, sf_dir, "entrada").select("n", "id", "ingresado_en")
    return ops.resolve_collisions(e, "id", [F.col("ingresado_en"), F.col("n")]).select("n", "id_unico", "id_base")


@CATALOGUE.query(
    """WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0),
            b AS (SELECT doc_id, md5(CASE WHEN doc_id % 11 = 0 THEN text || ' x' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
       SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
              CASE WHEN a.doc_id IS NULL THEN 'agregado' WHEN b.doc_id IS NULL THEN 'eliminado' ELSE 'modificado' END AS cambio
       FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h IS DISTINCT FROM b.h"""
)
def delta_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two states of the corpus, made from its rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = d.filter("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    return ops.snapshot_diff(d.filter("doc_id % 7 <> 0"), new, "doc_id", ["text"])


@CATALOGUE.query()
def delta_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of all documents, in any order."""
    return ops.fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source"], "1")


@CATALOGUE.query(
    """SELECT e.event_id, e.user_id, e.ts, s.event_id AS desde_evento, s.value AS valor_compra FROM events e
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') s ON e.user_id = s.user_id AND e.ts >= s.ts
       WHERE e.event_type <> 'purchase'"""
)
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last purchase before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("desde"), F.col("event_id").alias("desde_evento"), F.col("value").alias("valor_compra"))
    left = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return ops.asof_join(left, bought, "user_id", "ts", "desde", ["desde_evento", "valor_compra"])


@CATALOGUE.query(
    """SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS hasta FROM (SELECT DISTINCT user_id, ts FROM events)"""
)
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open intervals between the events of each user."""
    return ops.validity_intervals(table(spark, sf_dir, "events").select("user_id", "ts").distinct(), "user_id", "ts")


@CATALOGUE.query(
    """WITH l AS (SELECT doc_id, k, trim(lineas[k]) AS linea FROM (SELECT doc_id, lineas, unnest(range(1, len(lineas) + 1)) AS k
                 FROM (SELECT doc_id, string_split(text, chr(10)) AS lineas FROM documents WHERE text IS NOT NULL))),
       h AS (SELECT doc_id, k, linea, last_value(CASE WHEN linea LIKE '# %' THEN linea END IGNORE NULLS)
                    OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS titulo FROM l)
       SELECT doc_id, titulo, count(*) AS lineas, CAST(sum(length(linea)) AS BIGINT) AS caracteres FROM h WHERE linea <> '' GROUP BY 1, 2"""
)
def heading_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under each heading of each document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "linea"))
    lines = lines.select("doc_id", "k", F.trim("linea").alias("linea")).withColumn("t", F.when(F.col("linea").startswith("# "), F.col("linea")))
    filled = ops.forward_filled(lines, ["doc_id"], [F.col("k")], "t", "titulo").filter("linea <> ''")
    return filled.groupBy("doc_id", "titulo").agg(F.count(F.lit(1)).alias("lineas"), F.sum(F.length("linea").cast("long")).alias("caracteres"))


@CATALOGUE.query(
    """WITH a AS (SELECT DISTINCT lower(trim(cuerpo_legal)) AS cuerpo, TRY_CAST(regexp_extract(articulo_id, '^\\d+') AS BIGINT) AS num FROM articulos_vectorial),
       m AS (SELECT *, CASE WHEN num - lag(num) OVER w <= 3 THEN 0 ELSE 1 END AS nuevo FROM a WHERE num IS NOT NULL WINDOW w AS (PARTITION BY cuerpo ORDER BY num)),
       r AS (SELECT *, sum(nuevo) OVER (PARTITION BY cuerpo ORDER BY num) AS tramo FROM m)
       SELECT cuerpo, min(num) AS desde, max(num) AS hasta, count(*) AS cuantos FROM r GROUP BY cuerpo, tramo"""
)
def article_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of articles of each body with gaps of at most three."""
    a = table(spark, sf_dir, "articulos_vectorial").select(
        folded("cuerpo_legal").alias("cuerpo"), F.regexp_extract("articulo_id", r"^\d+", 0).try_cast("long").alias("num")
    )
    return ops.runs(a, ["cuerpo"], "num", 3)


@CATALOGUE.query(
    """WITH s AS (SELECT doc_id, source, n_chars, lower(trim(source)) = 'sentencia' AS f FROM documents WHERE source IS NOT NULL),
       r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n_chars DESC, doc_id) AS k FROM s),
       t AS (SELECT *, CASE WHEN f THEN k > 40 ELSE k > 20 END AS tarde FROM r WHERE k <= 60)
       SELECT doc_id, source, n_chars FROM t ORDER BY tarde, n_chars DESC, doc_id LIMIT 60"""
)
def quota_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty longest documents, twenty places kept for others than rulings."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").filter("source IS NOT NULL")
    return ops.quota_merge(d, folded("source") == "sentencia", [F.desc("n_chars"), F.col("doc_id")], 60, 20)


@CATALOGUE.query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
       r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k FROM m)
       SELECT x.l_orderkey, x.l_partkey AS a, y.l_partkey AS b FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND y.k BETWEEN x.k + 1 AND x.k + 3"""
)
def bounded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order paired with the next three."""
    return ops.bounded_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 3)


@CATALOGUE.query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
       SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS comunes FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2"""
)
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders each pair of parts shares."""
    return ops.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 50)


@CATALOGUE.query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS m FROM lineitem), n AS (SELECT k, count(*) AS n FROM m GROUP BY k HAVING count(*) >= 2),
       p AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM m x JOIN m y ON x.m = y.m AND x.k < y.k GROUP BY 1, 2)
       SELECT a, b, CAST(c AS INTEGER) AS comunes, round(c / (na.n + nb.n - c), 9) AS jaccard
       FROM p JOIN n na ON na.k = a JOIN n nb ON nb.k = b WHERE c / (na.n + nb.n - c) >= 0.4 - 1e-9"""
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of at least two parts that share a good part of them."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("m")).distinct()
    large = m.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2").select("k")
    return ops.jaccard_pairs(m.join(large, "k", "left_semi"), "k", "m", 0.4).withColumn("jaccard", F.round("jaccard", 9))


@CATALOGUE.query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS m FROM lineitem), n AS (SELECT k, count(*) AS n FROM m GROUP BY k),
       p AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM m x JOIN m y ON x.m = y.m AND x.k < y.k GROUP BY 1, 2)
       SELECT a, b, CAST(c AS INTEGER) AS comunes, round(c / (na.n + nb.n - c), 9) AS jaccard
       FROM p JOIN n na ON na.k = a JOIN n nb ON nb.k = b WHERE c / (na.n + nb.n - c) >= 0.6 - 1e-9"""
)
def jaccard_supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, of one supplier and more, whose suppliers agree for the most part."""
    return ops.jaccard_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 0.6).withColumn("jaccard", F.round("jaccard", 9))


@CATALOGUE.query(
    """WITH k AS (SELECT titulo, count(*) AS c, min(n) AS m FROM entrada WHERE titulo IS NOT NULL GROUP BY titulo)
       SELECT s.id AS fallo, s.caratula AS titulo, CASE WHEN coalesce(c, 0) = 1 THEN 'unico' WHEN coalesce(c, 0) > 1 THEN 'ambiguo' ELSE 'ausente' END AS estado,
              CASE WHEN c = 1 THEN m END AS id, coalesce(c, 0) AS candidatos
       FROM sentencias_judiciales s LEFT JOIN k ON k.titulo = s.caratula"""
)
def exact_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings with the entry of the same title, if exactly one has it."""
    wanted = table(spark, sf_dir, "sentencias_judiciales").select(F.col("id").alias("fallo"), F.col("caratula").alias("titulo"))
    return ops.exact_identity(wanted, table(spark, sf_dir, "entrada").select("titulo", "n"), "titulo", "n")


@CATALOGUE.query(
    """SELECT c.origen, r.id FROM cita c JOIN referencia r ON r.n = c.destino WHERE r.id LIKE 'norma:%' AND NOT EXISTS (
           SELECT 1 FROM cita d JOIN referencia q ON q.n = d.destino WHERE d.origen = c.origen AND q.id LIKE r.id || ':%' AND q.id NOT LIKE r.id || ':%:%')"""
)
def specific_over_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms cited by each entry, whole bodies only where no part of them is cited."""
    ref = table(spark, sf_dir, "referencia").filter("id LIKE 'norma:%'").select(F.col("n").alias("destino"), "id")
    return ops.specific_over_generic(table(spark, sf_dir, "cita").select("origen", "destino").join(ref, "destino").select("origen", "id"), "origen", "id")


@CATALOGUE.query(
    """SELECT id AS n, rol AS clave, 'fallo' AS origen FROM sentencias_judiciales WHERE rol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rol ORDER BY id) = 1
       UNION ALL
       SELECT doc_id, causa, 'documento' FROM documents WHERE causa IS NOT NULL AND causa NOT IN (SELECT rol FROM sentencias_judiciales WHERE rol IS NOT NULL)
       QUALIFY row_number() OVER (PARTITION BY causa ORDER BY doc_id) = 1"""
)
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases known from rulings, and those that only documents name."""
    s = table(spark, sf_dir, "sentencias_judiciales").select(F.col("id").alias("n"), F.col("rol").alias("clave"), F.lit("fallo").alias("origen")).filter("clave IS NOT NULL")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("causa").alias("clave"), F.lit("documento").alias("origen")).filter("clave IS NOT NULL")
    return ops.insert_absent(ops.first_wins(s, ["clave"], [F.col("n")]), d, ["clave"])


@CATALOGUE.query(
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem
                 WHERE l_extendedprice > 0 WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice))
       SELECT l_returnflag, count(*) AS n, min(v) AS min, max(CASE WHEN i = greatest(n // 4 - 1, 0) THEN v END) AS p25, round(median(v), 4) AS mediana,
              round(avg(v), 4) AS promedio, max(CASE WHEN i = least(3 * n // 4, n - 1) THEN v END) AS p75, max(v) AS max FROM r GROUP BY l_returnflag"""
)
def amount_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of amounts by index."""
    return ops.index_quartiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@CATALOGUE.query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of event values."""
    return ops.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.95])


@CATALOGUE.query(
    """WITH e AS (SELECT lower(trim(col)) AS col, era FROM entrada WHERE era IS NOT NULL)
       SELECT col, count(*) AS entradas, min(era) AS primera, max(era) AS ultima, round(sum(exp(-0.25 * (2026 - era))) / count(*), 6) AS vigencia,
              CASE WHEN sum(exp(-0.25 * (2026 - era))) / count(*) >= 0.65 THEN 'vigente' WHEN sum(exp(-0.25 * (2026 - era))) / count(*) >= 0.35 THEN 'media' ELSE 'antigua' END AS tramo
       FROM e GROUP BY col"""
)
def decay_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How recent each collection is, years weighing exponentially less."""
    e = table(spark, sf_dir, "entrada").filter("era IS NOT NULL").select(folded("col").alias("col"), "era")
    by = e.groupBy("col", "era").agg(F.count(F.lit(1)).alias("k"))
    out = by.groupBy("col").agg(
        F.sum("k").alias("entradas"), F.min("era").alias("primera"), F.max("era").alias("ultima"), F.sum(F.col("k") * F.exp((F.col("era") - 2026) * 0.25)).alias("w")
    )
    share = F.col("w") / F.col("entradas")
    return out.select(
        "col", "entradas", "primera", "ultima", F.round(share, 6).alias("vigencia"), F.when(share >= 0.65, "vigente").when(share >= 0.35, "media").otherwise("antigua").alias("tramo")
    )


@CATALOGUE.query(
    """SELECT area, count(*) AS fichas, count(DISTINCT obra) AS obras, count(DISTINCT autor) AS autores, CAST(coalesce(sum(tokens_aprox), 0) AS BIGINT) AS tokens,
              count(*) FILTER (tokens_aprox IS NULL OR tokens_aprox = 0) AS sin_tokens FROM doctrina_instituciones GROUP BY area"""
)
def area_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards, works, authors and tokens by area."""
    d = table(spark, sf_dir, "doctrina_instituciones")
    return d.groupBy("area").agg(
        F.count(F.lit(1)).alias("fichas"), F.countDistinct("obra").alias("obras"), F.countDistinct("autor").alias("autores"),
        F.coalesce(F.sum("tokens_aprox"), F.lit(0)).alias("tokens"), F.count_if(F.coalesce("tokens_aprox", F.lit(0)) == 0).alias("sin_tokens"),
    )


@CATALOGUE.query(
    """WITH t AS (SELECT lower(trim(e.col)) AS col, r.id, CAST(sum(c.n) AS BIGINT) AS veces FROM cita c JOIN referencia r ON r.n = c.destino JOIN entrada e ON e.n = c.origen GROUP BY 1, 2)
       SELECT col, id, veces, row_number() OVER (PARTITION BY col ORDER BY veces DESC, id) AS rango FROM t QUALIFY rango <= 3"""
)
def top_cited_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three identifiers that each collection cites most."""
    rolled = entity_rollup(spark, sf_dir).select("col", "id", "veces")
    out = ops.top_per_group(rolled, ["col"], [F.desc("veces"), F.col("id")], 3)
    return out.withColumn("rango", F.col("rango").cast("long"))


@CATALOGUE.query(
    """SELECT e.n, e.id FROM entrada e WHERE EXISTS (SELECT 1 FROM cita c WHERE c.origen = e.n AND lower(trim(c.rel)) LIKE 'cita_%')
       AND NOT EXISTS (SELECT 1 FROM cita c WHERE c.origen = e.n AND lower(trim(c.rel)) = 'normas')"""
)
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that cite decisions or works but no norm."""
    cita = table(spark, sf_dir, "cita").select(F.col("origen").alias("n"), folded("rel").alias("rel"))
    e = table(spark, sf_dir, "entrada").select("n", "id")
    return e.join(cita.filter("rel LIKE 'cita_%'"), "n", "left_semi").join(cita.filter("rel = 'normas'"), "n", "left_anti")


@CATALOGUE.query(
    """SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderkey) OVER w AS anterior, CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS INTEGER) AS dias
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def chain_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the customer's order before it and the days between."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.withColumn("anterior", F.lag("o_orderkey").over(w)).withColumn("dias", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)))


@CATALOGUE.query(
    """WITH p AS (SELECT d.doc_id, d.n_chars > 2000 AS largo, n.nivel >= 3 AS dificil FROM documents d JOIN niveles_muestra n ON n.doc_id = d.doc_id)
       SELECT count(*) FILTER (largo AND dificil) AS tp, count(*) FILTER (largo AND NOT dificil) AS fp, count(*) FILTER (NOT largo AND dificil) AS fn,
              round(count(*) FILTER (largo AND dificil) / nullif(count(*) FILTER (largo), 0), 6) AS precision,
              round(count(*) FILTER (largo AND dificil) / nullif(count(*) FILTER (dificil), 0), 6) AS recall FROM p"""
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length alone tells demanding texts: micro precision and recall."""
    levels = table(spark, sf_dir, "niveles_muestra").select("doc_id", "nivel")
    p = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(levels, "doc_id").select((F.col("n_chars") > 2000).alias("l"), (F.col("nivel") >= 3).alias("d"))
    c = p.agg(F.count_if(F.col("l") & F.col("d")).alias("tp"), F.count_if(F.col("l") & ~F.col("d")).alias("fp"), F.count_if(~F.col("l") & F.col("d")).alias("fn"))
    return c.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


@CATALOGUE.query(
    """WITH t AS (SELECT id, era_ AS era, CASE WHEN r = '7-2024' THEN 3 WHEN contains(c, 'jorquiel con') THEN 2 WHEN contains(c, 'jorquiel') OR contains(c, 'yarzabel') THEN 1 ELSE 0 END AS nivel
                  FROM (SELECT n AS id, coalesce(era, 0) AS era_, trim(rol) AS r, lower(titulo) AS c FROM entrada))
       SELECT id, nivel, CAST(row_number() OVER (PARTITION BY nivel ORDER BY era DESC, id) AS INTEGER) AS lugar FROM t WHERE nivel > 0"""
)
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by how closely they fit what is looked for: the role, a phrase of the title, one of its words; the later first within each."""
    e = table(spark, sf_dir, "entrada").select(F.col("n").alias("id"), F.coalesce("era", F.lit(0)).alias("era"), F.trim("rol").alias("r"), F.lower("titulo").alias("c"))
    tier = F.when(F.col("r") == "7-2024", 3).when(F.contains("c", F.lit("jorquiel con")), 2).when(F.contains("c", F.lit("jorquiel")) | F.contains("c", F.lit("yarzabel")), 1).otherwise(0)
    return ops.tiered(e.withColumn("nivel", tier), "nivel", [F.desc("era"), F.col("id")]).select("id", "nivel", "lugar")


@CATALOGUE.query(
    """WITH f AS (SELECT 'ley' AS k UNION ALL SELECT 'contrato' UNION ALL SELECT 'nulidad' UNION ALL SELECT 'costas')
       SELECT k AS termino, id FROM sentencias_judiciales JOIN f ON contains(lower(doctrina), k)"""
)
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings joined to the terms that their text holds, in one pass over the texts."""
    terms = F.array(*map(F.lit, ("ley", "contrato", "nulidad", "costas")))
    held = F.filter(terms, lambda t: F.contains(F.lower(F.col("doctrina")), t))
    return table(spark, sf_dir, "sentencias_judiciales").select(F.explode(held).alias("termino"), "id")


@CATALOGUE.query(
    """SELECT CASE WHEN materia LIKE '%laboral%' OR materia LIKE '%espido%' OR materia LIKE '%rabajo%' THEN 'laboral' WHEN materia LIKE '%enal%' OR materia LIKE '%obo%' OR materia LIKE '%stafa%' THEN 'penal'
                   WHEN materia LIKE '%guas%' OR materia LIKE '%mbiental%' THEN 'ambiental' ELSE 'general' END AS dominio, count(*) AS fallos FROM sentencias_judiciales GROUP BY 1"""
)
def rule_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings by the first rule that their subject meets."""
    m = F.col("materia")
    has = lambda *xs: F.coalesce(m.rlike("|".join(xs)), F.lit(False))
    domain = F.when(has("laboral", "espido", "rabajo"), "laboral").when(has("enal", "obo", "stafa"), "penal").when(has("guas", "mbiental"), "ambiental").otherwise("general")
    return table(spark, sf_dir, "sentencias_judiciales").groupBy(domain.alias("dominio")).agg(F.count(F.lit(1)).alias("fallos"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
