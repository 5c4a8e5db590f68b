"""Queries on the fields of records: identifiers, labels, choices, scores and report orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions import fields
from cartulario.functions.text import fold
from cartulario.plans.base import Catalogue
from cartulario.plans.scalar import fold_sql
from cartulario.session import table

CATALOGUE = Catalogue()


def _slug_sql(column: str) -> str:
    return f"regexp_replace(regexp_replace({fold_sql(column)}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@CATALOGUE.query(
    f"""WITH x AS (SELECT id, {_SQUEEZED.format(fold_sql("tribunal"))} AS t, {_slug_sql("tribunal")} AS ts, {fold_sql("trim(sala)")} AS s, {_slug_sql("sala")} AS ss FROM sentencias_judiciales)
        SELECT id, CASE WHEN ss <> '' THEN 'sala:' || coalesce('cs-' || CASE split_part(s, ' ', 1) WHEN 'primera' THEN 1 WHEN 'segunda' THEN 2 WHEN 'tercera' THEN 3 WHEN 'cuarta' THEN 4 WHEN 'quinta' THEN 5 WHEN 'sexta' THEN 6 END, ss) END AS sala,
               CASE WHEN ts <> '' THEN 'tribunal:' || CASE WHEN regexp_matches(t, '^(c\\.? ?a\\.?|corte de apelaciones) de .+$')
                    THEN 'ca-' || regexp_replace(regexp_replace(regexp_extract(t, '^(?:c\\.? ?a\\.?|corte de apelaciones) de (.+)$', 1), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') ELSE ts END END AS tribunal FROM x"""
)
def fn_court_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of rooms and courts."""
    s = table(spark, sf_dir, "sentencias_judiciales")
    return s.select("id", fields.room_id(F.col("sala")).alias("sala"), fields.court_id(F.col("tribunal")).alias("tribunal"))


@CATALOGUE.query(
    f"""WITH x AS (SELECT id, regexp_replace({_SQUEEZED.format(fold_sql("autor"))}, '^((don|dona|sr|sra|srta|senor|senora|ministro|ministra|abogado integrante|abogada integrante|fiscal judicial)\\.? )+', '') AS a,
                      materia, filepath FROM doctrina_instituciones)
        SELECT id, CASE WHEN {_slug_sql("a")} <> '' THEN 'ministro:' || {_slug_sql("a")} END AS juez, CASE WHEN {_slug_sql("materia")} <> '' THEN 'recurso:' || {_slug_sql("materia")} END AS recurso,
               'doc:' || replace(regexp_replace(regexp_replace(filepath, '^[^/]*/', ''), '\\.md$', ''), ' ', '_') AS ruta FROM x"""
)
def fn_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of people, kinds of appeal and files."""
    d = table(spark, sf_dir, "doctrina_instituciones")
    return d.select("id", fields.judge_id(F.col("autor")).alias("juez"), fields.prefixed_id("recurso", F.col("materia")).alias("recurso"), fields.path_id("doc", F.col("filepath")).alias("ruta"))


@CATALOGUE.query(
    """WITH x AS (SELECT n, string_split(id, ':') AS p FROM referencia WHERE id LIKE 'norma:%'), y AS (SELECT n, p[2] AS b, p[3] AS a, p[4] AS k, regexp_extract(p[2], '^(?:ley|dfl|dl|ds)-(\\d+)', 1) AS num FROM x),
       z AS (SELECT *, CASE WHEN b = 'cpr' THEN 'Constitución Política de la República'
                            WHEN b LIKE 'codigo-%' THEN 'Código ' || array_to_string(list_transform(string_split(replace(b, 'codigo-', ''), '-'), lambda w: upper(w[1]) || w[2:]), ' ')
                            WHEN num <> '' THEN CASE split_part(b, '-', 1) WHEN 'ley' THEN 'Ley N° ' WHEN 'dfl' THEN 'DFL N° ' WHEN 'dl' THEN 'DL N° ' ELSE 'DS N° ' END || replace(format('{:,}', CAST(num AS BIGINT)), ',', '.') END AS nombre,
                    CASE WHEN b LIKE 'codigo-%' THEN ' del ' WHEN num <> '' THEN CASE WHEN b LIKE 'ley-%' THEN ' de la ' ELSE ' del ' END ELSE ' de la ' END AS nexo FROM y)
       SELECT n, CASE WHEN a IS NOT NULL THEN 'Artículo ' || regexp_replace(replace(a, '-transitorio', ' transitorio'), '(\\d)-', '\\1 ', 'g') || coalesce(' N° ' || regexp_replace(k, '^n', ''), '') || nexo || nombre ELSE nombre END AS etiqueta FROM z"""
)
def fn_norm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of the dictionary written out."""
    return table(spark, sf_dir, "referencia").filter("id LIKE 'norma:%'").select("n", fields.norm_label(F.col("id")).alias("etiqueta"))


@CATALOGUE.query(
    f"""WITH x AS (SELECT id, fecha, rol, {_SQUEEZED.format("doctrina")} AS d FROM sentencias_judiciales),
        y AS (SELECT *, CASE WHEN length(d) <= 120 THEN d WHEN contains(d[1:120], '.') AND length(regexp_replace(d[1:120], '(?s)^(.*\\.)[^.]*$', '\\1')) * 2 > 120
                             THEN regexp_replace(d[1:120], '(?s)^(.*\\.)[^.]*$', '\\1') ELSE d[1:120] END AS c FROM x)
        SELECT id, concat_ws(' ', '[' || concat_ws(', ', 'Fallo', rol, CASE WHEN regexp_matches(fecha, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN strftime(try_strptime(fecha, '%Y-%m-%d'), '%d-%m-%Y') END) || ']', nullif(c, '')) AS cita FROM y"""
)
def fn_citation_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings as citations with an extract."""
    s = table(spark, sf_dir, "sentencias_judiciales")
    return s.select("id", fields.citation_brackets(F.lit("Fallo"), F.col("rol"), F.when(F.col("fecha").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("fecha")), F.col("doctrina"), 120).alias("cita"))


@CATALOGUE.query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          '\b[Ll]ey\s+(?:[Nn](?:ro|úm)?\.?\s*[°º]?\s*)?(\d{1,2})\.?(\d{3})\b', 'Ley N° \1.\2', 'g'),
          '\b[Rr]ol\s+(?:[Nn](?:ro|úm)?\.?\s*[°º]?\s*)?(\d{1,3})\.(\d{3})-(\d{4})\b', 'Rol N° \1\2-\3', 'g'), '\b[Rr]ol\s+(?:[Nn](?:ro|úm)?\.?\s*[°º]?\s*)?(\d{1,7}-\d{4})\b', 'Rol N° \1', 'g'),
          '\b(\d{1,2})\.?(\d{3})\.?(\d{3})-([0-9Kk])\b', '\1.\2.\3-\4', 'g'), '\.{3,}', '…', 'g'), '"([^"\n]+)"', '«\1»', 'g') AS texto FROM documents WHERE text IS NOT NULL"""
)
def fn_standard_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their citations in one way of writing."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", fields.standard_citations(F.col("text")).alias("texto"))


_SMALL = str(list(fields.SPANISH_SMALL))


@CATALOGUE.query(
    f"""WITH x AS (SELECT id, list_filter([obra, institucion, materia], lambda t: t IS NOT NULL) AS l FROM doctrina_instituciones), y AS (SELECT id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM x),
        z AS (SELECT id, t, i, len(list_intersect(list_distinct(regexp_split_to_array(lower(t), '\\s+')), {_SMALL})) AS s FROM y)
        SELECT id, t AS titulo FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, i) = 1"""
)
def fn_spanish_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three titles of a card the one that reads most like Spanish."""
    d = table(spark, sf_dir, "doctrina_instituciones")
    return d.select("id", fields.spanish_title(F.array_compact(F.array("obra", "institucion", "materia"))).alias("titulo")).filter("titulo IS NOT NULL")


@CATALOGUE.query(
    """WITH x AS (SELECT n, 'Dictamen N° ' || CASE n % 3 WHEN 0 THEN 'E' ELSE '' END || replace(format('{:,}', n * 7), ',', '.') || CASE n % 2 WHEN 0 THEN ', de ' || (1990 + n % 36) ELSE '-' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') END AS c FROM entrada)
       SELECT n, c AS escrito, CASE n % 3 WHEN 0 THEN 'E' ELSE '' END || (n * 7) || 'N' || CASE n % 2 WHEN 0 THEN 1990 + n % 36 ELSE CASE WHEN n % 100 <= 26 THEN 2000 ELSE 1900 END + n % 100 END AS codigo FROM x WHERE n * 7 < 1000000"""
)
def fn_opinion_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of opinions written in two ways, from numbers of entries."""
    n = F.col("n")
    dotted = F.regexp_replace((n * 7).cast("string"), r"(\d)(?=(?:\d{3})+$)", "$1.")
    ending = F.when(n % 2 == 0, F.concat(F.lit(", de "), (1990 + n % 36).cast("string"))).otherwise(F.concat(F.lit("-"), F.lpad((n % 100).cast("string"), 2, "0")))
    text = F.concat(F.lit("Dictamen N° "), F.when(n % 3 == 0, "E").otherwise(""), dotted, ending)
    return table(spark, sf_dir, "entrada").filter("n * 7 < 1000000").select("n", text.alias("escrito"), fields.opinion_code(text, 2026).alias("codigo"))


@CATALOGUE.query(
    f"""WITH x AS (SELECT id, lower(regexp_extract(rol, '\\b([A-Z]-\\d{{1,7}}-\\d{{4}}|\\d{{1,7}}-\\d{{4}})\\b', 1)) AS r, {_slug_sql("caratula")} AS s, cosechado_en FROM sentencias_judiciales)
        SELECT id, CASE WHEN coalesce(r, '') <> '' THEN 'rol-' || r ELSE concat_ws('-', strftime(cosechado_en, '%Y%m%d'), s[1:40]) END AS caso FROM x"""
)
def fn_case_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of cases, by role or by day and title."""
    return table(spark, sf_dir, "sentencias_judiciales").select("id", fields.case_id(F.col("rol"), F.col("caratula"), F.col("cosechado_en")).alias("caso"))


@CATALOGUE.query(
    """WITH x AS (SELECT unnest(['cs, tc', 'Suprema; ambientales;; suprema', 'Doctrina,cs , 9x,', 'á!, guias', '']) AS pedido)
       SELECT pedido, CASE pedido WHEN 'cs, tc' THEN 'cs,tc' WHEN 'Suprema; ambientales;; suprema' THEN 'cs,ta' WHEN 'Doctrina,cs , 9x,' THEN 'doc,cs' WHEN 'á!, guias' THEN 'guia' ELSE '' END AS colecciones,
              (SELECT count(*) FROM entrada WHERE lower(trim(col)) = 'cs' AND (pedido LIKE '%cs%' OR pedido LIKE 'Sup%')) AS filas_cs FROM x"""
)
def fn_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections asked for in several ways, with the entries of the supreme court that each reaches."""
    asked = spark.createDataFrame([(t,) for t in ("cs, tc", "Suprema; ambientales;; suprema", "Doctrina,cs , 9x,", "á!, guias", "")], "pedido string")
    cut = asked.withColumn("c", fields.collection_list(F.col("pedido")))
    held = table(spark, sf_dir, "entrada").select(F.lower(F.trim("col")).alias("k")).filter("k = 'cs'").agg(F.count(F.lit(1)).alias("cuantas"))
    return cut.join(F.broadcast(held)).select("pedido", F.array_join("c", ",").alias("colecciones"), F.when(F.array_contains("c", "cs"), F.col("cuantas")).otherwise(0).alias("filas_cs"))


@CATALOGUE.query(
    """WITH a AS (SELECT origen, list_distinct(list(destino)) AS l FROM cita WHERE destino IS NOT NULL AND origen IS NOT NULL GROUP BY 1)
       SELECT origen, CAST(len(l) AS INTEGER) AS cuantos, md5(array_to_string(list_sort(l), ',')) AS lista FROM a"""
)
def set_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entry cites, from two halves of the citations united in order, as a size and a digest."""
    c = table(spark, sf_dir, "cita").filter("destino IS NOT NULL AND origen IS NOT NULL").select("origen", "destino").distinct()
    halves = c.groupBy("origen").agg(*[F.sort_array(F.collect_list(F.when(F.col("destino") % 2 == i, F.col("destino").cast("string")))).alias(f"l{i}") for i in (0, 1)])
    both = fields.ordered_union(F.col("l1"), F.col("l0"), F.col("l1"))
    return halves.select("origen", F.size(both).alias("cuantos"), F.md5(F.array_join(F.array_sort(both.cast("array<long>")).cast("array<string>"), ",")).alias("lista"))


@CATALOGUE.query(f"SELECT doc_id FROM documents WHERE regexp_matches({fold_sql('text')}, '(^|[^a-z0-9_])por\\s+escrito($|[^a-z0-9_])')")
def phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which two words stand as a phrase of whole words."""
    return table(spark, sf_dir, "documents").filter(fields.whole_phrase(F.col("text"), "Por escrito")).select("doc_id")


@CATALOGUE.query(
    """WITH v AS (SELECT n, (n % 4) || '.' || (n % 12) || CASE n % 3 WHEN 0 THEN '' ELSE '.' || (n % 30) END AS version FROM entrada),
       p AS (SELECT n, version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) AS k FROM v)
       SELECT n, version, CASE WHEN k > [2, 10] THEN 'nueva' WHEN k = [2, 10] THEN 'igual' ELSE 'vieja' END AS frente_a FROM p"""
)
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions against 2.10, number by number."""
    n = F.col("n")
    v = F.concat(F.lit("v"), (n % 4).cast("string"), F.lit("."), (n % 12).cast("string"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("."), (n % 30).cast("string"))))
    k, base = fields.version_parts(F.col("v")), F.array(F.lit(2), F.lit(10))
    return table(spark, sf_dir, "entrada").select("n", v.alias("v")).select("n", F.substring("v", 2, 20).alias("version"), F.when(k > base, "nueva").when(k == base, "igual").otherwise("vieja").alias("frente_a"))


@CATALOGUE.query(
    """WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + CAST(o_orderkey % 90 - 45 AS INTEGER) AS c, o_orderdate::DATE + CAST(o_custkey % 50 AS INTEGER) AS a FROM orders), y AS (SELECT *, a + 20 AS b FROM x)
       SELECT o_orderkey, strftime(CASE WHEN d BETWEEN a - 60 AND b THEN d WHEN c BETWEEN a - 60 AND b THEN c ELSE a END, '%Y-%m-%d') AS fecha FROM y"""
)
def date_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of an order that fits between others of it."""
    d = F.to_date("o_orderdate")
    card, first = F.date_add(d, (F.col("o_orderkey") % 90 - 45).cast("int")), F.date_add(d, (F.col("o_custkey") % 50).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(fields.clamped_date(d, card, first, F.date_add(first, 20)), "yyyy-MM-dd").alias("fecha"))


@CATALOGUE.query(
    """WITH i AS (SELECT id, regexp_extract_all(concordancias, '\\d{2}\\.?\\d{3}') AS n, contenido FROM doctrina_instituciones)
       SELECT i.id, coalesce(len(n) > 0 AND len(list_filter(n, lambda v: NOT contains(regexp_replace(lower(contenido), '[.\\s]', '', 'g'), replace(v, '.', '')))) = 0, false) AS confirmada FROM i"""
)
def verified_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose listed laws all stand in their text."""
    d = table(spark, sf_dir, "doctrina_instituciones")
    listed = F.regexp_extract_all("concordancias", F.lit(r"\d{2}\.?\d{3}"), F.lit(0))
    return d.select("id", fields.all_in_text(listed, F.col("contenido")).alias("confirmada"))


@CATALOGUE.query(
    """WITH j AS (SELECT event_id, props, json_keys(props) AS k FROM events), y AS (SELECT event_id, list_transform(k, lambda x: x || ': ' || (props->>('$.' || x))) AS l FROM j)
       SELECT event_id, coalesce(array_to_string(l[1:3], ', '), '') AS linea FROM y"""
)
def readable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as readable lines."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(fields.readable_json(F.col("props")), F.lit("")).alias("linea"))


#: Keywords of areas, for the query.
AREAS = {"civil": ["contrato", "arriendo", "herencia"], "penal": ["delito", "pena", "imputado"], "laboral": ["sueldo", "despido", "sindicato"], "ambiental": ["agua", "humedal", "relave"]}


def _area_sql() -> str:
    def score(keys: list[str]) -> str:
        return " + ".join(f"CASE WHEN contains(t, '{k}') THEN 2 WHEN contains(b, '{k}') THEN 1 ELSE 0 END" for k in keys)

    scores = ", ".join(f"{score(keys)} AS s{i}" for i, keys in enumerate(AREAS.values()))
    cases = " ".join(f"WHEN s{i} = m THEN '{a}'" for i, a in enumerate(AREAS))
    first = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(w, '{k}')" for k in keys) + f" THEN '{a}' END" for a, keys in AREAS.items()) + "], lambda x: x IS NOT NULL)[1:3]"
    return f"""WITH x AS (SELECT doc_id, coalesce({fold_sql("titulo")}, '') AS t, coalesce({fold_sql("text[1:5000]")}, '') AS b, {fold_sql("text")} AS w FROM documents),
        y AS (SELECT doc_id, w, {scores} FROM x), z AS (SELECT *, greatest({", ".join(f"s{i}" for i in range(len(AREAS)))}) AS m FROM y)
        SELECT doc_id, CASE WHEN m = 0 THEN NULL {cases} END AS area, array_to_string({first}, ',') AS dominios FROM z"""


@CATALOGUE.query(_area_sql())
def area_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of each document, and the first three that it touches."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fields.area_score(F.col("titulo"), F.col("text"), AREAS).alias("area"), F.array_join(fields.domain_list(F.col("text"), AREAS), ",").alias("dominios"))


_WORDS = ["nulidad", "responsabilidad", "contrato"]


@CATALOGUE.query(
    f"""WITH x AS (SELECT id, fecha, coalesce({fold_sql("doctrina")}, '') AS t FROM sentencias_judiciales),
        y AS (SELECT id, fecha, {" + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in _WORDS)} AS h, {" + ".join(f"CAST(contains(t, '{w}') AS INT) * {2 if len(w) >= 8 else 1}" for w in _WORDS)} + CAST(contains(t, '{" ".join(_WORDS)}') AS INT) * 3 AS p FROM x)
        SELECT id, p AS puntos FROM y WHERE h >= 2 ORDER BY p DESC, nullif(fecha, '') DESC NULLS LAST, id LIMIT 100"""
)
def scored_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred rulings with most points for three words, the later first of equals, undated ones last."""
    s = table(spark, sf_dir, "sentencias_judiciales").select("id", "fecha", fields.weighted_words(F.col("doctrina"), _WORDS).alias("puntos"))
    return s.filter("puntos > 0").orderBy(F.desc("puntos"), F.desc_nulls_last(F.nullif("fecha", F.lit(""))), "id").limit(100).select("id", "puntos")


def _variants_sql(words: list[str]) -> str:
    def held(column: str) -> str:
        return " + ".join(f"CAST(coalesce({' OR '.join(f'contains({column}, {v!r})' for v in [w, w + 's', w + 'es'] + ([w[:-1]] if w.endswith('s') else []))}, false) AS INT)" for w in words)

    return f"""WITH x AS (SELECT doc_id, {fold_sql("titulo")} AS t, {fold_sql("text")} AS b, length(text) AS n FROM documents), y AS (SELECT doc_id, n, 3 * ({held("t")}) + least(4, {held("b")}) AS p FROM x)
        SELECT doc_id, p AS puntos FROM y WHERE p > 0 ORDER BY p DESC, n, doc_id LIMIT 200"""


@CATALOGUE.query(_variants_sql(["multas", "camino", "agua"]))
def variant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred documents with most points for three words in either number; the shorter first of equals."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), fields.variant_hits(F.col("titulo"), F.col("text"), ["multas", "camino", "agua"]).alias("puntos"))
    return d.filter("puntos > 0").orderBy(F.desc("puntos"), "n", "doc_id").limit(200).select("doc_id", "puntos")


@CATALOGUE.query(
    """SELECT id, tribunal, row_number() OVER (ORDER BY CASE lower(trim(tribunal)) WHEN 'corte suprema' THEN 0 WHEN 'tribunal constitucional' THEN 1 ELSE 2 END, id) AS lugar
       FROM sentencias_judiciales QUALIFY lugar <= 50"""
)
def court_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rulings, the highest courts first."""
    from pyspark.sql import Window

    rank = F.when(F.lower(F.trim("tribunal")) == "corte suprema", 0).when(F.lower(F.trim("tribunal")) == "tribunal constitucional", 1).otherwise(2)
    best = table(spark, sf_dir, "sentencias_judiciales").select("id", "tribunal", rank.alias("r")).orderBy("r", "id").limit(50)
    # The window holds the fifty rows of the report.
    return best.select("id", "tribunal", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("r", "id")).cast("long").alias("lugar"))


@CATALOGUE.query(
    f"""SELECT area, id, institucion FROM (SELECT area, id, institucion, filepath FROM doctrina_instituciones WHERE contains({fold_sql("institucion")}, 'a') AND area IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY area ORDER BY CASE WHEN filepath ILIKE '%1%' THEN 1 ELSE 0 END, length(institucion), institucion, id) = 1"""
)
def shortest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each area the institution of shortest name that holds a term, those of penalised files last."""
    from cartulario.operators.relational import first_wins

    d = table(spark, sf_dir, "doctrina_instituciones").filter(F.contains(fold(F.col("institucion")), F.lit("a")) & F.col("area").isNotNull())
    order = [F.when(F.col("filepath").ilike("%1%"), 1).otherwise(0), F.length("institucion"), F.col("institucion"), F.col("id")]
    return first_wins(d.select("area", "id", "institucion", "filepath"), ["area"], order).select("area", "id", "institucion")


@CATALOGUE.query(
    f"""SELECT id, fecha FROM sentencias_judiciales WHERE fecha BETWEEN '2024-01-01' AND '2025-06-30' AND contains({fold_sql("tribunal")}, 'apelaciones')
        AND contains({fold_sql("concat_ws(' ', caratula, materia, doctrina, normas)")}, 'ley')"""
)
def faceted_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings of a span of dates and kind of court, with a word anywhere in them."""
    s = table(spark, sf_dir, "sentencias_judiciales").filter(F.col("fecha").between("2024-01-01", "2025-06-30"))
    whole = F.concat_ws(" ", "caratula", "materia", "doctrina", "normas")
    return s.filter(F.contains(fold(F.col("tribunal")), F.lit("apelaciones")) & F.contains(fold(whole), F.lit("ley"))).select("id", "fecha")


_ASKED = ["cs:6-2021", "nada:1", "tc:11", "cs:1-2025", "cs:6-2021"]


@CATALOGUE.query(f"WITH w AS (SELECT unnest({_ASKED}) AS id, unnest(range(0, {len(_ASKED)})) AS lugar) SELECT CAST(lugar AS INTEGER) AS lugar, e.id, e.n FROM w JOIN entrada e ON e.id = w.id")
def entries_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a list of ids, each with its place in the list."""
    asked = spark.createDataFrame([(_ASKED,)], "ids array<string>").select(F.posexplode("ids").alias("lugar", "id"))
    return table(spark, sf_dir, "entrada").select("id", "n").join(F.broadcast(asked), "id").select("lugar", "id", "n")


@CATALOGUE.query(
    f"""WITH h AS (SELECT id FROM sentencias_judiciales WHERE contains({fold_sql("sala")}, 'no hay tal sala')), c AS (SELECT count(*) AS n FROM h)
        SELECT CAST(NULL AS BIGINT) AS id, 'disponibles: ' || (SELECT string_agg(DISTINCT {fold_sql("trim(sala, ' ')")}, ', ' ORDER BY {fold_sql("trim(sala, ' ')")}) FROM sentencias_judiciales WHERE trim(sala, ' ') <> '') AS aviso FROM c WHERE n = 0 AND EXISTS (SELECT 1 FROM sentencias_judiciales WHERE trim(sala, ' ') <> '')
        UNION ALL SELECT id, NULL FROM h"""
)
def filter_with_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings of a room, or one row that lists the rooms there are if there is none."""
    from cartulario.operators.lookup import filtered_or_hint

    s = table(spark, sf_dir, "sentencias_judiciales")
    return filtered_or_hint(s, "id", F.contains(fold(F.col("sala")), F.lit("no hay tal sala")), fold(F.trim("sala")))


@CATALOGUE.query(
    """WITH w AS (SELECT o_orderkey, CAST(o_orderkey % 500 AS BIGINT) AS semilla FROM orders) SELECT semilla, count(*) AS preguntas, 1 AS elegidas FROM w GROUP BY semilla"""
)
def seeded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question of each group, drawn by a seed: the same for the same seed."""
    from cartulario.operators.relational import seeded_choice

    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("semilla"), "o_orderkey")
    picked = seeded_choice(o, ["semilla"], "o_orderkey", 7).groupBy("semilla").agg(F.count(F.lit(1)).cast("int").alias("elegidas"))
    return o.groupBy("semilla").agg(F.count(F.lit(1)).alias("preguntas")).join(picked, "semilla")


@CATALOGUE.query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice * 38.0, 0) AS BIGINT) AS pesos FROM lineitem")
def amount_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in units of account as pesos, rounded half to even."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_extendedprice") * 38.0, 0).cast("long").alias("pesos"))


@CATALOGUE.query(
    """WITH p AS (SELECT event_id, props FROM events) SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS claves, array_to_string(list_sort(list_transform(json_keys(props), lambda k: k || '=' || (props->>('$.' || k)))), '|') AS hojas FROM p"""
)
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaves of the JSON properties of events, whatever their depth."""
    from cartulario.functions.records import json_leaves

    e = table(spark, sf_dir, "events").select("event_id", json_leaves(F.col("props")).alias("h"))
    return e.select("event_id", F.size("h").alias("claves"), F.array_join(F.array_sort(F.transform("h", lambda x: F.concat(x["ruta"], F.lit("="), x["valor"]))), "|").alias("hojas"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
