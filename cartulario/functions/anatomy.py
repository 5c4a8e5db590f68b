"""The parts of rulings, administrative opinions and harvested record files, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulario.functions.dates import iso_date
from cartulario.functions.segments import stripped
from cartulario.functions.text import fold, slug, squeeze
from cartulario.sources.files import bullets

# Words that open the parts of a ruling and of an opinion.
_ORDINAL = r"(?:primero|segundo|tercero|cuarto|quinto|sexto|s[ée]ptimo|octavo|noveno|(?:und[ée]|duod[ée]|d[ée])cimo(?:\s?\w+)?|\d{1,3}[°º])"
_ITEM = rf"^\s*{_ORDINAL}\s*[.:)°º-]"
_ORDERS = r"^\s*(?:se\s+(?:resuelve|declara|acoge|rechaza|confirma|revoca)|por\s+estas\s+consideraciones|resuelvo|y\s+vistos?)\b"
_DISSENT = r"(?imu)^.*\b(?:voto\s+(?:en\s+contra|disidente|de\s+minor[íi]a)|acordad[ao]\s+con\s+el\s+voto\s+en\s+contra)\b"
# Words by which a consideration is one of fact.
_FACTS = r"(?iu)\b(?:demand[óa]\w*|testig\w+|prueba\w*|declar[óo]|hechos?|acompañ\w+|fecha|consta)\b"


def ruling_parts(text: Column) -> Column:
    """(vistos, considerandos, resolutiva, disidencia, costas) of a ruling.

    What stands before the first consideration, the considerations as (numero, tipo, texto) in
    order, from the first ordering line on what is decided, and the dissent from its line on; ``costas`` tells
    whether costs are awarded. A consideration is HECHO if words of fact outnumber citations, else DERECHO. Missing
    parts are null; a null text gives nulls and no considerations.
    """
    dissent_at = F.length(F.get(F.split(text, _DISSENT, 2), F.lit(0)))
    main = F.when(text.rlike(_DISSENT), F.substr(text, F.lit(1), dissent_at)).otherwise(text)
    dissent = F.when(text.rlike(_DISSENT), stripped(F.substr(text, dissent_at + 1, F.length(text))))
    split = F.split(main, rf"(?imu)(?={_ORDERS})", 2)
    orders = F.when(F.size(split) > 1, stripped(F.get(split, F.lit(1))))
    body = F.get(split, F.lit(0))
    pieces = F.split(body, rf"(?imu)(?={_ITEM})")
    items = F.filter(pieces, lambda p: p.rlike(rf"(?iu){_ITEM}"))
    cites = lambda p: F.regexp_count(p, F.lit(r"(?iu)\b(?:art[íi]culos?|ley|c[óo]digo|constituci[óo]n)\b"))
    typed = F.transform(
        items,
        lambda p, i: F.struct((i + 1).cast("int").alias("numero"), F.when(F.regexp_count(p, F.lit(_FACTS)) > cites(p), "HECHO").otherwise("DERECHO").alias("tipo"), stripped(p).alias("texto")),
    )
    seen = F.when(F.size(pieces) > 0, F.nullif(stripped(F.get(pieces, F.lit(0))), F.lit("")))
    return F.struct(
        F.when(~F.coalesce(F.get(pieces, F.lit(0)).rlike(rf"(?iu){_ITEM}"), F.lit(False)), seen).alias("vistos"),
        F.coalesce(typed, F.array().cast("array<struct<numero:int,tipo:string,texto:string>>")).alias("considerandos"),
        orders.alias("resolutiva"), dissent.alias("disidencia"), F.coalesce(orders.rlike(r"(?iu)\bcon\s+costas\b"), F.lit(False)).alias("costas"),
    )


def opinion_parts(text: Column) -> Column:
    """(antecedentes, parrafos, conclusion) of an administrative opinion: what leads up to the first law, the paragraphs, and the last one if it concludes."""
    parts = F.filter(F.split(text, r"\r?\n[ \t]*\r?\n"), lambda p: p.rlike(r"\S"))
    last = F.element_at(parts, -1)
    first = F.filter(parts, lambda p, i: (i == 0) & ~p.rlike(r"(?iu)\bley\b"))
    return F.struct(
        F.when(F.size(first) > 0, stripped(F.get(first, F.lit(0)))).alias("antecedentes"), F.coalesce(F.transform(parts, stripped), F.array().cast("array<string>")).alias("parrafos"),
        F.when((F.size(parts) > 0) & last.rlike(r"(?iu)\b(?:en\s+(?:consecuencia|conclusi[óo]n|m[ée]rito)|por\s+(?:lo\s+)?tanto|se\s+concluye)\b"), stripped(last)).alias("conclusion"),
    )


def base_entry(df: DataFrame, collections: dict[str, str]) -> DataFrame:
    """(id, col, ruta, blob, bytes, titulo, formato) of files (ruta, blob, bytes, texto): the first folder tells the collection, else ``archivo``.

    The title is the first "# " heading, else the file's name made readable; data files and README are rows of the inventory only (no title).
    """
    first = F.substring_index("ruta", "/", 1)
    kinds = F.create_map(*[F.lit(x) for pair in collections.items() for x in pair])
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("ruta", "/"), -1), r"\.[A-Za-z0-9]+$", ""), "[-_]+", " ")
    only = F.col("ruta").rlike(r"(?iu)(?:^|/)readme[^/]*$|\.(?:jsonl?|csv|parquet|gz)$")
    heading = F.regexp_extract("texto", r"(?m)^# +(.+?)\s*$", 1)
    col = F.when(only, "dato").otherwise(F.coalesce(F.try_element_at(kinds, first), F.lit("archivo")))
    return df.select(
        F.concat(col, F.lit(":"), F.regexp_replace(F.regexp_replace(F.regexp_replace("ruta", "^[^/]*/", ""), r"\.md$", ""), " ", "_")).alias("id"), col.alias("col"), "ruta", "blob", "bytes",
        F.when(~only, F.coalesce(F.nullif(heading, F.lit("")), F.initcap(name))).alias("titulo"), F.regexp_extract("ruta", r"\.([A-Za-z0-9]+)$", 1).alias("formato"),
    )


def _bare_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(role), r"(?iu)^(?:rol\s*)?(?:n[°º]\s*)?", ""), r"\.", "")


def supreme_row(text: Column) -> Column:
    """A supreme-court card as (rol, era, fecha, sala, recurso, resultado, origen, ministros): from its bullets, the year of the role where the era is missing, a dash meaning nothing."""
    m = bullets(text)
    value = lambda *names: F.coalesce(*[F.when(~F.trim(m[n]).isin("", "-", "—", "–"), F.trim(m[n])) for n in names])
    role = _bare_role(value("rol"))
    people = F.filter(F.transform(F.split(F.coalesce(value("ministros", "integración"), F.lit("")), r"\s*[,;]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        role.alias("rol"), F.coalesce(value("era").try_cast("int"), F.regexp_extract(role, r"-(\d{4})$", 1).try_cast("int")).alias("era"), iso_date(value("fecha")).alias("fecha"), value("sala").alias("sala"),
        value("recurso").alias("recurso"), value("resultado").alias("resultado"), value("tribunal de origen").alias("origen"), people.alias("ministros"),
    )


def constitutional_row(text: Column) -> Column:
    """A constitutional ruling as (rol, fuente, desalineada, fecha): its number by the document's own evidence.

    The number of the official document counts if the body names it; else the first role that the body
    itself claims in its first 4,000 characters, the document's number, the header's, and 0. ``fuente`` tells which it
    was, ``desalineada`` whether the header says otherwise.
    """
    m = bullets(text)
    body = F.regexp_replace(text, r"(?s)\A.*?\n---\s*\n", "")
    header = F.nullif(F.regexp_extract(_bare_role(m["rol"]), r"(\d+)", 1), F.lit(""))
    official = F.nullif(F.regexp_extract(m["documento oficial"], r"(\d+)(?:\D*)$", 1), F.lit(""))
    own = F.nullif(F.regexp_replace(F.regexp_extract(F.substring(body, 1, 4000), r"(?iu)\brol\s*(?:n[°º]\s*)?(\d{1,2}\.?\d{3}|\d{2,6})\b", 1), r"\.", ""), F.lit(""))
    named = official.isNotNull() & F.contains(F.regexp_replace(body, r"\.", ""), official)
    source = F.when(named, "documento_nombrado").when(own.isNotNull(), "rol_propio").when(official.isNotNull(), "documento").when(header.isNotNull(), "encabezado").otherwise("ninguna")
    number = F.when(named, official).otherwise(F.coalesce(own, official, header, F.lit("0"))).cast("long")
    return F.struct(number.alias("rol"), source.alias("fuente"), F.coalesce(header.cast("long") != number, F.lit(False)).alias("desalineada"), iso_date(F.coalesce(m["fecha"], F.substring(body, 1, 3000))).alias("fecha"))


def environmental_row(path: Column, text: Column) -> Column:
    """An environmental ruling as (tribunal, rol, acumulados, fecha, sintesis, tiene_texto): all roles of the card and the file's name, the first its own."""
    m = bullets(text)
    words = fold(F.concat_ws(" ", path, m["tribunal"]))
    court = F.when(words.rlike(r"\b1ta\b|primer"), "1ta").when(words.rlike(r"\b2ta\b|segundo"), "2ta").when(words.rlike(r"\b3ta\b|tercer"), "3ta")
    roles = F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", m["rol"], F.element_at(F.split(path, "/"), -1)), F.lit(r"([A-Za-z]-\d{1,5}-\d{4})"), F.lit(1)), F.lower))
    body = F.regexp_replace(text, r"(?s)\A.*?\n---\s*\n", "")
    return F.struct(
        court.alias("tribunal"), F.get(roles, F.lit(0)).alias("rol"), F.slice(roles, F.lit(2), F.greatest(F.size(roles), F.lit(1))).alias("acumulados"), iso_date(m["fecha"]).alias("fecha"),
        F.coalesce(fold(path).contains("sintesis"), F.lit(False)).alias("sintesis"), (F.length(body) > 2000).alias("tiene_texto"),
    )


def article_nodes(df: DataFrame, record: str, code: str, text: str) -> DataFrame:
    """(nodo, etiqueta, padre): a node for each article heading of a code's running text, the first of equal numbers, under the code's own node."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(r"(?imu)^\s*art(?:[íi]culo|\.)\s+(\d{1,4}(?:\s+(?:bis|ter|qu[áa]ter))?)\b"), F.lit(1))
    parent = F.concat(F.lit("norma:"), slug(F.col(code)))
    flat = df.select(F.col(record).alias("id"), F.col(code).alias("c"), parent.alias("padre"), F.explode(F.array_distinct(F.transform(numbers, lambda n: F.regexp_replace(squeeze(fold(n)), " ", "-")))).alias("n"))
    out = flat.select(F.concat("padre", F.lit(":"), "n").alias("nodo"), F.concat(F.lit("Artículo "), F.replace("n", F.lit("-"), F.lit(" ")), F.lit(" · "), "c").alias("etiqueta"), "padre")
    return out.groupBy("nodo", "padre").agg(F.min("etiqueta").alias("etiqueta"))


def case_entities(text: Column) -> Column:
    """(fechas, montos, rut, hechos): dates, amounts and tax numbers of a text, each once in order, and up to 15 lines longer than 25 characters that hold a date or an amount."""
    date, money = r"\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b|\b\d{1,2} de [a-záéíóú]+ de \d{4}\b", r"\$ ?\d{1,3}(?:\.\d{3})*|\b\d{1,3}(?:\.\d{3})+ pesos\b|\bUF ?\d+(?:[.,]\d+)*"
    once = lambda pattern: F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), stripped), lambda x: (F.length(x) > 25) & x.rlike(f"{date}|{money}"))
    return F.struct(once(date).alias("fechas"), once(money).alias("montos"), once(r"\b\d{1,2}\.\d{3}\.\d{3}-[0-9kK]\b").alias("rut"), F.slice(F.coalesce(lines, F.array().cast("array<string>")), 1, 15).alias("hechos"))
