"""Readers of corpus files: inventories, JSON lines, Markdown trees, graphs, XML, HTML and word-processor files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inventory(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(ruta, blob, bytes) of every file below a folder, but those whose relative path begins with an excluded prefix.

    ``blob`` is the id that git gives to the content; files are hashed where they are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.regexp_replace(root, f"^{re.escape(folder.rstrip('/'))}/", "")
    head = F.encode(F.concat(F.lit("blob "), F.col("length").cast("string"), F.lit("\0")), "UTF-8")
    out = raw.select(rel.alias("ruta"), F.sha1(F.concat(head, F.col("content"))).alias("blob"), F.col("length").alias("bytes"))
    for prefix in excluded:
        out = out.filter(~F.col("ruta").startswith(prefix))
    return out


def _file_path(uri: Column) -> Column:
    """A path without its scheme and doubled slashes, blanks and other signs as they are: two ways to name one file agree, two files never do."""
    return F.regexp_replace(F.url_decode(F.replace(F.regexp_replace(uri, "^[a-z0-9]+:/+", "/"), F.lit("+"), F.lit("%2B"))), "/+", "/")


def json_lines(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Rows of line-delimited JSON files, plain or gzipped, with ``archivo``, ``orden`` (of the path in the list), ``linea`` and ``mala``.

    Blank lines are no rows. A line that is no JSON object keeps its text in ``mala``, other
    fields null, so that bad lines can be counted; missing fields are null.
    """
    raw = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("archivo"), F.monotonically_increasing_id().alias("linea"))
    order = F.lit(len(paths))
    for i, p in reversed(list(enumerate(paths))):
        order = F.when(_file_path(F.col("archivo")) == _file_path(F.lit(p)), i).otherwise(order)
    lines = raw.filter(F.trim("value") != "").withColumn("orden", order)
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("__r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    no_object = ~F.trim("value").startswith("{")
    bad = F.when(no_object | F.col("__r._corrupt_record").isNotNull(), F.col("value"))
    return parsed.select("archivo", "orden", "linea", bad.alias("mala"), *[F.col(f"__r.`{f.name}`").alias(f.name) for f in schema.fields])


def first_by_precedence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the good rows of ``json_lines`` the first of each key: by order of the files, then of the lines."""
    w = Window.partitionBy(*keys).orderBy("orden", "linea")
    return rows.filter("mala IS NULL").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def markdown_tree(spark: SparkSession, folder: str, skipped: tuple[str, ...] = ("README.md",)) -> DataFrame:
    """(ruta, categoria, titulo, texto, bytes, palabras) of every Markdown file below a folder.

    The title is the first "# " heading or the file's name made readable; the category is
    the name of its folder. Files and folders named in ``skipped`` are left out.
    """
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    rel = F.regexp_replace(path, f"^{re.escape(folder.rstrip('/'))}/", "")
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    heading = F.regexp_extract(F.col("value"), r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    readable = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "[-_]+", " ")))
    out = raw.select(
        rel.alias("ruta"),
        F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("categoria"),
        F.when(heading != "", heading).otherwise(readable).alias("titulo"),
        F.col("value").alias("texto"),
        F.octet_length("value").cast("long").alias("bytes"),
        F.regexp_count("value", F.lit(r"\S+")).cast("long").alias("palabras"),
    )
    return out.filter(~F.exists(F.split("ruta", "/"), lambda p: p.isin(*skipped)))


def front_matter(text: Column) -> Column:
    """(datos, cuerpo): the ``key: value`` lines between the first two ``---`` as a map, keys in lower case, and the text after them.

    Indented "- item" lines under a key and inline lists are joined with "; ". The first of
    repeated keys counts. A text without such a head gives an empty map and itself.
    """
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    has = text.rlike(r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)")
    joined = F.regexp_replace(F.regexp_replace(head, r"\r?\n[ \t]*-[ \t]+", "; "), r"(?m)^([^:\n]+):[ \t]*; ", "$1: ")
    pairs = F.filter(F.split(joined, r"\r?\n"), lambda x: x.rlike(r"^\s*[^:#\s][^:]*:"))
    keys = F.transform(pairs, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
    values = F.transform(pairs, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\[\"']|[\]\"']$", ""))
    data = _first_of_each(keys, values)
    body = F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.when(has, data).otherwise(none).alias("datos"), body.alias("cuerpo"))


def _first_of_each(keys: Column, values: Column) -> Column:
    """A map of two arrays in which the first of repeated keys counts."""
    both = F.arrays_zip(keys.alias("k"), values.alias("v"))
    kept = F.filter(both, lambda x, i: (F.array_position(keys, x["k"]) == i + 1))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))


def bullets(text: Column, within: int = 6000) -> Column:
    """A map of the ``- **Key:** value`` items in the first ``within`` characters, several on a line parted by " · "; first ones count."""
    head = F.substring(text, 1, within)
    item = r"\*\*([^*:\n]+):\*\*[ \t]*([^\n]*?)[ \t]*(?= · |\r?\n|$)"
    keys = F.transform(F.regexp_extract_all(head, F.lit(item), F.lit(1)), lambda k: F.lower(F.trim(k)))
    return _first_of_each(keys, F.transform(F.regexp_extract_all(head, F.lit(item), F.lit(2)), lambda v: F.trim(v)))


def node_link_graph(spark: SparkSession, path: str, node: T.StructType, edge: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one JSON document with ``nodes`` and ``edges`` or ``links``."""
    schema = T.StructType([T.StructField("nodes", T.ArrayType(node)), T.StructField("edges", T.ArrayType(edge)), T.StructField("links", T.ArrayType(edge))])
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    return raw.select(F.inline("nodes")), raw.select(F.inline(F.coalesce("edges", "links")))


def _unescaped(text: Column) -> Column:
    """The five named entities of XML as characters, the ampersand last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def law_xml(xml: Column) -> Column:
    """(titulo, organismo, numero, articulos) of a law in XML, prefixes aside: first of several places for each, parts as (tipo, id, texto)."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"<(/?)[A-Za-z0-9_]+:", "<$1"), r"\sxmlns(?::\w+)?=\"[^\"]*\"", "")

    def first(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.xpath_string(bare, F.lit(p))), F.lit("")) for p in paths])

    # Cut at each opening of a part, so that a part without a text takes none from the next; a part's own text stands before the parts in it.
    pieces = F.slice(F.split(bare, r"(?=<EstructuraFuncional\b)"), 2, 1_000_000_000)
    tag = lambda p, name: F.nullif(F.regexp_extract(p, rf"^<EstructuraFuncional\b[^>]*\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    own = lambda p: F.regexp_extract(p, r"(?s)<Texto\b[^>/]*>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</Texto>", 1)
    text = lambda p: F.when(p.rlike(r"<Texto\b[^>/]*>"), F.trim(_unescaped(F.regexp_replace(own(p), "<[^>]*>", ""))))
    parts = F.transform(pieces, lambda p: F.struct(tag(p, "tipoParte").alias("tipo"), tag(p, "idParte").alias("id"), text(p).alias("texto")))
    return F.struct(
        first("//Metadatos/TituloNorma", "//Encabezado/Titulo", "//Titulo").alias("titulo"), first("//Organismo", "//OrganismosEmisores/Organismo").alias("organismo"),
        first("//Identificador/Numero", "//Numero").alias("numero"), parts.alias("articulos"),
    )


# The character entities that index pages use.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&ntilde;": "ñ"}


def html_text(html: Column) -> Column:
    """The text of a piece of HTML: tags out, entities read, single blanks."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, letter in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_rows(html: Column) -> Column:
    """An array of (celdas, enlace) for the rows of the tables of a page: texts of cells, and the first link; rows without text are left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))

    def row(r: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), html_text)
        link = F.regexp_extract(r, r"(?is)<a\b[^>]*href=[\"']([^\"']+)[\"']", 1)
        return F.struct(cells.alias("celdas"), F.when(link != "", link).alias("enlace"))

    return F.filter(F.transform(rows, row), lambda r: F.exists(r["celdas"], lambda c: c != ""))


def absolute(link: Column, base: str) -> Column:
    """A link made absolute: those with a scheme stay, "//host" gets one, "/path" the host of ``base``, others its folder."""
    host = re.match(r"^(\w+://[^/]+)", base)
    root = host[1] if host else base
    folder = base if base.endswith("/") else base.rsplit("/", 1)[0] + "/"
    return (
        F.when(link.rlike(r"^\w+:"), link)
        .when(link.startswith("//"), F.concat(F.lit(root.split("//")[0]), link))
        .when(link.startswith("/"), F.concat(F.lit(root), link))
        .otherwise(F.concat(F.lit(folder), link))
    )


def documents_in(spark: SparkSession, folder: str) -> DataFrame:
    """(ruta, texto, estado) of the .txt, .md and .docx files below a folder, one task per group of files.

    Plain files are UTF-8, else Latin-1; of a .docx each paragraph becomes a line. Other
    files and broken archives come with a null text and the reason as ``estado``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                text, state = _text_of(path, bytes(content))
                out.append((path, text, state))
            yield pd.DataFrame(out, columns=["ruta", "texto", "estado"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return raw.mapInPandas(run, "ruta string, texto string, estado string")


def _text_of(path: str, content: bytes) -> tuple[str | None, str]:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("txt", "md"):
        try:
            return content.decode("utf-8"), "ok"
        except UnicodeDecodeError:
            return content.decode("latin-1"), "latin-1"
    if kind == "docx":
        try:
            xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8")
        except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
            return None, "archivo roto"
        paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
        lines = ["".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S)) for p in paragraphs]
        return "\n".join(x.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") for x in lines), "ok"
    return None, "tipo desconocido"


def page_profile(pages: DataFrame, record: str, text: str, least: int = 80) -> DataFrame:
    """Per file: pages, pages with more than ``least`` characters, their upper median of characters, and whether at least half have text."""
    size = F.coalesce(F.length(F.trim(text)), F.lit(0))
    counted = pages.groupBy(record).agg(
        F.count(F.lit(1)).alias("paginas"), F.count_if(size > least).alias("con_texto"), F.array_sort(F.collect_list(size)).alias("__s")
    )
    median = F.element_at("__s", (F.floor(F.size("__s") / 2) + 1).cast("int"))
    return counted.select(record, "paginas", "con_texto", median.alias("mediana"), (F.col("con_texto") * 2 >= F.col("paginas")).alias("capa_de_texto"))


def split_role_query(query: str) -> dict[str, str]:
    """A query that is wholly a role, "123-2024", as conditions on role and era; any other as free text."""
    m = re.fullmatch(r"\s*(\d{1,7})-(\d{4})\s*", query)
    return {"rol": m[1], "era": m[2]} if m else {"texto": query}
