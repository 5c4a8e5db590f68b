"""Table-valued extraction: sections, paragraphs, items, articles, mentions and header clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(df: DataFrame, record: str, text: str, level: int = 2) -> DataFrame:
    """(id, orden, titulo, cuerpo): the parts of Markdown texts under headings of a level; what stands before the first has a null title."""
    mark = "#" * level
    pieces = F.split(F.col(text), rf"(?m)^(?={mark} )")
    flat = df.select(F.col(record).alias("id"), F.posexplode(pieces).alias("orden", "p")).filter(F.col("p").rlike(r"\S"))
    title = F.regexp_extract("p", rf"\A{mark} +([^\n]*)", 1)
    return flat.select("id", "orden", F.when(title != "", F.trim(title)).alias("titulo"), stripped(F.regexp_replace("p", rf"\A{mark} +[^\n]*\n?", "")).alias("cuerpo"))


def section_index(df: DataFrame, record: str, text: str, most: int = 80) -> DataFrame:
    """(id, orden, nivel, titulo) of the first ``most`` headings of levels 1 to 3."""
    heads = F.slice(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^#{1,3} +[^\n]+"), F.lit(0)), 1, most)
    flat = df.select(F.col(record).alias("id"), F.posexplode(heads).alias("orden", "h"))
    return flat.select("id", "orden", F.length(F.regexp_extract("h", "^#+", 0)).alias("nivel"), F.trim(F.regexp_replace("h", "^#+ +", "")).alias("titulo"))


def paragraphs(df: DataFrame, record: str, text: str) -> DataFrame:
    """(id, orden, parrafo): the parts of texts between blank lines, list marks and numbers at their start taken off; lines if there is but one part."""
    by_blank = F.filter(F.split(F.col(text), r"\r?\n[ \t]*\r?\n"), lambda p: p.rlike(r"\S"))
    by_line = F.filter(F.split(F.col(text), r"\r?\n"), lambda p: p.rlike(r"\S"))
    parts = F.when(F.size(by_blank) > 1, by_blank).otherwise(by_line)
    flat = df.select(F.col(record).alias("id"), F.posexplode(parts).alias("orden", "p"))
    return flat.select("id", (F.col("orden") + 1).alias("orden"), stripped(F.regexp_replace("p", r"^\s*(?:[-*•]|\d+[.)°]|[a-z]\))\s+", "")).alias("parrafo"))


def articles(df: DataFrame, record: str, text: str, most: int = 12_000) -> DataFrame:
    """(id, orden, numero, texto): running text of a law cut at its article headings, each part at most ``most`` characters long."""
    pieces = F.split(F.col(text), r"(?imu)^(?=art(?:[íi]culo|\.)\s+\d+)")
    flat = df.select(F.col(record).alias("id"), F.posexplode(pieces).alias("orden", "p"))
    number = F.regexp_extract("p", r"(?iu)\Aart(?:[íi]culo|\.)\s+(\d+)", 1)
    return flat.filter(number != "").select("id", "orden", number.alias("numero"), F.substring("p", 1, most).alias("texto"))


def article_mentions(df: DataFrame, record: str, text: str) -> DataFrame:
    """(id, codigo, articulo, veces): articles of codes that prose refers to, "artículo 12 del Código Penal"."""
    pattern = r"(?iu)art[íi]culos?\s+(\d+)\s+del\s+(código\s+(?:de\s+)?\p{L}+(?:\s+de\s+\p{L}+)?|cpr)"
    text = F.col(text)
    numbers, names = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    zipped = F.arrays_zip(numbers.alias("articulo"), names.alias("codigo"))
    flat = df.select(F.col(record).alias("id"), F.inline(zipped))
    return flat.groupBy("id", F.lower("codigo").alias("codigo"), "articulo").agg(F.count(F.lit(1)).alias("veces"))


def without_running_lines(df: DataFrame, record: str, text: str, times: int = 6) -> DataFrame:
    """(id, texto): texts without lines of 6 to 89 characters that stand in them at least ``times`` times, and without lone page numbers.

    All is within a row, so nothing is shuffled: the sorted lines of a text bring equal ones
    together, and those that stand ``times`` apart in that order are the running ones. Null texts
    give no row, a text of which nothing stays comes out empty.
    """
    slim = df.select(F.col(record).alias("id"), F.split(F.col(text), r"\r?\n").alias("l")).filter("l IS NOT NULL")
    # Through a generator, so that the lines are sorted once.
    ordered = slim.select("id", "l", F.explode(F.array(F.array_sort(F.transform("l", lambda x: F.trim(x))))).alias("s"))
    runs = F.array_distinct(F.filter("s", lambda x, i: F.length(x).between(6, 89) & (F.get("s", i + times - 1) == x)))
    found = ordered.select("id", "l", F.explode(F.array(runs)).alias("r"))
    stays = F.filter("l", lambda x: ~F.array_contains("r", F.trim(x)) & ~x.rlike(r"^\s*\d{1,4}\s*$"))
    return found.select("id", F.array_join(stays, "\n").alias("texto"))


def kept_spans(spans: Column) -> Column:
    """Of an array of (desde, hasta) the spans that do not overlap: by start, the longer first; each kept if it begins at or after the end of the last kept."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["desde"].alias("desde"), (-s["hasta"]).alias("m"))))
    kind = "array<struct<desde:int,hasta:int>>"
    none = F.struct(F.lit(-1).alias("fin"), F.array().cast(kind).alias("k"))

    def step(state: Column, s: Column) -> Column:
        fits = s["desde"] >= state["fin"]
        one = F.array(F.struct(s["desde"].cast("int").alias("desde"), (-s["m"]).cast("int").alias("hasta")))
        return F.struct(F.when(fits, (-s["m"]).cast("int")).otherwise(state["fin"]).alias("fin"), F.when(fits, F.concat(state["k"], one)).otherwise(state["k"]).alias("k"))

    return F.aggregate(ordered, none, step, lambda s: s["k"])
