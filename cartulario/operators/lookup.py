"""Resolution of names, identifiers and queries, and the lookups built on them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulario.functions.text import content_words, fold, tokens


def nearest_known(df: DataFrame, column: str, known: DataFrame, identifier: str) -> DataFrame:
    """Rows with ``resuelto``, the identifier itself or its nearest ancestor that is known, and ``nivel``, how far up it is.

    An identifier's ancestors are what is left of it without its last parts, all the way up. Unknown ones get nulls.
    """
    parts = F.split(F.col(column), ":")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))
    ids = df.select(column).distinct().filter(F.col(column).isNotNull()).select(column, F.posexplode(up).alias("nivel", "__id"))
    hit = ids.join(known.select(F.col(identifier).alias("__id")).distinct(), "__id", "left_semi")
    best = hit.groupBy(column).agg(F.min(F.struct("nivel", "__id")).alias("__b"))
    return df.join(best, column, "left").select(*df.columns, F.col("__b.__id").alias("resuelto"), F.col("__b.nivel").alias("nivel"))


def article_key(text: Column) -> Column:
    """An article's number as it is looked up: folded, without "artículo" before it and signs after it, single blanks."""
    bare = F.regexp_replace(fold(F.trim(text)), r"^(?:articulos?|arts?\.?)\s*(?:n[°º]\s*)?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[°º]|[.,;:\s-]+$", ""), r"\s+", " "))


def tiered_articles(df: DataFrame, record: str, key: str, text: str, wanted: list[str]) -> DataFrame:
    """(pedido, id, grado): for each wanted article key the row of its best tier, of several the one of smallest id.

    Keys are compared as ``article_key`` has them. Tier 4: the key is the same; 3: it begins with
    the wanted one and a blank; 2: it begins with it; 1: the text speaks of "artículo N". One pass
    over the rows; what is asked for, and the one row a key that comes out, bound what is shuffled.
    """
    k, t = article_key(F.col(key)), fold(F.col(text))

    def graded(asked: Column) -> Column:
        w = article_key(asked)
        tier = F.when(k == w, 4).when(F.startswith(k, F.concat(w, F.lit(" "))), 3).when(F.startswith(k, w), 2).when(F.contains(t, F.concat(F.lit("articulo "), w)), 1)
        return F.struct(asked.alias("pedido"), tier.alias("grado"))

    asked = F.array(*[F.lit(w) for w in dict.fromkeys(wanted)])
    found = df.select(F.col(record).alias("id"), F.inline(F.filter(F.transform(asked, graded), lambda x: x["grado"].isNotNull())))
    best = found.groupBy("pedido").agg(F.min(F.struct((-F.col("grado")).alias("g"), "id")).alias("b"))
    return best.select("pedido", F.col("b.id").alias("id"), (-F.col("b.g")).alias("grado"))


def carried_forward(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Rows whose blank or null columns take the last filled value of earlier rows of their key; ``heredados`` lists which did."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out, taken = df, []
    for c in columns:
        filled = F.when(F.trim(c) != "", F.col(c))
        out = out.withColumn(f"__p_{c}", F.last(filled, ignorenulls=True).over(w)).withColumn(f"__f_{c}", filled)
        taken.append(F.when(F.col(f"__f_{c}").isNull() & F.col(f"__p_{c}").isNotNull(), F.lit(c)))
    kept = [F.coalesce(f"__f_{c}", f"__p_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return out.select(*kept, F.array_compact(F.array(*taken)).alias("heredados"))


# What an identifier in a query looks like.
_ROLE = re.compile(r"(?i)^\s*(?:rol|cs)?\s*(?:n[°ºo.]*)?\s*(\d{1,3}(?:\.\d{3})+|\d{1,7})-(\d{4})\s*$")
_LAW = re.compile(r"(?i)^\s*(?:art(?:[íi]culo|\.)?\s*(\d+)\s+(?:de\s+la\s+)?)?ley\s*(?:n[°ºo.]*)?\s*([\d.]{4,7})\s*$")


def query_ids(query: str, first_year: int = 1900, last_year: int = 2100) -> list[str]:
    """The identifiers that a query consists of, or none if it says anything else."""
    m = _ROLE.match(query)
    if m and first_year <= int(m[2]) <= last_year:
        return [f"cs:{int(m[1].replace('.', ''))}-{m[2]}"]
    m = _LAW.match(query)
    if m:
        body = f"norma:ley-{m[2].replace('.', '')}"
        return [f"{body}:{m[1]}", body] if m[1] else [body]
    return []


def orchestrated(entries: DataFrame, refs: DataFrame, cites: DataFrame, query: str, limit: int) -> DataFrame:
    """Entries for a query: (n, id, paso, peso), exact identifiers first, then who cites them, then those whose title holds all words.

    ``entries`` has n, id and titulo; ``refs`` n and id; ``cites`` destino, origen and n. An entry
    stands at its best step. ``limit`` is of the report.
    """
    wanted = query_ids(query)
    words = [w for w in re.findall(r"[a-z0-9]+", _plain(query)) if len(w) > 1]
    exact = entries.filter(F.col("id").isin(*wanted)).select("n", F.lit(1).alias("paso"), F.lit(0).cast("long").alias("peso"))
    cited = refs.filter(F.col("id").isin(*wanted)).select(F.col("n").alias("destino"))
    citers = cites.join(F.broadcast(cited), "destino").groupBy(F.col("origen").alias("n")).agg(F.sum("n").alias("peso")).select("n", F.lit(2).alias("paso"), "peso")
    held = F.lit(bool(words) and not wanted)
    for w in words:
        held = held & F.array_contains(tokens(F.col("titulo")), w)
    titled = entries.filter(held).select("n", F.lit(3).alias("paso"), F.lit(0).cast("long").alias("peso"))
    best = exact.unionByName(citers).unionByName(titled).groupBy("n").agg(F.min(F.struct("paso", (-F.col("peso")).alias("w"))).alias("__b"))
    out = best.join(entries.select("n", "id"), "n").select("n", "id", F.col("__b.paso").alias("paso"), (-F.col("__b.w")).alias("peso"))
    return out.orderBy("paso", F.desc("peso"), "id", "n").limit(limit)


def _plain(text: str) -> str:
    from cartulario.functions.text import ACCENTED, PLAIN

    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def passages(df: DataFrame, record: str, text: str, terms: list[str], around: int, most: int = 3) -> DataFrame:
    """(id, desde, pasaje): up to ``most`` stretches of ``around`` characters on both sides of folded terms, none overlapping the one before."""
    hits = F.flatten(F.array(*[_places(fold(F.col(text)), t) for t in terms]))
    none = F.struct(F.lit(-(10**6)).alias("last"), F.array().cast("array<int>").alias("k"))

    def step(state: Column, at: Column) -> Column:
        fits = (at - state["last"] > 2 * around) & (F.size(state["k"]) < most)
        return F.struct(F.when(fits, at).otherwise(state["last"]).cast("int").alias("last"), F.when(fits, F.concat(state["k"], F.array(at.cast("int")))).otherwise(state["k"]).alias("k"))

    kept = F.aggregate(F.array_sort(hits), none, step, lambda s: s["k"])
    flat = df.select(F.col(record).alias("id"), F.col(text).alias("__t"), F.explode(kept).alias("__at"))
    begin = F.greatest(F.col("__at") - around, F.lit(1))
    return flat.select("id", begin.alias("desde"), F.substr("__t", begin, F.col("__at") - begin + around).alias("pasaje"))


def _places(text: Column, term: str) -> Column:
    """Places, from 1, at which a folded term stands in a text: lengths of what is between its occurrences, added up."""
    parts = F.split(text, re.escape(_plain(term)))
    n = len(term)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("k"))

    def step(state: Column, part: Column) -> Column:
        at = (state["at"] + F.length(part)).cast("int")
        return F.struct((at + n).alias("at"), F.concat(state["k"], F.array(at)).alias("k"))

    return F.aggregate(parts, start, step, lambda s: F.slice(s["k"], 1, F.greatest(F.size(s["k"]) - 1, F.lit(0))))


def ranked_paragraphs(df: DataFrame, record: str, paragraph: str, order: str, terms: list[str], phrase: str, legal: list[str]) -> DataFrame:
    """(id, orden, puntaje): the best paragraph of each text: 15 for each term held, 60 for the phrase, 20 for a legal word, 15 for a citation."""
    t = fold(F.col(paragraph))
    score = sum((F.contains(t, F.lit(_plain(w))).cast("int") * 15 for w in terms), F.lit(0))
    score = score + F.contains(t, F.lit(_plain(phrase))).cast("int") * 60 + t.rlike("|".join(map(re.escape, map(_plain, legal)))).cast("int") * 20 + t.rlike(r"\bart(?:iculo|\.)\s*\d+").cast("int") * 15
    scored = df.select(F.col(record).alias("id"), F.col(order).alias("orden"), score.alias("puntaje"))
    return scored.groupBy("id").agg(F.min(F.struct((-F.col("puntaje")).alias("m"), "orden")).alias("__b")).select("id", F.col("__b.orden").alias("orden"), (-F.col("__b.m")).alias("puntaje"))


def stem_score(df: DataFrame, record: str, text: str, query: str) -> DataFrame:
    """(id, grado) of texts that hold the query as a phrase (2) or all of its words but for a plural ending (1)."""
    light = lambda w: F.regexp_replace(w, "(?:es|s)$", "")
    wanted = F.array_distinct(F.transform(content_words(F.lit(query)), light))
    held = F.transform(tokens(F.col(text)), light)
    phrase = F.contains(fold(F.col(text)), F.lit(_plain(query)))
    grade = F.when(phrase, 2).when(F.size(F.array_except(wanted, held)) == 0, 1)
    return df.select(F.col(record).alias("id"), grade.alias("grado")).filter("grado IS NOT NULL")


def merged_sources(sources: dict[str, DataFrame], key: str, content: str) -> DataFrame:
    """Rows of several sources without those of equal content (the first source wins), names that stand for different contents told apart.

    Columns: key, content, ``fuente`` and ``nombre``, the key or, for all but the first of equal keys, the key and a piece of the content's hash.
    """
    parts = [df.select(F.col(key).alias(key), F.col(content).alias(content), F.lit(i).alias("__o"), F.lit(name).alias("fuente")) for i, (name, df) in enumerate(sources.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.withColumn("__h", F.sha2(content, 256))
    one = both.withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy("__o", key))).filter("__n = 1").drop("__n")
    ranked = one.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__o", "__h")))
    name = F.when(F.col("__n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("-"), F.substring("__h", 1, 8)))
    return ranked.select(key, content, "fuente", name.alias("nombre"))


def filtered_or_hint(df: DataFrame, record: str, holds: Column, hint: Column) -> DataFrame:
    """(id, aviso): the rows for which ``holds``, or one row without id whose notice lists the values of ``hint`` in order if there are none.

    The values of a hint are few by nature (rooms, regions); they are distinct before they are gathered.
    """
    found = df.filter(F.coalesce(holds, F.lit(False))).select(F.col(record).alias("id"), F.lit(None).cast("string").alias("aviso"))
    none = found.agg((F.count(F.lit(1)) == 0).alias("__none"))
    values = df.select(hint.alias("v")).filter("v <> ''").distinct().agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("v"))
    notice = values.join(F.broadcast(none)).filter("__none AND v <> ''")
    return found.unionByName(notice.select(F.lit(None).cast(df.schema[record].dataType).alias("id"), F.concat(F.lit("disponibles: "), "v").alias("aviso")))
