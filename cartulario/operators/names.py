"""Joins of texts and records by names, keys and rules, and rows of harvested files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulario.functions.text import fold, slug, tokens
from cartulario.operators.relational import first_wins


def names_in_text(texts: DataFrame, record: str, text: str, names: DataFrame, name_id: str, name: str, shortest: int = 5) -> DataFrame:
    """(id, nombre_id, veces) for every name of a table that stands in a text, folded, as whole words.

    An equi-join on pairs of neighbouring words takes the place of every text with every name:
    each name is looked up by its rarest pair (or its only word), so frequent pairs join little;
    only candidates are verified, against the words of the text. Names shorter than ``shortest`` letters are no names.
    """
    n = names.select(F.col(name_id).alias("nombre_id"), tokens(F.col(name)).alias("w")).filter(F.length(F.array_join("w", " ")) >= shortest)
    n = n.dropDuplicates(["nombre_id", "w"])

    def keys(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))
        return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(w)

    t = texts.select(F.col(record).alias("id"), tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    words, pairs = F.array_distinct("t"), F.when(F.size("t") > 1, keys(F.col("t"))).otherwise(F.array().cast("array<string>"))
    held = t.select("id", F.explode(F.array_distinct(F.concat(words, pairs))).alias("k"))
    known = n.select("nombre_id", "w", F.explode(keys(F.col("w"))).alias("k"))
    seen = held.join(known.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("f"))
    rare = known.join(seen, "k").groupBy("nombre_id", "w").agg(F.min(F.struct("f", "k")).alias("b")).select("nombre_id", "w", F.col("b.k").alias("k"))
    found = held.join(rare, "k").select("id", "nombre_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("__w"))
    # The candidates of a text come back to it once, as an array of names that it may hold.
    whole = t.select("id", F.concat(F.lit(" "), F.array_join("t", "  "), F.lit(" ")).alias("__t"))
    checked = found.join(whole.dropDuplicates(["id"]), "id")
    double = F.replace(F.trim("__w"), F.lit(" "), F.lit("  "))
    size = F.length("__t") - F.length(F.replace("__t", F.concat(F.lit(" "), double, F.lit(" ")), F.lit("")))
    times = (size / (F.length(double) + 2)).cast("int")
    return checked.select("id", "nombre_id", times.alias("veces")).filter("veces > 0")


def rule_edges(df: DataFrame, record: str, text: str, rules: DataFrame) -> DataFrame:
    """(src, dst, rel) of every rule (palabra, dst, rel) whose keyword stands in the text, once each.

    The rules are a small table by nature; they go to the tasks as one array, so that texts do not move.
    """
    table = rules.select(fold("palabra").alias("k"), "dst", "rel").distinct().agg(F.sort_array(F.collect_list(F.struct("k", "dst", "rel"))).alias("__rules"))
    both = df.select(F.col(record).alias("src"), fold(F.col(text)).alias("__t")).join(F.broadcast(table))
    held = F.filter("__rules", lambda r: F.coalesce(F.contains("__t", r["k"]), F.lit(False)))
    return both.select("src", F.inline(F.array_distinct(F.transform(held, lambda r: F.struct(r["dst"].alias("dst"), r["rel"].alias("rel"))))))


def attached(left: DataFrame, key: str, right: DataFrame, foreign: str, order: list[str], most: int) -> DataFrame:
    """Rows with ``adjuntos``, the first ``most`` right rows of their key in order as an array of structs, and ``total``, how many there are."""
    order_by = [F.col(c) for c in order]
    ranked = right.withColumn("__n", F.row_number().over(Window.partitionBy(foreign).orderBy(*order_by))).filter(F.col("__n") <= most)
    lists = ranked.groupBy(F.col(foreign).alias("__k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", *order))), lambda x: F.struct(*[x[c].alias(c) for c in order])).alias("adjuntos"))
    totals = right.groupBy(F.col(foreign).alias("__f")).agg(F.count(F.lit(1)).alias("total"))
    out = left.join(lists, F.col(key) == F.col("__k"), "left").join(totals, F.col(key) == F.col("__f"), "left")
    kind = lists.schema["adjuntos"].dataType
    return out.select(*left.columns, F.coalesce("adjuntos", F.array().cast(kind)).alias("adjuntos"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))


def batch_resolved(asked: list[str], known: DataFrame, key: str, value: str) -> DataFrame:
    """(lugar, pedido, valor, falta): each asked key in its order with its value, every distinct one looked up once; missing ones say so."""
    spark = known.sparkSession
    wanted = spark.createDataFrame(list(enumerate(asked)), "lugar int, pedido string")
    found = first_wins(known.join(F.broadcast(wanted.select("pedido").distinct()), F.col(key) == F.col("pedido"), "left_semi").select(key, value), [key], [F.col(value)])
    out = wanted.join(F.broadcast(found), F.col("pedido") == F.col(key), "left")
    return out.select("lugar", "pedido", F.col(value).alias("valor"), F.col(key).isNull().alias("falta"))


def candidate_ids(df: DataFrame, name: str, known: DataFrame, identifier: str, prefixes: list[str]) -> DataFrame:
    """(nombre, id, orden): of the identifiers that a name could have under each prefix those that exist, and the first one (orden 0) if none does."""
    named = df.select(F.col(name).alias("nombre")).filter("nombre IS NOT NULL").distinct()
    made = F.array(*[F.concat(F.lit(f"{p}:"), slug(F.col("nombre"))) for p in prefixes])
    asked = named.select("nombre", F.posexplode(made).alias("orden", "id"))
    there = asked.join(known.select(F.col(identifier).alias("id")).distinct(), "id", "left_semi")
    none = asked.filter("orden = 0").join(there.select("nombre").distinct(), "nombre", "left_anti")
    return there.select("nombre", "id", (F.col("orden") + 1).alias("orden")).unionByName(none.select("nombre", "id", F.lit(0).alias("orden")))


def catalogue_hits(df: DataFrame, record: str, title: str, body: str, words: list[str], limit: int) -> DataFrame:
    """(id, puntos): additive scores of catalogue rows: 2 for each word in the body, 10 in the title, 5 more at its start, 25 for the whole phrase; the best ``limit``."""
    t, b = F.coalesce(fold(F.col(title)), F.lit("")), F.coalesce(fold(F.col(body)), F.lit(""))
    points = F.contains(t, F.lit(" ".join(words))).cast("int") * 25
    for w in words:
        points = points + F.contains(b, F.lit(w)).cast("int") * 2 + F.contains(t, F.lit(w)).cast("int") * 10 + t.startswith(w).cast("int") * 5
    return df.select(F.col(record).alias("id"), points.alias("puntos")).filter("puntos > 0").orderBy(F.desc("puntos"), "id").limit(limit)


def field_search(df: DataFrame, record: str, fields: dict[str, tuple[str, float]], words: list[str], prefix: int = 4, share: float = 0.45) -> DataFrame:
    """(id, puntos): BM25-like scores over the words of fields, each of its weight, whole numbers of hundredths.

    A word that stands in no record at all is looked up by its first ``prefix`` letters at ``share``
    of the weight. idf is ln(1 + (N - n + 0.5) / (n + 0.5)), at least 0.5. Two passes: one row of
    statistics, then scores where the rows are read.
    """
    cut = df.select(F.col(record).alias("id"), *[F.array_distinct(tokens(F.col(c))).alias(f"__{n}") for n, (c, _) in fields.items()])
    every = F.concat(*[F.col(f"__{n}") for n in fields])
    starts = lambda a, w: F.exists(a, lambda x: x.startswith(w[:prefix]))
    counts = [F.count_if(F.array_contains(every, w)).alias(f"__n{i}") for i, w in enumerate(words)] + [F.count_if(starts(every, w)).alias(f"__p{i}") for i, w in enumerate(words)]
    stats = cut.agg(F.count(F.lit(1)).alias("__all"), *counts)
    both = cut.join(F.broadcast(stats))
    points = F.lit(0.0)
    for i, w in enumerate(words):
        exact = F.col(f"__n{i}") > 0
        n = F.when(exact, F.col(f"__n{i}")).otherwise(F.col(f"__p{i}"))
        idf = F.greatest(F.log(1 + (F.col("__all") - n + 0.5) / (n + 0.5)), F.lit(0.5))
        weight = sum((F.when(F.when(exact, F.array_contains(f"__{f}", w)).otherwise(starts(F.col(f"__{f}"), w)), k).otherwise(0.0) for f, (_, k) in fields.items()), F.lit(0.0))
        points = points + idf * weight * F.when(exact, 1.0).otherwise(share)
    return both.select("id", F.bround(points * 100, 0).cast("long").alias("puntos")).filter("puntos > 0")


def resolved_node(nodes: DataFrame, query: str, degree: DataFrame) -> DataFrame:
    """(paso, id) of the one node that a query means, by the first step that finds any: its id (1), its whole label (2), a label that holds it (3), a definition that holds it (4).

    ``nodes`` has id, etiqueta and definicion; ``degree`` nodo and grado. In a step the node of most edges wins,
    then the shortest label, then the id. No row if no step finds any.
    """
    q = F.trim(fold(F.lit(query)))
    label, text = F.trim(fold("etiqueta")), fold("definicion")
    step = F.when(fold("id") == q, 1).when(label == q, 2).when(F.contains(label, q), 3).when(F.contains(text, q), 4)
    hit = nodes.select("id", "etiqueta", step.alias("paso")).filter("paso IS NOT NULL")
    ranked = hit.join(degree.select(F.col("nodo").alias("id"), "grado"), "id", "left")
    order = F.struct("paso", (-F.coalesce("grado", F.lit(0))).alias("g"), F.length("etiqueta").alias("l"), "id")
    return ranked.agg(F.min(order).alias("b")).filter("b IS NOT NULL").select("b.paso", "b.id")
