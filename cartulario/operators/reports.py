"""Reports, choices and identities of records: samples, revisions, collisions, chains, candidates and elections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulario.operators.relational import first_wins


def distinct_sample(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows in order, of each key only the first: the report's size bounds what is brought together."""
    return first_wins(df, [key], order).orderBy(*order).limit(most)


def pruned_revisions(df: DataFrame, key: str, order: list[Column], keep: int, record: str, referenced: DataFrame) -> DataFrame:
    """The newest ``keep`` rows of each key and those that are referenced (column ``record``), whatever their age."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    used = referenced.select(F.col(record).alias("__r")).distinct().withColumn("__used", F.lit(True))
    return ranked.join(used, F.col(record) == F.col("__r"), "left").filter((F.col("__n") <= keep) | F.col("__used")).select(*df.columns)


def resolved_ids(df: DataFrame, identifier: str, path: str, synthesis: Column) -> DataFrame:
    """Unique ids: of equal ones a row that is no synthesis and then the smallest path keeps it; the others are told apart.

    A synthesis gets ``:sintesis``, others the name of their file; what is still equal then gets ``-2`` and so on, in
    the order of the paths. Adds ``id_unico``, and ``id_base`` and ``calidad`` (``id_repetido``) for those that lost theirs.
    """
    first = df.withColumn("__s", F.coalesce(synthesis, F.lit(False))).withColumn("__n", F.row_number().over(Window.partitionBy(identifier).orderBy("__s", path)))
    name = F.regexp_replace(F.lower(F.element_at(F.split(F.col(path), "/"), -1)), r"\.[a-z0-9]+$", "")
    lost = F.col("__n") > 1
    made = F.when(~lost, F.col(identifier)).when(F.col("__s"), F.concat(identifier, F.lit(":sintesis"))).otherwise(F.concat(identifier, F.lit(":"), F.regexp_replace(name, "[^a-z0-9]+", "-")))
    named = first.withColumn("__made", made).withColumn("__k", F.row_number().over(Window.partitionBy("__made").orderBy("__n", path)))
    unique = F.when(F.col("__k") > 1, F.concat("__made", F.lit("-"), F.col("__k").cast("string"))).otherwise(F.col("__made"))
    return named.select(*df.columns, unique.alias("id_unico"), F.when(lost, F.col(identifier)).alias("id_base"), F.when(lost, F.lit("id_repetido")).alias("calidad"))


def chain_audit(df: DataFrame, key: str, year: str, owner: str, seller: str, as_of: int, years: int) -> DataFrame:
    """(key, titulos, quiebres, cubre) of chains of titles: how many there are, how often the seller is not the owner before, and whether they reach back ``years`` from ``as_of``."""
    w = Window.partitionBy(key).orderBy(year, owner, seller)
    before = F.lag(owner).over(w)
    marked = df.select(key, year, (before.isNotNull() & ~F.col(seller).eqNullSafe(before)).alias("__b"))
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("titulos"), F.count_if("__b").alias("quiebres"), (F.lit(as_of) - F.min(year) >= years).alias("cubre"))


def ordered_candidates(sources: list[DataFrame], key: str, limit: int) -> DataFrame:
    """(key, fuente, lugar) of candidates from several sources in the order of the list, within a source by ``lugar``; the first of equal keys, ``limit`` of them."""
    parts = [s.select(key, F.lit(i).alias("fuente"), "lugar") for i, s in enumerate(sources)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    best = both.groupBy(key).agg(F.min(F.struct("fuente", "lugar")).alias("b"))
    return best.select(key, "b.fuente", "b.lugar").orderBy("fuente", "lugar", key).limit(limit)


def elected(df: DataFrame, key: str, signals: dict[str, Column]) -> DataFrame:
    """(key, materia, senales, aviso): the subject of most signals, the first declared of equals; a warning tells of ties and of a single signal."""
    counted = F.array(*[F.struct((-c.cast("int")).alias("c"), F.lit(i).alias("i"), F.lit(name).alias("m")) for i, (name, c) in enumerate(signals.items())])
    ranked = F.array_sort(counted)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    note = F.when(first["c"] == 0, "sin señales").when(first["c"] == second["c"], "empate").when(first["c"] == -1, "una sola señal")
    return df.select(key, F.when(first["c"] < 0, first["m"]).alias("materia"), (-first["c"]).alias("senales"), note.alias("aviso"))


def best_overlap(asked: DataFrame, question: str, known: DataFrame, identifier: str, words: str) -> DataFrame:
    """(pregunta, id, comunes): for each array of words the known row that shares most of them, at least one, the smallest id of equals. Words are joined, so only rows that share one meet."""
    q = asked.select(F.col(question).alias("pregunta"), F.explode(F.array_distinct(F.split(question, " "))).alias("w"))
    k = known.select(F.col(identifier).alias("id"), F.explode(F.array_distinct(words)).alias("w"))
    shared = k.join(F.broadcast(q), "w").groupBy("pregunta", "id").agg(F.count(F.lit(1)).alias("c"))
    best = shared.groupBy("pregunta").agg(F.min(F.struct((-F.col("c")).alias("c"), "id")).alias("b"))
    return best.select("pregunta", "b.id", (-F.col("b.c")).alias("comunes"))


def top_labels(df: DataFrame, key: str, value: str, weight: str, label: Column, k: int) -> DataFrame:
    """(key, etiquetas): the ``k`` values of most weight of each key, ties by value, written out and joined."""
    w = Window.partitionBy(key).orderBy(F.desc(weight), value)
    best = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).withColumn("__l", label)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__l"))), lambda x: x["__l"]), "; ").alias("etiquetas"))


def last_written(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """One row of each key from several frames of equal columns: of the last frame that has it the row of largest ``order``."""
    both = None
    for i, s in enumerate(sources):
        part = s.withColumn("__i", F.lit(i))
        both = part if both is None else both.unionByName(part)
    return first_wins(both, [key], [F.desc("__i"), F.desc(order)]).drop("__i")
