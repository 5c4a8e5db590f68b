"""Views and upkeep of graphs: cards, explanations, cuts, community summaries, aliases, merges and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulario.functions.text import fold


def _ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= k)


def node_cards(edges: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int = 12) -> DataFrame:
    """(nodo, etiqueta, grado, ficha): a card of each wanted node (column ``nodo``): its label, how many edges it has, and by kind its first ``k`` neighbours in order.

    ``nodes`` has nodo, etiqueta and tipo. Only edges of wanted nodes are read on; the card is lines of
    ``kind (count): neighbours``, kinds in order. A node without edges has a card without lines.
    """
    asked = wanted.select("nodo").distinct()
    out = edges.join(asked, F.col("src") == F.col("nodo")).select("nodo", F.col("dst").alias("v"))
    come = edges.join(asked, F.col("dst") == F.col("nodo")).select("nodo", F.col("src").alias("v"))
    near = out.unionByName(come).distinct().join(nodes.select(F.col("nodo").alias("v"), F.col("etiqueta").alias("e"), "tipo"), "v")
    counts = near.groupBy("nodo", "tipo").agg(F.count(F.lit(1)).alias("c"))
    lists = _ranked(near, ["nodo", "tipo"], [F.col("e"), F.col("v")], k).groupBy("nodo", "tipo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "e"))), lambda x: x["e"]), ", ").alias("l"))
    # Kinds are few by nature: one line for each.
    lines = lists.join(counts, ["nodo", "tipo"]).select("nodo", "c", "tipo", F.concat("tipo", F.lit(" ("), "c", F.lit("): "), "l").alias("linea"))
    cards = lines.groupBy("nodo").agg(F.sum("c").alias("grado"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tipo", "linea"))), lambda x: x["linea"]), "\n").alias("ficha"))
    named = asked.join(nodes.select("nodo", "etiqueta"), "nodo", "left").join(cards, "nodo", "left")
    return named.select("nodo", "etiqueta", F.coalesce("grado", F.lit(0).cast("long")).alias("grado"), F.coalesce("ficha", F.lit("")).alias("ficha"))


def top_cut(edges: DataFrame, scores: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of highest score (nodo, puntaje; ties by id) and the edges among them."""
    kept = scores.orderBy(F.desc("puntaje"), "nodo").limit(most)
    ids = F.broadcast(kept.select("nodo"))
    inside = edges.join(ids.withColumnRenamed("nodo", "src"), "src", "left_semi").join(ids.withColumnRenamed("nodo", "dst"), "dst", "left_semi")
    return kept, inside


def community_summary(labels: DataFrame, degrees: DataFrame, kinds: DataFrame, top: int, members: int) -> DataFrame:
    """(comunidad, nodos, tipo, representantes) of the ``top`` largest communities: their size, their most frequent kind, and their ``members`` nodes of most edges in order."""
    sizes = labels.groupBy("comunidad").agg(F.count(F.lit(1)).alias("nodos")).orderBy(F.desc("nodos"), "comunidad").limit(top)
    inside = labels.join(F.broadcast(sizes), "comunidad").join(degrees.select("nodo", "grado"), "nodo", "left").join(kinds.select("nodo", "tipo"), "nodo", "left")
    counted = inside.filter("tipo IS NOT NULL").groupBy("comunidad", "tipo").agg(F.count(F.lit(1)).alias("c"))
    mode = counted.groupBy("comunidad").agg(F.min(F.struct((-F.col("c")).alias("c"), "tipo")).alias("m")).select("comunidad", "m.tipo")
    first = _ranked(inside, ["comunidad"], [F.desc_nulls_last("grado"), F.col("nodo")], members)
    names = first.groupBy("comunidad").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "nodo"))), lambda x: x["nodo"]).alias("representantes"))
    return F.broadcast(sizes).join(mode, "comunidad", "left").join(names, "comunidad")


def voted_community(edges: DataFrame, labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """(nodo, comunidad) of new nodes: the community of most weight among their labelled neighbours, ties to the smallest; those without any start their own."""
    new = fresh.select("nodo").distinct()
    ways = F.array(F.struct(F.col("src").alias("nodo"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("nodo"), F.col("src").alias("v")))
    near = edges.select(F.inline(ways), "peso").join(new, "nodo", "left_semi").join(labels.select(F.col("nodo").alias("v"), "comunidad"), "v")
    votes = near.groupBy("nodo", "comunidad").agg(F.sum("peso").alias("w"))
    best = votes.groupBy("nodo").agg(F.min(F.struct((-F.col("w")).alias("w"), "comunidad")).alias("b")).select("nodo", "b.comunidad")
    return new.join(best, "nodo", "left").select("nodo", F.coalesce("comunidad", "nodo").alias("comunidad"))


def inferred_aliases(curated: DataFrame, known: DataFrame, rules: list[tuple[str, Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """Aliases (nodo, id, regla) of curated nodes by the first rule that finds one known row, and bridges (nodo, id, regla) where it finds several.

    A rule is a name, a key of ``curated`` (nodo, …) and the same key of ``known`` (id, …). Each rule is an
    equi-join; keys that are null or empty join nothing.
    """
    found = None
    for i, (name, left, right) in enumerate(rules):
        l = curated.select("nodo", left.alias("k")).filter("k IS NOT NULL AND k <> ''")
        r = known.select("id", right.alias("k")).filter("k IS NOT NULL AND k <> ''")
        hit = l.join(r, "k").select("nodo", "id", F.lit(i).alias("orden"), F.lit(name).alias("regla")).distinct()
        found = hit if found is None else found.unionByName(hit)
    first = found.groupBy("nodo").agg(F.min("orden").alias("orden"))
    best = found.join(first, ["nodo", "orden"])
    counts = best.groupBy("nodo").agg(F.count(F.lit(1)).alias("c"))
    both = best.join(counts, "nodo")
    return both.filter("c = 1").select("nodo", "id", "regla"), both.filter("c > 1").select("nodo", "id", "regla")


def tolerant_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (nodo, etiqueta, tipo) and edges (src, dst, rel) from rows whose fields go by several names; the last row of a node wins, edges once.

    Known names: id, nodo or name; label, etiqueta or titulo; tipo or type; source, src, from or desde;
    target, dst, to or hasta; relation, rel or tipo. Ids are folded and trimmed. ``orden`` tells which row is last.
    """

    def pick(df: DataFrame, *names: str) -> Column:
        there = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    clean = lambda c: F.regexp_replace(fold(c), r"\s+", "_")
    n = nodes.select(clean(pick(nodes, "id", "nodo", "name")).alias("nodo"), pick(nodes, "label", "etiqueta", "titulo").alias("etiqueta"), pick(nodes, "tipo", "type").alias("tipo"), "orden").filter("nodo IS NOT NULL")
    last = n.groupBy("nodo").agg(F.max(F.struct("orden", "etiqueta", "tipo")).alias("b"))
    e = edges.select(clean(pick(edges, "source", "src", "from", "desde")).alias("src"), clean(pick(edges, "target", "dst", "to", "hasta")).alias("dst"), F.coalesce(pick(edges, "relation", "rel", "tipo"), F.lit("relacionado")).alias("rel"))
    return last.select("nodo", F.coalesce("b.etiqueta", "nodo").alias("etiqueta"), "b.tipo"), e.filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def merged_nodes(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Existing nodes whose null or blank fields are filled from fresh rows of their key, and the fresh ones that are new; keys are unique on each side."""
    fields = [c for c in existing.columns if c != key]
    f = fresh.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in fields])
    filled = lambda c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"__{c}"))
    return existing.join(f, F.col(key) == F.col("__k"), "full_outer").select(F.coalesce(key, "__k").alias(key), *[filled(c).alias(c) for c in fields])


def relation_blocks(edges: DataFrame, labels: DataFrame, old: DataFrame, k: int) -> DataFrame:
    """(nodo, bloque, huella, cambia): a "see also" block of each node's first ``k`` neighbours by label, its digest, and whether it differs from the ``old`` one (nodo, huella)."""
    near = edges.select(F.col("src").alias("nodo"), F.col("dst").alias("v")).distinct().join(labels.select(F.col("nodo").alias("v"), "etiqueta"), "v")
    first = _ranked(near, ["nodo"], [F.col("etiqueta"), F.col("v")], k)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__n", "etiqueta"))), lambda x: F.concat(F.lit("- "), x["etiqueta"]))
    blocks = first.groupBy("nodo").agg(F.array_join(lines, "\n").alias("bloque")).withColumn("huella", F.sha2("bloque", 256))
    was = old.select("nodo", F.col("huella").alias("__old"))
    return blocks.join(was, "nodo", "left").select("nodo", "bloque", "huella", (~F.col("huella").eqNullSafe(F.col("__old"))).alias("cambia"))


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 60, width: int = 40) -> DataFrame:
    """One row: a diagram as text of at most ``most`` nodes (nodo, etiqueta, distancia), nearest first, and the edges among them.

    Nodes are called n0, n1 and so on; labels are cut at ``width``. The bound is the view's: what is gathered has at most ``most`` nodes.
    """
    kept = nodes.orderBy("distancia", "nodo").limit(most)
    # The window holds the nodes of the view.
    named = kept.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("distancia", "nodo")) - 1)
    label = F.regexp_replace(F.when(F.length("etiqueta") > width, F.concat(F.substring("etiqueta", 1, width - 1), F.lit("…"))).otherwise(F.col("etiqueta")), '"', "'")
    boxes = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", label.alias("e")))), lambda x: F.concat(F.lit("  n"), x["k"], F.lit('["'), x["e"], F.lit('"]'))), "\n").alias("cajas"))
    ends = F.broadcast(named.select("nodo", "k"))
    inside = edges.select("src", "dst", "rel").distinct().join(ends.select(F.col("nodo").alias("src"), F.col("k").alias("a")), "src").join(ends.select(F.col("nodo").alias("dst"), F.col("k").alias("b")), "dst")
    arrows = inside.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "rel"))), lambda x: F.concat(F.lit("  n"), x["a"], F.lit(" -->|"), x["rel"], F.lit("| n"), x["b"])), "\n").alias("flechas"))
    return boxes.join(F.broadcast(arrows)).select(F.concat_ws("\n", F.lit("graph LR"), F.nullif("cajas", F.lit("")), F.nullif("flechas", F.lit(""))).alias("diagrama"))


#: Steps by which a result is made smaller: characters of a text, items of a list.
LADDER = ((4000, 50), (1500, 25), (600, 10), (250, 5), (120, 2))


def limited_rows(df: DataFrame, cap: int, ladder: tuple[tuple[int, int], ...] = LADDER) -> DataFrame:
    """Rows as JSON (``salida``) of at most ``cap`` characters, with the ``paso`` of the ladder that made them fit (0: whole); the last step stands even if it does not.

    Texts and arrays of texts are cut; the rows themselves stay all there: a limit of the view, not of the data.
    """

    def cut(step: tuple[int, int] | None) -> Column:
        columns = []
        for f in df.schema.fields:
            c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
            if step and kind == "string":
                c = F.substring(c, 1, step[0])
            elif step and kind == "array<string>":
                c = F.transform(F.slice(c, 1, step[1]), lambda x: F.substring(x, 1, step[0]))
            columns.append(c.alias(f.name))
        return F.to_json(F.struct(*columns))

    tries = F.array(*[F.struct(F.lit(i).alias("paso"), cut(s).alias("salida")) for i, s in enumerate((None, *ladder))])
    fits = F.filter(tries, lambda x: (F.length(x["salida"]) <= cap) | (x["paso"] == len(ladder)))
    return df.select(F.get(fits, F.lit(0)).alias("r")).select("r.salida", "r.paso")


def moving_sources(df: DataFrame, source: Column, changed: str, now: Column, minutes: int) -> DataFrame:
    """(fuente, ultimo, en_movimiento): of each source its last change and whether that is younger than ``minutes``, so that it had better be left alone."""
    last = df.groupBy(source.alias("fuente")).agg(F.max(changed).alias("ultimo"))
    return last.withColumn("en_movimiento", F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ultimo").cast("timestamp")) < minutes * 60 * 1_000_000)


def revalidated(state: DataFrame, seen: DataFrame, key: str, now: Column, hours: int) -> DataFrame:
    """(key, blob, revisado_en, accion): a copy checked within ``hours`` is kept unseen; of the others an equal blob is marked, another one fetched, and what the source does not show is kept as it was.

    ``state`` has key, blob and revisado_en, ``seen`` key and blob; keys that only the source has are new.
    """
    s = seen.select(F.col(key).alias("__k"), F.col("blob").alias("__blob"))
    fresh = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("revisado_en").cast("timestamp")) < hours * 3600 * 1_000_000
    act = F.when(F.col(key).isNull(), "nuevo").when(fresh, "vigente").when(F.col("__k").isNull(), "inalcanzable").when(F.col("blob") == F.col("__blob"), "igual").otherwise("cambiado")
    out = state.join(s, F.col(key) == F.col("__k"), "full_outer").withColumn("accion", F.coalesce(act, F.lit("cambiado")))
    taken = F.col("accion").isin("nuevo", "cambiado")
    checked = F.col("accion").isin("nuevo", "cambiado", "igual")
    return out.select(F.coalesce(key, "__k").alias(key), F.when(taken, F.col("__blob")).otherwise(F.col("blob")).alias("blob"), F.when(checked, now.cast("timestamp")).otherwise(F.col("revisado_en").cast("timestamp")).alias("revisado_en"), "accion")
