"""Property-graph operators on edge tables (src, dst, rel, peso)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulario.session import materialize


def accumulated(edges: DataFrame, weight: str = "peso") -> DataFrame:
    """One edge per (src, dst, rel) with the sum of weights; self-loops and edges with a null end are dropped."""
    kept = edges.filter((F.col("src") != F.col("dst")) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return kept.groupBy("src", "dst", "rel").agg(F.sum(weight).alias("peso"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways as (a, b, peso), weights of parallel edges added."""
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select(F.inline(ways), "peso").groupBy("a", "b").agg(F.sum("peso").alias("peso"))


def curated_degrees(edges: DataFrame, layer: str, curated: str) -> DataFrame:
    """(nodo, grado, curado): all edges of a node, and those of the curated layer."""
    ends = F.explode(F.array("src", "dst")).alias("nodo")
    return edges.select(ends, F.col(layer).alias("__l")).groupBy("nodo").agg(F.count(F.lit(1)).alias("grado"), F.count_if(F.col("__l") == curated).alias("curado"))


def degrees(edges: DataFrame) -> DataFrame:
    """(nodo, entrada, salida, grado): edges in, out and together."""
    ends = F.array(F.struct(F.col("src").alias("nodo"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("nodo"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = edges.select(F.inline(ends)).groupBy("nodo").agg(F.sum("i").alias("entrada"), F.sum("o").alias("salida"))
    return d.withColumn("grado", F.col("entrada") + F.col("salida"))


def graph_totals(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and density m / (n (n - 1)) over distinct ordered pairs."""
    nodes = degrees(edges).agg(F.count(F.lit(1)).alias("nodos"))
    pairs = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("aristas"))
    return nodes.join(F.broadcast(pairs)).withColumn("densidad", F.try_divide(F.col("aristas"), F.col("nodos") * (F.col("nodos") - 1)))


def neighbour_lists(edges: DataFrame, k: int) -> DataFrame:
    """(nodo, rel, sentido, total, vecinos): for each node, relation and direction the ``k`` heaviest neighbours in order.

    Ranks are limited below the shuffle, so a hub does not gather all of its edges.
    """
    out = F.struct(F.col("src").alias("nodo"), F.lit("sale").alias("sentido"), F.col("dst").alias("vecino"))
    come = F.struct(F.col("dst").alias("nodo"), F.lit("entra").alias("sentido"), F.col("src").alias("vecino"))
    flat = edges.select(F.inline(F.array(out, come)), "rel", "peso")
    keys = ["nodo", "rel", "sentido"]
    totals = flat.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy(*keys).orderBy(F.desc("peso"), "vecino")
    best = flat.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k)
    lists = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "vecino"))), lambda x: x["vecino"]).alias("vecinos"))
    return totals.join(lists, keys)


#: A frontier of up to this many nodes goes to every worker; a larger one is joined.
FEW = 100_000


def _few(df: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def ego(edges: DataFrame, seeds: DataFrame, hops: int, fan: int) -> DataFrame:
    """(nodo, distancia) of what is within ``hops`` of the seeds (column ``nodo``), both ways.

    From each reached node only its ``fan`` heaviest neighbours are followed, ties by id: the
    bound on hubs is the feature of this view. Only edges of the frontier are ranked; the
    lineage is cut after each hop.
    """
    ways = materialize(undirected(edges))
    w = Window.partitionBy("a").orderBy(F.desc("peso"), "b")
    reached = front = materialize(seeds.select("nodo").distinct().withColumn("distancia", F.lit(0)))
    for hop in range(1, hops + 1):
        near = ways.join(_few(front.select(F.col("nodo").alias("a"))), "a").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= fan)
        step = near.select(F.col("b").alias("nodo")).distinct()
        front = materialize(step.join(reached.select("nodo"), "nodo", "left_anti").withColumn("distancia", F.lit(hop)))
        reached = reached.unionByName(front)
    return reached


def distances(edges: DataFrame, seed, until=None) -> DataFrame:
    """(nodo, distancia, previo): breadth-first distances from a node over undirected edges, with the smallest predecessor.

    Hops go on until nothing new is reached or, if given, the node ``until`` is.
    """
    return _distances(materialize(undirected(edges).select("a", "b")), seed, until)


def _distances(ways: DataFrame, seed, until=None) -> DataFrame:
    kind = ways.schema["a"].dataType.simpleString()
    reached = front = ways.sparkSession.createDataFrame([(seed, 0, None)], f"nodo {kind}, distancia int, previo {kind}")
    hop = 0
    while not front.isEmpty() and (until is None or front.filter(F.col("nodo") == F.lit(until)).isEmpty()):
        hop += 1
        step = ways.join(_few(front.select(F.col("nodo").alias("a"))), "a").groupBy(F.col("b").alias("nodo")).agg(F.min("a").alias("previo"))
        front = materialize(step.join(reached.select("nodo"), "nodo", "left_anti").select("nodo", F.lit(hop).alias("distancia"), "previo"))
        reached = reached.unionByName(front)
    return reached


def all_shortest_paths(edges: DataFrame, start, end, most: int = 3) -> DataFrame:
    """(orden, camino, relaciones): the first ``most`` shortest undirected paths between two nodes, in the order of their nodes.

    ``camino`` is an array of nodes, ``relaciones`` one of labels: the smallest relation of the edge
    as it points, or ``es_<relation>_de`` against it. Distances are found first; the nodes on
    shortest paths are marked from the end back; then paths grow from the start, of which each
    node keeps the first ``most``: a hub never gathers more. No path gives no row.
    """
    ways = materialize(undirected(edges).select("a", "b"))
    level = materialize(_distances(ways, start, end).select("nodo", "distancia"))
    last = level.filter(F.col("nodo") == F.lit(end)).select("distancia").head()
    kind = ways.schema["a"].dataType.simpleString()
    if last is None:
        return ways.sparkSession.createDataFrame([], f"orden int, camino array<{kind}>, relaciones array<string>")
    on = [level.filter((F.col("nodo") == F.lit(end)) & (F.col("distancia") == last.distancia)).select("nodo")]
    for hop in range(last.distancia - 1, 0, -1):
        before = ways.join(_few(on[0].select(F.col("nodo").alias("a"))), "a").select(F.col("b").alias("nodo")).distinct()
        on.insert(0, materialize(before.join(level.filter(F.col("distancia") == hop).select("nodo"), "nodo", "left_semi")))
    paths = ways.sparkSession.createDataFrame([(start, [start])], f"nodo {kind}, camino array<{kind}>")
    for marked in on if last.distancia else []:
        grown = ways.join(F.broadcast(paths.withColumnRenamed("nodo", "a")), "a").join(marked.select(F.col("nodo").alias("b")), "b", "left_semi")
        grown = grown.select(F.col("b").alias("nodo"), F.concat("camino", F.array("b")).alias("camino"))
        best = Window.partitionBy("nodo").orderBy("camino")
        paths = materialize(grown.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= most).drop("__n"))
    ranked = paths.withColumn("orden", F.row_number().over(Window.partitionBy("nodo").orderBy("camino")))
    steps = ranked.select("orden", "camino", F.posexplode(F.slice("camino", 1, F.size("camino") - 1)).alias("paso", "x")).withColumn("y", F.get("camino", F.col("paso") + 1))
    labels = edges.groupBy("src", "dst").agg(F.min("rel").alias("rel"))
    # At most ``most`` paths are left: a few rows on the side that is broadcast.
    there = labels.join(F.broadcast(steps), (F.col("src") == F.col("x")) & (F.col("dst") == F.col("y"))).select("orden", "paso", F.struct(F.lit(0).alias("s"), F.col("rel").alias("t")).alias("r"))
    back = labels.join(F.broadcast(steps), (F.col("src") == F.col("y")) & (F.col("dst") == F.col("x"))).select("orden", "paso", F.struct(F.lit(1).alias("s"), F.concat(F.lit("es_"), "rel", F.lit("_de")).alias("t")).alias("r"))
    named = there.unionByName(back).groupBy("orden", "paso").agg(F.min("r").alias("r")).groupBy("orden").agg(F.array_sort(F.collect_list(F.struct("paso", F.col("r.t").alias("t")))).alias("l"))
    out = ranked.join(F.broadcast(named), "orden", "left")
    return out.select("orden", "camino", F.coalesce(F.transform("l", lambda x: x["t"]), F.array().cast("array<string>")).alias("relaciones"))


def blast_radius(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(nodo, directos, cascada, nivel) of each target (column ``nodo``): what a change of it touches.

    Direct are those that point to it or, if none does, those that it points to; the cascade
    is what the direct ones point to, without the target and the direct ones. Work is bounded by
    the edges of the targets and of their direct nodes. Targets without any edge have 0 and 0.
    """
    e = edges.select("src", "dst").distinct()
    wanted = targets.select("nodo").distinct()
    come = e.join(wanted, F.col("dst") == F.col("nodo")).select("nodo", F.col("src").alias("mid"))
    go = e.join(wanted, F.col("src") == F.col("nodo")).join(come.select("nodo").distinct(), "nodo", "left_anti").select("nodo", F.col("dst").alias("mid"))
    direct = materialize(come.unionByName(go).filter(F.col("mid") != F.col("nodo")))
    far = direct.join(e, F.col("mid") == F.col("src")).select("nodo", F.col("dst").alias("far")).filter(F.col("far") != F.col("nodo")).distinct()
    far = far.join(direct.select("nodo", F.col("mid").alias("far")), ["nodo", "far"], "left_anti")
    counts = wanted.join(direct.groupBy("nodo").agg(F.count(F.lit(1)).alias("directos")), "nodo", "left").join(far.groupBy("nodo").agg(F.count(F.lit(1)).alias("cascada")), "nodo", "left")
    none = F.lit(0).cast("long")
    out = counts.select("nodo", F.coalesce("directos", none).alias("directos"), F.coalesce("cascada", none).alias("cascada"))
    total = F.col("directos") + F.col("cascada")
    return out.withColumn("nivel", F.when(total >= 8, "ALTO").when(total >= 3, "MEDIO").otherwise("BAJO"))


def pagerank(edges: DataFrame, rounds: int = 100, alpha: float = 0.85, restart: DataFrame | None = None, cut: int = 5, tolerance: float | None = 1e-6) -> DataFrame:
    """(nodo, puntaje): weighted PageRank; what dangling nodes hold is shared out by the restart weights.

    Rounds end when all ranks together move by less than ``tolerance`` for each node, looked at
    every ``cut`` rounds when the lineage is cut, and after ``rounds`` at the latest; with a
    tolerance of None exactly ``rounds`` are run. ``restart`` (nodo, parte with sum 1) personalises
    it; without it all nodes restart alike. Contributions to a hub are added up on the map side.
    """
    links = edges.groupBy("src", "dst").agg(F.sum("peso").alias("peso"))
    out = links.groupBy("src").agg(F.sum("peso").alias("__out"))
    links = materialize(links.join(out, "src").select("src", "dst", (F.col("peso") / F.col("__out")).alias("parte")))
    nodes = materialize(links.select(F.explode(F.array("src", "dst")).alias("nodo")).distinct())
    n = nodes.count()
    if restart is None:
        base = nodes.withColumn("__r", F.lit(1.0 / max(n, 1)))
    else:
        base = nodes.join(restart.select("nodo", F.col("parte").alias("__r")), "nodo", "left").withColumn("__r", F.coalesce("__r", F.lit(0.0)))
    base = materialize(base.join(links.select(F.col("src").alias("nodo")).distinct().withColumn("__has", F.lit(True)), "nodo", "left"))
    rank = base.select("nodo", F.col("__r").alias("puntaje"), F.col("__r").alias("__was"))
    for i in range(1, rounds + 1):
        loose = rank.join(base.filter("__has IS NULL").select("nodo"), "nodo", "left_semi").agg(F.coalesce(F.sum("puntaje"), F.lit(0.0)).alias("__loose"))
        come = links.join(rank.select("nodo", "puntaje"), F.col("src") == F.col("nodo")).groupBy("dst").agg(F.sum(F.col("puntaje") * F.col("parte")).alias("__come"))
        now = base.join(come, F.col("nodo") == F.col("dst"), "left").join(F.broadcast(loose))
        now = now.select("nodo", (F.lit(1 - alpha) * F.col("__r") + alpha * (F.coalesce("__come", F.lit(0.0)) + F.col("__loose") * F.col("__r"))).alias("puntaje"))
        watched = i % cut == 0 and i < rounds
        rank = now.join(rank.select("nodo", F.col("puntaje").alias("__was")), "nodo") if watched and tolerance is not None else now
        if watched:
            rank = materialize(rank)
            if tolerance is not None and (rank.agg(F.sum(F.abs(F.col("puntaje") - F.col("__was")))).head()[0] or 0.0) <= tolerance * n:
                break
    return rank.select("nodo", "puntaje")


def personal_pagerank(edges: DataFrame, seeds: DataFrame, radius: int = 2, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """PageRank that restarts at the seeds (column ``nodo``, alike), on the undirected part of the graph within ``radius`` of them."""
    ways = materialize(undirected(edges))
    reached = front = materialize(seeds.select("nodo").distinct())
    for _ in range(radius):
        step = ways.join(_few(front.select(F.col("nodo").alias("a"))), "a").select(F.col("b").alias("nodo")).distinct()
        front = materialize(step.join(reached, "nodo", "left_anti"))
        reached = reached.unionByName(front)
    inside = ways.join(reached.select(F.col("nodo").alias("a")), "a", "left_semi").join(reached.select(F.col("nodo").alias("b")), "b", "left_semi")
    known = seeds.select("nodo").distinct().join(ways.select(F.col("a").alias("nodo")), "nodo", "left_semi")
    total = known.agg(F.count(F.lit(1)).alias("__n"))
    restart = known.join(F.broadcast(total)).select("nodo", (F.lit(1.0) / F.col("__n")).alias("parte"))
    return pagerank(inside.select(F.col("a").alias("src"), F.col("b").alias("dst"), "peso"), rounds, alpha, restart, tolerance=tolerance)


def communities(edges: DataFrame, rounds: int, side: Column | None = None) -> DataFrame:
    """(nodo, comunidad): labels spread over undirected weighted edges for a number of rounds.

    A node takes the label of the largest total weight among its neighbours, ties to the
    smallest label; it starts with its own. In each round only one half of the nodes moves,
    by turns, so that labels do not swing to and fro; ``side`` (0 or 1, of column ``nodo``)
    tells the halves, by default a hash. Weights for a hub are added up by label on the map side.
    """
    ways = materialize(undirected(edges))
    side = F.pmod(F.xxhash64("nodo"), F.lit(2)) if side is None else side
    label = ways.select(F.col("a").alias("nodo")).distinct().withColumn("comunidad", F.col("nodo"))
    for i in range(rounds):
        votes = ways.join(label, F.col("b") == F.col("nodo")).groupBy("a", "comunidad").agg(F.sum("peso").alias("__w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("__w")).alias("w"), "comunidad")).alias("__best"))
        moved = label.join(best, F.col("nodo") == F.col("a")).select(
            "nodo", F.when(side == i % 2, F.col("__best.comunidad")).otherwise(F.col("comunidad")).alias("comunidad")
        )
        label = materialize(moved)
    return label


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row with the modularity of a partition of undirected weighted edges."""
    ways = undirected(edges)
    inside = ways.join(label.select(F.col("nodo").alias("a"), F.col("comunidad").alias("x")), "a").join(label.select(F.col("nodo").alias("b"), F.col("comunidad").alias("y")), "b")
    whole = inside.agg(F.sum("peso").alias("m2"), F.sum(F.when(F.col("x") == F.col("y"), F.col("peso")).otherwise(0)).alias("dentro"))
    sums = inside.groupBy("x").agg(F.sum("peso").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return whole.join(F.broadcast(sums)).select((F.col("dentro") / F.col("m2") - F.col("k2") / (F.col("m2") * F.col("m2"))).alias("modularidad"))


def overlay(base: DataFrame, layer: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of a curated graph with those of a layer: (src, dst, rel, peso, capa).

    Where both join the same pair, the curated edges stand; layer edges with an end that is
    not in ``known`` (nodo) are left out; parallel layer edges become one with the relations in order.
    """
    ends = layer.join(known.select(F.col("nodo").alias("src")), "src", "left_semi").join(known.select(F.col("nodo").alias("dst")), "dst", "left_semi")
    fresh = ends.join(base.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    merged = fresh.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("rel")), "+").alias("rel"), F.max("peso").alias("peso"))
    return base.select("src", "dst", "rel", "peso", F.lit("curado").alias("capa")).unionByName(merged.select("src", "dst", "rel", "peso", F.lit("mapa").alias("capa")))
