"""Joins, windows, aggregations and set operations of a citation-rich corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total; null keys are one key.

    The rank limit is pushed below the shuffle, so a hot key sends one row per task.
    """
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__n = 1").drop("__n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rango") -> DataFrame:
    """The first ``k`` rows of each key with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each key its most frequent non-null value and how often it stands; ties go to the smaller value.

    Two combining aggregations: counts by key and value, then the largest of them.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("a"), F.col(value).alias("b"))).alias("__best")
    return counted.groupBy(*keys).agg(best).select(*keys, F.col("__best.b").alias(value), (-F.col("__best.a")).alias("veces"))


def resolve_collisions(df: DataFrame, identifier: str, order: list[Column]) -> DataFrame:
    """Unique identifiers: the first row of each keeps it, later ones get ``-2``, ``-3`` and so on.

    Adds ``id_unico``, and ``id_base`` for the rows that lost theirs.
    """
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(identifier).orderBy(*order)))
    lost = F.col("__n") > 1
    out = ranked.withColumn("id_unico", F.when(lost, F.concat(F.col(identifier), F.lit("-"), F.col("__n").cast("string"))).otherwise(F.col(identifier)))
    return out.withColumn("id_base", F.when(lost, F.col(identifier))).drop("__n")


def alias_resolved(df: DataFrame, column: str, aliases: DataFrame, alias: str, target: str) -> DataFrame:
    """The column replaced by the target of its alias where it has one; ``aliases`` has one row per alias."""
    a = aliases.select(F.col(alias).alias("__alias"), F.col(target).alias("__target"))
    out = df.join(a, F.col(column) == F.col("__alias"), "left")
    return out.withColumn(column, F.coalesce("__target", column)).drop("__alias", "__target")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows (key, cambio) of what was added, removed or changed from one snapshot to the next; keys are unique."""
    o = old.select(F.col(key).alias("__a"), F.xxhash64(*content).alias("__x"))
    n = new.select(F.col(key).alias("__b"), F.xxhash64(*content).alias("__y"))
    change = F.when(F.col("__a").isNull(), "agregado").when(F.col("__b").isNull(), "eliminado").when(F.col("__x") != F.col("__y"), "modificado")
    both = o.join(n, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), change.alias("cambio"))
    return both.filter(F.col("cambio").isNotNull())


def fingerprint(df: DataFrame, columns: list[str], version: str) -> DataFrame:
    """One row: the number of rows and a hash of all of them, in any order, with a rule version.

    Hashes of rows are added up, so every task sends one number and no sort is needed;
    repeated rows count. Adding is done in decimals wide enough not to overflow.
    """
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    total = df.agg(F.count(F.lit(1)).alias("filas"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("__h"))
    return total.select("filas", F.sha2(F.concat_ws("|", F.lit(version), F.col("filas").cast("string"), F.col("__h").cast("string")), 256).alias("huella"))


def validity_intervals(df: DataFrame, key: str, since: str) -> DataFrame:
    """Each row with ``hasta``, the next start of its key (null for the last): half-open validity."""
    return df.withColumn("hasta", F.lead(since).over(Window.partitionBy(key).orderBy(since)))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, since: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the right row of its key that was last in force at its time.

    Both sides are united and carried forward in one sorted pass per key, so there is no
    range join; right rows of the same instant count as in force. Null keys match nothing.
    """
    l = left.select(F.struct(*left.columns).alias("__row"), F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__v"))
    packed = F.struct(*values)
    r = right.select(F.lit(None).alias("__row"), F.col(key).alias("__k"), F.col(since).alias("__t"), F.lit(0).alias("__side"), packed.alias("__v"))
    both = _union(l, r)
    w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__v", F.when(F.col("__k").isNotNull(), F.last("__v", ignorenulls=True).over(w)))
    return carried.filter("__side = 1").select("__row.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def _union(left: DataFrame, right: DataFrame) -> DataFrame:
    row, value = left.schema["__row"].dataType, right.schema["__v"].dataType
    l = left.withColumn("__v", F.lit(None).cast(value))
    r = right.withColumn("__row", F.lit(None).cast(row))
    return l.unionByName(r)


def forward_filled(df: DataFrame, keys: list[str], order: list[Column], column: str, out: str) -> DataFrame:
    """The last non-null value of a column up to each row of its key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def runs(df: DataFrame, keys: list[str], number: str, gap: int) -> DataFrame:
    """Runs of numbers of each key in which neighbours differ by at most ``gap``: desde, hasta, cuantos. Repeats count once."""
    w = Window.partitionBy(*keys).orderBy(number)
    distinct = df.filter(F.col(number).isNotNull()).select(*keys, number).distinct()
    marked = distinct.withColumn("__new", F.coalesce((F.col(number) - F.lag(number).over(w) > gap).cast("int"), F.lit(1)))
    grouped = marked.withColumn("__run", F.sum("__new").over(w))
    return grouped.groupBy(*keys, "__run").agg(F.min(number).alias("desde"), F.max(number).alias("hasta"), F.count(F.lit(1)).alias("cuantos")).drop("__run")


def quota_merge(df: DataFrame, first: Column, order: list[Column], k: int, reserved: int) -> DataFrame:
    """``k`` rows in order, ``reserved`` of them kept for rows where ``first`` is false; either side fills what the other leaves.

    A report of k rows: only candidates within k of either side are ranked together.
    """
    flag = df.withColumn("__first", first)
    side = flag.withColumn("__n", F.row_number().over(Window.partitionBy("__first").orderBy(*order))).filter(F.col("__n") <= k)
    late = F.when(F.col("__first"), F.col("__n") > k - reserved).otherwise(F.col("__n") > reserved)
    picked = side.withColumn("__late", late.cast("int")).orderBy("__late", *order).limit(k)
    return picked.drop("__first", "__n", "__late")


def bounded_pairs(df: DataFrame, key: str, member: str, reach: int) -> DataFrame:
    """Pairs of each member with the next ``reach`` members of its key, in order: linear in the rows, not quadratic."""
    w = Window.partitionBy(key).orderBy(member)
    ahead = F.array(*[F.lead(member, i).over(w) for i in range(1, reach + 1)])
    paired = df.select(key, member).distinct().withColumn("__next", ahead)
    return paired.select(key, F.col(member).alias("a"), F.explode(F.filter("__next", lambda x: x.isNotNull())).alias("b"))


def cooccurrence(df: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """How many keys each pair of members (a < b) shares.

    Keys of up to ``most`` members are paired in one pass over their sorted members; larger
    ones would give a quadratic number of pairs and raise an error, so nothing is dropped. Null keys and
    members belong to nothing.
    """
    known = df.filter(F.col(key).isNotNull() & F.col(member).isNotNull())
    sets = known.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("__m"))
    checked = F.when(F.size("__m") <= most, F.col("__m")).otherwise(F.raise_error(F.lit(f"a key has more than {most} members")))
    rows = sets.select(checked.alias("__m")).select("__m", F.posexplode("__m").alias("__i", "a"))
    pairs = rows.select("a", F.explode(F.slice("__m", F.col("__i") + 2, F.lit(most))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("comunes"))


def jaccard_pairs(df: DataFrame, key: str, member: str, least: float) -> DataFrame:
    """Pairs of keys (a < b) whose member sets have a Jaccard similarity of at least ``least`` (above 0): a, b, comunes, jaccard.

    Exact, by prefix filtering: members are in one order, those of a thousandth of all rows
    and more last. Sets that share p members or more have their first two common ones among
    their first n - p + 2, so they meet under pairs of members there, of which there are far
    more than members; only where one shared member may do, under single ones. The set goes
    along, so a pair is scored where it meets, once: under its first common members.
    """
    lines = df.select(F.col(key).alias("k"), F.col(member).alias("m")).filter("k IS NOT NULL AND m IS NOT NULL")
    seen = lines.groupBy("m").agg(F.count(F.lit(1)).alias("f"))
    heavy = seen.crossJoin(F.broadcast(seen.agg(F.sum("f").alias("t")))).filter("f * 1000 >= t").select("m", "f")
    sets = lines.join(F.broadcast(heavy), "m", "left").repartition("k").groupBy("k").agg(F.collect_set(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "m")).alias("s"))
    sets = sets.select("k", F.transform(F.array_sort("s"), lambda x: x["m"]).alias("s"))
    fewest = lambda n: F.ceil(n * least - F.lit(1e-9))
    n = F.size("s")
    front = n - fewest(n).cast("int")
    # Sets of up to so many members may be alike with one shared member, and with sets of up to ``met``.
    met = int(int((1 + 1e-9) / least) / least + 1e-6)
    alone = F.when(n <= met, F.transform(F.slice("s", 1, front + 1), lambda x: F.struct(x.alias("x"), x.alias("y"))))
    start = F.slice("s", 1, front + 2)
    paired = F.flatten(F.transform(start, lambda x, at: F.transform(F.slice(start, at + 2, n), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    none = F.slice(F.transform("s", lambda x: F.struct(x.alias("x"), x.alias("y"))), 1, 0)
    met_under = F.concat(F.coalesce(alone, none), F.when(fewest(n) >= 2, paired).otherwise(none))
    probe = sets.select("k", "s", F.inline(met_under))
    l = probe.select(F.col("k").alias("a"), F.col("s").alias("sa"), "x", "y")
    r = probe.select(F.col("k").alias("b"), F.col("s").alias("sb"), "x", "y")
    na, nb = F.size("sa"), F.size("sb")
    fits = (F.col("a") < F.col("b")) & (na >= nb * least - 1e-9) & (nb >= na * least - 1e-9)
    same = F.array_intersect("sa", "sb")
    one = (fewest(na) < 2) | (fewest(nb) < 2)
    first = F.when(one, (F.col("x") == F.col("y")) & (F.get(same, F.lit(0)) == F.col("x"))).otherwise((F.get(same, F.lit(0)) == F.col("x")) & (F.get(same, F.lit(1)) == F.col("y")))
    scored = l.join(r, ["x", "y"]).filter(fits).filter(first).select("a", "b", F.size(same).alias("comunes"), (na + nb).alias("__n"))
    scored = scored.withColumn("jaccard", F.col("comunes") / (F.col("__n") - F.col("comunes")))
    return scored.filter(F.col("jaccard") >= least - 1e-9).select("a", "b", "comunes", "jaccard")


def exact_identity(wanted: DataFrame, known: DataFrame, name: str, identifier: str) -> DataFrame:
    """Each wanted name with the one identifier that has it; several or none leave it open and say so.

    Columns: the name, ``estado`` (unico, ambiguo, ausente), ``id`` and ``candidatos``.
    """
    held = known.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(
        F.count(F.lit(1)).alias("candidatos"), F.min(identifier).alias("__id")
    )
    out = wanted.join(held, F.col(name) == F.col("__name"), "left")
    count = F.coalesce("candidatos", F.lit(0))
    state = F.when(count == 1, "unico").when(count > 1, "ambiguo").otherwise("ausente")
    return out.select(*wanted.columns, state.alias("estado"), F.when(count == 1, F.col("__id")).alias("id"), count.cast("long").alias("candidatos"))


def insert_absent(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and the candidates whose key is new, the first of each key by all columns; existing ones win."""
    fresh = first_wins(candidates.join(existing.select(*keys), keys, "left_anti"), keys, [F.col(c) for c in candidates.columns])
    return existing.unionByName(fresh.select(*existing.columns))


def specific_over_generic(df: DataFrame, record: str, identifier: str) -> DataFrame:
    """Drops a mention of a whole body where the same record cites a part of it."""
    parents = df.select(F.col(record).alias("__r"), F.regexp_replace(identifier, ":[^:]*$", "").alias("__p")).filter(F.col(identifier) != F.col("__p")).distinct()
    return df.join(parents, (F.col(record) == F.col("__r")) & (F.col(identifier) == F.col("__p")), "left_anti")


def ranked_in_parts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row with its 0-based place ``__i`` by value within its key and the key's size ``__n``, no task per key.

    Rows are split into ranges of (key, value), numbered within each range, and moved up by
    the rows of the ranges before: a key with most of the rows is spread over many tasks.
    Only counts by key and range are brought together. Equal values get consecutive places.
    """
    parts = df.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id())
    counts = parts.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__rows").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), before.alias("__before"), F.sum("__rows").over(w).alias("__n"))
    inner = parts.withColumn("__in", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(value)) - 1)
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = inner.join(moved, same)
    return out.withColumn("__i", F.col("__in") + F.col("__before")).select(*df.columns, "__i", "__n")


def index_quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key, of its positive values: n, min, p25, mediana, promedio, p75, max.

    p25 is the value at index max(0, floor(n/4) - 1) and p75 at min(n - 1, floor(3n/4)) of
    the sorted values, from 0; the median is the usual one.
    """
    ranked = ranked_in_parts(df.filter(F.col(value) > 0).select(*keys, value), keys, value)
    low, high = F.greatest(F.floor(F.col("__n") / 4) - 1, F.lit(0)), F.least(F.floor(F.col("__n") * 3 / 4), F.col("__n") - 1)
    middle = (F.col("__i") >= F.floor((F.col("__n") - 1) / 2)) & (F.col("__i") <= F.floor(F.col("__n") / 2))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.max(F.when(F.col("__i") == low, F.col(value))).alias("p25"),
        F.round(F.avg(F.when(middle, F.col(value))), 4).alias("mediana"),
        F.round(F.avg(value), 4).alias("promedio"),
        F.max(F.when(F.col("__i") == high, F.col(value))).alias("p75"),
        F.max(value).alias("max"),
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Nearest-rank percentiles: the value at ceil(share * n) in order, at least the first.

    Places come from ``ranked_in_parts``, so a key with most of the rows holds them in no single task.
    """
    ranked = ranked_in_parts(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, value)
    at = lambda q: F.greatest(F.ceil(F.col("__n") * q), F.lit(1)) - 1
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("__i") == at(q), F.col(value))).alias(f"p{round(q * 100)}") for q in shares])


def seeded_choice(df: DataFrame, keys: list[str], record: str, seed: int) -> DataFrame:
    """One row of each key, drawn by a hash of the record and a seed: the same for the same seed, however the rows are laid out."""
    return first_wins(df, keys, [F.xxhash64(F.lit(seed), record), F.col(record)])


def tiered(df: DataFrame, tier: str, order: list[Column]) -> DataFrame:
    """Rows of a tier over 0 with their place within it (``lugar``, from 1) by the given order, which must be total.

    Places come from ranges of (tier, order) moved up by counts, so a tier of most rows is no single task.
    """
    kept = df.filter(F.col(tier) > 0)
    parts = kept.repartitionByRange(F.col(tier), *order).withColumn("__part", F.spark_partition_id())
    sizes = parts.groupBy(tier, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(tier).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(F.col(tier).alias("__t"), F.col("__part").alias("__p"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inner = parts.withColumn("__in", F.row_number().over(Window.partitionBy(tier, "__part").orderBy(*order)))
    out = inner.join(moved, (F.col(tier) == F.col("__t")) & (F.col("__part") == F.col("__p")))
    return out.select(*df.columns, (F.col("__in") + F.col("__before")).cast("int").alias("lugar"))
