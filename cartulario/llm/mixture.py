"""Mixing sources to target weights with a Pfair schedule of their blocks."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cartulario.session import materialize

#: Tokens in a block, the unit of scheduling, and slots that a schedule has at most: longer mixtures get larger blocks.
BLOCK = 4096
MOST_SLOTS = 1 << 20

#: Documents of one source are numbered in so many parts at once.
BUCKETS = 1024

#: Most listed sources: their table is a parameter and goes to the driver.
MOST_SOURCES = 1000


def folded(column: Column) -> Column:
    """A source's name trimmed and in lower case."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def mixture_shares(sizes: DataFrame, source: str, tokens: str, targets: DataFrame) -> DataFrame:
    """What each listed source can give to a mixture of T tokens, T being the tokens of all listed sources.

    Columns: source, peso, cuota (target share), max_repeticiones, tokens (of the
    source), total (T), aporte (tokens in the mixture), repeticiones (uses of the
    whole source, a fraction), cuota_real, limitada (the target is out of reach). This
    is the plan, budgets in place of documents: ``scheduled_shares`` has what the
    mixture holds.
    Sources without documents count 0 tokens; documents of unlisted or null sources
    are left out; null sizes count 0. Targets with a null source or a null or
    non-positive weight are no targets; a source listed twice has its weights summed
    and the larger cap. Only one row per source leaves the map side.
    """
    goals = _goals(targets)
    weighed = goals.select("source", "peso", "max_repeticiones", (F.col("peso") / F.sum("peso").over(Window.partitionBy())).alias("cuota"))
    totals = sizes.groupBy(folded(F.col(source)).alias("source")).agg(F.sum(tokens).alias("__tokens"))
    joined = weighed.join(totals, "source", "left").select("source", "peso", "cuota", "max_repeticiones", F.coalesce("__tokens", F.lit(0)).alias("tokens"))
    # The window holds one row per listed source, at most MOST_SOURCES.
    joined = joined.withColumn("total", F.sum("tokens").over(Window.partitionBy()))
    wanted = F.col("cuota") * F.col("total")
    most = F.col("max_repeticiones") * F.col("tokens")
    out = joined.withColumn("limitada", wanted > most).withColumn("aporte", F.least(F.round(wanted).cast("long"), most))
    given = F.sum("aporte").over(Window.partitionBy())
    return out.select(
        "source", "peso", "cuota", "max_repeticiones", "tokens", "total", "aporte",
        F.when(F.col("tokens") > 0, F.col("aporte") / F.col("tokens")).otherwise(F.lit(0.0)).alias("repeticiones"),
        F.when(given > 0, F.col("aporte") / given).otherwise(F.lit(0.0)).alias("cuota_real"),
        "limitada",
    )


def _goals(targets: DataFrame) -> DataFrame:
    clean = targets.select(folded(F.col("source")).alias("source"), F.col("peso").cast("double"), F.coalesce("max_repeticiones", F.lit(1)).cast("long").alias("max_repeticiones"))
    clean = clean.filter(F.col("source").isNotNull() & (F.col("peso") > 0) & ~F.isnan("peso") & (F.col("max_repeticiones") >= 0))
    return clean.groupBy("source").agg(F.sum("peso").alias("peso"), F.max("max_repeticiones").alias("max_repeticiones"))


def block_size(total: int, block: int | None = None, most: int = MOST_SLOTS) -> int:
    """Tokens of a block: the given number, else ``BLOCK``, or what cuts ``total`` into ``most`` slots if that is more."""
    return block or max(BLOCK, -(-total // most))


def schedule(budgets: dict[str, int], block: int) -> dict[str, list[int]]:
    """For each source the slots of its blocks over the whole mixture, by earliest deadline first.

    A source of ``a`` out of ``T`` tokens has the weight a / T, kept as a fraction of whole
    numbers: its block i is released at floor(i * T / a) and due at ceil((i + 1) * T / a), in
    slots of one block each. The weights add up to one, so every block is placed within its
    window and each source stays less than one block from its share at every slot, however long
    the mixture is: nothing is rounded and nothing repeats. The last block of a source may be a
    part of one; where no block is released, the slot passes.
    """
    names = sorted(n for n, a in budgets.items() if a > 0)
    total = sum(budgets[n] for n in names)
    left = {n: -(-budgets[n] // block) for n in names}
    slots: dict[str, list[int]] = {n: [] for n in names}
    coming = [(0, n) for n in names]
    heapq.heapify(coming)
    ready: list[tuple[int, str]] = []
    slot = 0
    while coming or ready:
        while coming and coming[0][0] <= slot:
            _, n = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(len(slots[n]) + 1) * total // budgets[n]), n))
        if ready:
            due, n = heapq.heappop(ready)
            if due <= slot:
                raise AssertionError("a block missed its deadline")
            slots[n].append(slot)
            if len(slots[n]) < left[n]:
                heapq.heappush(coming, (len(slots[n]) * total // budgets[n], n))
        slot += 1
    return slots


def mix_sources(sizes: DataFrame, record: str, source: str, tokens: str, targets: DataFrame, block: int | None = None) -> DataFrame:
    """Each use of a document in the mixture: turno, source, desde, repeticion, doc_id, tokens.

    ``desde`` is where its tokens begin in the source's part of the mixture; a block of
    ``block`` tokens of a source (see ``block_size``) is one job, and ``turno`` is the slot
    of the job that the document begins in. Read by (turno, source, desde), the mixture keeps each
    source less than one block from its share (documents are not cut, so one that
    crosses a block's end stays whole). The order within a source is by a hash of the
    id. A source is used ``repeticion`` times over, the last time in part; the use that
    reaches the budget is the last one.

    The running sum is taken in buckets: sums per bucket first, then positions within
    each, so a source with a third of all documents is no single task. Only the shares
    (one row per source) and at most ``MOST_SLOTS`` slots, and one more a source, are on the driver. Documents of
    unlisted or null sources are left out, those of 0 tokens take no room but stay.
    """
    flat = _flat(sizes, record, source, tokens)
    return _mixed(flat, _planned(flat, targets), block).orderBy("turno", "source", "desde", "doc_id")


def scheduled_shares(sizes: DataFrame, record: str, source: str, tokens: str, targets: DataFrame, block: int | None = None) -> DataFrame:
    """The columns of ``mixture_shares``, with what the scheduled mixture really holds, and mezclados (its tokens of the source).

    cuota_real is the source's part of all tokens that ``mix_sources`` gives a turn, so a
    document kept whole at the end of a small budget counts in full. A source is limitada
    if the mixture holds all its permitted uses and they are less than its target.
    """
    flat = _flat(sizes, record, source, tokens)
    shares = _planned(flat, targets)
    spark = sizes.sparkSession
    held = _mixed(flat, shares, block).filter("turno IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("mezclados"))
    plan = spark.createDataFrame(shares, _PLANNED)
    joined = plan.join(held, "source", "left").withColumn("mezclados", F.coalesce("mezclados", F.lit(0).cast("long")))
    # The window holds one row per listed source, at most MOST_SOURCES.
    given = F.sum("mezclados").over(Window.partitionBy())
    used_up = F.col("mezclados") >= F.col("max_repeticiones") * F.col("tokens")
    return joined.select(
        "source", "peso", "cuota", "max_repeticiones", "tokens", "total", "aporte",
        F.when(F.col("tokens") > 0, F.col("mezclados") / F.col("tokens")).otherwise(F.lit(0.0)).alias("repeticiones"),
        F.when(given > 0, F.col("mezclados") / given).otherwise(F.lit(0.0)).alias("cuota_real"),
        (used_up & (F.col("cuota") * F.col("total") > F.col("mezclados"))).alias("limitada"),
        "mezclados",
    )


_PLANNED = "source string, peso double, cuota double, max_repeticiones long, tokens long, total long, aporte long, repeticiones double, cuota_real double, limitada boolean"


def _flat(sizes: DataFrame, record: str, source: str, tokens: str) -> DataFrame:
    return materialize(
        sizes.select(F.col(record).alias("doc_id"), folded(F.col(source)).alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))
    )


def _planned(flat: DataFrame, targets: DataFrame) -> list[Row]:
    shares = mixture_shares(flat, "source", "tokens", targets).limit(MOST_SOURCES + 1).collect()
    if len(shares) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} listed sources")
    return shares


def _mixed(flat: DataFrame, shares: list[Row], block: int | None) -> DataFrame:
    """The rows of ``mix_sources``, in no order."""
    spark = flat.sparkSession
    budgets = {r.source: r.aporte for r in shares}
    block = block_size(sum(budgets.values()), block)
    slots = schedule(budgets, block)
    plan = spark.createDataFrame(
        [(r.source, r.tokens, r.aporte, slots[r.source]) for r in shares if r.source in slots], "source string, __all long, __budget long, __slots array<int>"
    )
    ranked = flat.withColumn("__order", F.xxhash64("doc_id")).withColumn("__bucket", F.pmod("__order", F.lit(BUCKETS)))
    ranked = ranked.join(F.broadcast(plan.select("source")), "source", "left_semi")
    sums = ranked.groupBy("source", "__bucket").agg(F.sum("tokens").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("__in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["source", "__bucket"])
    placed = placed.join(F.broadcast(plan), "source")
    uses = F.when(F.col("__all") > 0, F.ceil(F.col("__budget") / F.col("__all"))).otherwise(F.lit(0)).cast("int")
    used = placed.withColumn("__use", F.explode(F.when(uses > 0, F.sequence(F.lit(0), uses - 1)).otherwise(F.array().cast("array<int>"))))
    start = F.col("__use") * F.col("__all") + F.col("__offset") + F.col("__in")
    used = used.withColumn("desde", start).filter(F.col("desde") < F.col("__budget"))
    job = F.floor(F.col("desde") / block)
    slot = F.get("__slots", job.cast("int"))
    return used.select(
        slot.cast("long").alias("turno"), "source", "desde", (F.col("__use") + 1).alias("repeticion"), "doc_id", "tokens"
    )
