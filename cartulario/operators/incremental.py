"""Incremental and time-based operators, the batch counterparts of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(column: Column | str) -> Column:
    """A moment in microseconds since 1970; times without a zone are those of the session."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def latest_valid(df: DataFrame, key: str, at: str, seconds: int, now: Column) -> DataFrame:
    """The last row of each key up to ``now`` and whether it is younger than ``seconds``: adds ``vigente``."""
    best = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in df.columns if c not in (key, at)])
    last = df.filter(F.col(at) <= now).withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")
    return last.withColumn("vigente", instant(now) - instant(at) < seconds * 1_000_000)


def rate_in_window(df: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """Each event with the number of its key's events in the ``seconds`` up to it, and whether that is over ``most``."""
    w = Window.partitionBy(key).orderBy(instant(at)).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("previos", F.count(F.lit(1)).over(w)).withColumn("excede", F.col("previos") > most)


def on_time_first(df: DataFrame, keys: list[str], happened: Column, arrived: Column, days: int, order: list[Column]) -> DataFrame:
    """The first row of each key among those that arrived within ``days`` of what they tell; rows without a date count as in time."""
    timely = F.coalesce(F.datediff(arrived, happened) <= days, F.lit(True))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.filter(timely).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def tumbling(df: DataFrame, at: str, length: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums in fixed windows: desde, keys, n, suma."""
    grouped = df.groupBy(F.window(at, length).alias("__w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("suma"))
    return grouped.select(F.col("__w.start").alias("desde"), *keys, "n", "suma")


def sliding(df: DataFrame, at: str, length: str, every: str, keys: list[str]) -> DataFrame:
    """Counts in windows that overlap: desde, keys, n."""
    grouped = df.groupBy(F.window(at, length, every).alias("__w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("__w.start").alias("desde"), *keys, "n")


def sessions(df: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    """Sessions of each key, ended by a pause of ``gap``: key, desde, n. Merged from partial sessions on the map side."""
    grouped = df.groupBy(F.session_window(at, gap).alias("__w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("__w.start").alias("desde"), "n")


def apply_delta(base: DataFrame, changes: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A derived table after a delta: rows of changed or removed keys go, rows of ``new`` come.

    ``changes`` has the keys and ``cambio``; ``new`` holds the rows derived from added and changed
    records only. The result equals a full rebuild if the derivation is by record.
    """
    gone = changes.filter("cambio <> 'agregado'").select(key)
    return base.join(gone, key, "left_anti").unionByName(new.select(*base.columns))


def adjusted_counts(counts: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (keys, filas) after taking some records away and adding others, without counting the rest again."""
    minus = removed.groupBy(*keys).agg((-F.count(F.lit(1))).alias("filas"))
    plus = added.groupBy(*keys).agg(F.count(F.lit(1)).alias("filas"))
    total = counts.select(*keys, "filas").unionByName(minus).unionByName(plus).groupBy(*keys).agg(F.sum("filas").alias("filas"))
    return total.filter("filas <> 0")
