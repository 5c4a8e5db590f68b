"""Per-key results where a few keys hold most of the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "__key_{}"


def folded(column: Column | str) -> Column:
    """A label trimmed of outer white space and lower-cased; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


#: A key of at least this share of all rows has its distinct values kept as bitmaps; there are at most as many such keys as the share goes into one.
HEAVY = 0.001


def _flat(df: DataFrame, keys: dict[str, Column], distinct: Column, amount: Column) -> DataFrame:
    return df.select(
        *[expr.alias(KEY.format(i)) for i, expr in enumerate(keys.values())],
        distinct.alias("__distinct"),
        F.coalesce(amount.cast("long"), F.lit(0).cast("long")).alias("__amount"),
    )


def summarise_keys(df: DataFrame, keys: dict[str, Column], distinct: Column, amount: Column, heavy: float = HEAVY) -> DataFrame:
    """Rows, distinct values and a sum for each key, without a task per key.

    A first count finds the keys that hold at least ``heavy`` of all rows, a number of keys
    that the share bounds. Their rows are combined where they are read: each map task keeps,
    for a key and a range of 32,768 values, one bitmap of the values seen with the count and
    the sum, and only these compact states are shuffled and merged. The rows of all other keys
    go through two algebraic aggregations, the first by key and distinct value, so that no
    state is larger than a row. Distinct values that are no whole numbers take the second way for all keys.

    Nulls: a null in a key forms a key of its own; a null distinct value counts
    in ``filas`` but not in ``distintos``; a null amount adds nothing (a key of
    null amounts only has sum 0). Repeated rows count each time. An empty table gives
    no rows. Columns besides those used are ignored, whatever their names.
    """
    names = list(keys)
    flat = _flat(df, keys, distinct, amount)
    inner = [KEY.format(i) for i in range(len(names))]
    sums = [F.sum("__rows").alias("filas"), F.sum("__d").alias("distintos"), F.sum("__amount").alias("suma")]
    light = flat
    parts = []
    if flat.schema["__distinct"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        total = df.agg(F.count(F.lit(1))).scalar()
        # At most 1 / heavy keys: the bound of what is broadcast.
        hot = flat.groupBy(*inner).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") >= F.lit(heavy) * total).select(*[F.col(c).alias(f"{c}h") for c in inner])
        same = F.lit(True)
        for c in inner:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}h"))
        marked = flat.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), same, "left").drop(*[f"{c}h" for c in inner])
        light = marked.filter("__hot IS NULL OR __distinct IS NULL")
        value = F.col("__distinct").cast("long")
        states = marked.filter("__hot AND __distinct IS NOT NULL").groupBy(*inner, F.bitmap_bucket_number(value).alias("__bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("__bits"), F.count(F.lit(1)).alias("__rows"), F.sum("__amount").alias("__amount")
        )
        parts.append(states.select(*inner, F.bitmap_count("__bits").alias("__d"), "__rows", "__amount"))
    fine = light.groupBy(*inner, "__distinct").agg(F.count(F.lit(1)).alias("__rows"), F.sum("__amount").alias("__amount"))
    parts.append(fine.select(*inner, F.when(F.col("__distinct").isNotNull(), 1).otherwise(0).cast("long").alias("__d"), "__rows", "__amount"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*inner).agg(*sums).select(*[F.col(KEY.format(i)).alias(n) for i, n in enumerate(names)], "filas", "distintos", "suma")


def heavy_keys(df: DataFrame, keys: dict[str, Column], share: float) -> DataFrame:
    """Keys without nulls that hold at least ``share`` of all rows, with their number of rows (``filas``).

    One count, combined in the map tasks: a task sends one row per key that it saw, however many
    rows the key has. The total counts every row, those with null keys included; it is a scalar
    subquery, so only one number goes to the tasks. A table without rows gives no keys.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    flat = df.select(*[expr.alias(KEY.format(i)) for i, expr in enumerate(keys.values())]).dropna()
    counted = flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("filas"))
    return counted.filter(F.col("filas") >= F.lit(share) * total).select(*[F.col(KEY.format(i)).alias(n) for i, n in enumerate(keys)], "filas")
