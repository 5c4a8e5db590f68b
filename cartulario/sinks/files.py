"""Deterministic, partitioned and incremental writers, and updates of tables by key."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANIFEST = "particion string, filas long, bytes long, sha256 string, escrita boolean"


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with keys in order of the alphabet and without null fields."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "true"})


def normalized_line(line: str) -> str:
    """A JSON line with sorted keys, composed characters and no floats: numbers that are not whole are refused."""

    def refuse(value: str):
        raise ValueError(f"a float in a persisted row: {value}")

    return unicodedata.normalize("NFC", json.dumps(json.loads(line, parse_float=refuse), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def write_partitions(df: DataFrame, route: str, identifier: str, folder: str, known: dict[str, str] | None = None) -> DataFrame:
    """Writes one gzipped JSON-lines file per value of ``route`` and returns the manifest.

    Rows are sorted by id and line, keys sorted, characters composed and the archive's time
    fixed, so equal rows give equal bytes. ``known`` maps partitions to the sha256 of what
    is there: partitions with the same content are not written again. Each file is streamed
    by one task under a temporary name and then renamed, so a lost executor leaves no half
    file. ``folder`` is shared by all executors.
    """
    known = known or {}
    lines = df.select(F.col(route).cast("string").alias("p"), F.col(identifier).cast("string").alias("i"), canonical_json(df.drop(route)).alias("l"))
    ordered = lines.filter("p IS NOT NULL").repartition("p").sortWithinPartitions("p", "i", "l")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        done, current = [], None
        for frame in frames:
            for name, line in zip(frame["p"], frame["l"]):
                if current is None or current.name != name:
                    if current is not None:
                        done.append(current.close(known))
                    current = _File(folder, name)
                current.add(normalized_line(line))
        if current is not None:
            done.append(current.close(known))
        yield pd.DataFrame(done, columns=["particion", "filas", "bytes", "sha256", "escrita"])

    manifest = ordered.mapInPandas(run, MANIFEST)
    return df.sparkSession.createDataFrame(manifest.collect(), MANIFEST)


class _File:
    """One file on its way to its name."""

    def __init__(self, folder: str, name: str) -> None:
        self.name, self.rows = name, 0
        self.path = os.path.join(folder, f"{name}.jsonl.gz")
        self.temporary = f"{self.path}.{os.getpid()}.tmp"
        self.raw = open(self.temporary, "wb")  # noqa: SIM115
        self.out = gzip.GzipFile(fileobj=self.raw, mode="wb", mtime=0, filename="")
        self.hash = hashlib.sha256()

    def add(self, line: str) -> None:
        data = (line + "\n").encode("utf-8")
        self.hash.update(data)
        self.out.write(data)
        self.rows += 1

    def close(self, known: dict[str, str]) -> tuple:
        self.out.close()
        self.raw.close()
        digest, size = self.hash.hexdigest(), os.path.getsize(self.temporary)
        fresh = known.get(self.name) != digest
        if fresh:
            os.replace(self.temporary, self.path)
        else:
            os.remove(self.temporary)
        return self.name, self.rows, size, digest, fresh


def update_partitions(df: DataFrame, route: str, identifier: str, folder: str, state: str = "estado.json") -> DataFrame:
    """``write_partitions`` against the state file of the last time: unchanged partitions stay, vanished ones are deleted.

    The state file holds one entry per partition and is replaced as a whole at the end.
    """
    path = os.path.join(folder, state)
    os.makedirs(folder, exist_ok=True)
    known = json.load(open(path)) if os.path.exists(path) else {}  # noqa: SIM115
    manifest = write_partitions(df, route, identifier, folder, known)
    rows = {r.particion: r.sha256 for r in manifest.collect()}
    for gone in known.keys() - rows.keys():
        if os.path.exists(os.path.join(folder, f"{gone}.jsonl.gz")):
            os.remove(os.path.join(folder, f"{gone}.jsonl.gz"))
    with open(f"{path}.tmp", "w") as f:
        json.dump(dict(sorted(rows.items())), f)
    os.replace(f"{path}.tmp", path)
    return manifest


def partition_of(path: Column) -> Column:
    """The partition that a path belongs to: collection and, for the largest one, its year."""
    parts = F.split(path, "/")
    kind = F.regexp_replace(F.element_at(parts, 1), "^corpus_", "")
    return F.when((kind == "cs") & (F.size(parts) > 2), F.concat(kind, F.lit("-"), F.element_at(parts, 2))).otherwise(kind)


def upserted(base: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A table with fresh rows in place of those of the same key; of several fresh rows of a key the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    one = fresh.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return base.join(one.select(*keys), keys, "left_anti").unionByName(one.select(*base.columns))


def numbered(df: DataFrame, order: list[Column], prefix: str, digits: int = 6) -> DataFrame:
    """Rows with ``id_serie``, consecutive zero-padded numbers in order.

    Numbers come from a range-partitioned sort: places within each range, moved up by the
    rows of the ranges before, so no task sees all rows.
    """
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    # One row per range.
    w = Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", F.coalesce(F.sum("__rows").over(w), F.lit(0)).alias("__before"))
    inner = parts.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    out = inner.join(F.broadcast(before), "__part")
    number = F.lpad((F.col("__in") + F.col("__before")).cast("string"), digits, "0")
    return out.select(*df.columns, F.concat(F.lit(prefix), number).alias("id_serie"))
