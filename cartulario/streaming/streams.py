"""Structured Streaming forms of the time-based operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, name: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder that have a name; the schema is given, not inferred.

    Times without a zone become those of the session, as event time needs.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumns({c: stream[c].cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"})


def windowed(stream: DataFrame, at: str, delay: str, length: str, every: str | None, keys: list[str]) -> DataFrame:
    """Counts in tumbling or sliding windows; events later than ``delay`` are left out."""
    w = F.window(at, length, every) if every else F.window(at, length)
    grouped = stream.withWatermark(at, delay).groupBy(w.alias("__w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("__w.start").alias("desde"), *keys, "n")


def session_counts(stream: DataFrame, at: str, delay: str, gap: str, key: str) -> DataFrame:
    """Events of each session of a key."""
    grouped = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("__w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("__w.start").alias("desde"), "n")


def deduplicated(stream: DataFrame, at: str, delay: str, keys: list[str]) -> DataFrame:
    """The first event of each key; keys are forgotten once ``delay`` has passed."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def last_samples(stream: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """After each batch, for each key with news, the count and median of its last ``most`` values: key, n, mediana.

    The state of a key is its last values, bounded by ``most``.
    """
    kind = stream.schema[key].dataType.simpleString()

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            held = (held + frame[value].dropna().tolist())[-most:]
        state.update((held,))
        yield pd.DataFrame({key: [name[0]], "n": [len(held)], "mediana": [float(pd.Series(held).median()) if held else None]})

    return stream.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, n long, mediana double", "valores array<double>", "update", GroupStateTimeout.NoTimeout
    )


def run_to_end(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its last complete result.

    The result goes to the shared checkpoint folder batch by batch, not to the driver; only
    where all runs on one machine, as in tests, is a temporary folder made.
    """
    spark = result.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cartulario-stream-")
    out, state = (f"{base}/stream-{uuid.uuid4().hex}-{part}" for part in ("out", "state"))
    schema = result.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(schema).parquet(out)
