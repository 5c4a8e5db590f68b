"""Queries on time, state and change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.functions.dates import iso_date
from cartulario.operators import incremental as ops
from cartulario.operators import relational
from cartulario.plans.base import Catalogue
from cartulario.session import table
from cartulario.streaming import streams

CATALOGUE = Catalogue()
_NOW = "2024-01-12 00:00:00"


@CATALOGUE.query(
    f"""SELECT user_id, ts, event_id, TIMESTAMP '{_NOW}' - ts < INTERVAL 86400 SECOND AS vigente FROM events WHERE ts <= TIMESTAMP '{_NOW}'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def ttl_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user at a moment, and whether it is younger than a day."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return ops.latest_valid(e, "user_id", "ts", 86_400, F.lit(_NOW).cast("timestamp"))


@CATALOGUE.query(
    """SELECT event_id, count(*) OVER w AS previos, count(*) OVER w > 3 AS excede FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW)"""
)
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's events in the six hours before."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ops.rate_in_window(e, "user_id", "ts", 21_600, 3).select("event_id", "previos", "excede")


@CATALOGUE.query(
    """WITH x AS (SELECT id, n, ingresado_en, CASE WHEN regexp_matches(fecha, '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(fecha AS DATE)
                  WHEN regexp_matches(fecha, '^\\d{2}[/-]\\d{2}[/-]\\d{4}$') THEN CAST(try_strptime(replace(fecha, '/', '-'), '%d-%m-%Y') AS DATE) END AS f FROM entrada)
       SELECT id, n FROM x WHERE coalesce(date_diff('day', f, CAST(ingresado_en AS DATE)) <= 30, true) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingresado_en, n) = 1"""
)
def late_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery of each entry, deliveries more than thirty days after its date aside."""
    e = table(spark, sf_dir, "entrada").select("id", "n", "fecha", "ingresado_en")
    happened = F.to_date(iso_date(F.col("fecha")))
    return ops.on_time_first(e, ["id"], happened, F.to_date("ingresado_en"), 30, [F.col("ingresado_en"), F.col("n")]).select("id", "n")


@CATALOGUE.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS desde, event_type, count(*) AS n, round(sum(value), 4) AS suma FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums by type."""
    out = ops.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value")
    return out.withColumn("suma", F.round("suma", 4))


@CATALOGUE.query(
    """SELECT b - INTERVAL (k * 15) MINUTE AS desde, event_type, count(*) AS n FROM (SELECT event_type, ts, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events), range(4) r(k) GROUP BY 1, 2"""
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an hour, every quarter of an hour."""
    return ops.sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes", ["event_type"])


@CATALOGUE.query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nuevo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(nuevo) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS desde, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, ended by half an hour without events."""
    return ops.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "user_id")


@CATALOGUE.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS desde, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type from a stream over the events."""
    schema = table(spark, sf_dir, "events").schema
    events = streams.read_stream(spark, sf_dir, "events.parquet", schema)
    return streams.run_to_end(streams.windowed(events, "ts", "2 hours", "1 hour", None, ["event_type"])).withColumn("desde", F.col("desde").cast("timestamp_ntz"))


@CATALOGUE.query(
    """SELECT lower(trim(source)) AS source, count(*) AS filas FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1"""
)
def delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after a delta, from the counts before it: the same as counting anew."""
    from cartulario.operators.heavy_keys import folded

    d = table(spark, sf_dir, "documents").select("doc_id", folded("source").alias("source"))
    old, new = d.filter("doc_id % 7 <> 0"), d.filter("doc_id % 5 <> 0")
    before = old.groupBy("source").agg(F.count(F.lit(1)).alias("filas"))
    removed, added = old.join(new.select("doc_id"), "doc_id", "left_anti"), new.join(old.select("doc_id"), "doc_id", "left_anti")
    return ops.adjusted_counts(before, removed, added, ["source"])


@CATALOGUE.query("SELECT doc_id, length(text) AS letras FROM documents WHERE doc_id % 5 <> 0")
def delta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table derived by record after a delta: the same as deriving it anew."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    old, new = d.filter("doc_id % 7 <> 0"), d.filter("doc_id % 5 <> 0")
    derive = lambda x: x.select("doc_id", F.length("text").cast("long").alias("letras"))
    changes = relational.snapshot_diff(old, new, "doc_id", ["text"])
    fresh = new.join(changes.filter("cambio <> 'eliminado'").select("doc_id"), "doc_id", "left_semi")
    return ops.apply_delta(derive(old), changes, derive(fresh), "doc_id")


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
