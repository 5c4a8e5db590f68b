import pytest
from pyspark.sql import functions as F

from cartulario.operators import incremental
from cartulario.streaming import streams


@pytest.fixture()
def events(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 6}:{(i * 7) % 60:02d}:00", f"u{i % 3}", float(i)) for i in range(60)] + [(0, "2024-01-01 00:00:00", "u0", 0.0)]
    df = spark.createDataFrame(rows, "id long, t string, u string, v double").select("id", F.to_timestamp("t").alias("ts"), "u", "v")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def stream(spark, df, folder):
    return streams.read_stream(spark, folder, "*.parquet", df.schema)


def test_windows_and_sessions_equal_batch(spark, events):
    df, folder = events
    got = streams.run_to_end(streams.windowed(stream(spark, df, folder), "ts", "1 day", "1 hour", None, ["u"]))
    assert same(got, incremental.tumbling(df, "ts", "1 hour", ["u"], "v").drop("suma"))
    got = streams.run_to_end(streams.windowed(stream(spark, df, folder), "ts", "1 day", "1 hour", "30 minutes", ["u"]))
    assert same(got, incremental.sliding(df, "ts", "1 hour", "30 minutes", ["u"]))
    got = streams.run_to_end(streams.session_counts(stream(spark, df, folder), "ts", "1 day", "20 minutes", "u"))
    assert same(got, incremental.sessions(df, "ts", "20 minutes", "u"))


def test_deduplication(spark, events):
    df, folder = events
    got = streams.run_to_end(streams.deduplicated(stream(spark, df, folder), "ts", "1 day", ["id"]), "append")
    assert got.count() == 60


def test_last_samples(spark, events):
    df, folder = events
    out = streams.last_samples(stream(spark, df, folder), "u", "v", 5)
    query = out.writeStream.format("memory").queryName("muestras").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.sql("SELECT u, max(n) AS n FROM muestras GROUP BY u").collect()
    assert {r.u: r.n for r in last} == {"u0": 5, "u1": 5, "u2": 5}


def test_late_and_rates(spark, events):
    df, _ = events
    out = incremental.rate_in_window(df, "u", "ts", 3600, 5).collect()
    for r in out:
        assert r.previos == sum(1 for x in out if x.u == r.u and 0 <= (r.ts - x.ts).total_seconds() <= 3600)
