from collections import defaultdict

from pyspark.sql import functions as F

from cartulario.operators.heavy_keys import folded, heavy_keys, summarise_keys

SCHEMA = "destino long, rel string, origen long, n long, filas string, __distinct int"


def rows():
    out = [(1, r, i % 7, 2, "x", 0) for i, r in enumerate([" Normas", "normas", "NORMAS "] * 100)]
    out += [(2, "sala", None, None, "x", 0), (None, "sala", 1, 1, "x", 0), (3, None, 1, 1, "x", 0), (2, "sala", 4, 5, "x", 0)]
    return out


def expected(data):
    state = defaultdict(lambda: [0, set(), 0])
    for d, r, o, n, *_ in data:
        s = state[(d, r.strip().lower() if r is not None else None)]
        s[0] += 1
        s[1] |= {o} - {None}
        s[2] += n or 0
    return {(*k, v[0], len(v[1]), v[2]) for k, v in state.items()}


def keys():
    return {"destino": F.col("destino"), "rel": folded("rel")}


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = summarise_keys(df, keys(), F.col("origen"), F.col("n"))
    assert {tuple(r) for r in got.collect()} == expected(rows())


def test_share_counts_null_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = heavy_keys(df, keys(), 0.5).collect()
    assert [(r.destino, r.rel) for r in got] == [(1, "normas")]
    got = heavy_keys(df, keys(), 0.0).collect()
    assert {(r.destino, r.rel) for r in got} == {(1, "normas"), (2, "sala")}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert summarise_keys(df, keys(), F.col("origen"), F.col("n")).collect() == []
    assert heavy_keys(df, keys(), 0.01).collect() == []


def test_bitmaps_and_pairs_agree(spark):
    """Whether keys count as heavy changes nothing; values may be negative, null or far apart, and of any type."""
    data = [(i % 3, " Rel"[i % 2 :], (i * 7919) % 200_003 - 100_000 if i % 11 else None, i % 5 if i % 7 else None, "x", 0) for i in range(6000)] + [(9, "sola", 1, 1, "x", 0)] + rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    want = expected(data)
    for heavy in (0.001, 0.2, 2.0):
        assert {tuple(r) for r in summarise_keys(df, keys(), F.col("origen"), F.col("n"), heavy).collect()} == want
    assert {tuple(r) for r in summarise_keys(df, keys(), F.col("origen").cast("string"), F.col("n")).collect()} == want


def test_hot_key_sends_states(spark):
    """Rows of a hot key are combined where they are read: what is shuffled does not grow with them."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") % 50_000).alias("v"))
    got = summarise_keys(df, {"k": F.col("k")}, F.col("v"), F.lit(1)).collect()
    assert [tuple(r) for r in got] == [(1, 200_000, 50_000, 200_000)]
    plan = summarise_keys(df, {"k": F.col("k")}, F.col("v"), F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "partial_count" in plan
