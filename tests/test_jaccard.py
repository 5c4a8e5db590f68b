import pyarrow as pa
import pyarrow.parquet as pq

from cartulario.operators import relational as ops
from cartulario.plans import registry


def test_sets_of_one_take_part(spark, tmp_path):
    """Suppliers of orders: equal sets of one are alike; the smaller job on parts leaves sets of one out, as README says."""
    sets = {1: [7], 2: [7], 3: [7, 8], 4: [7, 8, 9], 5: [7, 8, 9, 10, 11], 6: [5]}
    rows = [(k, m) for k, v in sets.items() for m in v]
    t = pa.table({"l_orderkey": pa.array([k for k, _ in rows], pa.int64()), "l_partkey": pa.array([m for _, m in rows], pa.int64()), "l_suppkey": pa.array([m for _, m in rows], pa.int64())})
    pq.write_table(t, tmp_path / "lineitem.parquet")
    got = {(r.a, r.b, r.comunes, r.jaccard) for r in registry.QUERIES["jaccard_supplier_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 1, 1.0), (3, 4, 2, 0.666666667), (4, 5, 3, 0.6)}
    assert {(r.a, r.b) for r in registry.QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()} == {(3, 4), (3, 5), (4, 5)}


def test_sets_are_moved_twice(spark):
    """Lines are shuffled by key and probes by members: no list of candidates, and no set for each candidate, is."""
    rows = [(k, m) for k in range(40) for m in range(k % 7, k % 7 + 1 + k % 5)]
    df = spark.createDataFrame(rows + rows[:9] + [(None, 1), (1, None)], "k long, m long")
    sets = {}
    for k, m in rows:
        sets.setdefault(k, set()).add(m)
    for least in (0.3, 0.4, 0.5, 0.6, 0.75, 1.0):
        found = ops.jaccard_pairs(df, "k", "m", least)
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-9}
        rows_of = [(r.a, r.b, r.comunes) for r in found.collect()]
        assert set(rows_of) == want and len(rows_of) == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 3 and "Distinct" not in plan
