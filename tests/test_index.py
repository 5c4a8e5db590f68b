"""A written index answers as the scan does, and opens only what it needs."""

import os

import pytest
from pyspark.sql import functions as F

from cartulario.operators import search

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_indexed_searches(spark, tmp_path):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    grams, posts = str(tmp_path / "g"), str(tmp_path / "p")
    search.write_index(search.trigram_index(d, "doc_id", "text"), "trigrama", "doc", grams)
    search.write_index(search.postings(d, "doc_id", {"texto": F.col("text")}), "termino", "doc", posts)
    for needle in ("prescripción", "CAMINO", "llave", "no hay tal cosa", "de "):
        want = {r.doc for r in search.substring_search(d, "doc_id", "text", [needle]).collect()}
        assert {r.doc for r in search.indexed_substring(spark, grams, d, "doc_id", "text", needle).collect()} == want
    rows = search.indexed_rows(spark, posts, "termino", ["contrato", "multa", "contrato"])
    want = {tuple(r) for r in search.postings(d, "doc_id", {"texto": F.col("text")}).filter("termino IN ('contrato', 'multa')").select("doc", "termino", "tf").collect()}
    assert {tuple(r) for r in rows.select("doc", "termino", "tf").collect()} == want and want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "cubo" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert search.indexed_rows(spark, posts, "termino", []).count() == 0
    with pytest.raises(ValueError):
        search.indexed_substring(spark, grams, d, "doc_id", "text", "de")


def test_running_lines_are_found_within_a_text(spark):
    from cartulario.functions.segments import without_running_lines

    text = "\n".join(line for i in range(6) for line in ("  LIBRO UNO ", f"línea {i}", str(i + 10), "corto", "")) + "\nsolo cinco\n" * 5
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "x\r\n 12 ")], "id long, t string")
    got = [tuple(r) for r in without_running_lines(df, "id", "t").collect()]
    body = "\n".join(line for i in range(6) for line in (f"línea {i}", "corto", "")) + "\nsolo cinco\n" * 5
    assert sorted(got) == sorted([(1, body), (1, body), (3, ""), (4, "x")])
