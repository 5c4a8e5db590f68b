import re

import pytest
from pyspark.sql import functions as F

from cartulario.llm.chunking import _counted, split_oversized, unit_count

GAP = re.compile(r"[^ \t\n\r\f]+")
TEXTS = [
    None,
    "",
    "corto",
    "palabra " * 700,
    "x" * 5000,
    "Uno dos tres. Cuatro cinco seis! " * 90,
    "Párrafo uno con palabras.\n\nPárrafo dos; con más. " * 60,
    "\r\n\r\n".join("Línea larga de texto número %d, con coma." % i for i in range(200)),
    "😀é́ñ " * 600,
    "  \t" + "a b\nc " * 400 + " \n\n ",
    "palabra " * 20000,
]


def size(text, unit):
    return len(GAP.findall(text)) if unit == "palabras" else len(text)


@pytest.mark.parametrize("unit,most,overlap", [("palabras", 40, 5), ("caracteres", 160, 16), ("caracteres", 100, 0), ("palabras", 400, 40), ("caracteres", 1600, 160)])
def test_round_trip(spark, unit, most, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, texto string").withColumn("pieza", F.lit("x")).withColumn("desde", F.lit(1.5))
    rows = split_oversized(df, "id", "texto", unit, most, overlap).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    large = {i for i, t in enumerate(TEXTS) if t and size(t, unit) > most}
    assert set(by) == large
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.pieza)
        text, end = TEXTS[i], 0
        assert [p.pieza for p in pieces] == list(range(1, len(pieces) + 1)) and {p.piezas for p in pieces} == {len(pieces)}
        for p in pieces:
            assert 0 < size(p.texto, unit) <= most
            assert text[p.desde : p.hasta] == p.texto and p.desde + p.solape == end
            assert size(p.texto[: p.solape], unit) <= overlap
            end = p.hasta
        assert end == len(text)


def test_prefers_strong_boundaries(spark):
    text = ("Frase de relleno que sigue. " * 4 + "\n\n") * 6
    df = spark.createDataFrame([(1, text)], "id long, texto string")
    pieces = split_oversized(df, "id", "texto", "caracteres", 200, 0).orderBy("pieza").collect()
    assert all(p.texto.endswith("\n\n") for p in pieces)


def test_counts_and_empty(spark):
    df = spark.createDataFrame([(1, " a b  c\n"), (2, None), (3, "")], "id long, t string")
    assert [r[0] for r in df.orderBy("id").select(unit_count(F.col("t"), "palabras")).collect()] == [2, None, 0]
    empty = spark.createDataFrame([], "id long, t string")
    assert split_oversized(empty, "id", "t", "palabras", 10, 2).collect() == []
    with pytest.raises(ValueError):
        split_oversized(empty, "id", "t", "palabras", 10, 10)


@pytest.mark.parametrize("unit,most,overlap", [("palabras", 2000, 100), ("palabras", 100_000, 500), ("caracteres", 100_000, 1000)])
def test_large_limits(spark, unit, most, overlap):
    """Limits far over those of the tables: the depth of the matcher must not grow with them."""
    words = [f"palabra{i % 977}" + (".\n\n" if i % 5000 == 4999 else " ") for i in range(250_000)]
    texts = ["".join(words), "ñ😀" * 150_000, "x " * 210_000]
    rows = split_oversized(spark.createDataFrame(list(enumerate(texts)), "id long, texto string"), "id", "texto", unit, most, overlap).collect()
    assert {r.id for r in rows} == {i for i, t in enumerate(texts) if size(t, unit) > most}
    for i, text in enumerate(texts):
        pieces = sorted((r for r in rows if r.id == i), key=lambda r: r.pieza)
        assert "".join(p.texto[p.solape :] for p in pieces) == (text if pieces else "")
        assert all(0 < size(p.texto, unit) <= most and text[p.desde : p.hasta] == p.texto for p in pieces)
    if unit == "palabras" and most > 5000:
        assert all(p.texto.endswith("\n\n") for p in rows if p.id == 0 and p.pieza < p.piezas)


def test_twenty_megabytes_in_one_text(spark):
    text = "Considerando lo expuesto por la parte. " * 520_000
    got = split_oversized(spark.createDataFrame([(1, text)], "id long, texto string"), "id", "texto", "palabras", 400, 40)
    sums = got.selectExpr("count(*) n", "max(piezas) p", "sum(length(texto) - solape) c", "max(hasta) h").first()
    assert sums.n == sums.p > 7_000 and sums.c == sums.h == len(text)


def test_counts_in_descending_order():
    """The counted pattern tries every number of units once, the largest first."""
    for most in (0, 1, 63, 64, 65, 128, 130, 4095, 4096, 4100, 5000):
        pattern = re.compile(_counted("(?>a)", most, "b"))
        for n in {0, 1, 62, 63, 64, 65, 127, 128, 129, 4094, 4096, 4099, most}:
            found = pattern.match("a" * n + "b")
            assert (found is not None) == (n <= most)
