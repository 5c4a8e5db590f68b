"""Parts of rulings and opinions, rows of harvested files, and joins by names."""

from pyspark.sql import functions as F

from cartulario.functions import anatomy, fields
from cartulario.operators import names

RULING = """Santiago, tres de mayo de dos mil veinte.
VISTOS:
Que compareció la demandante.
PRIMERO: Que la demandada declaró ante testigos y acompañó prueba.
SEGUNDO: Que el artículo 1545 del Código Civil y la ley obligan.
Tercero.- Que consta la fecha de los hechos.
SE RESUELVE: acoger la demanda, con costas.
Acordada con el voto en contra del ministro Uno, quien estuvo por rechazarla."""


def one(spark, text, part):
    return spark.createDataFrame([(text,)], "t string").select(part(F.col("t")).alias("r")).first().r


def test_ruling_parts(spark):
    r = one(spark, RULING, anatomy.ruling_parts)
    assert r.vistos.startswith("Santiago") and r.vistos.endswith("demandante.")
    assert [(c.numero, c.tipo) for c in r.considerandos] == [(1, "HECHO"), (2, "DERECHO"), (3, "HECHO")]
    assert r.considerandos[1].texto.startswith("SEGUNDO") and r.resolutiva == "SE RESUELVE: acoger la demanda, con costas." and r.costas
    assert r.disidencia.startswith("Acordada")
    for text in (None, "", "sin partes"):
        empty = one(spark, text, anatomy.ruling_parts)
        assert empty.considerandos == [] and empty.resolutiva is None and empty.disidencia is None and not empty.costas


def test_opinion_parts(spark):
    r = one(spark, "Se consulta sobre un plazo.\n\nLa Ley N° 19.880 lo fija.\r\n\r\nEn consecuencia, procede.", anatomy.opinion_parts)
    assert (r.antecedentes, len(r.parrafos), r.conclusion) == ("Se consulta sobre un plazo.", 3, "En consecuencia, procede.")
    none = one(spark, None, anatomy.opinion_parts)
    assert (none.antecedentes, none.parrafos, none.conclusion) == (None, [], None)


def test_supreme_row(spark):
    text = "# Caso\n- **Tribunal:** CS\n- **Rol:** N° 1.234-2020 · **Era:** — · **Fecha:** 03/05/2020\n- **Ministros:** Ana Uno; Luis Dos, \n---\npie"
    r = one(spark, text, anatomy.supreme_row)
    assert (r.rol, r.era, r.fecha, r.sala, r.ministros) == ("1234-2020", 2020, "2020-05-03", None, ["Ana Uno", "Luis Dos"])


def test_environmental_row(spark):
    df = spark.createDataFrame([("ta/2ta/R-12-2019.md", "- **Rol:** R-11-2019 y r-12-2019\n---\n" + "x" * 2001), ("x.md", None)], "p string, t string")
    a, b = (r.r for r in df.select(anatomy.environmental_row(F.col("p"), F.col("t")).alias("r")).collect())
    assert (a.tribunal, a.rol, a.acumulados, a.tiene_texto) == ("2ta", "r-11-2019", ["r-12-2019"], True) and b.rol is None


def test_ordinals(spark):
    cases = {"primero": 1, "Séptima": 7, "décimo": 10, "decimoprimero": 11, "undécima": 11, "duodécimo": 12, "vigésima segunda": 22, "nonagésimo noveno": 99, "trigésimo": 30, "casa": None, "": None, "primer casa": None}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "w string")
    assert {r.w: r.n for r in df.select("w", fields.ordinal_number(F.col("w")).alias("n")).collect()} == {**cases, None: None}


def test_names_in_text_edges(spark):
    texts = spark.createDataFrame([(1, "El Río Calmoso y el río calmoso."), (1, "El Río Calmoso y el río calmoso."), (2, None), (3, ""), (4, "rio"), (5, "del rio calmosos")], "id long, t string")
    known = spark.createDataFrame([("a", "Río Calmoso"), ("b", "río"), ("c", None), ("a", "rio  CALMOSO"), ("d", "calmoso")], "k string, n string")
    got = sorted(tuple(r) for r in names.names_in_text(texts, "id", "t", known, "k", "n").distinct().collect())
    assert got == [(1, "a", 2), (1, "d", 2)]
    assert names.names_in_text(texts.limit(0), "id", "t", known, "k", "n").collect() == []
