import random

import pytest
from pyspark.sql import functions as F

from cartulario.llm.readability import LEAST_WORDS, reading_levels, spanish_prose

SMALL = "el la los de que en un una con por y del su al".split()
SUBJECT = {
    1: "abuela casa llave carta papel vecino dinero lista mesa turno".split(),
    2: "municipalidad sindicato prensa audiencia multa reclamo techo contrato obra barrio".split(),
    3: "demandante excepción prescripción costas litigantes recurso notificación fiscal nulidad perjuicios".split(),
    4: "hermenéutica sinalagmática ontológica dogmática subsumible inoponibilidad axiológica aquiliana exceptio redhibitorio".split(),
}


def text(rng, level, n=100, other=None):
    out = []
    for i in range(n):
        source = SUBJECT[other] if other and rng.random() < 0.2 else SUBJECT[level]
        out.append(rng.choice(SMALL) if rng.random() < 0.5 else rng.choice(source))
    return " ".join(out).capitalize() + "."


def corpus():
    rng = random.Random(9)
    rows = [(i, text(rng, i % 4 + 1, other=rng.randrange(1, 5))) for i in range(240)]
    rows += [
        (900, None), (901, ""), (902, " \n"), (903, "el la de " * 10), (904, "The court held that the lease was not in force and " * 12),
        (905, "O tribunal alegou que o prazo não corria por falta de uma prova e em custas da parte " * 6), (906, "1\t2\t3\tel\t4\t5\n" * 40),
        (907, text(rng, 4, 60_000)), (5, rows[5][1]),
    ]
    return rows


def frames(spark, grades=60):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("nivel", F.lit("x")).withColumn("bolsa", F.lit(1)).repartition(4)
    graded = spark.createDataFrame([(i, i % 4 + 1) for i in range(grades)] + [(None, 1), (7, None), (900, 2), (5555, 3)], "doc_id long, nivel int")
    return rows, docs, graded


def test_held_out_accuracy(spark):
    rows, docs, graded = frames(spark)
    out = reading_levels(docs, "doc_id", "text", graded).collect()
    got = {r.doc_id: r.nivel for r in out}
    assert set(got) == {*range(240), 907} and len(out) == 242
    held = [i for i in range(60, 240)]
    assert sum(got[i] == i % 4 + 1 for i in held) / len(held) > 0.97 and got[907] == 4
    mean = {k: [r.dificultad for r in out if r.nivel == k] for k in range(1, 5)}
    assert [round(sum(v) / len(v)) for v in mean.values()] == [1, 2, 3, 4]


def test_nothing_graded_and_empty(spark):
    _, docs, graded = frames(spark)
    assert {r.nivel for r in reading_levels(docs, "doc_id", "text", graded.limit(0)).collect()} == {None}
    assert reading_levels(docs.limit(0), "doc_id", "text", graded).collect() == []
    one = reading_levels(docs, "doc_id", "text", graded.filter("nivel = 2 and doc_id < 50")).collect()
    assert {r.nivel for r in one} == {2}


def test_prose():
    assert spanish_prose("el la de " * (LEAST_WORDS // 3)) is not None and spanish_prose("el la de " * (LEAST_WORDS // 3 - 1)) is None
    assert spanish_prose(None) is None and spanish_prose("9" * 5000) is None


def chain(spark):
    """Texts of which each shares half of its own words with the next; only the two ends are graded."""
    rng = random.Random(3)
    name = lambda i: "".join("aeioubcdfg"[int(c)] for c in f"{i:03d}") + "ez"
    rows = []
    for i in range(9):
        own = [name(10 * i + j) for j in range(20)]
        rows.append((i, " ".join(rng.choice(SMALL) if n % 2 else own[n // 2 % 20] for n in range(160))))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 1), (8, 2)], "doc_id long, nivel int")


def test_rounds_go_on_until_nothing_moves(spark):
    docs, graded = chain(spark)
    got = {r.doc_id: r.dificultad for r in reading_levels(docs, "doc_id", "text", graded).collect()}
    still = {r.doc_id: r.dificultad for r in reading_levels(docs, "doc_id", "text", graded, 1e-6).collect()}
    assert len(got) == 9 and max(abs(got[i] - still[i]) for i in got) < 0.02


def test_what_still_moves_is_told(spark):
    docs, graded = chain(spark)
    with pytest.warns(UserWarning, match="still move by"):
        reading_levels(docs, "doc_id", "text", graded, most=1).collect()
