import random

import pytest
from pyspark.sql import functions as F

from cartulario.llm.scans import CONFUSIONS, corrected, is_cut, is_folio, repair_scans

WORDS = "la demandante solicitó que se declarara nulidad del contrato conforme al mérito informe pericial agregado tribunal rechazó excepción prescripción opuesta por contraria notificación practicó forma legal aseguradora ordenó restituir sumas percibidas reajustes intereses".split()


def sentence(rng, n=14):
    s = " ".join(rng.choice(WORDS) for _ in range(n))
    return s[0].upper() + s[1:] + "."


def wrap(text, width):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def corpus(n=160):
    """Texts with planted noise: (id, contenido, definicion, obra, autor) and the (id, kind) planted."""
    rng, rows, truth = random.Random(11), [], set()
    for i in range(n):
        lines = wrap(" ".join(sentence(rng) for _ in range(6)), 60)
        kinds = {k for k in ("guion", "ocr", "encabezado", "folio") if i % 2 and rng.random() < 0.5}
        if "ocr" in kinds:
            j = next(j for j, l in enumerate(lines) if "contrato" in l or "tribunal" in l or "sumas" in l)
            lines[j] = lines[j].replace("contrato", "coritrato").replace("tribunal", "tri6unal").replace("sumas", "surnas")
        if "guion" in kinds:
            j = next(j for j in range(len(lines) - 1) if len(lines[j].split()[-1]) >= 6 and lines[j][-1].isalpha() and lines[j + 1][0].islower())
            w = lines[j].split()[-1]
            lines[j] = lines[j][: -len(w)] + w[:3] + rng.choice("-¬=‐")
            lines[j + 1] = w[3:] + " " + lines[j + 1]
        opened = [j for j in range(1, len(lines)) if lines[j - 1][-1].isalpha() and lines[j][0].islower()]
        if "encabezado" in kinds:
            lines.insert(rng.choice(opened), rng.choice(["EDICIONES DEL VADO", "Colección Toga Menor", "Tratado de riberas"]))
        elif "folio" in kinds:
            lines.insert(rng.choice(opened), rng.choice(["– 382 –", "Pág. 86", "123", "xviii", "fs. 7", "Foja ciento ochenta y siete"]))
        kinds = kinds - {"folio"} if "encabezado" in kinds else kinds
        truth |= {(i, k) for k in kinds}
        rows.append((i, ("\r\n" if i % 3 else "\n").join(lines), None, "Tratado de riberas", "Alba Abrilete"))
    return rows, truth


@pytest.fixture(scope="module")
def repaired(spark):
    rows, truth = corpus()
    rows += [
        (900, "CUADRO DE PLAZOS\n104\n247\n116\n\n" + "La demandante solicitó nulidad del contrato. " * 4, "", "x", "y"),
        (901, "Texto de una línea que queda como está.", None, None, None),
        (902, None, None, None, None),
        (903, "", "   \n\n\n\n ", "x", "y"),
        (904, "La demandante solicitó -así se dijo-\nla nulidad del contrato entre 1907-\n1907 conforme al mérito\ndel informe pericial por correo a\nmesa480@juzgado.invalid en la sala 421B.", None, "x", "y"),
        (905, "la nulidad del contrato " * 30_000, None, "x", "y"),
        rows[1],
        (None, "Una línea.", None, None, None),
        (2**60 + 1, "Otra línea.", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, contenido string, definicion string, obra string, autor string").withColumn("texto", F.lit(1)).withColumn("tipos", F.lit("z"))
    return rows, truth, repair_scans(df.repartition(3), "id", ["contenido", "definicion"], ["obra", "autor"]).collect()


def test_kinds(repaired):
    rows, truth, out = repaired
    got = {(r.id, k) for r in out for k in r.tipos}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert [x for x in got if x[0] is None or x[0] >= 900] == []


def test_texts_are_continuous(repaired):
    _, truth, out = repaired
    by = {r.id: r for r in out if r.campo == "contenido"}
    for i, k in truth:
        t = by[i].texto
        assert "Toga Menor" not in t and "VADO" not in t and "– 382 –" not in t and "\r" not in t
    assert by[901].texto == "Texto de una línea que queda como está." and by[903].texto == "" and 902 not in by
    assert by[None].texto == "Una línea." and by[2**60 + 1].texto == "Otra línea."
    assert sum(r.id == 1 for r in out) == 2
    assert "dijo- la nulidad" in by[904].texto or "dijo-\nla nulidad" in by[904].texto


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, contenido string, definicion string, obra string, autor string")
    assert repair_scans(df, "id", ["contenido", "definicion"], ["obra", "autor"]).collect() == []


def test_parts():
    words = {"antecedentes": 50, "dijo": 30, "la": 900, "técnico": 9, "contractual": 12, "contrato": 100, "nuevo": 9, "cosa": 50, "casa": 40}
    assert is_cut("ante", "-", "cedentes", words) and not is_cut("dijo", "-", "la", words)
    assert not is_cut("técnico", "-", "contractual", words) and is_cut("técnico", "¬", "contractual", words)
    assert corrected("Coritrato", words) == "Contrato" and corrected("C0NTRATO", words) == "CONTRATO" and corrected("casa", words) is None
    assert corrected("421B", words) is None and corrected("1907", words) is None
    assert is_folio("– 3 –", None) and is_folio("página 3 de 90", "abc") and not is_folio("1907", "entre 1907-") and not is_folio("1907-", None) and not is_folio("233.", None)
    assert len(set(CONFUSIONS)) == len(CONFUSIONS)


def test_many_texts_are_labelled_as_one_by_one():
    """The batched labelling against the textbook's, on texts of many lengths; and tallies against plain counting."""
    import numpy as np

    from cartulario.llm import scans

    rng = np.random.RandomState(3)
    texts = [rng.randint(0, len(scans.FEATURES), n).astype(np.uint8) for n in [0, 1, 1, 2, 700, *rng.randint(0, 40, 600)]]
    start, move, emit = scans.estimated(scans.tallies(texts, [scans.GUESS[t] for t in texts]))

    def plainly(text):
        if not len(text):
            return []
        score = np.array([[sum(e[k, scans.FEATURES[c, j]] for j, e in enumerate(emit)) for k in range(len(scans.LABELS))] for c in text])
        best, back = start + score[0], []
        for row in score[1:]:
            ways = best[:, None] + move
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    got = scans.viterbi(texts, start, move, emit)
    assert all(g.tolist() == plainly(t) for g, t in zip(got[:120], texts[:120]))
    k, n = len(scans.LABELS), len(scans.FEATURES)
    counts = scans.tallies(texts, got)
    assert counts[:k].sum() == sum(len(t) > 0 for t in texts) and counts[k : k + k * k].sum() == sum(max(len(t) - 1, 0) for t in texts) and counts[k + k * k :].sum() == sum(map(len, texts))
    assert (counts[k + k * k :].reshape(k, n).sum(0) == np.bincount(np.concatenate(texts), minlength=n)).all()


def told_apart(spark, monkeypatch, words, lines, rows):
    """Repaired texts with at most so many words and running lines in the model."""
    from cartulario.llm import scans

    monkeypatch.setattr(scans, "LEXICON", words)
    monkeypatch.setattr(scans, "KNOWN_LINES", lines)
    monkeypatch.setattr(scans, "PACK", 20_000)
    df = spark.createDataFrame(rows, "id long, key string, n string, obra string, autor string")
    return sorted(repair_scans(df.repartition(3), "id", ["key", "n"], ["obra", "autor"]).collect(), key=repr)


def test_words_and_lines_beyond_the_model_count_too(spark, monkeypatch):
    """A model of few or no words and lines gives what one of all gives: cuts, misread words and running lines."""
    rows, truth = corpus(120)
    rows += [
        (900, "El informe conforme al conforma-\ndo por la deman-\ndante ante-\nriormente conte-\nni-\ndo en el contra-\nto\nDE LA RIBERA\ny todo lo de-\nmás", "Un coritrato y CORITRATO y Tri6unal, surnas de mesa@casa.cl", "x", "y"),
        (901, None, "", None, None),
        (None, "Una línea con tri6unal.", "   \n\n\n\n ", None, None),
        rows[1],
    ]
    whole = told_apart(spark, monkeypatch, 200_000, 50_000, rows)
    assert len([r for r in whole if r.tipos]) > 40
    for words, lines in ((20, 50_000), (200_000, 1), (20, 1), (0, 0)):
        assert told_apart(spark, monkeypatch, words, lines, rows) == whole


def test_texts_that_ask_nothing(spark, monkeypatch):
    rows = [(1, None, None, None, None), (2, "la ley", None, None, None), (3, "", None, None, None)]
    for words in (200_000, 1, 0):
        got = told_apart(spark, monkeypatch, words, words, rows)
        assert [(r.id, r.tipos, r.texto) for r in got] == [(2, [], "la ley"), (3, [], "")]


def test_cut_words_are_asked_for():
    """Whatever the cuts before were, the words that the cuts of a text look up are among those asked for."""
    from collections import UserDict

    from cartulario.llm import scans

    class Seen(UserDict):
        def get(self, key, default=None):
            seen.add(key)
            return rng.choice([0, 0, 1, 2, 3, 9])

    rng = random.Random(5)
    for _ in range(300):
        lines = [rng.choice(["ante", "ce", "uno dos", "Tres", "x1", "", "a" * 150]) + rng.choice(["-", "-", "¬", "", "."]) for _ in range(rng.randint(1, 12))]
        labels = [rng.choice([0, 0, 0, 1, 2, 3, 4]) for _ in lines]
        seen = set()
        repairer = scans.Repairer(scans.Model())
        repairer.told({}, {})
        repairer.words = Seen()
        repairer._labelled("\n".join(lines), lines, scans.FEATURES[[0] * len(lines)], scans.np.array(labels))
        assert seen <= scans.at_cuts(lines, labels)


def test_equally_frequent_words_go_by_order():
    for a, b in (("tato", "íato"), ("íato", "tato")):
        assert corrected("fato", {a: 5, b: 5}) == "tato"
    assert corrected("fato", {"tato": 5, "íato": 6}) == "íato"
