import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulario.llm.canonical import NONE, Strings, Tree, allowed, map_to_canonical, match_values, plain_distance, swap_distance

ENTRIES = [
    ("t1", "tribunal", "Corte Suprema"),
    ("t2", "tribunal", "Corte de Apelaciones de Lontuey"),
    ("t3", "tribunal", "Corte de Apelaciones de Villa Arrayán"),
    ("t4", "tribunal", "1° Juzgado Civil de Trebunco"),
    ("t5", "tribunal", "2° Juzgado Civil de Trebunco"),
    ("t6", "tribunal", "Juzgado de Letras del Trabajo de Lontuey"),
    ("t7", "tribunal", "Tercer Tribunal Ambiental"),
    ("t8", "tribunal", "Juzgado de Familia de Lontuey"),
    ("s6", "sala", "Sexta Sala, Minera"),
    ("sv", "sala", "Sala de Verano"),
    ("m1", "materia", "Concesión minera"),
    ("m2", "materia", "Pensión de alimentos"),
]
TYPED = [
    ("tribunal", "  EXCMA. CORTE SUPREMA.", "t1"), ("tribunal", "Ecxma. Crote Suprema", "t1"), ("tribunal", "C. Suprema", "t1"),
    ("tribunal", "Suprema Corte", "t1"), ("tribunal", "C.A. de Lontuey", "t2"), ("tribunal", "lontuey, corte de apelaciones", "t2"),
    ("tribunal", "Corte de_Apelaciones de Vila Arrayan", "t3"), ("tribunal", "Corte de Apelaciones de VILLA ARRAYÃ¡N", "t3"),
    ("tribunal", "I Juzgado Civil de Trebunco", "t4"), ("tribunal", "Segundo Jdo. Civil Trebunco", "t5"), ("tribunal", "2° Juzgado Civil de Trebunio", "t5"),
    ("tribunal", "4° Juzgado Civil de Trebunco", NONE), ("tribunal", "JLT Lontuey", "t6"), ("tribunal", "Lontuey - Juzgado de Letras del Trabajo", "t6"),
    ("tribunal", "3TA", "t7"), ("tribunal", "3º TA", "t7"), ("tribunal", "1TA", NONE), ("tribunal", "J. Familia de Lontuey", "t8"),
    ("tribunal", "Corte de Apelaciones de Isla Yerma", NONE), ("tribunal", "Juzgado de Policía Local de Lontuey", NONE), ("tribunal", "???", NONE),
    ("sala", "6ta sala - Mienra", "s6"), ("sala", "Sala 6 (Minera)", "s6"), ("sala", "6ª, minera", "s6"), ("sala", "S. de Verano", "sv"), ("sala", "Sala de Espera", NONE),
    ("sala", "12", NONE), ("materia", "minera, concesion", "m1"), ("materia", "Conces. minera", "m1"), ("materia", "s/ concesión minera", "m1"),
    ("materia", "Demanda por pension de alimentos y costas", "m2"), ("materia", "Materia: PENSIÓN DE ALIMENTOS (OTROS)", "m2"), ("materia", "otros", NONE),
]


def test_batched_distance_is_the_edit_metric():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc d1") for _ in range(rng.randrange(1, 70))) for _ in range(200)]
    strings = Strings(texts)
    for pattern in ["a", "abc d", "abcd1" * 12, "d" * 63, "d" * 64, "ab1c " * 13, "abc d1" * 40]:
        got = strings.distances(pattern, np.arange(len(texts)))
        assert got.tolist() == [plain_distance(pattern, t) for t in texts]


def test_tree_returns_all_within_radius():
    rng = random.Random(5)
    tree = Tree([(k, n) for k, _, n in ENTRIES])
    texts = []
    for form in rng.sample(tree.nodes, 60):
        t = list(form)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("aeiou ")
        texts.append("".join(t).strip() or "x")
    radius = np.array([allowed(t) for t in texts], np.int32)
    got = tree.within(texts, radius)
    for t, r, found in zip(texts, radius, got):
        brute = {(plain_distance(n, t), i) for i, n in enumerate(tree.nodes) if plain_distance(n, t) <= r}
        assert set(found) == brute


@pytest.mark.parametrize("field", ["tribunal", "sala", "materia"])
def test_typed_values(field):
    tree = Tree([(k, n) for k, f, n in ENTRIES if f == field])
    cases = [(v, k) for f, v, k in TYPED if f == field]
    assert [g[0] for g in match_values(tree, [v for v, _ in cases])] == [k for _, k in cases]


def frames(spark):
    rows = [(i, v if f == "tribunal" else None, v if f == "sala" else None, v if f == "materia" else "  ", "extra") for i, (f, v, _) in enumerate(TYPED)]
    rows += [rows[0], (99, None, "", " \u00a0", "extra"), (100, "corte " * 5000, None, None, "x"), (None, "C. Suprema", None, None, "x"), (2**60 + 1, "C. Suprema", None, None, "x")]
    df = spark.createDataFrame(rows, "id long, tribunal string, sala string, materia string, clave string")
    ref = spark.createDataFrame(ENTRIES, "clave string, campo string, nombre string")
    return df, ref


def test_rows_and_shards_agree(spark):
    df, ref = frames(spark)
    fields = ["tribunal", "sala", "materia"]
    id_ = F.coalesce("id", F.lit(-1)).alias("id")
    one = sorted(tuple(r) for r in map_to_canonical(df, "id", fields, ref).select(id_, "campo", "clave").collect())
    want = sorted([(i, f, k) for i, (f, _, k) in enumerate(TYPED)] + [(0, "tribunal", "t1"), (100, "tribunal", NONE), (-1, "tribunal", "t1"), (2**60 + 1, "tribunal", "t1")])
    assert one == want
    many = sorted(tuple(r) for r in map_to_canonical(df, "id", fields, ref, broadcast_entries=5).select(id_, "campo", "clave").collect())
    assert many == want


def test_empty_tables(spark):
    df, ref = frames(spark)
    none = map_to_canonical(df, "id", ["sala"], ref.limit(0)).collect()
    assert {r.clave for r in none} == {NONE}
    assert map_to_canonical(df.limit(0), "id", ["sala"], ref).collect() == []


LONG = "instituto de " + " ".join(f"materia{i} y asunto{i * 7}" for i in range(12))
TIES = [
    ("a1", "materia", "banana rojo"), ("a2", "materia", "banana roja"), ("a3", "materia", "banano roje"),
    ("b1", "materia", "Corte de Apelaciones de Talca"), ("b2", "materia", "CA Talca"), ("c1", "materia", "pera verde"), ("c2", "materia", "pera verdes"),
    ("d1", "materia", LONG), ("d2", "materia", "x" * 70), ("d3", "materia", "juzgado tribunal corte suprema apelaciones garantia familia trabajo sala especial constitucional"),
    ("e1", "materia", "gemelos iguales"), ("e2", "materia", "gemelos iguales"),
]
ASKED = {
    "banano rojo": NONE, "banana roj": NONE, "ca talca": "b2", "c a talca": "b1", "pera verde": "c1", "pera verdez": NONE, LONG: "d1", LONG.replace("materia3", "matreia3"): "d1", LONG + " zzzz zzzz": NONE,
    "x" * 70: "d2", "x" * 68: "d2", "x" * 60: NONE, "j t c sup a gtia flia trab s esp const": "d3", "gemelos iguales": NONE, "gemelo iguales": NONE, "z" * 100_000: NONE,
}


@pytest.mark.parametrize("most", [1, 3, 20_000])
def test_parts_of_the_list_give_what_the_whole_gives(spark, most):
    """Ties and full names across shards, entries of hundreds of letters, and names with many short ways to write them."""
    df = spark.createDataFrame(list(enumerate(ASKED)), "id long, materia string")
    ref = spark.createDataFrame(TIES, "clave string, campo string, nombre string")
    got = {r.id: (r.clave, r.distancia) for r in map_to_canonical(df, "id", ["materia"], ref, broadcast_entries=most).collect()}
    assert {v: got[i][0] for i, v in enumerate(ASKED)} == ASKED
    assert {i for i, (k, d) in got.items() if d < 0} == {i for i, (k, _) in got.items() if k == NONE}


def test_equal_ends_do_not_change_the_distance_with_swaps():
    rng = random.Random(9)

    def plainly(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                cost = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    cost = min(cost, rows[i - 2][j - 2] + 1)
                rows[i].append(cost)
        return rows[-1][-1]

    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        assert swap_distance(a, b) == plainly(a, b)
