"""Graph operators against plain Python on small graphs."""

from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from cartulario.operators import graph

EDGES = [
    ("a", "b", "x", 1), ("b", "c", "x", 2), ("a", "d", "y", 1), ("d", "c", "z", 1), ("c", "e", "x", 5), ("e", "f", "x", 1), ("g", "a", "x", 1), ("g", "c", "w", 1), ("h", "i", "x", 1), ("c", "b", "x", 1),
    ("b", "c", "a", 1), ("e", "e2", "x", 1), ("e2", "f", "x", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, rel string, peso long").repartition(3)


def ways():
    out = defaultdict(set)
    for s, d, *_ in EDGES:
        out[s].add(d)
        out[d].add(s)
    return out


def shortest(a, b):
    front, w = [[a]], ways()
    seen = {a}
    while front:
        done = sorted(p for p in front if p[-1] == b)
        if done:
            return done
        front = [[*p, n] for p in front for n in w[p[-1]] if n not in seen]
        seen |= {p[-1] for p in front}
    return []


@pytest.mark.parametrize("a,b", list(product("acg", "fci")) + [("a", "nada")])
def test_all_shortest_paths(edges, a, b):
    got = sorted(graph.all_shortest_paths(edges, a, b).collect(), key=lambda r: r.orden)
    assert [r.camino for r in got] == shortest(a, b)[:3]
    for r in got:
        for x, y, label in zip(r.camino[:-1], r.camino[1:], r.relaciones, strict=True):
            there, back = (sorted(rel for s, d, rel, _ in EDGES if (s, d) == p) for p in ((x, y), (y, x)))
            assert label == (there[0] if there else f"es_{back[0]}_de")


def test_distances_and_radius(spark, edges):
    got = {r.nodo: r.distancia for r in graph.distances(edges, "a").collect()}
    assert got == {n: len(shortest("a", n)[0]) - 1 for n in "abcdefg"} | {"e2": 4}
    chain = spark.createDataFrame([(i, i + 1, "x", 1) for i in range(9)], "src long, dst long, rel string, peso long")
    assert {r.nodo: r.distancia for r in graph.distances(chain, 0).collect()} == {i: i for i in range(10)}


def test_blast_radius_follows_the_direct_ones(spark, edges):
    targets = spark.createDataFrame([("c",), ("g",), ("nada",), ("f",)], "nodo string")
    got = {r.nodo: (r.directos, r.cascada, r.nivel) for r in graph.blast_radius(edges, targets).collect()}
    # c: pointed to by b, d and g, which point to a besides; g: pointed to by none, so its successors a and c, which point to b, d and e.
    assert got == {"c": (3, 1, "MEDIO"), "g": (2, 3, "MEDIO"), "nada": (0, 0, "BAJO"), "f": (2, 0, "BAJO")}


def rank(pairs, restart, rounds=400):
    nodes = sorted({n for p in pairs for n in p})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for (s, d), w in pairs.items():
        m[at[d], at[s]] += w
    out = m.sum(0)
    r = np.array([restart.get(n, 0) for n in nodes])
    x = r.copy()
    for _ in range(rounds):
        x = 0.15 * r + 0.85 * (m @ np.divide(x, out, where=out > 0, out=np.zeros_like(x)) + x[out == 0].sum() * r)
    return dict(zip(nodes, x))


def test_pagerank_stops_by_itself(edges):
    pairs = defaultdict(float)
    for s, d, _, w in EDGES:
        pairs[s, d] += w
    nodes = {n for p in pairs for n in p}
    want = rank(pairs, {n: 1 / len(nodes) for n in nodes})
    got = {r.nodo: r.puntaje for r in graph.pagerank(edges, tolerance=1e-4).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 5e-3 for n in want)


def test_personal_pagerank_stays_within_the_radius(spark, edges):
    got = {r.nodo: r.puntaje for r in graph.personal_pagerank(edges, spark.createDataFrame([("a",), ("nada",)], "nodo string"), 1, 15, tolerance=None).collect()}
    assert set(got) == {"a", "b", "d", "g"} and abs(sum(got.values()) - 1) < 1e-9
    pairs = {p: 1.0 for p in [("a", "b"), ("a", "d"), ("a", "g"), ("b", "a"), ("d", "a"), ("g", "a")]}
    assert all(abs(got[n] - x) < 1e-6 for n, x in rank(pairs, {"a": 1.0}, 15).items())


def test_empty(spark, edges):
    none = edges.limit(0)
    assert graph.pagerank(none, 5).collect() == [] and graph.all_shortest_paths(none, "a", "b").collect() == []
    assert graph.blast_radius(none, spark.createDataFrame([("a",)], "nodo string")).collect()[0].directos == 0
