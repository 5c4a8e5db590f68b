from collections import defaultdict

import pytest

from cartulario.llm.mixture import block_size, mix_sources, mixture_shares, schedule, scheduled_shares


@pytest.mark.parametrize(
    "budgets,block",
    [
        ({"a": 22, "b": 14, "c": 1, "d": 50, "e": 0}, 1),
        ({"a": 220_000, "b": 145_003, "c": 40, "d": 500_001}, 64),
        ({f"s{i}": 1 + i * i * 37 for i in range(40)}, 100),
        ({"grande": 1_000_000, "chica": 1}, 128),
        ({n: p * 100_003 for n, p in zip("abcdefghij", (22, 14, 13, 11, 10, 9, 8, 6, 4, 3))}, 512),
    ],
)
def test_less_than_one_block_from_the_true_share(budgets, block):
    """Against the weights as given, at every slot, over thousands of rounds."""
    slots = schedule(budgets, block)
    assert set(slots) == {n for n, a in budgets.items() if a}
    taken = sorted(s for x in slots.values() for s in x)
    assert len(set(taken)) == len(taken) == sum(-(-a // block) for a in budgets.values())
    total, last = sum(budgets.values()), sum(budgets.values()) // block
    for name, own in slots.items():
        assert own == sorted(own)
        before = 0
        for i, slot in enumerate(own[: last + 1]):
            # Just before and just after each block, where the deviation is largest.
            assert i * total - slot * budgets[name] > -total or i * block >= budgets[name]
            assert (i + 1) * total - (slot + 1) * budgets[name] < total
            assert slot >= before
            before = slot + 1


def test_long_mixtures_get_larger_blocks():
    assert block_size(10**6) == 4096 and block_size(10**13) == -(-(10**13) // (1 << 20)) and block_size(10**13, 7) == 7


def tables(spark):
    docs = [(i, " Uno" if i % 2 else "UNO ", 10) for i in range(60)] + [(100 + i, "dos", 7) for i in range(10)]
    docs += [(200, "otra", 99), (201, None, 5), (202, "dos", None), (203, "uno", 0), (3, "uno", 10)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long").repartition(4)
    goals = spark.createDataFrame([("Uno", 1.0, 1), ("dos", 1.0, 2), ("tres", 2.0, 5), (None, 3.0, 1), ("mal", -1.0, 1)], "source string, peso double, max_repeticiones int")
    return sizes, goals


def test_shares(spark):
    sizes, goals = tables(spark)
    got = {r.source: r for r in mixture_shares(sizes, "source", "tokens", goals).collect()}
    assert set(got) == {"uno", "dos", "tres"}
    assert (got["uno"].tokens, got["dos"].tokens, got["tres"].tokens, got["uno"].total) == (610, 70, 0, 680)
    assert {n: r.limitada for n, r in got.items()} == {"uno": False, "dos": True, "tres": True}
    assert (got["uno"].aporte, got["dos"].aporte, got["tres"].aporte) == (170, 140, 0)
    assert got["uno"].cuota_real == pytest.approx(170 / 310)


def test_mixture(spark):
    sizes, goals = tables(spark)
    rows = mix_sources(sizes, "doc_id", "source", "tokens", goals, block=20).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert set(by) == {"uno", "dos"}
    assert 170 <= sum(r.tokens for r in by["uno"]) < 180 and 140 <= sum(r.tokens for r in by["dos"]) < 147
    for name, own in by.items():
        own.sort(key=lambda r: (r.desde, r.tokens))
        at = 0
        for r in own:
            assert r.desde == at
            at += r.tokens
        assert max(r.repeticion for r in own) <= {"uno": 1, "dos": 2}[name]
        turns = [r.turno for r in own]
        assert turns == sorted(turns)
    slots = schedule({"uno": 170, "dos": 140}, 20)
    assert {r.turno for r in by["dos"]} <= set(slots["dos"]) and {r.turno for r in by["uno"]} <= set(slots["uno"])


def test_emitted_documents_stay_near_their_shares(spark):
    """At every prefix of the mixture each source is less than a block and a document from its share."""
    docs = [(i, f"s{i % 7}", 1 + (i * 7919) % 60) for i in range(20_000)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    goals = spark.createDataFrame([(f"s{i}", 1.0 + i, 3) for i in range(7)], "source string, peso double, max_repeticiones int")
    rows = mix_sources(sizes, "doc_id", "source", "tokens", goals, block=256).collect()
    budgets = {r.source: r.aporte for r in mixture_shares(sizes, "source", "tokens", goals).collect()}
    total, at, held = sum(budgets.values()), 0, defaultdict(int)
    assert rows == sorted(rows, key=lambda r: (r.turno, r.source, r.desde, r.doc_id)) and total > 600 * 256
    for r in rows[: int(len(rows) * 0.98)]:
        held[r.source] += r.tokens
        at += r.tokens
        # The documents of all sources may be as far from whole blocks as those of one.
        assert all(abs(held[s] - at * a / total) < 256 + 60 * 2 for s, a in budgets.items())


def test_empty(spark):
    sizes, goals = tables(spark)
    assert mix_sources(sizes.limit(0), "doc_id", "source", "tokens", goals).collect() == []
    assert mix_sources(sizes, "doc_id", "source", "tokens", goals.limit(0)).collect() == []
    assert {r.limitada for r in mixture_shares(sizes.limit(0), "source", "tokens", goals).collect()} == {False}


def test_actual_shares_are_those_of_the_mixture(spark):
    """A budget of 100 tokens reached inside a text of 5,000 gives the share of the whole text."""
    docs = [(0, "larga", 5000)] + [(1 + i, "corta", 10) for i in range(500)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    goals = spark.createDataFrame([("larga", 1.0, 1), ("corta", 99.0, 1), ("nada", 0.5, 2)], "source string, peso double, max_repeticiones int")
    got = {r.source: r for r in scheduled_shares(sizes, "doc_id", "source", "tokens", goals).collect()}
    held = defaultdict(int)
    for r in mix_sources(sizes, "doc_id", "source", "tokens", goals).collect():
        held[r.source] += r.tokens
    assert {n: r.mezclados for n, r in got.items()} == {"larga": 5000, "corta": 5000, "nada": 0} == {**held, "nada": 0}
    assert got["larga"].cuota_real == got["corta"].cuota_real == pytest.approx(0.5)
    planned = {r.source: r.limitada for r in mixture_shares(sizes, "source", "tokens", goals).collect()}
    assert {n: r.limitada for n, r in got.items()} == planned == {"larga": False, "corta": True, "nada": True}


def test_scheduled_shares_of_tables(spark):
    sizes, goals = tables(spark)
    got = {r.source: r for r in scheduled_shares(sizes, "doc_id", "source", "tokens", goals).collect()}
    assert {n: r.limitada for n, r in got.items()} == {"uno": False, "dos": True, "tres": True}
    assert (got["uno"].mezclados, got["dos"].mezclados, got["tres"].mezclados) == (170, 140, 0)
    assert {r.limitada for r in scheduled_shares(sizes.limit(0), "doc_id", "source", "tokens", goals).collect()} == {False}
    assert scheduled_shares(sizes, "doc_id", "source", "tokens", goals.limit(0)).collect() == []
