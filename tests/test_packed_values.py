import pytest
from pyspark.sql import functions as F

from cartulario.operators.packed_values import packed_values, unpack

CASES = [
    (None, []),
    ("", []),
    (" \t ;; ", []),
    ("a; b, Art. 3; \"x; y\"", ["a", "b, Art. 3", "x; y"]),
    ('"Ley (denominada ""ley corta"") Art. 552"', ['Ley (denominada "ley corta") Art. 552']),
    ('""', []),
    ('Ley 5 "corta" Art. 3; CPR', ['Ley 5 "corta" Art. 3', "CPR"]),
    ("DFL N° 7/2031 / CPR /", ["DFL N° 7/2031", "CPR"]),
    ('a "b; c', ['a "b', "c"]),
    (" , «x, Ley», Ley 4, 5, CPR Art. 3, 4", ["x, Ley", "Ley 4, 5", "CPR Art. 3, 4"]),
    ('"""x"" y"; z', ['"x" y', "z"]),
    ("CPR · CPR\nCPR", ["CPR", "CPR", "CPR"]),
    ("“Código Civil | anexo 3” / Ley N° 1, Art. 2 inciso segundo", ["Código Civil | anexo 3", "Ley N° 1, Art. 2 inciso segundo"]),
    ('"A" y "B"', ['"A" y "B"']),
    ('"uno\u001edos"; Ley 1', ["uno\u001edos", "Ley 1"]),
    ('Ley 1 "a;b" Art. 2; "c", Ley 2 "d" / x', ['Ley 1 "a;b" Art. 2', "c", 'Ley 2 "d"', "x"]),
]


def test_cases(spark):
    df = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "i int, s string")
    got = {r.i: r.v for r in df.select("i", packed_values(F.col("s")).alias("v")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


def test_long_field(spark):
    text = "; ".join(f"Ley N° {i} Art. 1, 2" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "id long, s string")
    rows = unpack(df, "id", "s").orderBy("posicion").collect()
    assert len(rows) == 3000 and rows[-1].valor == "Ley N° 2999 Art. 1, 2" and rows[-1].posicion == 3000


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "id long, s string, valor int, posicion string, __values int")
    assert unpack(df, "id", "s").collect() == []
    df = spark.createDataFrame([(1, "a;b", 5, "p", 1)], "id long, s string, valor int, posicion string, __values int")
    assert [tuple(r) for r in unpack(df, "id", "s").orderBy("posicion").collect()] == [(1, 1, "a"), (1, 2, "b")]


@pytest.mark.parametrize("mark", ['"', "“", "«"])
def test_quoted_values_are_literal(spark, mark):
    close = {'"': '"', "“": "”", "«": "»"}[mark]
    df = spark.createDataFrame([(1, f"x;{mark}a;b|c, Ley{close};y")], "id long, s string")
    assert [r.valor for r in unpack(df, "id", "s").orderBy("posicion").collect()] == ["x", "a;b|c, Ley", "y"]


def by_hand(field):
    """The same values found letter by letter."""
    import re

    from cartulario.operators.packed_values import NORM_STARTS

    if field is None:
        return []
    blank = "\u0085   ​﻿ \t\n\r\x0b\x0c"
    pairs = {'"': '"', "“": "”", "«": "»"}
    starts = tuple(w.lower() for w in NORM_STARTS)
    out, now, close, i = [], "", "", 0

    def begins_norm(rest):
        rest = rest.lstrip(blank)
        low = rest.lower()
        for w in starts:
            if low.startswith(w) and not re.match(r"\w", low[len(w) : len(w) + 1]):
                return True
        return not rest or rest[0] in ",;|·•\"“«"

    while i < len(field):
        c = field[i]
        if close:
            now += c
            if c == close:
                close = ""
        elif c in pairs:
            close, now = pairs[c], now + c
        elif c in ";|·•\n\r\t" or (c == "/" and not (field[i - 1 : i].isdigit() and field[i + 1 : i + 2].isdigit())) or (c == "," and begins_norm(field[i + 1 :])):
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    out.append(now)
    values = []
    for v in out:
        v = v.strip(blank)
        if len(v) > 1 and v[0] in pairs and v[-1] == pairs[v[0]] and (v[0] == '"' and re.fullmatch(r'"(?:[^"]|"")*"', v, re.S) or v[0] != '"' and v[0] not in v[1:] and v[-1] not in v[1:-1]):
            v = v[1:-1].replace('""', '"').strip(blank)
        if v:
            values.append(v)
    return values


def test_against_letter_by_letter(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    for name, field in (("sentencias_judiciales", "normas"), ("doctrina_instituciones", "concordancias")):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        got = {}
        for r in unpack(df, "id", field).orderBy("id", "posicion").collect():
            got.setdefault(r.id, []).append(r.valor)
        want = {r.id: by_hand(r[field]) for r in df.select("id", field).collect()}
        assert got == {i: v for i, v in want.items() if v}
