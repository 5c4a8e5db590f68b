"""The citation grammar on phrases made for it."""

import random

import pytest

from cartulario.functions.cites import _code_articles, cited, norms_in, query_references, roles_in

NORMS = [
    ("según el artículo 1545 del Código Civil", {"norma:codigo-civil:1545": 1}),
    ("los artículos 6, 7 y 19 N° 3 de la Constitución Política de la República", {"norma:cpr:6": 1, "norma:cpr:7": 1, "norma:cpr:19:n3": 1}),
    ("artículos 1.545 y 1.546 del Código Civil, y 170 del Código de Procedimiento Civil", {"norma:codigo-civil:1545": 1, "norma:codigo-civil:1546": 1, "norma:codigo-procedimiento-civil:170": 1}),
    ("el art. 10 bis de la Ley N° 19.300 y la ley 19.300", {"norma:ley-19300:10-bis": 1, "norma:ley-19300": 1}),
    ("Ley 20.600, artículo 17", {"norma:ley-20600:17": 1}),
    ("la ley 12 del año", {}),
    ("el D.L. N° 211 y el DFL N° 1", {"norma:dl-211": 1, "norma:dfl-1": 1}),
    ("CPR Art. 19 y CPC", {"norma:cpr:19": 1, "norma:codigo-procedimiento-civil": 1}),
    ("firmó el CT ayer", {}),
    ("la constitución de la sociedad", {}),
    ("Constitución", {"norma:cpr": 1}),
    ("artículo 3° transitorio de la Ley N° 21.000", {"norma:ley-21000:3-transitorio": 1}),
    ("disposición quinta transitoria de la Constitución", {"norma:cpr:5-transitorio": 1}),
    ("artículo 161 inciso segundo del Código del Trabajo", {"norma:codigo-trabajo:161": 1}),
    ("artículo 25 sin más", {}),
    ("artí-\nculo 5 del Código Orgánico de Tribunales", {"norma:codigo-organico-tribunales:5": 1}),
    (None, {}),
    ("", {}),
]
ROLES = [
    ("la Corte Suprema, rol N° 1.234-2020", {"cs:1234-2020": 1}),
    ("CS Rol 6.647-2019 y CS 12-2021", {"cs:6647-2019": 1, "cs:12-2021": 1}),
    ("Corte de Apelaciones de Talca, rol 55-2020", {}),
    ("Tribunal Constitucional, rol N° 1234", {"tc:1234": 1}),
    ("STC 976-08", {"tc:976": 1}),
    ("Segundo Tribunal Ambiental, rol R-12-2019 y R-13-2019", {"ta:2ta:r-12-2019": 1, "ta:2ta:r-13-2019": 1}),
    ("rol R-5-2020 del Tercer Tribunal Ambiental", {"ta:3ta:r-5-2020": 1}),
    ("el juzgado dijo, y la Corte Suprema en rol 9-2018 y rol 9-2018", {"cs:9-2018": 2}),
    ("rol de la familia", {}),
    (None, {}),
]


@pytest.mark.parametrize("text,want", NORMS)
def test_norms(text, want):
    assert dict(norms_in(text)) == want


@pytest.mark.parametrize("text,want", ROLES)
def test_roles(text, want):
    assert dict(roles_in(text)) == want


def test_queries():
    assert query_references("Rol N° 1.126-2025 Corte Suprema") == ["cs:1126-2025"]
    assert query_references("artículo 19 de la Constitución") == ["norma:cpr:19"]
    assert query_references("qué dice la jurisprudencia reciente sobre el plazo del artículo 19 de la Constitución en materia de aguas") == []
    assert query_references("humedal") == []


def test_code_articles():
    assert _code_articles("En el Código Civil se ve el artículo 3 y los arts. 4 y 5; Ley 19.300.") == ["codigo-civil:3", "codigo-civil:4", "codigo-civil:5", "ley-19300"]


def test_planted_citations():
    """Precision and recall on texts with citations of many shapes among prose that has numbers of its own."""
    rng = random.Random(4)
    fill = ["El plazo de 30 días corrió.", "La parte pagó 12.500 pesos.", "Fojas 45 y siguientes.", "Hubo 3 testigos, según el acta 17.", "Se acogió en parte.", "El lote 12 de la manzana 4."]
    hit = made = true = 0
    for _ in range(400):
        a, b = rng.randrange(1, 2500), rng.randrange(1, 2500)
        law = rng.randrange(18000, 22000)
        dotted = f"{law // 1000}.{law % 1000:03d}"
        shapes = [
            (f"el artículo {a} del Código Civil", {f"norma:codigo-civil:{a}"}), (f"los artículos {a} y {b} del Código Penal", {f"norma:codigo-penal:{a}", f"norma:codigo-penal:{b}"}), (f"la Ley N° {dotted}", {f"norma:ley-{law}"}),
            (f"el art. {a % 90 + 1} de la ley {dotted}", {f"norma:ley-{law}:{a % 90 + 1}"}), (f"(artículo {a} inciso primero del Código del Trabajo)", {f"norma:codigo-trabajo:{a}"}), (f"CPR Art. {a % 120 + 1}", {f"norma:cpr:{a % 120 + 1}"}),
            (f"Código Tributario, artículo {a}", {f"norma:codigo-tributario:{a}"}), (f"artículo {a} bis del Código de Comercio", {f"norma:codigo-comercio:{a}-bis"}), (f"decreto ley {law % 900 + 100}", {f"norma:dl-{law % 900 + 100}"}),
        ]
        some = rng.sample(shapes, 3)
        text = " ".join(f"{rng.choice(fill)} Se aplica {s}, como se dijo. {rng.choice(fill)}" for s, _ in some)
        want = set().union(*[w for _, w in some])
        got = {k for k, _ in norms_in(text)}
        hit, made, true = hit + len(want & got), made + len(got), true + len(want)
    assert hit / made >= 0.95 and hit / true >= 0.93


def test_rows(spark):
    df = spark.createDataFrame([(1, "Ley N° 19.300 y Ley N° 19.300", "x"), (None, "CPR Art. 19", "x"), (2**60 + 1, None, "x"), (2**60 + 3, "Corte Suprema, rol 9-2018", "x")], "id long, t string, destino string")
    assert {tuple(r) for r in cited(df, "id", "t").collect()} == {(1, "norma:ley-19300", 2), (None, "norma:cpr:19", 1)}
    assert {tuple(r) for r in cited(df, "id", "t", "roles").collect()} == {(2**60 + 3, "cs:9-2018", 1)}
    assert cited(df.limit(0), "id", "t").collect() == []
