from pyspark.sql import functions as F

from cartulario.functions import dates, ids, records, segments, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_ids(spark):
    cases = {
        "Ley N° 31.226 Art. 1185": "norma:ley-31226:1185", "Código de Procedimiento Civil, Art. 5 inciso final": "norma:codigo-procedimiento-civil:5", "CPR": "norma:cpr",
        "DFL N° 7/2031 Art. 3": "norma:dfl-7-2031:3", "Auto Acordado N° 55-2030": "norma:aa-55-2030", "Reglamento de Riberas Arts. 4-9": "norma:reglamento-riberas:4", "otra cosa": None,
        "Código del Trabajo": "norma:codigo-trabajo", "Decreto Supremo N° 908 Art. 1": "norma:ds-908:1", "DL N° 4.120": "norma:dl-4120", "Código Civil | anexo 3": "norma:codigo-civil",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "x string")
    got = {r.x: r.y for r in df.select("x", ids.norm_id(F.col("x")).alias("y")).collect()}
    assert got == {**cases, None: None}
    assert one(spark, "norma:ley-1:5", ids.parent_id) == "norma:ley-1" and one(spark, "cs:1", ids.parent_id) is None
    assert one(spark, "CS 6.647-2019", ids.supreme_id) == "cs:6647-2019" and one(spark, "x", ids.supreme_id) is None
    assert one(spark, "1.385,95", ids.spanish_number) == 1385.95 and one(spark, "uno", ids.spanish_number) is None
    assert one(spark, 12345678, ids.check_digit, "long") == "5"


def test_dates(spark):
    cases = {"2024-02-30": None, "5/3/2021": "2021-03-05", "05-03-2021": "2021-03-05", "3 de marzo de 2020": "2020-03-03", "2020-01-02T10:00": "2020-01-02", "": None, "s/i": None, "1899-01-01": None, "2 de brumario de 2000": None,
        "Santiago, 3 de mayo de 2020": "2020-05-03", "1° de enero del 2020": "2020-01-01", "publicado el 2020-05-03": "2020-05-03", "03-05-2020 (rectificado)": "2020-05-03",
        "31/02/2020 y luego 2 de abril de 2021": "2021-04-02", "rol 12020-05-034": None, "1 de setiembre": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in df.select("x", dates.iso_date(F.col("x")).alias("y")).collect()} == cases


def test_text(spark):
    assert one(spark, "Ñandú ÁÉ", text.fold) == "nandu ae" and one(spark, None, text.tokens) == []
    assert one(spark, "ley nº 5 con-\ntrato", text.legal_text) == "ley N° 5 contrato"
    assert one(spark, "abc", lambda c: text.passage(c, "z", 3)) is None
    assert one(spark, "uno dos tres cuatro", lambda c: text.summary(c, 12)) == "uno dos"


def test_records(spark):
    df = spark.createDataFrame([(1, " ", ["cs:1", "x", None], "norma:cpr"), (2, "a", [], None)], "id int, s string, l array<string>, r string")
    clean = {r.id: r for r in records.without_empties(df).collect()}
    assert clean[1].s is None and clean[2].l is None and clean[2].s == "a"
    assert sorted(tuple(r) for r in records.references(df, "id", ("cs", "norma")).collect()) == [(1, "l", "cs:1"), (1, "r", "norma:cpr")]
    got = {r.id: r.motivo for r in records.with_reasons(df, {"a": F.col("id") > 1, "b": F.col("r").isNotNull()}).collect()}
    assert got == {1: "a", 2: "b"}
    assert df.orderBy("id").select(records.flattened(df, ("id",)).alias("f")).first().f == "  cs:1 x norma:cpr"


def test_segments(spark):
    md = spark.createDataFrame([(1, "antes\n## Uno\nx\n## Dos\ny\n"), (2, None), (3, "")], "id int, t string")
    assert [tuple(r)[2:] for r in segments.sections(md, "id", "t").orderBy("orden").collect()] == [(None, "antes"), ("Uno", "x"), ("Dos", "y")]
    law = spark.createDataFrame([(1, "Título\nArtículo 1.- Uno\nArt. 2 Dos\n")], "id int, t string")
    assert [(r.numero, r.texto.strip()) for r in segments.articles(law, "id", "t").orderBy("orden").collect()] == [("1", "Artículo 1.- Uno"), ("2", "Art. 2 Dos")]
    par = spark.createDataFrame([(1, "1. Uno\n\n- Dos\n\n \n\nTres"), (2, "a\nb")], "id int, t string")
    assert [(r.id, r.parrafo) for r in segments.paragraphs(par, "id", "t").orderBy("id", "orden").collect()] == [(1, "Uno"), (1, "Dos"), (1, "Tres"), (2, "a"), (2, "b")]
    run = spark.createDataFrame([(1, "CABECERA\nuno\n12\nCABECERA\ndos"), (2, None)], "id int, t string")
    assert [tuple(r) for r in segments.without_running_lines(run, "id", "t", 2).collect()] == [(1, "uno\ndos")]
    spans = [(0, 5), (3, 9), (5, 6), (5, 8), (8, 9)]
    df = spark.createDataFrame([(spans,)], "s array<struct<desde:int,hasta:int>>")
    assert [tuple(x) for x in df.select(segments.kept_spans(F.col("s")).alias("k")).first().k] == [(0, 5), (5, 8), (8, 9)]


def test_working_days_leave_out_holidays(spark):
    import datetime as dt

    days = [(dt.date(2026, 9, 16), dt.date(2026, 9, 21)), (dt.date(2026, 1, 1), dt.date(2026, 1, 1)), (dt.date(2026, 4, 30), dt.date(2026, 5, 4)), (dt.date(2026, 5, 4), dt.date(2026, 4, 1))]
    df = spark.createDataFrame(days, "a date, b date")
    got = df.select(dates.business_days(F.col("a"), F.col("b")).alias("x"), dates.business_days(F.col("a"), F.col("b"), saturdays=True).alias("y")).collect()
    assert [tuple(r) for r in got] == [(2, 2), (0, 0), (1, 2), (0, 0)]
