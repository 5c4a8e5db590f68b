import gzip
import hashlib
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulario.sinks import files as sinks
from cartulario.sources import files as src


def test_inventory_and_markdown(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "raw").mkdir()
    (tmp_path / "a" / "uno-dos.md").write_bytes(b"hola mundo\n")
    (tmp_path / "a" / "tres.md").write_text("x\n# El título \ncuerpo")
    (tmp_path / "raw" / "z.md").write_text("z")
    (tmp_path / "README.md").write_text("r")
    inv = {r.ruta: (r.blob, r.bytes) for r in src.inventory(spark, str(tmp_path), ("raw/",)).collect()}
    assert set(inv) == {"a/uno-dos.md", "a/tres.md", "README.md"}
    assert inv["a/uno-dos.md"] == (hashlib.sha1(b"blob 11\0hola mundo\n").hexdigest(), 11)
    tree = {r.ruta: r for r in src.markdown_tree(spark, str(tmp_path), ("README.md", "raw")).collect()}
    assert set(tree) == {"a/uno-dos.md", "a/tres.md"}
    assert (tree["a/uno-dos.md"].titulo, tree["a/uno-dos.md"].categoria, tree["a/uno-dos.md"].palabras) == ("Uno Dos", "a", 2)
    assert tree["a/tres.md"].titulo == "El título"


def test_json_lines_with_precedence(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl.gz"
    a.write_text('{"rol": "1", "t": "x"}\n\n{"rol": "2"\nnada\n{"rol": "1", "t": "y"}\n')
    b.write_bytes(gzip.compress(b'{"rol": "1", "t": "z"}\n{"rol": "3", "otro": 5}\n'))
    schema = T.StructType([T.StructField("rol", T.StringType()), T.StructField("t", T.StringType())])
    rows = src.json_lines(spark, [str(a), str(b)], schema)
    assert rows.filter("mala IS NOT NULL").count() == 2
    first = {r.rol: r.t for r in src.first_by_precedence(rows, ["rol"]).collect()}
    assert first == {"1": "x", "3": None}
    (tmp_path / "x").mkdir()
    inner = tmp_path / "x" / "a.jsonl"
    inner.write_text('{"rol": "1", "t": "otro"}\n')
    again = src.first_by_precedence(src.json_lines(spark, [str(inner), str(a)], schema), ["rol"]).collect()
    assert {r.rol: r.t for r in again} == {"1": "otro"}


def test_heads(spark):
    text = "---\nTitulo: Uno\nautores:\n  - Ana\n  - Luis\ntitulo: Dos\n---\nCuerpo: x"
    df = spark.createDataFrame([(1, text), (2, "sin cabeza"), (3, None)], "id int, t string")
    got = {r.id: r for r in df.select("id", src.front_matter(F.col("t")).alias("m")).select("id", "m.*").collect()}
    assert got[1].datos == {"titulo": "Uno", "autores": "Ana; Luis"} and got[1].cuerpo == "Cuerpo: x"
    assert got[2].datos == {} and got[2].cuerpo == "sin cabeza"
    b = spark.createDataFrame([("- **Rol:** 1-2020 · **Sala:** Tercera\n- **rol:** 2\n",)], "t string").select(src.bullets(F.col("t")).alias("m")).first().m
    assert b == {"rol": "1-2020", "sala": "Tercera"}


def test_graph_xml_html(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "a", "target": "b"}]}))
    node = T.StructType([T.StructField("id", T.StringType())])
    edge = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])
    nodes, edges = src.node_link_graph(spark, str(p), node, edge)
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("a", "b")]
    xml = '<n:Norma xmlns:n="urn:x"><n:Metadatos><n:TituloNorma> Ley de aguas </n:TituloNorma></n:Metadatos><n:EstructuraFuncional tipoParte="Artículo" idParte="1"><n:Texto> Uno </n:Texto></n:EstructuraFuncional></n:Norma>'
    law = spark.createDataFrame([(xml,)], "x string").select(src.law_xml(F.col("x")).alias("l")).first().l
    assert law.titulo == "Ley de aguas" and law.organismo is None and [tuple(a) for a in law.articulos] == [("Artículo", "1", "Uno")]
    parts = "<N>" + '<E tipoParte="Título" idParte="9">' + '<E tipoParte="Artículo" idParte="1"/>' + '<E idParte="2" tipoParte="Artículo"><Texto>Dos &amp;lt; &lt;b&gt;</Texto></E><E tipoParte="Artículo" idParte="3"><Texto/></E><E tipoParte="Artículo" idParte="4"><Texto><![CDATA[Cuatro]]></Texto></E></E></N>'
    law = spark.createDataFrame([(parts.replace("<E ", "<EstructuraFuncional ").replace("</E>", "</EstructuraFuncional>"),)], "x string").select(src.law_xml(F.col("x")).alias("l")).first().l
    assert [tuple(a) for a in law.articulos] == [("Título", "9", None), ("Artículo", "1", None), ("Artículo", "2", "Dos &lt; <b>"), ("Artículo", "3", None), ("Artículo", "4", "Cuatro")]
    html = "<table><tr><th>N°</th></tr><tr><td> <b>12</b>&nbsp;</td><td><a href='/x/1.pdf'>Res&oacute;l</a></td></tr><tr><td> </td></tr></table>"
    rows = spark.createDataFrame([(html,)], "h string").select(F.inline(src.html_rows(F.col("h")))).collect()
    assert [(r.celdas, r.enlace) for r in rows] == [(["N°"], None), (["12", "Resól"], "/x/1.pdf")]
    links = spark.createDataFrame([("/x/1.pdf",), ("y.pdf",), ("https://z/w",), ("//q/r",)], "l string").select(src.absolute(F.col("l"), "https://h.cl/a/b.html")).collect()
    assert [r[0] for r in links] == ["https://h.cl/x/1.pdf", "https://h.cl/a/y.pdf", "https://z/w", "https://q/r"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("niño".encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>Uno &amp; dos</w:t></w:r></w:p><w:p ><w:t xml:space='preserve'>tres</w:t></w:p></w:document>")
    (tmp_path / "c.docx").write_bytes(b"roto")
    (tmp_path / "d.bin").write_bytes(b"x")
    got = {os.path.basename(r.ruta): (r.texto, r.estado) for r in src.documents_in(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("niño", "latin-1"), "b.docx": ("Uno & dos\ntres", "ok"), "c.docx": (None, "archivo roto"), "d.bin": (None, "tipo desconocido")}


def test_pages_and_queries(spark):
    pages = spark.createDataFrame([(1, "x" * 100), (1, "x" * 90), (1, None), (2, "")], "f int, t string")
    got = {r.f: tuple(r)[1:] for r in src.page_profile(pages, "f", "t").collect()}
    assert got == {1: (3, 2, 90, True), 2: (1, 0, 0, False)}
    assert src.split_role_query(" 123-2024 ") == {"rol": "123", "era": "2024"} and src.split_role_query("agua 12-2024") == {"texto": "agua 12-2024"}


def rows(spark, extra=()):
    data = [(f"cs:{i}", "cs" if i % 3 else "tc", f"título {i}", i) for i in range(50)] + list(extra)
    return spark.createDataFrame(data, "id string, p string, titulo string, n long")


def test_partitions_are_deterministic_and_incremental(spark, tmp_path):
    one, two = str(tmp_path / "1"), str(tmp_path / "2")
    a = sinks.update_partitions(rows(spark).repartition(5), "p", "id", one).collect()
    sinks.write_partitions(rows(spark).repartition(2), "p", "id", two)
    for name in ("cs", "tc"):
        assert open(f"{one}/{name}.jsonl.gz", "rb").read() == open(f"{two}/{name}.jsonl.gz", "rb").read()
    assert {r.particion: r.filas for r in a} == {"cs": 33, "tc": 17} and all(r.escrita for r in a)
    b = {r.particion: r.escrita for r in sinks.update_partitions(rows(spark, [("tc:x", "tc", "é", 1)]), "p", "id", one).collect()}
    assert b == {"cs": False, "tc": True}
    assert "é" in gzip.open(f"{one}/tc.jsonl.gz", "rt").read()
    sinks.update_partitions(rows(spark).filter("p = 'cs'"), "p", "id", one)
    assert sorted(os.listdir(one)) == ["cs.jsonl.gz", "estado.json"]
    with pytest.raises(Exception, match="float"):
        sinks.write_partitions(rows(spark).withColumn("w", F.lit(1.5)), "p", "id", str(tmp_path / "3"))


def test_updates(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    fresh = spark.createDataFrame([(2, "x"), (2, "c"), (3, "d")], "k int, v string")
    got = sorted(tuple(r) for r in sinks.upserted(base, fresh, ["k"], [F.col("v")]).collect())
    assert got == [(1, "a"), (2, "c"), (3, "d")]
    series = sinks.numbered(rows(spark).repartition(7), [F.col("n")], "doc-", 4).orderBy("n").collect()
    assert [r.id_serie for r in series] == [f"doc-{i + 1:04d}" for i in range(50)]
    parts = spark.createDataFrame([("corpus_cs/2024/1.md",), ("corpus_tc/2020/3.md",), ("guia/x.md",)], "r string").select(sinks.partition_of(F.col("r")).alias("p")).collect()
    assert [r.p for r in parts] == ["cs-2024", "tc", "guia"]
