import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkwell.operators.stores import ChatStore, DocumentStore, IndexStore, KeyValueStore, StorageContext, Table, VectorStore
from sparkwell.sources import readers
from sparkwell.streaming.incremental import csv_stream, ingest_stream, windowed_counts


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age,city\nAnn, 30,Rome\nBob,,Oslo\n")
    rows = {r.doc_id.rpartition("_")[2]: r for r in readers.csv_rows(spark, str(tmp_path / "a.csv"), text=["NAME", "1"]).collect()}
    assert rows["0"].text == "name: Ann\nage: 30" and rows["0"].metadata["city"] == "Rome" and rows["1"].text == "name: Bob" and rows["1"].metadata["row"] == "2"
    whole = readers.csv_files(spark, str(tmp_path / "a.csv")).first()
    assert whole.text == "Ann | 30 | Rome\nBob | Oslo" and whole.metadata == {"total_rows": "2", "headers": "name, age, city"}
    assert readers.resolve_columns(["A", " b "], ["B", "0", "9", "zz"]) == [1, 0]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"b": 1, "a": "x"}, {"a": "y"}]')
    (tmp_path / "b.jsonl").write_text('{"a": "p"}\n\n{"a": "q", "c": 2}\n')
    got = {r.doc_id.rpartition("/")[2]: r for r in readers.json_files(spark, str(tmp_path), "a").collect()}
    assert {k: v.text for k, v in got.items()} == {"a.json_0": "x", "a.json_1": "y", "b.jsonl_0": "p", "b.jsonl_2": "q"}
    assert got["b.jsonl_2"].metadata == {"c": "2", "index": "2"} and got["a.json_0"].metadata == {"b": "1"}
    (tmp_path / "b.jsonl").write_text('{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed|json"):
        readers.json_files(spark, str(tmp_path)).collect()


HTML = '<html lang="en"><head><title> Test Page </title><meta name="description" content="d e"><script>var x;</script></head><body><p>Tom &amp; Jerry&#39;s &#233;</p><pre>x</pre><!-- no --></body></html>'


def test_html(spark, tmp_path):
    (tmp_path / "p.html").write_text(HTML)
    r = readers.html_files(spark, str(tmp_path)).first()
    assert r.text == "Tom & Jerry's é\n\nx" and r.metadata == {"title": "Test Page", "description": "d e", "language": "en"}
    assert spark.range(1).select(readers.html_text(F.lit(HTML), ("p",)).alias("t")).first().t == "Tom & Jerry's é"


def test_markdown(spark, tmp_path):
    (tmp_path / "d.md").write_text('---\ntitle: "T"\nauthor: A\n---\n# One\nsee [link](u) ![i](v)\n## Two\nb\n### Three\nc\n')
    r = readers.markdown_files(spark, str(tmp_path)).first()
    assert r.metadata == {"title": "T", "author": "A"} and "see link" in r.text and "(u)" not in r.text
    s = readers.markdown_sections(spark.createDataFrame([(1, r.text)], "doc_id long, text string")).orderBy("section_index").collect()
    assert [(x.header, x.header_level) for x in s] == [("One", 1), ("Two", 2)] and s[1].text.endswith("c")


def test_directory(spark, tmp_path):
    for n in ("a.txt", "b.TXT", "c.md", "d.py"):
        (tmp_path / n).write_text(n)
    got = readers.directory(spark, str(tmp_path)).collect()
    assert sorted(r.metadata["filename"] for r in got) == ["a.txt", "b.TXT", "c.md"]


def test_office_files(spark, tmp_path):
    x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{x}" xmlns:r="{rel}"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{x}"><si><t>name</t></si><si><t>Ann</t></si></sst>')
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>age</v></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="C3"><v>30</v></c></row>'
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{x}"><sheetData>{rows}</sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(b.getvalue())
    r = readers.excel_files(spark, str(tmp_path)).collect()
    assert [x.text for x in r] == ["name: Ann\nage: 30"] and r[0].metadata == {"sheet": "S1", "row": "1"}
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr>{cell.format("a")}{cell.format("b")}</w:tr></w:tbl></w:body></w:document>')
        z.writestr("docProps/core.xml", "<c><title>T</title></c>")
    (tmp_path / "a.docx").write_bytes(b.getvalue())
    r = readers.docx_files(spark, str(tmp_path)).first()
    assert r.text == "Hello\na | b" and r.metadata == {"title": "T"}
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    pages = readers.pdf_files(spark, str(tmp_path), lambda content: content.decode().split("|")).collect()
    assert sorted((p.text, p.metadata["page_number"]) for p in pages) == [("one", "1"), ("two", "2")]
    with pytest.raises(ValueError, match="pages"):
        readers.pdf_files(spark, str(tmp_path))


def test_stores(spark, tmp_path):
    kv = KeyValueStore(spark, str(tmp_path / "kv"))
    assert kv.get("k") is None
    for v in ('{"a": 1}', '{"a": 2}'):
        kv.put(spark.createDataFrame([("data", "k", v)], "collection string, key string, value string"))
    assert kv.get("k") == {"a": 2} and kv.all().count() == 1
    docs = DocumentStore(spark, str(tmp_path / "docs"))
    n = spark.createDataFrame([("n1", "t", {"m": "1"}, "s", "h1"), ("n2", "u", {}, "s", "h2")], "node_id string, text string, metadata map<string,string>, source_id string, hash string")
    docs.add(n)
    with pytest.raises(ValueError, match="exists"):
        docs.add(n, allow_update=False)
    wanted = spark.createDataFrame([(0, "n2"), (1, "zz"), (2, "n1")], "pos int, node_id string")
    assert [r.node_id for r in docs.lookup(wanted).collect()] == ["n2", "n1"]
    assert docs.source_info().first().node_ids == ["n1", "n2"]
    docs.delete_nodes(n.where("node_id = 'n1'"))
    assert docs.hashes().collect() == [("h2", "n2")]
    docs.delete_source(n)
    assert docs.read().count() == 0
    vs = VectorStore(spark, str(tmp_path / "v"))
    vs.add(spark.createDataFrame([("n1", "t", {}, [1.0, 2.0])], "node_id string, text string, metadata map<string,string>, embedding array<double>"))
    assert vs.read().first().embedding == [1.0, 2.0]
    ix = IndexStore(spark, str(tmp_path / "i"))
    ix.put(spark.createDataFrame([("i", "vector", "", "x")], "index_id string, kind string, summary string, location string"))
    assert ix.get().kind == "vector" and ix.get("zz") is None
    chat = ChatStore(spark, str(tmp_path / "c"))
    for role, text, at in (("user", "a", None), ("assistant", "b", None), ("system", "s", 0)):
        chat.add("k", role, text, at)
    assert [(r.pos, r.text) for r in chat.messages("k").collect()] == [(0, "s"), (1, "a"), (2, "b")]
    chat.delete_last("k")
    chat.delete_message("k", 0)
    assert [(r.pos, r.text) for r in chat.messages("k").collect()] == [(0, "a")]
    assert StorageContext(spark, str(tmp_path / "ctx")).vectors("x").read().count() == 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("name,age\nAnn,30\nBob,\n")
    store = Table(spark, str(tmp_path / "store"), "doc_id string, text string, hash string")
    docs = csv_stream(spark, str(tmp_path / "in"), ["name", "age"]).select(F.md5(F.col("text").cast("binary")).alias("doc_id"), "text")
    for _ in range(2):
        ingest_stream(docs, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in store.read().collect()) == ["name: Ann\nage: 30", "name: Bob"]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.n, r.total) for r in windowed_counts(events).collect()] == [(2, 3.0)]
