import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sheetwise.sources import documents, sinks

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, paragraphs, rows, title="Draining guide"):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    core = f'<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c:coreProperties>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
        z.writestr("docProps/core.xml", core)
    path.write_bytes(b.getvalue())


def test_docx_to_requirements(spark, tmp_path):
    docx(tmp_path / "a.docx", ["Open the vent", " "], [["Equipment", "Pressure (psig)", "Temp (F)"], ["T-61 Drum", "12 to 35", "70"], ["C-19 (shell)", "none", "-"], ["", "1", "2"], ["P-264 C and D", "9", ""]])
    parts = documents.read_procedure(spark, str(tmp_path / "a.docx"))
    assert [(r.kind, r.cells) for r in parts.filter("kind <> 'cells'").orderBy("kind").collect()] == [("paragraph", ["Open the vent"]), ("title", ["Draining guide"])]
    got = documents.requirements(parts).orderBy("ordinal").collect()
    assert [(r.ordinal, r.tags, [(q.field, q.min, q.max, q.unit) for q in r.quantities]) for r in got] == [(0, ["T-61"], [("pressure", 12.0, 35.0, "psig"), ("temperature", 70.0, 70.0, "degF")]), (1, ["P-264C", "P-264D"], [("pressure", 9.0, 9.0, "psig")])]
    assert got[0].evidence == "T-61 Drum | 12 to 35 | 70"
    assert [r.subject for r in documents.unread_rows(parts).collect()] == ["C-19 (shell)"]


def test_text_and_dispatch(spark, tmp_path):
    (tmp_path / "my sop.txt").write_text("  One line \n\n\r\n two\n", encoding="utf-8")
    assert [(r.title, r.text) for r in documents.read_text(spark, str(tmp_path / "my sop.txt")).orderBy("seq").collect()] == [("my sop", "One line"), ("my sop", "two")]
    assert documents.read_procedure(spark, str(tmp_path / "my sop.txt")).count() == 2
    for bad in ("x.doc", "x.odt", "x"):
        with pytest.raises(ValueError):
            documents.read_procedure(spark, bad)


def test_node_link_round_trip_and_findings(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "component", 0.7), ("n0", "instrument", 0.9)], "id string, kind string, confidence double")
    edges = spark.createDataFrame([("n0", "n1", "solid", [3, 4])], "source string, target string, style string, line_ids array<int>")
    sinks.write_node_link(nodes, edges, str(tmp_path / "g"))
    text = next((tmp_path / "g").glob("part-*")).read_text()
    assert [n["id"] for n in json.loads(text)["nodes"]] == ["n0", "n1"]
    n, e = documents.read_node_link(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.first().line_ids == [3, 4]
    f = spark.createDataFrame([("a", "finding", "low", "x", "f", 0.4), ("b", "verified", "info", None, None, 0.9), ("c", "finding", "critical", "y", "f", 0.9)], "check string, status string, severity string, subject string, field string, confidence double")
    sinks.write_findings(f, str(tmp_path / "f"))
    assert [json.loads(x)["check"] for x in next((tmp_path / "f").glob("part-*")).read_text().splitlines()] == ["c", "a", "b"]
    assert documents.read_findings(spark, str(tmp_path / "f")).count() == 3 and documents.read_findings(spark, str(tmp_path / "none")).count() == 0
    md = sinks.report(f, "Report", 0.42)
    assert "Issues: 1 critical, 1 low" in md and md.index("## Verified") < md.index("## Findings") and "42%" in md


def test_store(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_run(spark, str(tmp_path / "s"), "r1", {"nodes": t})
    sinks.write_run(spark, str(tmp_path / "s"), "r2", {"nodes": t.limit(1)})
    assert sinks.read_run(spark, str(tmp_path / "s"), "nodes").count() == 1 and sinks.read_run(spark, str(tmp_path / "s"), "nodes", "r1").count() == 2
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r.k, r.v) for r in sinks.upsert(t, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    twice = spark.createDataFrame([(2, "z"), (2, "c")], "k int, v string")
    assert sinks.upsert(t, twice, ["k"]).filter("k = 2").collect()[0].v == "c"
    n = spark.createDataFrame([("x", {"a": "1", "b": None, "c": "3"})], "key string, extras map<string,string>")
    assert {(r.name, r.value) for r in sinks.attribute_rows(n, "key", "extras", ("c",)).collect()} == {("a", "1")}


def test_library(spark, tmp_path):
    for p in ("sop/a.pdf", "Zed/b.pdf", "c.docx", "d.pdf", ".hidden/e.pdf", "f.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    (tmp_path / tmp_path.name).mkdir()
    (tmp_path / tmp_path.name / "g.pdf").write_bytes(b"x")  # a folder named like the root
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        got = [(r.path, r.kind) for r in documents.library(spark, root).collect()]
        assert (f"{tmp_path.name}/g.pdf", "drawing") in got
    got.remove((f"{tmp_path.name}/g.pdf", "drawing"))
    assert got == [("sop/a.pdf", "procedure"), ("Zed/b.pdf", "drawing"), ("c.docx", "procedure"), ("d.pdf", "drawing")]


def test_confined_paths():
    assert documents.confine("a/./b/../c.pdf", "/data/") == "/data/a/c.pdf"
    for bad in ("../x", "a/../../x", "/etc/x", "", ".", "a/..", "C:\\x", "file:/x", "\\x"):
        with pytest.raises(ValueError):
            documents.confine(bad, "/data")


def test_first_file_and_cache(spark, tmp_path):
    for p in ("b/z.PDF", "b/a.pdf", "b/0.txt", "c/y.docx"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    find = lambda *names, of: documents.first_file(spark, [str(tmp_path / n) for n in names], of)
    assert find("none", "b", "c", of=(".pdf",)).endswith("/b/a.pdf") and find("b", "c", of=(".docx",)).endswith("/c/y.docx") and find("none", of=(".pdf",)) is None
    path = str(tmp_path / "cache")
    assert documents.read_cache(spark, path).count() == 0
    schema = "key string, text string, confidence double, backend string"
    sinks.write_cache(spark.createDataFrame([("a", "", 0.0, "x"), ("b", "V-8", 0.9, "x")], schema), path)
    sinks.write_cache(spark.createDataFrame([("a", "T-61", 0.8, "y")], schema), path)
    assert {tuple(r) for r in documents.read_cache(spark, path).collect()} == {("a", "T-61", 0.8, "y"), ("b", "V-8", 0.9, "x")}


def test_preview_and_description(spark, tmp_path):
    docx(tmp_path / "a.docx", ["Open &lt;all&gt; vents", "Then close"], [["A", "B &amp; C"], ["1", "2"]], title="Draining")
    parts = documents.read_procedure(spark, str(tmp_path / "a.docx"))
    assert documents.as_html(parts).first().html == "<h1>Draining</h1>\n<p>Open &lt;all&gt; vents</p><p>Then close</p>\n<table><tr><th>A</th><th>B &amp; C</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert tuple(documents.described(parts).first())[1:] == ("Draining", 2, 1, 2)


def test_scores_and_fallback(spark, tmp_path):
    s = spark.createDataFrame([("edges", 9, 10, 0.9, 0.6, 0.98), ("tags", 1, 2, None, 0.1, 0.9)], "metric string, hits long, total long, rate double, low double, high double")
    text = sinks.score_report(s, "Scores")
    assert "| edges | 90.0% | 60.0% to 98.0% | 9 of 10 |" in text and "withheld" in text
    sinks.write_scores(s, str(tmp_path / "s"))
    assert [json.loads(x)["metric"] for x in next((tmp_path / "s").glob("part-*")).read_text().splitlines()] == ["edges", "tags"]
    t = {"nodes": spark.createDataFrame([(1,)], "k int")}
    (tmp_path / "blocked").write_text("a file where a folder should be")
    said = sinks.store_run(spark, str(tmp_path / "blocked"), str(tmp_path / "files"), "r1", t)
    assert "failed" in said and sinks.read_run(spark, str(tmp_path / "files"), "nodes").count() == 1
    assert "in the store" in sinks.store_run(spark, str(tmp_path / "ok"), str(tmp_path / "files"), "r2", t) and "no store" in sinks.store_run(spark, None, str(tmp_path / "files"), "r3", t)
