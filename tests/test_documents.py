"""Readers, writers and the comparison end to end on a small pair of editions."""

import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from stemma.editions import compare
from stemma.sources import documents, sinks
from stemma.streaming.editions import PARAGRAPHS, compare_arrivals

OLD = "# TR 1\n\n## 1 Zweck\n\nDiese Regel gilt für Anlagen.\n\n## 2 Schutz\n\nDer Schutz sollte geprüft\nwerden.\n\n- erste Stufe\n- zweite Stufe\n\n### 2.1 Relais\n\nDas Relais ist jährlich zu prüfen, siehe Abschnitt 1.\n\n## 3 Ende\n\nDieser Absatz entfällt in der neuen Ausgabe ganz.\n"
NEW = "# TR 1\n\n## 1 Zweck\n\nDiese Regel gilt für Anlagen.\n\n## 2 Schutz\n\nDer Schutz muss geprüft werden.\n\n- erste Stufe\n- zweite Stufe\n\n### 2.1 Relais\n\nDas Relais ist jährlich zu prüfen, siehe Abschnitt 2.\n\n## 3 Ende\n\nSpeicher werden neu geregelt.\n"


def paragraphs(spark):
    rows = [("p", e, *r[1:5], r[6], r[8]) for e, text in (("old", OLD), ("new", NEW)) for r in documents.parse_markdown(e, text)]
    return spark.createDataFrame(rows, PARAGRAPHS).filter("sec_ix >= 0")


def test_markdown_numbers_and_kinds():
    rows = documents.parse_markdown("d", OLD)
    assert [(r[2], r[4]) for r in rows if r[6] is None] == [("1", 1), ("2", 1), ("2.1", 2), ("3", 1)]
    assert [r[7] for r in rows if r[2] == "2" and r[6] is not None] == ["text", "list", "list"]
    try:
        documents.parse_markdown("d", "## 2 falsch")
    except documents.IngestError as e:
        assert "should be 1" in str(e)
    else:
        raise AssertionError


def test_editions_are_compared(spark):
    found = compare(paragraphs(spark))
    kinds = {(r["mapping"], r["kind"]): r["n"] for r in found.changes.groupBy("mapping", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {("2<2", "similar"): 1, ("2.1<2.1", "similar"): 1, ("3<3", "new"): 1, ("3<3", "removed"): 1}
    assert {r["mapping"]: r["n_identical"] for r in found.chapters.collect()} == {"1<1": 1, "2<2": 2, "2.1<2.1": 0, "3<3": 0}
    changes = {r["mapping"]: r for r in found.changes.filter("kind = 'similar'").collect()}
    assert changes["2<2"]["modality"]["shift"] == "verschaerft"
    assert changes["2.1<2.1"]["refs"]["internal_added"] == ["2"] and changes["2.1<2.1"]["refs"]["internal_removed"] == ["1"]


def test_arrivals(spark, tmp_path):
    paragraphs(spark).write.parquet(f"{tmp_path}/in")
    compare_arrivals(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_word_files_round_trip(spark, tmp_path):
    rows = [{"kind": "similar", "old_text": "alt & gut", "new_text": "neu"}]
    content = sinks.docx("Titel", rows)
    assert content == sinks.docx("Titel", rows)
    found, cells = documents.parse_docx("d", content)
    assert [(r[3], r[4]) for r in found] == [("Titel", 1)]
    assert [c[4:] for c in cells] == [(0, 0, "alt & gut"), (0, 1, "neu")]
    (tmp_path / "d.docx").write_bytes(content)
    (tmp_path / "e.md").write_text(OLD)
    assert documents.read_documents(spark, str(tmp_path)).select("doc").distinct().count() == 2
    assert documents.read_cells(spark, str(tmp_path)).count() == 2


def test_json_round_trip(spark, tmp_path):
    keys = documents.NAMES
    rows = [dict(zip(keys, r)) for r in documents.parse_markdown("d", OLD) if r[1] >= 0]
    (tmp_path / "d.json").write_text(documents.to_json(rows))
    got = documents.read_json(spark, str(tmp_path))
    assert got.filter("par_ix is not null").count() == sum(r["par_ix"] is not None for r in rows)
    tree = {"doc_id": "x", "source": {"format": "docx", "pages": None}, "sections": [{"id": "1", "title": None, "level": 1, "part": "hauptteil", "paragraphs": [{"id": "1.p1", "n0": "ä", "values": [{"raw": "5 %"}], "modality": None}], "tables": []}, {"id": "2", "title": "t", "level": 1, "paragraphs": []}]}
    (tmp_path / "d.json").write_text(json.dumps(tree, ensure_ascii=False))
    back = [r.asDict() for r in documents.read_json(spark, str(tmp_path)).collect()]
    assert json.loads(documents.to_json(back)) == tree


WORD_FILE = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Vorwort</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Inhalt</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Begriffe</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="TERM-number"/></w:pPr></w:p><w:p><w:pPr><w:pStyle w:val="TERM-name"/></w:pPr><w:r><w:t>Anlage</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="TERM-number3"/></w:pPr></w:p><w:p><w:pPr><w:pStyle w:val="TERM-name"/></w:pPr><w:r><w:t>Teil</w:t></w:r></w:p>
<w:p><w:r><w:t>Es gilt </w:t></w:r><w:ins w:author="x" w:date="d"><w:r><w:t>nun</w:t></w:r></w:ins><w:del w:author="y"><w:r><w:delText>nicht</w:delText></w:r></w:del><w:r><w:t> dies.</w:t></w:r></w:p>
<w:p><m:oMath><m:r><m:t>P=</m:t></m:r><m:r><m:t>UI</m:t></m:r></m:oMath></w:p><w:p><w:r><a:blip r:embed="i1"/></w:r></w:p><w:p><w:r><w:t>Bild 3 – Netz</w:t></w:r></w:p>
<w:p><w:r><w:t>Tabelle 1: Werte</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def test_word_details(spark, tmp_path):
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="i1" Target="media/a.png"/></Relationships>'
    content = sinks.frozen_zip({"word/document.xml": WORD_FILE.encode(), "word/_rels/document.xml.rels": rels.encode(), "word/media/a.png": b"png"})
    found = documents.WordReader("d", content).read()
    assert [(r[2], r[7], r[8]) for r in found.rows] == [("vorspann.vorwort", None, None), ("1", None, None), ("1", "term", "Anlage"), ("1", "term", "Teil"), ("1", "text", "Es gilt nun dies."), ("1", "formula", "")]
    assert [t[3] for t in found.terms] == ["1.1", "1.1.1"] and [(c[1:]) for c in found.changes] == [(1, 2, "ins", "nun", "x", "d"), (1, 2, "del", "nicht", "y", None)]
    assert [(f[1], f[4], f[5]) for f in found.formulas] == [("d_eq_001", None, "P=UI"), ("d_eq_002", "d_tab_001", "x")]
    assert found.figures == [("d", "d_fig_001", 1, 4, "Bild 3 – Netz", "assets/images/d_fig_001.png")] and found.images == {"d_fig_001.png": b"png"}
    (tmp_path / "d.docx").write_bytes(content)
    assert documents.read_word_part(spark, str(tmp_path), "terms").count() == 2
    table = documents.cell_matrices(documents.read_cells(spark, str(tmp_path))).first()
    assert table["caption"] == "Tabelle 1 – Werte" and table["cells"] == [["a", ""]]
    with pytest.raises(documents.IngestError):
        documents.WordReader("d", b"no archive")


def test_settings_vectors_and_digest(spark, tmp_path):
    from stemma import inspector
    from stemma.config import Config
    from stemma.editions import enriched
    from stemma.operators import align
    from stemma.sources import vectors

    c = Config.of_paths("a/old.docx", "b/new.docx", "out/x", tau=0.7)
    assert (c.old.doc_id, c.pair_label, c.run_name, c.tau, c.tau_for(("pdf", "docx")), c.tau_for(("pdf", "pdf"))) == ("old", "old <-> new", "x", 0.7, 0.6499999999999999, 0.7)
    (tmp_path / "c.toml").write_text('tau = 0.5\nllm_model = "m"\ndeutung_scope = "all"\n[old]\npath = "o"\ndoc_id = "o"\ntitle = "O"\nversion_label = "1"\n[new]\npath = "n"\ndoc_id = "n"\ntitle = "N"\nversion_label = "2"\n')
    f = Config.of_file(f"{tmp_path}/c.toml", "out")
    assert (f.tau, f.interpreter.model, f.interpreter.scope, f.new.title) == (0.5, "m", "all", "N")
    texts = spark.createDataFrame([(1, "Ein Text."), (2, "ein  text"), (3, "anderes")], "id int, text string")
    cache = vectors.VectorCache(spark.createDataFrame([], "key string, vec array<float>"), "m")
    lost = cache.missing(texts)
    assert lost.count() == 2
    filled = cache.added(lost.select("key", F.array(F.lit(1.0).cast("float")).alias("vec")))
    assert filled.missing(texts).count() == 0 and filled.with_vectors(texts).filter("vec is not null").count() == 3
    unit = lambda rows: spark.createDataFrame(rows, "p string, id int, vec array<double>")
    pairs = vectors.best_pairs(unit([("x", 1, [1.0, 0.0]), ("x", 2, [0.95, 0.31])]), unit([("x", 7, [1.0, 0.0]), ("x", 8, [0.0, 1.0])]), ["p"], 0.9)
    assert {(r["old_id"], r["new_id"], r["best_of_old"], r["best_of_new"]) for r in pairs.collect()} == {(1, 7, 7, 1), (2, 7, 7, 1)}
    from stemma.functions import values

    valued = pairs.withColumns({"old_values": values.extract(F.lit("5 % und 3 kW")), "new_values": values.extract(F.when(F.col("old_id") == 1, "3 kW, 5 %, 7 V").otherwise("4 %"))})
    valued = spark.createDataFrame(valued.collect(), valued.schema)
    assert {r["old_id"]: r["failed"] for r in align.confirm_moves(valued).collect()} == {1: [], 2: ["kennwerte", "wechselseitig"]}
    with pytest.raises(ValueError):
        vectors.similarity("none")
    digest = inspector.render(enriched(paragraphs(spark).filter("edition = 'old'")), "TR 1")
    assert "Sections : 4    Paragraphs: 6" in digest and "[L2] 2.1" in digest


def test_writers(spark, tmp_path):
    table = sinks.changes_csv([{"section_id": "1", "affected_components": ["a", "b"], "change": "x;y", "section_new": "1.2"}])
    head, row = table.decode("utf-8-sig").splitlines()
    assert head.split(";") == list(sinks.CSV_COLUMNS) and len(sinks.CSV_COLUMNS) == 19
    assert row.startswith("1;;") and ";a|b;" in row and '"x;y"' in row and row.endswith(";1.2") and table.startswith(b"\xef\xbb\xbf")
    assert sinks.changes_csv([]).count(b"\n") == 1
    note = tmp_path / "n.txt"
    sinks.coverage_note(note, "UNVOLLSTÄNDIG")
    assert note.read_text() == "UNVOLLSTÄNDIG\n"
    sinks.coverage_note(note, None)
    sinks.coverage_note(note, None)
    assert not note.exists()
    page = sinks.annotated_html("t", [{"kind": "similar", "old_text": "alt", "new_text": "neu", "head": "1", "section": "1.1", "cells": [["a", "b"]], "old_cells": [["A", "c"]]}], [{"section": "1", "old": "5 %", "new": "2 %", "value_class": "value_changed"}], {"x": b"png"})
    assert "<del>alt</del><ins>neu</ins>" in page and "<td>a</td><td class=changed>b</td>" in page and "<td>5 %</td><td>2 %</td>" in page and "base64," in page and "<h2>1 </h2>" in page
    assert json.loads(sinks.manifest({"a": b"x"}, {"tau": 0.62}, "2020-01-01"))["parameters"] == {"tau": 0.62}
    assert "| scope | 2 | 0 |" in sinks.component_markdown([{"component": "scope", "direction": "relaxed", "n": 2}, {"component": "none", "direction": "tightened", "n": 1}])
    tables = spark.createDataFrame([("t1", [["a", 'b"c'], ["d,e", None]])], "table_id string, cells array<array<string>>")
    assert tables.select(sinks.csv_text(F.col("cells"))).first()[0] == 'a,"b""c"\n"d,e",'
    sinks.write_tables(tables, f"{tmp_path}/tables")
    assert spark.read.text(f"{tmp_path}/tables/table_id=t1").count() == 2
    for made in (sinks.pptx("T", [{"head": "1", "title": "Zweck", "lines": ["a & b"]}]), sinks.final_docx("T", [{"new_id": "1", "title": "Zweck", "value_changes": [{"old": "5 %", "new": "2 %"}]}])):
        names = zipfile.ZipFile(io.BytesIO(made)).namelist()
        assert all(ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(made)).read(n)) is not None for n in names) and "[Content_Types].xml" in names


def test_layout_lines_become_paragraphs(spark):
    from stemma.sources import layout

    texts = [
        (1, 50, 8, "TR 1000:2026"), (1, 100, 14, "1 Zweck"), (1, 130, 10, "Diese Regel gilt für alle"), (1, 142, 10, "Anlagen am Netz."), (1, 180, 10, "– erster Punkt"), (1, 192, 10, "– zweiter Punkt"), (1, 790, 8, "1"),
        (2, 50, 8, "TR 1000:2026"), (2, 100, 10, "Tabelle 3 – Grenzwerte der"), (2, 112, 10, "Spannung"), (2, 140, 14, "2 Grundlagen"), (2, 170, 10, "2.1 Anlage"), (2, 200, 10, "Eine Anlage ist alles, was nach der hier folgenden Tabelle 3 empfohlen"), (2, 212, 10, "wird."),
        (2, 240, 10, "P = U · I = 3 (7)"), (2, 270, 10, "ANMERKUNG Das gilt nicht immer."), (2, 790, 8, "2"), (3, 50, 8, "TR 1000:2026"), (3, 100, 14, "Anhang A (informativ) Beispiele"), (3, 130, 10, "Ein Beispiel."), (3, 790, 8, "3"),
    ]
    lines = spark.createDataFrame([("d", k, p, float(y), 10.0, 200.0, float(s), s > 12, ["F"], t, 800.0) for k, (p, y, s, t) in enumerate(texts)], "doc string, ix int, page int, y double, x double, x1 double, size double, bold boolean, fonts array<string>, text string, page_height double")
    outline = spark.createDataFrame([("d", 0, "Inhalt", 1), ("d", 1, "1 Zweck", 1), ("d", 2, "2 Grundlagen", 2), ("d", 3, "Anhang A (informativ) Beispiele", 3), ("d", 4, "3 danach", 3), ("d", 5, "TR 1000", 1)], "doc string, ix int, title string, page int")
    found = layout.outline_sections(outline, spark.createDataFrame([("d", "TR 1000")], "doc string, doc_title string"))
    assert [(r["section_id"], r["part"]) for r in found.orderBy("ix").collect()] == [("1", "hauptteil"), ("2", "hauptteil"), ("A", "anhang_informativ")]
    rows = layout.read_layout(lines, outline).filter("par_ix is not null").orderBy("sec_ix", "par_ix").collect()
    assert [(r["section_id"], r["kind"], r["n0"]) for r in rows] == [
        ("1", "text", "Diese Regel gilt für alle Anlagen am Netz."), ("1", "list", "– erster Punkt"), ("1", "list", "– zweiter Punkt"), ("1", "caption", "Tabelle 3 – Grenzwerte der Spannung"),
        ("2", "term", "Anlage"), ("2", "text", "Eine Anlage ist alles, was nach der hier folgenden Tabelle 3 empfohlen wird."), ("2", "formula", "P = U · I = 3 (7)"), ("2", "note", "ANMERKUNG Das gilt nicht immer."), ("A", "text", "Ein Beispiel."),
    ]
    spans = spark.createDataFrame([("d", 1, 0, 5.0, "p"), ("d", 1, 1, 2.0, "i"), ("d", 1, 2, 2.0, "_")], "doc string, line int, k int, x double, text string")
    assert layout.reading_order(spans).first()["text"] == "i_p"
    assets = spark.createDataFrame([("d", "a", 2), ("d", "b", 9)], "doc string, asset_id string, page int")
    pages = spark.createDataFrame([("d", 1, 2), ("d", 0, 2)], "doc string, sec_ix int, page int")
    assert [tuple(r) for r in layout.claimed_assets(assets, pages).collect()] == [("d", "a", 0)]
    assert layout.read_layout(lines.limit(0), outline).count() == 0


def test_stages_say_what_is_missing(spark, tmp_path):
    from stemma import stages

    run = stages.Stages(spark, f"{tmp_path}/run")
    with pytest.raises(stages.MissingInputError, match="align"):
        run.load("links", "align")
    assert run.save("links", spark.range(3)).count() == 3 == run.load("links", "align").count()
