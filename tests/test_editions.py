"""The comparison end to end on small invented editions, and what is reported, asked and measured of it."""

import random

import pytest
from pyspark.sql import functions as F

from stemma import editions
from stemma.functions import captions
from stemma.operators import align, audits, chapters, diff, interpretation, kernels, reports
from stemma.plans import forms
from stemma.sources.documents import parse_markdown

OLD = """## 1 Anwendungsbereich

Diese Regel beschreibt den Anschluss von Speichern an ein Gebäudenetz.

## 2 Geltung

Sie gilt für alle Speicher mit einer Leistung über 10 kW im Gebäudenetz.

## 3 Zugang

Der Zugang zum Speicherraum sollte gegen Unbefugte gesichert sein.

## 4 Prüfung

### 4.1 Kalibrierung

Die Messeinrichtung des Speichers ist jährlich durch eine Fachkraft zu kalibrieren.

### 4.2 Protokoll

Über jede Kalibrierung ist ein Protokoll mit Datum und Messwerten anzulegen.

## 5 Abweichung

Die Abweichung der gemessenen Leistung darf 5 % nicht überschreiten.

## 6 Schutz

### 6.1 Relais

Das Schutzrelais trennt den Speicher bei einem Fehler im Gebäudenetz selbsttätig vom Netz.

### 6.2 Schalter

Der Kuppelschalter bleibt nach einer Trennung bis zur Freigabe geöffnet.

## 7 Kennzeichnung

Am Speicherraum ist ein dauerhaftes Schild mit der Nennleistung anzubringen.

## 8 Unterlagen

Der Betreiber hat folgende Unterlagen bereitzuhalten:

- den Übersichtsplan der gesamten Anlage

- die Bedienungsanleitung des Herstellers

- das letzte Prüfprotokoll

## 9 Betrieb

### 9.1 Meldung

Störungen des Speichers sind dem Netzbetreiber unverzüglich zu melden.

## 10 Aufbewahrung

Alle Protokolle sind zehn Jahre lang aufzubewahren und auf Verlangen vorzulegen.

## 11 Übergang

Bestehende Speicher dürfen bis zum Ende ihrer Nutzungsdauer weiterbetrieben werden.
"""
NEW = """## 1 Anwendungsbereich

Diese Regel beschreibt den Anschluss von Speichern an ein Gebäudenetz.

## 2 Geltung

Sie gilt für alle Speicher mit einer Leistung über 30 kW im Gebäudenetz.

## 3 Zugang

Der Zugang zum Speicherraum muss gegen Unbefugte gesichert sein.

## 4 Prüfung

### 4.1 Kalibrierung

Die Messeinrichtung des Speichers ist halbjährlich durch eine Fachkraft zu kalibrieren.

Ausgenommen bleiben Geräte mit selbsttätigem Abgleich gegen ein geeichtes Normal.

### 4.2 Fernabfrage

Leistungswerte müssen über eine gesicherte Verbindung abrufbar sein.

### 4.3 Protokoll

Über jede Kalibrierung ist ein Protokoll mit Datum und Messwerten anzulegen.

## 5 Abweichung

Die Abweichung der gemessenen Leistung darf 2 % nicht überschreiten.

## 6 Schutz

Das Schutzrelais trennt den Speicher bei einem Fehler im Gebäudenetz selbsttätig vom Netz. Der Kuppelschalter bleibt nach einer Trennung bis zur Freigabe geöffnet.

## 7 Kennzeichnung

Am Speicherraum ist ein dauerhaftes Schild mit der Nennleistung anzubringen.

## 8 Unterlagen

Der Betreiber hat folgende Unterlagen bereitzuhalten:

- den Übersichtsplan der gesamten Anlage

- die Bedienungsanleitung des Herstellers

- das letzte Prüfprotokoll

- einen Nachweis der Brandlast

## 9 Betrieb

### 9.1 Meldung

Störungen des Speichers sind dem Netzbetreiber unverzüglich zu melden.

### 9.2 Aufbewahrung

Alle Protokolle sind zehn Jahre lang aufzubewahren und auf Verlangen vorzulegen.

## 10 Entsorgung

Zellen gehören am Ende ihrer Lebensdauer in eine zugelassene Verwertung.
"""
MOVE = ["Der Nachweis der Blindleistung ist durch den Betreiber vor jeder Änderung der Anlage zu führen.", "kurz hier", "Die Messung der Spannung erfolgt an der Übergabestelle mit einem geeichten Gerät des Netzbetreibers."]
STAY = ["Im ersten Kapitel bleibt dieser Satz über die Speicher stehen.", "Im zweiten Kapitel bleibt dieser Satz über die Ladepunkte stehen."]
COSMETIC = (["Die Kennlinie (a) ist dauerhaft einzuhalten und jährlich zu prüfen.", "Die Reserve beträgt mindestens 5 %, jedoch immer so viel, wie der Netzbetreiber dafür verlangt.", "Nach Abschnitt 3 gilt die Grenze für alle Anlagen am Netz.", "Die Anlagen-Steuerung bleibt."],
            ["Die Kennlinie (b) ist dauerhaft einzuhalten und jährlich zu prüfen.", "Die Reserve beträgt mindestens 1 %, jedoch immer so viel, wie der Netzbetreiber dafür verlangt.", "Nach Abschnitt 4 gilt die Grenze für alle Anlagen am Netz.", "Die Anlagensteuerung bleibt."])
ROWS = "pair_id string, edition string, sec_ix int, section_id string, title string, level int, part string, par_ix int, kind string, n0 string"


def section(pair, edition, ix, title, texts, part="hauptteil"):
    head = (pair, edition, ix, str(ix + 1), title, 1, part)
    return [(*head, None, None, None), *((*head, k, "text", t) for k, t in enumerate(texts))]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("trx", e, *r[1:6], *r[6:9]) for e, text in (("old", OLD), ("new", NEW)) for r in parse_markdown(e, text)]
    rows += section("mv", "old", 0, "Nachweise", [STAY[0], *MOVE]) + section("mv", "old", 1, "Betrieb", [STAY[1]]) + section("mv", "old", 2, "Vorwort", ["Vorwort der alten Ausgabe."], "vorspann")
    rows += section("mv", "new", 0, "Nachweise", [STAY[0]]) + section("mv", "new", 1, "Betrieb", [STAY[1], MOVE[0], MOVE[2]])
    rows += section("co", "old", 0, "Grenzen", COSMETIC[0]) + section("co", "new", 0, "Grenzen", COSMETIC[1])
    rows += section("nz", "old", 0, "Begriffe und Symbole", ["Messwert", "x 1", "Dieser Absatz wird ersatzlos gestrichen, weil er nicht mehr gebraucht wird."]) + section("nz", "new", 0, "Begriffe und Symbole", ["k2"])
    tables = [
        ("co", "old", 0, "a", "Tabelle 1 – Grenzwerte der Spannung", [["U", "Wert"], ["1", "5 %"]]), ("co", "new", 0, "b", "Tabelle 2 – Grenzwerte der Spannung", [["U", "Wert"], ["1", "4 %"]]),
        ("co", "old", 0, "rest", "", [["(11)"]]), ("mv", "old", 0, "c", "Tabelle 3 – Zertifikate", [["Nr", "Art"], ["1", "Anlage"]]), ("mv", "new", 1, "d", "Tabelle 9 – Zertifikate", [["Nr", "Art"], ["1", "Anlage"]]),
        ("mv", "new", 0, "e", None, [["ganz", "anders"], ["und", "neu"]]),
    ]
    formulas = [("co", "old", 0, None, "P = U I"), ("co", "new", 0, None, "P=UI"), ("co", "new", 0, "Q = 1", None)]
    got = editions.compare(
        spark.createDataFrame(rows, ROWS), tables=spark.createDataFrame(tables, "pair_id string, edition string, sec_ix int, table_id string, caption string, cells array<array<string>>"),
        formulas=spark.createDataFrame(formulas, "pair_id string, edition string, sec_ix int, latex string, linear string"),
    )
    return got


@pytest.fixture(scope="module")
def changes(found):
    return [r.asDict(recursive=True) for r in found.changes.collect()]


def of(changes, pair):
    return sorted((c["mapping"], c["kind"]) for c in changes if c["pair_id"] == pair)


def test_invented_rule(found, changes):
    records = {r["mapping"]: r for r in found.chapters.filter("pair_id = 'trx'").collect()}
    assert set(records) == {"1<1", "2<2", "3<3", "4+4.2<4", "4.1<4.1", "4.3<4.2", "5<5", "6<6+6.1+6.2", "7<7", "8<8", "9<9", "9.1<9.1", "9.2<10", "<11", "10<"} and len(records) == 15
    assert of(changes, "trx") == sorted([("2<2", "similar"), ("3<3", "similar"), ("4.1<4.1", "similar"), ("5<5", "similar"), ("4.1<4.1", "new"), ("4+4.2<4", "new"), ("8<8", "new"), ("10<", "new"), ("<11", "removed"), ("6<6+6.1+6.2", "merged")])
    by = {(c["mapping"], c["kind"]): c for c in changes if c["pair_id"] == "trx"}
    assert by["2<2", "similar"]["kennwerte"]["changed"][0]["old"]["raw"] == "10 kW" and by["5<5", "similar"]["kennwerte"]["changed"][0]["value_class"] == "value_changed"
    assert by["3<3", "similar"]["modality"]["shift"] == "verschaerft" and by["<11", "removed"]["modality"] == {"old": "darf", "new": None, "shift": None, "sentence_shifts": None}
    assert by["6<6+6.1+6.2", "merged"]["old_ids"] == ["6.1.p1", "6.2.p1"] and by["6<6+6.1+6.2", "merged"]["semantic_equal"] and by["6<6+6.1+6.2", "merged"]["section_old"] == "6.1"
    assert by["<11", "removed"]["relocation"]["best_score"] < 0.7 and records["6<6+6.1+6.2"]["restructured"] == "merge_up"


def test_moves_are_one_event_with_two_records(found, changes):
    assert of(changes, "mv") == [("1<1", "moved_away")] * 3 + [("2<2", "moved_in")] * 2
    away = {c["old_text"]: c for c in changes if c["kind"] == "moved_away"}
    into = {c["new_text"]: c for c in changes if c["kind"] == "moved_in"}
    for t in (MOVE[0], MOVE[2]):
        assert away[t]["moved_to_chapter"] == "2" and away[t]["moved_to"] is not None and into[t]["moved_from"] is not None and away[t]["confidence"] == 1.0
    assert away[MOVE[1]]["moved_to"] is None and away[MOVE[1]]["moved_to_chapter"] == "2" and away[MOVE[1]]["via"] == "block"
    assert found.chapters.filter("pair_id = 'mv' and old_id = '3'").count() == 0  # front matter


def test_form_is_cosmetic_unless_a_fact_changed(changes):
    co = {c["old_text"][:11]: c for c in changes if c["pair_id"] == "co"}
    assert {k: (c["kind"], c["lifted_by"]) for k, c in co.items()} == {"Die Kennlin": ("cosmetic", None), "Die Reserve": ("similar", "kennwerte"), "Nach Abschn": ("similar", "refs")}


def test_noise_and_fragments_are_counted_not_reported(found, changes):
    assert of(changes, "nz") == [("1<1", "removed")]
    row = found.chapters.filter("pair_id = 'nz'").first()
    assert (row["n_noise"], row["n_non_normative"], row["n_old"], row["n_new"]) == (2, 1, 3, 1)


def test_tables_and_formulas(found):
    got = {(r["pair_id"], r["kind"], r["old"], r["new"], r["rows_changed"]) for r in found.tables.collect()}
    assert got == {("co", "matched", "a", "b", 1), ("mv", "moved_away", "c", "d", 0), ("mv", "moved_in", "c", "d", 0), ("mv", "new", None, "e", None)}
    assert [(r["n_old"], r["n_new"], r["added"], r["removed"]) for r in found.formulas.collect()] == [(1, 2, ["Q=1"], [])]


def test_reports(spark, found):
    kinds = {(r["pair_id"], r["kind"]): r["n"] for r in reports.change_kinds(found.changes).collect()}
    assert kinds["trx", "similar"] == 4 and kinds["mv", "moved_in"] == 2
    stats = {r["pair_id"]: r for r in reports.pair_statistics(found.changes, found.chapters).collect()}
    assert stats["trx"]["n_changes"] == 10 and stats["trx"]["n_value_changes"] == 2 and stats["trx"]["n_tightened"] == 1
    dossiers = {(r["pair_id"], r["mapping"]): r for r in reports.dossier(found.chapters, found.changes, tables=found.tables).collect()}
    assert dossiers["trx", "2<2"]["value_changes"][0]["new"] == "30 kW" and dossiers["trx", "1<1"]["n_changes"] == 0 and len(dossiers["co", "1<1"]["tables_diff"]) == 1
    slides = reports.slides(reports.dossier(found.chapters, found.changes), found.changes).filter("pair_id = 'trx'").orderBy("slide").collect()
    assert slides[0]["head"] == "2" and len(slides) == 9 and slides[0]["lines"][0].startswith("[similar]")
    lines = reports.parameter_groups(reports.value_changes(found.changes), found.chapters).filter("pair_id = 'trx'").orderBy("place").collect()
    assert [r["line"] for r in lines] == ["2: 10 kW → 30 kW", "5: 5 % → 2 %"]
    rows = reports.synopsis_rows(found.changes, found.chapters).filter("pair_id = 'trx'").orderBy("place").collect()
    assert [r["head"] for r in rows][:3] == ["2", "3", "4"] and next(r for r in rows if r["kind"] == "merged")["section"] == "6.1 → 6"
    assert reports.review_list(found.changes, found.balance).count() == 0
    said = spark.createDataFrame([("trx", "2<2", "2", 0, 0, "narrowed", "tightened", ["scope", ""], None, 0)], "pair_id string, mapping_id string, section_id string, change_index int, change_ix int, semantic_status string, normative_direction string, affected_components array<string>, indeterminate_reason string, place int")
    row = reports.change_rows(said, found.chapters, found.changes).first()
    assert (row["change_kind"], row["chapter_title"], row["affected_components"], row["section_new"], row["impact"]) == ("similar", "geltung", ["scope"], "2", "") and reports.carries_axes(said)
    view = reports.component_view(said.withColumn("mapping", F.col("mapping_id"))).collect()
    assert [(r["component"], r["direction"], r["n"]) for r in view] == [("scope", "tightened", 1)]


def test_prompts_answers_and_coverage(spark, found):
    excerpts = found.chapters.select("pair_id", "mapping", F.lit("alt").alias("old_excerpt"), F.lit("").alias("new_excerpt"))
    trx, chapters = found.changes.filter("pair_id = 'trx'"), found.chapters.filter("pair_id = 'trx'")
    asked = interpretation.prompts(trx, chapters, excerpts).cache()
    rows = {r["tag"]: r for r in asked.collect()}
    assert set(rows) == {"2_2", "3_3", "4_4.2_4", "4.1_4.1", "5_5", "8_8", "_11", "10_"}
    assert "    Kennwerte: 10 kW → 30 kW" in rows["2_2"]["user"] and "ÄNDERUNGEN (1 von 1, deterministisch" in rows["2_2"]["user"] and "(Kapitel in der neuen Fassung entfallen)" in rows["2_2"]["user"] and rows["4.1_4.1"]["indices"] == [0, 1]
    fixture = interpretation.FixtureProvider(spark.createDataFrame([], "key string, answer string"), "m", interpretation.system_prompt("Deutsch", "TR"))
    with pytest.raises(KeyError):
        fixture.resolve(asked)
    keys = {r["tag"]: r["key"] for r in fixture.keyed(asked).collect()}
    answers = [(keys["2_2"], '```json\n{"interpretations": [{"change_index": 0, "evidence": "über 30 kW", "semantic_status": "narrowed"}, {"change_index": 7}, {"change_index": 0}]}\n```'), (keys["3_3"], '{"interpretations": [{"change_index": 0, "change": "a\tb"}]}'), (keys["5_5"], "nein")]
    fixture.answers = spark.createDataFrame(answers, "key string, answer string")
    resolved = fixture.resolve(asked, strict=False).cache()
    assert {r["outcome"]: r["n"] for r in interpretation.outcome_counts(resolved).collect()} == {"ok": 1, "repaired": 1, "unparsable": 1, "export": 5}
    merged = interpretation.merged_answers(resolved, trx.groupBy("pair_id", "mapping").agg((F.max("change_ix") + 1).alias("n_changes")))
    got = {r["mapping"]: (r["collisions"], r["interpretation"]["semantic_status"]) for r in merged.collect()}
    assert got == {"2<2": (1, "narrowed"), "3<3": (0, None)}
    report = interpretation.coverage_report(asked, merged, 10)
    assert report.agg(F.sum("n_changes"), F.sum("n_interpreted")).first()[:] == (9, 2)
    assert reports.coverage_note(report).first()["note"].startswith("UNVOLLSTÄNDIG: 2 von 9 Änderungen sind gedeutet (22,2 %)")
    assert interpretation.blocks(spark.range(95).select(F.lit("p").alias("pair_id"), F.lit("m").alias("mapping"), F.col("id").cast("int").alias("change_ix"), *(F.lit(None).cast(trx.schema[c].dataType).alias(c) for c in ("kind", "modality", "kennwerte", "old_text", "new_text", "semantic_equal")))).groupBy("block").count().count() == 3
    assert interpretation.feedback(spark, {"move_pointer": 2}).filter("count > 0").count() == 1


HAY = [(0, "Die Anlage ist jährlich durch eine Fachkraft zu kalibrieren.", "Die Anlage ist halbjährlich durch eine Fachkraft zu kalibrieren."), (1, None, "Ausgenommen sind Geräte mit selbsttätigem Abgleich."), (2, "Kurz.", None)]


@pytest.mark.parametrize(
    ("index", "quote", "want"),
    [
        (0, "Die Anlage ist … durch eine Fachkraft zu kalibrieren", {"ok": True, "strict": True, "fragments": 2}),
        (0, "Die Uhr ist … durch eine Fachkraft zu kalibrieren", {"ok": False, "strict": False, "fragments": 2}),
        (0, "Die Anlage ist jährlich … zu kalibrieren", {"ok": True, "strict": True, "fragments": 2, "unique": True, "best": 0}),
        (0, "Die Anlage ist halbjährlich … Abgleich", {"ok": True, "strict": False, "fragments": 2}),
        (0, "die anlage ist jährlich erfunden worden", {"ok": True, "strict": False}),
        (0, "zu kalibrieren", {"ok": False, "strict": True, "unique": True}),
        (2, "kurz.", {"ok": True, "strict": True}),
        (0, "NEU: Die Anlage ist halbjährlich durch eine Fachkraft", {"ok": True, "extraction": "etikett"}),
        (0, "Das steht dort: „Die Anlage ist halbjährlich durch“ so.", {"ok": True, "extraction": "anfuehrung", "span": "Die Anlage ist halbjährlich durch"}),
        (0, "Ausgenommen sind Geräte mit selbsttätigem Abgleich", {"ok": False, "best": 1, "disputed": True}),
        (9, "Ausgenommen sind Geräte", {"ok": False, "best": 1, "disputed": True}),
        (0, "", {"ok": False, "strict": False, "best": None, "disputed": False}),
        (0, None, {"ok": False, "match_chars": 0}),
    ],
)
def test_evidence(evidence, index, quote, want):
    got = evidence[index, quote]
    assert {k: got[k] for k in want} == want


@pytest.fixture(scope="module")
def evidence(spark):
    cases = [m.args[1] for m in test_evidence.pytestmark][0]
    answers = spark.createDataFrame([("p", "m", i, q) for i, q, _ in cases], "pair_id string, mapping string, change_ix int, evidence string")
    changes = spark.createDataFrame([("p", "m", *h) for h in HAY], "pair_id string, mapping string, change_ix int, old_text string, new_text string")
    rows = interpretation.check_evidence(answers, changes).collect()
    return {(r["change_ix"], r["evidence"]): r["guard"].asDict() | {"unique": r["evidence_unique"], "best": r["change_index_best"], "disputed": r["change_index_disputed"]} for r in rows}


def test_matched_beginnings_equal_a_search(spark):
    import random

    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    rows = [(word(rnd.randrange(12)), word(30)) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, f string, h string").orderBy("k").select(interpretation.matched_chars(F.col("f"), F.col("h"))).collect()]
    assert got == [max(n for n in range(len(f) + 1) if f[:n] in h) for f, h in rows]


def test_axes_are_checked_not_corrected(spark):
    rows = [
        (0, "new", "extended", "tightened", ["scope", "other:x", "zzz"], None, "added", "extended", "tightened", ["scope", "other:x"], None, ["affected_components:outside_vocabulary"]),
        (1, "similar", "restricted", None, None, None, "modified", None, None, None, None, ["semantic_status:outside_vocabulary", "normative_direction:missing", "affected_components:missing"]),
        (2, "odd", "indeterminate", "unchanged", ["none"], None, None, None, "unchanged", ["none"], None, ["semantic_status:reason_missing"]),
        (3, "moved_in", "indeterminate", "unchanged", ["none"], " no_evidence ", "moved", "indeterminate", "unchanged", ["none"], "no_evidence", []),
        (4, "split", "clarified", "relaxed", ["other:"], "no_evidence", "split", "clarified", "relaxed", None, None, ["affected_components:outside_vocabulary", "indeterminate_reason:reason_without_abstention"]),
    ]
    frame = spark.createDataFrame([r[:6] for r in rows], "k int, kind string, semantic_status string, normative_direction string, affected_components array<string>, indeterminate_reason string")
    for r in interpretation.check_axes(frame).collect():
        want = rows[r["k"]]
        assert (r["structural_operation"], r["semantic_status"], r["normative_direction"], r["affected_components"], r["indeterminate_reason"]) == want[6:11], r
        assert [f"{v['field']}:{v['reason']}" for v in r["violations"]] == want[11]


def test_values_of_tables_are_sought_in_their_cells(spark):
    items = spark.createDataFrame([("p", "m", 0, "x_tab_001", "", ["5 % -> 4 %", "nur 7 kW"]), ("p", "m", 1, None, " Tabelle  1 – a ", ["Zeile 9,5 s"]), ("p", "m", 2, None, "doppelt", ["1 s"]), ("p", "m", 3, "x_tab_002", "", [])], "pair_id string, mapping string, item int, table_ref string, table string, value_changes array<string>")
    tables = spark.createDataFrame([("p", "m", "x_tab_001", "Tabelle 1 – b", 0), ("p", "m", "x_tab_002", "Tabelle 1 – a", 1), ("p", "m", "x_tab_003", "doppelt", 2), ("p", "m", "x_tab_004", "Doppelt", 3)], "pair_id string, mapping string, table_id string, caption string, place int")
    named = interpretation.resolve_table(items, tables)
    assert {r["item"]: r["table_id"] for r in named.collect()} == {0: "x_tab_001", 1: "x_tab_002", 2: None, 3: "x_tab_002"}
    cells = spark.createDataFrame([("p", "m", "x_tab_001", "old", "%", "5"), ("p", "m", "x_tab_001", "new", "%", "3"), ("p", "m", "x_tab_002", "new", "W", "7E+3"), ("p", "m", "x_tab_002", "new", "%", "4")], "pair_id string, mapping string, table_id string, side string, base_unit string, base_value string")
    got = {r["item"]: (r["values_checked"], r["values_found"], r["values_elsewhere"], r["values_ok"]) for r in interpretation.check_asset_values(named, cells).collect()}
    assert got == {0: (3, 1, 2, False), 1: (1, 0, 0, False), 2: (None, None, None, None), 3: (0, 0, 0, True)}
    why = spark.createDataFrame([(False, 3, 1, 2), (False, 1, 0, 0), (True, 1, 1, 0), (None, None, None, None)], "o boolean, c int, f int, e int").select(interpretation.values_reason(F.col("o"), F.col("c"), F.col("f"), F.col("e"))).collect()
    assert [r[0] for r in why] == ["values_in_other_table", "values_ok", None, None]
    quotes = spark.createDataFrame([("punkt | zeit | v",), ("punkt | nichts da",), ("zu kurz",), ("die tabelle zeigt den punkt",)], "q string").select(interpretation.asset_ok(F.col("q"), F.lit("die tabelle zeigt den punkt und die zeit"))).collect()
    assert [r[0] for r in quotes] == [True, False, False, True]


def test_answers_are_held_against_the_facts(spark):
    schema = "pair_id string, mapping string, change_ix int, kind string, old_pid string, new_pid string, moved_to string, moved_from string, modality string"
    changes = spark.createDataFrame(
        [("p", "a", 0, "moved_away", "o1", None, "n1", None, "muss"), ("p", "b", 0, "moved_in", None, "n1", None, "o1", "muss"), ("p", "a", 1, "moved_away", "o2", None, None, None, None), ("p", "a", 2, "moved_away", "o3", None, "n9", None, None), ("p", "b", 1, "moved_in", None, "n5", None, "o8", None),
         ("p", "c", 0, "new", None, "n7", None, None, "informativ")], schema)
    assert sorted(r["state"] for r in interpretation.move_pairs(changes).collect()) == ["dangling", "orphan", "paired", "unpaired"]
    said = [("p", "a", 0, "moved", "replaced", "not_applicable", "", "", False), ("p", "b", 0, "moved", "equivalent", "not_applicable", "", "", False), ("p", "c", 0, "added", "equivalent", "tightened", "gilt", "", True), ("p", "d", 0, "modified", "narrowed", "relaxed", "gilt nun in Abschnitt 5.2", "", False)]
    answers = spark.createDataFrame(said, "pair_id string, mapping string, change_ix int, structural_operation string, semantic_status string, normative_direction string, change string, impact string, reported boolean")
    flagged = interpretation.check_consistency(answers, changes).cache()
    got = {r["mapping"]: r for r in flagged.collect()}
    assert got["a"]["axis_partner_disagreement"] == ["semantic_status"] == got["b"]["axis_partner_disagreement"] and got["a"]["axis_c_contradicts_modality"]
    assert got["c"]["axis_b_contradicts_a"] and got["c"]["axis_b_reported_as_artefact"] and got["c"]["informative_with_direction"] and got["d"]["successor_named"]
    counts = interpretation.consistency_counts(flagged).first().asDict()
    assert counts == {"pair_id": "p", "n_partner_disagreement": 1, "n_axis_b_contradicts_a": 0, "n_axis_b_reported_as_artefact": 1, "n_axis_c_contradicts_modality": 2, "n_informative_with_direction": 1, "n_successor_named": 1, "n_multiple_flags": 2}
    dropped = spark.createDataFrame([({"evidence_ok": "x", "change": "y"},)], "a map<string,string>").select(interpretation.drop_owned(F.col("a")).alias("d")).first()["d"]
    assert dropped["kept"] == {"change": "y"} and dropped["dropped"] == ["evidence_ok"]


def test_audits(spark):
    removed = spark.createDataFrame([("p", "a", 0, "Dieser Satz steht noch im Kapitel eins der Regel."), ("p", "a", 1, "Dieser Satz ist in das Kapitel zwei gewandert."), ("p", "a", 2, "Dieser Satz ist nirgends mehr zu finden heute."), ("p", "a", 3, "zu kurz"), ("p", "a", 4, "Der erste Teil steht hier vorn. Der zweite Teil steht weiter hinten.")], "pair_id string, mapping string, change_ix int, text string")
    new = spark.createDataFrame([("p", 0, "1", 0, "Vorher. Dieser Satz steht  noch im Kapitel eins der Regel. Nachher."), ("p", 0, "1", 1, "Der zweite Teil steht weiter hinten. Und Der erste Teil steht hier vorn."), ("p", 1, "2", 0, "Dieser Satz ist in das Kapitel zwei gewandert.")], "pair_id string, sec_ix int, section_id string, par_ix int, text string")
    chapters = spark.createDataFrame([("p", "a", ["1"])], "pair_id string, mapping string, new_ids array<string>")
    got = {r["change_ix"]: (r["verdict"], r["section"], r["found_as"]) for r in audits.removal_audit(removed, new, chapters).collect()}
    assert got == {0: ("falsch_positiv", "1", "block"), 1: ("verschiebung", "2", "block"), 2: ("echt_entfallen", None, None), 3: ("kurzfragment", None, None), 4: ("falsch_positiv", "1", "saetze")}
    records = spark.createDataFrame([("p", "11.3<11.3+11.3.2", ["11.3"])], "pair_id string, mapping string, new_ids array<string>")
    known = spark.createDataFrame([("p", s) for s in ("11.3", "11.3.2", "11.3.2.1", "11.30")], "pair_id string, section_id string")
    circles = audits.candidate_circles(records, known)
    assert {(r["rule"], r["section"]) for r in circles.collect()} == {("A", "11.3"), ("B", "11.3"), ("B", "11.3.2"), *((x, s) for x in "CD" for s in ("11.3", "11.3.2", "11.3.2.1"))}
    cost = audits.simulate_circles(circles, spark.createDataFrame([("p", "11.3<11.3+11.3.2", 0, "11.3.2")], "pair_id string, mapping string, change_ix int, best_section string"), known.select("pair_id", F.col("section_id").alias("section"), F.lit(2).alias("n_paragraphs")))
    assert {r["rule"]: (r["resolved"], r["growth_total"]) for r in cost.collect()} == {"A": (0, 0), "B": (1, 2), "C": (1, 4), "D": (1, 4)}
    import statistics

    values = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.3]
    q = audits.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert [round(x, 9) for x in (q["least"], q["q1"], q["median"], q["q3"], q["most"])] == [1.0, *(round(x, 9) for x in statistics.quantiles(values, n=4)), 9.0]
    voices = spark.createDataFrame([("Text ist inhaltlich unverändert, nur ein Fragment, siehe Änderung [2]", "wort ohne ende")], "t string, c string").select(audits.signals(F.col("t"), F.lit(0), F.lit(False), F.array().cast("array<string>"), F.col("c"), F.lit(5)).alias("s"))
    assert voices.first()["s"] == ["fragment", "names_change", "voice_artefact", "voice_present"] and voices.select(audits.without_counterpart_group(F.col("s"))).first()[0] == "torn"
    assert audits.first_difference(b"abc", b"abd") == 2 and audits.first_difference(b"a", b"ab") == 1 and audits.first_difference(b"", b"") is None
    assert audits.structural_paths({"a": [1, {"b": 2}], "c": 3}, {"a": [1, {"b": 5}], "d": 3}) == ["$.a[1].b", "$.c", "$.d"]
    assert audits.apply_answer('{"interpretations": [{"change_index": 0}]}', [0, 1])["outcome"] == "incomplete" and audits.apply_answer("x", [])["outcome"] == "unparsable" and audits.apply_answer('{"interpretations": [{"change_index": 5}]}', [0])["outcome"] == "foreign_indices:[5]"


def test_short_forms(spark):
    c = lambda column, *rows: [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string, c string").orderBy("k").select(column).collect()]
    a, b = F.col("a"), F.col("b")
    assert c(captions.caption_text(a), ("Tabelle 11 - Einstellwerte X", "", ""), ("Tabelle 10 empfohlen.", "", ""), ("Bild A.1: ab", "", ""), ("Abbildung 3 – Netz", "", ""), (None, "", "")) == ["Einstellwerte X", None, None, "Netz", None]
    assert c(captions.is_caption_rest(a), (" – Netz", "", ""), (" empfohlen.", "", ""), (" (2 von 2)", "", ""), ("", "", "")) == [True, False, True, False]
    assert c(captions.location(a, b, F.col("c")), ("1", "1.2", "1"), ("1.2", "1.2", "1"), ("1", "1", "1"), ("", "1.3", "1"), ("", "", "1")) == ["1 → 1.2", "1.2", "", "1.3", ""]
    assert c(captions.axis_marker(a, b, F.array("c")), ("narrowed", "relaxed", "scope"), ("", "", ""), ("", "relaxed", "")) == ["[narrowed · relaxed · scope]", "", "[relaxed]"]
    assert c(captions.clip(a, 3), ("abcd", "", ""), (" abc ", "", ""), (None, "", "")) == ["abc …", "abc", ""] and c(captions.clip_counted(a, 3), ("abcde", "", "")) == ["abc … (+2)"]
    assert [tuple(x) for x in c(captions.parameter_line(a), ("Statik: 5 % → 4 %", "", ""), ("5 % -> 4 %", "", ""), ("nur Text", "", ""))] == [("Statik", "5 %", "4 %"), (None, "5 %", "4 %"), (None, "nur Text", None)]
    assert c(captions.first_names(F.split("a", ","), 2), ("x,y,z", "", ""), ("x", "", "")) == ["x, y +1 weitere", "x"]
    assert c(interpretation.successor_named(a, b), ("gilt künftig in Anhang B.3", "", ""), ("muss nun in enger Abstimmung erfolgen", "", "")) == [True, False] and c(interpretation.successor_hint(a, b), ("muss nun in enger Abstimmung", "", "")) == [True]
    assert c(interpretation.rendered_cells(F.array(F.array("a", "b"), F.array("c"))), (" x ", "y", "z")) == ["x | y ‖ z"]
    assert c(interpretation.rendered_cells(F.array_repeat(F.array("a"), 42)), ("x", "", ""))[0].endswith("x … (+2 Zeilen)")
    assert c(diff.qualifiers(a), ("Nur ggf. möglichst, in der Regel ggf.", "", "")) == [["ggf.", "in der regel", "möglichst", "nur"]]


def test_interpretation_from_frozen_answers(spark, found):
    from stemma.interpret import interpret, summaries

    none = spark.createDataFrame([], "key string, answer string")
    asked = interpret(found, none, "m", "Deutsch", "TR")
    assert {r["outcome"] for r in asked.outcomes.collect()} == {"export"} and asked.rows.count() == 0
    keys = {(r["pair_id"], r["tag"]): r["key"] for r in asked.resolved.collect()}
    answer = '{"interpretations": [{"change_index": 0, "semantic_status": "narrowed", "normative_direction": "tightened", "affected_components": ["limit_value"], "evidence": "mit einer Leistung über 30 kW", "change": "x"}]}'
    got = interpret(found, spark.createDataFrame([(keys["trx", "2_2"], answer), (keys["trx", "5_5"], answer)], "key string, answer string"), "m", "Deutsch", "TR")
    rows = {r["mapping"]: r for r in got.rows.collect()}
    assert rows["2<2"]["evidence_ok"] and rows["2<2"]["evidence_unique"] and not rows["5<5"]["evidence_ok"] and rows["5<5"]["structural_operation"] == "modified"
    assert [(r["mapping"], r["review_reasons"]) for r in got.review_queue.collect()] == [("5<5", ["evidence_ok"])]
    assert got.coverage.agg(F.sum("n_interpreted")).first()[0] == 2
    assert summaries(found).filter("pair_id = 'trx' and mapping = '<11'").first()["summary_old"].startswith("Bestehende Speicher")


def test_leftover_measures(spark, found):
    grid = {(r["threshold"], r["size"]): r["n"] for r in audits.balance_grid(found.balance).collect()}
    assert grid[0.8, 0] >= 2 and (0.8, 10) not in grid and audits.loudest(found.balance, 1).first()["old_surplus"] == 3
    snap = audits.snapshot(found.changes, found.chapters)
    assert snap.filter("pair_id = 'trx' and metric = 'changes.similar'").first()["value"] == 4
    assert audits.snapshot_drops(snap, snap.filter("metric <> 'chapters'")).filter("dropped").count() == 4
    entries = spark.createDataFrame([(["a", "b"],), (["a"],), (["a", "b"],)], "review_reasons array<string>")
    assert {(r["reasons"], r["n"]) for r in audits.review_combinations(entries).collect()} == {("a + b", 2), ("a", 1)}
    words = spark.createDataFrame([("tightened",), ("x",)], "w string").select(captions.label(F.col("w")).alias("l")).collect()
    assert [r["l"] for r in words] == ["verschärft", "x"]


def test_command_line(spark, tmp_path, capsys):
    from stemma.__main__ import main

    (tmp_path / "a.md").write_text("## 1 Zweck\n\nDer Wert darf 5 % nicht überschreiten.\n\n- gleich geblieben ist dies\n")
    (tmp_path / "b.md").write_text("## 1 Zweck\n\nDer Wert darf 2 % nicht überschreiten.\n\n- gleich geblieben ist dies\n")
    main(["compare", f"{tmp_path}/a.md", f"{tmp_path}/b.md", f"{tmp_path}/out"])
    assert capsys.readouterr().out.strip().endswith("similar: 1")
    assert "<td>5 %</td><td>2 %</td>" in (tmp_path / "out/synopsis.html").read_text() and (tmp_path / "out/manifest.json").exists() and (tmp_path / "out/tables/changes/_SUCCESS").exists()
    main(["inspect", f"{tmp_path}/b.md"])
    assert "2 %" in capsys.readouterr().out


def test_lines_of_one_place_have_one_order(spark):
    chapters = spark.createDataFrame([("p", "m", 0, "1", None)], "pair_id string, mapping string, chapter_ix int, new_id string, old_id string")
    rows = [("p", "m", 7, 0, "1", str(n), "9", "value_changed") for n in (46, 18, 100, 5, 46)]
    schema = "pair_id string, mapping string, change_ix int, k int, section string, old string, new string, value_class string"
    for some in (rows, rows[::-1], rows[2:] + rows[:2]):
        lines = reports.parameter_groups(spark.createDataFrame(some, schema).coalesce(1), chapters).orderBy("place").collect()
        assert [r["line"] for r in lines] == [f"1: {n} → 9" for n in (5, 18, 46, 46, 100)]


def test_long_quotes_match_to_their_last_letter(spark):
    hay = "abcdefghij" * 20_000
    quotes = [hay, hay + "x", hay[:150_001] + "x", "x" + hay, "abc", "abx"]
    rows = spark.createDataFrame([(k, q, hay) for k, q in enumerate(quotes)], "k int, q string, hay string")
    got = rows.select("k", interpretation.matched_chars(F.col("q"), F.col("hay")).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in got] == [200_000, 200_000, 150_001, 0, 3, 2]


def test_quotes_are_judged_once_per_text(spark, tmp_path):
    rows = [(o, 12 + p, 1) for o in range(50) for p in range(6)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert forms._quotes(spark, str(tmp_path)).count() == 6
    assert {r["form"]: (r["ok"], r["strict"], r["n"]) for r in forms.evidence_guard(spark, str(tmp_path)).collect()} == {k: (k < 4, k != 4, 50) for k in range(6)}


def test_each_text_is_looked_at_once(spark, monkeypatch):
    seen, of = [], editions._forms
    monkeypatch.setattr(editions, "_forms", lambda texts: seen.append(texts.count()) or of(texts))
    rows = [("p", e, s, "1", "t", 1, None if s == 9 else s, None if s == 9 else f"Text {s % 2}.") for e in ("old", "new") for s in range(10)]
    found = editions.enriched(spark.createDataFrame(rows, "pair_id string, edition string, sec_ix int, section_id string, title string, level int, par_ix int, n0 string")).collect()
    assert seen == [3] and sorted((r["edition"], r["sec_ix"], r["n0"] or "", r["key"]) for r in found) == sorted((r[1], r[2], r[7] or "", (r[7] or "").lower().replace(" ", "").replace(".", "")) for r in rows)


def test_groups_whose_words_decide_need_no_matrix(spark, monkeypatch):
    some = random.Random(3)
    texts = ["".join(some.choices("abcdef0123", k=96)) for _ in range(40)]
    old, new = [*texts[:30], "kurz"], [*texts[20:][::-1], "andere kurze"]
    score = kernels.cosine_matrix(old, new)
    whole = [(r, c, round(float(score[r, c]), 3)) for r, c in kernels.assign(score) if score[r, c] >= align.TAU_MOVED]
    assert len(whole) == 10
    near = [f"{texts[0]} {texts[1]} {k}" for k in range(3)]
    assert align.plain_moves(near, near[1:]) is None and align.plain_moves([texts[0]] * 2, texts[:1]) is None
    assert len(align.moved(near, near[1:])) == 2
    for module in (align, kernels):
        monkeypatch.setattr(module, "cosine_of_groups", None)
    assert sorted(align.moved(old, new)) == whole
    assert list(align.pair_residuals(dict(enumerate(texts[:20])), dict(enumerate(texts[20:])), align.TAU)) == []


def test_pairs_without_free_sections_stay_out_of_the_assignment(spark):
    schema = "pair_id string, edition string, sec_ix int, section_id string, title string, level int, part string, text string"
    rows = [(p, e, k, str(k + 1), f"titel {k}", 1, None, f"titel {k} inhalt") for p in ("a", "b") for e in ("old", "new") for k in range(3)]
    rows += [("b", "old", 3, "8", "besondere lasten", 1, None, "besondere lasten"), ("b", "new", 3, "9", "besondere lasten", 1, None, "besondere lasten"), ("a", "old", 3, "8", "allein", 1, None, "allein")]
    sections = spark.createDataFrame(rows, schema)
    found = chapters.by_similarity(sections, chapters.same_ids(sections))
    assert [(r["pair_id"], r["old_ix"], r["new_ix"]) for r in found.collect()] == [("b", 3, 3)]
