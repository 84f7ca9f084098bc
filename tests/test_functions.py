"""Golden cases of the text functions and brute-force checks of the kernels."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import modality, references, text, values
from stemma.operators import align, chapters, joins, kernels, review


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("form", "given", "want"),
    [
        (text.n1, "DIN EN 60909‑0", "DIN EN 60909-0"),
        (text.n1, "Wort- fortsetzung", "Wortfortsetzung"),
        (text.n1, "Erzeugungs- und Speichereinheit", "Erzeugungs- und Speichereinheit"),
        (text.n1, "eﬃzient", "effizient"),
        (text.n1, None, ""),
        (text.n2, " a –  b ", "a - b"),
        (text.n3, "50-Hz-Netz", "50hznetz"),
        (text.n3, "Wert 1.234,56 kV", "wert 1234 56 kv"),
        (text.compare_key, "5,0 %", "50%"),
        (text.compare_key, "„Größe“ ≤ 3", "größe≤3"),
    ],
)
def test_normal_forms(spark, form, given, want):
    assert one(spark, form, given) == want


def test_compare_key_is_the_filter_of_n3(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choice("aÄß19,.-– „“()\n%≤ﬁ") for _ in range(25)),) for _ in range(200)]
    frame = spark.createDataFrame(rows, "t string")
    slow = F.regexp_replace(text.n3(F.col("t")), f"[^{text.KEY_CHARS}]", "")
    assert frame.filter(slow != text.compare_key(F.col("t"))).count() == 0


def test_sentences_rejoin_after_abbreviations(spark):
    assert one(spark, text.sentences, "Es gilt bzw. Abschnitt 5. Dann folgt mehr. Ende! Ja") == ["Es gilt bzw. Abschnitt 5. Dann folgt mehr.", "Ende!", "Ja"]
    assert one(spark, text.sentences, "") == []


@pytest.mark.parametrize(
    ("sentence", "label"),
    [
        ("Die Messung ist jährlich zu kalibrieren.", "muss"),
        ("Die Unterlagen sind zehn Jahre aufzubewahren.", "muss"),
        ("Der Betreiber hat dies sicherzustellen.", "muss"),
        ("Der Zugang muss gesichert sein.", "muss"),
        ("Der Zugang sollte gesichert sein.", "sollte"),
        ("Der Wert darf 5 % nicht überschreiten.", "darf_nicht"),
        ("Anlagen dürfen weiterbetrieben werden.", "darf"),
        ("Es ist zulässig, die Werte zu erfassen.", "darf"),
        ("Ein Nachweis ist nicht erforderlich.", "darf"),
        ("Ein Nachweis ist nicht erforderlich; die Werte sind jedoch aufzubewahren.", "muss"),
        ("ANMERKUNG Die Messung muss erfolgen.", "informativ"),
        ("Das richtet sich nach den Angaben des Herstellers.", "informativ"),
        ("Der Betreiber kann messen.", "kann"),
        ("", "informativ"),
    ],
)
def test_modality(spark, sentence, label):
    assert one(spark, modality.label, sentence) == label


def test_deontic(spark):
    got = one(spark, modality.deontic, "Ein Nachweis ist nicht erforderlich.")
    assert got.asDict() == {"label": "darf", "type": "pflicht", "polarity": "negativ", "class": "zulaessigkeit"}
    assert one(spark, modality.deontic, "Der Wert darf 5 % nicht überschreiten.").asDict() == {"label": "darf_nicht", "type": "erlaubnis", "polarity": "negativ", "class": "verbot"}
    assert one(spark, modality.deontic, "Anlagen dürfen betrieben werden.")["type"] == "erlaubnis" and one(spark, modality.deontic, None)["class"] == "informativ"
    labels = spark.createDataFrame([(["muss", "darf", "muss"],), ([],)], "l array<string>").select(modality.paragraph_labels(F.col("l")).alias("p"), modality.is_normative(modality.strongest(F.col("l"))).alias("n")).collect()
    assert labels[0]["p"].asDict() == {"max": "muss", "counts": {"darf": 1, "muss": 2}} and labels[0]["n"] and labels[1]["p"]["max"] == "informativ" and not labels[1]["n"]


def test_shift(spark):
    pairs = [("muss", "darf", "gelockert"), ("sollte", "muss", "verschaerft"), ("kann", "darf", "unveraendert"), ("informativ", "informativ", "unveraendert")]
    got = spark.createDataFrame(pairs, "a string, b string, w string").filter(modality.shift(F.col("a"), F.col("b")) != F.col("w"))
    assert got.count() == 0


def test_references(spark):
    assert one(spark, references.internal, "Siehe Abschnitt 10.2.2.4 und Bild 5 sowie Tabelle 13.") == ["10.2.2.4", "Bild 5", "Tabelle 13"]
    assert one(spark, references.external, "Nach DIN EN 12345 (VDE 0999-1) und VDE-AR-N 9999.") == ["DIN EN 12345", "VDE 0999-1", "VDE-AR-N 9999"]


def test_values():
    assert [v["raw"] for v in values.parse("Die Statik beträgt 5 % bei 50,2 Hz.")] == ["5 %", "50,2 Hz"]
    assert values.parse("100 ms")[0]["base_value"] == "0.1" and values.parse("100 ms")[0]["base_unit"] == "s"
    assert values.parse("1.234,5 kW")[0]["value"] == "1234.5" and values.parse("950 kW")[0]["base_value"] == "9.5E+5"
    assert values.parse("höchstens 3 bis 5 kV")[0]["op"] == "<=" and values.parse("3 bis 5 kV")[0]["value2"] == "5"
    assert values.parse("1 000 ms")[0]["value"] == "1000" and values.parse(None) == []
    assert values.parse("1.234 kW")[0]["value"] == "1234" and values.parse("1.23 kW")[0]["value"] == "1.23" and values.parse("0,50 kV")[0]["base_value"] == "5E+2"
    assert values.parse("2,5 x 10 3 m") == [] or values.parse("2·103 m")[0]["base_unit"] == "m"
    assert [v["base_value"] for v in values.parse("3 mΩ 5 Ohm 7 µF 1 cm 4 pu")] == ["0.003", "5", "0.000007", "1", "4"]
    assert values.number("1.23,4") is None and values.number("-5,25") == values.Decimal("-5.25")
    assert [(v["value"], v["unit"]) for v in values.parse_cell("≥ 0,06 und 5 kW, 1,10")] == [("5", "kW"), ("0.06", None), ("1.10", None)]
    assert values.parse_cell("≤ 500,5 kW 3") == values.parse("≤ 500,5 kW 3")


def test_values_in_columns(spark):
    texts = ["höchstens 5 % bei 50,2 Hz", "nichts", None, "3 bis 5 kV", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: [{n: x for n, x in v.asDict().items() if x is not None or n not in ("value2", "base_value2")} for v in r["v"]] for r in rows.select("k", values.extract("t").alias("v")).collect()}
    assert got == {k: values.parse(t) for k, t in enumerate(texts)}
    cells = spark.createDataFrame([("t", 0, 0, "c"), ("t", 0, 1, "1,10"), ("t", 1, 1, "≥ 2 kW")], "table_id string, row int, col int, text string")
    assert {(r["row"], r["col"]) for r in values.cell_values(cells, ["table_id"], F.col("text")).collect()} == {(0, 1), (1, 1)}


def test_value_changes_equal_the_relational_form(spark):
    rnd = random.Random(9)
    units = ["kW", "W", "%", "ms"]
    text = lambda: " ".join(f"{rnd.choice(['', 'höchstens ', '≥ '])}{rnd.randrange(3)} {rnd.choice(units)}" for _ in range(rnd.randrange(5)))
    rows = spark.createDataFrame([(k, text(), text()) for k in range(60)], "k int, a string, b string").withColumns({"va": values.extract("a"), "vb": values.extract("b")}).cache()
    rows.count()
    d = rows.select("k", values.changes(F.col("va"), F.col("vb")).alias("d"))
    got = sorted((r["k"], c["unit"], "changed", c["old"]["base_value"], c["new"]["base_value"]) for r in d.collect() for c in r["d"]["changed"])
    flat = lambda c: rows.select("k", F.explode(c).alias("v")).select("k", "v.base_unit", "v.base_value", "v.base_value2", "v.op")
    want = values.difference(flat("va"), flat("vb"), ["k"]).collect()
    assert got == sorted((r["k"], r["base_unit"], "changed", r["old_value"], r["new_value"]) for r in want if r["kind"] == "changed")
    assert sum(len(r["d"]["added"]) for r in d.collect()) == sum(r["kind"] == "added" for r in want)
    assert sum(len(r["d"]["removed"]) for r in d.collect()) == sum(r["kind"] == "removed" for r in want)


def test_value_difference(spark):
    schema = "d long, base_unit string, base_value string, base_value2 string, op string"
    old = spark.createDataFrame([(1, "s", "0.1", None, None), (1, "s", "5", None, None), (1, "V", "1", None, None), (2, "W", "7", None, "<=")], schema)
    new = spark.createDataFrame([(1, "s", "0.2", None, None), (1, "s", "5", None, None), (1, "V", "2", None, None), (1, "V", "3", None, None), (2, "W", "7", None, ">=")], schema)
    got = {tuple(r) for r in values.difference(old, new, ["d"]).collect()}
    assert got == {(1, "s", "changed", "0.1", "0.2"), (1, "V", "removed", "1", None), (1, "V", "added", None, "2"), (1, "V", "added", None, "3"), (2, "W", "changed", "7", "7")}


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        score = rng.integers(0, 5, (n, m)) / 4
        got = kernels.assign(score)
        assert len(got) == min(n, m) == len({r for r, _ in got}) == len({c for _, c in got})
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(score[(i, j) if n <= m else (j, i)] for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
        assert abs(sum(score[p] for p in got) - best) < 1e-9
    assert kernels.assign(np.zeros((0, 3))) == []


def test_greedy_ties_take_the_larger_index():
    assert kernels.greedy(np.array([[0.9, 0.9], [0.9, 0.2]]), 0.5) == [(1, 0), (0, 1)]


def test_diff_accounts_for_every_character():
    d = kernels.syntactic_diff("Grenzwert 100 ms gilt.", "Grenzwert 200 ms gilt nun.")
    assert "".join(s for k, s in d["ops"] if k in "=-") == "Grenzwert 100 ms gilt." and "".join(s for k, s in d["ops"] if k in "=+") == "Grenzwert 200 ms gilt nun."
    assert d["chars_deleted"] == 3 and kernels.syntactic_diff("", "")["change_ratio"] == 0.0


P = lambda t: (t, "".join(c for c in t.lower() if c.isalnum()))
SENTENCES = {
    "a": "alpha der betreiber prüft die einstellwerte vor der ersten inbetriebnahme", "b": "beta die vorgabe erfolgt für jede erzeugungseinheit gesondert und dauerhaft",
    "c": "gamma der nachweis wird mit dem prüfbericht der messstelle geführt", "d": "delta eine völlig neue regel zum speicher ohne vorgänger",
}
S = SENTENCES
#: Chapters as (old texts, new texts) with the links that are wanted of them.
CHAPTERS = {
    "plain": (
        ["gleicher satz", "der grenzwert beträgt fünf prozent im netz", "alte angabe die entfällt ganz und gar ohne ersatz"], ["gleicher satz", "der grenzwert beträgt zwei prozent im netz", "völlig neue regel zum speicher"],
        {("identical", (0,), (0,)), ("similar", (1,), (1,)), ("removed", (2,), ()), ("new", (), (2,))},
    ),
    "ranks": (["x y", "x y", "x y"], ["x y", "x y"], {("identical", (0,), (0,)), ("identical", (1,), (1,)), ("removed", (2,), ())}),
    "absorbed": ([S["a"], S["b"]], [S["a"] + " und " + S["b"]], {("merged", (0, 1), (0,))}),
    "split": ([S["a"] + " " + S["b"]], [S["a"], S["b"]], {("split", (0,), (0, 1))}),
    "one_more_half": ([S["a"] + " " + S["b"] + " " + S["c"]], [S["a"] + " " + S["b"], S["c"], S["c"] + "x"], {("split", (0,), (0, 1)), ("new", (), (2,))}),
    "short_part": ([S["a"] + " beta kurz"], [S["a"], "beta kurz"], {("similar", (0,), (0,)), ("new", (), (1,))}),
    "only_new": ([], ["neu hier", ""], {("new", (), (0,)), ("new", (), (1,))}),
}


@pytest.fixture(scope="module")
def links(spark):
    rows = [(name, e, 10 * k, *P(t)) for name, sides in CHAPTERS.items() for e, texts in zip(("old", "new"), sides) for k, t in enumerate(texts)]
    found = align.align_paragraphs(spark.createDataFrame(rows, "chapter string, edition string, par_ix int, text string, key string"), ["chapter"])
    return [r.asDict() for r in align.link_order(found, ["chapter"]).collect()]


@pytest.mark.parametrize("name", sorted(CHAPTERS))
def test_alignment_passes(links, name):
    got = {(x["kind"], tuple(k // 10 for k in x["old"]), tuple(k // 10 for k in x["new"])) for x in links if x["chapter"] == name}
    assert got == CHAPTERS[name][2]
    places = [x for x in sorted((x for x in links if x["chapter"] == name), key=lambda x: x["place"])]
    assert [bool(x["new"]) for x in places] == sorted((bool(x["new"]) for x in places), reverse=True)


def test_every_paragraph_stands_in_one_link(links):
    for name, sides in CHAPTERS.items():
        for e, texts in zip(("old", "new"), sides):
            assert sorted(k // 10 for x in links if x["chapter"] == name for k in x[e]) == list(range(len(texts)))


def test_settle_takes_the_best_free_proposals():
    free_old, free_new = {0, 1, 2}, {0, 1, 2}
    taken = align.settle([(0.9, (0,), (0, 1)), (0.9, (1,), (1, 2)), (0.7, (0,), (0,)), (0.6, (2,), (1,))], free_old, free_new)
    assert taken == [(0.9, (1,), (1, 2)), (0.7, (0,), (0,))] and free_old == {2} and free_new == set()
    assert align.runs({0, 1, 2, 4}) == [(0, 1), (1, 2), (0, 1, 2)]


def test_moves_need_length_and_more_likeness_when_short():
    long = "der nachweis der anlage ist durch den betreiber vor jeder änderung des schutzes zu führen und aufzubewahren"
    short = "die anlage ist jährlich durch eine person zu prüfen"
    assert align.moved([long, short, "kurz"], ["kurz", short, long]) == [(0, 2, 1.0), (1, 1, 1.0)]
    assert align.moved([short], [short.replace("jährlich", "monatlich")]) == []


def test_chapters_map_by_id_content_gap_and_ancestor(spark):
    s = lambda e, k, i, t, x, level=1, part="hauptteil": ("p", e, k, i, level, part, t.title(), t, f"{t} {x}".strip())
    rows = [
        s("old", 0, "vorspann.vorwort", "vorwort", "", part="vorspann"), s("old", 1, "1", "zweck", "a b c"), s("old", 2, "2", "schutz der anlage", "relais und anregung im netz"), s("old", 3, "3", "messung der leistung", "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"),
        s("old", 4, "5", "ende", "z"), s("old", 5, "5.1", "rest", "", 2), s("old", 6, "6", "allgemeines", "u"), s("old", 7, "7", "weg", "nichts davon"),
        s("new", 0, "1", "zweck", "a b c"), s("new", 1, "4", "schutz der anlagen", "relais und anregung im netz"), s("new", 2, "4.1", "speicher", "neu", 2), s("new", 3, "8", "messung im netz", "ganz anders hier steht ein langer text über speicher und kabel"),
        s("new", 4, "5", "ende", "z"), s("new", 5, "6", "anforderungen", "v w"), s("new", 6, "9", "völlig neu", "xx"),
    ]
    got = chapters.map_sections(spark.createDataFrame(rows, "pair_id string, edition string, sec_ix int, section_id string, level int, part string, n_title string, title string, text string")).collect()
    kinds = {(r["mapping"], r["match_type"], r["restructured"]) for r in got}
    assert kinds == {("1<1", "id+title", None), ("4+4.1<2", "title", "split_down"), ("8<3", "sequence", None), ("5<5+5.1", "id+title", "merge_up"), ("6<6", "id+title", None), ("<7", "removed", None), ("9<", "new", None)}
    assert not any(0 in r["old_ixs"] for r in got)


def test_title_similarity():
    assert kernels.title_similarity("", "") == 0.0 == kernels.title_similarity("a", "") and kernels.title_similarity("schutz", "schutz") == 1.0
    assert kernels.title_similarity("schutz der anlage", "schutz der anlagen") > 0.55 > kernels.title_similarity("schutz", "messung")


def test_tokens_split_at_every_delimiter():
    assert kernels.tokens('kW/kVA "neu"') == ["kW", "/", "kVA", " ", '"', "neu", '"']
    assert "".join(kernels.tokens(t := "a–b „c“ d'e  f;g")) == t


def plain_cosine(old, new):
    """The definition, term by term."""
    from collections import Counter

    def part(terms_of):
        rows = [Counter(terms_of(t)) for t in [*old, *new]]
        df = Counter(w for r in rows for w in r)
        weigh = [{w: c * (np.log((1 + len(rows)) / (1 + df[w])) + 1) for w, c in r.items()} for r in rows]
        norm = [np.sqrt(sum(x * x for x in w.values())) or 1.0 for w in weigh]
        return np.array([[sum(x * weigh[len(old) + j].get(w, 0) for w, x in weigh[i].items()) / norm[i] / norm[len(old) + j] for j in range(len(new))] for i in range(len(old))])

    chars = lambda t: [f" {t} "[i : i + n] for n in (3, 4) for i in range(len(t) + 3 - n)]
    return np.clip(0.6 * part(str.split) + 0.4 * part(chars), 0, 1)


def test_cosine_matrix_equals_its_definition(monkeypatch):
    rnd = random.Random(3)
    texts = ["", "ä", "a b", *(" ".join(rnd.choice(["der", "netz", "über", "\U0001F600x", "a"]) for _ in range(rnd.randrange(9))) for _ in range(30))]
    for limit in (64, 0, 10**9):
        monkeypatch.setattr(kernels, "RARE_PAIRS", limit)
        assert np.abs(kernels.cosine_matrix(texts[:15], texts[15:]) - plain_cosine(texts[:15], texts[15:])).max() < 1e-9
    assert kernels.cosine_matrix([], ["a"]).shape == (0, 1)


def test_grams_of_a_large_alphabet():
    signs = "".join(map(chr, range(0x4E00, 0x4E00 + 18_000)))
    texts = [signs[:9_000], signs[9_000:], signs[4_000:12_000] + signs[:90], "ab"]
    assert np.abs(kernels.cosine_matrix(texts[:2], texts[2:]) - plain_cosine(texts[:2], texts[2:])).max() < 1e-9


def test_cosines_of_groups_from_a_least_one_on():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["der", "netz", "über", "anlage", "teil", "x"]) for _ in range(rnd.randrange(9))) for _ in range(12)]
    old, new = [(k,) for k in range(6)], align.runs(set(range(6, 12)))
    plain = plain_cosine(*([" ".join(texts[k] for k in g) for g in groups] for groups in (old, new)))
    for least in (0.0, 0.62, 0.8, 0.95, 1.01):
        got = kernels.cosine_of_groups(texts, kernels.word_numbers(texts), old, new, least)
        assert ((np.abs(got - plain) < 1e-9) | ((got == 0) & (plain < least))).all()


def test_windows_compare_characters_only_where_words_allow_it(monkeypatch):
    compared = []
    plain = kernels._char_terms
    monkeypatch.setattr(kernels, "_char_terms", lambda texts: compared.append(len(texts)) or plain(texts))
    old, new = ({k: f"{side}{k} wort{side}{k} satz{side}{k}" for k in range(20)} for side in "ab")
    assert list(align.pair_residuals(old, new, align.TAU)) == [] and compared == [40]
    halves = [" ".join(f"{word}{k}" for k in range(40)) for word in ("netz", "anlage")]
    old[20], new[20], new[21] = " ".join(halves), *halves
    assert [x[:3] for x in align.pair_residuals(old, new, 0.9)] == [([20], [20, 21], "split")]


def test_numbers_are_sought_where_there_may_be_some(spark):
    odd = ["1.234,56 kV", "1.234", "12,5 und 1.234.567,8", "١.٢٣٤", "a.5", "", ". 5", "3.4.5", "x", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    assert rows.filter(~text.canon_numbers(F.col("t")).eqNullSafe(text._canon_numbers(F.col("t")))).count() == 0


def test_classes_of_signs_cover_all_signs(spark):
    signs = spark.range(1, 0x30000).filter("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')").alias("t"))
    lower = F.lower(text._ligatures(F.col("t")))
    damaged = F.regexp_replace("t", f"[^{text.GOOD}]+", "…") != F.regexp_replace("t", text.DAMAGE, "…")
    other = F.regexp_replace(lower, f"[^{text.KEY_CHARS}]+", "") != text.compare_key(F.col("t"))
    assert signs.count() == 0x30000 - 1 - 2048 and signs.filter(damaged | other).count() == 0


def test_long_parts_are_looked_up_by_few_grams_within_a_group(spark):
    rows = spark.createDataFrame([("x", "abcdefgh"), ("x", "".join(f"{k:05d}" for k in range(999)))], "g string, key string")
    got = rows.select(joins._spread_grams(F.col("key"), ["g"]).alias("few"), joins._grams(F.col("key"), ["g"]).alias("all")).collect()
    assert [len(r["few"]) for r in got] == [1, joins.SPREAD] and all(set(r["few"]) <= set(r["all"]) for r in got)


def test_containment_equals_all_pairs(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("ab1") for _ in range(n))
    hosts = [(g, k, word(60)) for g in ("x", "y") for k in range(15)]
    parts = [(g, k, rnd.choice(hosts)[2][(at := rnd.randrange(40)) : at + rnd.choice([7, 8, 12, 20])]) for g in ("x", "y") for k in range(40)] + [("x", 99, hosts[3][2])]
    frame = lambda rows: spark.createDataFrame(rows, "g string, id int, key string")
    for strict in (True, False):
        got = {tuple(r) for r in joins.containing(frame(parts), frame(hosts), 8, strict, ["g"]).collect()}
        assert got == {(g, i, j) for g, i, p in parts for h, j, t in hosts if g == h and len(p) >= 8 and p in t and not (strict and p == t)}


def test_sentences_pair_in_the_order_of_the_new_text():
    assert kernels.pair_sentences(["a b c", "x y z", "q"], ["a b c", "neu ganz", "x y zz"]) == [(0, 0), (None, 1), (1, 2), (2, None)]
    assert kernels.pair_sentences([], ["a"]) == [(None, 0)] and kernels.pair_sentences(["a"], []) == [(0, None)]
    assert kernels.rows_changed(["a", "b", "c"], ["a", "x", "c", "d"]) == 2


def test_cosine_twins_agree(spark):
    texts = ["a b c d", "a b x", "q r", "a a b"], ["a b c", "r r q", "z"]
    frames = [spark.createDataFrame([(i, t.split()) for i, t in enumerate(side)], "id long, terms array<string>") for side in texts]
    got = {(r["old_id"], r["new_id"]): r["score"] for r in joins.tfidf_cosine(*frames).collect()}
    from collections import Counter

    rows = [Counter(t.split()) for side in texts for t in side]
    df = Counter(w for r in rows for w in r)
    weigh = [{w: c * (np.log((1 + len(rows)) / (1 + df[w])) + 1) for w, c in r.items()} for r in rows]
    for i in range(4):
        for j in range(3):
            a, b = weigh[i], weigh[4 + j]
            want = sum(a[w] * b.get(w, 0) for w in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            assert abs(got.get((i, j), 0) - want) < 1e-9


def test_review_order(spark):
    answers = spark.createDataFrame([(1, 0, 2, "late"), (1, 0, 1, "early"), (1, 3, 1, "x")], "chapter int, change_index int, block int, answer string")
    got = {(r["change_index"], r["answer"], r["collisions"]) for r in review.merge_answers(answers).collect()}
    assert got == {(0, "early", 1), (3, "x", 0)}


def test_shown_operations():
    from stemma.operators import diff

    assert diff.shown([("=", "Der "), ("-", "50-Hz"), ("+", "50 Hz"), ("=", " Wert")]) == ([("=", "Der 50 Hz Wert")], False)
    assert diff.shown([("=", "Wert "), ("-", "5"), ("+", "2"), ("=", " %")]) == ([("=", "Wert 2 %")], False)
    assert diff.shown([("-", "alt"), ("+", "neu")]) == ([("-", "alt"), ("+", "neu")], True)
    assert diff.shown([("=", "a"), ("+", " und mehr davon im ganzen Netz")])[1]
    assert diff.shown([]) == ([], False)
    assert diff.is_substantive("5 %") and not diff.is_substantive("x1") and not diff.is_substantive(" ; ")


def test_sentence_shift_is_the_strongest(spark):
    from stemma.operators import diff

    rows = [(1, 0, "Es kann sein.", "Es sollte sein."), (1, 1, "Es kann sein.", "Es muss sein."), (1, 2, None, "Es darf nicht sein."), (2, 0, "Es gilt.", "Es gilt.")]
    got = diff.sentence_shifts(spark.createDataFrame(rows, "c int, sent_ix int, old_sentence string, new_sentence string"), ["c"])
    assert [tuple(r) for r in got.collect()] == [(1, "verschaerft", 3)]
