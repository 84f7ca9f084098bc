"""Queries over values, modality and references; sentences are built from real columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import modality, references, values
from stemma.plans.paragraphs import table


UNITS_USED = ("kW", "ms", "%", "kV")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per line item, in five forms; odd lines are the new edition."""
    unit = F.element_at(F.array(*map(F.lit, UNITS_USED)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    whole = F.col("l_quantity").cast("int")
    n = whole.cast("string")
    forms = F.array(
        F.concat(F.lit("Grenzwert höchstens "), n, F.lit(" "), unit, F.lit(".")), F.concat(F.lit("Es gilt ≥"), n, unit, F.lit(", sonst nichts.")), F.concat(F.lit("Der Wert von "), n, F.lit(",5 "), unit, F.lit(" gilt.")),
        F.concat(F.lit("Ab 1."), F.lpad(n, 3, "0"), F.lit(" "), unit, F.lit(" wird abgeschaltet.")), F.concat(F.lit("zwischen "), n, F.lit(" bis "), (whole + 1).cast("string"), F.lit(" "), unit),
    )
    form = (F.col("l_partkey") % 5).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "old").otherwise("new").alias("edition"), form.alias("form"), F.element_at(forms, form + 1).alias("sentence"))


def value_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _limits(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(values.extract("sentence")).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", "v.op", "v.value", "v.value2", "v.unit", "v.base_unit", F.round(F.col("v.base_value").cast("double"), 9).alias("base_value"))


def value_base_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _limits(spark, sf_dir).select(F.explode(values.extract("sentence")).alias("v")).select("v.*")
    in_base = rows.select(values.base_unit(F.col("unit")).alias("base_unit"), F.round(F.col("value").cast("double") * values.base_factor(F.col("unit")), 6).alias("x"))
    return in_base.groupBy("base_unit").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


def value_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _limits(spark, sf_dir).select("l_orderkey", "edition", F.explode(values.extract("sentence")).alias("v"))
    flat = rows.select("l_orderkey", "edition", "v.base_unit", "v.base_value", "v.base_value2", "v.op")
    old, new = (flat.filter(F.col("edition") == e).drop("edition") for e in ("old", "new"))
    found = values.difference(old, new, ["l_orderkey"])
    total = lambda c: F.round(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6)
    return found.groupBy("base_unit", "kind").agg(F.count(F.lit(1)).alias("n"), total("old_value").alias("sum_old"), total("new_value").alias("sum_new"))


def value_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def op(c):
        return F.when(c == "1-URGENT", ">=").when(c == "2-HIGH", "<=").when(c == "3-MEDIUM", "=")

    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") / 2).cast("long").alias("k"), (F.col("o_orderkey") % 2).alias("side"), op(F.col("o_orderpriority")).alias("op"), F.floor(F.col("o_totalprice") / 100000).cast("string").alias("value"))
    pairs = orders.groupBy("k").agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("op", "value")), F.countDistinct("side").alias("sides")).filter("sides = 2")
    kind = values.change_class(F.col("op0"), F.col("op1"), F.col("value0"), F.col("value1"))
    return pairs.groupBy(F.coalesce(kind, F.lit("same")).alias("value_class")).agg(F.count(F.lit(1)).alias("n"))


SUBJECTS = ("Die Anlage", "Der Netzbetreiber", "Jede Erzeugungseinheit", "Das Schutzkonzept", "Der Anschlussnehmer", "Eine Messung", "Der Nachweis")
TAILS = ("vor der Inbetriebnahme", "im laufenden Betrieb", "nach jeder Änderung", "bei 5 % Abweichung", "auf eigene Kosten")
#: What a sentence says of its subject, with the label that a reader would give it.
PHRASES = (
    ("muss {} geprüft werden", "muss"), ("ist {} zu prüfen", "muss"), ("hat {} sicherzustellen, dass es gilt", "muss"), ("ist {} erforderlich", "muss"), ("ist {} aufzubewahren", "muss"),
    ("sollte {} geprüft werden", "sollte"), ("soll {} erfolgen", "sollte"), ("darf {} nicht betrieben werden", "darf_nicht"), ("ist {} unzulässig", "darf_nicht"),
    ("darf {} betrieben werden", "darf"), ("braucht {} nicht geprüft zu werden", "darf"), ("muss {} nicht geprüft werden", "darf"), ("ist {} nicht erforderlich", "darf"),
    ("kann {} betrieben werden", "kann"), ("besteht {} aus mehreren Teilen", "informativ"), ("wird {} beschrieben", "informativ"),
)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per order from a subject, a phrase and a tail; every ninth is a note."""
    pick = lambda parts, at: F.element_at(F.array(*map(F.lit, parts)), (at + 1).cast("int"))
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    tail = pick(TAILS, F.floor(other / len(SUBJECTS)) % len(TAILS))
    body = F.concat_ws(" ", pick(SUBJECTS, other % len(SUBJECTS)), F.replace(pick([p for p, _ in PHRASES], key % len(PHRASES)), F.lit("{}"), tail))
    note = F.when(key % 9 == 0, F.lit("ANMERKUNG ")).otherwise(F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(note, body, F.lit(".")).alias("sentence"))


def modality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).select("o_orderkey", modality.label(F.col("sentence")).alias("label"), modality.deontic_class(F.col("sentence")).alias("deontic_class"))
    return rows


def modality_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).select((F.col("o_orderkey") / 2).cast("long").alias("k"), (F.col("o_orderkey") % 2).alias("side"), modality.label(F.col("sentence")).alias("label"))
    pairs = rows.groupBy("k").agg(F.max(F.when(F.col("side") == 0, F.col("label"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("label"))).alias("b")).filter("a is not null and b is not null")
    return pairs.groupBy("a", "b", modality.shift(F.col("a"), F.col("b")).alias("shift")).agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"a": "old_label", "b": "new_label"})


def modality_audit_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructions by label: how many sentences of each."""
    s = F.col("sentence")
    construction = (
        F.when(s.rlike("nicht erforderlich"), "negated_need").when(s.rlike("darf .* nicht"), "prohibition").when(s.rlike("aufzubewahren|sicherzustellen"), "synthetic")
        .when(s.rlike("muss"), "modal").when(s.rlike(r"(?U)\bist\b.*\bzu\b"), "infinitive").otherwise("other")
    )
    rows = _sentences(spark, sf_dir).select(construction.alias("construction"), modality.label(s).alias("label"))
    out = rows.groupBy("construction").pivot("label", list(modality.RANK)).agg(F.count(F.lit(1)))
    return out.na.fill(0)


def soll_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentence")
    group = F.when(s.rlike(r"(?U)\bsollten?\b"), "sollte").when(s.rlike(r"(?U)\bsoll(en)?\b"), "soll").otherwise("none")
    return _sentences(spark, sf_dir).groupBy(group.alias("form")).agg(F.count(F.lit(1)).alias("n"))


def _reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of references per part, in three forms."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    d = lambda n: (key % n).cast("string")
    forms = F.array(
        F.concat(F.lit("Siehe Abschnitt "), size, F.lit("."), d(10), F.lit(" und Tabelle "), d(7), F.lit(" sowie Anhang B."), d(3), F.lit(" nach DIN EN 6"), size, F.lit(", VDE-AR-N 41"), size, F.lit(" und EEG 2023.")),
        F.concat(F.lit("Nach Kapitel "), d(9), F.lit(" und Abschnitt "), d(9), F.lit(" gilt Bild "), size, F.lit(" (IEC 6"), size, F.lit(").")),
        F.concat(F.lit("Unterabschnitt "), size, F.lit(".2.1, Gleichung "), d(5), F.lit(" und Anhang C; ISO 9"), d(10), F.lit("1 sowie EnWG.")),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(forms, (key % 3 + 1).cast("int")).alias("text"))


def refs_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference_lines(spark, sf_dir).select("p_partkey", F.array_join(references.internal(F.col("text")), "|").alias("refs"))


def refs_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference_lines(spark, sf_dir).select("p_partkey", F.array_join(references.external(F.col("text")), "|").alias("refs"))


def refs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reference_lines(spark, sf_dir).select((F.col("p_partkey") / 2).cast("long").alias("k"), (F.col("p_partkey") % 2).alias("side"), references.internal(F.col("text")).alias("refs"))
    pairs = rows.groupBy("k").agg(*(F.max(F.when(F.col("side") == s, F.col("refs"))).alias(n) for s, n in ((0, "old"), (1, "new")))).filter("old is not null and new is not null")
    d = references.changes(F.col("old"), F.col("new"))
    return pairs.select("k", F.array_join(d["added"], "|").alias("added"), F.array_join(d["removed"], "|").alias("removed"))


def top_external_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _reference_lines(spark, sf_dir).select(F.explode(references.external(F.col("text"))).alias("ref"))
    return refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ref").limit(25)


_LIMITS = """lim AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'old' ELSE 'new' END AS edition, CAST(l_quantity AS INT) AS q, l_partkey % 5 AS form,
  ['kW', 'ms', '%', 'kV'][l_linenumber % 4 + 1] AS unit, ['W', 's', '%', 'V'][l_linenumber % 4 + 1] AS base_unit, [1000.0, 0.001, 1.0, 1000.0][l_linenumber % 4 + 1]::DOUBLE AS factor FROM lineitem),
val AS (SELECT *, CASE form WHEN 0 THEN '<=' WHEN 1 THEN '>=' END AS op, CASE form WHEN 2 THEN q || '.5' WHEN 3 THEN CAST(1000 + q AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS value, CASE WHEN form = 4 THEN CAST(q + 1 AS VARCHAR) END AS value2 FROM lim)"""
_PICK = lambda parts, at: "['" + "', '".join(parts) + f"'][{at} + 1]"
_KEY, _OTHER = f"o_orderkey % {len(PHRASES)}", f"o_custkey % {len(SUBJECTS)}"
_SENTENCE = f"CASE WHEN o_orderkey % 9 = 0 THEN 'ANMERKUNG ' ELSE '' END || {_PICK(SUBJECTS, _OTHER)} || ' ' || replace({_PICK([p for p, _ in PHRASES], _KEY)}, '{{}}', {_PICK(TAILS, f'(o_custkey // {len(SUBJECTS)}) % {len(TAILS)}')}) || '.'"
_LABEL = f"CASE WHEN o_orderkey % 9 = 0 THEN 'informativ' ELSE {_PICK([x for _, x in PHRASES], _KEY)} END"
_CLASS = "CASE {c} WHEN 'muss' THEN 'anforderung' WHEN 'sollte' THEN 'empfehlung' WHEN 'darf' THEN 'zulaessigkeit' WHEN 'darf_nicht' THEN 'verbot' WHEN 'kann' THEN 'moeglichkeit' ELSE 'informativ' END"
_RANK = "CASE {c} WHEN 'darf_nicht' THEN 5 WHEN 'muss' THEN 4 WHEN 'sollte' THEN 3 WHEN 'darf' THEN 2 WHEN 'kann' THEN 1 ELSE 0 END"
_REFS = """refs AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Siehe Abschnitt ' || p_size || '.' || (p_partkey % 10) || ' und Tabelle ' || (p_partkey % 7) || ' sowie Anhang B.' || (p_partkey % 3) || ' nach DIN EN 6' || p_size || ', VDE-AR-N 41' || p_size || ' und EEG 2023.'
  WHEN 1 THEN 'Nach Kapitel ' || (p_partkey % 9) || ' und Abschnitt ' || (p_partkey % 9) || ' gilt Bild ' || p_size || ' (IEC 6' || p_size || ').' ELSE 'Unterabschnitt ' || p_size || '.2.1, Gleichung ' || (p_partkey % 5) || ' und Anhang C; ISO 9' || (p_partkey % 10) || '1 sowie EnWG.' END AS text FROM part),
internal AS (SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(text, '(?:Abschnitt|Kapitel|Unterabschnitt)\\s+(\\d+(?:\\.\\d+)*)', 1) || regexp_extract_all(text, 'Anhang\\s+([A-Z](?:\\.\\d+)*)', 1) || regexp_extract_all(text, '((?:Tabelle|Bild|Gleichung)\\s+\\d+)', 1))) AS refs FROM refs),
external AS (SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(text, '(?:DIN\\s+EN\\s+|VDE-AR-N\\s+|IEC\\s+|ISO\\s+)[0-9][0-9\\-–:. ]*\\d|EEG\\s+\\d{4}|EnWG'))) AS refs FROM refs)"""

QUERIES = {
    "value_extract": (value_extract, f"WITH {_LIMITS} SELECT l_orderkey, l_linenumber, op, value, value2, unit, base_unit, round(CAST(value AS DOUBLE) * factor, 9) AS base_value FROM val"),
    "value_base_units": (value_base_units, f"WITH {_LIMITS} SELECT base_unit, count(*) AS n, min(round(CAST(value AS DOUBLE) * factor, 6)) AS least, max(round(CAST(value AS DOUBLE) * factor, 6)) AS most FROM val GROUP BY base_unit"),
    "value_diff": (
        value_diff,
        f"""WITH {_LIMITS},
b AS (SELECT l_orderkey, edition, base_unit, coalesce(op, '') AS op, coalesce(value2, '') AS v2, value, CAST(value AS DOUBLE) * factor AS x FROM val),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, edition, base_unit, value, v2, op) AS nth FROM b),
r AS (SELECT l_orderkey, base_unit, value, v2, op, nth, max(edition) AS edition, max(x) AS x FROM n GROUP BY ALL HAVING count(*) = 1),
u AS (SELECT l_orderkey, base_unit, count(*) FILTER (edition = 'old') AS o, count(*) FILTER (edition = 'new') AS w, coalesce(sum(x) FILTER (edition = 'old'), 0) AS so, coalesce(sum(x) FILTER (edition = 'new'), 0) AS sw FROM r GROUP BY ALL),
k AS (SELECT base_unit, 'changed' AS kind, 1 AS n, so, sw FROM u WHERE o = 1 AND w = 1
  UNION ALL SELECT base_unit, 'removed', o, so, 0 FROM u WHERE NOT (o = 1 AND w = 1) AND o > 0
  UNION ALL SELECT base_unit, 'added', w, 0, sw FROM u WHERE NOT (o = 1 AND w = 1) AND w > 0)
SELECT base_unit, kind, CAST(sum(n) AS BIGINT) AS n, round(sum(so), 6) AS sum_old, round(sum(sw), 6) AS sum_new FROM k GROUP BY ALL""",
    ),
    "value_class_counts": (
        value_class_counts,
        """WITH o AS (SELECT o_orderkey // 2 AS k, o_orderkey % 2 AS side, CASE o_orderpriority WHEN '1-URGENT' THEN '>=' WHEN '2-HIGH' THEN '<=' WHEN '3-MEDIUM' THEN '=' END AS op, CAST(floor(o_totalprice / 100000) AS BIGINT) AS v FROM orders),
p AS (SELECT a.op AS a, b.op AS b, a.v AS va, b.v AS vb FROM o AS a JOIN o AS b ON a.k = b.k AND a.side = 0 AND b.side = 1)
SELECT CASE WHEN va <> vb THEN 'value_changed' WHEN a IS NULL AND b IS NOT NULL THEN 'operator_added' WHEN a IS NOT NULL AND b IS NULL THEN 'operator_removed' WHEN a <> b THEN 'operator_changed' ELSE 'same' END AS value_class, count(*) AS n FROM p GROUP BY 1""",
    ),
    "modality_labels": (modality_labels, f"WITH l AS (SELECT o_orderkey, {_LABEL} AS label FROM orders) SELECT o_orderkey, label, {_CLASS.format(c='label')} AS deontic_class FROM l"),
    "modality_shift": (
        modality_shift,
        f"""WITH l AS (SELECT o_orderkey // 2 AS k, o_orderkey % 2 AS side, {_LABEL} AS label FROM orders),
p AS (SELECT a.label AS a, b.label AS b FROM l AS a JOIN l AS b ON a.k = b.k AND a.side = 0 AND b.side = 1)
SELECT a AS old_label, b AS new_label, CASE WHEN replace(a, 'kann', 'darf') = replace(b, 'kann', 'darf') THEN 'unveraendert' WHEN {_RANK.format(c='b')} > {_RANK.format(c='a')} THEN 'verschaerft' ELSE 'gelockert' END AS shift, count(*) AS n FROM p GROUP BY ALL""",
    ),
    "modality_audit_pivot": (
        modality_audit_pivot,
        f"""WITH c AS (SELECT {_LABEL} AS label, {_SENTENCE} AS sentence FROM orders),
k AS (SELECT label, CASE WHEN contains(sentence, 'nicht erforderlich') THEN 'negated_need' WHEN regexp_matches(sentence, 'darf .* nicht') THEN 'prohibition' WHEN regexp_matches(sentence, 'aufzubewahren|sicherzustellen') THEN 'synthetic' WHEN contains(sentence, 'muss') THEN 'modal' WHEN regexp_matches(sentence, '\\bist\\b.*\\bzu\\b') THEN 'infinitive' ELSE 'other' END AS construction FROM c)
SELECT construction, """ + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in modality.RANK) + " FROM k GROUP BY construction",
    ),
    "soll_census": (soll_census, f"WITH s AS (SELECT {_SENTENCE} AS s FROM orders) SELECT CASE WHEN contains(s, 'sollte') THEN 'sollte' WHEN regexp_matches(s, '\\bsoll(en)?\\b') THEN 'soll' ELSE 'none' END AS form, count(*) AS n FROM s GROUP BY 1"),
    "refs_internal": (refs_internal, f"WITH {_REFS} SELECT p_partkey, array_to_string(refs, '|') AS refs FROM internal"),
    "refs_external": (refs_external, f"WITH {_REFS} SELECT p_partkey, array_to_string(refs, '|') AS refs FROM external"),
    "refs_diff": (
        refs_diff,
        f"""WITH {_REFS}
SELECT a.p_partkey // 2 AS k, array_to_string(list_sort(list_filter(b.refs, lambda x: NOT list_contains(a.refs, x))), '|') AS added, array_to_string(list_sort(list_filter(a.refs, lambda x: NOT list_contains(b.refs, x))), '|') AS removed
FROM internal AS a JOIN internal AS b ON a.p_partkey // 2 = b.p_partkey // 2 AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1""",
    ),
    "top_external_refs": (top_external_refs, f"WITH {_REFS}, e AS (SELECT unnest(refs) AS ref FROM external) SELECT ref, count(*) AS n FROM e GROUP BY ref ORDER BY n DESC, ref LIMIT 25"),
}
