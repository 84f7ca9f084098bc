"""Queries over short forms of text: captions, places, clips, keys, diffs of one word, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import captions, text, values
from stemma.operators import diff, interpretation
from stemma.plans.paragraphs import table


def _pick(parts: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, parts)), (at + 1).cast("int"))


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    forms = F.array(
        F.concat(F.lit("Tabelle "), key, F.lit(" – "), "p_name"), F.concat(F.lit("Bild A."), key, F.lit(": "), "p_name"), F.concat(F.lit("Tabelle "), key, F.lit(" empfohlen.")), F.concat(F.lit("siehe "), "p_name"), F.concat(F.lit("Abbildung "), key, F.lit(" - x"))
    )
    rests = F.array(F.concat(F.lit(" – "), "p_name"), F.concat(F.lit(": "), "p_name"), F.lit(" empfohlen."), F.lit(" (2 von 2)"), F.lit(""))
    at = (F.col("p_partkey") % 5 + 1).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(forms, at).alias("caption"), F.element_at(rests, at).alias("rest"))


def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _captions(spark, sf_dir)
    return rows.select("p_partkey", captions.caption_text(F.col("caption")).alias("description"), captions.is_caption_rest(F.col("rest")).alias("is_caption"))


def change_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.when(F.col(c) % 4 != 0, F.concat(F.lit("1."), (F.col(c) % 4).cast("string"))).otherwise("")
    rows = table(spark, sf_dir, "lineitem").select(name("l_partkey").alias("a"), name("l_suppkey").alias("b"), F.concat(F.lit("1."), (F.col("l_linenumber") % 4).cast("string")).alias("h"))
    return rows.groupBy(captions.location(F.col("a"), F.col("b"), F.col("h")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


def axis_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, direction = _pick(("narrowed", "", "extended"), F.col("event_id") % 3), _pick(("relaxed", ""), F.col("user_id") % 2)
    parts = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("scope"), F.col("event_type")))
    marker = captions.axis_marker(status, direction, parts)
    return table(spark, sf_dir, "events").groupBy(marker.alias("marker")).agg(F.count(F.lit(1)).alias("n"))


def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(captions.clip(F.col("text"), 160).cast("binary")).alias("clip_md5"), F.md5(captions.clip_counted(F.col("text"), 900).cast("binary")).alias("counted_md5"))


def parameter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(("{n}: {a} → {b}", "{a} -> {b}", "{n} entfällt"), F.col("p_partkey") % 3).alias("f"), "p_name", F.col("p_size").cast("string").alias("a"), F.col("p_partkey").cast("string").alias("b"))
    line = F.replace(F.replace(F.replace("f", F.lit("{n}"), F.col("p_name")), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b"))
    rows = rows.select("p_partkey", captions.parameter_line(line).alias("p"), captions.change_sides(line).alias("s"))
    return rows.select("p_partkey", F.col("p.name").alias("name"), F.col("p.old").alias("old"), F.col("p.new").alias("new"), F.col("s.new").alias("side_new"))


def first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", captions.first_names(F.col("names"), 3).alias("note"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(captions.extractive_summary(F.split("text", "\n")).cast("binary")).alias("summary_md5"))


def normal_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of numbers in sentences: thousands by dots, decimals by comma, hyphenated words."""
    n = F.floor(F.col("l_extendedprice")).cast("long")
    rest = F.lpad((F.round(F.col("l_quantity")) % 100).cast("int").cast("string"), 2, "0")
    grouped = F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string"))
    sentence = F.concat(F.lit("Das 50-Hz-Netz („alt“) hat "), grouped, F.lit(","), rest, F.lit(" kV!"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.n3(sentence).alias("n3"), text.canon_numbers(F.concat(grouped, F.lit(","), rest)).alias("number"))
    return rows


def one_word_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token diffs of sentences that differ in one place, with what is shown of them."""
    word = lambda c: F.concat(F.lit("wort"), (F.col(c) % 7).cast("string"))
    old, new = (F.concat(F.lit("Der Betreiber prüft/misst "), word(c), F.lit(" (jährlich).")) for c in ("l_partkey", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(old.alias("a"), new.alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("a", "b", "n", diff.change_of(F.col("a"), F.col("b")).alias("d")).select("a", "b", "n", "d.chars_inserted", "d.chars_deleted", "d.chars_equal", "d.change_ratio", "d.substantive", F.size("d.ops").alias("n_ops"))


def cell_and_formula_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    cells = F.array(F.array(F.col("p_brand"), F.col("p_type")), F.array(F.col("p_size").cast("string")))
    return parts.select(
        "p_partkey", diff.cell_key(F.concat(F.lit(" "), "p_type", F.lit(" X."))).alias("cell"), diff.formula_key(F.lit(""), F.concat("p_brand", F.lit(" = "), F.col("p_size").cast("string"))).alias("formula"), diff.table_content(cells).alias("content"),
        diff.is_fragment_table(F.when(F.col("p_size") % 2 == 0, F.array(F.array(F.col("p_type")))).otherwise(cells), F.when(F.col("p_size") % 3 == 0, F.lit("x"))).alias("is_fragment"),
    )


def value_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value differences of order pairs in one expression, with class, consistency and groups of classes."""
    op = _pick(("", "höchstens ", "≥ "), F.col("o_custkey") % 3)
    pair = F.floor(F.col("o_orderkey") / 2)
    said = F.concat(op, (F.col("o_custkey") % 5).cast("string"), F.lit(" kW und "), (pair % 2).cast("string"), F.lit(" ms"))
    rows = table(spark, sf_dir, "orders").select(pair.alias("k"), (F.col("o_orderkey") % 2).alias("side"), said.alias("s"))
    pairs = rows.groupBy("k").agg(*(F.max(F.when(F.col("side") == s, F.col("s"))).alias(n) for s, n in ((0, "a"), (1, "b")))).filter("a is not null and b is not null")
    found = pairs.withColumns({"va": values.extract("a"), "vb": values.extract("b")})
    d = diff.held(diff.held(diff.held(found, "va", "va"), "vb", "vb"), "d", values.changes(F.col("va"), F.col("vb")))
    split = values.split_classes(F.col("d.changed"))
    flat = d.select(F.coalesce(F.get("d.changed", F.lit(0))["value_class"], F.lit("same")).alias("value_class"), values.consistent(F.col("va"), F.col("vb")).alias("consistent"), F.size(split["numbers"]).alias("n_numbers"), F.size(split["operators"]).alias("n_operators"), F.size(values.keys(F.col("va"))).alias("n_keys"))
    return flat.groupBy("value_class", "consistent", "n_numbers", "n_operators", "n_keys").agg(F.count(F.lit(1)).alias("n"))


def cell_value_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in cells of parts: with a unit, as a bare decimal, and none."""
    cell = _pick(("≥ {n} kW", "0,{n}", "Zeile {n}", "{n},5 ms und 1,10"), F.col("p_partkey") % 4)
    cells = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("table_id"), F.col("p_partkey").alias("row"), F.lit(0).alias("col"), F.replace(cell, F.lit("{n}"), F.col("p_size").cast("string")).alias("text"))
    found = values.cell_values(cells, ["table_id"], F.col("text"))
    return found.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.size("values")).alias("n_values"), F.sum(F.size(F.filter("values", lambda v: v["unit"].isNull()))).alias("n_bare"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and quotes of line items, each once with its number; both follow from part and line."""
    n, p = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")
    record = F.concat(F.lit("Die Position "), p, F.lit(" der Bestellung enthält das Teil "), n, F.lit(" des Lagers."))
    forms = F.array(
        record, F.concat(F.lit("Die Position "), p, F.lit(" der Bestellung … Teil "), n), F.concat(F.lit("NEU: Die Position "), p, F.lit(" der Bestellung")), F.concat(F.lit("So steht es: „Die Position "), p, F.lit(" der Bestellung“!")), F.lit("frei erfunden und nirgends belegt"), F.lit("Lagers.")
    )
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("n", record.alias("record"), (F.col("l_partkey") % 6).alias("form"), F.element_at(forms, (F.col("l_partkey") % 6 + 1).cast("int")).alias("quote"))


def evidence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How quotes of six forms are judged against the record they name."""
    rows = _quotes(spark, sf_dir).withColumn("hay", interpretation.haystack(F.col("record")))
    rows = diff.held(rows, "g", interpretation.guarded(F.col("quote"), F.col("hay")))
    return rows.groupBy("form", "g.ok", "g.strict", "g.fragments", "g.extraction").agg(F.sum("n").alias("n"))


def asset_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    quote = F.element_at(F.array(F.lower("p_name"), F.lower(F.concat_ws(" | ", "p_type", "p_brand")), F.lower(F.concat_ws(" ‖ ", "p_type", F.lit("erfunden"))), F.lit("kurz")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("form"), interpretation.asset_ok(quote, hay).alias("ok")).groupBy("form", "ok").agg(F.count(F.lit(1)).alias("n"))


def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they come: strict, with a raw control character, cut off, fenced, missing."""
    body = F.concat(F.lit('{"interpretations": [{"change_index": '), (F.col("o_orderkey") % 9).cast("string"), F.lit(', "change": "a{t}b"}]}'))
    form = F.col("o_orderkey") % 5
    text_ = F.when(form == 0, F.replace(body, F.lit("{t}"), F.lit(" "))).when(form == 1, F.replace(body, F.lit("{t}"), F.lit("\t"))).when(form == 2, F.substring(body, 1, 30)).when(form == 3, F.concat(F.lit("```json\n"), F.replace(body, F.lit("{t}"), F.lit("")), F.lit("\n```")))
    rows = table(spark, sf_dir, "orders").select(form.alias("form"), interpretation.parse_answer(text_).alias("p"))
    return rows.groupBy("form", "p.outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.get("p.answer.interpretations", F.lit(0))["change_index"], F.lit(0))).alias("sum_index"))


def structural_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("new", "removed", "similar", "cosmetic", "merged", "split", "moved_in", "moved_away", "identical", "unknown")
    kind = _pick(kinds, F.col("l_partkey") % 10)
    return table(spark, sf_dir, "lineitem").groupBy(interpretation.structural_operation(kind).alias("operation")).agg(F.count(F.lit(1)).alias("n"))


def owned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of answers that the engine owns: dropped, and counted by name."""
    answer = F.map_from_arrays(F.array(F.lit("change"), F.when(F.col("event_id") % 2 == 0, "evidence_ok").otherwise("impact"), F.when(F.col("event_id") % 3 == 0, "structural_operation").otherwise("confidence")), F.array(*[F.lit("x")] * 3))
    rows = table(spark, sf_dir, "events").select(interpretation.drop_owned(answer).alias("d"))
    return rows.select(F.size("d.kept").alias("n_kept"), F.explode_outer("d.dropped").alias("field")).groupBy("n_kept", "field").agg(F.count(F.lit(1)).alias("n"))


def prompt_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = F.concat_ws("<", F.concat_ws("+", F.concat(F.lit("A."), F.col("l_linenumber").cast("string")), F.lit("B.2")), (F.col("l_partkey") % 50).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(interpretation.prompt_tag(mapping, F.col("l_suppkey") % 3).alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


_PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(p_partkey AS VARCHAR) AS k FROM part"
_OP = "CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN '<=' ELSE '>=' END"
QUERIES = {
    "caption_texts": (
        caption_texts,
        f"WITH p AS ({_PART}) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN length(p_name) >= 3 THEN p_name END WHEN 1 THEN CASE WHEN length(p_name) >= 3 THEN p_name END END AS description, p_partkey % 5 IN (0, 1, 3) AS is_caption FROM p",
    ),
    "change_locations": (
        change_locations,
        """WITH s AS (SELECT CASE WHEN l_partkey % 4 <> 0 THEN '1.' || (l_partkey % 4) ELSE '' END AS a, CASE WHEN l_suppkey % 4 <> 0 THEN '1.' || (l_suppkey % 4) ELSE '' END AS b, '1.' || (l_linenumber % 4) AS h FROM lineitem),
o AS (SELECT CASE WHEN a <> '' AND b <> '' AND a <> b THEN a || ' → ' || b ELSE CASE WHEN (CASE WHEN b <> '' THEN b ELSE a END) NOT IN ('', h) THEN (CASE WHEN b <> '' THEN b ELSE a END) ELSE '' END END AS shown FROM s)
SELECT shown, count(*) AS n FROM o GROUP BY shown""",
    ),
    "axis_markers": (
        axis_markers,
        """WITH e AS (SELECT ['narrowed', '', 'extended'][event_id % 3 + 1] AS s, ['relaxed', ''][user_id % 2 + 1] AS d, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'scope, ' || event_type END AS p FROM events),
m AS (SELECT array_to_string(list_filter([s, d, p], lambda x: x <> ''), ' · ') AS m FROM e) SELECT CASE WHEN m <> '' THEN '[' || m || ']' ELSE '' END AS marker, count(*) AS n FROM m GROUP BY 1""",
    ),
    "clipped_texts": (
        clipped_texts,
        """WITH t AS (SELECT doc_id, trim(text, ' ') AS t, text FROM documents) SELECT doc_id, md5(CASE WHEN length(t) <= 160 THEN t ELSE substring(t, 1, 160) || ' …' END) AS clip_md5,
  md5(CASE WHEN length(text) <= 900 THEN text ELSE substring(text, 1, 900) || ' … (+' || (length(text) - 900) || ')' END) AS counted_md5 FROM t""",
    ),
    "parameter_lines": (
        parameter_lines,
        f"WITH p AS ({_PART}) SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 = 2 THEN p_name || ' entfällt' ELSE CAST(p_size AS VARCHAR) END AS old, CASE WHEN p_partkey % 3 < 2 THEN k END AS new, CASE WHEN p_partkey % 3 = 2 THEN p_name || ' entfällt' ELSE k END AS side_new FROM p",
    ),
    "first_names": (
        first_names,
        "WITH n AS (SELECT n_regionkey, list_sort(list(n_name)) AS l FROM nation GROUP BY n_regionkey) SELECT n_regionkey, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' +' || (len(l) - 3) || ' weitere' ELSE '' END AS note FROM n",
    ),
    "summaries": (summaries, "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda s: length(s) > 40)[1:3], ' ')) AS summary_md5 FROM documents"),
    "normal_numbers": (
        normal_numbers,
        "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) AS n, lpad(CAST(CAST(round(l_quantity) AS INT) % 100 AS VARCHAR), 2, '0') AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, 'das 50hznetz alt hat ' || n || ' ' || r || ' kv' AS n3, n || '.' || r AS number FROM l",
    ),
    "one_word_diffs": (
        one_word_diffs,
        """WITH l AS (SELECT 'wort' || (l_partkey % 7) AS a, 'wort' || (l_suppkey % 7) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, 'Der Betreiber prüft/misst ' || a || ' (jährlich).' AS x, 'Der Betreiber prüft/misst ' || b || ' (jährlich).' AS y FROM l)
SELECT x AS a, y AS b, n, CASE WHEN a = b THEN 0 ELSE 5 END AS chars_inserted, CASE WHEN a = b THEN 0 ELSE 5 END AS chars_deleted, CASE WHEN a = b THEN length(x) ELSE length(x) - 5 END AS chars_equal,
  CASE WHEN a = b THEN 0.0::DOUBLE ELSE round(10::DOUBLE / (length(x) + 5), 4) END AS change_ratio, a <> b AS substantive, CASE WHEN a = b THEN 1 ELSE 4 END AS n_ops FROM t""",
    ),
    "cell_and_formula_keys": (
        cell_and_formula_keys,
        """SELECT p_partkey, replace(lower(p_type), ' ', '') || 'x' AS cell, replace(p_brand, ' ', '') || '=' || p_size AS formula, substring(lower(p_brand || ' ' || p_type || ' ' || p_size), 1, 400) AS content,
  p_size % 3 <> 0 AND p_size % 2 = 0 AS is_fragment FROM part""",
    ),
    "value_changes": (
        value_changes,
        f"""WITH o AS (SELECT o_orderkey // 2 AS k, o_orderkey % 2 AS side, {_OP} AS op, o_custkey % 5 AS v FROM orders),
p AS (SELECT a.op AS oa, b.op AS ob, a.v AS va, b.v AS vb FROM o AS a JOIN o AS b ON a.k = b.k AND a.side = 0 AND b.side = 1),
c AS (SELECT CASE WHEN va <> vb THEN 'value_changed' WHEN oa = ob THEN 'same' WHEN oa = '' THEN 'operator_added' WHEN ob = '' THEN 'operator_removed' ELSE 'operator_changed' END AS value_class FROM p)
SELECT value_class, value_class = 'same' AS consistent, CAST(value_class = 'value_changed' AS INT) AS n_numbers, CAST(value_class NOT IN ('value_changed', 'same') AS INT) AS n_operators, 2 AS n_keys, count(*) AS n FROM c GROUP BY value_class""",
    ),
    "cell_value_totals": (
        cell_value_totals,
        """SELECT p_partkey // 100 AS table_id, count(*) FILTER (p_partkey % 4 <> 2) AS n_cells, CAST(sum(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END) AS BIGINT) AS n_values,
  CAST(sum(CASE WHEN p_partkey % 4 IN (1, 3) THEN 1 ELSE 0 END) AS BIGINT) AS n_bare FROM part GROUP BY 1 HAVING count(*) FILTER (p_partkey % 4 <> 2) > 0""",
    ),
    "evidence_guard": (
        evidence_guard,
        """SELECT l_partkey % 6 AS form, l_partkey % 6 < 4 AS ok, l_partkey % 6 <> 4 AS strict, CASE WHEN l_partkey % 6 = 1 THEN 2 ELSE 1 END AS fragments,
  CASE WHEN l_partkey % 6 = 2 THEN 'etikett' WHEN l_partkey % 6 = 3 THEN 'anfuehrung' ELSE 'roh' END AS extraction, count(*) AS n FROM lineitem GROUP BY ALL""",
    ),
    "asset_evidence": (
        asset_evidence,
        "SELECT p_partkey % 4 AS form, CASE p_partkey % 4 WHEN 0 THEN length(p_name) >= 8 WHEN 1 THEN true ELSE false END AS ok, count(*) AS n FROM part GROUP BY ALL",
    ),
    "answer_outcomes": (
        answer_outcomes,
        """SELECT o_orderkey % 5 AS form, ['ok', 'repaired', 'unparsable', 'ok', 'no_answer'][o_orderkey % 5 + 1] AS outcome, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN o_orderkey % 9 ELSE 0 END) AS BIGINT) AS sum_index FROM orders GROUP BY ALL""",
    ),
    "structural_operations": (
        structural_operations,
        "SELECT ['added', 'removed', 'modified', 'modified', 'merged', 'split', 'moved', 'moved', 'unchanged', NULL][l_partkey % 10 + 1] AS operation, count(*) AS n FROM lineitem GROUP BY 1",
    ),
    "owned_fields": (
        owned_fields,
        """WITH e AS (SELECT event_id % 2 = 0 AS a, event_id % 3 = 0 AS b FROM events), f AS (SELECT 3 - CAST(a AS INT) - CAST(b AS INT) AS n_kept, CASE WHEN a OR b THEN list_filter([CASE WHEN a THEN 'evidence_ok' END, CASE WHEN b THEN 'structural_operation' END], lambda x: x IS NOT NULL) ELSE [NULL] END AS d FROM e),
u AS (SELECT n_kept, unnest(d) AS field FROM f) SELECT n_kept, field, count(*) AS n FROM u GROUP BY ALL""",
    ),
    "prompt_tags": (
        prompt_tags,
        "SELECT 'A.' || l_linenumber || '_B.2_' || (l_partkey % 50) || CASE WHEN l_suppkey % 3 > 0 THEN '.T' || (l_suppkey % 3 + 1) ELSE '' END AS tag, count(*) AS n FROM lineitem GROUP BY 1",
    ),
}
