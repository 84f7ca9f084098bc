"""Queries over chapters, links, tables, reports, audits and page layout; their inputs are built from real columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import align, audits, chapters, diff, interpretation, reports
from stemma.plans.forms import _pick
from stemma.plans.paragraphs import table
from stemma.sources import layout, vectors


def _text(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------- chapters and links


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sections of two editions: brand as pair, numbers with up to three levels, titles of real words."""
    parts = table(spark, sf_dir, "part")
    number = F.concat_ws(".", _text(F.floor(F.col("p_partkey") / 20)), F.when(F.col("p_partkey") % 20 >= 4, _text(F.floor(F.col("p_partkey") % 20 / 4))), F.when(F.col("p_partkey") % 4 >= 2, F.lit("1")))
    title = F.lower(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")))
    return parts.select(
        F.lit("p").alias("pair_id"), F.when(F.col("p_partkey") % 2 == 0, "old").otherwise("new").alias("edition"), F.col("p_partkey").cast("int").alias("sec_ix"), number.alias("section_id"), F.lit(1).alias("level"), F.lit("hauptteil").alias("part"), title.alias("title"), title.alias("text")
    )


def nearest_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmapped sections and the mapped section that they are absorbed by: every seventh one is mapped."""
    rows = _sections(spark, sf_dir)
    mapped = rows.filter("edition = 'old'").select("pair_id", F.col("sec_ix").alias("old_ix")).filter("old_ix % 4 = 0").withColumn("new_ix", F.lit(0))
    return chapters.absorbed(rows, mapped, "old").select("sec_ix", "head_ix")


def link_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of links: by the first new paragraph, removals behind by the first old one."""
    one = lambda c: F.array(F.col(c).cast("int"))
    none = F.array().cast("array<int>")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, none).otherwise(one("l_linenumber")).alias("new"), F.when(F.col("l_linenumber") % 3 == 1, none).otherwise(one("l_linenumber")).alias("old"), "l_linenumber")
    placed = align.link_order(items.distinct(), ["l_orderkey"])
    return placed.groupBy("l_linenumber", "place").agg(F.count(F.lit(1)).alias("n"))


def written_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of moves between line items, with pointers."""
    rows = table(spark, sf_dir, "orders").select(F.lit("p").alias("pair_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "removed").otherwise("new").alias("kind"), F.lit(0.0).alias("confidence"), F.lit("rest").alias("via"))
    moves = rows.filter("kind = 'removed' and id % 6 = 0").select("pair_id", F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id"), F.lit(0.9).alias("score"))
    out = align.write_moves(rows, moves, ["pair_id"])
    return out.select("id", "kind", "moved_to", "moved_from", "confidence", "via")


def vector_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", vectors.vector_key("m", F.col("r_name")).alias("key"))


# ---------------------------------------------------------------- tables


def row_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two rows per order pair, matched by caption, and moved across chapters otherwise."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.lit("p").alias("pair_id"), F.concat(F.lit("c"), _text(F.floor(key / 4))).alias("mapping"), F.when(key % 2 == 0, "old").otherwise("new").alias("edition"), F.concat(F.lit("t"), _text(key)).alias("table_id"), key.alias("place"),
        F.concat(F.lit("Tabelle 1 – "), F.when(key % 4 < 2, F.concat(F.lit("gruppe "), F.sha1(_text(F.floor(key / 4)).cast("binary")))).otherwise(F.sha1(_text(key).cast("binary")))).alias("caption"),
        F.array(F.array(F.concat(F.lit("kopf "), _text(key)), F.col("s_name")), F.array(F.md5(_text(key).cast("binary")), F.lit("fest"))).alias("cells"),
    )
    found = diff.tables_diff(diff.table_rows(rows).withColumn("content_key", F.lit("")).select("pair_id", "mapping", "edition", "table_id", "place", "caption_key", "content_key", "row_keys"), ["pair_id", "mapping"])
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("rows_changed").alias("rows_changed"))


# ---------------------------------------------------------------- reports


def section_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and references of line items by order, as of the paragraphs of a section."""
    label = _pick(("muss", "darf", "kann"), F.col("l_partkey") % 3)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(label, F.lit("informativ")).alias("labels"), F.array(_text(F.col("l_suppkey") % 4)).alias("refs_internal"), F.array(F.concat(F.lit("EN "), _text(F.col("l_linenumber")))).alias("refs_external"))
    out = reports.section_rollup(rows, ["l_orderkey"])
    count = lambda k: F.coalesce(F.try_element_at("modality_counts", F.lit(k)), F.lit(0))
    return out.select("l_orderkey", count("muss").alias("muss"), count("darf").alias("darf"), count("kann").alias("kann"), count("informativ").alias("informativ"), F.array_join("refs_internal", ",").alias("refs_in"), F.array_join("refs_external", ",").alias("refs_out"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as changes of chapters, with value changes and shifts."""
    kind = _pick(("similar", "new", "removed", "cosmetic"), F.col("l_partkey") % 4)
    shift = F.when(F.col("l_suppkey") % 3 == 0, "verschaerft").when(F.col("l_suppkey") % 3 == 1, "gelockert")
    item = "struct<unit:string,old:struct<raw:string>,new:struct<raw:string>,value_class:string>"
    one = F.struct(F.lit("W").alias("unit"), F.struct(_text(F.col("l_quantity").cast("int")).alias("raw")).alias("old"), F.struct(_text(F.col("l_linenumber")).alias("raw")).alias("new"), F.when(F.col("l_linenumber") % 2 == 0, "value_changed").otherwise("operator_added").alias("value_class"))
    values = F.when(F.col("l_partkey") % 4 == 0, F.array(one)).otherwise(F.array().cast(f"array<{item}>"))
    head = F.col("l_orderkey") % 40
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), _text(head % 2)).alias("pair_id"), F.concat(F.lit("m"), _text(head)).alias("mapping"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("change_ix"), kind.alias("kind"), F.struct(values.alias("changed")).alias("kennwerte"),
        F.struct(shift.alias("shift")).alias("modality"), F.lit("1.1").alias("section_new"), F.lit("1").alias("section_old"), F.col("l_extendedprice").alias("price"), "l_quantity", F.lit("alt").alias("old_text"), F.lit("neu").alias("new_text"),
    )


def _chapters(spark: SparkSession) -> DataFrame:
    rows = spark.range(40)
    head = F.col("id")
    return rows.select(F.concat(F.lit("p"), _text(head % 2)).alias("pair_id"), F.concat(F.lit("m"), _text(head)).alias("mapping"), head.cast("int").alias("chapter_ix"), (head % 5 == 0).alias("part_changed"), F.lit(None).cast("string").alias("old_id"), _text(head).alias("new_id"), F.lit("t").alias("title"))


def pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.pair_statistics(_changes(spark, sf_dir), _chapters(spark))
    return out.withColumn("part_changed_mappings", F.array_join("part_changed_mappings", ","))


def parameter_group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parameter_groups(reports.value_changes(_changes(spark, sf_dir)), _chapters(spark)).withColumnRenamed("group", "value_group")


def dossier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.dossier(_chapters(spark), _changes(spark, sf_dir))
    return out.select("pair_id", "mapping", "n_changes", F.size("value_changes").alias("n_values"))


def slide_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    return reports.slides(reports.dossier(_chapters(spark), changes), changes).select("pair_id", "slide", "head", F.size("lines").alias("n_lines"))


def removal_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals with evidence in review order: relocation scores from discounts, surplus from orders."""
    changes = _changes(spark, sf_dir)
    score = F.round(F.col("l_quantity") / 50, 4)
    rows = changes.withColumns({"relocation": F.struct(score.alias("best_score"), F.lit("1").alias("best_section"), (F.col("change_ix") % 2 == 0).alias("in_mapping")), "possible_move_to": F.when(F.col("change_ix") % 7 == 0, "x"), "old_ids": F.array(F.lpad(_text(F.col("change_ix")), 12, "0"))})
    balance = _chapters(spark).select("pair_id", "mapping", (F.col("chapter_ix") % 10).alias("old_surplus"))
    found = reports.review_list(rows, balance)
    return found.select("pair_id", "mapping", "change_ix", F.array_join("review_reasons", "|").alias("reasons"), "surplus")


def strongest_table_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("run"), (F.col("l_partkey") % 20).alias("old"), (F.col("l_suppkey") % 20).alias("new"), F.col("l_discount").alias("score"))
    return reports.strongest_pairs(rows, ["run"])


def run_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per run, rows of any run, zero where one has none."""
    rows = table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("r"), _text(F.col("event_id") % 3)).alias("run"))
    return reports.across_runs(rows, "event_type", F.count(F.lit(1)), ["r0", "r1", "r2"])


def coverage_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("p"), _text(F.col("o_orderkey") % 3)).alias("pair_id"), F.lpad(_text(F.col("o_orderkey") % 30), 2, "0").alias("mapping")).agg(F.count(F.lit(1)).alias("n_changes"), F.count_if(F.col("o_orderstatus") != "P").alias("n_interpreted"))
    rows = rows.withColumns({"n_unanswered": F.col("n_changes") - F.col("n_interpreted"), "incomplete": F.col("n_interpreted") < F.col("n_changes")})
    return reports.coverage_note(rows)


def truncation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, "asset_block").otherwise("table").alias("kind"), F.greatest(F.col("l_quantity") - 40, F.lit(0)).alias("n_dropped"))
    return interpretation.truncation_report(notes)


# ---------------------------------------------------------------- audits


def exclusive_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audits.quantiles(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.select("o_orderstatus", "n", "least", F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"), F.round("q3", 4).alias("q3"), "most")


def consistency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of interpretations of orders: even ones moved away to the odd one behind them."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    even = key % 2 == 0
    ids = [F.lit("p").alias("pair_id"), F.lit("m").alias("mapping"), key.cast("int").alias("change_ix")]
    changes = orders.select(*ids, F.when(even, "moved_away").otherwise("moved_in").alias("kind"), F.when(even, _text(key)).alias("old_pid"), F.when(~even, _text(key)).alias("new_pid"), F.when(even, _text(key + 1)).alias("moved_to"), F.when(~even, _text(key - 1)).alias("moved_from"), _pick(("muss", "informativ"), F.col("o_custkey") % 2).alias("modality"))
    answers = orders.select(
        *ids, F.lit("moved").alias("structural_operation"), _pick(("equivalent", "narrowed"), F.col("o_custkey") % 2).alias("semantic_status"), _pick(("not_applicable", "tightened", "unchanged"), F.col("o_custkey") % 3).alias("normative_direction"),
        F.when(F.col("o_custkey") % 5 == 0, "gilt nun in Abschnitt 3.1").otherwise("gilt nun in der Regel").alias("change"), F.lit("").alias("impact"), F.lit(False).alias("reported"),
    )
    return interpretation.consistency_counts(interpretation.check_consistency(answers, changes))


def counterpart_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick(("verschoben nach Abschnitt 5.4", "ein Duplikat von Änderung [2]", "nur ein Fragment", "inhaltlich unverändert", "neu"), F.col("event_id") % 5)
    shown = _pick(("Das ist ein ganzer Satz mit Ende.", "wort"), F.col("user_id") % 2)
    rows = table(spark, sf_dir, "events").select(audits.signals(said, F.lit(0), F.lit(False), F.array(F.lit("scope")), shown, F.lit(9)).alias("s"))
    return rows.select(F.array_join("s", ",").alias("signals"), audits.without_counterpart_group(F.col("s")).alias("verdict")).groupBy("signals", "verdict").agg(F.count(F.lit(1)).alias("n"))


def axis_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda m: table(spark, sf_dir, "events").select("event_id", _pick(("narrowed", "extended", "replaced"), F.col("event_id") % m % 3).alias("status"))
    return audits.axis_migration(run(4), run(5), ["event_id"], "status")


def disagreement_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda m: _pick(("a", "b"), F.col("event_id") % m % 2)
    return audits.disagreement_signatures(table(spark, sf_dir, "events").select(at(2).alias("away_status"), at(3).alias("into_status"), at(5).alias("away_direction"), F.when(F.col("event_id") % 4 > 0, at(7)).alias("into_direction")))


def recheck_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda m: table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % m == 0).alias("ok"))
    return audits.rechecked(run(2), run(3), ["event_id"])


def pairing_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    left = rows.select(F.lit("p").alias("pair_id"), _text(key % 5).alias("mapping"), _text(key).alias("table_id"))
    scores = rows.select(F.lit("p").alias("pair_id"), _text(key % 5).alias("mapping"), _text(key).alias("table_id"), _text(key % 3).alias("other_mapping"), (key % 2 == 0).alias("other_taken"), (key % 10 / 10).alias("score"))
    return audits.pairing_causes(left, scores, 0.5).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- page layout


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as pages: a running head on every page, a page number, and a line that comes once."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("doc"), F.floor(F.col("l_orderkey") / 50).alias("page"), "l_linenumber", "l_partkey")
    y = F.when(F.col("l_linenumber") == 1, 10.0).when(F.col("l_linenumber") == 2, 790.0).when(F.col("l_linenumber") == 3, 20.0).otherwise(400.0)
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Kopf "), _text(F.col("page")))).when(F.col("l_linenumber") == 2, F.concat(F.lit("- "), _text(F.col("page")), F.lit(" -"))).otherwise(F.concat(F.lit("Zeile "), F.md5(_text(F.col("l_partkey")).cast("binary"))))
    lines = items.select("doc", "page", y.alias("y"), text.alias("text"), F.lit(800.0).alias("page_height"), "l_linenumber")
    return layout.without_page_edges(lines).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def outline_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of suppliers: main chapters, a list to skip, front matter, an annex and its parts."""
    key = F.col("s_suppkey")
    titles = F.array(F.lit("Inhalt"), F.lit("Vorwort"), F.concat(F.lit("1 "), "s_name"), F.lit("1.2  Zweck"), F.lit("1 Nochmal"), F.when(key % 2 == 0, "Anhang B (informativ) – Werte").otherwise("Anhang B Werte"), F.lit("B.1.1 Tafeln"), F.lit("C.1 fremd"), F.lit("2 zu spät"), F.lit("Literaturhinweise"))
    rows = table(spark, sf_dir, "supplier").select(key.alias("doc"), F.posexplode(titles).alias("ix", "title"), F.lit(1).alias("page"))
    return layout.outline_sections(rows).groupBy("section_id", "level", "part").agg(F.count(F.lit(1)).alias("n"))


def reading_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc"), F.col("l_orderkey").alias("line"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("k"), F.col("l_quantity").alias("x"), _text(F.col("l_linenumber")).alias("text"))
    return layout.reading_order(spans).select("line", "text")


def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("doc"), F.when(F.col("l_partkey") % 3 == 0, 14.2).otherwise(9.8).alias("size"))
    return layout.body_sizes(rows)


def asset_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 20).alias("doc"), F.col("o_orderkey").alias("asset_id"), (F.col("o_custkey") % 30).alias("page"))
    pages = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("doc"), F.col("s_suppkey").alias("sec_ix"), (F.col("s_nationkey")).cast("long").alias("page"))
    return layout.claimed_assets(assets, pages)


_C = """c AS (SELECT 'p' || (l_orderkey % 40 % 2) AS pair_id, 'm' || (l_orderkey % 40) AS mapping, l_orderkey % 40 AS h, l_orderkey * 8 + l_linenumber AS ix, l_partkey % 4 AS k, l_suppkey % 3 AS s, CAST(l_quantity AS INT) AS q, l_linenumber AS ln, l_quantity AS quantity FROM lineitem)"""
_D = f"{_C}, d AS (SELECT pair_id, mapping, h, count(*) FILTER (k <> 3) AS n_changes, count(*) FILTER (k = 0) AS n_values FROM c GROUP BY ALL)"
_QUANTILE = lambda p: f"round(v[least(greatest(CAST(floor((n + 1) * {p}) AS BIGINT), 1), n)] + ((n + 1) * {p} - floor((n + 1) * {p})) * (v[least(CAST(floor((n + 1) * {p}) AS BIGINT) + 1, n)] - v[least(greatest(CAST(floor((n + 1) * {p}) AS BIGINT), 1), n)]), 4)"

QUERIES = {
    "nearest_ancestors": (
        nearest_ancestors,
        """WITH s AS (SELECT p_partkey AS ix, array_to_string(list_filter([CAST(p_partkey // 20 AS VARCHAR), CASE WHEN p_partkey % 20 >= 4 THEN CAST(p_partkey % 20 // 4 AS VARCHAR) END, CASE WHEN p_partkey % 4 >= 2 THEN '1' END], lambda x: x IS NOT NULL), '.') AS id FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT id, max(ix) AS head_ix FROM s WHERE ix % 4 = 0 GROUP BY id), f AS (SELECT * FROM s WHERE ix % 4 <> 0)
SELECT f.ix AS sec_ix, m.head_ix FROM f JOIN m ON starts_with(f.id, m.id || '.') QUALIFY row_number() OVER (PARTITION BY f.ix ORDER BY length(m.id) DESC) = 1""",
    ),
    "link_places": (
        link_places,
        """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), p AS (SELECT l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END, l_linenumber) AS place FROM l)
SELECT l_linenumber, place, count(*) AS n FROM p GROUP BY ALL""",
    ),
    "written_moves": (
        written_moves,
        """WITH k AS (SELECT o_orderkey AS id FROM orders), m AS (SELECT id AS o, id + 1 AS n FROM k WHERE id % 6 = 0)
SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN a.o IS NOT NULL THEN 'moved_away' ELSE 'removed' END ELSE CASE WHEN b.n IS NOT NULL THEN 'moved_in' ELSE 'new' END END AS kind, a.n AS moved_to, b.o AS moved_from,
  CASE WHEN a.o IS NOT NULL OR b.n IS NOT NULL THEN 0.9::DOUBLE ELSE 0.0 END AS confidence, CASE WHEN a.o IS NOT NULL OR b.n IS NOT NULL THEN 'tfidf' ELSE 'rest' END AS via FROM k LEFT JOIN m AS a ON a.o = id LEFT JOIN m AS b ON b.n = id""",
    ),
    "vector_keys": (vector_keys, "SELECT r_regionkey, 'h' || sha1('m' || chr(0) || lower(r_name)) AS key FROM region"),
    "row_diffs": (
        row_diffs,
        """WITH s AS (SELECT s_suppkey // 4 AS c, s_suppkey % 4 AS r FROM supplier), g AS (SELECT c, count(*) FILTER (r = 0) AS a, count(*) FILTER (r = 1) AS b, count(*) FILTER (r = 2) AS x, count(*) FILTER (r = 3) AS y FROM s GROUP BY c),
k AS (SELECT 'matched' AS kind, sum(a * b) AS n, sum(2 * a * b) AS w FROM g UNION ALL SELECT 'removed', sum(a - a * b + x), NULL FROM g UNION ALL SELECT 'new', sum(b - a * b + y), NULL FROM g)
SELECT kind, CAST(n AS BIGINT) AS n, CAST(w AS BIGINT) AS rows_changed FROM k WHERE n > 0""",
    ),
    "section_rollups": (
        section_rollups,
        """SELECT l_orderkey, count(*) FILTER (l_partkey % 3 = 0) AS muss, count(*) FILTER (l_partkey % 3 = 1) AS darf, count(*) FILTER (l_partkey % 3 = 2) AS kann, count(*) AS informativ,
  array_to_string(list_sort(list(DISTINCT CAST(l_suppkey % 4 AS VARCHAR))), ',') AS refs_in, array_to_string(list_sort(list(DISTINCT 'EN ' || l_linenumber)), ',') AS refs_out FROM lineitem GROUP BY l_orderkey""",
    ),
    "pair_totals": (
        pair_totals,
        f"""WITH {_C}, t AS (SELECT pair_id, count(*) AS n_changes, count(DISTINCT mapping) AS n_chapters_with_changes, count(*) FILTER (k = 0) AS n_value_changes, count(*) FILTER (s = 0) AS n_tightened, count(*) FILTER (s = 1) AS n_relaxed FROM c GROUP BY pair_id),
p AS (SELECT 'p' || (i % 2) AS pair_id, array_to_string(list_sort(list('m' || i)), ',') AS part_changed_mappings FROM generate_series(0, 39, 5) AS g(i) GROUP BY 1) SELECT * FROM t LEFT JOIN p USING (pair_id)""",
    ),
    "parameter_group_lines": (
        parameter_group_lines,
        f"""WITH {_C}, g AS (SELECT pair_id, CASE WHEN ln % 2 = 0 THEN 'numbers' ELSE 'operators' END AS "group", h || CASE WHEN '1.1' <> CAST(h AS VARCHAR) THEN ' (1.1)' ELSE '' END || ': ' || q || ' → ' || ln AS line, h, ix FROM c WHERE k = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, "group" ORDER BY h, ix) AS place FROM g) SELECT pair_id, "group" AS value_group, place, line FROM r WHERE place <= 14""",
    ),
    "dossier_counts": (dossier_counts, f"WITH {_D}, h AS (SELECT 'p' || (i % 2) AS pair_id, 'm' || i AS mapping FROM generate_series(0, 39) AS g(i)) SELECT pair_id, mapping, coalesce(n_changes, 0) AS n_changes, coalesce(n_values, 0) AS n_values FROM h LEFT JOIN d USING (pair_id, mapping)"),
    "slide_ranking": (
        slide_ranking,
        f"WITH {_D}, r AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY 3 * n_values + n_changes DESC, h) AS slide, CAST(h AS VARCHAR) AS head, least(n_changes, 5) AS n_lines FROM d WHERE n_changes > 0) SELECT * FROM r WHERE slide <= 22",
    ),
    "removal_reviews": (
        removal_reviews,
        f"""WITH {_C}, r AS (SELECT pair_id, mapping, ix AS change_ix, h % 10 AS surplus, list_filter([CASE WHEN ix % 7 = 0 THEN 'possible_move' END, CASE WHEN round(quantity / 50, 4) >= 0.7 AND ix % 2 <> 0 THEN 'relocated_outside_mapping' END, CASE WHEN round(quantity / 50, 4) >= 0.7 AND ix % 2 = 0 THEN 'missed_inside_mapping' END, CASE WHEN h % 10 >= 5 THEN 'unbalanced_mapping' END], lambda x: x IS NOT NULL) AS why FROM c WHERE k = 2)
SELECT pair_id, mapping, change_ix, array_to_string(why, '|') AS reasons, surplus FROM r WHERE len(list_filter(why, lambda x: x <> 'unbalanced_mapping')) > 0""",
    ),
    "strongest_table_pairs": (
        strongest_table_pairs,
        """WITH b AS (SELECT l_orderkey % 3 AS run, l_partkey % 20 AS old, l_suppkey % 20 AS new, max(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, old, new) AS place FROM b)
SELECT run, old, new, score, place FROM r WHERE place <= 20""",
    ),
    "run_views": (run_views, "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS r0, count(*) FILTER (event_id % 3 = 1) AS r1, count(*) FILTER (event_id % 3 = 2) AS r2 FROM events GROUP BY 1"),
    "coverage_notes": (
        coverage_notes,
        """WITH c AS (SELECT 'p' || (o_orderkey % 3) AS pair_id, lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') AS m, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS d FROM orders GROUP BY 1, 2),
s AS (SELECT pair_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS d, list_sort(list(m) FILTER (d < n)) AS l FROM c GROUP BY pair_id)
SELECT pair_id, 'UNVOLLSTÄNDIG: ' || d || ' von ' || n || ' Änderungen sind gedeutet (' || replace(printf('%.1f', d::DOUBLE / n * 100), '.', ',') || ' %). Kapitel: ' || array_to_string(l[1:8], ', ') || CASE WHEN len(l) > 8 THEN ' +' || (len(l) - 8) || ' weitere' ELSE '' END AS note FROM s WHERE d < n""",
    ),
    "truncation_counts": (
        truncation_counts,
        "SELECT count(*) FILTER (l_linenumber <> 1) AS n_tables, count(*) FILTER (l_linenumber <> 1 AND l_quantity > 40) AS n_tables_truncated, count(*) FILTER (l_linenumber = 1) AS n_asset_blocks, count(*) FILTER (l_linenumber = 1 AND l_quantity > 40) AS n_asset_blocks_truncated FROM lineitem",
    ),
    "exclusive_quartiles": (
        exclusive_quartiles,
        f"WITH l AS (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, n, v[1] AS least, {_QUANTILE(0.25)} AS q1, {_QUANTILE(0.5)} AS median, {_QUANTILE(0.75)} AS q3, v[n] AS most FROM l",
    ),
    "consistency_flags": (
        consistency_flags,
        """WITH o AS (SELECT o_orderkey AS k, o_custkey % 2 AS st, o_custkey % 3 AS d, o_custkey % 5 = 0 AS named FROM orders),
p AS (SELECT count(*) FILTER (a.st <> b.st OR a.d <> b.d) AS n FROM o AS a JOIN o AS b ON b.k = a.k + 1 AND a.k % 2 = 0),
e AS (SELECT o.*, x.k IS NOT NULL AND (x.st <> o.st OR x.d <> o.d) AS dis FROM o LEFT JOIN o AS x ON x.k = CASE WHEN o.k % 2 = 0 THEN o.k + 1 ELSE o.k - 1 END),
f AS (SELECT *, st = 0 AND d = 0 AS c, st = 1 AND d = 1 AS i, st = 1 AND named AS s FROM e)
SELECT 'p' AS pair_id, (SELECT n FROM p) AS n_partner_disagreement, 0::BIGINT AS n_axis_b_contradicts_a, 0::BIGINT AS n_axis_b_reported_as_artefact, count(*) FILTER (c) AS n_axis_c_contradicts_modality, count(*) FILTER (i) AS n_informative_with_direction,
  count(*) FILTER (s) AS n_successor_named, count(*) FILTER (CAST(dis AS INT) + CAST(c AS INT) + CAST(s AS INT) > 1) AS n_multiple_flags FROM f""",
    ),
    "counterpart_groups": (
        counterpart_groups,
        """WITH e AS (SELECT event_id % 5 AS v, user_id % 2 = 1 AS f FROM events),
s AS (SELECT v, f, list_sort(list_filter([CASE WHEN f THEN 'fragment' END, CASE WHEN v = 1 THEN 'names_change' END, CASE WHEN v = 0 THEN 'names_place' END, CASE v WHEN 0 THEN 'voice_elsewhere' WHEN 1 THEN 'voice_duplicate' WHEN 2 THEN 'voice_artefact' WHEN 3 THEN 'voice_present' END], lambda x: x IS NOT NULL)) AS l FROM e)
SELECT array_to_string(l, ',') AS signals, CASE WHEN v = 1 THEN 'duplicate' WHEN v = 0 THEN 'relocation' WHEN v IN (2, 3) AND f THEN 'torn' WHEN len(l) = 0 THEN 'genuine' ELSE 'unclassified' END AS verdict, count(*) AS n FROM s GROUP BY 1, 2""",
    ),
    "axis_migration": (axis_migration, "WITH e AS (SELECT ['narrowed', 'extended', 'replaced'][event_id % 4 % 3 + 1] AS before, ['narrowed', 'extended', 'replaced'][event_id % 5 % 3 + 1] AS after FROM events) SELECT before, after, count(*) AS n FROM e GROUP BY ALL"),
    "disagreement_signatures": (
        disagreement_signatures,
        """WITH e AS (SELECT ['a', 'b'][event_id % 2 % 2 + 1] AS a, ['a', 'b'][event_id % 3 % 2 + 1] AS b, ['a', 'b'][event_id % 5 % 2 + 1] AS c, CASE WHEN event_id % 4 > 0 THEN ['a', 'b'][event_id % 7 % 2 + 1] END AS d FROM events),
s AS (SELECT array_to_string(list_filter([CASE WHEN a IS DISTINCT FROM b THEN a || '>' || b END, CASE WHEN c IS DISTINCT FROM d THEN c || '>' || coalesce(d, '-') END], lambda x: x IS NOT NULL), ' | ') AS signature FROM e) SELECT signature, count(*) AS n FROM s WHERE signature <> '' GROUP BY 1""",
    ),
    "recheck_outcomes": (recheck_outcomes, "SELECT CASE WHEN (event_id % 2 = 0) = (event_id % 3 = 0) THEN 'same' WHEN event_id % 3 = 0 THEN 'saved' ELSE 'lost' END AS outcome, count(*) AS n FROM events GROUP BY 1"),
    "pairing_causes": (
        pairing_causes,
        "SELECT CASE WHEN s_suppkey % 10 >= 5 AND s_suppkey % 5 = s_suppkey % 3 AND s_suppkey % 2 = 0 THEN 'displacement' WHEN s_suppkey % 10 >= 5 AND s_suppkey % 5 <> s_suppkey % 3 THEN 'chapter_boundary' ELSE 'no_candidate' END AS cause, count(*) AS n FROM supplier GROUP BY 1",
    ),
    "page_edges": (
        page_edges,
        """WITH l AS (SELECT l_orderkey % 50 AS doc, l_orderkey // 50 AS page, l_linenumber AS ln, l_partkey AS p FROM lineitem), pages AS (SELECT doc, max(page) AS pages FROM l GROUP BY doc),
e AS (SELECT *, CASE ln WHEN 1 THEN 'Kopf #' WHEN 2 THEN '- # -' WHEN 3 THEN substring('Zeile ' || regexp_replace(md5(CAST(p AS VARCHAR)), '[0-9]+', '#', 'g'), 1, 60) END AS key FROM l),
c AS (SELECT doc, key, count(*) AS n FROM e WHERE key IS NOT NULL GROUP BY ALL)
SELECT ln AS l_linenumber, count(*) AS n FROM e JOIN pages USING (doc) LEFT JOIN c USING (doc, key) WHERE ln <> 2 AND (key IS NULL OR n < 0.3 * pages) GROUP BY ln""",
    ),
    "outline_chapters": (
        outline_chapters,
        """WITH n AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS i FROM supplier)
SELECT * FROM (SELECT 'vorspann.vorwort' AS section_id, 1 AS level, 'vorspann' AS part, n FROM n UNION ALL SELECT '1', 1, 'hauptteil', n FROM n UNION ALL SELECT '1.2', 2, 'hauptteil', n FROM n UNION ALL SELECT 'Literatur', 1, 'literatur', n FROM n
  UNION ALL SELECT 'B', 1, 'anhang_informativ', i FROM n UNION ALL SELECT 'B', 1, 'anhang_normativ', n - i FROM n UNION ALL SELECT 'B.1.1', 3, 'anhang_informativ', i FROM n UNION ALL SELECT 'B.1.1', 3, 'anhang_normativ', n - i FROM n) WHERE n > 0""",
    ),
    "reading_orders": (reading_orders, "SELECT l_orderkey AS line, string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY l_quantity, l_linenumber * 1000000 + l_partkey, l_linenumber) AS text FROM lineitem GROUP BY 1"),
    "body_sizes": (body_sizes, "WITH s AS (SELECT l_orderkey % 10 AS doc, CASE WHEN l_partkey % 3 = 0 THEN 14.0::DOUBLE ELSE 10.0 END AS size, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT doc, size AS body_size FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) = 1"),
    "asset_claims": (asset_claims, "SELECT o_orderkey % 20 AS doc, o_orderkey AS asset_id, min(s_suppkey) AS sec_ix FROM orders JOIN supplier ON o_orderkey % 20 = s_suppkey % 20 AND o_custkey % 30 = s_nationkey GROUP BY 1, 2"),
}
