"""What the deliverables show: statistics, dossiers, rows of tables, slides and lists, as DataFrames.

Writers only lay out what these hold. Changes are those of a comparison (`editions.compare`),
interpretations rows (by..., change_ix, axes, texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import values
from stemma.functions.captions import axis_marker, clip, first_names, location, section_location
from stemma.operators.review import REASONS

BY = ["pair_id", "mapping"]
# Columns of the change table, and how much a slide shows.
CSV_COLUMNS = (
    "section_id", "mapping_id", "chapter_title", "change_index", "change_kind", "structural_operation", "semantic_status", "normative_direction", "affected_components", "indeterminate_reason",
    "semantic_label", "obligation", "change", "impact", "evidence", "evidence_ok", "confidence", "section_old", "section_new",
)
AXES = ("structural_operation", "semantic_status", "normative_direction", "affected_components", "indeterminate_reason")
TOP_SLIDES, SLIDE_CHANGES, GROUP_ROWS, TOP_REFS, TOP_SLIDE_REFS, TOP_PAIRS = 22, 5, 14, 25, 12, 20


# ---------------------------------------------------------------- statistics


def section_rollup(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., modality_counts, refs_internal, refs_external) of enriched paragraphs of a section."""
    labels = paragraphs.select(*by, F.explode("labels").alias("label")).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    counts = labels.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("modality_counts"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    refs = paragraphs.groupBy(*by).agg(union("refs_internal"), union("refs_external"))
    return refs.join(counts, by, "left").withColumn("modality_counts", F.coalesce("modality_counts", F.create_map().cast("map<string,bigint>")))


def cell_values_total(cell_values: DataFrame, by: list[str]) -> DataFrame:
    """Values in table cells, which no diff of texts has looked at."""
    return cell_values.groupBy(*by).agg(F.sum(F.size("values")).alias("cell_values"))


def document_statistics(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., sections, paragraphs, characters, by part and by modality) of enriched paragraphs."""
    body = F.col("par_ix").isNotNull()
    totals = paragraphs.groupBy(*by).agg(F.countDistinct("sec_ix").alias("sections_total"), F.count_if(body).alias("paragraphs"), F.sum(F.when(body, F.length("n1")).otherwise(0)).alias("characters"))

    def spread(rows: DataFrame, key: str, name: str) -> DataFrame:
        counted = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    parts = spread(paragraphs.select(*by, "sec_ix", "part").distinct(), "part", "sections_by_part")
    return totals.join(parts, by, "left").join(spread(paragraphs.filter(body), "modality", "modality"), by, "left")


def top_references(paragraphs: DataFrame, by: list[str], n: int = TOP_REFS) -> DataFrame:
    """(by..., place, ref, n): the most frequent external references; ties in order of their first place."""
    each = paragraphs.select(*by, F.struct("sec_ix", "par_ix").alias("at"), F.posexplode("refs_external").alias("k", "ref"))
    counted = each.groupBy(*by, "ref").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "k")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).filter(F.col("place") <= n).select(*by, "place", "ref", "n")


def change_kinds(changes: DataFrame) -> DataFrame:
    return changes.groupBy("pair_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def value_changes(changes: DataFrame) -> DataFrame:
    """One row per changed value: chapter, section where it stands, both spellings, and the class."""
    each = changes.select(*BY, "change_ix", F.coalesce("section_new", "section_old").alias("section"), F.posexplode("kennwerte.changed").alias("k", "v"))
    return each.select(*BY, "change_ix", "k", "section", F.col("v.old.raw").alias("old"), F.col("v.new.raw").alias("new"), F.col("v.value_class").alias("value_class"))


def pair_statistics(changes: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row per pair: changes, chapters with changes, value changes, shifts, and changed parts."""
    shift = lambda s: F.count_if(F.col("modality.shift") == s)
    totals = changes.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_changes"), F.countDistinct("mapping").alias("n_chapters_with_changes"), F.sum(F.size("kennwerte.changed")).alias("n_value_changes"), shift("verschaerft").alias("n_tightened"), shift("gelockert").alias("n_relaxed")
    )
    moved = chapters.filter("part_changed").groupBy("pair_id").agg(F.array_sort(F.collect_list("mapping")).alias("part_changed_mappings"))
    return totals.join(moved, "pair_id", "left")


def build_statistics(paragraphs: DataFrame, changes: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row per pair: the statistics of both editions beside those of the comparison."""
    each = document_statistics(paragraphs, ["pair_id", "edition"])
    facts = [c for c in each.columns if c not in ("pair_id", "edition")]
    sides = {e: each.filter(F.col("edition") == e).select("pair_id", F.struct(*facts).alias(e)) for e in ("old", "new")}
    return sides["old"].join(sides["new"], "pair_id", "full_outer").join(pair_statistics(changes, chapters), "pair_id", "left")


# ---------------------------------------------------------------- per chapter


def dossier(chapters: DataFrame, changes: DataFrame, topics: DataFrame | None = None, interpretations: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """One row per chapter with all that is known of it: keywords, counts, value changes, and tables that
    are not the same.

    Keywords of the interpretation come first, then those of the section, each once.
    """
    counted = changes.groupBy(*BY).agg(F.count_if(F.col("kind") != "cosmetic").alias("n_changes"))
    moved = value_changes(changes).groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("change_ix", "k", "old", "new"))).alias("v"))
    rows = chapters.join(counted, BY, "left").join(moved, BY, "left").na.fill(0, ["n_changes"])
    words = [F.array().cast("array<string>")]
    if interpretations is not None:
        rows = rows.join(interpretations.select(*BY, F.col("keywords").alias("said_keywords")), BY, "left")
        words.append(F.coalesce("said_keywords", words[0]))
    if topics is not None:
        rows = rows.join(topics.groupBy(*BY).agg(F.transform(F.sort_array(F.collect_list(F.struct("score", "topic")), asc=False), lambda t: t["topic"]).alias("section_keywords")), BY, "left")
        words.append(F.coalesce("section_keywords", words[0]))
    if tables is not None:
        shown = tables.filter((F.col("kind") != "matched") | ~F.coalesce("identical", F.lit(False)))
        rows = rows.join(shown.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("kind", "old", "new", "rows_changed"))).alias("tables_diff")), BY, "left")
    pairs = F.coalesce(F.transform("v", lambda v: F.struct(v["old"].alias("old"), v["new"].alias("new"))), F.array().cast("array<struct<old:string,new:string>>"))
    return rows.withColumns({"value_changes": pairs, "keywords": F.array_distinct(F.concat(*words))}).drop("v", "said_keywords", "section_keywords")


def interpretation_chapters(interpretations: DataFrame, chapters: DataFrame) -> DataFrame:
    """Interpretations (pair_id, mapping_id, section_id, ...) with their chapter: by mapping, else by the
    section that a chapter is named after."""
    named = chapters.select("pair_id", F.col("mapping").alias("m"), "title", "chapter_ix", F.explode(F.array_distinct(F.array_compact(F.array("new_id", "old_id")))).alias("section"))
    by_section = named.groupBy("pair_id", F.col("section").alias("section_id")).agg(F.min_by(F.struct("m", "title"), "chapter_ix").alias("s"))
    by_mapping = chapters.select("pair_id", F.col("mapping").alias("mapping_id"), F.struct(F.col("mapping").alias("m"), "title").alias("d"))
    rows = interpretations.join(by_mapping, ["pair_id", "mapping_id"], "left").join(by_section, ["pair_id", "section_id"], "left")
    source = F.coalesce("d", "s")
    return rows.withColumns({"mapping": source["m"], "chapter_title": source["title"]}).drop("d", "s")


def change_rows(interpretations: DataFrame, chapters: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per interpretation with the columns of the change table as text, lists as lists.

    Chapters in their order, changes as answered (`place`); what is not known is empty.
    """
    rows = interpretation_chapters(interpretations, chapters)
    facts = changes.select(*BY, F.col("change_ix").alias("change_index"), F.col("kind").alias("change_kind"), "section_old", "section_new")
    rows = rows.join(facts, [*BY, "change_index"], "left").withColumn("mapping_id", F.coalesce("mapping_id", "mapping"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = set(rows.columns)
    parts = F.filter(F.coalesce("affected_components", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "")
    columns = [parts.alias(c) if c == "affected_components" else (text(c) if c in known else F.lit("")).alias(c) for c in CSV_COLUMNS]
    return rows.select("pair_id", "place", *columns)


def carries_axes(interpretations: DataFrame) -> bool:
    """Whether a run knows the axes at all: by its fields, not by what they say."""
    return any(a in interpretations.columns for a in AXES[1:4])


def component_view(interpretations: DataFrame) -> DataFrame:
    """(pair_id, component, direction, n, change_indices): what happened to which part of the rules."""
    named = F.filter(F.coalesce("affected_components", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "")
    parts = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("none")))
    each = interpretations.select("pair_id", F.explode(F.array_distinct(parts)).alias("component"), F.coalesce("normative_direction", F.lit("")).alias("direction"), F.struct("mapping", "change_ix").alias("at"))
    return each.groupBy("pair_id", "component", "direction").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("at")).alias("changes"))


def synopsis_rows(changes: DataFrame, chapters: DataFrame, interpretations: DataFrame | None = None) -> DataFrame:
    """Rows of the side-by-side synopsis, in document order: place, section, both texts, and what is said."""
    rows = changes.join(chapters.select(*BY, "chapter_ix", F.coalesce("new_id", "old_id").alias("head"), "title"), BY)
    shown = location(F.coalesce("section_old", F.lit("")), F.coalesce("section_new", F.lit("")), F.col("head"))
    out = rows.withColumns({"section": shown, "marker": F.lit("")})
    if interpretations is not None and carries_axes(interpretations):
        said = interpretations.select(*BY, "change_ix", axis_marker(F.coalesce("semantic_status", F.lit("")), F.coalesce("normative_direction", F.lit("")), F.coalesce("affected_components", F.array().cast("array<string>"))).alias("said"))
        out = out.join(said, [*BY, "change_ix"], "left").withColumn("marker", F.coalesce("said", F.lit(""))).drop("said")
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("chapter_ix", "change_ix"))
    return out.select("pair_id", place.alias("place"), "head", "title", "section", "kind", "old_text", "new_text", "marker")


def final_synopsis(dossiers: DataFrame) -> DataFrame:
    """Chapters of the final synopsis: the most relevant first, then by the id as text."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in {"high": 0, "medium": 1, "low": 2}.items() for x in kv)), F.col("training_relevance")), F.lit(3))
    return dossiers.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy(rank, F.coalesce("new_id", "old_id"))))


def parameter_groups(changed: DataFrame, chapters: DataFrame) -> DataFrame:
    """Lines of value changes for slides: numbers before spellings, GROUP_ROWS of each, the section where it is
    not the chapter's own. Values of one place come in their own order, smaller numbers first."""
    rows = changed.join(chapters.select(*BY, "chapter_ix", F.coalesce("new_id", "old_id").alias("head")), BY)
    group = F.when(F.coalesce(F.col("value_class").isin(*values.OPERATOR_CLASSES), F.lit(False)), "operators").otherwise("numbers")
    where = section_location(F.coalesce("section", F.lit("")), F.col("head"))
    line = F.concat(F.col("head"), F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""), F.lit(": "), F.concat_ws(" → ", "old", "new"))
    place = F.row_number().over(Window.partitionBy("pair_id", "group").orderBy("chapter_ix", "change_ix", "k", F.length("old"), "old", F.length("new"), "new", where))
    return rows.withColumns({"group": group, "line": line}).withColumn("place", place).filter(F.col("place") <= GROUP_ROWS).select("pair_id", "group", "place", "line")


def slides(dossiers: DataFrame, changes: DataFrame) -> DataFrame:
    """(pair_id, slide, head, title, lines): the chapters with most weight, up to TOP_SLIDES, each with its first
    SLIDE_CHANGES substantive changes.

    Weight: value changes count three, other changes one; ties by document order.
    """
    weight = 3 * F.size("value_changes") + F.col("n_changes")
    ranked = dossiers.filter("n_changes > 0").withColumn("slide", F.row_number().over(Window.partitionBy("pair_id").orderBy(weight.desc(), "chapter_ix"))).filter(F.col("slide") <= TOP_SLIDES)
    each = changes.filter("kind <> 'cosmetic'").withColumn("nth", F.row_number().over(Window.partitionBy(*BY).orderBy("change_ix"))).filter(F.col("nth") <= SLIDE_CHANGES)
    line = F.concat_ws(" ", F.concat(F.lit("["), F.col("kind"), F.lit("]")), clip(F.coalesce("new_text", "old_text"), 160))
    lines = each.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("l"))
    return ranked.join(lines, BY, "left").select("pair_id", "slide", F.coalesce("new_id", "old_id").alias("head"), "title", F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>")).alias("lines"))


def coverage_note(coverage: DataFrame) -> DataFrame:
    """(pair_id, note): one sentence per pair with unanswered changes, naming the first chapters; no row where
    all are answered."""
    sums = coverage.groupBy("pair_id").agg(F.sum("n_interpreted").alias("done"), F.sum("n_changes").alias("total"), F.sum("n_unanswered").alias("open"), F.array_sort(F.collect_list(F.when(F.col("incomplete"), F.col("mapping")))).alias("names"))
    percent = F.translate(F.format_string("%.1f", F.col("done") / F.col("total") * 100), ".", ",")
    text = F.concat(F.lit("UNVOLLSTÄNDIG: "), "done", F.lit(" von "), "total", F.lit(" Änderungen sind gedeutet ("), percent, F.lit(" %). Kapitel: "), first_names(F.col("names")))
    return sums.filter("open > 0").select("pair_id", text.alias("note"))


# ---------------------------------------------------------------- removals


def review_list(changes: DataFrame, balance: DataFrame) -> DataFrame:
    """Removals with evidence that they are elsewhere, in review order.

    Takes changes with relocation and, where an embedding pass ran, possible_move_to. The surplus
    of a chapter is a reason too, but never the only one.
    """
    rows = changes.filter("kind = 'removed'").join(balance.select(*BY, F.col("old_surplus").alias("surplus")), BY)
    possible = F.col("possible_move_to").isNotNull() if "possible_move_to" in changes.columns else F.lit(False)
    found = F.coalesce(F.col("relocation.best_score") >= 0.7, F.lit(False))
    inside = F.coalesce("relocation.in_mapping", F.lit(False))
    why = F.array_compact(F.array(F.when(possible, REASONS[0]), F.when(found & ~inside, REASONS[1]), F.when(found & inside, REASONS[2]), F.when(F.col("surplus") >= 5, REASONS[3])))
    rows = rows.withColumn("review_reasons", why).filter(F.size(F.array_remove("review_reasons", REASONS[3])) > 0)
    rank = F.when(F.array_contains("review_reasons", REASONS[0]), 0).when(F.array_contains("review_reasons", REASONS[1]), 1).otherwise(2)
    order = Window.partitionBy("pair_id").orderBy(rank, F.coalesce("relocation.best_score", F.lit(0.0)).desc(), F.col("surplus").desc(), "mapping", "old_ids")
    return rows.withColumn("place", F.row_number().over(order)).select("pair_id", "place", "mapping", "change_ix", "old_ids", "old_text", F.length("old_text").alias("chars"), "review_reasons", "relocation", "surplus")


def review_counts(entries: DataFrame) -> DataFrame:
    """Entries per pair, and how many carry each reason."""
    return entries.groupBy("pair_id").agg(F.count(F.lit(1)).alias("entries"), *(F.count_if(F.array_contains("review_reasons", r)).alias(r) for r in REASONS))


def strongest_pairs(pairs: DataFrame, by: list[str], n: int = TOP_PAIRS) -> DataFrame:
    """The strongest table pairs of (by..., old, new, score), each once with its best score."""
    best = pairs.groupBy(*by, "old", "new").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "old", "new"))
    return best.withColumn("place", place).filter(F.col("place") <= n)


def across_runs(rows: DataFrame, row: str, value: Column, runs: list[str], order: str | None = None) -> DataFrame:
    """A column per run (rows with `run`), rows in the order of the first run that has them, 0 where one has none."""
    first = F.min(F.struct(F.array_position(F.array(*map(F.lit, runs)), F.col("run")).alias("r"), F.col(order or row).alias("o")))
    ordered = rows.groupBy(row).agg(first.alias("first"))
    table = rows.groupBy(row).pivot("run", runs).agg(value).na.fill(0)
    return table.join(ordered, row).orderBy("first").drop("first")
