"""What is asked about changes, and how answers are held against the facts.

Prompts, answers and checks are tables and expressions; the call to a model is not part of
the engine, so answers come from a table keyed by the digest of what was asked. Every check
marks and none corrects, except that axis values outside their vocabulary become null and are
reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions.captions import change_sides, clip, clip_counted
from stemma.functions.text import let, n1, n2
from stemma.operators.review import BLOCK, COMPONENTS, NORMATIVE_DIRECTION, OPERATION, SEMANTIC_STATUS, cache_key, priority

# Codes of abstention, modal labels, and bounds of quotes and prompts.
INDETERMINATE, REASON_CODES = "indeterminate", ("no_evidence", "ambiguous_scope", "conflicting_signals", "outside_text")
MODAL = ("muss", "darf", "darf_nicht", "sollte", "kann")
SPAN, PROBE, SHORT_ASSET, ASSET_PREFIX, CELL = 15, 15, 8, 40, 3
CHANGE_CHARS, EXCERPT_CHARS, TABLE_ROWS, TABLE_CHARS, BLOCK_CHARS = 900, 1600, 40, 8000, 32000
#: Fields of an answer that the engine knows itself, whatever a model says.
OWNED = (
    "evidence_ok", "evidence_strict", "evidence_match_chars", "evidence_fragments", "evidence_unique", "evidence_span", "evidence_extraction",
    "change_index_best", "change_index_disputed", "structural_operation",
)
OWNED_CHAPTER = ("section_id", "mapping_id", "_source", "_changes_total", "_changes_interpreted")
OWNED_ASSET = (*OWNED[:7], "table_id", "values_checked", "values_found", "values_ok", "values_elsewhere")
REVIEW = ("contradiction_flag", "evidence_ok", "change_index_disputed", "axis_partner_disagreement", "successor_named")
BY = ["pair_id", "mapping"]


def structural_operation(kind: Column) -> Column:
    """Axis A: what happened to the text, from the kind of the change; null for an unknown kind."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in OPERATION.items() for x in kv)), kind)


def drop_owned(answer: Column, fields: tuple[str, ...] = OWNED) -> Column:
    """struct<kept, dropped> of an answer map without the fields that the engine owns, and those as found."""
    owned = lambda k, _: k.isin(*fields)
    return F.struct(F.map_filter(answer, lambda k, v: ~owned(k, v)).alias("kept"), F.array_sort(F.map_keys(F.map_filter(answer, owned))).alias("dropped"))


# ---------------------------------------------------------------- axes


def check_axes(rows: DataFrame) -> DataFrame:
    """Rows with checked axes and `violations`, an array of struct<field, value, reason>.

    Takes columns kind, semantic_status, normative_direction, affected_components (array) and
    indeterminate_reason. Abstaining needs a reason code, and a code needs an abstention.
    """
    fault = lambda field, value, reason: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(reason).alias("reason"))
    none = F.array().cast("array<struct<field:string,value:string,reason:string>>")
    valid, faults = {}, []
    for field, vocabulary in (("semantic_status", SEMANTIC_STATUS), ("normative_direction", NORMATIVE_DIRECTION)):
        value = F.col(field)
        valid[field] = F.when(value.isin(*vocabulary), value)
        missing = value.isNull() | (value == "")
        faults.append(F.when(missing, F.array(fault(field, value, "missing"))).when(~value.isin(*vocabulary), F.array(fault(field, value, "outside_vocabulary"))).otherwise(none))
    parts = F.col("affected_components")
    labelled = lambda c: c.isin(*COMPONENTS) | c.rlike(r"^other:\s*\S")
    admitted = F.filter(parts, lambda c: F.coalesce(labelled(c), F.lit(False)))
    foreign = F.transform(F.filter(parts, lambda c: ~F.coalesce(labelled(c), F.lit(False))), lambda c: fault("affected_components", c, "outside_vocabulary"))
    faults.append(F.when(parts.isNull() | (F.size(parts) == 0), F.array(fault("affected_components", F.lit(None), "missing"))).otherwise(foreign))
    said = F.nullif(F.trim("indeterminate_reason"), F.lit(""))
    code = F.when(said.isin(*REASON_CODES), said)
    faults.append(F.when(said.isNotNull() & code.isNull(), F.array(fault("indeterminate_reason", said, "outside_vocabulary"))).otherwise(none))
    abstains = {f: F.coalesce(v == INDETERMINATE, F.lit(False)) for f, v in valid.items()}
    any_abstains = abstains["semantic_status"] | abstains["normative_direction"]
    faults += [F.when(a & code.isNull(), F.array(fault(f, F.lit(INDETERMINATE), "reason_missing"))).otherwise(none) for f, a in abstains.items()]
    faults.append(F.when(~any_abstains & code.isNotNull(), F.array(fault("indeterminate_reason", code, "reason_without_abstention"))).otherwise(none))
    return rows.withColumns(
        {
            "structural_operation": structural_operation(F.col("kind")),
            **{f: F.when(~(abstains[f] & code.isNull()), v) for f, v in valid.items()},
            "affected_components": F.when(F.size(admitted) > 0, admitted),
            "indeterminate_reason": F.when(any_abstains, code),
            "violations": F.concat(*faults),
        }
    )


# ---------------------------------------------------------------- evidence

ELLIPSIS = r"\s*(?:\[\s*(?:…|\.\.\.)\s*\]|…|\.\.\.)\s*"
LABEL = r"(?i)^(?:alte fassung|neue fassung|alt|neu|vorher|nachher)(?::\s*|\s+[-–]\s+)"
#: Quotes after the quotation marks were unified: straight double, straight single, single guillemets.
QUOTED = rf"\"([^\"]{{{SPAN},}})\"|'([^']{{{SPAN},}})'|›([^›‹]{{{SPAN},}})‹"


def fragments(quote: Column) -> Column:
    """What stands between the ellipses of a quote."""
    return F.filter(F.transform(F.split(quote, ELLIPSIS), F.trim), lambda f: f != "")


def candidates(answer: Column) -> Column:
    """array<struct<span, mode>>: the whole answer, then what it puts in quotation marks, or the
    answer without its label if it quotes nothing."""
    one = lambda span, mode: F.struct(span.alias("span"), F.lit(mode).alias("mode"))

    def of(text: Column) -> Column:
        quoted = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), lambda q: F.trim(F.substring(q, F.lit(2), F.length(q) - 2)))
        spans = F.transform(F.filter(quoted, lambda q: F.length(q) >= SPAN), lambda q: one(q, "anfuehrung"))
        bare = F.trim(F.regexp_replace(text, LABEL, ""))
        labelled = F.when((F.size(quoted) == 0) & (bare != text) & (F.length(bare) >= SPAN), F.array(one(bare, "etikett"))).otherwise(F.array().cast("array<struct<span:string,mode:string>>"))
        return F.concat(F.array(one(text, "roh")), spans, labelled)

    return let(F.trim(n2(answer)), of)


def matched_chars(fragment: Column, hay: Column) -> Column:
    """Letters of the longest beginning of a fragment that stands in the text.

    Beginnings are nested, so the length is found bit by bit from the largest power of two that
    is not longer; a fragment that stands there whole is not cut at all.
    """
    bits = F.transform(F.sequence(F.least(F.floor(F.log2(F.length(fragment).cast("double"))), F.lit(30)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    fits = lambda n, b: (n + b <= F.length(fragment)) & F.contains(hay, F.substring(fragment, F.lit(1), n + b))
    found = F.aggregate(bits, F.lit(0), lambda n, b: F.when(fits(n, b), n + b).otherwise(n))
    return F.when(F.contains(hay, fragment), F.length(fragment)).otherwise(found)


def metrics(quote: Column, hay: Column) -> Column:
    """struct<strict, match_chars, fragments> of a quote in lower case."""

    def of(parts: Column) -> Column:
        return let(
            F.transform(parts, lambda f: F.struct(matched_chars(f, hay).alias("n"), F.length(f).alias("size"))),
            lambda m: F.struct(
                ((F.size(m) > 0) & F.forall(m, lambda x: x["n"] == x["size"])).alias("strict"), F.aggregate(m, F.lit(0), lambda s, x: s + x["n"]).alias("match_chars"), F.size(m).alias("fragments")
            ),
        )

    return let(fragments(quote), of)


def text_ok(quote: Column, hay: Column) -> Column:
    """The beginning of a quote stands in the record; a short one has to be the record."""
    short = (F.trim(hay) != "") & (quote == F.trim(hay))
    long = F.contains(hay, F.substring(quote, 1, PROBE)) | F.contains(hay, quote)
    return F.when(quote == "", F.lit(False)).when(F.length(quote) < PROBE, short).otherwise(long)


def asset_ok(quote: Column, hay: Column) -> Column:
    """A quote of a table or figure stands there, or all cells of a quoted row do."""
    cells = F.filter(F.transform(F.split(quote, r"\s*[|‖]\s*"), F.trim), lambda c: F.length(c) >= CELL)
    row = (F.size(cells) >= 2) & F.forall(cells, lambda c: F.contains(hay, c))
    return (F.length(quote) >= SHORT_ASSET) & (F.contains(hay, quote) | F.contains(hay, F.substring(quote, 1, ASSET_PREFIX)) | row)


def guarded(answer: Column, hay: Column, ok: Callable[[Column, Column], Column] = text_ok) -> Column:
    """struct<ok, strict, match_chars, fragments, span, extraction> of the first candidate that passes,
    else of the one that covers most."""

    def judged(c: Column) -> Column:
        return let(
            F.lower(c["span"]),
            lambda q: let(metrics(q, hay), lambda m: F.struct(ok(q, hay).alias("ok"), m["strict"].alias("strict"), m["match_chars"].alias("match_chars"), m["fragments"].alias("fragments"), c["span"].alias("span"), c["mode"].alias("extraction"))),
        )

    def best(all_: Column) -> Column:
        most = F.array_max(F.transform(all_, lambda r: r["match_chars"]))
        return F.coalesce(F.get(F.filter(all_, lambda r: r["ok"]), F.lit(0)), F.get(F.filter(all_, lambda r: r["match_chars"] == most), F.lit(0)))

    return let(F.transform(candidates(F.coalesce(answer, F.lit(""))), judged), best)


def haystack(*texts: Column) -> Column:
    """Texts as quotes are sought in them."""
    return F.lower(F.concat_ws(" ", *(n2(F.coalesce(t, F.lit(""))) for t in texts)))


def check_evidence(answers: DataFrame, changes: DataFrame) -> DataFrame:
    """Answers (by..., change_ix, evidence) with the guard's verdict and the record that fits best.

    Adds evidence (struct of `guarded` and unique) as `guard`, change_index_best and
    change_index_disputed; an index that names no record has an empty one.
    """
    hays = changes.select(*BY, F.col("change_ix").alias("ix"), haystack(F.col("old_text"), F.col("new_text")).alias("hay"))
    records = hays.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("ix", "hay"))).alias("records"))
    own = F.coalesce(F.get(F.filter("records", lambda r: r["ix"] == F.col("change_ix")), F.lit(0))["hay"], F.lit(""))
    rows = answers.join(records, BY, "left").withColumn("records", F.coalesce("records", F.array().cast("array<struct<ix:int,hay:string>>")))
    rows = rows.withColumn("guard", guarded(F.col("evidence"), own))
    quote = F.lower("guard.span")
    scored = F.transform("records", lambda r: let(metrics(quote, r["hay"]), lambda m: F.struct(r["ix"].alias("ix"), m["match_chars"].alias("n"), m["strict"].alias("strict"))))
    rows = rows.withColumn("scored", F.explode(F.array(scored))).drop("records")
    most = F.coalesce(F.array_max(F.transform("scored", lambda s: s["n"])), F.lit(0))
    first = F.get(F.filter("scored", lambda s: s["n"] == most), F.lit(0))["ix"]
    chosen = F.coalesce(F.get(F.filter("scored", lambda s: s["ix"] == F.col("change_ix")), F.lit(0))["n"], F.lit(-1))
    elsewhere = F.exists("scored", lambda s: s["strict"] & ~s["ix"].eqNullSafe(F.col("change_ix")))
    return rows.withColumns(
        {"change_index_best": F.when(most > 0, first), "change_index_disputed": (most > 0) & (most > chosen), "evidence_ok": F.col("guard.ok"), "evidence_unique": F.col("guard.strict") & ~elsewhere}
    ).drop("scored")


def review_reasons(flags: dict[str, Column]) -> Column:
    """Why an interpretation needs a look, in fixed order; evidence_ok counts where it is false."""
    return F.array_compact(F.array(*(F.when(F.coalesce(~flags[r] if r == "evidence_ok" else flags[r], F.lit(False)), F.lit(r)) for r in REVIEW if r in flags)))


# ---------------------------------------------------------------- values of tables


def resolve_table(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Items with the table they name: by its id, also within the name, else by a caption that only one
    table of the chapter has.

    Takes items (by..., item, table_ref, table) and tables (by..., table_id, caption, place).
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    named = F.trim(F.coalesce(F.nullif("table_ref", F.lit("")), F.nullif("table", F.lit("")), F.lit("")))
    sides = items.select(*BY, "item", named.alias("named")).join(tables.select(*BY, "table_id", "caption", "place"), BY)
    by_id = sides.filter((F.col("named") != "") & F.contains("named", F.col("table_id"))).groupBy(*BY, "item").agg(F.min_by("table_id", "place").alias("by_id"))
    same = sides.filter((norm(F.col("named")) != "") & (norm(F.col("named")) == norm(F.col("caption")))).groupBy(*BY, "item").agg(F.min("table_id").alias("by_caption"), F.count(F.lit(1)).alias("n"))
    found = items.join(by_id, [*BY, "item"], "left").join(same.filter("n = 1").drop("n"), [*BY, "item"], "left")
    return found.withColumn("table_id", F.coalesce("by_id", "by_caption")).drop("by_id", "by_caption")


def claimed_values(items: DataFrame) -> DataFrame:
    """(by..., item, table_id, side, base_unit, base_value) of items' value_changes (array of strings).

    The halves of an arrow belong to their editions; without one a value may stand on either.
    """
    from stemma.functions import values

    claims = items.select(*BY, "item", "table_id", F.explode("value_changes").alias("claim"))
    arrow = F.col("claim").rlike(r"-+>|=+>|→|➔|➝|»")
    sides = change_sides(F.col("claim"))
    halves = F.when(arrow, F.array(F.struct(F.lit("old").alias("side"), sides["old"].alias("text")), F.struct(F.lit("new").alias("side"), sides["new"].alias("text")))).otherwise(F.array(F.struct(F.lit("both").alias("side"), F.col("claim").alias("text"))))
    parts = claims.select(*BY, "item", "table_id", F.explode(halves).alias("h")).select(*BY, "item", "table_id", "h.side", n1(F.col("h.text")).alias("text"))
    return parts.withColumn("values", values.extract_cells(F.col("text"))).select(*BY, "item", "table_id", "side", F.explode("values").alias("v")).select(*BY, "item", "table_id", "side", "v.base_unit", "v.base_value")


def check_asset_values(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Items with values_checked, values_found, values_ok and values_elsewhere.

    cells are (by..., table_id, side, base_unit, base_value) rows. A table of one edition only
    answers for both. Values in other tables of the chapter count as elsewhere; items without a
    table stay unchecked (null).
    """
    known = cells.distinct()
    both_sides = known.groupBy(*BY, "table_id").agg(F.collect_set("side").alias("sides"))
    wide = known.join(both_sides, [*BY, "table_id"])
    reach = F.when(F.size("sides") == 1, F.array(F.lit("old"), F.lit("new"), F.lit("both"))).otherwise(F.array(F.col("side"), F.lit("both")))
    wide = wide.select(*BY, "table_id", F.explode(reach).alias("side"), "base_unit", "base_value").distinct()
    claims = claimed_values(items.filter("table_id is not null")).withColumn("claim", F.monotonically_increasing_id())
    hit = [F.col(f"c.{c}") == F.col(f"w.{c}") for c in (*BY, "side", "base_value")] + [F.col("c.base_unit").eqNullSafe(F.col("w.base_unit"))]
    met = claims.alias("c").join(wide.withColumnRenamed("table_id", "where").alias("w"), hit, "left")
    each = met.groupBy(*(F.col(f"c.{c}") for c in (*BY, "item", "table_id", "claim"))).agg(
        F.max(F.coalesce(F.col("where") == F.col("table_id"), F.lit(False)).cast("int")).alias("here"), F.max(F.col("where").isNotNull().cast("int")).alias("anywhere")
    )
    counts = each.groupBy(*BY, "item").agg(F.count(F.lit(1)).alias("values_checked"), F.sum("here").alias("values_found"), F.sum(F.col("anywhere") - F.col("here")).alias("values_elsewhere"))
    rows = items.join(counts, [*BY, "item"], "left")
    joined = F.col("table_id").isNotNull()
    n = {c: F.when(joined, F.coalesce(c, F.lit(0))) for c in ("values_checked", "values_found", "values_elsewhere")}
    return rows.withColumns({**n, "values_ok": F.when(joined, F.coalesce("values_checked", F.lit(0)) == F.coalesce("values_found", F.lit(0)))})


def values_reason(ok: Column, checked: Column, found: Column, elsewhere: Column) -> Column:
    """The one value reason of a failed item: all missing values stand in another table, or not."""
    other = (F.coalesce(elsewhere, F.lit(0)) > 0) & (F.coalesce(found, F.lit(0)) + elsewhere == checked)
    return F.when(ok == F.lit(False), F.when(other, "values_in_other_table").otherwise("values_ok"))


def asset_reasons(evidence_ok: Column, reason: Column) -> Column:
    return F.array_compact(F.array(F.when(evidence_ok == F.lit(False), F.lit("evidence_ok")), reason))


# ---------------------------------------------------------------- consistency

SUCCESSOR = r"(?iU)\b(?:nun|jetzt|nunmehr|k[uü]nftig|zuk[uü]nftig)\s+(?:in|nach)"
PLACE = r"\s+(?:Abschnitt|Kapitel|Anhang)\s+[A-Z]?\.?\d[\d.]*"


def successor_named(change: Column, impact: Column) -> Column:
    """Whether free text names the section that a rule moved to."""
    return F.concat_ws(" ", change, impact).rlike(SUCCESSOR + PLACE)


def successor_hint(change: Column, impact: Column) -> Column:
    return F.concat_ws(" ", change, impact).rlike(SUCCESSOR + r"\b")


def move_pairs(changes: DataFrame) -> DataFrame:
    """(pair_id, state, away, into): moves by the pointer of their old side.

    Takes (by..., change_ix, kind, old_pid, new_pid, moved_to, moved_from). paired: the target is
    a moved_in record (the first that holds it); unpaired: no pointer; dangling: the target is
    no moved_in record; orphan: a moved_in record whose source is no moved_away record.
    """
    here = F.struct("mapping", "change_ix")
    away = changes.filter("kind = 'moved_away'").select("pair_id", here.alias("away"), "moved_to", F.col("old_pid").alias("away_pid"))
    into = changes.filter("kind = 'moved_in'").select("pair_id", here.alias("into"), "moved_from", F.col("new_pid").alias("into_pid"))
    first = into.groupBy("pair_id", F.col("into_pid").alias("moved_to")).agg(F.min("into").alias("into"))
    sides = away.join(first, ["pair_id", "moved_to"], "left")
    state = F.when(F.col("moved_to").isNull(), "unpaired").when(F.col("into").isNull(), "dangling").otherwise("paired")
    sources = away.select("pair_id", F.col("away_pid").alias("moved_from")).distinct()
    orphans = into.filter("moved_from is not null").join(sources, ["pair_id", "moved_from"], "left_anti")
    return sides.select("pair_id", state.alias("state"), "away", "into").unionByName(orphans.select("pair_id", F.lit("orphan").alias("state"), F.lit(None).cast(sides.schema["away"].dataType).alias("away"), "into"))


def check_consistency(answers: DataFrame, changes: DataFrame) -> DataFrame:
    """Answers with the flags that the facts raise.

    Takes answers (by..., change_ix, structural_operation, semantic_status, normative_direction,
    change, impact, reported) and changes as `move_pairs` with modality (the label of the new side,
    else of the old one). axis_b_reported_as_artefact tells where the chapter itself reports the
    change as an artefact; partner_disagreement lists the axes on which both sides of a move differ.
    """
    pairs = move_pairs(changes).filter("state = 'paired'").select("pair_id", F.explode(F.array(F.struct(F.col("away").alias("own"), F.col("into").alias("other")), F.struct(F.col("into").alias("own"), F.col("away").alias("other")))).alias("p"))
    said = answers.select("pair_id", F.struct("mapping", "change_ix").alias("other"), F.struct("semantic_status", "normative_direction").alias("theirs"))
    partner = pairs.select("pair_id", "p.own", "p.other").join(said, ["pair_id", "other"]).groupBy("pair_id", "own").agg(F.min("theirs").alias("theirs"))
    rows = answers.withColumn("own", F.struct("mapping", "change_ix")).join(partner, ["pair_id", "own"], "left").drop("own")
    rows = rows.join(changes.select(*BY, "change_ix", "modality"), [*BY, "change_ix"], "left")
    differs = lambda axis: F.when(F.col("theirs").isNotNull() & ~F.col(axis).eqNullSafe(F.col(f"theirs.{axis}")), F.lit(axis))
    alone = (F.col("semantic_status") == "equivalent") & F.col("structural_operation").isin("added", "removed")
    flags = {
        "axis_partner_disagreement": F.array_compact(F.array(differs("semantic_status"), differs("normative_direction"))),
        "axis_b_contradicts_a": F.coalesce(alone, F.lit(False)),
        "axis_b_reported_as_artefact": F.coalesce(alone & F.col("reported"), F.lit(False)),
        "axis_c_contradicts_modality": F.coalesce(F.col("modality").isin(*MODAL) & (F.col("normative_direction") == "not_applicable"), F.lit(False)),
        "informative_with_direction": F.coalesce((F.col("modality") == "informativ") & F.col("normative_direction").isin("tightened", "relaxed"), F.lit(False)),
        "successor_named": F.coalesce((F.col("semantic_status") == "narrowed") & successor_named(F.col("change"), F.col("impact")), F.lit(False)),
    }
    return rows.withColumns(flags).drop("theirs", "modality")


def consistency_counts(flagged: DataFrame) -> DataFrame:
    """One row per pair: how often each flag was raised, and records with more than one."""
    disagrees = F.size("axis_partner_disagreement") > 0
    raised = disagrees.cast("int") + sum((F.col(c).cast("int") for c in ("axis_b_contradicts_a", "axis_c_contradicts_modality", "successor_named")), F.lit(0))
    return flagged.groupBy("pair_id").agg(
        (F.count_if(disagrees) / 2).cast("long").alias("n_partner_disagreement"), F.count_if(F.col("axis_b_contradicts_a") & ~F.col("axis_b_reported_as_artefact")).alias("n_axis_b_contradicts_a"),
        F.count_if("axis_b_reported_as_artefact").alias("n_axis_b_reported_as_artefact"), F.count_if("axis_c_contradicts_modality").alias("n_axis_c_contradicts_modality"),
        F.count_if("informative_with_direction").alias("n_informative_with_direction"), F.count_if("successor_named").alias("n_successor_named"), F.count_if(raised > 1).alias("n_multiple_flags"),
    )


# ---------------------------------------------------------------- prompts


def change_priority(changes: DataFrame) -> Column:
    """What a change is worth asking about first."""
    strong = F.col("modality.new").isin("muss", "darf_nicht") | F.col("modality.old").isin("muss", "darf_nicht")
    length = F.length(F.coalesce("old_text", F.lit(""))) + F.length(F.coalesce("new_text", F.lit("")))
    no = F.lit(False)
    return priority(F.col("kind"), F.size("kennwerte.changed") > 0, F.coalesce(F.col("modality.shift").isin("verschaerft", "gelockert"), no), F.coalesce(strong, no), length, F.coalesce("semantic_equal", no))


def blocks(changes: DataFrame) -> DataFrame:
    """Changes with their block of at most BLOCK; blocks hold changes by priority, in document order inside."""
    place = F.row_number().over(Window.partitionBy(*BY).orderBy(change_priority(changes).desc(), "change_ix"))
    return changes.withColumn("block", F.floor((place - 1) / BLOCK).cast("int"))


def change_block(texts_old: Column, texts_new: Column) -> Column:
    """One change as a prompt shows it; moves show the other side's text where it is known."""
    line = lambda condition, *parts: F.when(condition, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    m, refs = F.col("modality"), F.col("refs")
    signs = lambda sign, items, n: F.transform(F.slice(items, 1, n), lambda x: F.concat(F.lit(sign), x))
    raw = lambda side: F.transform(F.col(f"kennwerte.{side}"), lambda v: v["raw"])
    moved = F.transform("kennwerte.changed", lambda c: F.concat_ws(" → ", c["old"]["raw"], c["new"]["raw"]))
    known = F.concat(moved, signs("+", raw("added"), 6), signs("−", raw("removed"), 6))
    inner = F.slice(F.concat(signs("+", refs["internal_added"], 100), signs("−", refs["internal_removed"], 100)), 1, 10)
    outer = F.slice(F.concat(signs("+", refs["external_added"], 100), signs("−", refs["external_removed"], 100)), 1, 8)
    old, new = F.coalesce("old_text", texts_old), F.coalesce("new_text", texts_new)
    lines = [
        F.concat(F.lit("["), F.col("change_ix"), F.lit("] TYP="), F.col("kind")),
        F.coalesce(line(m["shift"].isNotNull(), "    Modalität: ", m["old"], " → ", m["new"], " (", m["shift"], ")"), line(m["new"].isNotNull(), "    Modalität (neu): ", m["new"]), line(m["old"].isNotNull(), "    Modalität (alt): ", m["old"])),
        line(F.size(known) > 0, "    Kennwerte: ", F.array_join(known, "; ")), line(F.size(inner) > 0, "    Querverweise (intern): ", F.array_join(inner, "; ")), line(F.size(outer) > 0, "    Referenzen: ", F.array_join(outer, "; ")),
        line(F.col("moved_from").isNotNull(), "    (hierher verschoben aus ", F.col("moved_from"), ")"),
        F.coalesce(line(F.col("moved_to").isNotNull(), "    (verschoben nach ", F.col("moved_to"), ")"), line(F.col("moved_to_chapter").isNotNull(), "    (verschoben nach Kapitel ", F.col("moved_to_chapter"), ")")),
        line(old.isNotNull(), "    ALT: ", clip(old, CHANGE_CHARS)), line(new.isNotNull(), "    NEU: ", clip(new, CHANGE_CHARS)),
    ]
    return F.concat_ws("\n", *lines)


def rendered_cells(cells: Column) -> Column:
    """Cell text of a table for a prompt, with notes on rows and letters left out."""
    rows = F.transform(F.slice(cells, 1, TABLE_ROWS), lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "))
    more = F.size(cells) - TABLE_ROWS
    body = F.concat(F.array_join(rows, " ‖ "), F.when(more > 0, F.concat(F.lit(" … (+"), more, F.lit(" Zeilen)"))).otherwise(""))
    over = F.length(F.trim(body)) - TABLE_CHARS
    return F.when(over > 0, F.concat(F.substring(F.trim(body), 1, TABLE_CHARS), F.lit(" … (gekürzt, +"), over, F.lit(" Zeichen)"))).otherwise(F.trim(body))


def prompt_tag(mapping: Column, block: Column) -> Column:
    """File-safe name of a request; later blocks of a chapter carry their number."""
    return F.concat(F.regexp_replace(mapping, r"(?U)[^\w.]", "_"), F.when(block > 0, F.concat(F.lit(".T"), block + 1)).otherwise(""))


def in_scope(changes: DataFrame, chapters: DataFrame, scope: str = "core") -> DataFrame:
    """Chapters that are asked about: in the core scope those with a substantive change or a changed part."""
    if scope != "core":
        return chapters
    substantive = changes.filter(~F.coalesce("semantic_equal", F.lit(False))).select(*BY).distinct()
    return chapters.join(substantive.withColumn("substantive", F.lit(True)), BY, "left").filter("substantive or part_changed").drop("substantive")


def prompts(changes: DataFrame, chapters: DataFrame, excerpts: DataFrame, assets: DataFrame | None = None, scope: str = "core") -> DataFrame:
    """(by..., block, tag, indices, user): one request per block of a chapter; an empty chapter in scope asks once.

    excerpts are (by..., old_excerpt, new_excerpt); assets (by..., assets) texts that travel with
    the first block; moves carry the other side's text if changes have partner_text.
    """
    partner = F.col("partner_text") if "partner_text" in changes.columns else F.lit(None).cast("string")
    shown = blocks(changes).withColumn("shown", change_block(F.when(F.col("kind") == "moved_in", partner), F.when(F.col("kind") == "moved_away", partner)))
    parts = shown.groupBy(*BY, "block").agg(F.array_sort(F.collect_list(F.struct("change_ix", "shown"))).alias("c"))
    totals = parts.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.size("c")).alias("n_changes"))
    heads = in_scope(changes, chapters, scope).join(totals, BY, "left").join(excerpts, BY, "left")
    rows = heads.join(parts, BY, "left").withColumn("block", F.coalesce("block", F.lit(0)))
    rows = rows.join(assets, BY, "left") if assets is not None else rows.withColumn("assets", F.lit(None).cast("string"))
    n = F.coalesce(F.size("c"), F.lit(0))
    part = F.when(F.col("block") > 0, F.concat(F.lit(", Teil "), F.col("block") + 1, F.lit(" von "), F.col("n_parts"))).otherwise("")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("KAPITEL "), F.coalesce("new_id", "old_id"), F.lit(" — "), F.coalesce("title", F.lit("")), F.lit("  (Teil: "), F.coalesce("part", F.lit("")), F.when(F.col("part_changed"), ", NORMATIV/INFORMATIV-STATUS GEÄNDERT!").otherwise(""), F.lit(")")),
        F.concat(F.lit("Kapitel-Modus: "), F.col("match_type"), F.lit("; nicht geänderte Absätze: "), F.coalesce("n_identical", F.lit(0))),
        F.lit("\nAUSZUG ALTE FASSUNG:"), F.coalesce(F.nullif(clip(F.col("old_excerpt"), EXCERPT_CHARS), F.lit("")), F.lit("(Kapitel existiert in der alten Fassung nicht)")),
        F.lit("\nAUSZUG NEUE FASSUNG:"), F.coalesce(F.nullif(clip(F.col("new_excerpt"), EXCERPT_CHARS), F.lit("")), F.lit("(Kapitel in der neuen Fassung entfallen)")),
        F.concat(F.lit("\nÄNDERUNGEN ("), n, F.lit(" von "), F.coalesce("n_changes", F.lit(0)), part, F.lit(", deterministisch ermittelt):")),
        F.array_join(F.transform("c", lambda c: c["shown"]), "\n"), F.when(F.col("block") == 0, clip_counted(F.col("assets"), BLOCK_CHARS)),
    )
    return rows.select(*BY, "block", prompt_tag(F.col("mapping"), F.col("block")).alias("tag"), F.coalesce(F.transform("c", lambda c: c["change_ix"]), F.array().cast("array<int>")).alias("indices"), text.alias("user"))


def system_prompt(language: str, title: str) -> str:
    """What a model is told before any chapter."""
    return f"Du vergleichst zwei Ausgaben von „{title}“. Antworte auf {language}, nur mit dem verlangten JSON, und belege jede Aussage mit einem wörtlichen Zitat aus ALT oder NEU."


# ---------------------------------------------------------------- answers

ANSWER = "struct<interpretations:array<struct<change_index:int,semantic_status:string,normative_direction:string,affected_components:array<string>,indeterminate_reason:string,change:string,impact:string,evidence:string,confidence:string>>>"


def parse_answer(text: Column, schema: str = ANSWER) -> Column:
    """struct<answer, outcome>: strict, then with raw control characters in strings; code fences go."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", "")

    def of(t: Column) -> Column:
        broken = "stemma_unreadable"
        typed = schema.replace("struct<", f"struct<{broken}:string,", 1)

        def read(**options: str) -> Column:
            return F.from_json(t, F.lit(typed) if False else typed, {"columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE", **options})

        return let(F.struct(read().alias("s"), read(allowUnquotedControlChars="true").alias("l")), lambda r: _outcome(r, broken, t))

    return let(bare, of)


def _outcome(r: Column, broken: str, text: Column) -> Column:
    strict, lenient = (x.isNotNull() & x[broken].isNull() & F.ltrim(text).startswith("{") for x in (r["s"], r["l"]))
    outcome = F.when(text.isNull(), "no_answer").when(strict, "ok").when(lenient, "repaired").otherwise("unparsable")
    return F.struct(F.when(strict, r["s"]).when(lenient, r["l"]).alias("answer"), outcome.alias("outcome"))


class FixtureProvider:
    """Frozen answers (key, answer) by the digest of model, system and user prompt."""

    def __init__(self, answers: DataFrame, model: str, system: str):
        self.answers, self.model, self.system = answers, model, system

    def keyed(self, asked: DataFrame) -> DataFrame:
        return asked.withColumn("key", cache_key(F.lit(self.model), F.lit(self.system), F.col("user")))

    def missing(self, asked: DataFrame) -> DataFrame:
        """Requests without an answer, for export."""
        return self.keyed(asked).join(self.answers.select("key"), "key", "left_anti")

    def resolve(self, asked: DataFrame, strict: bool = True) -> DataFrame:
        """Requests with the answer and what became of it; a missing key fails unless exported instead."""
        if strict and (lost := self.missing(asked).select("tag").head(3)):
            raise KeyError(f"no frozen answer for {', '.join(r['tag'] for r in lost)}")
        rows = self.keyed(asked).join(self.answers, "key", "left").withColumn("parsed", parse_answer(F.col("answer")))
        return rows.select(*asked.columns, "key", "parsed.answer", F.when(F.col("parsed.outcome") == "no_answer", "export").otherwise(F.col("parsed.outcome")).alias("outcome"))


PROVIDERS = {
    "anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY", "azure_openai": "AZURE_OPENAI_API_KEY", "google": "GOOGLE_API_KEY", "mistral": "MISTRAL_API_KEY", "groq": "GROQ_API_KEY",
    "together": "TOGETHER_API_KEY", "openrouter": "OPENROUTER_API_KEY", "openai_compatible": "OPENAI_API_KEY", "ollama": None,
}


def resolve_key(provider: str, environment: dict[str, str], key_file: str | None = None) -> str | None:
    """The key of a provider: its own variable, the general one, or a file; one provider needs none."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}")
    if PROVIDERS[provider] is None:
        return None
    found = environment.get(PROVIDERS[provider]) or environment.get("LLM_API_KEY")
    if not found and key_file:
        with open(key_file, encoding="utf-8") as f:
            found = f.read().strip()
    return found or None


def merged_answers(resolved: DataFrame, chapters: DataFrame) -> DataFrame:
    """(by..., change_ix, block, collisions, interpretation): the earliest block's answer for every change.

    Indices that name no change of the chapter are dropped; chapters are (by..., n_changes).
    """
    each = resolved.select(*BY, "block", F.posexplode("answer.interpretations").alias("at", "i")).withColumn("change_ix", F.col("i.change_index"))
    known = each.join(chapters.select(*BY, "n_changes"), BY).filter((F.col("change_ix") >= 0) & (F.col("change_ix") < F.col("n_changes")))
    place = Window.partitionBy(*BY, "change_ix").orderBy("block", "at")
    rows = known.withColumn("nth", F.row_number().over(place)).withColumn("collisions", F.count(F.lit(1)).over(Window.partitionBy(*BY, "change_ix")) - 1)
    return rows.filter("nth = 1").select(*BY, "change_ix", "block", "collisions", F.col("i").alias("interpretation"))


def outcome_counts(resolved: DataFrame) -> DataFrame:
    """Requests by what became of them; errors count by their kind before the colon."""
    return resolved.groupBy(F.split_part("outcome", F.lit(":"), F.lit(1)).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def truncation_report(notes: DataFrame) -> DataFrame:
    """One row of (kind, n_dropped) notes: how many tables and blocks there were, and how many were cut."""
    of = lambda kind, cut=False: F.count_if((F.col("kind") == kind) & ((F.col("n_dropped") > 0) | F.lit(not cut)))
    return notes.agg(of("table").alias("n_tables"), of("table", True).alias("n_tables_truncated"), of("asset_block").alias("n_asset_blocks"), of("asset_block", True).alias("n_asset_blocks_truncated"))


def coverage_report(asked: DataFrame, merged: DataFrame, n_changes_total: int) -> DataFrame:
    """Per chapter: changes that were shown, answered and not; with the share of all changes as text."""
    shown = asked.groupBy(*BY).agg(F.sum(F.size("indices")).alias("n_changes"), F.count(F.lit(1)).alias("n_requests"))
    done = merged.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_interpreted"), F.sum("collisions").alias("n_collisions"))
    rows = shown.join(done, BY, "left").na.fill(0, ["n_interpreted", "n_collisions"])
    return rows.withColumns({"n_unanswered": F.col("n_changes") - F.col("n_interpreted"), "incomplete": F.col("n_interpreted") < F.col("n_changes"), "n_changes_total": F.lit(n_changes_total)})


def german_percent(part: Column, whole: Column) -> Column:
    """A share in percent with one decimal behind a comma; of nothing, all."""
    return F.translate(F.format_string("%.1f", F.when(whole == 0, F.lit(100.0)).otherwise(part / whole * 100)), ".", ",")


def feedback(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(field, count, finding) rows, those at zero as well: a number that only shows when it is bad is not measured."""
    wording = {
        "axis_partner_disagreement": "interpreted move pair(s) disagree between their two sides", "axis_b_contradicts_a": "interpretation(s) call a change without a counterpart equivalent",
        "axis_c_contradicts_modality": "interpretation(s) call a change with a modal sentence non-normative", "informative_with_direction": "interpretation(s) give a direction to an informative change",
        "successor_named": "narrowed interpretation(s) name the section the rule moved to", "move_pointer": "moved_away record(s) point at a paragraph that is not moved_in", "move_pointer_orphan": "moved_in record(s) name a source that is not moved_away",
    }
    return spark.createDataFrame([(f, int(counts.get(f, 0)), f"{int(counts.get(f, 0))} {words}") for f, words in wording.items()], "field string, count long, finding string")
