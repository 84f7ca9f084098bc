"""Measurements over finished comparisons: what removals became, and how sure the passes are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import n2, sentences
from stemma.operators import joins

BY = ["pair_id", "mapping"]
#: Parts of the range of values that are ranked by themselves.
SLICES = 1000
# What is too short to be judged, and the words by which free text says what a change is.
FRAGMENT_CHARS, FRAGMENT_WORDS = 25, 7
VOICES = {
    "voice_elsewhere": ["verschob", "verschieb", "übernommen", "übernahme", "überführt", "integriert", "ersetzt", "umplatzier", "an anderer stelle", "hierher", "fortgeführt", "umgestellt in"],
    "voice_present": [
        "inhaltlich unverändert", "inhaltlich identisch", "war aber zuvor", "war zuvor", "war aber bereits", "war bereits", "bereits vorhanden", "bleibt erhalten", "entspricht aber dem alten", "entspricht dem alten",
        "ist aber teil", "teil der fortgesetzten", "teil der unveränderten", "unverändert vorhanden", "weiterhin vorhanden", "unverändert enthalten",
    ],
    "voice_artefact": [
        "artefakt", "fragment", "extrakt", "verstümmelt", "platzhalter", "umbruch", "formatierung", "formatänderung", "aufzählungszeichen", "redaktionelle einleitung", "preprocessing", "überbleibsel",
        "diff-erkennung", "verschluckt", "erkennungsfehler",
    ],
    "voice_duplicate": ["duplikat", "doppelt", "identisch mit", "wiederholung", "zweimal"],
}
FORMAL = ("heading", "caption", "reference", "formula", "note")


def comparable(text: Column) -> Column:
    return F.lower(n2(F.coalesce(text, F.lit(""))))


def is_fragment(text: Column) -> Column:
    """Too short to prove anything: few letters, or a few words without a sentence end."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return (F.length(text) < FRAGMENT_CHARS) | ((words <= FRAGMENT_WORDS) & ~text.rlike(r"[.!?][)\"']?\s*$"))


def removal_audit(removed: DataFrame, new: DataFrame, chapters: DataFrame) -> DataFrame:
    """Removed texts by what became of them, with the section where they stand.

    Takes removed (by..., change_ix, text), new paragraphs (pair_id, sec_ix, section_id, par_ix, text)
    and chapters (by..., new_ids). falsch_positiv: it stands in its own chapter; verschiebung:
    elsewhere; kurzfragment: too short; else echt_entfallen. A text stands somewhere as one block,
    or with all its sentences in one section.
    """
    rows = removed.select(*BY, "change_ix", comparable(F.col("text")).alias("key"), F.transform(sentences(n2(F.col("text"))), F.lower).alias("s"))
    body = new.select("pair_id", "sec_ix", "section_id", "par_ix", comparable(F.col("text")).alias("t")).filter("t <> ''")
    whole = body.groupBy("pair_id", "sec_ix", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par_ix", "t"))), lambda p: p["t"]), " ").alias("key"))
    hosts = whole.select("pair_id", F.struct("sec_ix", "section_id").alias("id"), "key")
    judged = rows.filter(~is_fragment(F.col("key")))
    blocks = judged.select("pair_id", F.struct("mapping", "change_ix", F.lit(-1).alias("k")).alias("id"), "key")
    several = judged.filter(F.size("s") >= 2).select("pair_id", "mapping", "change_ix", F.posexplode("s").alias("k", "key")).select("pair_id", F.struct("mapping", "change_ix", "k").alias("id"), "key")
    met = joins.containing(blocks.unionByName(several), hosts, joins.GRAM, False, ["pair_id"]).select("pair_id", "part_id.*", F.col("host_id.section_id").alias("section"), F.col("host_id.sec_ix").alias("sec_ix"))
    need = judged.select(*BY, "change_ix", F.size("s").alias("n_sentences"))
    hits = met.groupBy(*BY, "change_ix", "section", "sec_ix").agg(F.max((F.col("k") < 0).cast("int")).alias("block"), F.countDistinct(F.when(F.col("k") >= 0, F.col("k"))).alias("n")).join(need, [*BY, "change_ix"])
    hits = hits.filter((F.col("block") == 1) | ((F.col("n_sentences") >= 2) & (F.col("n") == F.col("n_sentences"))))
    own = F.coalesce(F.array_contains("new_ids", F.col("section")), F.lit(False))
    placed = hits.join(chapters.select(*BY, "new_ids"), BY).groupBy(*BY, "change_ix").agg(F.min(F.struct((~own).alias("elsewhere"), "sec_ix", "section", (F.col("block") == 0).alias("scattered"))).alias("hit"))
    kind = F.when(is_fragment(F.col("key")), "kurzfragment").when(F.col("hit").isNull(), "echt_entfallen").when(F.col("hit.elsewhere"), "verschiebung").otherwise("falsch_positiv")
    out = rows.join(placed, [*BY, "change_ix"], "left")
    return out.select(*BY, "change_ix", kind.alias("verdict"), "hit.section", F.when(F.col("hit.scattered"), "saetze").when(F.col("hit").isNotNull(), "block").alias("found_as"))


def constellation(verdict: Column, found_as: Column, host_kind: Column, same_key: Column) -> Column:
    """Why a text that stands in its chapter was reported as removed."""
    return F.when(
        verdict == "falsch_positiv",
        F.when(found_as == "saetze", "satzumstellung").when(host_kind.isNull(), "sonstiges").when(host_kind == "new", "verpasste_paarung").when(same_key, "doppelvorkommen").otherwise("verschmelzung_2_zu_1"),
    )


def mapping_sections(mapping: Column) -> Column:
    """Every section id that a mapping id names on either side; digests are none."""
    return F.filter(F.split(mapping, r"[<+]"), lambda i: (i != "") & ~i.startswith("~"))


def candidate_circles(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """(by..., rule, section): the new sections in which a chapter's removals would be sought.

    A: the sections of its record; B: also those its id names; C: also all below its sections;
    D: B and C. Takes sections (pair_id, section_id) of the new edition.
    """
    known = sections.select("pair_id", F.col("section_id").alias("section")).distinct()
    own = chapters.select(*BY, F.explode("new_ids").alias("section")).join(known, ["pair_id", "section"])
    named = chapters.select(*BY, F.explode(mapping_sections(F.col("mapping"))).alias("section")).join(known, ["pair_id", "section"])
    steps = F.split("section", r"\.")
    above = known.select("pair_id", "section", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))).alias("head")).filter("head <> section")
    below = own.select(*BY, F.col("section").alias("head")).join(above, ["pair_id", "head"]).select(*BY, "section")
    reach = {"A": [own], "B": [own, named], "C": [own, below], "D": [own, named, below]}
    out = None
    for rule, frames in reach.items():
        for frame in frames:
            rows = frame.select(*BY, F.lit(rule).alias("rule"), "section")
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def simulate_circles(circles: DataFrame, relocated: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per rule: relocated removals it would reach, and the paragraphs it would compare more.

    Takes relocated (by..., change_ix, best_section) and sizes (pair_id, section, n_paragraphs).
    """
    reached = relocated.join(circles.withColumnRenamed("section", "best_section"), [*BY, "best_section"]).groupBy("rule").agg(F.countDistinct(*BY, "change_ix").alias("resolved"))
    per = circles.join(sizes, ["pair_id", "section"], "left").groupBy(*BY, "rule").agg(F.coalesce(F.sum("n_paragraphs"), F.lit(0)).alias("n"))
    least = per.filter("rule = 'A'").select(*BY, F.col("n").alias("n_least"))
    cost = per.join(least, BY, "left").groupBy("rule").agg(F.sum(F.col("n") - F.coalesce("n_least", F.lit(0))).alias("growth_total"), F.max("n").alias("circle_max"))
    return cost.join(reached, "rule", "left").na.fill(0, ["resolved"])


def signals(free_text: Column, own_index: Column, reported: Column, components: Column, change_text: Column, n_changes: Column) -> Column:
    """Sorted signals of an interpretation that calls a change without a counterpart equivalent."""
    low = F.lower(free_text)
    named = F.transform(F.regexp_extract_all(free_text, F.lit(r"(?iU)(?:änderung|index)\s*\[?\s*(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    place = r"(?U)(?:[Aa]bschnitt|[Aa]nhang|[Aa]bsatz|[Kk]apitel|[Bb]ild|[Tt]abelle|[Gg]leichung|[Uu]nterabschnitt|[Pp]unkt\w*)\s*[\[(]?\s*(?:\d|[A-Z](?:\b|\.))"
    words = F.size(F.filter(F.split(F.trim(change_text), r"(?U)\s+"), lambda w: w != ""))
    says = {voice: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)) for voice, terms in VOICES.items()}
    says["voice_artefact"] |= free_text.rlike(r"(?iU)\bals\s+(?:\S+\s+){0,3}?(?:erkannt|gelistet|geführt|gemeldet)\b")
    holds = {
        "feedback": reported,
        "names_change": F.exists(named, lambda n: (n >= 0) & (n < n_changes) & (n != own_index)),
        "names_place": free_text.rlike(place),
        "formal_component": (F.size(components) > 0) & F.forall(components, lambda c: c.isin(*FORMAL)),
        "fragment": (F.trim(change_text) == "") | (~F.trim(change_text).rlike(r"[.!?]$") & (words < 12)),
        **says,
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in holds.items()))))


def without_counterpart_group(found: Column) -> Column:
    """What such a record is: by its signals, the first rule that holds."""
    has = lambda *names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    claim, shape = has("voice_artefact", "voice_present", "feedback"), has("feedback", "fragment", "formal_component")
    return (
        F.when(has("voice_duplicate") & has("names_change"), "duplicate")
        .when(has("voice_elsewhere") & has("names_place", "names_change"), "relocation")
        .when(claim & shape, "torn")
        .when(F.size(found) == 0, "genuine")
        .otherwise("unclassified")
    )


def axis_migration(before: DataFrame, after: DataFrame, key: list[str], axis: str) -> DataFrame:
    """(before, after, n): how the values of an axis moved between two runs over one change set."""
    both = before.select(*key, F.col(axis).alias("before")).join(after.select(*key, F.col(axis).alias("after")), key)
    return both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def disagreement_signatures(pairs: DataFrame) -> DataFrame:
    """(signature, n) of (away_status, into_status, away_direction, into_direction) rows of moves."""
    part = lambda a, b: F.when(~F.col(a).eqNullSafe(F.col(b)), F.concat_ws(">", F.coalesce(a, F.lit("-")), F.coalesce(b, F.lit("-"))))
    signature = F.concat_ws(" | ", part("away_status", "into_status"), part("away_direction", "into_direction"))
    return pairs.select(signature.alias("signature")).filter("signature <> ''").groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def quantiles(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, least, q1, median, q3, most): quartiles by the exclusive method, at (n + 1) p.

    Values are ranked in slices of their range, so a group is not one task; positions between two
    values are interpolated, and kept within the data.
    """
    by = by or []
    v = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    low, high = v.agg(F.min("v"), F.max("v")).first()
    step = ((high or 0.0) - (low or 0.0)) / SLICES or 1.0
    sliced = v.withColumn("slice", F.floor((F.col("v") - F.lit(low or 0.0)) / F.lit(step)))
    ranked = joins.ranked(sliced, by, "slice", ["v"], "k", "n")

    def at(p: float) -> Column:
        place = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), (F.col("n") + 1) * F.lit(p)))
        first = F.floor(place)
        weight = F.when(F.col("k") == first, 1 - (place - first)).when(F.col("k") == first + 1, place - first).otherwise(0.0)
        return F.sum(F.col("v") * weight)

    return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.min("v").alias("least"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("v").alias("most"))


def nearest_rank(rows: DataFrame, value: str, p: float) -> DataFrame:
    """(n, value): the smallest value that a share p of all values does not exceed."""
    return rows.agg(F.count(value).alias("n"), F.expr(f"percentile_disc({p}) within group (order by `{value}`)").alias("value"))


def evidence_shares(guards: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, ok, strict, extracted): shares of interpretations whose quote holds, and how it was won."""
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return guards.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col("guard.ok")).alias("ok"), share(F.col("guard.strict")).alias("strict"), share(F.col("guard.extraction") != "roh").alias("extracted"))


def rechecked(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(outcome, n): verdicts that a new check saved, lost or kept."""
    both = before.select(*key, F.col("ok").alias("a")).join(after.select(*key, F.col("ok").alias("b")), key)
    outcome = F.when(F.col("a") == F.col("b"), "same").when(F.col("b"), "saved").otherwise("lost")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def balance_grid(balance: DataFrame, thresholds: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7, 0.8), sizes: tuple[int, ...] = (0, 3, 5, 10)) -> DataFrame:
    """(threshold, size, n, n_two_sided): chapters out of balance for every threshold and least size."""
    larger = F.greatest("n_old", "n_new")
    cells = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("size")) for t in thresholds for m in sizes))
    hit = balance.select("n_old", "n_new", F.explode(F.filter(cells, lambda c: (F.col("imbalance") >= c["threshold"]) & (larger >= c["size"]))).alias("c"))
    return hit.groupBy("c.threshold", "c.size").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("n_old") > 0) & (F.col("n_new") > 0)).alias("n_two_sided"))


def loudest(balance: DataFrame, n: int = 10) -> DataFrame:
    """The chapters with the largest surplus of old paragraphs."""
    return balance.orderBy(F.desc("old_surplus"), "pair_id", "mapping").limit(n)


def review_combinations(entries: DataFrame) -> DataFrame:
    """(reasons, n_reasons, n): review entries by the reasons they carry together."""
    return entries.groupBy(F.array_join("review_reasons", " + ").alias("reasons"), F.size("review_reasons").alias("n_reasons")).agg(F.count(F.lit(1)).alias("n"))


def snapshot(changes: DataFrame, chapters: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """(pair_id, metric, value): what a later run must not fall below without a reason."""
    kinds = changes.groupBy("pair_id", F.concat(F.lit("changes."), "kind").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    out = kinds.unionByName(chapters.groupBy("pair_id", F.lit("chapters").alias("metric")).agg(F.count(F.lit(1)).alias("value")))
    if guards is not None:
        out = out.unionByName(guards.groupBy("pair_id", F.lit("evidence_ok").alias("metric")).agg(F.count_if("guard.ok").alias("value")))
    return out


def snapshot_drops(before: DataFrame, after: DataFrame, hard: tuple[str, ...] = ("evidence_ok", "chapters")) -> DataFrame:
    """(pair_id, metric, before, after, dropped): metrics side by side; hard ones must not drop."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), ["pair_id", "metric"], "full_outer")
    return both.withColumn("dropped", F.col("metric").isin(*hard) & (F.coalesce("after", F.lit(0)) < F.coalesce("before", F.lit(0))))


def pairing_causes(left: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """(by..., table_id, cause): why a leftover table has no partner.

    Takes left (by..., table_id) and scores (pair_id, mapping, table_id, other_mapping, other_taken,
    score): displacement if its best partner of the chapter is taken; chapter_boundary if a partner
    stands in another chapter; else no_candidate.
    """
    good = scores.filter(F.col("score") >= least)
    inside = good.filter(F.col("mapping") == F.col("other_mapping")).groupBy(*BY, "table_id").agg(F.max(F.col("other_taken").cast("int")).alias("taken"))
    across = good.filter(F.col("mapping") != F.col("other_mapping")).select(*BY, "table_id").distinct().withColumn("across", F.lit(True))
    rows = left.join(inside, [*BY, "table_id"], "left").join(across, [*BY, "table_id"], "left")
    return rows.select(*BY, "table_id", F.when(F.col("taken") == 1, "displacement").when(F.col("across"), "chapter_boundary").otherwise("no_candidate").alias("cause"))


def apply_answer(text: str, indices: list[int]) -> dict:
    """An answer to be admitted for a request, or the reason why it is not (outcome and answer)."""
    import json

    try:
        answer = json.loads(text, strict=False)
    except ValueError:
        return {"outcome": "unparsable", "answer": None}
    said = answer.get("interpretations") if isinstance(answer, dict) else None
    if not isinstance(said, list):
        return {"outcome": "no_interpretations", "answer": None}
    got = [i.get("change_index") for i in said if isinstance(i, dict)]
    foreign = sorted({x for x in got if x not in indices}, key=str)
    if foreign:
        return {"outcome": f"foreign_indices:{foreign}", "answer": None}
    return {"outcome": "ok" if set(got) == set(indices) else "incomplete", "answer": answer}


def first_difference(old: bytes, new: bytes) -> int | None:
    """The first byte at which two artifacts differ; None if they are equal."""
    if old == new:
        return None
    size = min(len(old), len(new))
    return next((k for k in range(size) if old[k] != new[k]), size)


def structural_paths(old, new, path: str = "$", most: int = 5) -> list[str]:
    """Up to `most` paths at which two JSON trees differ, in the order of the old one."""
    found: list[str] = []
    todo = [(old, new, path)]
    while todo and len(found) < most:
        a, b, at = todo.pop(0)
        if isinstance(a, dict) and isinstance(b, dict):
            todo = [(a.get(k), b.get(k), f"{at}.{k}") for k in dict.fromkeys([*a, *b]) if a.get(k) != b.get(k)] + todo
        elif isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
            todo = [(x, y, f"{at}[{k}]") for k, (x, y) in enumerate(zip(a, b)) if x != y] + todo
        elif a != b:
            found.append(at)
    return found
