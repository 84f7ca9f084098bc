"""Asking about the changes of a comparison, and what the answers are worth, from prompts to coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.editions import BY, ChangeSet
from stemma.functions.captions import extractive_summary
from stemma.functions.text import sentences
from stemma.operators import interpretation as it
from stemma.stages import kept


@dataclass(frozen=True)
class Interpretations:
    """Tables of an interpretation run."""

    prompts: DataFrame
    resolved: DataFrame
    rows: DataFrame
    review_queue: DataFrame
    coverage: DataFrame
    outcomes: DataFrame


def excerpts(found: ChangeSet) -> DataFrame:
    """(by..., old_excerpt, new_excerpt): the texts of a chapter's changes, as far as they are known."""
    texts = found.changes.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("change_ix", "old_text", "new_text"))).alias("t"))
    side = lambda e: F.array_join(F.transform("t", lambda c: F.coalesce(c[f"{e}_text"], F.lit(""))), " ").alias(f"{e}_excerpt")
    return texts.select(*BY, side("old"), side("new"))


def summaries(found: ChangeSet) -> DataFrame:
    """(by..., summary_old, summary_new) for chapters that nobody was asked about."""
    of = lambda e: extractive_summary(sentences(F.col(f"{e}_excerpt"))).alias(f"summary_{e}")
    return excerpts(found).select(*BY, of("old"), of("new"))


def interpret(found: ChangeSet, answers: DataFrame, model: str, language: str, title: str, scope: str = "core") -> Interpretations:
    """Interpretations from a table of answers (key, answer); requests without one are for export.

    Answers are parsed and merged per change; axes are checked against their vocabularies, quotes
    against the records, and both against what the comparison knows. Nothing is corrected.
    """
    asked = kept(it.prompts(found.changes, found.chapters, excerpts(found), scope=scope), "prompts")
    provider = it.FixtureProvider(answers, model, it.system_prompt(language, title))
    resolved = kept(provider.resolve(asked, strict=False), "answers")
    sizes = found.changes.groupBy(*BY).agg((F.max("change_ix") + 1).alias("n_changes"))
    merged = kept(it.merged_answers(resolved, sizes), "merged")
    facts = found.changes.select(*BY, "change_ix", "kind")
    said = it.check_axes(merged.select(*BY, "change_ix", "collisions", *(F.col(f"interpretation.{c}").alias(c) for c in ("semantic_status", "normative_direction", "affected_components", "indeterminate_reason", "change", "impact", "evidence", "confidence"))).join(facts, [*BY, "change_ix"]))
    guarded = kept(it.check_evidence(said, found.changes), "guarded")
    moves = found.changes.select(
        *BY, "change_ix", "kind", F.get("old_ids", F.lit(0)).alias("old_pid"), F.get("new_ids", F.lit(0)).alias("new_pid"), F.when(F.col("kind") == "moved_away", F.col("moved_to")).alias("moved_to"),
        F.when(F.col("kind") == "moved_in", F.col("moved_from")).alias("moved_from"), F.coalesce("modality.new", "modality.old").alias("modality"),
    )
    rows = kept(it.check_consistency(guarded.withColumn("reported", F.lit(False)), moves), "interpretations")
    flags = {"evidence_ok": F.col("evidence_ok"), "change_index_disputed": F.col("change_index_disputed"), "axis_partner_disagreement": F.size("axis_partner_disagreement") > 0, "successor_named": F.col("successor_named")}
    queue = rows.withColumn("review_reasons", it.review_reasons(flags)).filter(F.size("review_reasons") > 0).select(*BY, "change_ix", "review_reasons")
    total = found.changes.count()
    return Interpretations(asked, resolved, rows, queue, it.coverage_report(asked, merged, total), it.outcome_counts(resolved))
