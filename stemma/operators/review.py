"""Review rules, answer handling and prompt order over changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Blocks of a request, relocation, and surplus of an unbalanced chapter.
BLOCK, RELOCATION_TAU, OLD_SURPLUS, REMOVED_CHARS, FULL_CHARS = 40, 0.7, 5, 60, 2000
REASONS = ("possible_move", "relocated_outside_mapping", "missed_inside_mapping", "unbalanced_mapping")
# Closed vocabularies of the interpretation axes.
SEMANTIC_STATUS = ("equivalent", "clarified", "extended", "narrowed", "replaced", "contradictory", "indeterminate")
NORMATIVE_DIRECTION = ("tightened", "relaxed", "unchanged", "not_applicable", "indeterminate")
COMPONENTS = (
    "proof_obligation", "limit_value", "procedure", "deadline", "responsibility", "documentation", "scope", "definition", "reference", "formula", "note", "heading", "caption", "example", "none",
)
OPERATION = {"new": "added", "removed": "removed", "changed": "modified", "similar": "modified", "cosmetic": "modified", "merged": "merged", "split": "split", "moved_in": "moved", "moved_away": "moved", "identical": "unchanged"}


def priority(kind: Column, has_value: Column, shifted: Column, strong: Column, length: Column, equal: Column) -> Column:
    """What a change is worth asking about first."""
    score = F.when(has_value, 4.0).otherwise(0.0) + F.when(shifted, 3.0).otherwise(0.0)
    score = score + F.when(kind.isin("new", "removed") & strong, 3.0).otherwise(0.0) + F.when(kind.isin("moved_in", "moved_away"), 1.0).otherwise(0.0)
    return score + F.least(length, F.lit(FULL_CHARS)) / FULL_CHARS - F.when(equal, 5.0).otherwise(0.0)


def blocks(changes: DataFrame, by: str, score: str, order: str) -> DataFrame:
    """Place of each change by priority, and the request block of 40 it falls in."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), order))
    return changes.withColumn("place", place).withColumn("block", F.floor((F.col("place") - 1) / BLOCK))


def reasons(moved: Column, best: Column, in_mapping: Column, unbalanced: Column) -> Column:
    """Reasons to review a removal, in fixed order; the last never admits by itself."""
    found = F.array(
        F.when(moved, REASONS[0]),
        F.when((best >= RELOCATION_TAU) & ~in_mapping, REASONS[1]),
        F.when((best >= RELOCATION_TAU) & in_mapping, REASONS[2]),
        F.when(unbalanced, REASONS[3]),
    )
    return F.array_compact(found)


def admitted(found: Column) -> Column:
    return F.size(F.array_remove(found, REASONS[3])) > 0


def merge_answers(answers: DataFrame) -> DataFrame:
    """One answer per (chapter, change_index): that of the earliest block; collisions counted."""
    place = Window.partitionBy("chapter", "change_index").orderBy("block", "answer")
    every = Window.partitionBy("chapter", "change_index")
    rows = answers.withColumn("nth", F.row_number().over(place)).withColumn("collisions", F.count(F.lit(1)).over(every) - 1)
    return rows.filter("nth = 1").drop("nth")


def coverage(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """Per chapter: changes shown, interpreted, unanswered."""
    got = answered.groupBy("chapter").agg(F.countDistinct("change_index").alias("interpreted"))
    rows = asked.join(got, "chapter", "left").withColumn("interpreted", F.coalesce("interpreted", F.lit(0)))
    return rows.withColumn("unanswered", F.greatest(F.col("shown") - F.col("interpreted"), F.lit(0)))


def cache_key(model: Column, system: Column, user: Column) -> Column:
    return F.sha1(F.concat(model, F.lit("\x00"), system, F.lit("\x00"), user).cast("binary"))


def snapshot_verdict(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts by digest: same, differing, missing or added."""
    both = expected.withColumnRenamed("digest", "want").join(actual.withColumnRenamed("digest", "got"), "artifact", "full_outer")
    verdict = F.when(F.col("want").isNull(), "added").when(F.col("got").isNull(), "missing").when(F.col("want") == F.col("got"), "same").otherwise("differing")
    return both.select("artifact", verdict.alias("verdict"))
