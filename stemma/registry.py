"""All queries of the engine, gathered from its plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.plans import comparison, diffs, enrich, forms, links, measures, paragraphs, reviews, texts

MODULES = (paragraphs, texts, enrich, links, reviews, diffs, forms, measures, comparison)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
