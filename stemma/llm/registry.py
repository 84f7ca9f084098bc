"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import bpe, decontaminate, embeddings, html, jaccard, language, records, secrets, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_bpe": bpe.op2_bpe,
        "op3_language": language.op3_language,
        "op4_secrets": secrets.op4_secrets,
        "op5_records": records.op5_records,
        "op6_embeddings": embeddings.op6_embeddings,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_warc": warc.op8_warc,
        "op9_jaccard": jaccard.op9_jaccard,
        "op10_html": html.op10_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op8_warc": warc.ORACLE}
