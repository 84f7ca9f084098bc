"""A readable digest of a document's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections and examples that a digest shows.
SECTIONS, EXAMPLES = 20, 8


def summary(paragraphs: DataFrame) -> DataFrame:
    """One row: sections, paragraphs, values, and labels by how often they come, of enriched rows."""
    body = paragraphs.filter("par_ix is not null")
    totals = paragraphs.agg(F.countDistinct("sec_ix").alias("sections"), F.count("par_ix").alias("paragraphs"), F.sum(F.when(F.col("par_ix").isNotNull(), F.size("values")).otherwise(0)).alias("n_values"))
    labels = body.groupBy("modality").agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("n", "modality")), asc=False).alias("l"))
    said = labels.select(F.array_join(F.transform("l", lambda x: F.concat(x["modality"], F.lit("="), x["n"])), ", ")).first()[0]  # one row of six labels at most
    return totals.withColumn("modality", F.lit(said))


def render(paragraphs: DataFrame, title: str = "") -> str:
    """The digest as text: totals, the first sections, and the first paragraphs with values."""
    t = summary(paragraphs).first()
    lines = [f"Document : {title}", f"Sections : {t['sections']}    Paragraphs: {t['paragraphs']}", f"Values   : {t['n_values']}", f"Modality : {t['modality']}", ""]
    heads = paragraphs.groupBy("sec_ix", "section_id", "title", "level").agg(F.count("par_ix").alias("n")).orderBy("sec_ix").limit(SECTIONS)
    lines += [f"  [L{r['level']}] {r['section_id']:12s} {(r['title'] or '')[:58]:58s} paras={r['n']}" for r in heads.collect()]
    shown = paragraphs.filter(F.size("values") > 0).orderBy("sec_ix", "par_ix").limit(EXAMPLES)
    for r in shown.select("section_id", "modality", "n1", F.transform("values", lambda v: v["raw"]).alias("raw")).collect():
        lines += [f"  {r['section_id']} [{r['modality']}] {' '.join(r['n1'].split())[:88]}", f"      values: {', '.join(r['raw'])}"]
    return "\n".join(lines)
