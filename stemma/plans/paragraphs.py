"""Two editions from one table: paragraphs, anchors and what remains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.text import compare_key

KEY = "stemma_key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edition_paragraphs(documents: DataFrame) -> DataFrame:
    """Non-blank lines of even (old) and odd (new) documents; the language is the chapter."""
    lines = documents.select(
        F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("edition"),
        F.col("lang").alias("chapter"),
        F.col("doc_id").alias("sec_ix"),
        F.posexplode(F.split("text", "\n")).alias("par_ix", "n0"),
    )
    return lines.filter(F.length(F.trim("n0")) > 0)


def change_kinds(paragraphs: DataFrame) -> DataFrame:
    """Counts of identical, removed and new paragraphs per chapter.

    Per key the number of pairs is the smaller of the two counts, so partial counts are all
    that is shuffled: a key that holds a third of all rows costs one row per task.
    """
    keyed = paragraphs.select("chapter", "edition", compare_key(F.col("n0")).alias(KEY))
    is_old, is_new = (F.col("edition") == e for e in ("old", "new"))
    counts = keyed.groupBy("chapter", KEY).agg(F.count_if(is_old).alias("n_old"), F.count_if(is_new).alias("n_new"))
    same = F.when(F.col(KEY) == "", F.lit(0)).otherwise(F.least("n_old", "n_new"))
    kinds = counts.select("chapter", F.posexplode(F.array(same, F.col("n_old") - same, F.col("n_new") - same)).alias("k", "n"))
    name = F.element_at(F.array(F.lit("identical"), F.lit("removed"), F.lit("new")), F.col("k") + 1)
    return kinds.groupBy("chapter", name.alias("kind")).agg(F.sum("n").alias("n_paragraphs")).filter("n_paragraphs > 0")


def paragraph_change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_kinds(edition_paragraphs(table(spark, sf_dir, "documents")))


#: Lines of documents as paragraphs of two editions.
PARAGRAPHS_SQL = """
lines AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS edition, lang AS chapter,
         doc_id AS sec_ix, unnest(string_split(text, chr(10))) AS n0,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS par_ix
  FROM documents),
paragraphs AS (SELECT * FROM lines WHERE length(trim(n0, ' ')) > 0),
keyed AS (SELECT *, regexp_replace(lower(replace(replace(replace(replace(replace(replace(replace(n0,
         'ﬀ','ff'),'ﬁ','fi'),'ﬂ','fl'),'ﬃ','ffi'),'ﬄ','ffl'),'ﬅ','ft'),'ﬆ','st')), '[^0-9a-zäöüß%<>≤≥=+]+', '', 'g') AS key
  FROM paragraphs)"""

QUERIES = {
    "paragraph_change_kinds": (
        paragraph_change_kinds,
        f"""WITH {PARAGRAPHS_SQL},
counts AS (SELECT chapter, key, count(*) FILTER (edition = 'old') AS o, count(*) FILTER (edition = 'new') AS n FROM keyed GROUP BY ALL),
kinds AS (
  SELECT chapter, 'identical' AS kind, CASE WHEN key = '' THEN 0 ELSE least(o, n) END AS c FROM counts UNION ALL
  SELECT chapter, 'removed', o - CASE WHEN key = '' THEN 0 ELSE least(o, n) END FROM counts UNION ALL
  SELECT chapter, 'new', n - CASE WHEN key = '' THEN 0 ELSE least(o, n) END FROM counts)
SELECT chapter, kind, CAST(sum(c) AS BIGINT) AS n_paragraphs FROM kinds GROUP BY ALL HAVING sum(c) > 0""",
    ),
}
