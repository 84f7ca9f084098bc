"""Queries over normal forms, sections and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import text as forms
from stemma.functions.keywords import topics
from stemma.operators import joins
from stemma.operators.align import mapping_id, qualified_name
from stemma.plans.paragraphs import PARAGRAPHS_SQL, edition_paragraphs, table


def normalize_n2_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(forms.n2(F.col("text")).cast("binary")).alias("n2_md5"))


def compare_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = forms.compare_key(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(key.cast("binary")).alias("key_md5"), F.length(key).cast("long").alias("key_length"))


def garbage_ratio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.round(forms.garbage_ratio(F.col("text")), 9)
    rows = table(spark, sf_dir, "documents").select("lang", ratio.alias("r"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("max_ratio"), F.count_if(F.col("r") > 0.4).alias("n_garbage"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(forms.sentences(forms.n2(F.col("text")))).cast("long").alias("n_sentences"))


def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character 3- and 4-grams of the items, most frequent first (ties by gram)."""
    items = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("t"))
    grams = items.select(F.explode(forms.char_ngrams(F.col("t"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(50)


#: Documents whose rows are ranked together.
SLICE = 1024


def qualified_section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents with the language as section id; a source may hold much of the table."""
    sections = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("lang").alias("section_id"), F.floor(F.col("doc_id") / SLICE).alias("slice"))
    rows = joins.ranked(sections, ["source", "section_id"], "slice", ["doc_id"])
    return rows.select("doc_id", qualified_name(F.col("section_id"), F.col("rank"), F.col("total")).alias("qualified_id"))


def mapping_id_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    side = lambda rest: F.collect_set(F.when(F.col("l_linenumber") % 2 == rest, F.col("l_partkey").cast("string")))
    sides = items.groupBy("l_orderkey").agg(side(0).alias("old_ids"), side(1).alias("new_ids"))
    return sides.select("l_orderkey", mapping_id(F.col("old_ids"), F.col("new_ids")).alias("mapping_id"))


SYLLABLES = {"alpha": ["the", "ing"], "beta": ["ung", "sch"], "gamma": ["ción", "mente"], "delta": ["eau", "tion"]}


def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(text, 1, 40).alias("title_key"), text.alias("text_key"), n_words.alias("n_words"))
    return topics(rows, SYLLABLES).select("doc_id", "topic", "hits", "score")


def paragraph_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new paragraphs per chapter; unbalanced if the sides differ by 60 % of at least 5."""
    rows = edition_paragraphs(table(spark, sf_dir, "documents")).withColumn("chapter", F.concat_ws("/", "chapter", (F.col("sec_ix") % 97).cast("string")))
    counts = rows.groupBy("chapter").agg(F.count_if(F.col("edition") == "old").alias("n_old"), F.count_if(F.col("edition") == "new").alias("n_new"))
    larger = F.greatest("n_old", "n_new")
    imbalance = F.round(F.abs(F.col("n_old") - F.col("n_new")) / larger, 4)
    return counts.select("chapter", "n_old", "n_new", imbalance.alias("imbalance"), (F.col("n_old") - F.col("n_new")).alias("surplus"), ((imbalance >= 0.6) & (larger >= 5)).alias("unbalanced"))


def balance_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraph_balance(spark, sf_dir)
    decile = F.least(F.floor(F.col("imbalance") * 10), F.lit(9)).cast("long")
    return rows.groupBy(decile.alias("decile")).agg(F.count(F.lit(1)).alias("n_chapters"))


def anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th old and the k-th new paragraph of a key.

    Ranks are unique per side, so the group of (key, rank) holds a pair at most, and a line that
    is common in all documents is ranked in slices.
    """
    rows = edition_paragraphs(table(spark, sf_dir, "documents"))
    key = forms.compare_key(F.col("n0"))
    keyed = rows.select("edition", "chapter", "sec_ix", "par_ix", F.md5(key.cast("binary")).alias("k"), F.floor(F.col("sec_ix") / SLICE).alias("slice")).filter(key != "")
    placed = joins.ranked(keyed, ["chapter", "k", "edition"], "slice", ["sec_ix", "par_ix"])
    old = placed.filter("edition = 'old'").select("chapter", "k", "rank", F.col("sec_ix").alias("old_sec"), F.col("par_ix").alias("old_par"))
    new = placed.filter("edition = 'new'").select("chapter", "k", "rank", F.col("sec_ix").alias("new_sec"), F.col("par_ix").alias("new_par"))
    return old.join(new, ["chapter", "k", "rank"]).drop("k").select("chapter", "rank", "old_sec", "old_par", "new_sec", "new_par")


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edition_paragraphs(table(spark, sf_dir, "documents"))
    return rows.groupBy("edition", "chapter").agg(
        F.countDistinct("sec_ix").alias("n_sections"), F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("n0")).alias("n_chars"), F.max(F.length("n0")).cast("long").alias("longest")
    )


#: The SQL twin of n2; `{t}` is the text. SQL doubles single quotes in its literals.
_QUOTED = "'" + '"' * 3 + "''" * 3 + '"' * 2 + "---'"
_N2 = (
    r"regexp_replace(regexp_replace(translate(replace(regexp_replace(regexp_replace(replace(translate(regexp_replace("
    r"{t}, '[^\x{0}-\x{24F}\x{370}-\x{3FF}\x{1E00}-\x{1EFF}\x{2000}-\x{27BF}]+', '…', 'g'), chr(10) || chr(9) || chr(8208) || chr(8209) || chr(160), '  -- '), chr(173), ''),"
    r" '([a-zäöüß])-\s+((?:und|oder|bzw|sowie|als)(?:[^\p{L}\p{N}_]|$))', '\1' || chr(1) || '\2', 'g'),"
    r" '([a-zäöüß])-\s+([a-zäöüß])', '\1\2', 'g'), chr(1), '- '), '„“”‚‘’«»–—−', " + _QUOTED + r"), '\s+', ' ', 'g'), '^ | $', '', 'g')"
)

QUERIES = {
    "normalize_n2_hash": (normalize_n2_hash, "SELECT doc_id, md5(" + _N2.replace("{t}", "text") + ") AS n2_md5 FROM documents"),
    "compare_key_hash": (
        compare_key_hash,
        """WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^0-9a-zäöüß%<>≤≥=+]+', '', 'g') AS k FROM documents)
SELECT doc_id, md5(k) AS key_md5, length(k) AS key_length FROM k""",
    ),
    "garbage_ratio_stats": (
        garbage_ratio_stats,
        r"""WITH v AS (SELECT lang, regexp_replace(text, '\s+', '', 'g') AS v FROM documents),
r AS (SELECT lang, CASE WHEN length(v) = 0 THEN 0 ELSE round(length(regexp_replace(v, '[\x{0}-\x{24F}\x{370}-\x{3FF}\x{1E00}-\x{1EFF}\x{2000}-\x{27BF}\x{1D400}-\x{1D7FF}]+', '', 'g')) / length(v), 9) END AS r FROM v)
SELECT lang, count(*) AS n, max(r) AS max_ratio, count(*) FILTER (r > 0.4) AS n_garbage FROM r GROUP BY lang""",
    ),
    "sentence_counts": (sentence_counts, None),
    "char_ngram_counts": (
        char_ngram_counts,
        """WITH t AS (SELECT ' ' || lower(text) || ' ' AS t FROM benchmark),
g AS (SELECT unnest(list_transform(generate_series(1, length(t) - 2), lambda i: substring(t, i, 3))) AS gram FROM t
  UNION ALL SELECT unnest(list_transform(generate_series(1, length(t) - 3), lambda i: substring(t, i, 4))) FROM t)
SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 50""",
    ),
    "qualified_section_ids": (
        qualified_section_ids,
        """WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source, lang) AS c FROM documents)
SELECT doc_id, CASE WHEN c > 1 THEN lang || '#' || n ELSE lang END AS qualified_id FROM s""",
    ),
    "mapping_id_build": (
        mapping_id_build,
        """WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber % 2 = 0)) AS o,
  list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber % 2 = 1)) AS n FROM lineitem GROUP BY l_orderkey),
j AS (SELECT l_orderkey, coalesce(o, []) AS o, coalesce(n, []) AS n FROM s)
SELECT l_orderkey,
  CASE WHEN len(n) > 3 THEN array_to_string(n[1:3], '+') || '+~' || substring(sha1(array_to_string(n, '+')), 1, 8) ELSE array_to_string(n, '+') END || '<' ||
  CASE WHEN len(o) > 3 THEN array_to_string(o[1:3], '+') || '+~' || substring(sha1(array_to_string(o, '+')), 1, 8) ELSE array_to_string(o, '+') END AS mapping_id FROM j""",
    ),
    "keyword_density": (
        keyword_density,
        "WITH d AS (SELECT doc_id, lower(text) AS t, substring(lower(text), 1, 40) AS title, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS n FROM documents), k AS ("
        + " UNION ALL ".join(
            f"SELECT doc_id, n, '{name}' AS topic, "
            + " + ".join(f"(length(t) - length(replace(t, '{x}', ''))) // {len(x)}" for x in terms)
            + " AS hits, "
            + " OR ".join(f"contains(title, '{x}')" for x in terms)
            + " AS in_title FROM d"
            for name, terms in SYLLABLES.items()
        )
        + "), s AS (SELECT *, round(hits * 1000.0::DOUBLE / greatest(n, 1) + CASE WHEN in_title THEN 5.0 ELSE 0.0 END, 2) AS score FROM k) SELECT doc_id, topic, hits, score FROM s WHERE (score >= 1.2 AND hits >= 2) OR in_title",
    ),
    "paragraph_balance": (paragraph_balance, None),
    "balance_deciles": (balance_deciles, None),
    "anchor_pairs": (
        anchor_pairs,
        f"""WITH {PARAGRAPHS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY chapter, key, edition ORDER BY sec_ix, par_ix) AS rank FROM keyed WHERE key <> '')
SELECT o.chapter, o.rank, o.sec_ix AS old_sec, o.par_ix AS old_par, n.sec_ix AS new_sec, n.par_ix AS new_par
FROM r AS o JOIN r AS n ON o.chapter = n.chapter AND o.key = n.key AND o.rank = n.rank AND o.edition = 'old' AND n.edition = 'new'""",
    ),
    "doc_stats": (
        doc_stats,
        f"""WITH {PARAGRAPHS_SQL}
SELECT edition, chapter, count(DISTINCT sec_ix) AS n_sections, count(*) AS n_paragraphs, CAST(sum(length(n0)) AS BIGINT) AS n_chars, max(length(n0)) AS longest FROM paragraphs GROUP BY ALL""",
    ),
}
_BALANCE = f"""{PARAGRAPHS_SQL},
c AS (SELECT chapter || '/' || (sec_ix % 97) AS chapter, count(*) FILTER (edition = 'old') AS n_old, count(*) FILTER (edition = 'new') AS n_new FROM paragraphs GROUP BY 1),
b AS (SELECT *, round(abs(n_old - n_new) / greatest(n_old, n_new), 4) AS imbalance FROM c)"""
QUERIES["paragraph_balance"] = (paragraph_balance, f"WITH {_BALANCE} SELECT *, n_old - n_new AS surplus, imbalance >= 0.6 AND greatest(n_old, n_new) >= 5 AS unbalanced FROM b")
QUERIES["balance_deciles"] = (balance_deciles, f"WITH {_BALANCE} SELECT CAST(least(floor(imbalance * 10), 9) AS BIGINT) AS decile, count(*) AS n_chapters FROM b GROUP BY 1")
