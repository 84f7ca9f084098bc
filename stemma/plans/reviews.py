"""Queries over reviews, answers, statistics and audits; changes are built from real columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import interpretation, review
from stemma.plans.paragraphs import table


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("similar", "new", "removed", "moved_in", "identical"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("chapter"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ix"), "l_extendedprice", kind.alias("kind"),
        (F.col("l_discount") > 0.05).alias("has_value"), (F.col("l_tax") > 0.06).alias("shifted"), (F.col("l_returnflag") == "R").alias("strong"), (F.col("l_quantity") * 40).alias("length"),
    )


def change_priority_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir)
    score = review.priority(F.col("kind"), F.col("has_value"), F.col("shifted"), F.col("strong"), F.col("length"), F.col("kind") == "identical")
    rows = rows.withColumn("score", F.round(score, 6)).withColumn("tie", F.struct("ix", "l_extendedprice"))
    placed = review.blocks(rows, "chapter", "score", "tie")
    return placed.groupBy("chapter", "block").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("score").alias("least"))


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") == 1).alias("moved"), (F.col("l_discount") * 10).alias("best"), (F.col("l_partkey") % 2 == 0).alias("in_mapping"), (F.col("l_quantity") > 45).alias("unbalanced")
    )
    found = review.reasons(F.col("moved"), F.col("best"), F.col("in_mapping"), F.col("unbalanced"))
    return rows.select(F.array_join(found, "|").alias("reasons"), review.admitted(found).alias("admitted")).groupBy("reasons", "admitted").agg(F.count(F.lit(1)).alias("n"))


def merge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("chapter"), (F.col("l_partkey") % 40).alias("change_index"), F.col("l_linenumber").alias("block"), F.col("l_suppkey").cast("string").alias("answer"))
    merged = review.merge_answers(answers.distinct())
    return merged.groupBy("chapter").agg(F.count(F.lit(1)).alias("n_answers"), F.sum("collisions").alias("n_collisions"), F.sum("block").alias("sum_block"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 500).alias("chapter")).agg((F.count(F.lit(1)) + 5).alias("shown"))
    answered = table(spark, sf_dir, "lineitem").filter("l_quantity < 10").select((F.col("l_orderkey") % 500).alias("chapter"), (F.col("l_partkey") % 40).alias("change_index"))
    return review.coverage(asked, answered)


def axis_cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic status by normative direction, from event types and values; some abstain without a reason."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        pick((*review.SEMANTIC_STATUS, "odd"), F.col("event_id") % 8).alias("semantic_status"), pick((*review.NORMATIVE_DIRECTION, "odd"), F.col("user_id") % 6).alias("normative_direction"),
        F.array(F.lit("scope"), F.col("event_type")).alias("affected_components"), F.when(F.col("event_id") % 3 == 0, "outside_text").alias("indeterminate_reason"), F.lit("similar").alias("kind"),
    )
    checked = interpretation.check_axes(rows)
    return checked.groupBy(F.col("semantic_status").alias("status"), F.col("normative_direction").alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("violations")).alias("n_violations"))


def component_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.explode(F.array((F.col("doc_id") % 4).cast("string"), (F.col("doc_id") % 3).cast("string"))).alias("component"), F.when(F.col("quality") == 1, "tightened").otherwise("relaxed").alias("direction"))
    return labels.groupBy("component").pivot("direction", ["tightened", "relaxed"]).agg(F.count(F.lit(1))).na.fill(0)


def partner_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as moves: paired, unpaired, dangling, and orphans."""
    orders, null = table(spark, sf_dir, "orders"), F.lit(None).cast("string")
    base = [F.lit("p").alias("pair_id"), F.lit("m").alias("mapping"), F.col("o_orderkey").alias("change_ix")]
    source, target = F.concat(F.lit("o"), F.col("o_orderkey")), F.concat(F.lit("n"), F.col("o_custkey"))
    away = orders.filter("o_orderkey % 3 = 0").select(*base, F.lit("moved_away").alias("kind"), source.alias("old_pid"), null.alias("new_pid"), F.when(F.col("o_orderkey") % 5 != 0, target).alias("moved_to"), null.alias("moved_from"))
    into = orders.filter("o_orderkey % 2 = 0").select(*base, F.lit("moved_in").alias("kind"), null.alias("old_pid"), target.alias("new_pid"), null.alias("moved_to"), source.alias("moved_from"))
    return interpretation.move_pairs(away.union(into)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 9 + F.col("l_tax"), 6).alias("x"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at or above each threshold from 0.5 to 0.9, in one pass without a join."""
    steps = F.array(*(F.lit(t / 100) for t in range(50, 95, 5)))
    hit = _scores(spark, sf_dir).select(F.explode(F.filter(steps, lambda t: F.col("x") >= t)).alias("threshold"))
    return hit.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bins of 0.05; the top bin is closed; quotients are rounded before the floor."""
    bin_ = F.least(F.floor(F.round(F.col("x") / F.lit(0.05), 9)), F.lit(19))
    return _scores(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of empty bins between occupied ones, from the sorted array of 20 bins at most."""
    steps = table(spark, sf_dir, "lineitem").select(F.least(F.floor(F.round(F.col("l_discount") * 9 / F.lit(0.05), 9)), F.lit(19)).alias("bin"))
    bins = steps.agg(F.array_sort(F.collect_set("bin")).alias("b"))
    pairs = bins.select(F.explode(F.arrays_zip(F.slice("b", 1, F.greatest(F.size("b") - 1, F.lit(0))).alias("low"), F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0))).alias("high"))).alias("p"))
    return pairs.filter("p.high > p.low + 1").select((F.col("p.low") + 1).alias("first_empty"), (F.col("p.high") - 1).alias("last_empty"))


def snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    one = parts.filter("p_partkey % 11 <> 0").select(name.alias("artifact"), F.sha2(F.col("p_name").cast("binary"), 256).alias("digest"))
    two = parts.filter("p_partkey % 13 <> 0").select(name.alias("artifact"), F.sha2(F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).cast("binary"), 256).alias("digest"))
    return review.snapshot_verdict(one, two).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def prompt_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts whose frozen answer is missing: an anti-join on the digest of the request."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", review.cache_key(F.lit("m"), F.col("role"), F.col("text")).alias("key"))
    answers = turns.filter("turn % 2 = 0").select("key").distinct()
    return turns.join(answers, "key", "left_anti")


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.min(x).alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("median"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_extendedprice)").alias("p90"), F.max(x).alias("most"))


_CH = """ch AS (SELECT l_orderkey % 50 AS chapter, l_orderkey * 10 + l_linenumber AS ix, l_extendedprice, ['similar', 'new', 'removed', 'moved_in', 'identical'][l_partkey % 5 + 1] AS kind, l_discount > 0.05 AS v, l_tax > 0.06 AS s, l_returnflag = 'R' AS st, l_quantity * 40 AS len FROM lineitem),
sc AS (SELECT *, round(CASE WHEN v THEN 4.0::DOUBLE ELSE 0 END + CASE WHEN s THEN 3.0 ELSE 0 END + CASE WHEN kind IN ('new', 'removed') AND st THEN 3.0 ELSE 0 END + CASE WHEN kind = 'moved_in' THEN 1.0 ELSE 0 END + least(len, 2000) / 2000.0::DOUBLE - CASE WHEN kind = 'identical' THEN 5.0 ELSE 0 END, 6) AS score FROM ch)"""
_X = "x AS (SELECT round(l_discount * 9 + l_tax, 6) AS x FROM lineitem)"
_H = f"{_X}, h AS (SELECT CAST(least(floor(round(x / 0.05::DOUBLE, 9)), 19) AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1)"
_list = lambda xs: "['" + "', '".join(xs) + "']"

QUERIES = {
    "change_priority_blocks": (
        change_priority_blocks,
        f"WITH {_CH}, p AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY score DESC, ix, l_extendedprice) AS place FROM sc) SELECT chapter, (place - 1) // 40 AS block, count(*) AS n, max(score) AS best, min(score) AS least FROM p GROUP BY ALL",
    ),
    "review_reasons": (
        review_reasons,
        """WITH l AS (SELECT l_linenumber = 1 AS m, l_discount * 10 AS b, l_partkey % 2 = 0 AS i, l_quantity > 45 AS u FROM lineitem),
r AS (SELECT list_filter([CASE WHEN m THEN 'possible_move' END, CASE WHEN b >= 0.7 AND NOT i THEN 'relocated_outside_mapping' END, CASE WHEN b >= 0.7 AND i THEN 'missed_inside_mapping' END, CASE WHEN u THEN 'unbalanced_mapping' END], lambda x: x IS NOT NULL) AS r FROM l)
SELECT array_to_string(r, '|') AS reasons, len(list_filter(r, lambda x: x <> 'unbalanced_mapping')) > 0 AS admitted, count(*) AS n FROM r GROUP BY ALL""",
    ),
    "merge_answers": (
        merge_answers,
        """WITH a AS (SELECT DISTINCT l_orderkey % 300 AS chapter, l_partkey % 40 AS ix, l_linenumber AS block, CAST(l_suppkey AS VARCHAR) AS answer FROM lineitem),
m AS (SELECT chapter, ix, block, row_number() OVER (PARTITION BY chapter, ix ORDER BY block, answer) AS nth, count(*) OVER (PARTITION BY chapter, ix) - 1 AS c FROM a)
SELECT chapter, count(*) AS n_answers, CAST(sum(c) AS BIGINT) AS n_collisions, CAST(sum(block) AS BIGINT) AS sum_block FROM m WHERE nth = 1 GROUP BY chapter""",
    ),
    "coverage": (
        coverage,
        """WITH a AS (SELECT o_orderkey % 500 AS chapter, count(*) + 5 AS shown FROM orders GROUP BY 1), g AS (SELECT l_orderkey % 500 AS chapter, count(DISTINCT l_partkey % 40) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY 1)
SELECT chapter, shown, coalesce(n, 0) AS interpreted, greatest(shown - coalesce(n, 0), 0) AS unanswered FROM a LEFT JOIN g USING (chapter)""",
    ),
    "axis_cross_table": (
        axis_cross_table,
        f"""WITH e AS (SELECT {_list((*review.SEMANTIC_STATUS, 'odd'))}[event_id % 8 + 1] AS s, {_list((*review.NORMATIVE_DIRECTION, 'odd'))}[user_id % 6 + 1] AS d, event_type NOT IN {tuple(review.COMPONENTS)} AND NOT starts_with(event_type, 'other:') AS c, event_id % 3 = 0 AS r FROM events),
a AS (SELECT *, s = 'indeterminate' AS sa, d = 'indeterminate' AS da FROM e)
SELECT CASE WHEN s <> 'odd' AND (r OR NOT sa) THEN s END AS status, CASE WHEN d <> 'odd' AND (r OR NOT da) THEN d END AS direction, count(*) AS n,
  CAST(sum(CAST(s = 'odd' AS INT) + CAST(d = 'odd' AS INT) + CAST(c AS INT) + CAST(sa AND NOT r AS INT) + CAST(da AND NOT r AS INT) + CAST(r AND NOT sa AND NOT da AS INT)) AS BIGINT) AS n_violations FROM a GROUP BY 1, 2""",
    ),
    "component_pivot": (
        component_pivot,
        "WITH c AS (SELECT unnest([CAST(doc_id % 4 AS VARCHAR), CAST(doc_id % 3 AS VARCHAR)]) AS component, quality FROM labels) SELECT component, count(*) FILTER (quality = 1) AS tightened, count(*) FILTER (quality <> 1 OR quality IS NULL) AS relaxed FROM c GROUP BY component",
    ),
    "partner_disagreement": (
        partner_disagreement,
        """WITH a AS (SELECT 'o' || o_orderkey AS src, CASE WHEN o_orderkey % 5 <> 0 THEN 'n' || o_custkey END AS target FROM orders WHERE o_orderkey % 3 = 0), i AS (SELECT 'n' || o_custkey AS target, 'o' || o_orderkey AS src FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT CASE WHEN target IS NULL THEN 'unpaired' WHEN target IN (SELECT target FROM i) THEN 'paired' ELSE 'dangling' END AS state FROM a UNION ALL SELECT 'orphan' FROM i WHERE src NOT IN (SELECT src FROM a))
SELECT state, count(*) AS n FROM s GROUP BY state""",
    ),
    "threshold_sweep": (threshold_sweep, f"WITH {_X}, t AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]::DOUBLE[]) AS threshold) SELECT threshold, count(*) AS n FROM x, t WHERE x >= threshold GROUP BY threshold"),
    "score_histogram": (score_histogram, f"WITH {_H} SELECT bin, n FROM h"),
    "histogram_gaps": (histogram_gaps, "WITH h AS (SELECT DISTINCT CAST(least(floor(round(l_discount * 9 / 0.05::DOUBLE, 9)), 19) AS BIGINT) AS bin FROM lineitem), g AS (SELECT bin, lead(bin) OVER (ORDER BY bin) AS nx FROM h) SELECT bin + 1 AS first_empty, nx - 1 AS last_empty FROM g WHERE nx > bin + 1"),
    "snapshot_check": (
        snapshot_check,
        """WITH a AS (SELECT 'p' || p_partkey AS k, sha256(p_name) AS d FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT 'p' || p_partkey AS k, sha256(CASE WHEN p_size > 40 THEN p_name || '!' ELSE p_name END) AS d FROM part WHERE p_partkey % 13 <> 0)
SELECT CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'missing' WHEN a.d = b.d THEN 'same' ELSE 'differing' END AS verdict, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1""",
    ),
    "prompt_cache_keys": (
        prompt_cache_keys,
        "WITH t AS (SELECT conv_id, turn, sha1('m' || chr(0) || role || chr(0) || text) AS key FROM conversations) SELECT * FROM t WHERE key NOT IN (SELECT key FROM t WHERE turn % 2 = 0)",
    ),
    "score_quantiles": (
        score_quantiles,
        "SELECT l_returnflag, min(l_extendedprice) AS least, quantile_disc(l_extendedprice, 0.5) AS median, quantile_disc(l_extendedprice, 0.9) AS p90, max(l_extendedprice) AS most FROM lineitem GROUP BY 1",
    ),
}
