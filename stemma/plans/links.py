"""Queries over alignment: similarity, containment, relocation, tables, vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.text import compare_key, n3, word_trigrams
from stemma.operators import align, diff, joins, kernels
from stemma.plans.paragraphs import PARAGRAPHS_SQL, edition_paragraphs, table


#: Lines a text can have; an id is the text's number and the line's.
PLACES = 1 << 31


def _words(text):
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def tfidf_cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every even benchmark item the most similar odd one (ties: least id)."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), _words(F.col("text")).alias("terms"))
    scores = joins.tfidf_cosine(items.filter("id % 2 = 0"), items.filter("id % 2 = 1")).withColumn("score", F.round("score", 6))
    best = scores.groupBy("old_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "new_id")).alias("b"))
    return best.select("old_id", "b.new_id", F.round(-F.col("b.s"), 6).alias("score"))


def chapter_map_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of two editions by id, kept if their titles share enough words (Jaccard >= 0.55)."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") / 2).cast("long").alias("section_id"), (F.col("doc_id") % 2).alias("side"), F.array_distinct(_words(F.substring("text", 1, 60))).alias("title"))
    old, new = (docs.filter(F.col("side") == s).select("section_id", F.col("title").alias(n)) for s, n in ((0, "old_title"), (1, "new_title")))
    jaccard = F.size(F.array_intersect("old_title", "new_title")) / F.size(F.array_union("old_title", "new_title"))
    return old.join(new, "section_id").select("section_id", F.round(jaccard, 6).alias("title_sim")).withColumn("same", F.col("title_sim") >= 0.55)


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edition_paragraphs(table(spark, sf_dir, "documents")).filter("edition = 'new'")
    return rows.select((F.col("sec_ix") * PLACES + F.col("par_ix")).alias("id"), compare_key(F.col("n0")).alias("key"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.select((F.col("item_id") * PLACES + F.col("k")).alias("id"), compare_key(F.col("line")).alias("key"))


def absorbed_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.contained_in(_parts(spark, sf_dir), _hosts(spark, sf_dir), align.MIN_ABSORB)


def split_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.one_per_host(joins.contained_in(_parts(spark, sf_dir), _hosts(spark, sf_dir), align.MIN_SPLIT, strict=False))


def trigram_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items sought among documents by word trigrams."""
    grams = word_trigrams(F.regexp_replace(F.lower("text"), r"[^0-9a-zäöüßñáéíóúèêçà]+", " "))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), grams.alias("grams"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), grams.alias("grams"))
    return joins.best_coverage(items, docs)


def removed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark lines that documents no longer hold as a paragraph: where else they stand."""
    parts = _parts(spark, sf_dir).filter(F.length("key") >= align.MIN_ABSORB)
    hosts = _hosts(spark, sf_dir)
    exact = hosts.groupBy("key").agg(F.min("id").alias("exact_id"))
    inside = joins.contained_in(parts, hosts, align.MIN_ABSORB).withColumnRenamed("host_id", "inside_id")
    rows = parts.join(exact, "key", "left").join(inside, parts["id"] == inside["part_id"], "left")
    kind = F.when(F.col("exact_id").isNotNull(), "kept").when(F.col("inside_id").isNotNull(), "moved_into").otherwise("gone")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def evidence_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes (first lines of items) whose beginning stands in documents: how many hold it."""
    quote = F.lower(F.split("text", "\n")[0])
    parts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), quote.alias("quote")).filter(F.length("quote") >= 15)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("key"))
    starts = joins.containing(parts.select("id", F.substring("quote", 1, 15).alias("key")), docs, 15, strict=False)
    whole = joins.containing(parts.select("id", F.col("quote").alias("key")), docs, 15, strict=False).withColumn("whole", F.lit(True))
    rows = starts.join(whole, ["part_id", "host_id"], "left").groupBy(F.col("part_id").alias("item_id"))
    return rows.agg(F.countDistinct("host_id").alias("n_docs"), F.countDistinct(F.when(F.col("whole"), F.col("host_id"))).alias("n_whole"))


def change_index_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every conversation's first turn the later turn that shares most words with it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(_words(F.col("text"))).alias("w"))
    first = turns.filter("turn = 0").select("conv_id", F.col("w").alias("q"))
    scored = turns.filter("turn > 0").join(first, "conv_id").select("conv_id", "turn", F.size(F.array_intersect("w", "q")).alias("match"))
    best = scored.groupBy("conv_id").agg(F.min(F.struct((-F.col("match")).alias("m"), "turn")).alias("b"))
    return best.select("conv_id", F.when(F.col("b.m") < 0, F.col("b.turn")).alias("best_turn"), (-F.col("b.m")).cast("long").alias("n_words"))


def block_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "removed").when(F.col("l_quantity") < 30, "moved_away").otherwise("similar")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", kind.alias("kind"), F.when(kind == "moved_away", (F.col("l_partkey") % 2).cast("string")).alias("moved_to"))
    return align.continue_blocks(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"]).groupBy("kind", "moved_to").agg(F.count(F.lit(1)).alias("n"))


#: Vectors of one label that are compared at once.
VECTORS = 2048


def _label_products(spark: SparkSession, sf_dir: str, schema: str, of) -> DataFrame:
    """of(label, old ids, new ids, products) over all pairs of blocks of a label's old and new vectors."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    sizes = rows.groupBy("label", (F.col("vec_id") % 2).alias("side")).agg(F.ceil(F.count(F.lit(1)) / VECTORS).cast("int").alias("blocks"))
    sides = [sizes.filter(F.col("side") == s).select("label", F.col("blocks").alias(n)) for s, n in ((0, "blocks"), (1, "others"))]
    grid = sides[0].join(sides[1], "label")
    frames = []
    for s, own, other in ((0, "blocks", "others"), (1, "others", "blocks")):
        part = rows.filter(F.col("vec_id") % 2 == s).join(F.broadcast(grid.select("label", F.col(own).alias("blocks"), F.col(other).alias("n_other"))), "label")
        part = part.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
        same = [F.col(c).alias(c) for c in ("label", "vec_id", "embedding")]  # columns of their own on either side
        frames.append(part.select(*same, F.col("mine" if s == 0 else "other").alias("a"), F.col("other" if s == 0 else "mine").alias("b")))

    def pair(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(old) or not len(new):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        x, y = (np.stack(side["embedding"]).astype(np.float64) for side in (old, new))
        return of(key[0], old["vec_id"].to_numpy(), new["vec_id"].to_numpy(), np.round(x @ y.T, 6))

    return frames[0].groupBy("label", "a", "b").cogroup(frames[1].groupBy("label", "a", "b")).applyInPandas(pair, schema)


def mutual_best_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new vectors of one label that are each other's best by cosine, from 0.2 on.

    Blocks of a label give the best of each of their vectors; only these meet again.
    """

    def best(label, old, new, score) -> pd.DataFrame:
        rows = []
        for ids, others, s, side in ((old, new, score, 0), (new, old, score.T, 1)):
            order = np.argsort(others, kind="stable")  # among equals the least id
            at = order[s[:, order].argmax(1)]
            rows.append(pd.DataFrame({"side": side, "id": ids, "other": others[at], "score": s[np.arange(len(ids)), at]}))
        return pd.concat(rows)

    found = _label_products(spark, sf_dir, "side int, id long, other long, score double", best)
    top = found.groupBy("side", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "other")).alias("b")).select("side", "id", "b.other", (-F.col("b.s")).alias("score"))
    old, new = (top.filter(F.col("side") == s).drop("side") for s in (0, 1))
    both = old.alias("o").join(new.alias("n"), (F.col("o.id") == F.col("n.other")) & (F.col("o.other") == F.col("n.id")))
    return both.filter("o.score >= 0.2").select(F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"), F.col("o.score").alias("score"))


def cosine_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of old and new vectors by label: how many, how many close, and the best."""

    def count(label, old, new, score) -> pd.DataFrame:
        return pd.DataFrame([(label, score.size, int((score >= 0.3).sum()), float(score.max()))], columns=["label", "n_pairs", "n_close", "best"])

    found = _label_products(spark, sf_dir, "label int, n_pairs long, n_close long, best double", count)
    return found.groupBy("label").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_close").alias("n_close"), F.max("best").alias("best"))


def cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of parts as tables of five rows, even keys old and odd keys new, by position."""
    cells = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 10).alias("table_id"), F.floor(F.pmod("p_partkey", F.lit(10)) / 2).alias("row"), F.when(F.col("p_partkey") % 2 == 0, "old").otherwise("new").alias("edition"),
        F.posexplode(F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("col", "text"),
    )
    return diff.cell_changes(cells, ["table_id"]).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_changed"))


def formula_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula = F.concat(F.lit("x = "), (F.col("l_partkey") % 5).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "old").otherwise("new").alias("edition"), diff.formula_key(F.lit(None).cast("string"), formula).alias("key"))
    return diff.formulas_diff(rows, ["l_orderkey"]).select("l_orderkey", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    rows = parts.select(F.floor(F.col("p_partkey") / 40).alias("chapter"), "p_partkey", F.col("p_name").alias("caption"), F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("content"))
    return rows.withColumn("edition", F.when(F.col("p_partkey") % 2 == 0, "old").otherwise("new"))


def table_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a chapter paired by caption or content."""

    def pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p_partkey")
        old, new = (rows[rows["edition"] == e] for e in ("old", "new"))
        sides = [list(zip(x["caption"], x["content"])) for x in (old, new)]
        got = kernels.pair_tables(*sides)
        return pd.DataFrame([(key[0], int(old["p_partkey"].iloc[i]), int(new["p_partkey"].iloc[j]), s) for i, j, s in got], columns=["chapter", "old_id", "new_id", "score"])

    return _matrix(spark, sf_dir).groupBy("chapter").applyInPandas(pair, "chapter long, old_id long, new_id long, score double")


def hungarian_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of the paragraphs of each group of ten documents."""
    docs = table(spark, sf_dir, "documents").withColumn("block", F.floor(F.col("doc_id") / 10))
    rows = docs.select("block", F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("edition"), "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "n0"))
    rows = rows.filter(F.length(F.trim("n0")) > 0).select("block", "edition", (F.pmod("doc_id", F.lit(10)) * 100_000_000 + F.col("k")).cast("int").alias("par_ix"), n3(F.col("n0")).alias("text"), compare_key(F.col("n0")).alias("key"))
    links = align.align_paragraphs(rows, ["block"])
    return links.groupBy("kind", "via").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"))


def moved_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves between the removed and new lines of each block of documents."""
    docs = table(spark, sf_dir, "documents").withColumn("block", F.floor(F.col("doc_id") / 20))
    rows = docs.select("block", (F.col("doc_id") % 2).alias("side"), "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "n0")).select("block", "side", "doc_id", "k", n3(F.col("n0")).alias("text"))

    def pair(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "k"])
        old, new = (group[group["side"] == s]["text"].tolist() for s in (0, 1))
        return pd.DataFrame([(key[0], i, j, s) for i, j, s in align.moved(old, new)], columns=["block", "old_ix", "new_ix", "score"])

    return rows.groupBy("block").applyInPandas(pair, "block long, old_ix int, new_ix int, score double")


def syntactic_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token diff of consecutive turns of a conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])

    @F.pandas_udf("chars_inserted long, chars_deleted long, chars_equal long, change_ratio double, n_ops long")
    def diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        found = [kernels.syntactic_diff(a, b) for a, b in zip(old, new)]
        return pd.DataFrame([(d["chars_inserted"], d["chars_deleted"], d["chars_equal"], d["change_ratio"], len(d["ops"])) for d in found], columns=["chars_inserted", "chars_deleted", "chars_equal", "change_ratio", "n_ops"])

    return pairs.select("conv_id", "turn", diff("text", "next").alias("d")).select("conv_id", "turn", "d.*")


_KEY = "regexp_replace(lower({t}), '[^0-9a-zäöüß%<>≤≥=+]+', '', 'g')"
_CONTAIN = f"""{PARAGRAPHS_SQL},
hosts AS (SELECT sec_ix * 2147483648 + par_ix AS id, key FROM keyed WHERE edition = 'new'),
lines2 AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM benchmark),
parts AS (SELECT item_id * 2147483648 + k AS id, {_KEY.format(t='line')} AS key FROM lines2)"""
_WORDS = "list_filter(string_split_regex(lower({t}), '\\s+'), lambda w: w <> '')"

QUERIES = {
    "tfidf_cosine_top1": (
        tfidf_cosine_top1,
        f"""WITH t AS (SELECT item_id AS id, item_id % 2 AS side, unnest({_WORDS.format(t='text')}) AS term FROM benchmark),
tf AS (SELECT side, id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT side, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
l AS (SELECT side, id, sqrt(sum(w * w)) AS l FROM w GROUP BY ALL),
u AS (SELECT side, id, term, w / l AS w FROM w JOIN l USING (side, id)),
s AS (SELECT a.id AS old_id, b.id AS new_id, round(sum(a.w * b.w), 6) AS score FROM u AS a JOIN u AS b ON a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT old_id, new_id, score FROM s QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) = 1""",
    ),
    "chapter_map_equi": (
        chapter_map_equi,
        f"""WITH d AS (SELECT doc_id // 2 AS section_id, doc_id % 2 AS side, list_distinct({_WORDS.format(t='substring(text, 1, 60)')}) AS title FROM documents),
p AS (SELECT a.section_id, len(list_intersect(a.title, b.title)) / len(list_distinct(a.title || b.title)) AS j FROM d AS a JOIN d AS b ON a.section_id = b.section_id AND a.side = 0 AND b.side = 1)
SELECT section_id, round(j, 6) AS title_sim, round(j, 6) >= 0.55 AS same FROM p""",
    ),
    "absorbed_containment": (absorbed_containment, f"WITH {_CONTAIN} SELECT p.id AS part_id, min(h.id) AS host_id FROM parts AS p JOIN hosts AS h ON contains(h.key, p.key) AND h.key <> p.key WHERE length(p.key) >= 20 GROUP BY p.id"),
    "split_containment": (
        split_containment,
        f"WITH {_CONTAIN}, f AS (SELECT p.id AS part_id, min(h.id) AS host_id FROM parts AS p JOIN hosts AS h ON contains(h.key, p.key) WHERE length(p.key) >= 40 GROUP BY p.id) SELECT min(part_id) AS part_id, host_id FROM f GROUP BY host_id",
    ),
    "trigram_relocation": (
        trigram_relocation,
        """WITH w AS (SELECT 'i' AS side, item_id AS id, list_filter(string_split(regexp_replace(lower(text), '[^0-9a-zäöüßñáéíóúèêçà]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM benchmark
  UNION ALL SELECT 'd', doc_id, list_filter(string_split(regexp_replace(lower(text), '[^0-9a-zäöüßñáéíóúèêçà]+', ' ', 'g'), ' '), lambda w: w <> '') FROM documents),
g AS (SELECT side, id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) ELSE [array_to_string(w, ' ')] END AS g FROM w),
e AS (SELECT side, id, len(g) AS n, unnest(g) AS g FROM g),
c AS (SELECT a.id AS old_id, b.id AS new_id, round(count(*) / any_value(a.n), 4) AS score FROM e AS a JOIN e AS b ON a.g = b.g AND a.side = 'i' AND b.side = 'd' GROUP BY a.id, b.id)
SELECT old_id, new_id, score AS best_score FROM c QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) = 1""",
    ),
    "removed_audit": (
        removed_audit,
        f"""WITH {_CONTAIN}, p AS (SELECT * FROM parts WHERE length(key) >= 20),
k AS (SELECT p.id, CASE WHEN EXISTS (SELECT 1 FROM hosts AS h WHERE h.key = p.key) THEN 'kept' WHEN EXISTS (SELECT 1 FROM hosts AS h WHERE contains(h.key, p.key)) THEN 'moved_into' ELSE 'gone' END AS kind FROM p)
SELECT kind, count(*) AS n FROM k GROUP BY kind""",
    ),
    "evidence_contains": (
        evidence_contains,
        """WITH p AS (SELECT item_id, lower(string_split(text, chr(10))[1]) AS quote FROM benchmark)
SELECT item_id, count(*) AS n_docs, count(*) FILTER (contains(lower(text), quote)) AS n_whole FROM p JOIN documents ON contains(lower(text), substring(quote, 1, 15)) WHERE length(quote) >= 15 GROUP BY item_id""",
    ),
    "change_index_best": (
        change_index_best,
        f"""WITH t AS (SELECT conv_id, turn, list_distinct({_WORDS.format(t='text')}) AS w FROM conversations),
s AS (SELECT b.conv_id, b.turn, len(list_intersect(b.w, a.w)) AS m FROM t AS a JOIN t AS b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0)
SELECT conv_id, CASE WHEN m > 0 THEN turn END AS best_turn, m AS n_words FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY m DESC, turn) = 1""",
    ),
    "block_continuation": (
        block_continuation,
        """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_linenumber % 3 = 0 THEN 'removed' WHEN l_quantity < 30 THEN 'moved_away' ELSE 'similar' END AS kind, CAST(l_partkey % 2 AS VARCHAR) AS m FROM lineitem),
t AS (SELECT *, CASE WHEN kind = 'moved_away' THEN m END AS moved_to, CASE WHEN kind <> 'removed' THEN kind || '/' || CASE WHEN kind = 'moved_away' THEN m ELSE '' END END AS tag FROM l),
w AS (SELECT *, last_value(tag IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(tag IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t),
f AS (SELECT CASE WHEN kind = 'removed' AND b = a AND starts_with(b, 'moved_away') THEN 'moved_away' ELSE kind END AS kind, CASE WHEN kind = 'removed' AND b = a AND starts_with(b, 'moved_away') THEN substring(b, 12) ELSE moved_to END AS moved_to FROM w)
SELECT kind, moved_to, count(*) AS n FROM f GROUP BY ALL""",
    ),
    "mutual_best_vectors": (
        mutual_best_vectors,
        """WITH v AS (SELECT vec_id, label AS block, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS old_id, b.vec_id AS new_id, round(list_dot_product(a.e, b.e), 6) AS score FROM v AS a JOIN v AS b ON a.block = b.block AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) = 1 AND row_number() OVER (PARTITION BY new_id ORDER BY score DESC, old_id) = 1 AND score >= 0.2""",
    ),
    "cosine_rescue": (
        cosine_rescue,
        """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.label, round(list_dot_product(a.e, b.e), 6) AS s FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
SELECT label, count(*) AS n_pairs, count(*) FILTER (s >= 0.3) AS n_close, max(s) AS best FROM p GROUP BY label""",
    ),
    "cell_diff": (
        cell_diff,
        """WITH c AS (SELECT p_partkey // 10 AS table_id, (p_partkey % 10) // 2 AS r, p_partkey % 2 AS side, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS t, unnest([0, 1, 2]) AS col FROM part),
b AS (SELECT table_id, r, col, max(regexp_replace(lower(t), '\\s+', '', 'g')) FILTER (side = 0) AS o, max(regexp_replace(lower(t), '\\s+', '', 'g')) FILTER (side = 1) AS n FROM c GROUP BY ALL)
SELECT table_id, count(*) AS n_changed FROM b WHERE o IS DISTINCT FROM n GROUP BY table_id""",
    ),
    "formula_set_diff": (
        formula_set_diff,
        """WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT 'x=' || (l_partkey % 5)) FILTER (l_linenumber % 2 = 0), []) AS o, coalesce(list(DISTINCT 'x=' || (l_partkey % 5)) FILTER (l_linenumber % 2 = 1), []) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(list_filter(n, lambda x: NOT list_contains(o, x))), '|') AS added, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(n, x))), '|') AS removed FROM s""",
    ),
    "table_pairing": (table_pairing, None),
    "hungarian_alignment": (hungarian_alignment, None),
    "moved_pass": (moved_pass, None),
    "syntactic_diff_stats": (syntactic_diff_stats, None),
}
