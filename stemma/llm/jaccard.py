"""Jaccard join on word shingles by chosen paths.

Texts with equal sets of shingles are one class and take part once. A class follows paths of
sampled tokens: it extends a path by each of its tokens whose hash with the path is below
1 / (LAMBDA * size), so two sets take a common path the likelier the more they share.
Classes with a common path of `LEVELS` tokens form a bucket. Small buckets are compared by
brute force; larger ones are split by further levels, and what still is large is compared in
blocks, so that no case is dropped. Runs are repeated (as independent paths) until a pair at
the threshold is missed with a probability below 1 - RECALL, even if all its paths lie in
large buckets and it has to meet again after every split.

The comparison inside buckets uses 256-bit sketches whose bound misses a pair at the
threshold with a probability of about 1e-5; what passes makes candidate components, and
within these all pairs are verified exactly on the whole sets: similar means
9 * common >= 4 * (size + size), i.e. a Jaccard similarity of at least 0.8.

Defined results: words are those of `word_hashes` (A-Z lower-cased); a text of fewer than
five words has its words as one shingle; null texts and texts without words have no links and
are classes of their own; copies link to each other; rows that repeat a doc_id are rows of
their own in every count; null ids come last as representatives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import all_salts, read_table, salt, small_batches, written
from stemma.llm.decontaminate import word_hashes
from stemma.llm.graph import components

#: Words of a shingle and the least similarity of a link (fixed by the contract).
SHINGLE, SIMILARITY = 5, 0.8
#: Sampling rate of tokens per level, levels of a path, recall of a pair at the threshold.
LAMBDA, LEVELS, RECALL = 0.7, 1, 0.999
#: Largest bucket compared at once; larger ones are split so many times and then cut in blocks.
BUCKET, SPLITS = 1000, 2
#: Members of a component whose sets are verified together; larger ones in pairs of blocks.
BLOCK = 256
#: Bits of a sketch, and those that must agree at least (9/10 expected at 0.8, less 4.5 sigma).
BITS, AGREE = 256, 208
SALTS = 8
#: Rows of a broadcast table (large buckets; classes whose texts are needed), about 100 bytes each, at most.
BROADCAST_ROWS = 200_000
#: Paths (a long each) that are broadcast, at most.
BROADCAST_PATHS = 1_000_000
#: Links that a task remembers so as not to give them twice.
LINKS_KEPT = 50_000
#: Characters of texts whose words are hashed at once.
TOGETHER = 1 << 19

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def runs_needed() -> int:
    """Runs after which a pair at the threshold has met with the target probability.

    Common extensions of a path are about Poisson with mean SIMILARITY / LAMBDA; q is the
    probability that some common path survives all levels, those of the splits with them.
    """
    q = 1.0
    for _ in range(LEVELS * (SPLITS + 1)):
        q = 1 - math.exp(-SIMILARITY / LAMBDA * q)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - q))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts of about TOGETHER characters are hashed at once."""
    out, some, size = [], [], 0
    for k, t in enumerate(texts):
        some.append(t)
        size += len(t or "")
        if size >= TOGETHER or k == len(texts) - 1:
            out += _sets(some)
            some, size = [], 0
    return out


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    n = len(hashes)
    grams = np.zeros(n, np.uint64)
    for k in range(SHINGLE):  # shingles that start anywhere; those across texts are not used
        grams = grams * _C1 + np.concatenate([hashes[k:], np.zeros(min(k, n), np.uint64)])[:n]
    grams = mix(grams)
    for c in counts.tolist():
        if c >= SHINGLE:
            out.append(np.unique(grams[at : at + c - SHINGLE + 1]))
        elif c:
            one = np.array([c], np.uint64)
            for k in range(at, at + c):
                one = mix(one * _C2 + hashes[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def extend(paths: np.ndarray, tokens: np.ndarray, levels: int) -> np.ndarray:
    """All chosen extensions of paths by so many levels."""
    rate = 1.0 / (LAMBDA * len(tokens))
    below = np.uint64(2**64 - 1) if rate >= 1 else np.uint64(int(rate * 2.0**64))
    for _ in range(levels):
        grown = []
        for some in np.array_split(paths, max(1, len(paths) * len(tokens) >> 20)):
            h = mix(some[:, None] + tokens[None, :])
            grown.append(mix(h[h <= below] + _C2))
        paths = np.concatenate(grown) if grown else paths[:0]
    return np.unique(paths)


_SEEDS = mix(np.arange(1, BITS + 1, dtype=np.uint64) * _C1)


def sketch(tokens: np.ndarray) -> bytes:
    """One bit of each of BITS least hashes."""
    least = np.full(BITS, np.uint64(2**64 - 1))
    for some in np.array_split(tokens, max(1, len(tokens) >> 10)):
        h = (some[:, None] ^ _SEEDS[None, :]) * _C2
        least = np.minimum(least, (h ^ (h >> np.uint64(31))).min(0))
    return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).tobytes()


SIGNED = "sig binary, size int, paths array<long>, sketch binary"


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def signed(text: Column) -> Column:
    """Class signature, set size, paths of all runs, and sketch of a text; nulls without words."""
    roots = mix(np.arange(1, runs_needed() + 1, dtype=np.uint64) * _C2)

    @F.pandas_udf(SIGNED)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for tokens in shingle_sets(list(texts)):
            if len(tokens):
                rows.append((signature(tokens), len(tokens), extend(roots, tokens, LEVELS).view(np.int64), sketch(tokens)))
            else:
                rows.append((None, 0, None, None))
        return pd.DataFrame(rows, columns=["sig", "size", "paths", "sketch"])

    return of(text)


# ---------------------------------------------------------------- buckets


def similar_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (rows of uint64) agree in enough bits."""
    return BITS - np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) >= AGREE


def bucket_links(buckets: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (first row, other row) of each tree of similar rows in each bucket.

    Rows of a bucket are adjacent. Each row in turn is compared with the rows that are not in
    its tree yet, which are few where many rows are alike.
    """
    a, b = [], []
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(buckets)]]))
    two = starts[sizes == 2]
    ok = similar_pairs(sketches[two], sketches[two + 1])
    a.append(two[ok])
    b.append(two[ok] + 1)
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        rows = sketches[s : s + n]
        root = np.arange(n)
        for k in range(n - 1):
            # only rows outside k's tree can add to the forest
            rest = np.flatnonzero(root != root[k])
            if not len(rest):
                continue
            hit = rest[similar_pairs(rows[k], rows[rest])]
            root[np.isin(root, root[hit])] = root[k]
        for r in np.unique(root):
            tree = np.flatnonzero(root == r)
            a.append(np.full(len(tree) - 1, s + tree[0]))
            b.append(s + tree[1:])
    return np.concatenate(a), np.concatenate(b)


LINKS = "u binary, v binary"


def compare_buckets(rows: DataFrame) -> DataFrame:
    """Links of (bucket columns..., sig, sketch) rows, whose buckets are of bounded size."""
    keys = [c for c in rows.columns if c not in ("sig", "sketch")]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            if kept is not None:
                batch = pd.concat([kept, batch], ignore_index=True)
            last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy() if len(batch) else np.zeros(0, bool)
            kept = batch[last]
            yield links(batch[~last])
        if kept is not None:
            yield links(kept)

    given: set[tuple[bytes, bytes]] = set()

    def links(batch: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"u": [], "v": []})
        buckets = batch.groupby(keys, sort=False).ngroup().to_numpy()
        bits = np.frombuffer(b"".join(batch["sketch"]), np.uint64).reshape(len(batch), -1)
        a, b = bucket_links(buckets, bits)
        sigs = batch["sig"].to_numpy()
        new = {(u, v) if u < v else (v, u) for u, v in zip(sigs[a], sigs[b])} - given
        if len(given) < LINKS_KEPT:
            given.update(new)
        return pd.DataFrame(sorted(new), columns=["u", "v"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "sig").mapInPandas(compare, LINKS)


def _paths_of(classes: DataFrame) -> DataFrame:
    return classes.select(F.explode("paths").alias("path"), "sig")


def _few(paths: DataFrame, counts: DataFrame, large: bool, n_large: int) -> DataFrame:
    """Rows of paths in large buckets, or in small ones with at least two members."""
    big = counts.filter(F.col("n") > BUCKET).select("path", "n")
    if n_large <= BROADCAST_ROWS:
        big = F.broadcast(big)
        in_big = paths.join(big, "path")
        rest = paths.join(big, "path", "left_anti")
    else:
        spread = paths.withColumn("salt", salt([F.col("sig")], SALTS))
        wide = big.withColumn("salt", all_salts(SALTS))
        in_big = spread.join(wide, ["path", "salt"]).drop("salt")
        rest = spread.join(wide, ["path", "salt"], "left_anti").drop("salt")
    if large:
        return in_big
    shared = counts.filter(F.col("n") <= BUCKET).select("path")
    if shared.count() <= BROADCAST_PATHS:  # else both sides are shuffled
        shared = F.broadcast(shared)
    return rest.join(shared, "path", "left_semi")


def candidate_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) links between classes that met in a bucket and look similar."""
    spark = classes.sparkSession
    sketches = classes.select("sig", "sketch")
    paths, found = _paths_of(classes), []
    for split in range(SPLITS + 1):
        counts = written(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "path-counts")
        n_large = counts.filter(F.col("n") > BUCKET).count()
        small = _few(paths, counts, False, n_large).join(sketches, "sig").select("path", "sig", "sketch")
        found.append(compare_buckets(small))
        if not n_large:
            break
        large = _few(paths, counts, True, n_large)
        if split < SPLITS:
            paths = written(_split(large, classes, docs), "paths")
        else:  # still large: every pair of blocks of the bucket once
            blocks = F.ceil(F.col("n") / BUCKET).cast("int")
            mine = F.pmod(F.xxhash64("sig", F.lit(9)), blocks).cast("int")
            others = F.sequence(F.lit(0), F.col("blocks") - 1)
            rows = large.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(others))
            rows = rows.select("path", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "sig")
            found.append(compare_buckets(rows.join(sketches, "sig").select("path", "low", "high", "sig", "sketch")))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.distinct()


def _with_text(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """Classes with the text of their first row; a row that repeats it brings it again."""
    texts = docs.select(F.col("doc_id").alias("text_id"), F.col("key").alias("text_key"), "text")
    firsts = written(firsts, "firsts")
    if firsts.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        firsts = F.broadcast(firsts)
    return firsts.join(texts, (F.col("first.key") == F.col("text_key")) & F.col("first.doc_id").eqNullSafe(F.col("text_id")))


def _split(large: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Members of large buckets follow their paths for LEVELS more tokens."""

    @F.pandas_udf("array<long>")
    def further(texts: pd.Series, paths: pd.Series) -> pd.Series:
        sets = shingle_sets(list(texts))
        return pd.Series([extend(np.array(p, np.int64).view(np.uint64), s, LEVELS).view(np.int64) if len(s) else [] for s, p in zip(sets, paths)])

    members = large.groupBy("sig").agg(F.collect_list("path").alias("paths"))  # a class has few paths
    with_text = _with_text(members.join(classes.select("sig", "first"), "sig"), docs)
    return with_text.select(F.explode(further("text", "paths")).alias("path"), "sig").distinct()


# ---------------------------------------------------------------- verification

VERIFIED = "sig binary, n long, root binary"


def verify_sets(sets: list[np.ndarray], left: np.ndarray | None = None) -> np.ndarray:
    """Exact matrix of links between sets; with sides, only of pairs of different sides."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    tokens, which = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    shared = np.bincount(which, minlength=len(tokens)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[which]
    row, which = row[keep], column[which[keep]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    width = 1 << 13
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(which, [low, low + width])
        grid = np.zeros((n, width), np.float32)
        grid[row[a:b], which[a:b] - low] = 1
        common += grid @ grid.T
    links = 9 * common.astype(np.int64) >= 4 * (size[:, None] + size[None, :])
    np.fill_diagonal(links, False)
    if left is not None:
        links &= left[:, None] != left[None, :]
    return links


def verified_links(classes: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, n, root): documents linked to each class, and the least class of its tree.

    Sets are read anew from the representative's text, each once per block it meets.
    """
    members = written(components(found).toDF("sig", "comp"), "candidates")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).withColumn("salt", all_salts(SALTS))
    spread = members.withColumn("salt", salt([F.col("sig")], SALTS)).join(sizes, ["comp", "salt"])
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sig", F.lit(9)), F.col("blocks")).cast("int")
    reps = spread.withColumn("blocks", blocks).withColumn("mine", mine).join(classes.select("sig", "first", "copies"), "sig")
    with_text = _with_text(reps, docs)
    rows = with_text.select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "mine", "sig", "copies", "text")
    rows = rows.select("comp", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") <= F.col("other")).alias("left"), "sig", "copies", "text")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        # a row that repeats the first one brings its text again: it counts once
        sets, own = {}, {}
        for k, (s, sig) in enumerate(zip(shingle_sets(group["text"].tolist()), group["sig"])):
            if sig not in own and signature(s) == sig:
                sets[sig], own[sig] = s, k
        group, sets = group.iloc[list(own.values())], list(sets.values())
        if len(group) < 2:
            return pd.DataFrame({"sig": group["sig"], "n": [0] * len(group), "root": group["sig"]})
        links = verify_sets(sets, group["left"].to_numpy() if group["low"].iloc[0] != group["high"].iloc[0] else None)
        n = (links * group["copies"].to_numpy()[None, :]).sum(1)
        sigs = group["sig"].to_numpy()
        order = sorted(range(len(sigs)), key=lambda k: sigs[k])
        root = {}
        for k in order:  # breadth first from the least member of each tree
            if k in root:
                continue
            root[k], queue = k, [k]
            while queue:
                for j in np.flatnonzero(links[queue.pop()]).tolist():
                    if j not in root:
                        root[j] = k
                        queue.append(j)
        return pd.DataFrame({"sig": sigs, "n": n, "root": [sigs[root[k]] for k in range(len(sigs))]})

    return rows.groupBy("comp", "low", "high").applyInPandas(verify, VERIFIED)


# ---------------------------------------------------------------- join

def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, key, sig), classes (sig, first, copies), verified (sig, n, root).

    key is a digest of the text; first the (no_id, doc_id, key) that stands for the class.
    """
    small_batches(docs.sparkSession)
    docs = _keyed(docs)
    rows = written(docs.select("doc_id", "key", signed(F.col("text")).alias("s")).select("doc_id", "key", "s.*"), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = (
        rows.filter("sig is not null")
        .groupBy("sig")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    )
    classes = written(classes, "classes")
    verified = written(verified_links(classes, docs, candidate_links(classes, docs)), "verified")
    return rows.select("doc_id", "key", "sig"), classes.select("sig", "first", "copies"), verified


def _with_classes(rows: DataFrame, classes: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with their class and its facts; only classes that have any are joined."""
    known = classes.join(facts, "sig", "left").filter((F.col("copies") > 1) | F.col("fact").isNotNull())
    spread = rows.withColumn("salt", salt([F.col("doc_id"), F.col("key")], SALTS))
    return spread.join(known.withColumn("salt", all_salts(SALTS)), ["sig", "salt"], "left").drop("salt")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, classes, verified = join(read_table(spark, sf_dir, "documents"))
    links = verified.groupBy("sig").agg(F.sum("n").alias("fact"))
    out = _with_classes(rows, classes, links)
    n = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("fact", F.lit(0))
    return out.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), n.cast("long").alias("n_links"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, first): the row that links lead to, for all rows that have links."""
    rows, classes, verified = join(docs)
    trees = components(verified.select("sig", "root")).toDF("sig", "tree")
    named = classes.join(trees, "sig").select("sig", "first", "tree")
    least = named.groupBy("tree").agg(F.min("first").alias("fact")).withColumn("salt", all_salts(SALTS))
    facts = named.withColumn("salt", salt([F.col("sig")], SALTS)).join(least, ["tree", "salt"]).select("sig", "fact")
    out = _with_classes(rows, classes, facts).filter("first is not null")
    return out.select("doc_id", "key", F.coalesce("fact", "first").alias("first"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents but for all but the first of each group, with all their columns.

    First is the least doc_id; among rows that repeat it with one text, the one with the least
    hash of its columns.
    """
    names = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in names))
    rows = docs.select(whole.alias("row"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    grouped = written(groups(docs), "groups")
    is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key"))
    counted = grouped.groupBy(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), is_first.alias("stays")).agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted.filter("not stays or n > 1"), "leaving")
    if counted.count() <= BROADCAST_ROWS:  # else the documents are shuffled
        counted = F.broadcast(counted)
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    rest = rows.join(counted, same, "left_anti").select("row")
    if not counted.filter("stays").isEmpty():  # repeated rows of a first document: one stays
        again = rows.join(counted.filter("stays"), same, "left_semi")
        one = again.groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
        rest = rest.union(one)
    return rest.select(*(F.col(f"row.`{c}`").alias(c) for c in names))
