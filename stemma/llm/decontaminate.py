"""Benchmark decontamination by suffix arrays over the training texts.

The words of a batch of documents form a shard with a suffix array (prefix doubling over word
ranks). Every suffix of a benchmark item is binary-searched in it by its window, i.e. its
first `WINDOW` words, which gives all its places in the shard. Only stretches of at least a
window of words that some item knows enter the suffix array, as no window can lie elsewhere.
At the places found, the longest verbatim matches come from the benchmark block's own suffix
array, whose ranges are narrowed by ever shorter powers of two of words; so a window that
repeats a thousand times in an item and in a document costs their sum, not their product.

The benchmark is cut into blocks that tasks write to the shared folder, and a worker reads
one block after the other, so neither the driver nor a worker ever holds a benchmark of
unknown size.

Words are runs of digits, letters a to z (A to Z in lower case) and characters beyond ASCII.
Defined results: null and empty texts have no words and no hits; an item without words never
occurs, one of fewer than `WINDOW` words is one window; items with one id are one item, a
null id is the item "null"; repeated rows each get their row; with an empty benchmark nothing
is hit; other columns are kept where rows are removed and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import filesystem, free_name, read_table, shared_dir, small_batches

#: Consecutive words that count as a leak.
WINDOW = 10
#: Words by which the suffix array is ordered (a power of two, at least the window).
DEPTH = 16
#: Bytes of benchmark text in one block, about.
BLOCK_BYTES = 8 << 20
#: Bytes of text in one shard, about; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_PRIME, inverse)]
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    b = _FOLD[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    inside = b != 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(b) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(b.astype(np.uint64) * power[: len(b)])])
    h = (sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    counts = np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])))
    return h, counts


# ---------------------------------------------------------------- benchmark blocks


class Block:
    """Windows of some benchmark items over the sorted vocabulary of the block."""

    def __init__(self, items: list[str], hashes: np.ndarray, counts: np.ndarray):
        self.items = items
        self.vocabulary = np.unique(hashes)
        ids = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        rows, item = [], []
        at = 0
        for k, n in enumerate(counts.tolist()):
            if n:
                w = min(WINDOW, n)
                grid = np.unique(np.lib.stride_tricks.sliding_window_view(ids[at : at + n], w), axis=0)
                rows.append(np.pad(grid, ((0, 0), (0, WINDOW - w))))
                item.append(np.full(len(grid), k))
            at += n
        grid = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int32)
        item = np.concatenate(item) if item else np.zeros(0, np.int64)
        # equal windows are searched once, and windows of the same items share one set of them
        self.windows, which = np.unique(grid, axis=0, return_inverse=True)
        order = np.argsort(which.reshape(-1), kind="stable")
        cuts = np.searchsorted(which.reshape(-1)[order], np.arange(1, len(self.windows)))
        known: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.set_of = np.zeros(len(self.windows), np.int64)
        for k, some in enumerate(np.split(item[order], cuts) if len(self.windows) else []):
            key = some.tobytes()
            if key not in known:
                known[key] = len(self.sets)
                self.sets.append(some)
            self.set_of[k] = known[key]
        self.by_name = sorted(range(len(items)), key=items.__getitem__)
        self.name_rank = np.zeros(len(items), np.int64)
        self.name_rank[self.by_name] = np.arange(len(items))
        self.width = (self.windows > 0).sum(1)
        self.least = int(self.width.min()) if len(self.windows) else WINDOW
        self.ids, self.counts = ids, counts
        self._ranks: list[np.ndarray] = []
        self._pairs: list[np.ndarray] = []

    def _index(self) -> None:
        """Ranks of all words' followers by powers of two, and the suffix array; made at need.

        The items stand one after the other with a 0 behind each, which no document word equals.
        """
        ends = np.cumsum(self.counts)
        self.owner = np.repeat(np.arange(len(self.counts)), np.asarray(self.counts) + 1)
        text = np.insert(self.ids, ends, 0).astype(np.int64)
        self._ranks, self._pairs = [text], []
        step = 1
        while step < int(max(self.counts)):
            rank = self._ranks[-1]
            key = rank * (int(rank.max()) + 1) + np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
            pairs, new = np.unique(key, return_inverse=True)
            self._pairs.append(pairs)
            self._ranks.append(new.reshape(-1) + 1)
            step *= 2
        self.suffixes = np.argsort(self._ranks[-1], kind="stable")

    def longest(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For places in words (0 ends a stretch): words of the longest match with an item, and the
        range of the suffix array that holds it."""
        if not self._ranks:
            self._index()
        queries, step = [words.astype(np.int64)], 1
        for pairs, rank in zip(self._pairs, self._ranks):
            q = queries[-1]
            after = np.concatenate([q[step:], np.zeros(min(step, len(q)), np.int64)])[: len(q)]
            key = q * (int(rank.max()) + 1) + after
            found = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            queries.append(np.where((q > 0) & (after > 0) & (pairs[found] == key), found + 1, 0))
            step *= 2
        size = np.zeros(len(at), np.int64)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64)
        for k in range(len(queries) - 1, -1, -1):
            place = at + size
            want = np.where(place < len(words), queries[k][np.minimum(place, len(words) - 1)], 0)
            try_ = np.flatnonzero(want)
            rank = np.concatenate([self._ranks[k], np.zeros(int(max(self.counts)) + 1, np.int64)])

            def bound(upper: bool) -> np.ndarray:
                a, b = low[try_].copy(), high[try_].copy()
                while len(live := np.flatnonzero(a < b)):
                    middle = (a[live] + b[live]) // 2
                    value = rank[self.suffixes[middle] + size[try_[live]]]
                    right = (value < want[try_[live]]) | ((value == want[try_[live]]) & upper)
                    a[live[right]] = middle[right] + 1
                    b[live[~right]] = middle[~right]
                return a

            first, last = bound(False), bound(True)
            hit = last > first
            low[try_[hit]], high[try_[hit]] = first[hit], last[hit]
            size[try_[hit]] += 1 << k
        return size, low, high

    def least_item(self, ranks: np.ndarray) -> str:
        return self.items[self.by_name[int(ranks.min())]]


def write_blocks(benchmark: DataFrame, target: str) -> list[str]:
    """Write the benchmark as blocks of word hashes; only their paths come to the driver."""
    small_batches(benchmark.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(target)
        fs.create_dir(root, recursive=True)
        items: list[str] = []
        texts: list[str] = []

        def flush() -> pd.DataFrame:
            hashes, counts = word_hashes(texts)
            name = hashlib.sha256(repr((items, hashes.tobytes())).encode()).hexdigest()  # a repeated task writes the same file
            buffer = io.BytesIO()
            np.savez(buffer, items=np.array(items, dtype=str), hashes=hashes, counts=counts)
            mine = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(mine, compression=None) as out:
                out.write(buffer.getvalue())
            fs.move(mine, f"{root}/{name}.npz")
            items.clear()
            texts.clear()
            return pd.DataFrame({"path": [f"{target}/{name}.npz"]})

        size = 0
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                items.append(item)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        if items:
            yield flush()

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return sorted({r["path"] for r in rows.mapInPandas(write, "path string").collect()})


_blocks: dict[str, Block] = {}


def load_block(path: str) -> Block:
    """A block of this worker's last one or two."""
    if path not in _blocks:
        fs, name = filesystem(path)
        with fs.open_input_stream(name, compression=None) as f:
            data = np.load(io.BytesIO(f.read()))
        if len(_blocks) >= 2:
            _blocks.pop(next(iter(_blocks)))
        _blocks[path] = Block(data["items"].tolist(), data["hashes"], data["counts"])
    return _blocks[path]


# ---------------------------------------------------------------- suffix arrays


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Places of a sequence in the order of their first DEPTH words (0 ends a stretch)."""
    rank = words.astype(np.int64)
    step = 1
    while step < DEPTH:
        after = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        rank = np.where(words == 0, 0, np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1)
        step *= 2
    return np.argsort(rank, kind="stable")


def find(windows: np.ndarray, width: np.ndarray, words: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window the range of the suffix array that begins with it, by binary search."""
    padded = np.concatenate([words, np.zeros(WINDOW, words.dtype)])

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live]) // 2
            at = order[middle]
            sign = np.zeros(len(live), np.int64)  # of the suffix against the window
            for k in range(WINDOW):
                open_ = (sign == 0) & (k < width[live])
                if not open_.any():
                    break
                sign[open_] = np.sign(padded[at[open_] + k].astype(np.int64) - windows[live[open_], k])
            right = (sign < 0) | ((sign == 0) & upper)
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]

    return bound(False), bound(True)


class Hits:
    """What a shard's documents have in common with the benchmark."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.ends = np.cumsum(counts)
        self.cover = np.zeros(int(counts.sum()) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in counts]
        self.longest = [(0, "", 0)] * len(counts)  # words, item, first word in the document

    def add(self, hashes: np.ndarray, block: Block) -> None:
        if not len(hashes) or not len(block.windows):
            return
        at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
        ids = np.where(block.vocabulary[at] == hashes, at + 1, 0)
        # stretches of known words within one document, of a window's length at least
        cut = np.zeros(len(ids) + 1, bool)
        cut[self.ends[self.counts > 0]] = True
        begins = (ids != 0) & (np.concatenate([[0], ids[:-1]]) == 0) | (ids != 0) & cut[:-1]
        first = np.flatnonzero(begins)
        stops = np.flatnonzero((ids != 0) & (np.concatenate([ids[1:], [0]]) == 0) | (ids != 0) & cut[1:]) + 1
        wide = stops - first >= block.least
        first, sizes = first[wide], (stops - first)[wide]
        if not len(first):
            return
        # the stretches one after the other, with a 0 behind each
        start = np.concatenate([[0], np.cumsum(sizes + 1)])
        place = np.arange(start[-1]) - np.repeat(start[:-1], sizes + 1) + np.repeat(first, sizes + 1)
        words = ids[np.minimum(place, len(ids) - 1)]
        words[start[1:] - 1] = 0
        low, high = find(block.windows, block.width, words, order := suffix_array(words))
        found = np.flatnonzero(high > low)
        if not len(found):
            return
        n = high[found] - low[found]
        window = np.repeat(found, n)
        spot = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[found], n)]
        at = place[spot]
        np.add.at(self.cover, at, 1)
        np.add.at(self.cover, at + block.width[window], -1)
        doc = np.searchsorted(self.ends, at, side="right")
        for d, k in np.unique(np.stack([doc, block.set_of[window]]), axis=1).T.tolist():
            self.items[d].update(block.items[i] for i in block.sets[k])
        # the longest match of each document: the first place of its most words, and the least item there
        size, full = block.width[window].copy(), np.flatnonzero(block.width[window] == WINDOW)
        ranges = np.zeros((2, len(at)), np.int64)
        if len(full):
            size[full], ranges[0, full], ranges[1, full] = block.longest(words, spot[full])
        by = np.lexsort((at, -size, doc))
        for k in by[np.flatnonzero(np.diff(doc[by], prepend=-1))].tolist():
            low, high = ranges[:, k].tolist()
            holders = block.owner[block.suffixes[low:high]] if high else block.sets[block.set_of[window[k]]]
            d = int(doc[k])
            match = (int(size[k]), block.least_item(block.name_rank[holders]), int(at[k]) - int(self.ends[d] - self.counts[d]))
            if (-match[0], match[2], match[1]) < (-self.longest[d][0], self.longest[d][2], self.longest[d][1]):
                self.longest[d] = match

    def rows(self) -> list[tuple]:
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.cover[:-1]) > 0)])
        n_hit = hit[self.ends] - hit[self.ends - self.counts]
        return [(int(n), int(h), sorted(i), *match) for n, h, i, match in zip(self.counts, n_hit, self.items, self.longest)]


def shard_hits(texts: list[str | None], paths: list[str]) -> list[tuple]:
    """n_words, n_hit, items and longest match of each text of a shard."""
    hashes, counts = word_hashes(texts)
    hits = Hits(counts)
    for path in paths:
        hits.add(hashes, load_block(path))
    return hits.rows()


FOUND = "n_words long, n_hit long, items array<string>, longest long, longest_item string, longest_at long"


def overlap(text: Column, paths: list[str]) -> Column:
    """struct of n_words, n_hit, items, and the longest match with its item and place."""

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows, shard, size = [], [], 0
        for t in texts:
            shard.append(t)
            size += len(t or "")
            if size >= SHARD_BYTES:
                rows += shard_hits(shard, paths)
                shard, size = [], 0
        rows += shard_hits(shard, paths) if shard else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return found(text)


def blocks_of(benchmark: DataFrame) -> list[str]:
    return write_blocks(benchmark, shared_dir(benchmark.sparkSession, "benchmark-blocks"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    paths = blocks_of(read_table(spark, sf_dir, "benchmark"))
    found = read_table(spark, sf_dir, "documents").select("doc_id", overlap(F.col("text"), paths).alias("f"))
    items = F.array_join(F.array_sort("f.items"), ",")
    return found.select(
        "doc_id",
        "f.n_words",
        "f.n_hit",
        F.size("f.items").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"),
        (F.col("f.n_hit") > 0).alias("contaminated"),
        "f.longest",
        "f.longest_item",
        "f.longest_at",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with the benchmark, with all their columns."""
    small_batches(docs.sparkSession)
    f = free_name(docs, "overlap")
    return docs.withColumn(f, overlap(F.col("text"), blocks_of(benchmark))).filter(F.col(f"{f}.n_hit") == 0).drop(f)


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
n AS (SELECT *, least({WINDOW}, len(w)) AS n FROM i WHERE len(w) > 0),
o AS (SELECT k, item, w, n, unnest(generate_series(0, len(w) - n)) AS o FROM n),
wins AS (SELECT k, item, n, o, array_to_string(w[o + 1:o + n], ' ') AS win FROM o),
widths AS (SELECT DISTINCT n FROM n),
p AS (SELECT r, n, w, unnest(generate_series(0, len(w) - n)) AS p FROM d, widths WHERE len(w) >= n),
places AS (SELECT r, n, p, array_to_string(w[p + 1:p + n], ' ') AS win FROM p),
occ AS (SELECT r, p, k, item, n, o FROM places JOIN wins USING (n, win)),
hit AS (SELECT r, count(DISTINCT h) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS h FROM (SELECT DISTINCT r, p, n FROM occ)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS items FROM occ GROUP BY r),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY r, k, p - o ORDER BY p) AS run FROM occ),
matches AS (SELECT r, item, min(p) AS first_place, count(*) - 1 + any_value(n) AS words FROM runs GROUP BY r, k, item, p - o, run),
best AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY r ORDER BY words DESC, first_place, item) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(words, 0) AS longest, coalesce(best.item, '') AS longest_item, coalesce(first_place, 0) AS longest_at
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)"""
