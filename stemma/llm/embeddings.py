"""Embedding near-duplicates by spherical-cap filters.

The space is cut into `PARTS` blocks of coordinates after a random rotation; each block has a
code of random unit vectors, and a filter direction is one codeword per block (a random
product code), so few codewords stand for many random directions. A vector belongs to every
filter whose cap it lies in, i.e. whose direction's inner product with it exceeds the cap's
height; list decoding finds these without trying all: sums of the first blocks that cannot
reach the height any more end the walk, and the last block's codewords are taken from a
sorted list. Vectors join on filters.

The number of directions and the height follow from the number of vectors: a filter holds
about `MEMBERS` random vectors and a vector lies in about `FILTERS` filters at every size of
the table, so the work grows with the table and not with its square.

What is dealt to the filters is a vector in bytes (8 bits a component) with a bound of its
error. Pairs that reach the cosine within the bound make candidate components, and within
these all pairs are verified by cosine in double precision on the vectors themselves, read
anew. Vectors with equal components are one class and are compared once. Large filters and
components are compared in pairs of blocks; nothing is capped.

Defined results: vectors that are null or empty, have null or non-finite components, or are
zero, link with nothing and are their own component; vectors of different lengths never link;
rows that repeat a vec_id are vectors of their own; null ids come last; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import all_salts, read_table, salt, small_batches, written
from stemma.llm.graph import components

#: Least cosine of a link (fixed by the contract).
COSINE = 0.95
#: Filters of a vector in all rotations together, and random vectors in a filter, about.
FILTERS, MEMBERS = 6, 32
#: Rotations of a table of up to FEW vectors; one more for every tenfold of that.
ROTATIONS, FEW = 8, 10_000
#: Blocks of the product code, and codewords of a block from which a block more is taken.
PARTS, MANY_WORDS = 2, 2048
#: The share of directions that a vector's caps hold in a small table.
LARGEST_SHARE = 0.02
#: Members of a filter or component compared at once; larger ones in pairs of blocks.
BLOCK = 512
#: Rows of a broadcast table (large filters, members of components), about 100 bytes each, at most.
BROADCAST_ROWS = 200_000
#: Links that a task remembers so as not to give them twice.
LINKS_KEPT = 200_000
SALTS = 8


def cap_height(length: int, share: float) -> float:
    """Inner product with a direction that this share of all unit vectors of a length exceeds."""
    x = np.linspace(-1, 1, 400_001)[1:-1]
    density = np.cumsum((1 - x * x) ** ((max(length, 3) - 3) / 2))
    return float(x[np.searchsorted(density, (1 - share) * density[-1])])


class ProductCode:
    """Filter directions of one rotation for vectors of one length in a table of so many rows."""

    def __init__(self, length: int, rows: int, rotation: int, rotations: int):
        rng = np.random.default_rng([length, rotation, 6])
        share = min(LARGEST_SHARE, MEMBERS / max(1, rows))
        directions = FILTERS / rotations / share
        self.parts = max(1, min(PARTS, length // 2))
        while directions ** (1 / self.parts) > MANY_WORDS and self.parts < length // 2:
            self.parts += 1
        self.words = max(4, math.ceil(directions ** (1 / self.parts)))
        self.turn = np.linalg.qr(rng.standard_normal((length, length)))[0]
        self.cuts = np.linspace(0, length, self.parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            code = rng.standard_normal((self.words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / math.sqrt(self.parts))
        self.height = cap_height(length, share)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row the numbers of all directions above the height; the best one if none is."""
        y = x @ self.turn
        sums = [y[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)]
        rest = np.cumsum([s.max(1) for s in sums][::-1], axis=0)[::-1]  # most that later blocks add
        order = np.argsort(-sums[-1], axis=1, kind="stable")
        ranked = np.take_along_axis(sums[-1], order, axis=1)
        out = []
        for k in range(len(x)):
            partial, number = np.zeros(1), np.zeros(1, np.int64)
            for p in range(self.parts - 1):
                partial = (partial[:, None] + sums[p][k][None, :]).reshape(-1)
                number = (number[:, None] * self.words + np.arange(self.words)[None, :]).reshape(-1)
                live = partial + rest[p + 1][k] >= self.height
                partial, number = partial[live], number[live]
            n = np.searchsorted(-ranked[k], partial - self.height, side="right")
            heads = np.repeat(np.cumsum(n) - n, n)
            chosen = np.repeat(number, n) * self.words + order[k][np.arange(int(n.sum())) - heads]
            if not len(chosen):
                best = 0
                for s in sums:
                    best = best * self.words + int(s[k].argmax())
                chosen = np.array([best])
            out.append(chosen)
        return out


_codes: dict[tuple[int, int], list[ProductCode]] = {}


def product_codes(length: int, rows: int) -> list[ProductCode]:
    """Codes of all rotations; a worker keeps those of a few lengths."""
    if (length, rows) not in _codes:
        if len(_codes) >= 8:
            _codes.clear()
        rotations = ROTATIONS + max(0, math.ceil(math.log10(max(1, rows) / FEW)))
        _codes[length, rows] = [ProductCode(length, rows, r, rotations) for r in range(rotations)]
    return _codes[length, rows]


def filters_of(vectors: list[np.ndarray], rows: int) -> list[np.ndarray]:
    """Numbers of the filters of unit vectors, of all rotations, in a table of so many rows."""
    out: list[list[np.ndarray]] = [[] for _ in vectors]
    by_length: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        by_length.setdefault(len(v), []).append(k)
    for length, places in by_length.items():
        x = np.stack([vectors[k] for k in places])
        base = 0
        for code in product_codes(length, rows):
            for k, numbers in zip(places, code.decode(x)):
                out[k].append(base + numbers)
            base += code.words**code.parts
    return [np.concatenate(f).astype(np.int64) for f in out]


def unit(vector) -> np.ndarray | None:
    """The vector at length one in double precision, or None if it links with nothing."""
    if vector is None or not len(vector):
        return None
    v = np.array([np.nan if c is None else c for c in vector], np.float64)
    if not np.isfinite(v).all():
        return None
    v = v / (np.abs(v).max() or 1.0)  # squares of huge components do not overflow
    norm = float(np.sqrt(v @ v))
    return v / norm if norm > 0 else None


def pack(u: np.ndarray) -> bytes:
    """A unit vector in bytes: scale, bound of the error's length, and 8 bits a component."""
    scale = np.float32(np.abs(u).max() / 127)
    q = np.rint(u / float(scale))
    error = np.nextafter(np.float32(np.linalg.norm(u - q * float(scale)) * (1 + 1e-6)), np.float32(np.inf))
    return struct.pack("<ff", scale, error) + np.clip(q, -127, 127).astype(np.int8).tobytes()


def unpack(small: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of components (without scale errors) and the bounds of vectors of one length."""
    raw = np.frombuffer(b"".join(small), np.uint8).reshape(len(small), -1)
    scale, error = raw[:, :8].copy().view(np.float32).T.astype(np.float64)
    return raw[:, 8:].view(np.int8) * scale[:, None], error


def signature(vector, kind: type) -> bytes:
    return hashlib.blake2b((np.asarray(vector, kind) + kind(0)).tobytes(), digest_size=16).digest()  # -0 equals 0


def _kind(vectors: DataFrame) -> type:
    return np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def signed(vectors: DataFrame) -> DataFrame:
    """vec_id, key, class signature and vector in bytes; nulls for vectors without links."""
    kind = _kind(vectors)

    @F.pandas_udf("sig binary, small binary")
    def of(rows: pd.Series) -> pd.DataFrame:
        units = [unit(r) for r in rows]
        return pd.DataFrame([(None, None) if u is None else (signature(r, kind), pack(u)) for r, u in zip(rows, units)], columns=["sig", "small"])

    return vectors.select("vec_id", F.xxhash64("embedding").alias("key"), of("embedding").alias("s")).select("vec_id", "key", "s.*")


def filters(small: Column, rows: int) -> Column:
    """Filters of vectors in bytes."""

    @F.pandas_udf("array<long>")
    def of(smalls: pd.Series) -> pd.Series:
        vectors = []
        for s in smalls:
            v = unpack([s])[0][0]
            vectors.append(v / np.linalg.norm(v))
        return pd.Series(filters_of(vectors, rows))

    return of(small)


# ---------------------------------------------------------------- candidates

LINKS = "u binary, v binary"


def trees(close: np.ndarray) -> np.ndarray:
    """The first row of each row's tree of a symmetric matrix of links."""
    root = np.full(len(close), -1)
    for k in range(len(close)):
        if root[k] >= 0:
            continue
        front = np.array([k])
        while len(front):
            root[front] = k
            front = np.flatnonzero(close[front].any(0) & (root < 0))
    return root


def candidates(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Links (first row, other row) of the trees of members that may reach the cosine."""
    x, error = unpack(group["small"].tolist())
    reach = x @ x.T + error[:, None] + error[None, :] + error[:, None] * error[None, :]
    root = trees(reach >= COSINE - 1e-9)
    other = np.flatnonzero(root != np.arange(len(root)))
    return root[other], other


def candidate_links(classes: DataFrame) -> DataFrame:
    """(u, v) links between classes that met in a filter and may reach the cosine."""
    number = F.explode("filters").alias("number")
    size = F.octet_length("small").alias("length")
    large = classes.select(size, number).groupBy("length", "number").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > BLOCK)
    large = written(large, "large-filters")
    rows = classes.select("sig", "small", size, number)
    if large.count() <= BROADCAST_ROWS:  # else both sides are shuffled, large filters over salts
        placed = rows.join(F.broadcast(large), ["length", "number"], "left")
    else:
        placed = rows.withColumn("salt", salt([F.col("sig")], SALTS)).join(large.withColumn("salt", all_salts(SALTS)), ["length", "number", "salt"], "left").drop("salt")
    blocks = F.ceil(F.coalesce("members", F.lit(1)) / BLOCK).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("sig", F.lit(9)), blocks).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("length", "number", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "sig", "small")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: set[tuple[bytes, bytes]] = set()

        def of(batch: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            new = set()
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    group = batch.iloc[a:b]
                    sigs = group["sig"].to_numpy()
                    for i, j in zip(*candidates(group)):
                        new.add((sigs[i], sigs[j]) if sigs[i] < sigs[j] else (sigs[j], sigs[i]))
            new -= given
            if len(given) < LINKS_KEPT:
                given.update(new)
            return pd.DataFrame(sorted(new), columns=["u", "v"])

        kept: list[pd.DataFrame] = []
        for batch in batches:
            batch = pd.concat([*kept, batch], ignore_index=True) if kept else batch
            key = batch[keys].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
            yield of(batch, cuts)
            kept = [batch.iloc[cuts[-1] :]]  # the last group may go on
        if kept:
            yield of(kept[0], np.array([0, len(kept[0])]))

    keys = ["length", "number", "low", "high"]
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, LINKS).distinct()


# ---------------------------------------------------------------- verification

FOUND = "sig binary, n long, root binary"


def exact_links(x: np.ndarray) -> np.ndarray:
    """Matrix of links between rows, by cosine in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    close = x @ x.T >= COSINE
    np.fill_diagonal(close, False)
    return close


def verified_links(vectors: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, n, root): vectors linked to each class, and the least class of its tree."""
    kind = _kind(vectors)
    members = written(components(found).toDF("sig", "comp"), "vector-candidates")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).withColumn("salt", all_salts(SALTS))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sig", F.lit(9)), F.col("blocks")).cast("int")
    spread = members.withColumn("salt", salt([F.col("sig")], SALTS)).join(sizes, ["comp", "salt"]).withColumn("blocks", blocks).withColumn("mine", mine)
    firsts = written(spread.join(classes.select("sig", "first", "copies"), "sig").select("comp", "blocks", "mine", "sig", "first", "copies"), "vector-firsts")
    if firsts.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        firsts = F.broadcast(firsts)
    own = vectors.select(F.col("vec_id").alias("own_id"), F.xxhash64("embedding").alias("own_key"), F.col("embedding").alias("vector"))
    same = (F.col("first.key") == F.col("own_key")) & F.col("first.vec_id").eqNullSafe(F.col("own_id"))
    rows = firsts.join(own, same).select("comp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "sig", "copies", "vector")
    rows = rows.select("comp", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") <= F.col("other")).alias("left"), "sig", "copies", "vector")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        # a row that repeats the first one brings its vector again: it counts once
        group = group[[signature(v, kind) == s for v, s in zip(group["vector"], group["sig"])]].drop_duplicates("sig").sort_values("sig")
        sigs, left = group["sig"].to_numpy(), group["left"].to_numpy()
        if len(group) < 2:
            return pd.DataFrame({"sig": sigs, "n": np.zeros(len(sigs), np.int64), "root": sigs})
        lengths = np.array([len(v) for v in group["vector"]])
        close = np.zeros((len(group), len(group)), bool)
        for length in np.unique(lengths):
            of = np.flatnonzero(lengths == length)
            close[np.ix_(of, of)] = exact_links(np.stack([np.asarray(v, kind) for v in group["vector"].iloc[of]]))
        if group["low"].iloc[0] != group["high"].iloc[0]:
            close &= left[:, None] != left[None, :]
        n = (close * group["copies"].to_numpy()[None, :]).sum(1)
        return pd.DataFrame({"sig": sigs, "n": n, "root": sigs[trees(close)]})

    return rows.groupBy("comp", "low", "high").applyInPandas(verify, FOUND)


def links(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (vec_id, key, sig), classes (sig, first, copies), found (sig, n, root).

    first is the (no_id, vec_id, key) that stands for the class; key a hash of the vector.
    """
    small_batches(vectors.sparkSession)
    rows = written(signed(vectors), "vectors")
    first = F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "key")
    classes = rows.filter("sig is not null").groupBy("sig").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("small").alias("small"))
    classes = written(classes.withColumn("filters", filters(F.col("small"), rows.count())), "vector-classes")
    found = written(verified_links(vectors, classes, candidate_links(classes)), "vector-links")
    return rows.select("vec_id", "key", "sig"), classes.select("sig", "first", "copies"), found


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    rows, classes, found = links(vectors)
    counts = found.groupBy("sig").agg(F.sum("n").alias("linked")).filter("linked > 0")
    trees = components(found.select("sig", "root")).toDF("sig", "tree")
    named = classes.join(trees, "sig")
    least = named.groupBy("tree").agg(F.min("first").alias("least")).withColumn("salt", all_salts(SALTS))
    facts = named.withColumn("salt", salt([F.col("sig")], SALTS)).join(least, ["tree", "salt"]).select("sig", "least")
    known = classes.join(facts, "sig", "left").join(counts, "sig", "left").filter((F.col("copies") > 1) | F.col("least").isNotNull())
    spread = rows.withColumn("salt", salt([F.col("vec_id"), F.col("key")], SALTS))
    out = spread.join(known.withColumn("salt", all_salts(SALTS)), ["sig", "salt"], "left")
    n = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))
    component = F.coalesce("least.vec_id", "first.vec_id", "vec_id")
    out = out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
