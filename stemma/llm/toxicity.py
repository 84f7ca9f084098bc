"""Toxicity by a lexicon that is matched with spelling errors and read in context.

The lexicon (terms, and stems that take endings) is learned from labelled documents and held
in a trie. Words are looked up by running their Levenshtein automata along the trie, so every
term within the allowed edits is found in one walk; the automata of all new words of some
texts walk together, as bit masks in arrays, and leave a branch when none of their states
lives. Each hit gets a context-window score: words of direct address nearby raise it,
quotation marks and words of reporting lower it. A logistic regression over what a document's
hits add up to gives the score.

Learning takes at most `SAMPLE_ROWS` labelled documents of either label, chosen by a hash of
the id: one half teaches the lexicon, the other half the weights. In the first half near
copies (five-word shingles, similarity 0.8 by `HASHES` least hashes of the whole text) count
once, or else a copied text would make terms of its words.

Defined results: null texts count as empty; an empty text scores as a text without hits; with
no labels, or one label only, the lexicon is empty and every score is the share of toxic
labels (0 without labels); texts are read whole; a document labelled twice is toxic if either
label is; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import id_fold, read_table, small_batches
from stemma.llm.jaccard import SIMILARITY, mix, shingle_sets
from stemma.llm.language import fit_linear

#: Labelled documents of either label that are learned from, at most.
SAMPLE_ROWS = 3000
#: Entries of the lexicon, at most, and the least log odds and documents of one.
ENTRIES, LEAST_ODDS, LEAST_DOCS = 500, 2.5, 3
#: A stem is a beginning of so many letters that has at least so many endings; its least log odds.
STEM_LETTERS, ENDINGS, STEM_ODDS = range(4, 9), 5, 4.0
#: Letters of a term from which one edit, and two edits, are allowed.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words on either side of a hit that belong to its window.
WINDOW = 4
#: Words a worker remembers the look-up of; the memory is emptied when it is full.
WORDS_KEPT = 500_000
#: Characters of texts whose new words are looked up together, and the words from which that pays.
TOGETHER_CHARS, TOGETHER_WORDS = 1 << 20, 64
#: Least hashes by which near copies in the sample are told.
HASHES = 64
HELD_OUT, FOLDS = 0, 5

#: Words of direct address, and words of reporting another's speech, in four languages.
ADDRESS = frozenset("you your youre are u ur du dich dir dein deine bist ihr euch tu toi te ton ta es vous êtes tú eres usted vosotros sois".split())
REPORTING = frozenset(
    "said says quote quoted quotes called calls word words term wrote writes slur insult insulted sagte schrieb nannte wort zitat begriff "
    "dit écrit appelé mot terme citation dijo escribió llamó palabra término cita".split()
)
QUOTES = frozenset("\"“”„«»‹›")
TOKEN = regex.compile(r"[\p{L}\p{M}]+|[\"“”„«»‹›]")

# ---------------------------------------------------------------- automata and trie


def allowed_edits(letters: int) -> int:
    """Edits that a term of so many letters allows."""
    return 2 if letters >= TWO_EDITS else 1 if letters >= ONE_EDIT else 0


class Trie:
    """Terms by letters; a node is [children, entry or -1, whether any ending is accepted, edits below]."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.root: list = [{}, -1, False, 0]
        self.terms = [*terms, *stems]
        for k, term in enumerate(self.terms):
            edits = 0 if k >= len(terms) else allowed_edits(len(term))
            node = self.root
            node[3] = max(node[3], edits)
            for c in term:
                node = node[0].setdefault(c, [{}, -1, False, 0])
                node[3] = max(node[3], edits)
            if node[1] < 0:
                node[1] = k
            node[2] |= k >= len(terms)
        self.plain, self.stem_set = set(terms), set(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.longest = max([len(t) for t in terms if len(t) >= ONE_EDIT], default=0)

    def lookup(self, word: str) -> int:
        """0: no entry; 1: a term as it is; 2: a stem with an ending; 3 or 4: a term but for 1 or 2 edits."""
        known = self._spelled(word)
        return known if known is not None else self._kind(self.nearest(word))

    def lookup_all(self, words: list[str]) -> list[int]:
        """`lookup` of many words, whose automata walk the trie together."""
        out = [self._spelled(w) for w in words]
        rest = [k for k, kind in enumerate(out) if kind is None]
        if len(rest) < TOGETHER_WORDS:
            found = [self.nearest(words[k]) for k in rest]
        else:
            found = self.nearest_all([words[k] for k in rest])
        for k, edits in zip(rest, found):
            out[k] = self._kind(edits)
        return out

    def _spelled(self, word: str) -> int | None:
        """What a word is without its automaton; None if that has to decide."""
        if word in self.plain:
            return 1
        if any(word[:n] in self.stem_set for n in self.stem_sizes):
            return 2
        return None if ONE_EDIT - 1 <= len(word) <= self.longest + 2 else 0

    @staticmethod
    def _kind(edits: int | None) -> int:
        return 2 + edits if edits else 0

    def nearest(self, word: str) -> int | None:
        """Least edits to a term that allows them: the word's Levenshtein automaton on the trie.

        The automaton's states are (letters of the word read, edits spent); a set of states is
        a bit mask per number of edits. A branch of the trie with no live state is left.
        """
        accept, letters = 1 << len(word), {}
        for k, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << k
        best, stack = None, [(self.root, 1, 3, 7, 0)]
        while stack:
            node, r0, r1, r2, depth = stack.pop()
            depth += 1
            for c, child in node[0].items():
                m = letters.get(c, 0)
                s0 = (r0 & m) << 1
                s1 = (r1 & m) << 1 | r0 | r0 << 1 | s0 << 1
                s2 = (r2 & m) << 1 | r1 | r1 << 1 | s1 << 1
                if not (s2 if child[3] == 2 else s1 if child[3] else 0) & (accept * 2 - 1):
                    continue
                if child[1] >= 0 and not child[2] and depth >= ONE_EDIT:
                    edits = 1 if s1 & accept else 2 if s2 & accept and depth >= TWO_EDITS else None
                    if edits and (best is None or edits < best):
                        best = edits
                if child[0]:
                    stack.append((child, s0, s1, s2, depth))
        return best

    def nearest_all(self, words: list[str]) -> list[int]:
        """`nearest` of many words of at most `longest` + 2 letters, 0 for none: one walk for all.

        Masks are of 64 bits; as terms have at most 40 letters, so have words that reach them.
        """
        one = np.uint64(1)
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        of_word = np.repeat(np.arange(len(words)), sizes)
        bit = one << (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
        accept = one << sizes.astype(np.uint64)
        inside = (accept << one) - one
        masks: dict[str, np.ndarray] = {}
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        for some in np.split(order, cuts):
            mask = masks[chr(codes[some[0]])] = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(mask, of_word[some], bit[some])
        none = np.zeros(len(words), np.uint64)
        best = np.full(len(words), 3, np.int64)
        start = np.ones(len(words), np.uint64)
        stack = [(self.root, np.arange(len(words)), start, start * np.uint64(3), start * np.uint64(7), 0)]
        while stack:
            node, rows, r0, r1, r2, depth = stack.pop()
            depth += 1
            for c, child in node[0].items():
                if not child[3]:
                    continue
                m = masks.get(c, none)[rows]
                s0 = (r0 & m) << one
                s1 = (r1 & m) << one | r0 | r0 << one | s0 << one
                s2 = (r2 & m) << one | r1 | r1 << one | s1 << one if child[3] == 2 else s1
                live = np.flatnonzero(s2 & inside[rows])
                if not len(live):
                    continue
                here, s0, s1, s2 = rows[live], s0[live], s1[live], s2[live]
                if child[1] >= 0 and not child[2] and depth >= ONE_EDIT:
                    ends = accept[here]
                    if depth >= TWO_EDITS:
                        two = here[(s2 & ends) != 0]
                        best[two] = np.minimum(best[two], 2)
                    best[here[(s1 & ends) != 0]] = 1
                if child[0]:
                    stack.append((child, here, s0, s1, s2, depth))
        return np.where(best < 3, best, 0).tolist()


class _Known(dict):
    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = self.trie.lookup(word) if word not in QUOTES else 0
        return found

    def learn(self, words: set[str]) -> None:
        """Look up all words that are not known yet."""
        new = sorted(w for w in words if w not in self and w not in QUOTES)
        if len(self) + len(new) > WORDS_KEPT:
            self.clear()
        self.update(zip(new, self.trie.lookup_all(new)))


# ---------------------------------------------------------------- scoring


@dataclass
class ToxicityModel:
    terms: list[str]
    stems: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = np.array(features_of(texts, _known(tuple(self.terms), tuple(self.stems)))) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_tries: dict[tuple, _Known] = {}


def _known(terms: tuple, stems: tuple) -> _Known:
    if (terms, stems) not in _tries:
        _tries.clear()
        _tries[terms, stems] = _Known(Trie(list(terms), list(stems)))
    return _tries[terms, stems]


def window_score(tokens: list[str], at: int, quoted: bool) -> float:
    """How much a hit is abuse: 1 plain, up to 2 by direct address, down to 0.1 in quotation."""
    near = tokens[max(0, at - WINDOW) : at] + tokens[at + 1 : at + 1 + WINDOW]
    address = sum(t in ADDRESS for t in near)
    reporting = sum(t in REPORTING for t in near)
    score = 1.0 + 0.5 * min(address, 2)
    if quoted:
        score *= 0.3
    return max(0.1, score * 0.5 ** min(reporting, 2))


def features_of(texts: list[str | None], known: _Known) -> list[list[float]]:
    """`features` of many texts; new words of about `TOGETHER_CHARS` of text are looked up at once."""
    out, some, size = [], [], 0
    for k, text in enumerate(texts):
        some.append(TOKEN.findall((text or "").lower()))
        size += len(text or "")
        if size >= TOGETHER_CHARS or k == len(texts) - 1:
            known.learn({w for tokens in some for w in tokens})
            out += [_features(tokens, known) for tokens in some]
            some, size = [], 0
    return out


def features(text: str | None, known: _Known) -> list[float]:
    """Sums over the hits of a text: exact, stem and misspelled ones, by context, and density."""
    return features_of([text], known)[0]


def _features(tokens: list[str], known: _Known) -> list[float]:
    kinds = list(map(known.__getitem__, tokens))
    if not any(kinds):
        return [0.0] * 6
    hits = [k for k, kind in enumerate(kinds) if kind]
    quotes = [k for k, t in enumerate(tokens) if t in QUOTES]
    inside = np.searchsorted(quotes, hits) if quotes else np.zeros(len(hits), int)
    exact = stem = fuzzy = quotation = 0.0
    for at, before in zip(hits, inside):
        quoted = before % 2 == 1 and before < len(quotes) and quotes[before] - quotes[before - 1] <= 12 * WINDOW
        s = window_score(tokens, at, quoted)
        quotation += s < 1
        if kinds[at] == 1:
            exact += s
        elif kinds[at] == 2:
            stem += s
        else:
            fuzzy += s / (kinds[at] - 2)
    return [math.log1p(exact), math.log1p(stem), math.log1p(fuzzy), math.log1p(quotation), min(1.0, 50 * (exact + stem) / len(tokens)), float(exact + stem >= 1)]


# ---------------------------------------------------------------- learning


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic and half of at most about `rows` documents of each label."""
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.xxhash64(F.col("doc_id"), F.lit(1)).cast("double") / F.lit(2.0**64) + 0.5
    chosen = F.lit(False)
    for toxic, n in counts.items():
        chosen = chosen | ((F.col("toxic") == toxic) & (place <= F.lit(min(1.0, rows / n))))
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(2))
    return labelled.filter(chosen).select("doc_id", "toxic", half.alias("half")).limit(3 * rows)


_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))


def least_hashes(text: Column) -> Column:
    """The least of each of `HASHES` hashes of the shingles of a whole text, as bytes."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for tokens in shingle_sets(list(texts)):
            least = np.full(HASHES, np.uint64(2**64 - 1))
            for some in np.array_split(tokens, max(1, len(tokens) >> 12)):
                least = np.minimum(least, mix(some[:, None] ^ _SEEDS[None, :]).min(0, initial=np.uint64(2**64 - 1)))
            out.append((least >> np.uint64(32)).astype(np.uint32).tobytes())
        return pd.Series(out)

    return of(text)


def first_of_copies(sketches: list[bytes]) -> list[int]:
    """Places of the rows that are no near copy of a row kept before them."""
    rows = np.frombuffer(b"".join(sketches), np.uint32).reshape(len(sketches), HASHES)
    kept: list[int] = []
    for k in range(len(rows)):
        if not kept or (rows[kept] == rows[k]).mean(1).max() < SIMILARITY:
            kept.append(k)
    return kept


def learn_lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Terms and stems that mark toxic texts, from (text, toxic) rows without copies."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return [], []
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]{3,40}"), F.lit(0)))).alias("word"))
    bad, fine = F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine")
    scale = F.lit((totals[0] + 1) / (totals[1] + 1))
    odds = F.log((F.col("bad") + 0.5) / (F.col("fine") + 0.5) * scale)

    def best(counts: DataFrame, name: str, least_odds: float) -> list:
        strong = (F.col("bad") >= max(LEAST_DOCS, totals[1] // 100)) & (odds >= least_odds)
        return counts.filter(strong).orderBy((odds * F.sqrt("bad")).desc(), name).limit(ENTRIES).collect()

    # one entry a document at most counts for a stem, as for a term
    terms = [r["word"] for r in best(words.groupBy("word").agg(bad, fine), "word", LEAST_ODDS)]
    def begins(n: int) -> Column:
        longer = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"[\p{{L}}\p{{M}}]{{{n + 1},}}"), F.lit(0)))
        return F.transform(longer, lambda w: F.substring(w, F.lit(1), F.lit(n)))

    beginnings = rows.select("toxic", F.explode(F.array_distinct(F.flatten(F.array(*map(begins, STEM_LETTERS))))).alias("stem"))
    forms = words.filter("toxic = 1").select(F.explode(F.array(*(F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LETTERS))).alias("stem"), "word").groupBy("stem").agg(F.approx_count_distinct("word").alias("forms"))
    ranked = best(beginnings.groupBy("stem").agg(bad, fine).join(forms.filter(F.col("forms") >= ENDINGS), "stem").filter(F.col("bad") >= max(LEAST_DOCS, totals[1] // 50)), "stem", STEM_ODDS)
    stems: list[str] = []
    for r in ranked:  # the strongest of stems that begin one another
        if not any(r["stem"].startswith(s) or s.startswith(r["stem"]) for s in stems):
            stems.append(r["stem"])
    return sorted(t for t in terms if not any(t.startswith(s) for s in stems)), sorted(stems)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from labelled documents of the learnable ids."""
    small_batches(docs.sparkSession)
    labelled = labels.filter(learnable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [tuple(r) for r in _sample(labelled, rows).collect()]
    if not chosen:
        return ToxicityModel([], [], np.zeros(6), -30.0)
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int, half int"))  # bounded by `rows`
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    sample = sample.groupBy("doc_id", "toxic", "half").agg(F.min("text").alias("text")).cache()  # one text an id
    teaching = sample.filter("half = 0")
    sketches = teaching.select("doc_id", "toxic", least_hashes(F.col("text")).alias("least")).orderBy("doc_id").collect()  # bounded by `rows`
    apart = []
    for toxic in (0, 1):
        of_label = [r for r in sketches if r["toxic"] == toxic]
        apart += [(of_label[k]["doc_id"],) for k in first_of_copies([bytes(r["least"]) for r in of_label])]
    once = teaching.join(F.broadcast(spark.createDataFrame(apart, "doc_id long")), "doc_id")
    terms, stems = learn_lexicon(once.select("text", "toxic"))

    @F.pandas_udf("array<double>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(features_of(list(texts), _known(tuple(terms), tuple(stems))))

    got = sample.filter("half = 1").select("toxic", found("text").alias("f")).toPandas()
    sample.unpersist()
    share = (sum(t for _, t, _ in chosen) + 0.5) / (len(chosen) + 1)
    if not len(got) or got["toxic"].nunique() < 2 or not (terms or stems):
        return ToxicityModel(terms, stems, np.zeros(6), math.log(share / (1 - share)))
    x, y = np.stack(got["f"]).astype(np.float32), got["toxic"].to_numpy()
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = fit_linear(x, (2.0 * y - 1)[:, None].astype(np.float32), weight, rounds=400, decay=1e-3)
    return ToxicityModel(terms, stems, w[:, 0].astype(float), float(b[0]))


def score(text: Column, model: ToxicityModel) -> Column:
    """Score of a text column between 0 and 1."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)))

    return scores(text)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    model = train(docs, labels, ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
