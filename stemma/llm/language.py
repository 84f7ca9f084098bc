"""Language of a text by error-correcting output codes.

Every language has a codeword; one binary linear classifier over hashed byte n-grams predicts
each bit. Decoding weighs each classifier's logistic loss by how reliable that classifier is
on the language in question (measured on rows kept out of its training) and takes the nearest
codeword. A second codeword almost as near makes the prediction ambiguous.

Training takes at most `SAMPLE_ROWS` labelled rows, equally many of each language as far as
there are, chosen by a hash of the id; only their n-gram counts come to the driver.

Defined results: null texts and texts without a letter are `und` with score 0; without any
labelled row everything is `und`; with one learned language every text with a letter is that
language; equally near codewords go to the first language by name; texts are read whole;
repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import free_name, id_fold, read_table, small_batches

#: Rows that classifiers are fitted on, at most.
SAMPLE_ROWS = 2000
#: Buckets that byte n-grams of orders 1 to 3 are hashed into.
BUCKETS = 4096
#: A prediction is ambiguous if its probability leads the next by less than this.
MARGIN = 0.1
#: The fold of doc_ids that is never learned from, of so many.
HELD_OUT, FOLDS = 2, 4
UNKNOWN = "und"

#: ASCII that is no letter becomes a space, so that n-grams see words and their ends.
_SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and (any(c.isalpha() for c in text[:200]) or any(c.isalpha() for c in text))


def ngram_counts(text: str) -> np.ndarray:
    """Hellinger-scaled counts of hashed byte n-grams of a whole text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", np.uint8).astype(np.int32)
    b = b[(b != 32) | np.concatenate([[True], b[:-1] != 32])]  # runs of spaces count as one
    two = b[:-1] * 257 + b[1:]
    three = two[:-1] * 263 + b[2:]
    grams = [b, two * 31 + 7, three * 17 + 3]
    counts = sum(np.bincount((g ^ (g >> 9)) & (BUCKETS - 1), minlength=BUCKETS) for g in grams).astype(np.float32)
    scaled = np.sqrt(counts)
    return scaled / max(float(np.linalg.norm(scaled)), 1e-9)


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to six languages get the exhaustive code (every split of the languages in two once);
    more get the best of random codes by least distance between rows, of fixed seed.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 6:
        rest = range(1, languages)
        splits = [set(c) for n in range(1, languages) for c in combinations(rest, n)]
        return np.array([[-1.0 if k in s else 1.0 for s in splits] for k in range(languages)])
    bits, rng = math.ceil(10 * math.log2(languages)), np.random.default_rng(20)
    best, most = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        if (np.abs(code.sum(0)) == languages).any():
            continue
        apart = (bits - code @ code.T) / 2 + np.eye(languages) * bits
        if apart.min() > most:
            best, most = code, apart.min()
    return best


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all columns of y (+1, -1) at once, by accelerated gradient."""
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = c = np.zeros(y.shape[1], np.float32)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    rate = np.float32(4.0 / (float(weight[:, 0] @ np.einsum("ij,ij->i", x, x)) + 1))
    for k in range(rounds):
        p = weight * y / (1 + np.exp(np.clip(y * (x @ v + c), -30, 30)))
        new, new_b = v + rate * (x.T @ p - np.float32(decay) * v), c + rate * p.sum(0)
        ahead = np.float32(k / (k + 3))
        w, v = new, new + ahead * (new - w)
        b, c = new_b, new_b + ahead * (new_b - b)
    return w, b


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    reliability: np.ndarray | None = None
    temperature: float = 1.0

    def distances(self, bits: np.ndarray) -> np.ndarray:
        """Loss of each row's bits against every codeword, weighed by reliability."""
        losses = np.logaddexp(0, -self.code[None] * bits[:, None])
        return (losses * self.reliability[None]).sum(2)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, probability and ambiguity of each text."""
        out = [(UNKNOWN, 0.0, False)] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        if not known or not self.languages:
            return out
        if len(self.languages) == 1:
            for k in known:
                out[k] = (self.languages[0], 1.0, False)
            return out
        bits = np.stack([ngram_counts(texts[k]) @ self.weights for k in known]) + self.bias
        close = -self.temperature * self.distances(bits)
        p = np.exp(close - close.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        for k, row, (first, second) in zip(known, p, order[:, :2]):
            out[k] = (self.languages[first], float(row[first]), bool(row[first] - row[second] < MARGIN))
        return out


def fit(languages: np.ndarray, grams: np.ndarray) -> LanguageModel:
    """Classifiers on four fifths of the rows; their reliability per language on the rest."""
    names = sorted(set(languages.tolist()))
    if len(names) < 2:
        return LanguageModel(names, codewords(len(names)))
    code = codewords(len(names))
    of = np.array([names.index(x) for x in languages])
    y = code[of].astype(np.float32)
    share = 1.0 / np.bincount(of, minlength=len(names))[of]
    test = np.arange(len(of)) % 5 == 4
    w, b = fit_linear(grams[~test], y[~test], share[~test])
    bits = grams[test] @ w + b
    right = np.ones((len(names), code.shape[1]))
    for k in range(len(names)):
        own = of[test] == k
        if own.any():  # smoothed accuracy of each classifier on this language
            right[k] = ((bits[own] * code[k] > 0).sum(0) + 1) / (own.sum() + 2)
    model = LanguageModel(names, code, w, b, right / right.sum(1, keepdims=True))
    scales = [0.5, 1, 2, 4, 8, 16, 32]
    if test.any():  # the temperature under which the kept-out rows are likeliest
        d = -model.distances(bits)
        logp = [np.mean((s * d - np.logaddexp.reduce(s * d, 1)[:, None])[np.arange(len(d)), of[test]]) for s in scales]
        model.temperature = scales[int(np.argmax(logp))]
    w, b = fit_linear(grams, y, share)
    model.weights, model.bias = w, b
    return model


def train(docs: DataFrame, learnable: Column, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from a bounded sample of the learnable rows with a language and a letter."""
    small_batches(docs.sparkSession)
    rows_of = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows_of.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([])
    each = max(1, rows // len(counts))
    place = F.xxhash64(F.col("doc_id"), F.lit(3)).cast("double") / F.lit(2.0**64) + 0.5
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (place <= F.lit(min(1.0, each / n))))

    @F.pandas_udf("binary")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([ngram_counts(t).astype(np.float16).tobytes() for t in texts])

    # about `each` rows a language come to the driver, as counts of fixed size; the limit only
    # bites where rows that repeat an id share its hash
    sample = rows_of.filter(chosen).select("doc_id", "lang", grams("text").alias("grams")).limit(4 * rows).toPandas().sort_values(["doc_id", "grams"])
    counted = np.frombuffer(b"".join(sample["grams"]), np.float16).reshape(len(sample), -1).astype(np.float32)
    return fit(sample["lang"].to_numpy(), counted)


def predictions(text: Column, model: LanguageModel) -> Column:
    """struct<lang_pred, score, ambiguous> of a text column."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict(list(texts)), columns=["lang_pred", "score", "ambiguous"])

    return predict(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_fold(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id")))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictions(F.col("text"), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def drop_unknown(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Documents whose language could be told: neither without letters nor ambiguous."""
    p = free_name(docs, "predicted")
    rows = docs.withColumn(p, predictions(F.col("text"), model))
    return rows.filter((F.col(f"{p}.lang_pred") != UNKNOWN) & ~F.col(f"{p}.ambiguous")).drop(p)
