"""Normal forms of text as Catalyst expressions.

The forms build on each other: `n1` repairs extraction damage, `n2` unifies typography,
`n3` is the form for comparing meaning, and `compare_key` decides equality. Input is NFC
(`nfc` at ingest, the one step that has no built-in function).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ligatures, spaces, quotes and dashes that are unified.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
SPACES = "     ⁠﻿"
QUOTES = "„“”‚‘’«»"
QUOTES_TO = "\"\"\"'''\"\""
DASHES = "–—‐‑−"
#: Fixed value: blocks of characters that are not glyph damage.
GOOD = "\\x{0}-\\x{24F}\\x{370}-\\x{3FF}\\x{1E00}-\\x{1EFF}\\x{2000}-\\x{27BF}"
#: Fixed value: what carries information in a compare key.
KEY_CHARS = "0-9a-zäöüß%<>≤≥=+"
# The signs that fall, with those that a text mostly has told by its first ranges: Java tries one
# range of a class after the other, for each sign of a text.
DAMAGE = f"[\\x{{250}}-\\x{{10FFFF}}&&[^{GOOD}]]+"
NO_KEY = r"[\x00-$&-*,-/:;?-`{-\x{10FFFF}&&[^äöüß≤≥]]+"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, and plain letters for mathematical alphanumerics."""
    def fold(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        t = unicodedata.normalize("NFC", t)
        return "".join(unicodedata.normalize("NFKC", c) if 0x1D400 <= ord(c) <= 0x1D7FF else c for c in t)

    return text.map(fold)


def _ligatures(text: Column) -> Column:
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def n1(text: Column) -> Column:
    t = _ligatures(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, DAMAGE, "…")
    t = F.translate(t, "‐‑" + SPACES + "\n\t­", "--" + " " * (len(SPACES) + 2))
    t = F.replace(t, F.lit("\r "), F.lit(" "))
    return F.regexp_replace(t, r"(?U)([a-zäöüß])-\s+(?!(?:und|oder|bzw|sowie|als)\b)([a-zäöüß])", "$1$2")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def n2(text: Column) -> Column:
    return collapse(F.translate(n1(text), QUOTES + DASHES, QUOTES_TO + "-" * len(DASHES)))


def canon_numbers(text: Column) -> Column:
    """1.234,56 becomes 1234.56 and 1.234 becomes 1234; dots of up to four groups go.

    Texts without a digit behind a dot or comma, which all patterns need, are not searched.
    """
    return let(text, lambda t: F.when(t.rlike(r"(?U)[.,]\d"), _canon_numbers(t)).otherwise(t))


def _canon_numbers(t: Column) -> Column:
    for groups in range(4, 0, -1):
        whole = r"(\d{1,3})" + r"\.(\d{3})" * groups
        t = F.regexp_replace(t, rf"(?U)(?<![\w,.]){whole},(\d+)(?!\w)", "".join(f"${g}" for g in range(1, groups + 2)) + f".${groups + 2}")
    t = F.regexp_replace(t, r"(?U)(?<![\w,.])(\d+),(\d+)(?!\w)", "$1.$2")
    return F.regexp_replace(t, r"(?U)(?<![\w,.])(\d{1,3})\.(\d{3})(?!\d)", "$1$2")


def n3(text: Column) -> Column:
    t = canon_numbers(F.lower(n2(text)))
    t = F.regexp_replace(t, r"(?U)(?<=\w)-(?=\w)", "")
    return collapse(F.regexp_replace(t, r"[.,;:!?()\[\]{}\"']", " "))


def compare_key(text: Column) -> Column:
    """Equal keys mean equal texts. All that `n3` does besides lower case falls to the filter."""
    t = F.lower(_ligatures(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.replace(t, F.lit(" "), F.lit("")), NO_KEY, "")


def garbage_ratio(text: Column) -> Column:
    """Share of visible characters outside the good blocks."""
    visible = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    bad = F.regexp_replace(visible, f"[{GOOD}\\x{{1D400}}-\\x{{1D7FF}}]+", "")
    return F.when(F.length(visible) == 0, F.lit(0.0)).otherwise(F.length(bad) / F.length(visible))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_ngrams(text: Column) -> Column:
    """Character 3- and 4-grams of a text with a space before and behind, in one pass for each size."""
    grams = lambda padded, n: F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return let(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), lambda p: F.concat(grams(p, 3), grams(p, 4)))


def word_trigrams(text: Column) -> Column:
    """Distinct word trigrams of a normal form; fewer than three words are one gram."""

    def grams(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))
        return F.array_distinct(F.transform(at, lambda k: F.array_join(F.slice(words, k, F.lit(3)), " ")))

    return let(F.filter(F.split(text, " "), lambda w: w != ""), grams)


# Abbreviations that end no sentence.
ABBREVIATIONS = (
    r"bzw|z\. ?B|u\. ?a|d\. ?h|i\. ?d\. ?R|ggf|evtl|max|min|ca|vgl|Nr|Abs|Kap|Tab|Abb|"
    r"inkl|zzgl|u\. ?U|o\. ?ä|o\. ?g|s\. ?o|s\. ?u|usw|etc|Hrsg|Aufl|S|f|ff|Pkt|gem|"
    r"engl|dt|allg|techn|el|Fa|Ing|Dr|Prof"
)


def sentences(text: Column) -> Column:
    """Sentences of an n1 or n2 text; a part after an abbreviation or a numbered dot rejoins."""
    parts = F.filter(F.transform(F.split(text, r'(?U)(?<=[.!?:])\s+(?=[A-ZÄÖÜ0-9„"(])'), F.trim), lambda p: p != "")
    open_end = rf"(?iU)(?:\b(?:{ABBREVIATIONS})\.)$|\b\d+\.$"
    empty = F.expr("cast(array() as array<string>)")

    def add(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        rejoined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", last, part)))
        return F.when((F.size(done) > 0) & last.rlike(open_end), rejoined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, empty, add)
