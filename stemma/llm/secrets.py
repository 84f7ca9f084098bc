"""Secrets in texts, and weak candidates that only count together.

Strong (base) spans stand by themselves: assignments of long values, access identifiers and
long hexadecimal runs. Parts that prove nothing alone, i.e. short or oddly named secrets,
account names and endpoints, are reported only where complementary parts lie in one scope:
parts are exploded to rows, and secrets are interval-joined with identifiers and endpoints
whose spans lie within `SCOPE` code points. Bins as wide as the scope make that an equi-join;
as spans do not overlap, a bin holds a bounded number of them, however long the text.

Everything is DataFrame functions; positions are code points, end exclusive. Starts come from
the lengths of what lies between the matches, so a text is read once per pattern; sums over
many matches go in chunks (`folded`), and masking goes in blocks of the text, so the work
grows with the text and not with the square of its matches.

Defined results: null text counts as empty; an empty text has no spans, the digest of the
empty string and empty `spans`; spans of one start are ordered by kind, then end; repeated
rows each get their row (links are found per distinct row); empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import read_table, written

#: Base patterns (letters of the first in either case), and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Weak parts: secrets by other names or shorter than base ones, account names, endpoints.
WEAK_SECRET = r"""(passphrase|pwd|access_?key|private_?key|auth|credentials?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
WEAK_ID = r"""(client_?id|key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z]+|mongodb|redis|amqp)://[A-Za-z0-9@:._-]+|(?:host|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9:/._-]{4,}"""
#: Least length of a base assignment's value that is too short to stand alone.
SHORT_VALUE = 6
#: Code points between parts of one credential, at most.
SCOPE = 240
#: Kinds in the order of ties; the base ones first.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
SPAN = "struct<start:int,kind:int,end:int,value:int>"
#: Items of an array that are folded at once, and code points of a block of text that is masked.
CHUNK, BLOCK = 128, 2048


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(items: Column, zero: Column, step, emit, none: Column) -> Column:
    """Array of emit(state, item) over an array, where step(state, item) is the next state.

    Spark's arrays grow by copying, so a plain fold that appends costs the square of its
    length. Here the states at the heads of chunks are found first; then each chunk is folded
    by itself.
    """

    def chunks(all_items: Column) -> Column:
        heads = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_items) / CHUNK).cast("int") - 1, F.lit(0)))
        return F.transform(heads, lambda k: F.slice(all_items, k * CHUNK + 1, CHUNK))

    def states(parts: Column) -> Column:
        start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("heads"))
        return F.aggregate(parts, start, lambda s, part: F.struct(F.aggregate(part, s["now"], step).alias("now"), F.concat(s["heads"], F.array(s["now"])).alias("heads")), lambda s: s["heads"])

    def within(part: Column, head: Column) -> Column:
        start = F.struct(head.alias("now"), none.alias("out"))
        return F.aggregate(part, start, lambda s, x: F.struct(step(s["now"], x).alias("now"), F.concat(s["out"], F.array(emit(s["now"], x))).alias("out")), lambda s: s["out"])

    return let(items, lambda all_items: let(chunks(all_items), lambda parts: F.flatten(F.zip_with(parts, states(parts), within))))


def matches(text: Column, pattern: str, kind: str, value_group: bool = False, fold: bool = False) -> Column:
    """array<struct<start, kind, end, value>>: leftmost non-overlapping matches of a pattern.

    value is the length of group 2, or of the match. The parts between the matches give the
    starts: each is all parts up to the match plus all matches before it.
    """
    regex = f"(?i){pattern}" if fold else pattern
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    between = F.split(text, regex, -1)
    number = KINDS.index(kind)

    def after(at: Column, pair: Column) -> Column:
        return at + F.length(pair["between"]) + F.length(pair["found"])

    def span(at: Column, pair: Column) -> Column:
        start, end = at + F.length(pair["between"]), after(at, pair)
        value = F.length(F.regexp_extract(pair["found"], regex, 2)) if value_group else end - start
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), value.alias("value"))

    pairs = let(found, lambda f: F.arrays_zip(F.slice(between, F.lit(1), F.size(f)).alias("between"), f.alias("found")))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    walked = folded(pairs, F.lit(0), after, span, none)
    return F.when(text.rlike(regex), walked).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row_key, and all base and weak spans of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    assign = matches(F.col("text"), ASSIGN, "assign", value_group=True, fold=True)
    spans = rows.select(
        "doc_id",
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").cast("binary")).alias("row_key"),
        assign.alias("assign"),
        # runs are maximal, so a least length in the pattern drops what fails and nothing else
        matches(F.col("text"), f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "access").alias("access"),
        matches(F.col("text"), f"[0-9a-f]{{{LEAST['hex']},}}", "hex").alias("hex"),
        matches(F.col("text"), WEAK_SECRET, "weak_secret", fold=True).alias("weak_secret"),
        matches(F.col("text"), WEAK_ID, "weak_id", fold=True).alias("weak_id"),
        matches(F.col("text"), ENDPOINT, "endpoint", fold=True).alias("endpoint"),
    )
    weak = F.lit(KINDS.index("weak_secret"))
    short = F.transform(
        F.filter("assign", lambda s: (s["value"] < LEAST["assign"]) & (s["value"] >= SHORT_VALUE)),
        lambda s: F.struct(s["start"].alias("start"), weak.alias("kind"), s["end"].alias("end"), s["value"].alias("value")),
    )
    return spans.select(
        "doc_id",
        "row_key",
        F.filter("assign", lambda s: s["value"] >= LEAST["assign"]).alias("assign"),
        "access",
        "hex",
        F.concat("weak_secret", short).alias("weak_secret"),
        "weak_id",
        "endpoint",
    )


def linked_parts(found: DataFrame) -> DataFrame:
    """row_key and the weak spans that have a complementary part in their scope.

    A weak secret needs an identifier or an endpoint, an account name or an endpoint needs a
    secret. Rows without a secret or without another part leave before the join.
    """
    both = found.filter((F.size("assign") + F.size("weak_secret") > 0) & (F.size("access") + F.size("weak_id") + F.size("endpoint") > 0))

    def exploded(*kinds: str) -> DataFrame:
        return both.select("row_key", F.explode(F.concat(*kinds)).alias("s")).distinct().select("row_key", "s.start", "s.kind", "s.end")

    first, last = F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE)
    secrets = exploded("assign", "weak_secret").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))))
    others = exploded("access", "weak_id", "endpoint").withColumn("bin", F.explode(F.sequence(first, last)))
    near = (F.col("o.start") <= F.col("s.end") + SCOPE) & (F.col("s.start") <= F.col("o.end") + SCOPE)
    pairs = secrets.alias("s").join(others.alias("o"), ["row_key", "bin"]).filter(near)
    sides = pairs.select("row_key", F.explode(F.array(*(F.struct(*(F.col(f"{side}.{c}").alias(c) for c in ("start", "kind", "end"))) for side in "so"))).alias("span"))
    weak = sides.filter(F.col("span.kind") >= KINDS.index("weak_secret")).distinct()
    return weak.groupBy("row_key").agg(F.collect_list("span").alias("linked"))


def joined(spans: Column) -> Column:
    """kind:start:end of ordered spans, by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def ordered(*spans: Column | str) -> Column:
    plain = F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(plain)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, row_key, the three counts, and ordered base and linked spans.

    The parts are written once, without the texts; only rows that can have links are joined.
    """
    found = written(parts(docs), "secret-parts")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    base = ordered("assign", "access", "hex")
    rows = found.select("doc_id", "row_key", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"), (F.size(F.concat("weak_secret", "weak_id", "endpoint")) > 0).alias("weak"))
    with_weak = rows.filter("weak").join(linked_parts(found), "row_key", "left").withColumn("linked", F.coalesce("linked", none))
    return rows.filter("not weak").withColumn("linked", none).unionByName(with_weak).drop("weak")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(ordered("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each ordered span that starts behind all before it as the mask, and what overlaps gone.

    What stays lies between the spans. It is cut out of blocks of the text, as a code point of
    a string is only found by walking there.
    """
    gap = "struct<from:int,to:int,mask:boolean>"

    def reach(at: Column, span: Column) -> Column:
        return F.greatest(at, span["end"])

    def before(at: Column, span: Column) -> Column:
        return F.struct(at.alias("from"), F.greatest(at, span["start"]).alias("to"), (span["start"] >= at).alias("mask"))

    none = F.expr(f"cast(array() as array<{gap}>)")
    behind = F.struct(F.aggregate(spans, F.lit(0), reach).alias("from"), F.length(text).alias("to"), F.lit(False).alias("mask"))
    gaps = F.concat(folded(spans, F.lit(0), reach, before, none), F.array(behind))
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(parts: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")

        def cut(k: Column) -> Column:
            left = F.greatest(begin - k * BLOCK, F.lit(0))
            return F.substring(F.element_at(parts, k + 1), left + 1, F.least(end - k * BLOCK, F.lit(BLOCK)) - left)

        return F.when(end > begin, F.array_join(F.transform(F.sequence(first, last), cut), "")).otherwise("")

    def with_mask(parts: Column, g: Column) -> Column:
        return F.concat(piece(parts, g["from"], g["to"]), F.when(g["mask"], F.lit(mask)).otherwise(""))

    return let(blocks, lambda parts: F.array_join(F.transform(gaps, lambda g: with_mask(parts, g)), ""))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows with every base secret and every weak secret of a linked credential masked.

    Account names and endpoints stay. Rows without anything like a secret are passed on without a join; all
    columns are kept, and n_chars, where there is one, is that of the new text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    suspect = text.rlike(f"(?i){ASSIGN}|{WEAK_SECRET}") | text.rlike(f"AKIA[A-Z0-9]{{{LEAST['access'] - 4}}}|[0-9a-f]{{{LEAST['hex']}}}")
    rest, docs = docs.filter(~suspect), docs.filter(suspect)
    key = "row_key"
    row_key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).cast("binary"))
    hits = scan(docs.select("doc_id", "text"))
    secret = F.filter(ordered("base", "linked"), lambda s: s["kind"] <= KINDS.index("weak_secret"))
    spans = hits.select(key, secret.alias("spans")).filter(F.size("spans") > 0).dropDuplicates([key])
    names = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), row_key.alias(key)).join(spans, key, "left")
    masked_text = F.when(F.size("spans") > 0, masked(F.col("row.text"), F.col("spans"), mask)).otherwise(F.col("row.text"))
    # made by a generator, so that Python functions that follow take a column and not all of this
    inner = inner.select("row", "spans", F.explode(F.array(masked_text)).alias("new"))
    new = F.col("new")
    changed = F.size("spans") > 0
    columns = []
    for c in names:
        if c == "text":
            columns.append(new.alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(changed, F.length(new).cast(kind)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return rest.unionByName(inner.select(*columns))


def _sql_matches(pattern: str, kind: int, flags: str = "") -> str:
    """DuckDB: list of {start, kind, end, found} of all matches in `text`."""
    p = "'" + (flags + pattern).replace("'", "''") + "'"
    m, b = f"regexp_extract_all(text, {p}, 0)", f"list_transform(string_split_regex(text, {p}), lambda x: length(x))"
    return f"""list_transform(generate_series(1, len({m})), lambda i: {{
      'start': CAST(list_sum(({b})[1:i]) + coalesce(list_sum(list_transform(({m})[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'kind': {kind},
      'end': CAST(list_sum(({b})[1:i]) + list_sum(list_transform(({m})[1:i], lambda x: length(x))) AS BIGINT), 'found': ({m})[i]}})"""


def _folded(pattern: str) -> str:
    """The words of a pattern with ASCII letters in either case (RE2 folds beyond ASCII)."""
    import re

    head, _, tail = pattern.partition(")")
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head) + ")" + tail


def _oracle() -> str:
    import re

    groups = ENDPOINT.split("|(?:host")
    endpoint = re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", groups[0].split("://")[0].replace("[a-z]", "@")).replace("@", "[A-Za-z]").replace("(?:", "(?:") + "://" + groups[0].split("://")[1]
    endpoint += "|" + _folded("(?:host" + groups[1])
    value = "length(regexp_extract(s.found, '" + _folded(ASSIGN).replace("'", "''") + "', 2))"
    near = f"(t.start <= s.end + {SCOPE} AND s.start <= t.end + {SCOPE})"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
m AS (SELECT doc_id, r, {_sql_matches(_folded(ASSIGN), 0)} AS a, {_sql_matches(f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 1)} AS k,
  {_sql_matches(f"[0-9a-f]{{{LEAST['hex']},}}", 2)} AS h, {_sql_matches(_folded(WEAK_SECRET), 3)} AS w,
  {_sql_matches(_folded(WEAK_ID), 4)} AS i, {_sql_matches(endpoint, 5)} AS e FROM t),
all_spans AS (
  SELECT r, s.start AS start, CASE WHEN s.kind = 0 AND {value} < {LEAST['assign']} THEN 3 ELSE s.kind END AS kind, s.end AS "end"
  FROM (SELECT r, unnest(a || k || h || w || i || e) AS s FROM m)
  WHERE s.kind <> 0 OR {value} >= {SHORT_VALUE}),
kept AS (
  SELECT DISTINCT * FROM all_spans AS s WHERE kind <= 2
    OR (kind = 3 AND EXISTS (SELECT 1 FROM all_spans AS t WHERE t.r = s.r AND t.kind IN (1, 4, 5) AND {near}))
    OR (kind >= 4 AND EXISTS (SELECT 1 FROM all_spans AS t WHERE t.r = s.r AND t.kind IN (0, 3) AND {near}))),
named AS (SELECT *, {list(KINDS)}[kind + 1] || ':' || start || ':' || "end" AS name FROM kept),
docs AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_linked,
  string_agg(name, ',' ORDER BY start, kind, "end") FILTER (kind <= 2) AS base, string_agg(name, ',' ORDER BY start, kind, "end") AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM t LEFT JOIN docs USING (r)"""


ORACLE = _oracle()
