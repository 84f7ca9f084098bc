"""Documents from the lines of a page layout, as a PDF library gives them.

Lines are rows (doc, ix, page, y, x, x1, size, bold, fonts, text, page_height), the outline rows
(doc, ix, title, page). What a line is follows from its text, its neighbours and the outline;
counts and the outline are relational, and the paragraphs of a document are read line by line in
one task, as each line depends on what stands open before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators.diff import plain_garbage

# Front matter, navigation lists, and the measures of a page.
FRONT = ["vorwort", "einleitung", "anwendungsbeginn", "änderungen"]
NAVIGATION = ["inhalt", "inhaltsverzeichnis", "bilder", "tabellen", "contents", "table of contents", "figures", "tables"]
EDGE, REPEATED, GAP, WRAPPED_LINES, TERM_CHARS = 0.07, 0.3, 1.7, 3, 60
CAPTION = re.compile(r"^\s*(Tabelle|Bild|Abbildung)\s+([A-Z]?\.?\d+(?:\.\d+)*[a-z]?)(.*)$")
CAPTION_REST = re.compile(r"^\s*(?:[–—\-:]|[A-ZÄÖÜ(\[„“\"])")
BULLET = re.compile(r"^\s*(?:[–—•\-]\s+|[a-z]\)\s+|\d+\)\s+|[ivx]+\.\s+)")
NOTE = re.compile(r"^\s*(?:ANMERKUNG|BEISPIEL)")
SENTENCE_END = re.compile(r"[.!?:;]\s*$")
FORMULA_SIGNS = frozenset("=≤≥<>±×⋅·∙√∑∏∫Δφϕαβγητωπ∞≈")


# ---------------------------------------------------------------- outline


def outline_sections(outline: DataFrame, doc_titles: DataFrame | None = None) -> DataFrame:
    """(doc, section_id, title, level, part, page, ix): chapters of an outline, the first of an id.

    Main chapters count until the first annex; annexes carry their letter to their parts;
    navigation lists and repetitions of the document's own title are no chapters.
    """
    title = F.trim(F.regexp_replace("title", r"(?U)\s+", " "))
    low = F.lower(title)
    rows = outline.filter("page > 0").withColumn("title", title).filter((low != "") & ~low.isin(NAVIGATION))
    if doc_titles is not None:
        own = F.lower(F.trim("doc_title"))
        t = F.lower("title")
        repeats = (own != "") & ((t == own) | ((F.length(t) > 3) & F.contains(own, t)))
        rows = rows.join(doc_titles, "doc", "left").filter(~F.coalesce(repeats, F.lit(False))).drop("doc_title")
    annex = r"^Anhang\s+([A-Z])\s*(?:\((normativ|informativ)\))?\s*[–—\-:]?\s*(.*)$"
    get = lambda pattern, n: F.nullif(F.regexp_extract("title", pattern, n), F.lit(""))
    before = Window.partitionBy("doc").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    letter = get(annex, 1)
    rows = rows.withColumns({"own_letter": letter, "letter": F.last(letter, ignorenulls=True).over(before), "annex_part": F.last(F.when(letter.isNotNull(), F.concat(F.lit("anhang_"), F.coalesce(get(annex, 2), F.lit("normativ")))), ignorenulls=True).over(before)})
    main, sub = r"^(\d+(?:\.\d+)*)\s+(.*)$", r"^([A-Z])\.(\d+(?:\.\d+)*)\s+(.*)$"
    part_of_annex = get(sub, 1).eqNullSafe(F.col("letter")) & get(sub, 1).isNotNull()
    is_main = get(main, 1).isNotNull() & F.col("letter").isNull()
    low = F.lower("title")
    dots = lambda c: F.size(F.split(c, r"\."))
    one = lambda i, t, level, part: F.struct(i.alias("section_id"), t.alias("title"), F.lit(level).cast("int").alias("level") if isinstance(level, int) else level.cast("int").alias("level"), part.alias("part"))
    kind = (
        F.when(F.col("own_letter").isNotNull(), one(F.col("own_letter"), F.coalesce(get(annex, 3), F.col("title")), 1, F.col("annex_part")))
        .when(part_of_annex, one(F.concat_ws(".", get(sub, 1), get(sub, 2)), get(sub, 3), 1 + dots(get(sub, 2)), F.col("annex_part")))
        .when(is_main, one(get(main, 1), get(main, 2), dots(get(main, 1)), F.lit("hauptteil")))
        .when(low.startswith("literatur"), one(F.lit("Literatur"), F.col("title"), 1, F.lit("literatur")))
        .when(low.isin(FRONT), one(F.concat(F.lit("vorspann."), low), F.col("title"), 1, F.lit("vorspann")))
    )
    found = rows.withColumn("s", kind).filter("s is not null").select("doc", "ix", "page", "s.*")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "section_id").orderBy("ix"))).filter("nth = 1").drop("nth")


# ---------------------------------------------------------------- lines


def reading_order(spans: DataFrame) -> DataFrame:
    """Lines of (doc, line, k, x, text) spans: their texts from left to right, equal places as drawn."""
    parts = F.array_sort(F.collect_list(F.struct("x", "k", "text")))
    return spans.groupBy("doc", "line").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "").alias("text"))


def edge_key(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), r"\d+", "#"), 1, 60)


def without_page_edges(lines: DataFrame) -> DataFrame:
    """Lines but for running heads and feet: at the edge of the page, and repeated on many pages or numbers."""
    at_edge = (F.col("y") < EDGE * F.col("page_height")) | (F.col("y") > (1 - EDGE) * F.col("page_height"))
    rows = lines.withColumns({"at_edge": at_edge, "edge_key": edge_key(F.col("text"))}).filter(F.trim("text") != "")
    pages = lines.groupBy("doc").agg(F.max("page").alias("pages"))
    repeated = rows.filter("at_edge").groupBy("doc", "edge_key").agg(F.count(F.lit(1)).alias("n")).join(pages, "doc").filter(F.col("n") >= REPEATED * F.col("pages"))
    kept = rows.join(repeated.select("doc", "edge_key", F.lit(True).alias("at_edge"), F.lit(True).alias("again")), ["doc", "edge_key", "at_edge"], "left")
    number = F.col("at_edge") & F.trim("text").rlike(r"^[–\-\s]*\d+[–\-\s]*$")
    return kept.filter(~F.coalesce("again", F.lit(False)) & ~number).drop("again", "edge_key", "at_edge")


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc, body_size): the most frequent rounded font size, the least among equals."""
    return lines.groupBy("doc").agg(F.mode(F.round("size"), True).alias("body_size"))


def claimed_assets(assets: DataFrame, section_pages: DataFrame) -> DataFrame:
    """Assets (doc, asset_id, page) with the first section (doc, sec_ix, page) that touches their page."""
    return assets.join(section_pages, ["doc", "page"]).groupBy("doc", "asset_id").agg(F.min("sec_ix").alias("sec_ix"))


# ---------------------------------------------------------------- paragraphs of one document


def is_caption(text: str) -> re.Match | None:
    """Keyword and number of a caption, if what follows belongs to one."""
    m = CAPTION.match(text)
    return m if m and CAPTION_REST.match(m[3]) else None


def is_formula(text: str, fonts: tuple[str, ...] = ()) -> bool:
    """Broken glyphs, an equation number behind a short line, or many signs."""
    t = text.strip()
    if not t:
        return False
    visible = sum(not c.isspace() for c in t)
    garbage, signs = plain_garbage(t), sum(c in FORMULA_SIGNS for c in t)
    broken = garbage > 0.15 or (garbage > 0.06 and garbage * visible >= 2)
    numbered = bool(re.search(r"\(\d{1,3}\)\s*$", t)) and (signs >= 1 or garbage > 0 or len(t) < 80)
    dense = signs >= max(2, 0.04 * len(t))
    slanted = signs >= 1 and sum(c.isalpha() for c in t) < 40 and any(w in f for f in fonts for w in ("Italic", "Symbol", "Math"))
    return broken or numbered or dense or slanted


@dataclass
class Line:
    page: int
    y: float
    size: float
    bold: bool
    fonts: tuple[str, ...]
    text: str
    page_edge: bool = False

    def far_below(self, above: Line) -> bool:
        return self.page == above.page and self.y - above.y > self.size * GAP


@dataclass
class Reader:
    """Paragraphs of one section, line by line; `open` holds the texts of the one that goes on."""

    section_id: str
    in_terms: bool
    rows: list[dict] = field(default_factory=list)
    open: list[str] = field(default_factory=list)
    kind: str = "text"
    page: int = 0

    def close(self) -> None:
        text = " ".join(self.open).strip()
        if text:
            kind = "formula" if self.kind == "text" and is_formula(text) else self.kind
            self.rows.append({"kind": kind, "text": text, "page": self.page, "term_no": None})
        self.open = []

    def alone(self, kind: str, text: str, page: int, term_no: str | None = None) -> None:
        self.close()
        self.rows.append({"kind": kind, "text": text, "page": page, "term_no": term_no})

    def wrapped(self, lines: list[Line], k: int, text: str, stop) -> tuple[str, int]:
        """A text that runs on over the next lines, and the first line behind it."""
        j = k + 1
        while j < len(lines) and j - k < WRAPPED_LINES and not SENTENCE_END.search(text):
            t = lines[j].text.strip()
            apart = lines[j].page != lines[j - 1].page or lines[j].far_below(lines[j - 1])
            if apart or not t or BULLET.match(t) or re.fullmatch(r"\d{1,4}", t) or is_caption(t) or stop(t):
                break
            text, j = f"{text} {' '.join(t.split())}".strip(), j + 1
        return text, j

    def starts_anew(self, line: Line, before: Line | None, t: str) -> bool:
        if before is None or not self.open or BULLET.match(t) or NOTE.match(t):
            return True
        if line.page != before.page:
            said = " ".join(self.open)
            goes_on = not SENTENCE_END.search(said) and (t.strip()[:1].islower() or t.strip()[:1] in "(–-0123456789")
            return not goes_on
        return line.far_below(before)

    def read(self, lines: list[Line]) -> list[dict]:
        numbered = re.compile(rf"^({re.escape(self.section_id)}(?:\.\d+)+)\s*(.*)$") if re.match(r"^\d+(\.\d+)*$", self.section_id) else None
        sub = numbered.match if numbered else lambda t: None
        k, before, bullet, term = 0, None, False, None
        while k < len(lines):
            line, at = lines[k], k
            k += 1
            t = line.text.rstrip()
            if re.fullmatch(r"[–—\-•▪]", t.strip()):  # a bullet on a line of its own belongs to the next
                bullet, before = True, line
                continue
            if bullet:
                t, bullet = "– " + t.lstrip(), False
            if term:  # the name of a numbered term stands on the next line
                self.alone("term", t.strip(), line.page, term)
                term, before = None, line
                continue
            head, caption = sub(t.strip()), is_caption(t.strip())
            if head and (line.bold or len(head[2]) <= 90):
                self.close()
                rest = head[2].strip(" –—-:")
                if rest:
                    rest, k = self.wrapped(lines, at, rest, sub)
                    self.alone("term", rest, line.page, head[1])
                else:
                    term = head[1]
                before = lines[k - 1]
            elif caption and (line.bold or len(t.strip()) < 120):
                text, k = self.wrapped(lines, at, " ".join(t.split()), sub)
                self.alone("caption", text, line.page)
                before = lines[k - 1]
            elif (self.open or line.page_edge) and re.fullmatch(r"\d{1,4}", t.strip()):
                before = line  # a page number
            else:
                anew = self.starts_anew(line, before, t)
                name = anew and self.in_terms and 0 < len(t.strip()) <= TERM_CHARS and not (SENTENCE_END.search(t) or BULLET.match(t) or NOTE.match(t))
                if name:
                    self.alone("term", t.strip(), line.page)
                else:
                    if anew:
                        self.close()
                        self.page = line.page
                        self.kind = "note" if NOTE.match(t) else "list" if BULLET.match(t) else "formula" if is_formula(t, line.fonts) else "text"
                    self.open.append(t.strip())
                before = line
        self.close()
        return self.rows


def heading_place(lines: list[Line], start: int, section: dict, body_size: float) -> int | None:
    """The line of a section's heading, on its page or the next, from a line on."""
    sid, title = section["section_id"], " ".join(section["title"].split()).lower()[:24]
    numbered = section["part"] == "hauptteil" or re.match(r"^[A-Z](\.|$)", sid)
    for k in range(start, len(lines)):
        line = lines[k]
        if line.page > section["page"] + 1:
            return None
        t = " ".join(line.text.split())
        stands_out = line.bold or line.size > body_size
        if line.page < section["page"]:
            continue
        if numbered and re.match(rf"^{re.escape(sid)}(\s|$)", t):
            rest = t[len(sid) :].strip().lower()
            if not title or not rest or title.startswith(rest[:8]) or rest.startswith(title) or stands_out:
                return k
        elif sid.startswith("vorspann") or sid == "Literatur":
            if t.lower().startswith(title[:12]) and stands_out:
                return k
        elif len(sid) == 1 and sid.isalpha() and t.lower().startswith(f"anhang {sid.lower()}"):
            return k
    return None


def placed_sections(lines: list[Line], sections: list[dict], body_size: float) -> list[tuple[int, bool, dict]]:
    """Sections by the line they begin at; a heading that is not found leaves the first line of its page."""
    out, at = [], 0
    for s in sections:
        place = heading_place(lines, at, s, body_size)
        if place is not None:
            at = place + 1
            out.append((place, True, s))
        else:
            out.append((next((k for k, x in enumerate(lines) if x.page >= s["page"]), len(lines)), False, s))
    return sorted(out, key=lambda x: x[0])


def without_title(rows: list[dict], title: str) -> list[dict]:
    """Paragraphs without a first one that repeats the section's title, or that begins with it."""
    if not rows:
        return rows
    first, name = " ".join(rows[0]["text"].split()), " ".join(title.split()).lower()
    low = first.lower()
    if low and len(low) <= len(name) + 12 and (name.startswith(low[:40]) or low.startswith(name[:40])):
        return rows[1:]
    if len(name) >= 8 and low.startswith(name):
        rows[0]["text"] = first[len(name) :].lstrip(" –—-:")
    return rows


def read_document(lines: list[Line], sections: list[dict], body_size: float) -> list[tuple]:
    """(sec_ix, section_id, title, level, part, par_ix, kind, n0, page, term_no) rows of a document."""
    for k, line in enumerate(lines):
        line.page_edge = k == 0 or k == len(lines) - 1 or lines[k - 1].page != line.page or lines[k + 1].page != line.page
    terms = [s["section_id"] for s in sections if "begriff" in s["title"].lower()]
    places = placed_sections(lines, sections, body_size)
    out = []
    for n, (at, _, s) in enumerate(places):
        end = places[n + 1][0] if n + 1 < len(places) else len(lines)
        sid = s["section_id"]
        reader = Reader(sid, any(sid == r or sid.startswith(r + ".") for r in terms))
        rows = without_title(reader.read(lines[min(at + 1, len(lines)) : end]), s["title"])
        facts = (n, sid, s["title"], s["level"], s["part"])
        out.append((*facts, None, None, None, s["page"], None))
        out += [(*facts, k, r["kind"], r["text"], r["page"], r["term_no"]) for k, r in enumerate(rows)]
    return out


ROWS = "doc string, sec_ix int, section_id string, title string, level int, part string, par_ix int, kind string, n0 string, page int, term_no string"


def read_layout(lines: DataFrame, outline: DataFrame, doc_titles: DataFrame | None = None) -> DataFrame:
    """Paragraph rows of all documents; a document is one group, as its lines depend on each other."""
    sections = outline_sections(outline, doc_titles)
    body = without_page_edges(lines)
    sized = body.join(body_sizes(body), "doc")

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in ROWS.split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        left = left.sort_values("ix", kind="stable")
        read = [Line(int(r.page), float(r.y), float(r.size), bool(r.bold), tuple(r.fonts if r.fonts is not None else ()), r.text) for r in left.itertuples()]
        found = right.sort_values("ix", kind="stable")[["section_id", "title", "level", "part", "page"]].to_dict("records")
        rows = read_document(read, found, float(left["body_size"].iloc[0]))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names).astype({"par_ix": "Int32"})

    return sized.groupBy("doc").cogroup(sections.groupBy("doc")).applyInPandas(one, ROWS)
