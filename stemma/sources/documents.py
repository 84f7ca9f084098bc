"""Readers of document editions: Markdown, Word files and earlier results as JSON.

Each gives rows (doc, sec_ix, section_id, title, level, part, par_ix, kind, n0): one row per
paragraph, with the sections' columns repeated. A file is one task: headings, counters and
captions depend on all that stands before them.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "doc string, sec_ix int, section_id string, title string, level int, part string, par_ix int, kind string, n0 string"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Titles that open a part of a standard, and the style of headings.
FRONT = ("vorwort", "einleitung", "anwendungsbeginn", "änderungen")
NAVIGATION = ("inhalt", "inhaltsverzeichnis", "bilder", "tabellen", "contents", "table of contents", "figures", "tables")
HEADING = re.compile(r"^(?:berschrift|überschrift|heading)\s*([1-9])$", re.I)
ANNEX = re.compile(r"^Anhang\s+([A-Z])\b.*?(?:\((normativ|informativ)\))?", re.I)


class IngestError(ValueError):
    """A source that cannot be read as a document."""


class Sections:
    """Counters of headings: a deeper level starts anew, annexes count by letter."""

    def __init__(self, doc: str):
        self.doc, self.counts, self.letter, self.part = doc, [], "", "hauptteil"
        self.section = (-1, "", "", 0, "vorspann")
        self.par_ix, self.rows = 0, []

    def heading(self, title: str, level: int) -> str:
        annex, low = ANNEX.match(title), title.strip().lower()
        if low in FRONT:  # no number, so the chapters that follow count from one
            number, level, self.part = f"vorspann.{low}", 1, "vorspann"
        elif low.startswith("literatur"):
            number, level, self.part = "Literatur", 1, "literatur"
        elif annex:
            self.letter, self.counts = annex[1].upper(), [0]
            self.part = "anhang_normativ" if "normativ" in title.lower() else "anhang_informativ"
            number = self.letter
        else:
            if not self.letter:
                self.part = "hauptteil"
            self.counts = [*self.counts[:level], *[0] * (level - len(self.counts))]
            self.counts[level - 1] += 1
            steps = self.counts[1:] if self.letter else self.counts
            number = ".".join([*([self.letter] if self.letter else []), *map(str, steps)])
        self.section = (self.section[0] + 1, number, title.strip(), level, self.part)
        self.par_ix = 0
        self.rows.append((self.doc, *self.section, None, None, None))
        return number

    def paragraph(self, text: str, kind: str) -> None:
        self.rows.append((self.doc, *self.section, self.par_ix, kind, text))
        self.par_ix += 1


def parse_markdown(doc: str, text: str) -> list[tuple]:
    """`## 1 Title` opens a section (its number must be the counted one), `- x` is a list item."""
    out, block = Sections(doc), []

    def flush() -> None:
        if block:
            out.paragraph(" ".join(block), "text")
            block.clear()

    for line in (text or "").splitlines():
        head = re.match(r"^(#{2,})\s+(\S+)\s+(.*)$", line)
        if head:
            flush()
            number = out.heading(head[3], len(head[1]) - 1)
            if number != head[2]:
                raise IngestError(f"{doc}: section {head[2]} should be {number}")
        elif line.startswith("# "):
            flush()
            out.paragraph(line[2:].strip(), "text")
        elif re.match(r"^\s*-\s+", line):
            flush()
            out.paragraph(re.sub(r"^\s*-\s+", "", line).strip(), "list")
        elif line.strip():
            block.append(line.strip())
        else:
            flush()
    flush()
    return out.rows


def accepted_text(paragraph: ElementTree.Element) -> str:
    """Text with insertions and without deletions; tabs, breaks and hyphens as characters."""
    out = []

    def take(node: ElementTree.Element) -> None:
        if node.tag == W + "del":
            return
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag in (W + "tab", W + "br", W + "noBreakHyphen"):
            out.append({"tab": "\t", "br": "\n", "noBreakHyphen": "‑"}[node.tag[len(W) :]])
        for child in node:
            take(child)

    take(paragraph)
    return "".join(out)


M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BLIP, VML = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip", "{urn:schemas-microsoft-com:vml}imagedata"
CAPTIONS = re.compile(r"^\s*(Tabelle|Bild|Abbildung)\s+([A-Z]?\.?\d+(?:\.\d+)*)\s*[–—:-]?\s*(.*)$", re.S)


@dataclass
class Word:
    """What a Word file holds: paragraph rows, cells, tracked changes, formulas, figures and term numbers.

    cells are (doc, table_id, caption, sec_ix, row, col, text); changes (doc, sec_ix, par_ix, kind, text,
    author, date); formulas (doc, formula_id, sec_ix, par_ix, table_id, linear, image); figures (doc,
    figure_id, sec_ix, par_ix, caption, image); terms (doc, sec_ix, par_ix, term_no).
    """

    rows: list[tuple] = field(default_factory=list)
    cells: list[tuple] = field(default_factory=list)
    changes: list[tuple] = field(default_factory=list)
    formulas: list[tuple] = field(default_factory=list)
    figures: list[tuple] = field(default_factory=list)
    terms: list[tuple] = field(default_factory=list)
    images: dict[str, bytes] = field(default_factory=dict)


WORD_PARTS = {
    "cells": "doc string, table_id string, caption string, sec_ix int, row int, col int, text string",
    "changes": "doc string, sec_ix int, par_ix int, kind string, text string, author string, date string",
    "formulas": "doc string, formula_id string, sec_ix int, par_ix int, table_id string, linear string, image string",
    "figures": "doc string, figure_id string, sec_ix int, par_ix int, caption string, image string",
    "terms": "doc string, sec_ix int, par_ix int, term_no string",
}


def linear(math: ElementTree.Element) -> str:
    """A formula as its letters in order."""
    return "".join(t.text or "" for t in math.iter(M + "t"))


class WordReader:
    """One walk over the body of a Word file; numbers and captions depend on what stood before."""

    def __init__(self, doc: str, content: bytes):
        self.doc, self.out = doc, Word()
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(content))
            self.body = ElementTree.fromstring(self.archive.read("word/document.xml")).find(W + "body")
            self.styles = self._named("word/styles.xml", W + "style", lambda s: (s.get(W + "styleId"), (s.find(W + "name").get(W + "val") if s.find(W + "name") is not None else None) or s.get(W + "styleId")))
            self.targets = self._named("word/_rels/document.xml.rels", "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship", lambda r: (r.get("Id"), r.get("Target")))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            raise IngestError(f"{doc}: {e}") from e
        self.sections = Sections(doc)
        self.counts = {"tab": 0, "eq": 0, "fig": 0}
        self.held = ""  # caption of the table that follows
        self.term, self.term_counts = None, [0, 0]

    def _named(self, part: str, tag: str, pair) -> dict:
        if part not in self.archive.namelist():
            return {}
        return dict(pair(x) for x in ElementTree.fromstring(self.archive.read(part)).iter(tag))

    def _id(self, kind: str) -> str:
        self.counts[kind] += 1
        return f"{self.doc}_{kind}_{self.counts[kind]:03d}"

    def _image(self, relation: str | None, name: str) -> str | None:
        target = self.targets.get(relation)
        path = target and (target if target.startswith("word/") else "word/" + target.lstrip("/"))
        if not path or path not in self.archive.namelist():
            return None
        file = f"{name}.{path.rpartition('.')[2]}"
        self.out.images[file] = self.archive.read(path)
        return f"assets/images/{file}"

    def _assets(self, node: ElementTree.Element, par: int | None, table: str | None = None) -> int:
        """Formulas and figures of a paragraph or table; how many formulas there are."""
        place, before = (self.sections.section[0], par), len(self.out.formulas)
        for math in node.iter(M + "oMath"):
            self.out.formulas.append((self.doc, self._id("eq"), *place, table, linear(math), None))
        for preview in node.iter(VML):
            name = self._id("eq")
            self.out.formulas.append((self.doc, name, *place, table, None, self._image(preview.get(R + "id"), name)))
        for blip in node.iter(BLIP):
            name = self._id("fig")
            self.out.figures.append((self.doc, name, *place, None, self._image(blip.get(R + "embed"), name)))
        return len(self.out.formulas) - before

    def table(self, node: ElementTree.Element) -> None:
        name = self._id("tab")
        for r, row in enumerate(node.findall(W + "tr")):
            for c, cell in enumerate(row.findall(W + "tc")):
                text = "\n".join(accepted_text(p) for p in cell.findall(W + "p"))
                self.out.cells.append((self.doc, name, self.held, self.sections.section[0], r, c, text))
        self._assets(node, self.sections.par_ix - 1 if self.sections.par_ix else None, name)
        self.held = ""

    def caption(self, m: re.Match) -> bool:
        """A caption goes to the table that follows, or to the last figure of the section without one."""
        text = f"{m[1]} {m[2]}" + (f" – {m[3].strip()}" if m[3].strip() else "")
        if m[1] == "Tabelle":
            self.held = text
            return True
        for k in range(len(self.out.figures) - 1, -1, -1):
            figure = self.out.figures[k]
            if figure[2] != self.sections.section[0]:
                break
            if figure[4] is None:
                self.out.figures[k] = (*figure[:4], text, figure[5])
                break
        return True

    def paragraph(self, node: ElementTree.Element) -> None:
        mark = node.find(f"{W}pPr/{W}pStyle")
        style = self.styles.get(mark.get(W + "val"), mark.get(W + "val")) if mark is not None else ""
        text, head = accepted_text(node).strip(), HEADING.match(style or "")
        if style and re.match(r"^TERM-number\s*3?$", style):  # numbers that Word counts and the text lacks
            sub = style.endswith("3")
            self.term_counts = [self.term_counts[0], self.term_counts[1] + 1] if sub else [self.term_counts[0] + 1, 0]
            self.term = ".".join(map(str, [self.sections.section[1], *self.term_counts[: 1 + sub]]))
        if head:
            if text and text.lower() not in NAVIGATION:
                self.sections.heading(text, int(head[1]))
                self.term_counts = [0, 0]
            return
        formulas = self._assets(node, self.sections.par_ix)
        found = CAPTIONS.match(text) if text else None
        if found and self.caption(found):
            return
        if not text and not formulas:
            return
        note = re.match(r"^\s*(?:ANMERKUNG|BEISPIEL)", text)
        kind = (
            "note" if note else "term" if (style or "").upper().startswith("TERM") or (style or "").startswith("Begriff") else "formula" if formulas and len(text) < 5
            else "list" if node.find(f"{W}pPr/{W}numPr") is not None else "text"
        )
        place = (self.doc, self.sections.section[0], self.sections.par_ix)
        for change in node.iter():
            if change.tag in (W + "ins", W + "del"):
                said = "".join(t.text or "" for t in change.iter() if t.tag in (W + "t", W + "delText"))
                self.out.changes.append((*place, change.tag[len(W) :], said, change.get(W + "author"), change.get(W + "date")))
        if kind == "term" and self.term:
            self.out.terms.append((*place, self.term))
            self.term = None
        self.sections.paragraph(text, kind)

    def read(self) -> Word:
        for node in self.body if self.body is not None else []:
            if node.tag == W + "tbl":
                self.table(node)
            elif node.tag == W + "p":
                self.paragraph(node)
        self.out.rows = self.sections.rows
        return self.out


def parse_docx(doc: str, content: bytes) -> tuple[list[tuple], list[tuple]]:
    """Paragraph rows and cells of a Word file."""
    found = WordReader(doc, content).read()
    return found.rows, found.cells


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All .md and .docx files below a path, dispatched by extension; others raise IngestError."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                doc, _, ending = file.rsplit("/", 1)[-1].rpartition(".")
                if ending.lower() == "md":
                    rows = parse_markdown(doc, content.decode("utf-8"))
                elif ending.lower() == "docx":
                    rows = parse_docx(doc, content)[0]
                else:
                    raise IngestError(f"{file}: neither Markdown nor Word")
                yield pd.DataFrame(rows, columns=NAMES).astype({"par_ix": "Int32"})

    return files.mapInPandas(parse, ROWS)


def read_word_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One kind of what the .docx files below a path hold, by its name in WORD_PARTS."""
    schema = WORD_PARTS[part]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                doc = file.rsplit("/", 1)[-1].rpartition(".")[0]
                rows = getattr(WordReader(doc, content).read(), part)
                found = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                yield found.astype({"par_ix": "Int32"}) if "par_ix" in found else found

    return files.mapInPandas(parse, schema)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all tables of the .docx files below a path."""
    return read_word_part(spark, path, "cells")


def cell_matrices(cells: DataFrame) -> DataFrame:
    """(doc, table_id, caption, sec_ix, cells): cells by row and column as matrices of text."""
    rows = cells.groupBy("doc", "table_id", "caption", "sec_ix", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("r"))
    return rows.groupBy("doc", "table_id", "caption", "sec_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda r: r["r"]).alias("cells"))


KNOWN = {"doc": ("doc_id", "sections"), "section": ("id", "title", "level", "part", "paragraphs"), "paragraph": ("id", "n0", "kind")}


def parse_json(text: str) -> list[tuple]:
    """(…paragraph row, extra) of a document tree; extra keeps what is not a column, as JSON of three trees.

    A key that is absent stays absent and one that is null stays null.
    """
    tree = json.loads(text)
    rest = lambda x, kind: {k: v for k, v in x.items() if k not in KNOWN[kind]}
    out = []
    for n, s in enumerate(tree.get("sections") or []):
        head = (tree.get("doc_id"), n, s.get("id"), s.get("title"), s.get("level"), s.get("part"))
        pack = lambda p: json.dumps([rest(tree, "doc"), rest(s, "section"), p], ensure_ascii=False)  # noqa: E731, B023
        out.append((*head, None, None, None, pack(sorted(k for k in KNOWN["section"] if k not in s))))
        for k, p in enumerate(s.get("paragraphs") or []):
            out.append((*head, k, p.get("kind"), p.get("n0"), pack({**rest(p, "paragraph"), "": [p.get("id"), sorted(k for k in KNOWN["paragraph"] if k not in p)]})))
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph rows of documents kept as JSON trees, with `extra` so that nothing is lost."""
    files = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(parse_json(text), columns=[*NAMES, "extra"]).astype({"par_ix": "Int32", "level": "Int32"})

    return files.mapInPandas(parse, ROWS + ", extra string")


def to_json(rows: list[dict]) -> str:
    """A document tree of paragraph rows of one document, in order, with their extra keys."""
    tree: dict = {"doc_id": rows[0]["doc"] if rows else None, "sections": []}
    sections: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (r["sec_ix"], -1 if r["par_ix"] is None else r["par_ix"])):
        of_doc, of_section, own = json.loads(r["extra"]) if r.get("extra") else ({}, {}, None)
        if r["sec_ix"] not in sections:
            absent = own if r["par_ix"] is None and own else []
            whole = {"id": r["section_id"], "title": r["title"], "level": r["level"], "part": r["part"], "paragraphs": []}
            sections[r["sec_ix"]] = {k: v for k, v in whole.items() if k not in absent} | of_section
            tree["sections"].append(sections[r["sec_ix"]])
            tree |= of_doc
        if r["par_ix"] is not None:
            extra = dict(own or {})
            name, absent = extra.pop("", [f"{r['section_id']}.p{r['par_ix'] + 1}", []])
            whole = {"id": name, "n0": r["n0"], "kind": r["kind"]}
            sections[r["sec_ix"]]["paragraphs"].append({k: v for k, v in whole.items() if k not in absent} | extra)
    return json.dumps(tree, ensure_ascii=False, indent=1)
