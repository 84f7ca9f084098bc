"""Writers of results: tables as CSV and JSON lines, lists as Markdown, pages, Word files and slides.

Large tables are written by the tasks; single files of one pair of editions are made from its rows
and depend on them alone, byte for byte.
"""

from __future__ import annotations

import csv
import hashlib
import html
import io
import json
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators.kernels import syntactic_diff
from stemma.operators.reports import CSV_COLUMNS

# The date that makes archives repeatable, and names of their parts.
EPOCH = (1980, 1, 1, 0, 0, 0)
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SLIDES = "http://schemas.openxmlformats.org/presentationml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_changes(rows: DataFrame, path: str) -> None:
    """Change rows with `;` and lists joined by `|`, written by the tasks."""
    flat = [F.concat_ws("|", c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes if c in CSV_COLUMNS]
    rows.select(*flat).write.option("sep", ";").option("header", "true").option("encoding", "UTF-8").mode("overwrite").csv(path)


def changes_csv(rows: list[dict]) -> bytes:
    """One file of one pair of editions: byte-order mark, header always, `;` between columns."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";")
    writer.writerow(CSV_COLUMNS)
    for r in rows:
        writer.writerow(["|".join(x) if isinstance(x := r.get(c), (list, tuple)) else "" if x is None else x for c in CSV_COLUMNS])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def coverage_note(path: Path, note: str | None) -> None:
    """The companion of a change table: written if something is unanswered, else removed."""
    if note:
        path.write_text(note + "\n", encoding="utf-8")
    else:
        path.unlink(missing_ok=True)


def csv_text(cells: Column) -> Column:
    """A cell matrix as lines of comma-separated values."""
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: quoted(F.coalesce(c, F.lit("")))), ",")), "\n")


def write_tables(tables: DataFrame, path: str) -> None:
    """Every table of (table_id, cells) as CSV in a folder of its own, written by the tasks."""
    tables.select("table_id", csv_text(F.col("cells")).alias("value")).write.partitionBy("table_id").mode("overwrite").text(path)


def write_track_changes(changes: DataFrame, path: str) -> None:
    """Tracked changes as JSON lines."""
    changes.write.mode("overwrite").json(path)


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Requests as text files by their tag, for answering elsewhere."""
    prompts.select("tag", F.col("user").alias("value")).write.partitionBy("tag").mode("overwrite").text(path)


def artifact_json(tree: dict) -> str:
    """A stage's result as JSON: one space of indentation, letters as they are."""
    return json.dumps(tree, ensure_ascii=False, indent=1)


def marked(old: str | None, new: str | None) -> str:
    """A text with its insertions and deletions."""
    marks = {"=": "{}", "-": "<del>{}</del>", "+": "<ins>{}</ins>"}
    return "".join(marks[k].format(html.escape(s)) for k, s in syntactic_diff(old or "", new or "")["ops"])


def table_html(cells: list[list[str]], other: list[list[str]] | None = None) -> str:
    """A table whose cells are marked where they differ from one of the same grid."""
    grid = other is not None and [len(r) for r in other] == [len(r) for r in cells]
    key = lambda c: "".join((c or "").lower().split())
    row = lambda i, r: "".join(f"<td{' class=changed' if grid and key(c) != key(other[i][j]) else ''}>{html.escape(c or '')}</td>" for j, c in enumerate(r))
    return "<table>" + "".join(f"<tr>{row(i, r)}</tr>" for i, r in enumerate(cells)) + "</table>"


def annotated_html(title: str, rows: list[dict], values: list[dict] | None = None, images: dict[str, bytes] | None = None) -> str:
    """A page of all changes in order: badges, where they stand, insertions and deletions, tables, pictures,
    and a table of changed values."""
    import base64

    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    if values:
        body = "".join(f"<tr>{''.join(f'<td>{html.escape(str(v.get(c) or str()))}</td>' for c in ('section', 'old', 'new', 'value_class'))}</tr>" for v in values)
        parts.append(f"<table class='sortable'><tr><th>Abschnitt</th><th>alt</th><th>neu</th><th>Art</th></tr>{body}</table>")
    head = None
    for r in rows:
        if r.get("head") != head and r.get("head"):
            head = r["head"]
            parts.append(f"<h2>{html.escape(head)} {html.escape(r.get('title') or '')}</h2>")
        badge = f"<span class='badge'>{html.escape(r['kind'])}</span>" + (f" <small>{html.escape(r['section'])}</small>" if r.get("section") else "")
        parts.append(f"<p class='{html.escape(r['kind'])}'>{badge} {marked(r.get('old_text'), r.get('new_text'))}{' ' + html.escape(r['marker']) if r.get('marker') else ''}</p>")
        if r.get("cells"):
            parts.append(table_html(r["cells"], r.get("old_cells")))
    for name, content in sorted((images or {}).items()):
        parts.append(f"<img alt='{html.escape(name)}' src='data:image/png;base64,{base64.b64encode(content).decode()}'>")
    return "".join(parts) + "</body></html>"


def component_markdown(rows: list[dict]) -> str:
    """What happened to which part of the rules: a table of directions, and the changes of each part."""
    directions = sorted({r["direction"] for r in rows})
    parts = sorted({r["component"] for r in rows})
    count = {(r["component"], r["direction"]): r["n"] for r in rows}
    lines = ["# Änderungen nach Bestandteil", "", "| Bestandteil | " + " | ".join(d or "ohne Angabe" for d in directions) + " |", "|-" * (len(directions) + 1) + "|"]
    lines += [f"| {p} | " + " | ".join(str(count.get((p, d), 0)) for d in directions) + " |" for p in parts]
    return "\n".join(lines) + "\n"


def feedback_markdown(rows: list[dict]) -> str:
    """Findings of a run, one line each, those at zero as well."""
    return "\n".join(["# Rückmeldungen", "", *(f"- {r['field']}: {r['finding']}" for r in rows)]) + "\n"


def review_markdown(entries: list[dict]) -> str:
    lines = ["# Entfallene Absätze zur Durchsicht", ""]
    for e in entries:
        lines += [f"## {e['section']}", f"- Gründe: {', '.join(e['reasons'])}", f"- Text: {e['text']}", ""]
    return "\n".join(lines)


def frozen_zip(files: dict[str, bytes]) -> bytes:
    """A ZIP archive whose bytes depend on its content alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, EPOCH), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _xml(body: str) -> bytes:
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{body}'.encode()


def _relations(targets: list[tuple[str, str]]) -> bytes:
    links = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets, 1))
    return _xml(f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')


def _types(parts: dict[str, str]) -> bytes:
    named = "".join(f'<Override PartName="/{name}" ContentType="application/vnd.openxmlformats-officedocument.{kind}+xml"/>' for name, kind in parts.items())
    return _xml(f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{named}</Types>')


def _word(body: str) -> bytes:
    files = {
        "[Content_Types].xml": _types({"word/document.xml": "wordprocessingml.document.main"}),
        "_rels/.rels": _relations([("officeDocument", "word/document.xml")]),
        "word/document.xml": _xml(f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'),
    }
    return frozen_zip(files)


def _paragraph(text: str, style: str = "", strike: bool = False) -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    run = "<w:rPr><w:strike/></w:rPr>" if strike else ""
    return f'<w:p>{mark}<w:r>{run}<w:t xml:space="preserve">{html.escape(text or "")}</w:t></w:r></w:p>'


def docx(title: str, rows: list[dict]) -> bytes:
    """The synopsis as a Word file: a heading and a two-column table of old and new texts."""
    table = "".join(f"<w:tr><w:tc>{_paragraph(r.get('old_text'))}</w:tc><w:tc>{_paragraph(r.get('new_text'))}</w:tc></w:tr>" for r in rows)
    return _word(_paragraph(title, "Heading1") + (f"<w:tbl>{table}</w:tbl>" if rows else ""))


def final_docx(title: str, chapters: list[dict]) -> bytes:
    """The final synopsis: per chapter a heading, what changed, and its changed values."""
    body = [_paragraph(title, "Heading1")]
    for c in chapters:
        body.append(_paragraph(f"{c.get('new_id') or c.get('old_id')} {c.get('title') or ''}".strip(), "Heading2"))
        body += [_paragraph(c[name]) for name in ("change_overview", "practical_note") if c.get(name)]
        body += [_paragraph(f"{v['old']} → {v['new']}", "ListBullet") for v in c.get("value_changes") or []]
    return _word("".join(body))


def _shape(number: int, kind: str, lines: list[str]) -> str:
    text = "".join(f'<a:p><a:r><a:t>{html.escape(t)}</a:t></a:r></a:p>' for t in lines or [""])
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{text}</p:txBody></p:sp>'


def _tree(shapes: str) -> str:
    return f'<p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{shapes}</p:spTree></p:cSld>'


def pptx(title: str, slides: list[dict]) -> bytes:
    """A draft of slides: a title, then per slide its head and lines."""
    space = f'xmlns:a="{DRAWING}" xmlns:p="{SLIDES}" xmlns:r="{OFFICE}"'
    pages = [(title, []), *((f"{s['head']} {s.get('title') or ''}".strip(), list(s["lines"])) for s in slides)]
    fills = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>' * 3
    lines = '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>' * 3
    colors = "".join(f'<a:{n}><a:srgbClr val="{c}"/></a:{n}>' for n, c in zip(("dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink"), ("000000", "FFFFFF", "333333", "EEEEEE", *["4472C4"] * 8)))
    fonts = "".join(f'<a:{n}><a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/></a:{n}>' for n in ("majorFont", "minorFont"))
    theme = f'<a:theme xmlns:a="{DRAWING}" name="plain"><a:themeElements><a:clrScheme name="plain">{colors}</a:clrScheme><a:fontScheme name="plain">{fonts}</a:fontScheme><a:fmtScheme name="plain"><a:fillStyleLst>{fills}</a:fillStyleLst><a:lnStyleLst>{lines}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{fills}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    clr = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" ' + " ".join(f'accent{k}="accent{k}"' for k in range(1, 7)) + ' hlink="hlink" folHlink="folHlink"/>'
    files = {
        "_rels/.rels": _relations([("officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": _xml(f'<p:presentation {space}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{"".join(f"""<p:sldId id="{255 + k}" r:id="rId{k + 1}"/>""" for k in range(1, len(pages) + 1))}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>'),
        "ppt/_rels/presentation.xml.rels": _relations([("slideMaster", "slideMasters/slideMaster1.xml"), *(("slide", f"slides/slide{k}.xml") for k in range(1, len(pages) + 1))]),
        "ppt/slideMasters/slideMaster1.xml": _xml(f'<p:sldMaster {space}>{_tree("")}{clr}<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>'),
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _relations([("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": _xml(f'<p:sldLayout {space} type="obj">{_tree("")}</p:sldLayout>'),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _relations([("slideMaster", "../slideMasters/slideMaster1.xml")]),
        "ppt/theme/theme1.xml": _xml(theme),
    }
    kinds = {"ppt/presentation.xml": "presentationml.presentation.main", "ppt/slideMasters/slideMaster1.xml": "presentationml.slideMaster", "ppt/slideLayouts/slideLayout1.xml": "presentationml.slideLayout", "ppt/theme/theme1.xml": "theme"}
    for k, (head, body) in enumerate(pages, 1):
        files[f"ppt/slides/slide{k}.xml"] = _xml(f"<p:sld {space}>{_tree(_shape(2, 'title', [head]) + _shape(3, 'body', body))}</p:sld>")
        files[f"ppt/slides/_rels/slide{k}.xml.rels"] = _relations([("slideLayout", "../slideLayouts/slideLayout1.xml")])
        kinds[f"ppt/slides/slide{k}.xml"] = "presentationml.slide"
    return frozen_zip(files | {"[Content_Types].xml": _types(kinds)})


def manifest(inputs: dict[str, bytes], parameters: dict, created: str) -> str:
    """Digests of the inputs and all parameters; the date is given, so runs repeat byte for byte."""
    return json.dumps({"schema_version": 1, "created": created, "inputs": {k: hashlib.sha256(v).hexdigest() for k, v in sorted(inputs.items())}, "parameters": dict(sorted(parameters.items()))}, ensure_ascii=False, indent=1)
