"""Command line: compare two editions into a folder, or show a digest of documents."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import editions, inspector
from stemma.config import Config
from stemma.operators import reports
from stemma.sources import documents, sinks
from stemma.stages import Stages


def read(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph rows of a .json, .md or .docx file."""
    return documents.read_json(spark, path).drop("extra") if path.lower().endswith(".json") else documents.read_documents(spark, path)


def compare(spark: SparkSession, config: Config) -> editions.ChangeSet:
    """Both editions of a configuration, compared; every table and the single files go to its folder."""
    sides = [read(spark, s.path).filter("sec_ix >= 0").select(F.lit(config.pair_label).alias("pair_id"), F.lit(e).alias("edition"), "sec_ix", "section_id", "title", "level", "part", "par_ix", "kind", "n0") for e, s in (("old", config.old), ("new", config.new))]
    formats = tuple(s.path.rpartition(".")[2].lower() for s in (config.old, config.new))
    found = editions.compare(sides[0].unionByName(sides[1]), tau=config.tau_for(formats))
    out, run = Path(config.out_dir), Stages(spark, f"file://{Path(config.out_dir).resolve()}/tables")
    out.mkdir(parents=True, exist_ok=True)
    for name in ("chapters", "links", "changes", "moves", "balance"):
        run.save(name, getattr(found, name))
    rows = [r.asDict(recursive=True) for r in reports.synopsis_rows(found.changes, found.chapters).orderBy("place").collect()]  # one pair of editions
    changed = [r.asDict() for r in reports.value_changes(found.changes).orderBy("mapping", "change_ix", "k").collect()]
    slides = [r.asDict() for r in reports.slides(reports.dossier(found.chapters, found.changes), found.changes).orderBy("slide").collect()]
    removed = [{"section": r["mapping"], "reasons": r["review_reasons"], "text": r["old_text"]} for r in reports.review_list(found.changes, found.balance).orderBy("place").collect()]
    (out / "synopsis.html").write_text(sinks.annotated_html(config.pair_label, rows, changed), encoding="utf-8")
    (out / "synopsis.docx").write_bytes(sinks.docx(config.pair_label, rows))
    (out / "slides.pptx").write_bytes(sinks.pptx(config.pair_label, slides))
    (out / "removed.md").write_text(sinks.review_markdown(removed), encoding="utf-8")
    inputs = {s.path: Path(s.path).read_bytes() for s in (config.old, config.new)}
    (out / "manifest.json").write_text(sinks.manifest(inputs, {"tau": config.tau, "tau_moved": config.tau_moved, "similarity": config.similarity, "pair_label": config.pair_label}, ""), encoding="utf-8")
    return found


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stemma")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compare", help="compare two editions")
    one.add_argument("old")
    one.add_argument("new")
    one.add_argument("out")
    one.add_argument("--tau", type=float, default=0.62)
    two = commands.add_parser("inspect", help="show a digest of a document")
    two.add_argument("path")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("stemma").getOrCreate()
    if args.command == "compare":
        found = compare(spark, Config.of_paths(args.old, args.new, args.out, tau=args.tau))
        for r in reports.change_kinds(found.changes).orderBy("kind").collect():
            print(f"{r['kind']}: {r['n']}")
    else:
        rows = read(spark, args.path).withColumns({"pair_id": F.lit("p"), "edition": F.lit("new")})
        print(inspector.render(editions.enriched(rows), args.path))


if __name__ == "__main__":
    main()
