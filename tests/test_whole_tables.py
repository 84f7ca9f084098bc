"""Queries run over whole tables: long documents and rows without a length."""

from stemma.plans import diffs, links

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_long_documents_are_aligned(spark, tmp_path):
    line = "Die Anlage ist vor der ersten Inbetriebnahme durch eine befähigte Person zu prüfen"
    many = "\n".join([*(f"zeile {k}" for k in range(1200)), line])
    rows = [(0, many, "de", "s", len(many)), (1, many, "de", "s", len(many)), (40, line, "de", "s", None), (41, line, "de", "s", None)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["kind"], r["via"]): r["n"] for r in links.hungarian_alignment(spark, str(tmp_path)).collect()}
    assert found == {("identical", "anchor"): 1202}
    moved = {(r["block"], r["old_ix"], r["new_ix"], r["score"]) for r in links.moved_pass(spark, str(tmp_path)).collect()}
    assert moved == {(0, 1200, 1200, 1.0), (2, 0, 0, 1.0)}


def test_tables_beyond_the_first_chapters_are_paired(spark, tmp_path):
    # chapters 60 and 67: one table in each edition, far apart and with large keys
    rows = [(2400, "schnelle Pumpe", "Brand#1", "SMALL", 5), (2401, "xxxx", "Q", "ZZ", 77), (2681, "schnelle Pumpe", "Brand#1", "SMALL", 5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in diffs.cross_chapter_tables(spark, str(tmp_path)).collect()] == [(6, 2400, 2681, 1.0)]
    near = [*rows[:2], (2403, *rows[2][1:])]
    spark.createDataFrame(near, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in links.table_pairing(spark, str(tmp_path)).collect()] == [(60, 2400, 2403, 1.0)]
