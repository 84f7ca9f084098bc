"""The pipeline's stages on a small table, each held against what it must do."""

import random

import corpus_pipeline
from stemma.llm.common import read_table


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    vocabulary = {lang: ["".join(rnd.choice(s) for _ in range(3)) for _ in range(150)] for lang, s in {"en": ["the", "ing", "er"], "de": ["sch", "ung", "ei"]}.items()}
    rows = []
    for k in range(80):
        lang = ("en", "de")[k % 2]
        rows.append([k, " ".join(rnd.choice(vocabulary[lang]) for _ in range(80)), lang])
    rows[10][1] = rows[4][1].replace(rows[4][1].split()[3], "changed", 1)
    item = " ".join(rows[21][1].split()[5:25])
    rows[30][1] += " password=abcdefghijkl1234"
    rows += [[200, "12 34 !!", "en"], [201, None, "en"], [202, "", None], [203, rows[6][1], "en"]]
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = read_table(spark, str(tmp_path), "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert docs.columns == frame.columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name == "secrets":
            assert "[SECRET]" in {r["doc_id"]: r["text"] for r in docs.collect()}[30]
    every = {r[0] for r in rows}
    assert kept["language"] == every - {200, 201, 202}
    assert kept["near_duplicates"] == kept["language"] - {10, 203}
    assert kept["decontamination"] == kept["near_duplicates"] - {21}
    assert kept["tokens"] == kept["secrets"] == kept["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["tokens"]


def test_odd_tables(spark, tmp_path):
    """Null benchmark items, further columns with names that clash, repeated rows, and empty documents."""
    rows = [(k, f"the thing number {k} is here and there with many other words of its own {k * 7} " * 3, "en", "s", 1, "x", "y") for k in range(30)] + [(3, None, None, None, None, None, None)]
    rows += [rows[5]] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sig string, row_key string")
    frame.write.parquet(f"{tmp_path}/full/documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for name in ("full", "empty"):
        spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs = read_table(spark, f"{tmp_path}/full", "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/full")
        assert docs.columns == frame.columns
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(30))
    assert corpus_pipeline.run(spark, f"{tmp_path}/full").count() == 30
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
