"""Every opN_ query over small tables: the columns, flags and thresholds of its contract."""

import hashlib
import zlib

import duckdb
import pytest

from stemma.llm import registry

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my omicron".split()
ROWS = {
    "documents": [
        *((k, " ".join(TEXT[k % 5 : k % 5 + 8] * 4) + (" you idiot" if k % 4 == 0 else "") + f" end {k % 6}", "en", "s", 1) for k in range(60)),
        (60, None, "en", "s", None), (61, "", None, None, 0), (62, "1 2 3", "en", "s", 5), (None, "null id password=abcdefgh12345678", "en", "s", 1), (7, "again token: 0123456789abcdef", None, "s", 1),
    ],
    "labels": [*((k, 1, int(k % 4 == 0)) for k in range(60)), (None, 1, 1), (3, None, None)],
    "benchmark": [(1, " ".join(TEXT[:10])), (2, None), (None, "epsilon zeta"), (2, "")],
    "pages": [(1, "http://a/x", "<article><p>one" + "x" * 1000), (2, "http://a/y", "<article><p>one" + "x" * 1000), (3, None, None), (None, "u", ""), (1, "http://a/x", "small")],
    "embeddings": [(0, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.01, 0.0], 1), (2, [0.0, 1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 2)],
}
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    "op7_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_jaccard": ["doc_id", "class_id", "n_links"],
    "op10_html": ["page_id", "url", "text", "n_chars"],
}
TABLE = {"op6_embeddings": "embeddings", "op8_warc": "pages", "op10_html": "pages"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables; `empty` holds the same without rows."""
    top = tmp_path_factory.mktemp("tables")
    for name, schema in SCHEMAS.items():
        frame = spark.createDataFrame(ROWS[name], schema)
        frame.write.parquet(f"{top}/full/{name}.parquet")
        frame.limit(0).write.parquet(f"{top}/empty/{name}.parquet")
    return top


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: run(spark, f"{folder}/full").collect() for name, run in registry.queries().items()}


def test_every_row_and_column_is_there(results):
    assert set(results) == set(COLUMNS)
    for name, columns in COLUMNS.items():
        rows = results[name]
        assert list(rows[0].asDict())[: len(columns)] == columns or set(columns) <= set(rows[0].asDict()), name
        assert sorted(str(r[0]) for r in rows) == sorted(str(r[0]) for r in ROWS[TABLE.get(name, "documents")]), name


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables_give_empty_results(spark, folder, name):
    assert registry.queries()[name](spark, f"{folder}/empty").count() == 0


def test_held_out_flags_and_thresholds(results):
    for r in results["op1_toxicity"]:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    for r in results["op3_language"]:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "und")
    assert {r["doc_id"] for r in results["op3_language"] if r["lang_pred"] == "und"} == {60, 61, 62}


def test_results_of_the_small_tables(results):
    assert {r["doc_id"] for r in results["op1_toxicity"] if r["predicted"]} == {k for k in range(60) if k % 4 == 0}
    records = sorted(results["op5_records"], key=lambda r: r["start"])
    assert [r["start"] for r in records] == [sum(x["n_tokens"] for x in records[:k]) for k in range(len(records))]
    known = [r["doc_id"] for r in records if r["doc_id"] is not None]
    assert known == sorted(known) and {r["n_tokens"] for r in records if r["doc_id"] in (60, 61)} == {1}
    found = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in results["op6_embeddings"]}
    assert found == {(0, 2, 0, True), (1, 2, 0, False), (None, 2, 0, False), (2, 1, 2, True), (3, 0, 3, True), (4, 0, 4, True)}
    one = hashlib.sha1(ROWS["pages"][0][2].encode()).hexdigest()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in results["op8_warc"] if r["payload_digest"] == one} == {(1, "revisit", 2), (2, "response", None)}
    assert {r["text"] for r in results["op10_html"]} == {"one" + "x" * 1000, "", "small"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(results, folder, name):
    con = duckdb.connect()
    for t in SCHEMAS:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/full/{t}.parquet/*.parquet'")
    columns = sorted(results[name][0].asDict())
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in results[name]) == sorted(map(repr, want))
