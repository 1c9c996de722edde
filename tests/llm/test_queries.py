"""Columns, types and row counts of the registered queries."""

import zlib

import duckdb
import pytest

from quirefold.llm import queries

COLUMNS = {
    "op1_bpe": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op2_lines": [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("text_sha256", "string")],
    "op3_minhash": [("doc_id", "bigint"), ("class_id", "bigint"), ("is_kept", "boolean")],
    "op4_decontam": [("doc_id", "bigint"), ("contaminated", "boolean"), ("item_id", "bigint"), ("coverage", "double"), ("n_items", "bigint")],
    "op5_substring": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
    "op6_secrets": [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")],
    "op7_langid": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op8_quality": [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")],
    "op9_urls": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op10_licenses": [("doc_id", "bigint"), ("n_paragraphs", "bigint"), ("n_licences", "bigint"), ("families", "string"), ("all_confirmed", "boolean")],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    key = COLUMNS[name][0][0]
    source = spark.read.parquet(f"{sf}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert sorted(r[key] for r in rows) == sorted(r[0] for r in source.select(key).collect())
    if name == "op7_langid":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    if name == "op4_decontam":
        assert any(r.contaminated for r in rows) and all(r.coverage >= 0.5 for r in rows if r.contaminated)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
