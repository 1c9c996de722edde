"""Every registered query of the document operators against its DuckDB SQL."""

import math

import duckdb
import pytest

from quirefold import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, con, name):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_rows_without_sql_are_of_every_document(spark, sf, con):
    pages = con.sql("SELECT DISTINCT d.doc_id, (t.pos - 1) // 20 + 1 FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS t(line, pos)").fetchall()
    found = queries.queries()
    docs = {d for d, _ in pages}
    assert {r.doc_id for r in found["layout_recovery"](spark, sf).select("doc_id").collect()} == docs
    images = found["ocr_rebuild"](spark, sf).select("image_id", "text").collect()
    assert {int(r.image_id.split("-")[0]) % 4 for r in images} == {0, 1, 2, 3}
    assert max(len(x) for r in images for x in r.text.split("\n")) > 40
    assert {r.doc_id for r in found["code_metrics"](spark, sf).select("doc_id").collect()} == docs


def test_similarity_of_every_adjacent_pair(spark, sf, con):
    want = con.sql("SELECT sum(len(string_split(text, chr(10))) - 1) FROM documents").fetchall()[0][0]
    assert queries.queries()["similarity_match"](spark, sf).count() == want
