"""The driver contract."""

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    df = entry.entry(spark)
    assert df.columns[:3] == ["doc_id", "page", "score"] and df.count() > 0


def test_no_query_output_is_nested(spark, sf):
    for name in ("page_quality", "doc_quality", "manifest", "jobs_latest"):
        kinds = [k for _, k in entry.queries()[name](spark, sf).dtypes]
        assert not any(k.startswith(("map", "struct", "variant")) for k in kinds)
