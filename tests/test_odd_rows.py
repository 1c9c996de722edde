"""Queries against their SQL on small tables of rows that the driver's smaller tables do not have."""

import duckdb
import pytest

from quirefold import queries


def both(spark, folder, name, table, rows, schema):
    """Rows of the query and of its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


# lines of a document that its number puts undecorated at every seventh place
OWN = ["4355709550244650 Mentoi ment", "12", "7  two spaces", "  8  as a gutter", "  1234567890123456789  long", "        9  far right", "٣ other digits", "no number", "  5"]


@pytest.mark.parametrize("name", ["numbered_gutter", "consecutive_gutters"])
def test_lines_that_begin_with_numbers_of_their_own(spark, tmp_path, name):
    rows = []
    for n, own in enumerate(OWN):
        doc = 28 * (n + 1)  # divisible by 4 and 7: line 4 of seven is shown as it is
        rows.append((doc, "\n".join(own if pos % 7 == 4 else f"line {pos}" for pos in range(30))))
        rows.append((doc + 4, "\n".join([own, "a\rb", "c d", "", own])))  # line 0 of seven is
    got, want = both(spark, tmp_path, name, "documents", rows, "doc_id long, text string")
    assert got == want and len(got) > 20


def test_visible_text_of_odd_pages(spark, tmp_path):
    texts = ["<title>a&amp;&amp b</title>", "a &amp", "&amp;lt; &lt &copy; &copy2020", "&eacute; &#233; &#xe9; &nbsp;", " <p>a  b\x0bc\x1cd </p>　", "\t<b>x</b>\r\n", "a<b", "", None, "&apos;&#39;&quot;&middot;"]
    rows = [(n, t) for n, t in enumerate(texts)]
    got, want = both(spark, tmp_path, "html_visible_text", "pages", rows, "page_id long, html string")
    assert got == want and len(got) == len(texts)
