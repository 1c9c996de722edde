import random
from collections import Counter, defaultdict

from quirefold.llm import lines


def brute(rows, ratio=0.06, min_pages=2):
    pages, seen = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        if host is not None:
            pages[host] += 1
            for line in set((text or "").split("\n")) if text is not None else ():
                seen[host][line] += 1
    out = {}
    for i, host, text in rows:
        if text is None:
            out[i] = (None, 0)
            continue
        kept = [x for x in text.split("\n") if not (host is not None and x.strip(" \t") and seen[host][x] >= min_pages and seen[host][x] > ratio * pages[host])]
        out[i] = ("\n".join(kept), len(text.split("\n")) - len(kept))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        text = "\n".join(rng.choice(["menu", "menu ", "", " \t", f"line {rng.randrange(30)}", f"own {i}"]) for _ in range(rng.randrange(0, 9)))
        rows.append((i, host, rng.choice([text, text, text, None, ""])))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for few in (10**6, 0):
        got = lines.drop_boilerplate(df, broadcast_lines=few).collect()
        assert {r.doc_id: (r.text, r.n_dropped) for r in got} == brute(rows)
        assert len(got) == len(rows)


def test_edges(spark):
    schema = "doc_id long, source string, text string, host string, n_lines string"
    assert lines.drop_boilerplate(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "s", "x\ny", "h", "q")] * 6 + [(None, None, None, None, None)], schema)
    got = lines.drop_boilerplate(df).collect()
    assert [r.text for r in got if r.doc_id] == [""] * 6 and [r.n_lines for r in got if r.doc_id] == [2] * 6


def test_small_sites_and_very_long_texts(spark):
    long = "\n".join(f"line {k}" for k in range(200_000))
    rows = [(1, "tiny", "menu\na"), (2, "tiny", "menu\nb"), (3, "tiny", "c"), (4, "one", "menu\nalone"), (5, "big", long + "\nmenu"), (6, "big", "menu\nmore")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == brute(rows) and got[1] == ("a", 1) and got[3] == ("c", 0) and got[4] == ("menu\nalone", 0) and got[5] == (long, 1)
