import pytest

from quirefold.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark)


def plain(model, text):
    """What the projection should give, by the same model, one paragraph at a time."""
    out, n = [], 0
    for p in (text or "").split("\n"):
        if not p.strip(" \t\n\r\x0b\x0c"):
            continue
        probs = model.probabilities(p)
        if probs[-1] < 0.5:
            best = max(probs[:-1])
            family = licenses.CLASSES[probs.index(best)]
            import re

            w = re.findall("[a-z0-9]+", p.lower())
            two = {" ".join(x) for x in zip(w, w[1:])}
            sure = False
            for t in licenses.TEMPLATES[family]:
                v = re.findall("[a-z0-9]+", t.lower())
                pairs = {" ".join(x) for x in zip(v, v[1:])}
                sure |= len(pairs & two) >= 0.5 * min(len(pairs), max(1, len(two)))
            out.append((n, family if sure and best >= model.threshold else "unknown", round(best, 6), sure))
        n += 1
    return n, out


def test_projection_equals_the_model(spark, model):
    texts = [t for _, t in licenses.examples()] + [None, "", "\n \n", "é", "Released under the MIT License.\n\nplain words\nAll rights reserved. Licensed under CC BY 4.0."]
    rows = list(enumerate(texts))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_paragraphs, [(x.paragraph, x.family, round(x.probability, 6), x.confirmed) for x in r.licences]) == plain(model, dict(rows)[r.doc_id])


def test_families(spark, model):
    held = {
        "mit": "This project is released under the MIT License.", "apache": "The code is licensed under the Apache License, Version 2.0.", "gpl": "It is licensed under the GNU General Public License, version 3.",
        "cc": "Text licensed under CC BY-NC 4.0.", "proprietary": "Copyright 2019 Some Firm. All rights reserved.", "bsd": "Licensed under the BSD 3-Clause License", "mpl": "Files are under the Mozilla Public License 2.0",
        "lgpl": "under the GNU Lesser General Public License, version 2.1", "agpl": "under the GNU Affero General Public License, version 3",
    }
    rows = [(k, f"first line\n{v}\nlast line") for k, v in held.items()]
    got = licenses.scan(spark.createDataFrame(rows, "k string, text string"), model).collect()
    assert {r.k: [(x.paragraph, x.family) for x in r.licences] for r in got} == {k: [(1, k)] for k in held}


def test_prose_and_edges(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = licenses.scan(docs.selectExpr("*", "1 as licences"), model).collect()
    for r in got:
        stated = any(x in r.text for x in ("icensed under", "Released under the MIT", "All rights reserved"))
        assert bool(r.licences) == stated, r.text[:80]
        assert all(x.family != "unknown" for x in r.licences)
    assert licenses.scan(docs.limit(0), model).count() == 0
