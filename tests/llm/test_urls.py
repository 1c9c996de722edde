import re

from quirefold.llm import urls

SCHEMA = "page_id long, url string"


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_hosts_paths_and_rules(spark):
    rows = ["http://A.com/x", "https://www.EXAMPLE.com/en/1?x#y", "http://b.example.com/en/", "http://example.com/en", "ftp://x.net/es/1", "http://x.net/fr", "http://xnet/fr/", "net://net/fr/a://b",
            "http://h?/en/", "http://h#/en/", "http://", "no scheme", "", None, "x://y://z/q", "http://ÄÖ.com/ä", "http://com/", "http://com", "a\nb://c.com/\nd"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), SCHEMA), spark.createDataFrame([], "id long, bad boolean"), urls.RULES).collect()}
    for i, url in enumerate(rows):
        assert (got[i].host, got[i].path) == plain(url), url
        rule, verdict = plain_rule(*plain(url))
        assert (got[i].rule, got[i].verdict) == (rule, verdict or "allow"), url


def test_templates(spark):
    rows, bad, i = [], [], 0
    for host in ("h.org", "k.org"):
        for part, n in (("news", 60), ("spam", 60), ("blog", 60)):
            for k in range(n):
                rows.append((i, f"http://{host}/{part}/{i}.html"))
                bad.append((i, part == "spam" and host == "h.org"))
                i += 1
    rows += [(i, "http://h.org/spam/unseen/"), (i + 1, "http://h.org/news/unseen"), (i + 2, "http://k.org/spam/unseen"), (i + 2, "http://k.org/spam/unseen")]
    got = urls.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bad, "id long, bad boolean"), urls.RULES).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[i].verdict == "block" and by[i].template == "/spam/*"
    assert by[i + 1].verdict == "allow" and by[i + 2].verdict == "allow" and by[i + 2].template == "/+/*"


def test_small_sections_of_a_large_host(spark):
    rows = [(i, f"http://h.org/part{i % 40}/{i}.html") for i in range(2400)]
    bad = [(i, i % 40 == 7) for i, _ in rows]
    got = urls.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bad, "id long, bad boolean"), urls.RULES).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i, x in bad if x}


def test_edges(spark):
    labels = spark.createDataFrame([(None, True), (1, None), (1, True), (1, False)], "id long, bad boolean")
    assert urls.judge(spark.createDataFrame([], SCHEMA), labels, urls.RULES).count() == 0
    deep = "http://d.org/" + "/".join("abcdefghijkl")
    got = urls.judge(spark.createDataFrame([(1, deep, "x")] * 4, SCHEMA + ", host string"), labels, urls.RULES).collect()
    assert {r.template for r in got} == {"/+" * 12} and {r.verdict for r in got} == {"block"}


def plain_templates(rows, min_pages=3, chi_square=6.63):
    """The tree as stated, in plain loops; rows: id -> (host, segments, good, bad)."""

    def differs(good, bad, all_good, all_bad):
        labelled, other_bad = good + bad, all_bad - bad
        other = all_good + all_bad - labelled
        if labelled < 5 or other < 5 or not all_bad * all_good:
            return False
        cross = bad * (other - other_bad) - other_bad * good
        return (labelled + other) * cross * cross / (all_bad * all_good * labelled * other) >= chi_square

    template, level = {i: "" for i in rows}, 0
    while True:
        nodes = {}
        for i, (host, parts, good, bad) in rows.items():
            if len(parts) > level:
                one = nodes.setdefault((host, template[i]), {}).setdefault(parts[level], [0, 0, 0])
                for k, x in enumerate((1, good, bad)):
                    one[k] += x
        if not any(sum(n for n, _, _ in node.values()) >= min_pages for node in nodes.values()):
            return {i: template[i] + ("/**" if len(rows[i][1]) > level else "") for i in rows}
        token = {}
        for key, node in nodes.items():
            n, all_good, all_bad = (sum(x[k] for x in node.values()) for k in range(3))
            if n < min_pages:
                continue
            own = {}
            for part, (n, good, bad) in node.items():
                if n >= min_pages:
                    token[key, part] = "+"
                    if differs(good, bad, all_good, all_bad):
                        own[part] = (bad * (all_good + all_bad) > all_bad * (good + bad), good, bad)
            for part, (worse, good, bad) in own.items():
                pool = [x for x in own.values() if x[0] == worse]
                alike = len(pool) > 1 and not differs(good, bad, sum(x[1] for x in pool), sum(x[2] for x in pool))
                token[key, part] = ("+worse" if worse else "+better") if alike else part
        grown = {i: f"{template[i]}/{token.get(((host, template[i]), parts[level]), '*')}" for i, (host, parts, _, _) in rows.items() if len(parts) > level}
        template, level = template | grown, level + 1


def test_trees_verdicts_and_purity_against_plain_loops(spark):
    import random

    rng = random.Random(6)
    rows, bad = [], {}
    for i in range(3000):
        host = rng.choice(["h.org", "h.org", "k.org", "deep.org"])
        depth = rng.choice([0, 1, 2, 3, 12]) if host == "deep.org" else rng.randrange(5)
        parts = [rng.choice([f"s{k}{rng.randrange(6)}", f"s{k}{rng.randrange(6)}", f"id{i}"]) for k in range(depth)]
        rows.append((i, f"http://{host}/" + "/".join(parts)))
        if rng.random() < 0.7:
            bad[i] = rng.random() < (0.9 if parts[:1] in (["s01"], ["s02"]) else 0.6 if "s111" in parts or "s33" in parts else 0.1)
    parts = {i: (url.split("/")[2], [x for x in url.split("/")[3:] if x], int(i in bad and not bad[i]), int(bad.get(i, False))) for i, url in rows}
    want = plain_templates(parts)
    assert any("+worse" in t for t in want.values()) and any(t.count("/") >= 12 for t in want.values())
    sums = {}
    for i, (host, _, good, evil) in parts.items():
        one = sums.setdefault((host, want[i]), [0, 0])
        one[0] += good
        one[1] += evil
    mean = sum(g for g, _ in sums.values()) / sum(g + b for g, b in sums.values())
    purity = {k: (g + 5 * mean) / (g + b + 5) for k, (g, b) in sums.items()}
    got = urls.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(bad.items()), "id long, bad boolean"), urls.RULES).collect()
    assert {r.page_id: (r.template, r.verdict) for r in got} == {i: (want[i], "block" if purity[parts[i][0], want[i]] < 0.5 else "allow") for i in want}
    assert {r.verdict for r in got} == {"allow", "block"}
