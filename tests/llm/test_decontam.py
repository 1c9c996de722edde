import random
import re

from quirefold.llm import decontam


def tokens(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def tiling(a, b, least):
    """Textbook greedy string tiling of item a against text b: covered tokens of a."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and not ma[x + n] and not mb[y + n]:
                    n += 1
                if n > best:
                    best, found = n, [(x, y)]
                elif n == best and n >= least:
                    found.append((x, y))
        if not found:
            return total
        for x, y in found:
            if not any(ma[x : x + best]) and not any(mb[y : y + best]):
                ma[x : x + best], mb[y : y + best] = [True] * best, [True] * best
                total += best


def brute(docs, items, least=5, coverage=0.5):
    out = {}
    for i, text in docs:
        b, best = tokens(text), []
        for k, t in items:
            a = tokens(t)
            share = tiling(a, b, least) / len(a) if len(a) >= least else 0
            if share >= coverage:
                best.append((share, -k))
        out[i] = (-max(best)[1], round(max(best)[0], 9), len(best)) if best else (None, 0.0, 0)
    return out


def test_against_textbook_tiling(spark):
    rng = random.Random(4)
    words = [f"T{k}" for k in range(60)]
    items = [(k, ", ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 17, 30])))) for k in range(12)] + [(50, None), (51, "")]
    items.append((40, items[3][1]))
    docs = [(200, None), (201, ""), (202, items[2][1].upper())]
    for i in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            t = tokens(rng.choice(items)[1])
            cut = rng.randrange(len(t) + 1)
            w += rng.choice([t, t[cut:] + t[:cut], t[cut:], [rng.choice(words) for _ in range(20)]])
        docs.append((i, " ".join(w)))
    schema = "doc_id long, text string"
    for block in (4 << 20, 300):
        got = decontam.decontaminate(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
        assert {r.doc_id: (r.leak_item, round(r.leak_coverage, 9), r.leak_items) for r in got} == brute(docs, items)


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontam.decontaminate(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0
    df = spark.createDataFrame([(1, "x ONE two three; four five six", "a"), (1, "x ONE two three; four five six", "b")], "doc_id long, text string, leak_item string")
    assert [r.leak_item for r in decontam.decontaminate(df, bench).collect()] == [1, 1]
    assert [r.leak_item for r in decontam.decontaminate(df, bench.limit(0)).collect()] == [None, None]
