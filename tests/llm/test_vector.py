import re

import numpy as np
import pyarrow as pa

from quirefold.llm import vector


def test_words_and_hashes_do_not_depend_on_place():
    hasher = vector.WordHasher("space")
    texts = ["one two  three", None, "", "\tthree one", "é two\x0bone", "three"]
    data, offsets = vector.buffers(pa.array(texts))
    starts, ends, row = hasher.spans(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert row.tolist() == [0, 0, 0, 3, 3, 4, 4, 4, 5]
    h = hasher.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))


def test_very_long_text_hashes_alike_in_pieces():
    hasher = vector.WordHasher("space")
    words = [f"w{k % 977}" for k in range(700_000)] + ["x" * 1_500_000, "end"]
    data, offsets = vector.buffers(pa.array([" ".join(words)]))
    starts, ends, _ = hasher.spans(data, offsets)
    assert len(data) > 2 * vector.CHUNK_BYTES and len(starts) == len(words)
    h = hasher.hashes(data, starts, ends)
    assert len(np.unique(h)) == 979 and (h[: 977 * 700].reshape(700, 977) == h[:977]).all()
    assert (hasher._hashes(data, starts, ends) == h).all()


def test_ranges_cover_all_rows():
    offsets = np.array([0, 5, 5, 30, 31, 60])
    assert list(vector.ranges(offsets, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(vector.ranges(np.array([0]))) == []


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, _b int")
    assert vector.fresh(df, "a", "b", "_B") == ["_a", "b", "__B"]
