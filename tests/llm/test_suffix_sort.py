"""The distributed suffix sort against brute force."""

import random

import pytest

from tidewell.llm import suffix_sort

rng = random.Random(17)


def brute(texts):
    seen, out = {}, set()
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        for k in range(len(b) - suffix_sort.LENGTH + 1):
            if seen.setdefault(b[k : k + suffix_sort.LENGTH], (i, k)) != (i, k):
                out.add((i, k))
    return out


@pytest.mark.parametrize("length", [100, 7])
def test_repeated_places(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_sort, "LENGTH", length)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = {3 * i: " ".join(word() for _ in range(rng.randint(1, 60))) for i in range(12)}
    texts |= {1: passage, 4: f"x {passage} y", 7: f"{passage} {passage}", 10: passage, 13: "ab" * 130, 16: "", 19: None, 22: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert len(want) > 300
    assert {(r[0], r[1]) for r in suffix_sort.repeated_places(docs).collect()} == want


def test_counts_over_ranges(spark):
    rows = [(rng.randrange(4), rng.randrange(3), k % 3, k // 50, k) for k in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, cls long, d long, i long").repartition(7)
    for r in suffix_sort.counted(df, ["a", "b"]).collect():
        key = rows[r["i"]][:2]
        assert [r["less0"], r["less1"], r["less2"]] == [sum(x[:2] < key and x[2] == c for x in rows) for c in range(3)]
