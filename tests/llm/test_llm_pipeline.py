"""Stages of the corpus pipeline against plain Python, each by the whole of its job."""

import random

import numpy as np
import pytest

import brute
import corpus_pipeline
from steplake.llm.jaccard_join import Cut

SF = "/root/testdata/sf0.001"


def near(docs, size=5, percent=80):
    """docs: {doc_id: text} -> {doc_id: smallest doc_id that links lead to}"""
    sets = {d: brute.shingles(t, size) for d, t in docs.items()}
    label = {d: d for d in docs}
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_copies_by_five_words_and_80_percent(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    for i, share in enumerate((0.02, 0.08, 0.15, 0.22, 0.3, 0.6)):  # text appended
        docs[10_000 + i] = " ".join(base[:200] + base[200:200 + int(share * 200)])
    for i, n in enumerate((1, 3, 4, 5, 6, 9)):  # words changed
        text = [f"v{w}" for w in base]
        for at in rng.sample(range(300), n):
            text[at] = f"x{i}"
        docs[20_000 + i] = " ".join(text)
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame, SF).collect()]
    assert sorted(got) == sorted(d for d, c in near(docs).items() if c == d)


def test_null_and_repeated_ids_are_judged_by_their_own_text(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(1000)}" for _ in range(n)]
    one, two, three, four = (words(100) for _ in range(4))
    rows = [(1, one, "a"), (None, [*one, "end"], "b"), (2, two, "c"), (2, three, "d"), (2, two, "e"), (None, four, "f"), (None, [*four, "x"], "g"),
            (None, four, "h"), (3, [], "i"), (None, [], "j"), (5, [*three, "end"], "k")]
    docs = spark.createDataFrame([(i, " ".join(t), m) for i, t, m in rows], "doc_id bigint, text string, mark string")
    got = sorted(r.mark for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect())
    assert [m for m in got if m not in "cefgh"] == ["a", "d", "i", "j"]
    assert sum(m in "ce" for m in got) == sum(m in "fgh" for m in got) == 1

    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(brute.WORDS.findall(r.text or "")) >= 13)
    rows = [(None, item, "dirty"), (None, "clean words", "a"), (4, item, "dirty"), (4, "other clean words", "b"), (None, None, "c"), (4, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    assert sorted(r.mark for r in corpus_pipeline.without_benchmarks(spark, docs, SF).collect()) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("percent", [80, 90])
def test_fragments_lose_no_link_and_empty_ones_are_rare(percent):
    rng = np.random.default_rng(11)
    cut = Cut(percent)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(4, 600)), dtype=np.uint64) * 2)
        drop = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) * (100 - percent) // 100 + 2)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * both < percent * len(np.union1d(a, b)):
            continue
        keys = [set(cut.keys(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]
    for n in (40, 200, 1000, 3000):
        emitted = []
        for _ in range(100):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
            emitted.append(set(cut.keys(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0].tolist()))
        met = [k for keys in emitted for k in keys]
        assert len(met) - len(set(met)) < 20  # sets without common n-grams share next to no key
