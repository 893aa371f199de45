import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from steplake.llm.components import components
from steplake.llm.decontaminate import contamination, remove_spans
from steplake.llm.jaccard_join import Cut, jaccard_components
from steplake.llm.suffix_dedup import remove_repeats
from steplake.llm.words import FOLDED, NOT_SPACE, ranges, running, word_hashes


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")


def near_copies(seed, n, words=60):
    """Texts of a few families, each a base with some words changed."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, words))] for _ in range(6)]
    docs = {}
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            text += [rng.choice(vocabulary) for _ in range(rng.randint(1, 4))]
        docs[i] = rng.choice([" ", "  ", "\n"]).join(text).upper() if rng.random() < 0.2 else " ".join(text)
    return docs


def test_hashes_of_equal_ranges_are_equal():
    raw = np.frombuffer(b"abcd xabcdy ABCD", np.uint8)
    sums = running(raw, FOLDED)
    h = ranges(sums, np.array([0, 6, 12, 0]), np.array([4, 10, 16, 3]))
    assert h[0] == h[1] == h[2] != h[3]
    hashes, row = word_hashes(np.frombuffer(b"a b" + b"c a", np.uint8), np.array([0, 3, 3, 6]), NOT_SPACE)
    assert row.tolist() == [0, 0, 2, 2] and hashes[0] == hashes[3] != hashes[1] != hashes[2]


@pytest.mark.parametrize("seed,n,words", [(1, 120, 60), (2, 120, 12), (3, 60, 300)])
def test_jaccard_components(spark, seed, n, words):
    docs = near_copies(seed, n, words) | {1000: None, 1001: "", 1002: "  ", 1003: "one two", 1004: "ONE  two"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, docs)).collect()}
    assert got == brute.components(docs)


def test_fragments_never_lose_a_link():
    """Sets that may link share a key, whatever their sizes: drawn at the threshold and close to it."""
    rng = np.random.default_rng(5)
    cut = Cut(90)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
        drop = int(rng.integers(0, len(a) // 10 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 10 + 2)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * both < 90 * len(np.union1d(a, b)):
            continue
        keys = [set(cut.keys(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_jaccard_odd_rows(odd_documents, no_documents):
    got = {}
    for r in jaccard_components(odd_documents).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)}
    assert got[4] == got[5] == got[12] == {(1, 4)}
    assert got[6] == {(1, 6)} == got[None]
    assert got[7] == {(got[7].copy().pop()[0], 7)} and {c for _, c in got[8]} == {7}
    assert jaccard_components(odd_documents).count() == 14
    assert jaccard_components(no_documents).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (5, 5), (None, 3)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert labels == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_contamination(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Stone", "wäter", "x9", "river", "night", "glass"]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(n)) for i, n in enumerate([30, 20, 13, 12, 5, 2])} | {50: None, 51: "?!", 52: ""}
    docs = {}
    for i in range(60):
        words = [rng.choice(vocabulary + ["other", "words", "here"]) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            source = items[rng.randrange(6)].upper().split()
            at = rng.randint(0, len(words))
            words[at:at] = source[rng.randint(0, 3):]
        docs[i] = rng.choice([" ", ", ", "\n"]).join(words)
    docs |= {100: None, 101: "", 102: "---"}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in contamination(frame(spark, docs), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()}
    assert got == brute.contamination(docs, items)


def test_contamination_of_many_windows_is_the_same(spark, monkeypatch):
    """Beyond the bounds anchors are not listed and windows not broadcast."""
    import steplake.llm.decontaminate as d

    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o"), (2, "q r")], "item_id bigint, text string")
    docs = frame(spark, {1: "z a b c d e f g h i j k l m n z", 2: "q r s", 3: "s"})
    want = sorted(map(tuple, contamination(docs, items).drop("hit_spans").collect()))
    monkeypatch.setattr(d, "MAX_LISTED_ANCHORS", 1)
    monkeypatch.setattr(d, "MAX_BROADCAST_WINDOWS", 1)
    assert sorted(map(tuple, contamination(docs, items).drop("hit_spans").collect())) == want


def test_contamination_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "one"), (None, None)], "item_id bigint, text string").withColumn("w", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_hit) for r in contamination(odd_documents, items).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4] == got[12] == (1, 1) and got[6] == (2, 1) and got[7] == (120_000, 0)
    assert contamination(odd_documents, items.where("false")).where("contaminated").count() == 0
    assert contamination(no_documents, items).count() == 0
    plan = contamination(odd_documents, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_remove_spans(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    docs = frame(spark, {1: "Say: RED, green-blue! and on", 2: "red green", 3: None})
    got = {r.doc_id: r.text for r in remove_spans(docs, items).collect()}
    assert got == {1: "Say: and on", 2: "red green", 3: None}


def passages(seed, n):
    """Texts that share passages, with umlauts cut at any byte, and repeats within one text."""
    rng = random.Random(seed)
    vocabulary = ["the", "größe", "of", "naïve", "stone", "and", "ab", "é"]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 60))) for _ in range(5)]
    docs = {}
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(rng.randint(1, 50))))
        docs[i] = " | ".join(parts)
    return docs | {n: None, n + 1: "", n + 2: "a" * 400, n + 3: "a" * 99, n + 4: "ab" * 300, n + 5: docs[0], n + 6: shared[0][:120]}


@pytest.mark.parametrize("seed,depth", [(1, 100), (2, 100), (3, 41), (4, 8)])
def test_remove_repeats(spark, seed, depth):
    docs = passages(seed, 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame(spark, docs).repartition(5), depth).collect()}
    assert got == brute.without_repeats(docs, depth)


def test_remove_repeats_odd_rows(odd_documents, no_documents):
    rows = remove_repeats(odd_documents, 100, with_bytes=True).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 14 and got[1].n_bytes == got[2].n_bytes == 0 and got[4].n_removed == 0
    assert got[8].n_bytes - got[8].n_removed == 3 and bytes(got[8].kept) == b"end"
    assert got[10].n_removed == 4999 and got[10].n_spans == 1
    assert remove_repeats(no_documents).count() == 0


def _odd_ids(texts):
    """Two different rows without doc_id, one doc_id twice with different texts, repeated rows, helper names as columns."""
    a, b, c = texts
    return [(None, a, 1), (None, b, 2), (3, c, 3), (3, a, 4), (3, a, 5), (4, b, 6), (None, None, 7), (3, None, 8), (None, a, 9)]


def test_remove_repeats_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    make = lambda n: " ".join(f"w{rng.randrange(1000)}" for _ in range(n))
    shared = make(60)
    rows = _odd_ids([make(50) + shared, shared + make(90), make(40) + shared + make(3)])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, number int")
    marked = docs.withColumn("mark", F.xxhash64("text")).collect()
    # one document per doc_id and text, in the order of doc_id, NULL last, and hash
    order = {key: i for i, key in enumerate(sorted({(r.doc_id is None, r.doc_id or 0, r.mark) for r in marked}))}
    place = lambda r: order[r.doc_id is None, r.doc_id or 0, r.mark]
    want = brute.without_repeats({place(r): r.text for r in marked})
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r.doc_id, *want[place(r)])) for r in marked)
    assert sum(r[2] > 0 for r in got) >= 3


def test_remove_spans_of_null_and_repeated_ids(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    rows = _odd_ids(["Say: RED, green-blue! and on", "red green", "more red green blue"])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words int").withColumn("gaps", F.lit("kept")).withColumn("hit_spans", F.lit(1))
    cut = {"Say: RED, green-blue! and on": "Say: and on", "more red green blue": "more ", "red green": "red green", None: None}
    got = remove_spans(docs, items)
    assert got.columns == docs.columns
    assert sorted(((r.words, r.doc_id, r.text, r.gaps, r.hit_spans) for r in got.collect()), key=str) == sorted(
        ((n, i, cut[t], "kept", 1) for i, t, n in rows), key=str)
