"""Repeated windows, periodic runs and hard negatives against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from steplake.llm import hard_negatives, window_doubling
from steplake.llm.hard_negatives import mine_hard_negatives
from steplake.llm.periodic_runs import Grammar, find_runs, runs_of
from steplake.llm.window_doubling import lengths_to, remove_repeated_windows
from steplake.llm.words import mix


# ---- windows of doubling length

def test_lengths_at_most_double():
    for window in (1, 2, 3, 35, 100):
        for doublings in range(8):
            lengths = lengths_to(window, doublings)
            assert lengths[-1] == window and all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:]))


@pytest.mark.parametrize("window,doublings,part", [(35, 2, 2000), (35, 0, 2000), (7, 5, 500), (1, 2, 2000), (35, 3, 4 << 20)])
def test_repeated_windows(spark, monkeypatch, window, doublings, part):
    monkeypatch.setattr(window_doubling, "LEAST_PART", part)
    rng = random.Random(window + doublings)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(120))] for _ in range(25)]
    rows = [(rng.choice([i, None]), " ".join(rng.choice(base)[rng.randrange(10):] + rng.choice(base))) for i in range(100)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, rows[0][1]), (4, rows[0][1]), (4, "other text"), (5, "Z z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in remove_repeated_windows(frame, window, doublings).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.without_windows(rows, window)))


def test_windows_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in remove_repeated_windows(odd_documents).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.without_windows(rows)))
    assert remove_repeated_windows(no_documents).count() == 0


def test_levels_read_one_exchange_of_the_texts(spark):
    found = remove_repeated_windows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 3


# ---- periodic runs

def _numbers(texts):
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return mix(np.array([x + 1 for t in texts for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)), row


def _odd_text(rng):
    text = [rng.randrange(rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randrange(400))]
    for _ in range(rng.randrange(4)):
        if len(text) > 9:
            a = rng.randrange(len(text))
            p = rng.randrange(1, max(2, (len(text) - a) // 2))
            for i in range(a, a + rng.randrange(1, len(text) - a + 1)):
                text[i] = text[a + (i - a) % p]
    return text


@pytest.mark.parametrize("shortest,repeats", [(24, 3), (6, 3), (40, 4), (1, 5)])
def test_runs(shortest, repeats):
    rng = random.Random(shortest)
    for _ in range(60):
        texts = [_odd_text(rng) for _ in range(rng.randrange(1, 6))]
        words, row = _numbers(texts)
        first = np.searchsorted(row, np.arange(len(texts)))
        got = [(int(r), int(s - first[r]), int(e - s), int(q)) for r, s, e, q in zip(*runs_of(words, row, shortest, repeats))]
        assert got == [(i, *x) for i, t in enumerate(texts) for x in brute.runs(t, shortest, repeats)]


def test_grammar_derives_its_texts_and_leaves_no_pair_twice():
    rng = random.Random(5)
    texts = [_odd_text(rng) for _ in range(20)]
    words, row = _numbers(texts)
    grammar = Grammar(words, row)
    for rule in np.unique(grammar.rule):  # all places of a rule derive the same words
        mine = grammar.rule == rule
        size = grammar.size[mine]
        assert len(set(size)) == 1 and mine.sum() > 1
        assert len({tuple(words[p:p + size[0]]) for p in grammar.place[mine]}) == 1
    starts = np.append(np.flatnonzero(grammar.left), len(words))
    for i in range(len(texts)):
        at = starts[:-1][row[starts[:-1]] == i]
        ends = starts[1:][row[starts[:-1]] == i]
        pieces = [tuple(words[a:b]) for a, b in zip(at, ends)]
        pairs = [(a, b) for a, b in zip(pieces, pieces[1:])]
        again = {p for p in pairs if pairs.count(p) > 1}
        assert all(a == b for a, b in again)  # a word three times in a row


def test_runs_of_one_word():
    words, row = _numbers([[7] * 30_000, [1, 2] * 5000])
    assert list(zip(*(x.tolist() for x in runs_of(words, row, 24, 3)))) == [(0, 0, 30_000, 1), (1, 30_000, 40_000, 2)]


def test_runs_odd_rows(spark, odd_documents, no_documents):
    extra = spark.createDataFrame([(None, "a b " * 40 + "c"), (20, "x " * 23), (20, "x " * 24), (21, "x\ty\n" * 12 + "end")], "doc_id bigint, text string")
    rows = odd_documents.unionByName(extra, allowMissingColumns=True)
    want = []
    for r in rows.collect():
        words = brute.SPACED.findall(r.text or "")
        found = brute.runs(words)
        want.append((r.doc_id, len(words), found, brute.collapsed(words, found)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(rows).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(w[2] for w in want)
    assert find_runs(no_documents).count() == 0


# ---- hard negatives

def _vectors(rng):
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.2, 1]) for _ in range(rng.choice([6, 6, 6, 4]))], rng.randrange(4)) for i in range(240)]
    rows += [(400 + i, rows[3][1], i % 3) for i in range(40)]  # copies
    return rows + [(500, [0.0] * 6, 1), (501, [0.0] * 6, 1), (502, [], 2), (None, [1.0], 1), (503, None, 1), (504, [None, 1.0], 1), (505, [float("nan")], 1),
                   (506, [1.0], None), (20, rows[20][1], rows[20][2]), (20, [0.5] * 6, 1)]


@pytest.mark.parametrize("first,clusters,members,step", [(16384, None, 1024, 512), (30, 3, 3, 7)])
def test_hard_negatives(spark, monkeypatch, first, clusters, members, step):
    """Whole lists, and lists of several segments, blocks, crowds and steps."""
    for name, value in (("FIRST", first), ("MEMBERS", members), ("STEP", step)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = _vectors(random.Random(4))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("key", F.lit("clash")).withColumn("v", F.lit(1))
    got = mine_hard_negatives(frame, F.col("vec_id") % 20 == 0, clusters=clusters).collect()
    want = brute.hard_negatives(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_hard_negatives_of_nothing_and_of_text_labels(spark):
    frame = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "a"), (3, [1.5], "b")], "vec_id bigint, embedding array<float>, label string")
    assert mine_hard_negatives(frame.where("false"), F.col("vec_id") == 1).count() == 0
    assert mine_hard_negatives(frame, F.col("vec_id") == 9).count() == 0
    assert [tuple(r) for r in mine_hard_negatives(frame, F.col("vec_id") == 1).collect()] == [(1, 2, 1, 3, 131072, 98304)]
