"""How many rows the similarity join makes of a large group of near copies, and what bounds its pairs."""

import random

import numpy as np
import pyarrow as pa

import brute
from steplake.llm import jaccard_join
from test_llm_text_operators import frame


def large_group(n, words=120):
    """One text, copies of it with one word changed, which link with each other, and with two, which link with few."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    docs = {}
    for i in range(n):
        text = list(base)
        for k in range(0 if i == n // 2 else 2 if i % 5 == 0 else 1):
            text[rng.randrange(5, words - 5)] = f"c{i}x{k}"
        docs[i] = " ".join(text)
    return docs


def test_rows_of_a_large_group_grow_with_the_group(spark, monkeypatch):
    pairs, edges = spark.sparkContext.accumulator(0), []
    crossing, components = jaccard_join._crossing, jaccard_join.components

    def counted(*args):
        run, made = crossing(*args), pairs

        def counting(key, table):
            out = run(key, table)
            made.add(out.num_rows)
            return out
        return counting

    def watched(links):
        edges.append(links.count())
        return components(links)

    monkeypatch.setattr(jaccard_join, "_crossing", counted)
    monkeypatch.setattr(jaccard_join, "components", watched)
    docs = large_group(240)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, docs), 5, 80).collect()}
    expected = brute.components(docs, 80, 5)
    assert got == expected and len({low for _, low in expected.values()}) < 10
    assert pairs.value <= 4 * len(docs) and sum(edges) <= 4 * len(docs)


def test_bits_never_differ_more_than_the_sets():
    rng = np.random.default_rng(8)
    for n in (1, 30, 3000, 40000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
        b = np.unique(np.concatenate([a[n // 9:], rng.integers(0, 1 << 63, n // 7, dtype=np.uint64)]))
        owner = np.repeat([0, 1], [len(a), len(b)])
        x, y = jaccard_join.fine_bits(np.concatenate([a, b]), owner, 2).view(np.uint64)
        apart = int(jaccard_join._apart(x[None], y)[0])
        assert apart <= len(np.setxor1d(a, b)) and (n > 30 or apart == len(np.setxor1d(a, b)))


def test_keys_of_the_same_classes_are_one():
    low = np.array([7, 7, 8, 8, 9, 9, 10], np.uint32)
    classes = np.array([1, 2, 2, 1, 1, 3, 4], np.uint64)
    table = pa.table({"x": [low.tobytes()], "y": [classes.tobytes()]})
    got = jaccard_join._shared_keys((pa.scalar(0),), table).to_pylist()
    assert sorted((r["class"], r["weight"]) for r in got) == [(1, 1), (1, 2), (2, 2), (3, 1)]
    assert len({r["key"] for r in got}) == 2
