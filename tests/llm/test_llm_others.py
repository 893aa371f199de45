import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from steplake.llm.mix_sources import Mix, permuted
from steplake.llm.pseudonyms import luhn, pseudonymise, replace_values
from steplake.llm.pseudonyms import permuted as feistel
from steplake.llm.queries import URL_RULES
from steplake.llm.top_k import top_inner_products
from steplake.llm.url_filter import build_cascade, filter_urls

KEY = b"test"


# ---- URL filter

@pytest.mark.parametrize("n,listed", [(5000, 700), (3000, 1), (300, 300), (200, 0)])
def test_cascade_is_exact(spark, n, listed):
    universe = spark.range(n).select(F.concat(F.lit("host"), "id").alias("key"))
    cascade = build_cascade(universe.limit(listed).unionAll(spark.createDataFrame([(None,)], "key string")), universe)
    picked = {r.key for r in universe.limit(listed).collect()}
    got = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == picked


def test_rules_and_odd_urls(spark):
    rows = {1: "http://a.net/x", 2: "https://www.EXAMPLE.net/en/1?q#f", 3: "https://example.net/en", 4: "x://deep.example.com/de/#t",
            5: "http://b.org/fr/", 6: "http://b.org/de/", 7: None, 8: "no address", 9: "http://net", 10: "http://", 11: "http://bad.org?x=http://a.net/",
            12: "http://notexample.net/en/", 13: "http://ÄB.net/p", 14: "http://bad.org/y"}
    pages = spark.createDataFrame(list(rows.items()), "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("listed", F.lit(1))
    listed = spark.createDataFrame([("bad.org",), ("elsewhere.com",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, URL_RULES, listed).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("www.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.net", "/en", "net/", "block"),
        4: ("deep.example.com", "/de/", "example.com/de/", "block"), 5: ("b.org", "/fr/", "org/fr/", "allow"), 6: ("b.org", "/de/", None, "allow"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("net", "", None, "allow"), 10: ("", "", None, "allow"),
        11: ("bad.org", "", None, "block"), 12: ("notexample.net", "/en/", "net/", "block"), 13: ("Äb.net", "/p", "net/", "block"),
        14: ("bad.org", "/y", None, "block")}
    assert filter_urls(pages.where("false"), URL_RULES, listed).count() == 0
    plan = filter_urls(pages, URL_RULES, listed)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_long_lists_are_joined(spark, monkeypatch):
    import steplake.llm.url_filter as u

    monkeypatch.setattr(u, "MAX_BITS", 32)
    pages = spark.createDataFrame([(1, "http://bad.org/"), (2, "http://good.org/")], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in filter_urls(pages, [], spark.createDataFrame([("bad.org",), ("worse.org",)], "key string")).collect()}
    assert got == {1: "block", 2: "allow"}


# ---- source mix

def test_index_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        index, size, key = np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64)
        there = permuted(index, size, key)
        assert sorted(there) == list(range(n))
        assert (permuted(there, size, key, inverse=True) == index).all()


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["b", "a", "ab", "Z", "é", None]) if i % 3 else "a", " ".join("w" * rng.randint(0, 900) for _ in range(rng.randint(0, 400)))) for i in range(300)]
    rows += [(900, "tiny", "one two"), (901, "none", None), (902, "none", "  ")]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("size", F.lit("clash"))
    size = {i: len(brute.SPACED.findall(t or "")) for i, _, t in rows}
    words = {}
    for i, s, _ in rows:
        words[s] = words.get(s, 0) + size[i]
    target = brute.targets(words)
    mix = Mix(documents)
    got = mix.summary().collect()
    assert len(got) == len(rows) and {r.doc_id: r.size for r in got} == size
    taken = {}
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in words)
    assert sorted(map(str, got)) == sorted(map(str, Mix(documents.repartition(7)).summary().collect()))
    pieces = mix.mixed().groupBy("doc_id").agg(F.sum(F.col("until_word") - F.col("from_word")).alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_odd_rows(odd_documents, no_documents):
    got = Mix(odd_documents).summary().collect()
    assert len(got) == 14 and all(r.taken <= 2 * r.size for r in got)
    assert Mix(no_documents).summary().count() == 0
    assert {r.taken for r in Mix(odd_documents.where("doc_id < 4")).summary().collect()} == {0}


# ---- pseudonyms

@pytest.mark.parametrize("size", [1, 2, 10, 1000])
def test_feistel_is_a_permutation(size):
    there = [feistel(KEY, "x", i, size) for i in range(size)]
    assert sorted(there) == list(range(size))
    assert [feistel(KEY, "x", v, size, True) for v in there] == list(range(size))


def test_values_stay_valid_and_linked():
    text = "card 4041894974608795 or 4041 8949 7460 8795, host 152.143.123.131, on 2001-02-28 and 28.02.2001, +1 (988) 555-2485, DE89 3704 0044 0532 0130 00"
    new, n = pseudonymise(text, KEY)
    assert n == 7 and pseudonymise(text, KEY)[0] == new != pseudonymise(text, b"other")[0]
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}(?=,)", new)
    assert cards[0] == cards[1].replace(" ", "") and luhn(cards[0][:-1]) == int(cards[0][-1])
    year, month, day = re.search(r"(\d{4})-(\d\d)-(\d\d)", new).groups()
    assert f"{day}.{month}.{year}" in new
    account = re.search(r"DE[\d ]+", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    assert all(int(p) < 256 for p in re.search(r"host ([\d.]+),", new)[1].split("."))
    assert not re.search("4041894974608795|152.143|988|555-2485|3704", new)


@pytest.mark.parametrize("text", ["4041894974608796", "999.1.1.1", "1.2.3.4.5", "2001-02-30", "000-12-3456", "(123) 555-0000", "version 1.2.3", "in 1999", "3/4"])
def test_invalid_candidates_stay(text):
    assert pseudonymise(f"x {text} y", KEY) == (f"x {text} y", 0)


def test_pseudonyms_odd_rows(spark, odd_documents, no_documents):
    out = replace_values(odd_documents, KEY)
    assert out.columns == [*odd_documents.columns, "n_values"]
    assert sorted(map(str, out.drop("n_values").collect())) == sorted(map(str, odd_documents.collect()))
    assert replace_values(no_documents, KEY).count() == 0
    rows = spark.createDataFrame([(1, "a@b.example.org 10.0.0.1", 5), (2, "a@b.example.org", 6)], "doc_id bigint, text string, n_values int")
    got = {r.doc_id: r for r in replace_values(rows, KEY).collect()}
    assert got[1].n_values == 2 and got[2].n_values == 1 and got[1].text.split()[0] == got[2].text != "a@b.example.org"


# ---- top k

def best(vectors, is_query, k, scale=64):
    whole = {i: [int(np.floor(float(x) * scale)) for x in v] for i, v in vectors}
    out = []
    for q, a in whole.items():
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,n,scale", [(1, 400, 1), (2, 30, 1), (3, 300, 100_000)])
def test_top_k(spark, monkeypatch, seed, n, scale):
    import steplake.llm.top_k as t

    monkeypatch.setattr(t, "BLOCK", 32)
    monkeypatch.setattr(t, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in (rng.normal(size=8) * rng.gamma(1.0) * scale).astype(np.float32)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # many equal scores
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, top_inner_products(frame, F.col("vec_id") % 5 == 0, 6).collect()))
    assert got == best(rows, lambda i: i % 5 == 0, 6)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [3.0]), (6, []), (None, [1.0, 1.0]), (20, [0.5, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got = sorted(map(tuple, top_inner_products(frame, F.col("vec_id") % 20 == 0).collect()))
    assert got == best([(0, [1, 2, ]), (5, [3, 0]), (6, [0, 0]), (20, [0.5, -1])], lambda i: i % 20 == 0, 20)
    assert top_inner_products(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert top_inner_products(frame.where("vec_id = 5"), F.col("vec_id") % 20 == 0).count() == 0
    assert top_inner_products(frame.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
