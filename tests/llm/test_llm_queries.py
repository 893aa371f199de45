"""Every corpus query on the smallest tables: against its SQL twin, or against plain Python."""

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from oracle import compare, connect
from steplake.llm.pseudonyms import pseudonymise
from steplake.llm.queries import ORACLE, PSEUDONYM_KEY, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, duck, name):
    status, detail = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF)
    assert status == "exact", detail


def test_jaccard_and_repeats_against_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_ngram_jaccard_join"](spark, SF).collect()} == brute.components(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op10_suffix_dedup"](spark, SF).collect()}
    assert got == brute.without_repeats(docs)


def test_mix_query(spark):
    rows = QUERIES["op7_source_mix"](spark, SF).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = {}
    for r in texts.values():
        words[r.source] = words.get(r.source, 0) + len(brute.SPACED.findall(r.text or ""))
    target = brute.targets(words)
    taken = {}
    for r in rows:
        assert r.size == len(brute.SPACED.findall(texts[r.doc_id].text or "")) and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[r.source]) and r.source_size == words[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(rows) == len(texts) and all(abs(taken[s] - target[s]) < 1 for s in words)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op7_source_mix"](spark, SF).collect()))


def test_pseudonym_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_pseudonyms"](spark, SF).collect():
        assert (r.text, r.n_values) == pseudonymise(texts[r.doc_id], PSEUDONYM_KEY)


def test_pipeline(spark, folder):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{folder}/{name}")
        kept.append(docs)
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == kept[0].columns
    rows = [{r.doc_id: r for r in d.collect()} for d in kept]
    assert set(rows[1]) == {d for d, r in rows[0].items() if any(c.isalpha() for c in r.text or "")}
    parts = brute.components({d: r.text for d, r in rows[1].items()}, corpus_pipeline.NEAR_PERCENT, corpus_pipeline.NEAR_WORDS)
    assert set(rows[2]) == {d for d, (_, c) in parts.items() if c == d}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    dirty = brute.contamination({d: r.text for d, r in rows[2].items()}, items)
    assert set(rows[3]) == {d for d, x in dirty.items() if not x[-1]}
    assert {d: r.text for d, r in rows[4].items()} == {d: pseudonymise(r.text, PSEUDONYM_KEY)[0] for d, r in rows[3].items()}
    assert all(r.n_chars == len(r.text) for r in rows[4].values() if r.text != rows[3][r.doc_id].text)
    mixed = docs.collect()
    assert {r.doc_id for r in mixed} == set(rows[4])
    words = {}
    for r in rows[4].values():
        words[r.source] = words.get(r.source, 0) + len(brute.SPACED.findall(r.text))
    target = brute.targets(words)
    assert all(r.target == pytest.approx(target[r.source]) for r in mixed)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, mixed))


def test_pipeline_odd_rows(spark, odd_documents, no_documents):
    benchmark = SF
    for docs, least in ((odd_documents.withColumn("n_chars", F.length("text").cast("bigint")), 1), (no_documents.withColumn("n_chars", F.lit(0)), 0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, benchmark)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        assert docs.count() >= least
