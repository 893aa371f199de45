import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import LANGUAGE
from steplake.llm.language_id import best_path, identify, keep_identified, learn
from steplake.llm.queries import QUERIES
from steplake.llm.quality import cumulative_link, grade
from steplake.llm.toxicity import logistic, score_toxicity, swaps

SF = "/root/testdata/sf0.1"


def one_by_one(scores, penalty):
    """The best path of one row, by trying every step."""
    total, back = scores[0].copy(), []
    for s in scores[1:]:
        moves = total[:, None] - penalty * (1 - np.eye(len(total)))
        back.append(moves.argmax(axis=0))
        total = moves.max(axis=0) + s
    out = [int(total.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return total.max(), out[::-1]


def test_best_path():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 40, 7, 0, 25]
    row = np.repeat(np.arange(len(lengths)), lengths)
    scores = rng.normal(size=(len(row), 3)).astype(np.float32) * 4
    got = best_path(scores, row, len(lengths), 5.0)
    for r, n in enumerate(lengths):
        if n:
            mine, labels = scores[row == r], got[row == r]
            value = mine[np.arange(n), labels].sum() - 5.0 * (labels[1:] != labels[:-1]).sum()
            assert value == pytest.approx(one_by_one(mine, 5.0)[0], abs=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join((words.split() * 5)[i % 3:]), lang) for i, (lang, words) in enumerate([*LANGUAGE.items()] * 5)]
    return learn(spark.createDataFrame([*rows, (99, None, "en"), (98, "the", None)], "doc_id bigint, text string, lang string"))


def test_spans_of_mixed_texts(spark, model):
    en, ru = " ".join(LANGUAGE["en"].split() * 3), " ".join(LANGUAGE["ru"].split() * 3)
    rows = identify(spark.createDataFrame([(1, f"{en}. {ru}!"), (2, "123 !"), (3, None), (4, "路 水")], "doc_id bigint, text string"), model).collect()
    got = {r.doc_id: r for r in rows}
    assert [(s.lang, (f"{en}. {ru}!")[s.first:s.last]) for s in got[1].spans] == [("en", en), ("ru", ru)]
    assert got[1].lang_pred in ("en", "ru") and 0.4 < got[1].score < 0.6
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[2].score == 0 and got[3].spans == []
    assert got[4].lang_pred in LANGUAGE  # a script nobody uses leaves all candidates


def test_language_odd_rows(spark, model, odd_documents, no_documents):
    rows = identify(odd_documents, model).collect()
    assert len(rows) == 14 and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 9}
    assert identify(no_documents, model).count() == 0
    empty = learn(no_documents)
    assert {(r.lang_pred, r.score) for r in identify(odd_documents, empty).collect()} == {("und", 0.0)}
    kept = keep_identified(odd_documents, model)
    assert kept.columns == odd_documents.columns and kept.count() == 10
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 8, 10, 11, 12, 12]


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op4_language_id"](spark, SF).join(truth, "doc_id").where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.98 and 0 <= got[1] <= got[2] <= 1


def auc(pairs):
    pairs = np.array(pairs, float)
    order = pairs[:, 0].argsort(kind="stable")
    rank = np.empty(len(pairs))
    rank[order] = np.arange(len(pairs))
    hot = pairs[:, 1] == 1
    return (rank[hot].sum() - hot.sum() * (hot.sum() - 1) / 2) / (hot.sum() * (~hot).sum())


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op6_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    assert auc([r[:2] for r in rows]) > 0.93
    assert np.mean([r.toxic == r.predicted for r in rows]) > 0.95


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op1_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert auc([(r.expected_grade, r.quality) for r in rows]) > 0.93
    assert np.mean([r.keep for r in rows if r.quality == 1 and r.toxic == 0]) > 0.97


def test_swapped_terms_score_alike():
    """A term that goes with the label by accident gets no weight of its own."""
    rng = np.random.default_rng(1)
    a, b = (list(swaps([("alpha", "beta")]))[i] for i in (0, 1))
    number, row, y = [], [], []
    for i in range(400):
        toxic = i % 2
        y.append(toxic)
        number += [11 if rng.random() < (0.6 if toxic else 0.02) else 12, a if toxic and rng.random() < 0.8 else b]
        row += [i, i]
    y = np.array(y)
    plain = dict(zip(*logistic([("alpha", "beta")], penalty=0.0)(np.array(number), np.array(row), y)[:2]))
    fair = dict(zip(*logistic([("alpha", "beta")], penalty=50.0)(np.array(number), np.array(row), y)[:2]))
    assert abs(fair[a] - fair[b]) < 0.2 * abs(plain[a] - plain[b])
    assert fair[11] > 0.5


def test_ordered_thresholds():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 600)
    number, row = [], []
    for i, grade_ in enumerate(y):
        for f in range(6):
            if rng.random() < 0.15 + 0.2 * grade_:
                number.append(f)
                row.append(i)
    used, weight, threshold = cumulative_link(4)(np.array(number), np.array(row), y)
    assert (np.diff(threshold) > 0).all() and len(threshold) == 3 and (weight > 0).all() and len(used) == 6


def test_classifier_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None), (7, 1), (500, 0), (12, 1), (12, 1)], "doc_id bigint, y int").withColumn("text", F.lit("x"))
    scored = score_toxicity(odd_documents, labels).collect()
    assert len(scored) == 14 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert {r.score for r in score_toxicity(odd_documents, labels.where("false")).collect()} == {0.5}
    assert score_toxicity(no_documents, labels).count() == 0
    graded = grade(odd_documents, labels.withColumn("y", F.col("y") * 2), 3).collect()
    assert len(graded) == 14 and all(0 <= r.expected_grade <= 2 and r.p_grade_1 >= r.p_grade_2 for r in graded)
    assert grade(no_documents, labels, 3).count() == 0 and grade(odd_documents, labels.where("false"), 3).count() == 14
