"""Quality classifier: ordinal regression with cumulative links on graded ratings.

All grades share one weight per hashed feature; P(grade >= k) is the logistic function of the score less the
k-th of the ordered thresholds. The expected grade ranks documents, and the probability of reaching a grade selects them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplake.llm.hashed import SAMPLE_ROWS, Fit, fit_in_task, labelled_sample, quality_features, score_rows, screened

RIDGE = 1e-3
STEPS = 300


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cumulative_link(grades: int, ridge: float = RIDGE, steps: int = STEPS) -> Fit:
    """A fit of grades 0 to ``grades`` - 1. The thresholds are the first one and the logarithms of the steps between them, so they stay in order."""
    def fit(number, row, y):
        n, k = len(y), grades - 1
        reached = np.array([((y >= g).sum() + 0.5) / (n + 1) for g in range(1, grades)])
        start = np.maximum.accumulate(-np.log(reached / (1 - reached)) + 1e-3 * np.arange(k))
        if not n or y.min() == y.max():  # nothing to tell apart: the grades' shares
            return np.zeros(0, np.int64), np.zeros(0), start
        used = screened(number, row, y)
        at = np.searchsorted(used, number)
        known = used[np.minimum(at, max(len(used) - 1, 0))] == number if len(used) else np.zeros(len(number), bool)
        column, row = at[known], row[known]
        params = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
        moment, second = np.zeros_like(params), np.zeros_like(params)
        # each grade weighs alike
        share = (1 / np.maximum(np.bincount(y, minlength=grades), 1))[y] / len(np.unique(y))
        for step in range(1, steps + 1):
            weight, first, gaps = params[:len(used)], params[len(used)], np.exp(params[len(used) + 1:])
            threshold = np.concatenate([[-np.inf], first + np.append(0, np.cumsum(gaps)), [np.inf]])
            score = np.bincount(row, weights=weight[column], minlength=n)
            # P(y) = F(t[y+1] - s) - F(t[y] - s)
            high, low = _sigmoid(threshold[y + 1] - score), _sigmoid(threshold[y] - score)
            high, low = np.where(y == k, 1.0, high), np.where(y == 0, 0.0, low)
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p * share, low * (1 - low) / p * share
            d_score = d_high - d_low  # of the loss, -log p
            slope_t = np.array([(d_low[y == j]).sum() - (d_high[y == j - 1]).sum() for j in range(1, grades)])
            slope_gap = np.array([slope_t[j:].sum() for j in range(1, k)]) * gaps
            slope = np.concatenate([np.bincount(column, weights=d_score[row], minlength=len(used)) + ridge * weight, [slope_t.sum()], slope_gap])
            moment, second = 0.9 * moment + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
            params = params - 0.05 * (moment / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
        return used, params[:len(used)], params[len(used)] + np.append(0, np.cumsum(np.exp(params[len(used) + 1:])))

    return fit


def grade(documents: DataFrame, ratings: DataFrame, grades: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, expected_grade and p_grade_1 .. p_grade_<grades - 1> for every row of documents(doc_id, text), learned from ratings(doc_id, y).

    y is a grade from 0 to ``grades`` - 1; p_grade_k is the probability of grade k or better. The fit takes at most
    ``rows`` rated documents, those whose doc_id hashes lowest; NULL ratings, ratings outside the grades and those
    of no document don't count. Every whole text is graded, NULL as an empty one. Without ratings of
    different grades all documents get the grades' smoothed shares. Repeated rows stay; other columns are
    ignored; an empty table gives no rows.
    """
    rated = ratings.select("doc_id", F.col("y").cast("int").alias("y")).where(F.col("y").between(0, grades - 1))
    numbers, weights, thresholds = fit_in_task(labelled_sample(documents, rated, rows), quality_features, cumulative_link(grades))
    if len(thresholds) != grades - 1:
        thresholds = np.zeros(grades - 1)
    out = score_rows(documents, quality_features, numbers, weights)
    tails = [(1 / (1 + F.exp(float(t) - F.col("linear")))).alias(f"p_grade_{k}") for k, t in enumerate(thresholds, 1)]
    out = out.select("doc_id", *tails)
    return out.select("doc_id", sum((F.col(f"p_grade_{k}") for k in range(1, grades)), F.lit(0.0)).alias("expected_grade"),
                      *[f"p_grade_{k}" for k in range(1, grades)])
