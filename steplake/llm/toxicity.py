"""Toxicity score: a logistic model whose score may not change when identity terms are swapped.

Each labelled text that mentions a group gets a counterfactual, the same text with another group's
term. The loss adds the squared difference of the two linear scores, so a term's own weight
is driven to that of its counterparts and neutral mentions of a group do not count as toxic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplake.llm.hashed import SAMPLE_ROWS, Fit, distinct, fit_in_task, labelled_sample, score_rows, screened, term_numbers, word_features

# Groups of terms that stand for each other; a term is swapped for the next one of its group.
IDENTITY_TERMS = [
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu"), ("gay", "straight", "lesbian"), ("immigrants", "natives", "refugees"),
    ("black", "white", "asian"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "inländer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
]
PENALTY = 4.0  # of a squared score change
RIDGE = 1e-3
STEPS = 300


def swaps(groups=IDENTITY_TERMS) -> dict[int, int]:
    """From each identity term's features to those of the term that replaces it."""
    out = {}
    for group in groups:
        for term, other in zip(group, group[1:] + group[:1]):
            a, b = term_numbers(term), term_numbers(other)
            out |= {x: b[min(i, len(b) - 1)] for i, x in enumerate(a)}
    return out


def logistic(groups=IDENTITY_TERMS, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> Fit:
    """A fit with the counterfactual penalty: features that tell the labels apart, and all identity terms."""
    swap = swaps(groups)

    def fit(number, row, y):
        n = len(y)
        if not n or y.min() == y.max():  # nothing to tell apart: the labels' share
            share = (y.sum() + 0.5) / (n + 1) if n else 0.5
            return np.zeros(0, np.int64), np.zeros(0), np.array([np.log(share / (1 - share))])
        terms = np.array(sorted({*swap, *swap.values()}), np.int64)
        used = np.union1d(screened(number, row, y), np.intersect1d(terms, number))
        used = np.union1d(used, np.array([swap[t] for t in used.tolist() if t in swap], np.int64))
        at = np.searchsorted(used, number)
        known = used[np.minimum(at, max(len(used) - 1, 0))] == number if len(used) else np.zeros(len(number), bool)
        column, row = at[known], row[known]
        # counterfactuals of the rows that mention a term
        to = np.array([np.searchsorted(used, swap[f]) if f in swap else i for i, f in enumerate(used.tolist())], np.int64)
        mentions = np.unique(row[to[column] != column]) if len(column) else np.zeros(0, np.int64)
        swapped, swapped_row = distinct(to[column], row)
        in_swap = np.isin(swapped_row, mentions)
        swapped, swapped_row = swapped[in_swap], swapped_row[in_swap]
        is_mention = np.zeros(n, bool)
        is_mention[mentions] = True
        weight, bias = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean())))
        # both classes weigh alike, so 0.5 parts them
        share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
        moment, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for step in range(1, steps + 1):
            linear = np.bincount(row, weights=weight[column], minlength=n)
            other = np.bincount(swapped_row, weights=weight[swapped], minlength=n)
            error = (1 / (1 + np.exp(-np.clip(linear + bias, -30, 30))) - y) * share
            gap = np.where(is_mention, linear - other, 0) * (2 * penalty / n)
            slope = np.bincount(column, weights=(error + gap)[row], minlength=len(used)) - np.bincount(swapped, weights=gap[swapped_row], minlength=len(used))
            slope = np.append(slope + ridge * weight, error.sum())
            moment, second = 0.9 * moment + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
            move = 0.05 * (moment / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
            weight, bias = weight - move[:-1], bias - move[-1]
        return used, weight, np.array([bias])

    return fit


def score_toxicity(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, groups=IDENTITY_TERMS) -> DataFrame:
    """doc_id, score, predicted for every row of documents(doc_id, text), learned from labels(doc_id, y).

    The fit takes at most ``rows`` labelled documents, those whose doc_id hashes lowest; labels that are NULL or
    belong to no document don't count. Every whole text is scored; a NULL or empty one has the score of a text
    without known words. Without labels of both kinds all scores are the labels' smoothed share.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    sample = labelled_sample(documents, labels.select("doc_id", F.col("y").cast("int").alias("y")), rows)
    numbers, weights, bias = fit_in_task(sample, word_features, logistic(groups))
    score = 1 / (1 + F.exp(-(F.col("linear") + float(bias[0]))))
    return score_rows(documents, word_features, numbers, weights).select("doc_id", score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
