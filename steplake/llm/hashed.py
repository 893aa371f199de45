"""Hashed presence features of texts, and linear models over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplake.llm.shared import group_bounds
from steplake.llm.words import FOLDED, NOT_SPACE, chunks, mix, ranges, running, word_bounds

BITS = 20  # of a feature number
STEM = 5  # bytes of a word's stem
SAMPLE_ROWS = 12_000  # labelled rows a model is fitted on at most
_U = np.uint64

_codes = np.arange(256)
WORD_BYTE = ((_codes >= 48) & (_codes <= 57)) | ((_codes | 32 >= 97) & (_codes | 32 <= 122) & (_codes < 128)) | (_codes >= 128)
MARK_BYTE = NOT_SPACE & ~WORD_BYTE
UPPER = (_codes >= 65) & (_codes <= 90)

Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _numbers(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes + _U(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(64 - BITS)).astype(np.int64)


def word_features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and row of every word, A-Z as a-z, and of the stem of every longer word."""
    begin, end, row = word_bounds(raw, starts, WORD_BYTE)
    sums = running(raw, FOLDED)
    long = end - begin > STEM
    return (np.concatenate([_numbers(ranges(sums, begin, end), 1), _numbers(ranges(sums, begin[long], begin[long] + STEM), 2)]),
            np.concatenate([row, row[long]]))


def quality_features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and stems, runs of other marks, and the text's shape: length, and shares of marks, capitals and line ends."""
    words, row = word_features(raw, starts)
    begin, end, mark_row = word_bounds(raw, starts, MARK_BYTE)
    marks = _numbers(ranges(running(raw, FOLDED), begin, end), 3)
    n = len(starts) - 1
    size = np.diff(starts)
    shape, shape_row = [_numbers(np.minimum(16, np.log2(size + 1)).astype(_U), 4)], [np.arange(n)]
    owner = np.repeat(np.arange(n), size)
    for kind, member in ((5, MARK_BYTE), (6, UPPER), (7, _codes == 10), (8, ~NOT_SPACE)):
        share = np.bincount(owner, weights=member[raw], minlength=n) / np.maximum(size, 1)
        shape.append(_numbers(np.minimum(20, share * 40).astype(_U), kind))
        shape_row.append(np.arange(n))
    return np.concatenate([words, marks, *shape]), np.concatenate([row, mark_row, *shape_row])


def distinct(number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a row once, by row."""
    order = np.lexsort((number, row))
    number, row = number[order], row[order]
    first = group_bounds(row, number)[:-1]
    return number[first], row[first]


def term_numbers(term: str) -> list[int]:
    """The features of one word."""
    raw = np.frombuffer(term.encode(), np.uint8)
    return word_features(raw, np.array([0, len(raw)]))[0].tolist()


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, y, text) of at most ``rows`` labelled documents: those whose doc_id hashes lowest. ``rows`` bounds what is broadcast."""
    chosen = labels.where("doc_id is not null and y is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")


def _featured(features: Features):
    def run(batches):
        for batch in batches:
            y = batch.column("y")
            for rows, raw, starts in chunks(batch.column("text")):
                number, row = distinct(*features(raw, starts))
                cut = np.searchsorted(row, np.arange(len(rows) + 1))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(rows.start, len(rows)), "y": y.slice(rows.start, len(rows)),
                                       "features": pa.array([number[b:e].astype(np.int32).tobytes() for b, e in zip(cut[:-1], cut[1:])], pa.binary())})
    return run


Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def fit_in_task(sample: DataFrame, features: Features, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, weights and thresholds from ``fit(features, rows, labels)``, run by one task over the bounded sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("doc_id")
        rows = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("features")]
        number = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        result = fit(number.astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.asarray(table.column("y")).astype(np.int64))
        yield pa.record_batch({c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("numbers", "weights", "thresholds"), result)})

    made = sample.select("doc_id", F.col("y").cast("int").alias("y"), "text").mapInArrow(_featured(features), "doc_id bigint, y int, features binary")
    out = made.repartition(1).mapInArrow(run, "numbers binary, weights binary, thresholds binary").first()
    if out is None:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(1)
    return np.frombuffer(bytes(out["numbers"]), np.int64), np.frombuffer(bytes(out["weights"])), np.frombuffer(bytes(out["thresholds"]))


def screened(number: np.ndarray, row: np.ndarray, y: np.ndarray, least: int = 5, z: float = 4.0) -> np.ndarray:
    """Features of at least ``least`` rows whose rows' mean label differs from the others' by ``z`` standard errors."""
    if not len(number):
        return np.zeros(0, np.int64)
    size = int(number.max()) + 1
    seen = np.bincount(number, minlength=size)
    total = np.bincount(number, weights=y[row].astype(float), minlength=size)
    n, rest = len(y), np.maximum(len(y) - seen, 1)
    gap = total / np.maximum(seen, 1) - (y.sum() - total) / rest
    error = np.sqrt(max(float(y.var()), 1e-9) * (1 / np.maximum(seen, 1) + 1 / rest))
    return np.flatnonzero((seen >= least) & (seen <= n) & (np.abs(gap) >= z * error))


def scores(raw: np.ndarray, starts: np.ndarray, features: Features, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's distinct features; only weighted ones are sorted."""
    number, row = features(raw, starts)
    used = weight[number] != 0
    number, row = distinct(number[used], row[used])
    return np.bincount(row, weights=weight[number], minlength=len(starts) - 1).astype(float)


def dense(numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS)
    out[numbers] = weights
    return out


def score_rows(documents: DataFrame, features: Features, numbers: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id and the linear score of every whole text. The weights sent to the tasks are as many as features passed the screen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = dense(numbers, weights)
        for batch in batches:
            parts = [scores(raw, starts, features, weight) for _, raw, starts in chunks(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(parts or [np.zeros(0)]))], names=["doc_id", "linear"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, linear double")
