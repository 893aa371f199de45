"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered by most-significant-digit passes and only through the threshold's bytes;
suffixes equal at that depth are the repeated windows. A suffix alone in its group is left out
of the next pass.

The first digit is that of sampled suffixes: each window is represented by the suffix, among those
that start in it, whose first bytes hash lowest, and equal windows choose the same one. The windows
of one sampled suffix are neighbours, a run. Pass 1 groups runs by the sampled suffix's first
bytes, pass 2 by all bytes of the run: equal runs are repeated windows altogether. What still shares
the first digit is parted by three more digits, of the bytes before and behind the sampled suffix that
the run's early, middle and late windows need; parts alone with their digit are left out, the
others are spread out into single windows, whose whole threshold bytes are the last digit.
A task groups its own runs before it sends one row per distinct run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steplake.llm.shared import bucket_count, bucket_of, group_bounds, packed, text_bytes, unpacked, written
from steplake.llm.words import BYTES, chunks, mix, ranges
from steplake.llm.words import running as running_sum
from steplake.operators.windows import running

_U = np.uint64
_LAST = (1 << 63) - 1  # stands for a NULL doc_id: after all others
_LOW = _U(0xFFFFFFFF)

CHUNK = 1 << 18  # bytes worked on at a time

_BLOBS = "kind tinyint, bucket int, head binary, body binary, doc binary, pos binary, more binary"
_BLOB_SCHEMA = pa.schema([("kind", pa.int8()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in ("head", "body", "doc", "pos", "more")])
# bytes of ``more``: windows of the run, place of the sampled suffix in it, digits of its three parts
_MORE = 5
_FOUND = "removed boolean, doc_id bigint, first int, last int"
_SENT, _REMOVED = 0, 1


def runs_of(raw: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same sampled suffix: its digit, the hash of all the run's bytes, first window, and ``more``."""
    head = depth // 4
    n = len(raw) - depth + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros((0, _MORE), np.uint8)
    sums = running_sum(raw, BYTES)
    at = np.arange(len(raw) - head + 1)
    digits = ranges(sums, at, at + head)
    low = (digits & ~_LOW) | at.astype(_U)  # equal digits: the one further left
    width, span = depth - head + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    crossing = np.zeros(n + 1, np.int64)  # windows that reach over a row's end
    inner = starts[1:-1]
    np.add.at(crossing, np.clip(inner - depth + 1, 0, n), 1)
    np.add.at(crossing, np.clip(inner, 0, n), -1)
    window = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
    chosen = (low[window] & _LOW).astype(np.int64)
    bounds = group_bounds(chosen)
    first, count, chosen = window[bounds[:-1]], np.diff(bounds), chosen[bounds[:-1]]
    # a window that starts d bytes before the sampled suffix needs d bytes on its left and the rest on its right
    left = [np.maximum(chosen - k * head, 0) for k in range(3)]
    right = [np.minimum(chosen + (k + 1) * head, len(raw)) for k in range(3)]
    parts = [(ranges(sums, left[k], right[2 - k]) >> _U(56)).astype(np.uint8) for k in range(3)]
    more = np.stack([count.astype(np.uint8), (chosen - first).astype(np.uint8), *parts], axis=1)
    # the chosen digits are the low ones, so they are spread out again
    return mix(digits[chosen]), ranges(sums, first, first + count - 1 + depth), first, more


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of documents (first byte, byte after the last), overlapping and touching ones joined."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    if not len(doc):
        return doc, first, last
    # a running maximum of the ends that starts anew with each document
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    step = int(last.max()) + 1
    reach = np.maximum.accumulate(last + number * step)
    new = np.concatenate([[True], (first + number * step)[1:] > reach[:-1]])
    cut = np.append(np.flatnonzero(new), len(doc))
    return doc[cut[:-1]], first[cut[:-1]], (reach - number * step)[cut[1:] - 1]


def _blobs(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    rows = packed(bucket, *columns)
    cols = list(zip(*rows)) if rows else [()] * (len(columns) + 1)
    return pa.record_batch([pa.array(np.full(len(rows), kind), pa.int8()), pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]],
                           schema=_BLOB_SCHEMA)


def _gathered(head, body, doc, pos, more, depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The earliest of a task's equal bodies go on; the others are removed here already."""
    order = np.lexsort((pos, doc, body))
    head, body, doc, pos, more = (x[order] for x in (head, body, doc, pos, more))
    earliest = np.zeros(len(body), bool)
    earliest[group_bounds(body)[:-1]] = True
    keep = np.flatnonzero(earliest)
    keep = keep[np.lexsort((pos[keep], doc[keep]))]
    low = head[keep].astype(np.uint32)
    yield _blobs(_SENT, bucket_of(head[keep], buckets), low, body[keep], doc[keep], pos[keep].astype(np.int32), more[keep])
    later = _not_first(earliest, body, doc, pos)
    d, first, last = merged(doc[later], pos[later], pos[later] + more[later, 0] - 1 + depth)
    where = bucket_of(d.astype(_U) * _U(0x9E3779B97F4A7C15), buckets)
    none = np.zeros((len(d), 0), np.uint8)
    yield _blobs(_REMOVED, where, none, last.astype(np.int32), d, first.astype(np.int32), none)


def _not_first(earliest: np.ndarray, body: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Entries behind their group's first; a repeat of the first's own place is the same suffix again."""
    first = np.flatnonzero(earliest)
    lead = first[np.cumsum(earliest) - 1] if len(first) else first
    return ~earliest & ((doc != doc[lead]) | (pos != pos[lead]))


def _collected(pieces: Iterator[tuple[np.ndarray, ...]], depth: int, buckets: int, flush: int = 250_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n > flush:
            yield from _gathered(*map(np.concatenate, zip(*held)), depth, buckets)
            held, n = [], 0
    if n:
        yield from _gathered(*map(np.concatenate, zip(*held)), depth, buckets)


def _runs(depth: int, buckets: int):
    def pieces(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for rows, raw, starts in chunks(batch.column("text"), CHUNK):
                head, body, first, more = runs_of(raw, starts, depth)
                row = np.searchsorted(starts, first, "right") - 1
                yield head, body, ids[rows.start + row], first - starts[row], more

    return lambda batches: _collected(pieces(batches), depth, buckets)


def _windows(depth: int, buckets: int):
    """Single windows of the runs asked for."""
    def pieces(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            asked = batch.column("asked")
            for rows, raw, starts in chunks(batch.column("text"), CHUNK):
                sums = running_sum(raw, BYTES)
                wanted = asked.slice(rows.start, len(rows))
                n = np.asarray(wanted.value_lengths().fill_null(0))
                flat = wanted.flatten()
                first, last = np.asarray(flat.field("first")).astype(np.int64), np.asarray(flat.field("last")).astype(np.int64)
                count = last - first
                row = np.repeat(np.repeat(np.arange(len(rows)), n), count)
                pos = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                body = ranges(sums, starts[row] + pos, starts[row] + pos + depth)
                yield body, body, ids[rows.start + row], pos, np.ones((len(pos), 1), np.uint8)

    return lambda batches: _collected(pieces(batches), depth, buckets)


def _grouped(depth: int, spread: bool):
    """Runs of a bucket: later ones of equal bodies are removed; the earliest ones stay open where the digit has several bodies."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        sent, gone = table.filter(pa.array(kind == _SENT)), table.filter(pa.array(kind == _REMOVED))
        take = lambda t, c, k: unpacked(t.column(c).combine_chunks(), k)
        head, body, doc, pos = (take(sent, c, k) for c, k in (("head", np.uint32), ("body", _U), ("doc", np.int64), ("pos", np.int32)))
        more = take(sent, "more", np.uint8).reshape(len(body), _MORE if spread else 1)
        order = np.lexsort((pos, doc, body, head))
        head, body, doc, pos, more = head[order], body[order], doc[order], pos[order].astype(np.int64), more[order].astype(np.int64)
        earliest = np.zeros(len(body), bool)
        earliest[group_bounds(head, body)[:-1]] = True
        later = _not_first(earliest, body, doc, pos)
        first = np.concatenate([take(gone, "pos", np.int32), pos[later]]).astype(np.int64)
        last = np.concatenate([take(gone, "body", np.int32), pos[later] + more[later, 0] - 1 + depth]).astype(np.int64)
        d, first, last = merged(np.concatenate([take(gone, "doc", np.int64), doc[later]]), first, last)
        if spread:
            lead = np.flatnonzero(earliest)
            o, o_first, o_last = _open(head[lead], doc[lead], pos[lead], more[lead], depth)
        else:
            o, o_first, o_last = (np.zeros(0, np.int64),) * 3
        return pa.table({"removed": pa.array(np.arange(len(d) + len(o)) < len(d)), "doc_id": np.concatenate([d, o]),
                         "first": pa.array(np.concatenate([first, o_first]), pa.int32()), "last": pa.array(np.concatenate([last, o_last]), pa.int32())})
    return run


def _open(head, doc, pos, more, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (document, first start, behind the last) whose part of a run shares its digits with another body."""
    shift, place = more[:, 0], more[:, 1]
    found = []
    for k in range(3):
        # a quarter of the depth before the sampled suffix belongs to part 0, the next to 1, the rest to 2
        low = np.zeros_like(place) if k == 2 else np.maximum(place - (k + 1) * (depth // 4) + 1, 0)
        high = np.minimum(place - k * (depth // 4) + 1, shift)
        has = np.flatnonzero(low < high)
        order = has[np.lexsort((more[has, 2 + k], head[has]))]
        bounds = group_bounds(head[order], more[order, 2 + k])
        shared = order[np.repeat(np.diff(bounds) > 1, np.diff(bounds))]
        found.append((doc[shared], pos[shared] + low[shared], pos[shared] + high[shared]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _rest(with_bytes: bool):
    """What is left of each text."""
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for text, cut in zip(part.column("text"), part.column("spans")):
                    data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                    kept, at, removed, n_spans = hashlib.sha256(), 0, 0, 0
                    pieces = []
                    spans = sorted((s["first"], s["last"]) for s in cut.as_py() or [])
                    for i, (first, last) in enumerate([*spans, (len(data), len(data))]):
                        if first <= at and i and i < len(spans):  # goes on from the span before
                            removed, at = removed + max(0, last - at), max(at, last)
                            continue
                        kept.update(data[at:first])
                        if with_bytes:
                            pieces.append(bytes(data[at:first]))
                        if i < len(spans):
                            removed, n_spans, at = removed + last - first, n_spans + 1, last
                    for c, v in zip(out, (len(data), removed, n_spans, kept.hexdigest(), b"".join(pieces) if with_bytes else None)):
                        out[c].append(v)
                yield pa.record_batch({"doc_id": part.column("doc_id")} | {c: pa.array(v, t) for (c, v), t in zip(
                    out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))})
    return run


def _numbered(texts: DataFrame) -> tuple[DataFrame, Column]:
    """Texts by a doc_id that is never NULL and names one text, and the column that gives back the one they came with.

    Where a doc_id does not do so, documents are numbered by doc_id, NULL last, and the hash of their text.
    """
    plain = texts.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text")
    marks = plain.select("doc_id", F.xxhash64("text").alias("mark")).groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b"))
    if marks.where("a <> b").isEmpty():
        return plain, F.nullif("doc_id", F.lit(_LAST))
    ids = texts.select("doc_id", F.xxhash64("text").alias("mark")).distinct()
    numbers = running(ids, [], ["doc_id", "mark"], row_number="number").select(F.col("doc_id").alias("came"), "mark", F.col("number").cast("bigint").alias("number"))
    numbers = written(numbers, "suffix-documents")
    joined = texts.withColumn("here", F.xxhash64("text")).join(numbers, F.col("doc_id").eqNullSafe(F.col("came")) & (F.col("here") == F.col("mark")))
    return joined.select(F.col("number").alias("doc_id"), "text", "came"), F.col("came")


def remove_repeats(documents: DataFrame, depth: int = 100, with_bytes: bool = False) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are UTF-8 bytes, NULL is empty. A byte goes if a string of ``depth`` bytes over it also starts earlier: in
    a document with a smaller doc_id, or further left in the same one; all texts are judged as they came, and
    strings never cross documents. Texts shorter than ``depth`` stay. A NULL doc_id counts as the largest.
    kept holds the bytes left, if asked for. Rows that repeat doc_id and text are one document and come as often
    as they are. Rows that repeat a doc_id, or have none, with different texts are different documents, in the order of their
    texts' hashes. Other columns are ignored; an empty table gives no rows.
    """
    if not 8 <= depth <= 255:
        raise ValueError("depth is a byte's worth of windows, 8 to 255")
    spark = documents.sparkSession
    texts, named = _numbered(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    buckets = bucket_count(spark, text_bytes(texts))
    found = texts.mapInArrow(_runs(depth, buckets), _BLOBS).groupBy("bucket").applyInArrow(_grouped(depth, True), _FOUND)
    found = written(found, "suffix-runs", "removed")
    asked = found.where("not removed").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    # both joins read one exchange of the texts by doc_id
    single = (texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_windows(depth, buckets), _BLOBS)
              .groupBy("bucket").applyInArrow(_grouped(depth, False), _FOUND))
    spans = (found.where("removed").unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    joined = texts.join(spans, "doc_id", "left").select(named.alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_rest(with_bytes), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
