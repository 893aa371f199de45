"""Removal of repeated word windows, by windows of doubling length.

Every text's windows of a few words are counted over the whole corpus. A window of twice the length can only
repeat if both of its halves do, so each level looks at those windows alone, until the asked length
is reached; where none is left the later levels have nothing to do.

Texts are dealt to parts of bounded size. A part sends each distinct window once, packed by ranges of hashes, so a passage that stands in every text reaches its
range once a part. What comes back is one bit for each window sent, and the part's own list of candidates; all levels read one
exchange of the texts. Lower levels send 32 bits of a hash beside its range, which may let too many windows pass; the last sends all 64.
"""

from __future__ import annotations

from itertools import compress
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplake.llm.shared import bucket_of, group_bounds, packed, text_bytes
from steplake.llm.words import BYTES, NOT_SPACE, chunks, ranges, running, running_sums, word_bounds

_U = np.uint64

LEAST_PART, MOST_PART, BLOB = 4 << 20, 128 << 20, 4096  # bytes of a part: packed windows of one part and range fill a blob

_SENT = "bucket int, part int, data binary"
_SPANS = "array<struct<first:int,last:int>>"


def lengths_to(window: int, doublings: int) -> list[int]:
    """Window lengths, each at most twice the one before, up to ``window``."""
    out = [window]
    while len(out) <= doublings and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


class _Part:
    """Words of a part's texts, in an order that does not depend on how they arrived."""

    def __init__(self, table: pa.Table):
        table = table.take(pa.array(np.argsort(np.asarray(table.column("mark")), kind="stable")))
        self.ids = table.column("doc_id").combine_chunks()
        self.texts = table.column("text").combine_chunks()
        hashes, row = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for rows, raw, starts in chunks(self.texts):
            begin, end, of = word_bounds(raw, starts, NOT_SPACE)
            hashes.append(ranges(running(raw, BYTES), begin, end))
            row.append(of + rows.start)
        words, row = np.concatenate(hashes), np.concatenate(row)
        self.sums, self.n = running_sums(words), len(words)
        self.bounds = np.searchsorted(row, np.arange(len(self.ids) + 1))
        self.stop = np.repeat(self.bounds[1:], np.diff(self.bounds))  # behind the last word of a word's text

    def whole(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those of the windows that lie within one text."""
        return at[at + length <= self.stop[at]]

    def windows(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of windows in order, each window's place among them, and how often each occurs."""
        return np.unique(ranges(self.sums, at, at + length), return_inverse=True, return_counts=True)

    def surviving(self, at: np.ndarray, length: int, data: dict[int, bytes], buckets: int) -> np.ndarray:
        """The windows that occur again: in this part, or by the bits that came back for each range."""
        hashes, which, count = self.windows(at, length)
        again = count > 1
        bucket = bucket_of(hashes, buckets)
        bounds = group_bounds(bucket)
        for first, last in zip(bounds, bounds[1:]):
            again[first:last] |= np.unpackbits(np.frombuffer(data[int(bucket[first])], np.uint8), count=last - first).astype(bool)
        return at[again[which]]

    def sent(self, number: int, at: np.ndarray, length: int, buckets: int, exact: bool) -> list[tuple[int, int, bytes]]:
        hashes = self.windows(at, length)[0]
        entries = hashes if exact else hashes.astype(np.uint32)
        return [(b, number, blob) for b, blob in packed(bucket_of(hashes, buckets), entries)]


def _received(returns: pa.Table | None) -> tuple[dict[int, bytes], bytes | None]:
    data, mask = {}, None
    if returns is not None:
        for bucket, blob in zip(returns.column("bucket").to_pylist(), returns.column("data").to_pylist()):
            if bucket < 0:
                mask = blob
            else:
                data[bucket] = blob
    return data, mask


def _survivors(part: _Part, level: int, lengths: list[int], returns: pa.Table, buckets: int) -> np.ndarray:
    """Windows of a level that occur again. The candidates of the first level are all windows."""
    data, mask = _received(returns)
    if level == 0:
        at = part.whole(np.arange(part.n), lengths[0])
    else:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(mask or b"", np.uint8), count=part.n)) if mask else np.zeros(0, np.int64)
    return part.surviving(at, lengths[level], data, buckets)


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, number, data = zip(*rows) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "part": pa.array(number, pa.int32()), "data": pa.array(data, pa.binary())})


def _first(lengths: list[int], buckets: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        part = _Part(texts)
        return _table(part.sent(key[0].as_py(), part.whole(np.arange(part.n), lengths[0]), lengths[0], buckets, len(lengths) == 1))
    return run


def _next(level: int, lengths: list[int], buckets: int):
    """Windows of this level whose halves both survived the level before."""
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, returns: pa.Table) -> pa.Table:
        part, number, length = _Part(texts), key[0].as_py(), lengths[level]
        lives = np.zeros(part.n + length, bool)
        at = _survivors(part, level - 1, lengths, returns, buckets)
        lives[at] = True
        at = part.whole(at[lives[at + length - lengths[level - 1]]], length)
        if not len(at):
            return _table([])
        mask = np.zeros(part.n, bool)
        mask[at] = True
        return _table([(-1 - number, number, np.packbits(mask).tobytes()), *part.sent(number, at, length, buckets, level == len(lengths) - 1)])
    return run


def _counted(exact: bool):
    """For every blob of a range one bit an entry: whether another part sent the same."""
    kind = _U if exact else np.uint32

    def run(key: tuple[pa.Scalar, ...], blobs: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return blobs
        parts = [np.frombuffer(x.as_buffer(), kind) for x in blobs.column("data")]
        entries = np.concatenate(parts)
        ordered = np.sort(entries)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        again = np.zeros(len(entries), bool)
        if len(twice):
            near = np.minimum(np.searchsorted(twice, entries), len(twice) - 1)
            again = twice[near] == entries
        ends = np.cumsum([len(p) for p in parts])
        data = [np.packbits(x).tobytes() for x in np.split(again, ends[:-1])]
        return blobs.set_column(blobs.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))
    return run


def _rest(lengths: list[int], buckets: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, returns: pa.Table) -> pa.Table:
        part, window = _Part(texts), lengths[-1]
        at = _survivors(part, len(lengths) - 1, lengths, returns, buckets)
        edge = np.zeros(part.n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept, spans, removed = [], [], []
        for i, (text, first, last) in enumerate(zip(part.texts, part.bounds, part.bounds[1:])):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            cut = gone[first:last]
            removed.append(int(cut.sum()))
            if removed[-1]:
                words = compress(words, ~cut)
                step = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                spans.append([{"first": a, "last": b} for a, b in step.reshape(-1, 2).tolist()])
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table({"doc_id": part.ids, "n_words": pa.array(np.diff(part.bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})
    return run


def remove_repeated_windows(documents: DataFrame, window: int = 35, doublings: int = 2) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_words, n_removed, spans, kept.

    A word goes if a window of ``window`` words over it also starts anywhere else, in the same text or another; all are judged as they came.
    spans holds the stretches of removed words (first word from 0, word behind the last), kept the other words joined by one blank.
    Words are runs of bytes other than blanks. Every row is a text of its own: rows that repeat doc_id and text are copies of each
    other, and a NULL doc_id stays NULL. A NULL, empty or blank text has no words. A part holds whole texts, so a very long one is a
    part of its own. Other columns are ignored; an empty table gives no rows. Windows are compared by 64-bit hashes.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text_bytes(texts)
    part_bytes = min(MOST_PART, max(LEAST_PART, isqrt(size * BLOB)))
    parts = size // part_bytes + 1
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // part_bytes + 1)
    lengths = lengths_to(window, doublings)
    # equal rows of one input split meet in a part, others are spread
    mark = F.xxhash64("doc_id", "text")
    texts = texts.withColumn("mark", mark).withColumn("part", F.pmod(F.xxhash64(F.col("mark"), F.spark_partition_id()), F.lit(parts)).cast("int"))
    by_part = texts.groupBy("part")
    sent = by_part.applyInArrow(_first(lengths, buckets), _SENT)
    for level in range(len(lengths)):
        returns = sent.groupBy("bucket").applyInArrow(_counted(level == len(lengths) - 1), _SENT).groupBy("part")
        if level + 1 < len(lengths):
            sent = by_part.cogroup(returns).applyInArrow(_next(level + 1, lengths, buckets), _SENT)
    return by_part.cogroup(returns).applyInArrow(_rest(lengths, buckets), f"doc_id bigint, n_words bigint, n_removed bigint, spans {_SPANS}, kept string")
