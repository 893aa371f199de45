"""Language identification: script ranges narrow the candidates, and the best path over per-word scores,
with a penalty for each switch, labels the spans of mixed-language texts.

A word's score in a language is the log-probability of its letter trigrams and of the word itself,
counted over the words of labelled texts. A word of a script that only some languages use can
only belong to those.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplake.llm.shared import group_bounds
from steplake.llm.words import chunks, mix

GRAM_BITS, WORD_BITS = 16, 18  # of the hashed counts
SAMPLE_ROWS = 20_000  # labelled texts the counts are taken from at most
MAX_LANGUAGES = 500
SWITCH = 12.0  # log-probability a change of language has to win
USED = 0.001  # share of a language's letters from which on it uses a script
FOREIGN = -30.0  # score of a word in a language that does not use its script
PATH_CELLS = 1_000_000  # words times languages on the best path at a time
CHUNK = 1 << 18  # bytes of texts whose letters are scored at a time
_U = np.uint64

# Scripts by ranges of code points.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS})
OTHER = len(SCRIPT_NAMES) + 1  # letters outside the ranges


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: the script's number (0: no letter) and the code point in lower case."""
    points = range(0x110000)
    letter = np.array([0xD800 > p and chr(p).isalpha() or p > 0xDFFF and chr(p).isalpha() for p in points])
    script = np.where(letter, OTHER, 0).astype(np.int8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = np.where(letter[first:last + 1], SCRIPT_NAMES.index(name) + 1, 0)
    lower = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(letter).tolist():
        small = chr(p).lower()
        if len(small) == 1:
            lower[p] = ord(small)
    return script, lower


def words_of(raw: np.ndarray, starts: np.ndarray):
    """Code points of the rows, and of every word (a run of letters of one script): begin, end, row and script."""
    script_of, lower = _tables()
    text = raw.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = (raw & 0xC0) != 0x80
    begins = np.append(0, np.cumsum(lead))[starts]  # rows in code points
    script = script_of[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[begins] = True
    edge[1:-1] |= script[1:] != script[:-1]
    cut = np.flatnonzero(edge[:-1])
    ends = np.append(cut[1:], len(points))
    use = script[cut] > 0 if len(points) else np.zeros(0, bool)
    begin, end = cut[use], ends[use]
    return lower[points], begin, end, np.searchsorted(begins, begin, "right") - 1, script[begin], begins


def _features(points, begin, end):
    """Numbers of the trigrams (one per letter, word edges as blanks), the word each belongs to, and the words' numbers."""
    length = end - begin
    word = np.repeat(np.arange(len(begin)), length)
    at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
    here = points[at].astype(_U)
    before = np.where(at == begin[word], 32, points[np.maximum(at - 1, 0)]).astype(_U)
    after = np.where(at + 1 == end[word], 32, points[np.minimum(at + 1, max(len(points) - 1, 0))]).astype(_U)
    gram = mix(before * _U(0x1000003D) + here * _U(0x2000000011) + (after << _U(42)))
    place = (at - begin[word]).astype(_U)
    total = np.zeros(len(begin), _U)
    if len(at):
        total = np.add.reduceat(mix(here * _U(0x9E3779B1) + (place << _U(32))), np.cumsum(length) - length)
    return (gram >> _U(64 - GRAM_BITS)).astype(np.int64), word, (mix(total) >> _U(64 - WORD_BITS)).astype(np.int64)


_SIZES = (1 << GRAM_BITS, 1 << WORD_BITS, OTHER + 1)
_OFFSETS = np.cumsum((0, *_SIZES))


def _counted(batches):
    """Per language the counts of trigrams, words and scripts, as numbers with counts."""
    for batch in batches:
        lang = np.asarray(pc.index_in(batch.column("lang"), names := pc.unique(batch.column("lang"))))
        for rows, raw, starts in chunks(batch.column("text"), CHUNK):
            points, begin, end, row, script, _ = words_of(raw, starts)
            gram, word, whole = _features(points, begin, end)
            of = lang[rows.start + row]
            for i in np.unique(of):
                mine = of == i
                number = np.concatenate([gram[mine[word]], _OFFSETS[1] + whole[mine], _OFFSETS[2] + script[mine]])
                used, count = np.unique(number, return_counts=True)
                yield pa.record_batch({"lang": pa.array([names[int(i)].as_py()]), "numbers": pa.array([used.astype(np.int32).tobytes()], pa.binary()),
                                       "counts": pa.array([count.astype(np.int64).tobytes()], pa.binary())})


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(_OFFSETS[-1], np.int64)
    for n, c in zip(table.column("numbers"), table.column("counts")):
        total[np.frombuffer(n.as_buffer(), np.int32)] += np.frombuffer(c.as_buffer(), np.int64)
    used = np.flatnonzero(total)
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "numbers": pa.array([used.astype(np.int32).tobytes()], pa.binary()),
                     "counts": pa.array([total[used].tobytes()], pa.binary())})


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        parts = [counts[:, _OFFSETS[i]:_OFFSETS[i + 1]].astype(float) for i in range(3)]
        self.gram, self.word = (self._log(p) for p in parts[:2])
        self.uses = parts[2] >= np.maximum(USED * parts[2].sum(axis=1, keepdims=True), 1)

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        """Log-probabilities against their mean over the languages; 0 for what no text has."""
        seen = counts.sum(axis=0) > 0
        log = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * max(1, seen.sum())))
        return np.where(seen, log - log.mean(axis=0), 0).T.astype(np.float32)

    def word_scores(self, points, begin, end, script) -> np.ndarray:
        gram, word, whole = _features(points, begin, end)
        scores = self.word[whole].copy()
        if len(word):
            scores += np.add.reduceat(self.gram[gram], np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])), axis=0)
        known = self.uses.any(axis=0)
        out = known[script][:, None] & ~self.uses.T[script]
        return scores + np.where(out, np.float32(FOREIGN), np.float32(0))


def learn(documents: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Counts over at most ``rows`` of documents(doc_id, text, lang), those whose doc_id hashes lowest; rows without text or lang don't count."""
    usable = documents.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    mark = F.xxhash64("doc_id")
    n = usable.count()
    if n > rows:
        # hashes are even, so this cuts close below the bound; the limit only guards it
        usable = usable.where(mark < F.lit(int(-(1 << 63) + (1 << 64) * (0.97 * rows / n)))).limit(rows)
    totals = usable.mapInArrow(_counted, "lang string, numbers binary, counts binary").groupBy("lang").applyInArrow(
        _summed, "lang string, numbers binary, counts binary").limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    totals.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(totals), _OFFSETS[-1]))
    for i, r in enumerate(totals):
        counts[i, np.frombuffer(bytes(r["numbers"]), np.int32)] = np.frombuffer(bytes(r["counts"]), np.int64)
    return Model([r["lang"] for r in totals], counts)


def best_path(scores: np.ndarray, row: np.ndarray, n_rows: int, switch: float = SWITCH) -> np.ndarray:
    """The language of every word: the path of highest score, less ``switch`` for each change, row by row.

    All rows take a step at once; words are laid out by their place in the row, longest rows first.
    """
    length = np.bincount(row, minlength=n_rows)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(n_rows, np.int64)
    rank[order] = np.arange(n_rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    active = np.bincount(place) if len(place) else np.zeros(0, np.int64)
    base = np.cumsum(active) - active
    spot = base[place] + rank[row]
    laid = np.empty_like(scores)
    laid[spot] = scores
    came = np.empty(scores.shape, bool)  # whether a word's language follows from a change
    best = np.zeros(len(row), np.int16)  # the language before, if it does
    labels = np.zeros(len(row), np.int16)
    state = np.zeros((n_rows, scores.shape[1]), np.float32)
    for t, n in enumerate(active):
        now = state[:n]
        at = slice(base[t], base[t] + n)
        best[at] = now.argmax(axis=1)
        now -= now.max(axis=1, keepdims=True)
        came[at] = now < -switch
        np.maximum(now, -switch, out=now)
        now += laid[at]
    follow = state.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = slice(base[t], base[t] + n)
        labels[at] = follow[:n]
        change = came[at][np.arange(n), follow[:n]]
        follow[:n] = np.where(change, best[at], follow[:n])
    return labels[spot]


SPANS = "array<struct<first:int,last:int,lang:string>>"


def _identified(model: Model, with_spans: bool = True):
    languages = np.array(model.languages, object)
    kinds = len(languages)

    def emit(held, ids):
        scores, row, begin, end, letters = (np.concatenate(x) for x in zip(*held))
        n = len(ids)
        if kinds:
            label = best_path(scores, row, n)
        else:
            label, row, begin, end, letters = (x[:0] for x in (row, row, begin, end, letters))
        share = np.bincount(row * max(kinds, 1) + label, weights=letters, minlength=n * max(kinds, 1)).reshape(n, -1)
        total = share.sum(axis=1)
        top = share.argmax(axis=1)
        named = {"doc_id": ids, "lang_pred": pa.array([languages[t] if s > 0 else "und" for t, s in zip(top, total)], pa.string()),
                 "score": pa.array(np.where(total > 0, share[np.arange(n), top] / np.maximum(total, 1), 0.0))}
        if not with_spans:
            return pa.record_batch(named)
        cut = group_bounds(row, label)
        of = row[cut[:-1]]
        spans = pa.StructArray.from_arrays([pa.array(begin[cut[:-1]], pa.int32()), pa.array(end[cut[1:] - 1], pa.int32()),
                                            pa.array(languages[label[cut[:-1]]] if kinds else [], pa.string())], ["first", "last", "lang"])
        offsets = np.searchsorted(of, np.arange(n + 1))
        return pa.record_batch(named | {"spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)})

    def run(batches):
        for batch in batches:
            held, first, cells, done = [], 0, 0, 0
            for rows, raw, starts in chunks(batch.column("text"), CHUNK):
                points, begin, end, row, script, begins = words_of(raw, starts)
                scores = model.word_scores(points, begin, end, script) if kinds else np.zeros((len(row), 0), np.float32)
                held.append((scores, row + rows.start - first, *(x.astype(np.int32) for x in (begin - begins[row], end - begins[row], end - begin))))
                cells, done = cells + scores.size, rows.stop
                if cells > PATH_CELLS:
                    yield emit(held, batch.column("doc_id").slice(first, done - first))
                    held, first, cells = [], done, 0
            if held:
                yield emit(held, batch.column("doc_id").slice(first, done - first))
            pa.default_memory_pool().release_unused()  # a worker keeps what it does not give back
    return run


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, lang_pred, score, spans.

    spans are stretches of one language, in code points, first letter to behind the last; lang_pred is the language with most
    letters (the first in order among equals) and score its share of the letters. A text that is
    NULL or has no letters, and every text if no language was learned, is 'und' with score 0.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_identified(model), f"doc_id bigint, lang_pred string, score double, spans {SPANS}")


def keep_identified(documents: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of documents whose language is known with a score of at least ``least``; all columns stay, whatever their names."""
    columns = documents.columns
    at = columns.index("text")
    label = _identified(model, with_spans=False)

    def run(batches):
        for batch in batches:
            asked = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], names=["doc_id", "text"])
            keep = [pa.array([x != "und" and s >= least for x, s in zip(out.column("lang_pred").to_pylist(), out.column("score").to_pylist())], pa.bool_())
                    for out in label([asked])]
            if keep:
                yield batch.filter(pa.concat_arrays(keep))

    placed = documents.toDF(*[f"c{i}" for i in range(len(columns))])
    return placed.mapInArrow(run, placed.schema).toDF(*columns)
