"""Periodic runs of words, found on a grammar of each text.

A text's word numbers are compressed by Re-Pair: the most frequent pair of neighbours becomes a nonterminal, until no
pair occurs twice. A run lies across the boundary of the smallest nonterminal (or of the start rule's
symbols) that derives all of it, so the runs that cross a rule's boundary are computed once, at its first place, copied to
all places where the rule derives text, and pieces with the same period are merged into maximal runs.

All texts of a chunk are compressed at once. In a round, each pair that outranks every pair it overlaps is
replaced: what is replaced elsewhere before cannot touch it, so taking one pair after the other would do the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplake.llm.shared import group_bounds
from steplake.llm.words import BYTES, NOT_SPACE, _power, chunks, mix, ranges, running, running_sums, word_bounds

_U = np.uint64
_LEFT, _RIGHT, _ROW = _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
SPOTS = 2_000_000  # candidate periods looked at together

RUNS = "array<struct<start:int,length:int,period:int>>"


def repeated(keys: np.ndarray) -> np.ndarray:
    """Places of keys that may occur more than once: all that do, and few others."""
    bits = max(10, int(len(keys)).bit_length() + 3)
    cell = (keys >> _U(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(cell, minlength=1)[cell] > 1) if len(keys) else np.zeros(0, np.int64)


class Grammar:
    """Re-Pair of rows of 64-bit words. A rule is known by its places: ``rule`` numbers them, ``place`` is where
    they begin, ``cut`` and ``size`` are the rule's boundary and length in words. ``left`` marks the start rules' symbols."""

    def __init__(self, words: np.ndarray, row: np.ndarray):
        n = len(words)
        symbol = np.append(words, _U(0))
        size = np.ones(n + 1, np.int64)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        edge = np.flatnonzero(row[1:] != row[:-1])
        after[edge], before[edge + 1] = n, n  # n stands for no symbol
        if n:
            after[n - 1:], before[0] = n, n
        gone = np.zeros(n + 1, bool)
        gone[n] = True
        priority = np.zeros(n + 1, np.int64)
        live = np.flatnonzero(after[:n] < n)
        rules, places, cuts, sizes, count = [], [], [], [], 0
        while len(live):
            keys = mix(symbol[live] * _LEFT + symbol[after[live]] * _RIGHT + row[live].astype(_U) * _ROW)
            near = repeated(keys)
            live, keys = live[near], keys[near]
            order = np.argsort(keys, kind="stable")
            at, keys = live[order], keys[order]
            bounds = group_bounds(keys)
            length = np.diff(bounds)
            group = np.repeat(np.arange(len(length)), length)
            # of a word that stands three times in a row, every other pair counts
            chained = np.zeros(len(at), bool)
            chained[1:] = (after[at[:-1]] == at[1:]) & (group[1:] == group[:-1])
            index = np.arange(len(at))
            odd = (index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 1 if len(at) else chained
            pairs = length - np.bincount(group[odd], minlength=len(length))
            if not (pairs > 1).any():
                break
            rank = np.empty(len(pairs), np.int64)
            rank[np.lexsort((keys[bounds[:-1]], pairs))] = np.arange(1, len(pairs) + 1)
            rank[pairs < 2] = 0
            mine = rank[group]
            priority[at] = mine
            beaten = (mine < priority[before[at]]) | (mine < priority[after[at]])
            priority[at] = 0
            win = (pairs > 1) & (np.bincount(group[beaten], minlength=len(pairs)) == 0)
            taken = win[group] & ~odd
            first = at[taken]
            second = after[first]
            behind = after[second]
            number = (np.cumsum(win) - 1)[group[taken]]
            rules.append(count + number)
            places.append(first)
            cuts.append(size[first])
            size[first] += size[second]
            sizes.append(size[first])
            count += int(win.sum())
            symbol[first] = keys[taken]
            after[first], before[behind] = behind, first
            gone[second] = True
            stays = at[(mine > 0) & ~win[group]]
            live = np.concatenate([stays, first, before[first]])
            live = live[~gone[live]]
            live = np.unique(live[after[live] < n])
        empty = [np.zeros(0, np.int64)]
        self.rule, self.place, self.cut, self.size = (np.concatenate(x or empty) for x in (rules, places, cuts, sizes))
        order = np.lexsort((self.place, self.rule))
        self.rule, self.place, self.cut, self.size = (x[order] for x in (self.rule, self.place, self.cut, self.size))
        self.left = ~gone[:n]


def _agree(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words, at most ``most``, agree from a and b on, or before a and b."""
    low, high = np.zeros(len(a), np.int64), np.maximum(most, 0)
    down = _power("down", len(sums))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        half = (low[open_] + high[open_] + 1) // 2
        x, y = (a[open_] - half, b[open_] - half) if back else (a[open_], b[open_])
        same = (sums[x + half] - sums[x]) * down[x] == (sums[y + half] - sums[y]) * down[y]
        low[open_] = np.where(same, half, low[open_])
        high[open_] = np.where(same, high[open_], half - 1)


def _crossing(words: np.ndarray, row: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray,
              shortest: int, repeats: int) -> tuple[np.ndarray, ...]:
    """(boundary's number, start, end, period) of runs within [low, high) that lie across or next to a boundary.

    At least half of a run lies on one side of the boundary, so the words at the boundary come again a period
    further on that side, as many as half a run has beyond its period. These are looked up by their hashes,
    periods from a power of two to the next at a time.
    """
    n = len(words)
    sums = running_sums(words)
    row_end = np.searchsorted(row, row, "right")
    gram = max(1, shortest * (repeats - 2) // (2 * repeats))
    near, far, size = 1, max(2, 4 * gram // (repeats - 2)), gram
    left = np.arange(n)
    longest = int((high - low).max(initial=0)) // repeats
    found = []
    known = np.zeros((3, len(cut)), np.int64)  # start, end and period of a boundary's first run
    while near <= longest:
        left = left[left + size <= row_end[left]]
        keys = mix(ranges(sums, left, left + size) + row[left].astype(_U) * _ROW)
        again = repeated(keys)
        left, keys = left[again], keys[again]
        order = np.argsort(keys, kind="stable")
        bounds = group_bounds(keys[order])
        wide = np.diff(bounds) > 1
        group = np.repeat(np.arange(len(wide)), np.diff(bounds))
        order, group = order[wide[group]], group[wide[group]]
        if not len(order):
            break
        spot = group * (n + 1) + left[order]  # ascending
        number = np.full(n + 1, -1)
        number[left[order]] = group
        for right in (True, False):
            base = cut if right else cut - size
            ok = np.flatnonzero((base >= low) & (base + size <= high) & (number[np.clip(base, 0, n)] >= 0))
            b, g = base[ok], number[base[ok]]
            if right:
                first = np.searchsorted(spot, g * (n + 1) + b + near)
                last = np.searchsorted(spot, g * (n + 1) + np.minimum(b + far, high[ok] - size + 1))
            else:
                first = np.searchsorted(spot, g * (n + 1) + np.maximum(b - far + 1, low[ok]))
                last = np.searchsorted(spot, g * (n + 1) + np.maximum(b - near + 1, low[ok]))
            many = np.maximum(last - first, 0)
            ok, first, b, many = (x[many > 0] for x in (ok, first, b, many))
            ends = np.cumsum(many)
            at = 0
            while at < len(ok):  # a slice of the boundaries
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPOTS, "right")))
                part = slice(at, to)
                of = np.repeat(np.arange(at, to), many[part])
                step = np.arange(len(of)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
                other = spot[first[of] + step] % (n + 1)
                who, x, y = ok[of], np.minimum(other, b[of]), np.maximum(other, b[of])
                # inside a run already found, further multiples of its period tell nothing new
                start, end, period = known[:, who]
                news = np.flatnonzero((period == 0) | (x < start) | (y + size > end) | ((y - x) % np.maximum(period, 1) != 0))
                who, x, y = who[news], x[news], y[news]
                ahead = _agree(sums, x, y, high[who] - y, False)
                start = x - _agree(sums, x, y, x - low[who], True)
                end, period = y + ahead, y - x
                good = np.flatnonzero(end - start >= np.maximum(shortest, repeats * period))
                who, start, end, period = who[good], start[good], end[good], period[good]
                found.append((who, start, end, period))
                order_ = np.lexsort((-period, known[2, who] == 0))  # the smallest period is written last
                fresh = order_[known[2, who[order_]] == 0]
                known[:, who[fresh]] = start[fresh], end[fresh], period[fresh]
                at = to
        near, size = far, max(size, (repeats - 2) * far // 2)
        far *= 2
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def runs_of(words: np.ndarray, row: np.ndarray, shortest: int, repeats: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, period) of all runs, by row, start and period; starts are numbers of words."""
    none = (np.zeros(0, np.int64),) * 4
    if len(words) < shortest:
        return none
    grammar = Grammar(words, row)
    lead = group_bounds(grammar.rule)[:-1]
    lead = lead[grammar.size[lead] >= shortest]
    begin = np.searchsorted(row, row, "left")
    finish = np.searchsorted(row, row, "right")
    symbol = np.flatnonzero(grammar.left)
    symbol = symbol[(symbol > begin[symbol]) & (finish[symbol] - begin[symbol] >= shortest)]
    cut = np.concatenate([grammar.place[lead] + grammar.cut[lead], symbol])
    low = np.concatenate([grammar.place[lead], begin[symbol]])
    high = np.concatenate([grammar.place[lead] + grammar.size[lead], finish[symbol]])
    who, start, end, period = _crossing(words, row, cut, low, high, shortest, repeats)
    if not len(who):
        return none
    # a rule's runs at all its places
    ruled = who < len(lead)
    bounds = group_bounds(grammar.rule)
    of = np.searchsorted(bounds, lead)[who[ruled]]
    many = np.diff(bounds)[of]
    at = np.repeat(bounds[of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    shift = grammar.place[at] - np.repeat(low[who[ruled]], many)
    start = np.concatenate([start[~ruled], np.repeat(start[ruled], many) + shift])
    end = np.concatenate([end[~ruled], np.repeat(end[ruled], many) + shift])
    period = np.concatenate([period[~ruled], np.repeat(period[ruled], many)])
    return _merged(row[start], start, end, period)


def _merged(row, start, end, period) -> tuple[np.ndarray, ...]:
    """Pieces of the same period that share a period's length are one run; of equal stretches the smallest period stays."""
    order = np.lexsort((start, period, row))
    row, start, end, period = row[order], start[order], end[order], period[order]
    number = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (period[1:] != period[:-1])]))
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * step)
    new = np.concatenate([[True], (start + number * step)[1:] > reach[:-1] - period[1:]])
    new[1:] |= number[1:] != number[:-1]
    cut = np.append(np.flatnonzero(new), len(row))
    row, start, end, period = row[cut[:-1]], start[cut[:-1]], (reach - number * step)[cut[1:] - 1], period[cut[:-1]]
    order = np.lexsort((period, end, start, row))
    row, start, end, period = row[order], start[order], end[order], period[order]
    lead = group_bounds(row, start, end)[:-1]
    row, start, end, period = row[lead], start[lead], end[lead], period[lead]
    order = np.lexsort((period, start, row))
    return row[order], start[order], end[order], period[order]


def _found(shortest: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, starts in chunks(batch.column("text")):
                begin, end, row = word_bounds(raw, starts, NOT_SPACE)
                words = ranges(running(raw, BYTES), begin, end)
                first = np.searchsorted(row, np.arange(len(rows) + 1))
                of, start, stop, period = runs_of(words, row, shortest, repeats)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, stop, -1)
                keep = np.cumsum(edge[:-1]) == 0
                offsets = np.searchsorted(of, np.arange(len(rows) + 1))
                rest = []
                for r in range(len(rows)):
                    text = raw[starts[r]:starts[r + 1]].tobytes().split()
                    if offsets[r] < offsets[r + 1]:
                        text = compress(text, keep[first[r]:first[r + 1]])
                    rest.append(b" ".join(text))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (start - first[of], stop - start, period)], ["start", "length", "period"])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(rows.start, len(rows)), "n_words": pa.array(np.diff(first), pa.int64()),
                                       "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
                                       "collapsed": pa.array(rest, pa.binary()).cast(pa.string())})
    return run


def find_runs(documents: DataFrame, shortest: int = 24, repeats: int = 3) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_words, runs, collapsed.

    A run is a stretch of words with smallest period p, at least ``shortest`` words and ``repeats`` periods long, that no
    neighbouring word extends with that period; start counts words from 0, runs are ordered by start and period.
    collapsed holds the words left, joined by one blank, when of each run only the first period stays. Words are runs of bytes other than
    blanks, compared by 64-bit hashes. A NULL, empty or blank text has no words and no runs, and '' is left of it; every row is judged
    alone, so repeated rows and NULL ids change nothing. One task holds a whole text, however long. Other columns are ignored; an empty table gives no rows.
    """
    if repeats < 3:
        raise ValueError("a run has three periods at least")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_found(shortest, repeats), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")
