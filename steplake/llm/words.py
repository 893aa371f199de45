"""Words, windows and their 64-bit hashes for whole batches of texts, as numpy arrays.

A hash of a byte range is a polynomial of its bytes modulo 2**64 with a random value per
byte, finished by a mixing step, so hashes of all ranges of a batch come from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts are worked through about so many bytes at a time

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # 5 modulo 8: powers of different exponents differ in their low bits
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    out = values ^ (values >> _U(33))
    out *= _U(0xFF51AFD7ED558CCD)
    out ^= out >> _U(33)
    out *= _U(0xC4CEB9FE1A85EC53)
    out ^= out >> _U(33)
    return out


def _table(fold: bool) -> np.ndarray:
    codes = np.arange(256)
    if fold:
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return mix((codes + 1).astype(_U) * _BASE)


BYTES = _table(False)
FOLDED = _table(True)  # A-Z count as a-z

_codes = np.arange(256)
NOT_SPACE = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factors = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, _U)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=_U)
    return _powers[kind][:n]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Consecutive rows with about ``limit`` bytes of UTF-8 (NULL is empty; one row at least):
    the rows' numbers, their bytes, and where each row starts, with the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(starts, starts[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield range(first, last), raw[starts[first]:starts[last]], starts[first:last + 1] - starts[first]
        first = last


def running(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Running sums from which ``ranges`` takes hashes."""
    return running_sums(table[raw])


def running_sums(values: np.ndarray) -> np.ndarray:
    """The same over any 64-bit values, such as words' hashes."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _power("up", len(values)), out=sums[1:])
    return sums


def ranges(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges from ``begin`` to before ``end``."""
    down = _power("down", len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_bounds(raw: np.ndarray, starts: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every longest run of member bytes; runs never cross rows."""
    inside = member[raw]
    first, last = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    first[starts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    last[starts] = True  # a run ends before the start of the next row
    end = inside.copy()
    end[:-1] &= ~inside[1:] | last[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, member: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    begin, end, row = word_bounds(raw, starts, member)
    return ranges(running(raw, FOLDED if fold else BYTES), begin, end), row
