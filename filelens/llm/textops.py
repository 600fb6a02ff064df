"""Vectorised word, line and n-gram hashing over Arrow string batches.

All functions work on the bytes of many texts at once. Words are maximal runs
of anything but the six ASCII white-space characters (``[^\\x20\\x09-\\x0D]+``);
bytes of multi-byte characters are never white space, so bytes suffice.

Hashes are 64-bit: a table of random words per byte, a polynomial over the
span (prefix sums, so any span costs O(1)) and a final bit mix. Texts are
handled in slices of :data:`SLICE_BYTES`; one longer text is one slice, and
its per-byte work runs in chunks of whole spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective bit mix)."""
    x = np.array(x, dtype=_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n (kept for the usual slice size)."""
    size = max(SLICE_BYTES, n)
    if size not in _powers:
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        tables = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        if size > SLICE_BYTES:
            return tables
        _powers[size] = tables
    return _powers[size]


def text_slices(col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive slices of a
    string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1 + col.offset)[col.offset:]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


def spans_of(kept: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``kept`` bytes inside one text."""
    n = len(kept)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = kept.copy()
    first[1:] &= ~kept[:-1] | cut[1:n]
    last = kept.copy()
    last[:-1] &= ~kept[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans_of(~_SPACE[buf], offs)


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the \\n-split lines of every text (empty texts have one)."""
    breaks = np.flatnonzero(buf == 0x0A)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    return starts, ends


def rows_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the text that each non-empty span lies in."""
    return np.searchsorted(offs, starts, "right") - 1


def byte_values(b: np.ndarray) -> np.ndarray:
    return _TABLE[b]


def code_point_values(c: np.ndarray) -> np.ndarray:
    return mix64(c.astype(_U) + _U(1))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values=byte_values) -> np.ndarray:
    """64-bit hash of every span's bytes (or other units, each mapped to a
    random word by ``values``); spans are ordered and disjoint."""
    out = np.zeros(len(starts), _U)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right"))
        j = max(j, i + 1)
        base, stop = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(stop - base + 1)
        sums = np.zeros(stop - base + 1, _U)
        np.cumsum(values(buf[base:stop]) * up[:stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(_U)
        i = j
    return mix64(out)


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word index, hash) of every window of ``n`` words in one text."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(rows[:m] == rows[n - 1:])
    h = np.zeros(len(at), _U)
    for k in range(n):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + words[at + k])
    return at, h


def per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of true bytes in each text."""
    out = np.zeros(len(offs) - 1, np.int64)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        out[full] = np.add.reduceat(mask, offs[:-1][full], dtype=np.int64)
    return out


def keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash that also depends on the text the value lies in."""
    return mix64(hashes ^ mix64(rows.astype(_U) + _U(0x9E3779B97F4A7C15)))
