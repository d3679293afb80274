"""Words and shingles of whole Arrow text columns as 64-bit hashes, in numpy.

Texts are taken as UTF-8 bytes, so that ASCII separators and case never need decoding. Work goes
piece by piece (about PIECE bytes, cut at separators): a text of any length takes bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=U)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, and about so many bytes, so that what a task makes of them stays small."""
    for batch in batches:
        few = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, few):
            yield batch.slice(i, few)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: ASCII but letters and digits: what parts words of op8's kind; the words above are parted by ASCII white space.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x2545F4914F6CDD1D | 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(PIECE * 2 + 1, U(base))
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=U))
    return _POWERS[0], _POWERS[1]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its texts; null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def _hashed(piece: np.ndarray, begins: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a piece; no word crosses a byte marked in begins."""
    gap = gaps[piece]
    before = np.empty(len(piece), dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    before |= begins
    starts = np.flatnonzero(before & ~gap)
    after = np.empty(len(piece), dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:] | begins[1:]
    ends = np.flatnonzero(after & ~gap) + 1
    up, down = _powers()
    total = np.zeros(len(piece) + 1, dtype=U)
    np.cumsum((_LOWER[piece].astype(U) + U(1)) * up[: len(piece)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)), starts


def _long_word(piece: np.ndarray) -> np.ndarray:
    """The same hash for one word longer than the tables of powers."""
    h, at = 0, 1
    for i in range(0, len(piece), PIECE):
        part = piece[i : i + PIECE]
        h += int(((_LOWER[part].astype(U) + U(1)) * _powers()[0][: len(part)]).sum()) * at
        at = at * pow(_BASE, len(part), 1 << 64) & (1 << 64) - 1
    return mix(np.array([(h + len(piece)) & (1 << 64) - 1], dtype=U))


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, hashes of their lower-cased words, offsets of the texts in them); gaps: bytes between words."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(max(i + 1, np.searchsorted(offsets, offsets[i] + PIECE, "right") - 1))
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * PIECE:
            piece = data[lo:hi]
            if not len(piece):
                yield i, j, np.zeros(0, U), np.zeros(j - i + 1, np.int64)
            else:
                at = offsets[i : j + 1] - lo
                begins = np.zeros(len(piece), dtype=bool)
                begins[at[:-1][at[:-1] < len(piece)]] = True
                hashes, starts = _hashed(piece, begins, gaps)
                yield i, j, hashes, np.searchsorted(starts, at)
        else:  # one long text
            parts = []
            while lo < hi:
                end = min(hi, lo + PIECE)
                if end < hi:
                    last = np.flatnonzero(gaps[data[lo:end]])
                    if len(last):
                        end = lo + int(last[-1]) + 1
                    else:
                        more = end
                        while more < hi and not gaps[data[more]]:
                            more += 1
                        parts.append(_long_word(data[lo:more]))
                        lo = more
                        continue
                parts.append(_hashed(data[lo:end], np.zeros(end - lo, dtype=bool), gaps)[0])
                lo = end
            hashes = np.concatenate(parts)
            yield i, j, hashes, np.array([0, len(hashes)], np.int64)
        i = j


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; empty for fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    total = np.zeros(n, dtype=U)
    for j in range(k):
        total = (total ^ (total >> U(29))) * _MULTIPLIERS[j % 4] + hashes[j : j + n]
    return mix(total)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of k words; a shorter text is one run, one without words none."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, k)) if len(hashes) >= k else grams(hashes, len(hashes))
