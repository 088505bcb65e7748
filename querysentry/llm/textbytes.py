"""Words, lines and n-gram hashes of whole Arrow columns, by numpy on their UTF-8 bytes.

White space is ASCII (blank and 0x09 to 0x0D), so that words can be found on bytes. A
text's word hash depends on the word's bytes only: equal words have equal hashes in every
task and on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from querysentry.llm.frames import kept_in_process

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(characters: str) -> np.ndarray:
    """Membership table for ASCII characters."""
    found = np.zeros(256, bool)
    found[[ord(c) for c in characters]] = True
    return found


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row begins; the last entry is the end."""
    column = pa.compute.cast(pa.compute.fill_null(column, ""), pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64 and their inverses."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    made = []
    with np.errstate(over="ignore"):
        for base in (_BASE, inverse):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            made.append(np.multiply.accumulate(powers))
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


class SpanHash:
    """Hashes of any byte spans of ``data`` in constant time each, from prefix sums."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        powers, self._inverse = kept_in_process(("powers", size), lambda: _powers(size))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of maximal runs of equal non-zero ``kind``, split at row borders."""
    n = len(kind)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    change = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, as runs of bytes that are no ASCII white space."""
    return runs(~SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line (split at line feeds only), empty ones included."""
    breaks = np.flatnonzero(data == 0x0A)
    ends = np.concatenate([breaks, offsets[1:]])
    starts = np.concatenate([breaks + 1, offsets[:-1]])
    starts.sort()
    ends.sort()
    # A text that ends in a line feed has an empty last line that begins where the next row does.
    row_of_start = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(len(offsets) - 1)])
    row_of_start.sort()
    return starts, ends, row_of_start


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row (or between any ascending borders)."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
