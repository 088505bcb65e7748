"""An open-addressed table that interns byte spans of one batch, by numpy.

Keys are the spans' XXH64 values, worked out for all spans of a length at once. A span goes
to the first slot from its key on that is free or holds the same bytes; equal keys alone
are not trusted. Equal spans walk the same slots in the same rounds, so they meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import xxhash

from querysentry.llm.frames import kept_in_process

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_CRC = np.uint32(0xEDB88320)
#: Longer spans, and lengths with fewer spans, are hashed and compared one by one.
_LONG, _FEW = 256, 4
#: Bytes that must follow the last span in the buffer.
PADDING = 8


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _crc_tables() -> list[np.ndarray]:
    """What a byte, and each pair of the next eight bytes, adds to a CRC-32."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ _CRC, step >> 1).astype(np.uint32)
    pairs = np.arange(1 << 16, dtype=np.uint32)
    made = []
    for _ in range(2):
        pairs = step[pairs & 255] ^ (pairs >> 8)
    for _ in range(4):
        made.append(pairs)
        for _ in range(2):
            pairs = step[pairs & 255] ^ (pairs >> 8)
    return [step, *reversed(made)]


class Spans:
    """Byte spans [start, end) of a buffer that ends in ``PADDING`` spare bytes."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buffer, self.starts, self.lengths = buffer, starts, ends - starts
        self._raw = memoryview(buffer)
        # Eight (four) bytes from any place on.
        self._eight = np.ndarray(len(buffer) - 7, "<u8", buffer.data, 0, (1,))
        self._four = np.ndarray(len(buffer) - 3, "<u4", buffer.data, 0, (1,))

    def __len__(self) -> int:
        return len(self.starts)

    def bytes_of(self, k: int) -> memoryview:
        return self._raw[self.starts[k] : self.starts[k] + self.lengths[k]]

    def _hash_length(self, at: np.ndarray, length: int) -> np.ndarray:
        done = 0
        if length >= 32:
            start = (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)
            lanes = [np.full(len(at), v, np.uint64) for v in start]
            while done + 32 <= length:
                for k in range(4):
                    lanes[k] = _rotate(lanes[k] + self._eight[at + (done + 8 * k)] * _P2, 31) * _P1
                done += 32
            h = _rotate(lanes[0], 1) + _rotate(lanes[1], 7) + _rotate(lanes[2], 12) + _rotate(lanes[3], 18)
            for lane in lanes:
                h = (h ^ (_rotate(lane * _P2, 31) * _P1)) * _P1 + _P4
        else:
            h = np.full(len(at), _P5, np.uint64)
        h = h + np.uint64(length)
        while done + 8 <= length:
            h = _rotate(h ^ (_rotate(self._eight[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
            done += 8
        if done + 4 <= length:
            h = _rotate(h ^ (self._four[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
            done += 4
        while done < length:
            h = _rotate(h ^ (self.buffer[at + done].astype(np.uint64) * _P5), 11) * _P1
            done += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))

    def _crc_length(self, at: np.ndarray, length: int) -> np.ndarray:
        step, *pairs = kept_in_process(("powers", "crc"), _crc_tables)
        crc, done = np.full(len(at), 0xFFFFFFFF, np.uint32), 0
        while done + 8 <= length:
            x = self._eight[at + done] ^ crc
            crc = pairs[0][x & np.uint64(0xFFFF)]
            for k in (1, 2, 3):
                crc ^= pairs[k][(x >> np.uint64(16 * k)) & np.uint64(0xFFFF)]
            done += 8
        while done < length:
            crc = step[(crc ^ self.buffer[at + done]) & np.uint32(255)] ^ (crc >> np.uint32(8))
            done += 1
        return ~crc

    def _by_length(self, chosen: np.ndarray, together: Callable, single: Callable) -> np.ndarray:
        """A number per chosen span: ``together`` for those of a length, ``single`` for long or odd ones."""
        made = np.empty(len(chosen), np.uint64)
        lengths = self.lengths[chosen]
        order = np.argsort(np.minimum(lengths, _LONG + 1).astype(np.uint16), kind="stable")
        borders = np.searchsorted(np.minimum(lengths[order], _LONG + 1), np.arange(_LONG + 3)).tolist()
        with np.errstate(over="ignore"):
            for length, (start, stop) in enumerate(zip(borders, borders[1:])):
                group = order[start:stop]
                if length <= _LONG and len(group) >= _FEW:
                    made[group] = together(self.starts[chosen[group]], length)
                else:
                    made[group] = [single(self.bytes_of(k)) for k in chosen[group].tolist()]
        return made

    def keys(self) -> np.ndarray:
        """XXH64 (seed 0) of every span."""
        return self._by_length(np.arange(len(self)), self._hash_length, xxhash.xxh64_intdigest)

    def crcs(self, chosen: np.ndarray) -> np.ndarray:
        """CRC-32 of the chosen spans."""
        return self._by_length(chosen, self._crc_length, zlib.crc32)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans ``a`` hold the same bytes as the spans ``b``, pair by pair."""
        same = self.lengths[a] == self.lengths[b]
        left = np.flatnonzero(same & (a != b))
        long = self.lengths[a[left]] > _LONG
        for k in left[long].tolist():
            same[k] = self.bytes_of(a[k]) == self.bytes_of(b[k])
        left, done = left[~long], 0
        while len(left):
            size = self.lengths[a[left]]
            differ = self._eight[self.starts[a[left]] + done] ^ self._eight[self.starts[b[left]] + done]
            spare = np.maximum(0, 8 * (done + 8 - size)).astype(np.uint64)
            equal = (differ << spare) == 0
            same[left[~equal]] = False
            done += 8
            left = left[equal & (size > done)]
        return same


class SpanTable:
    """Slots of the distinct spans of a batch: ``slots`` by span, ``owner`` and ``counts`` by slot."""

    def __init__(self, spans: Spans):
        self._spans = spans
        size = 1 << max(4, (2 * len(spans)).bit_length())
        self.owner = np.full(size, -1, np.int32)
        self.slots = np.zeros(len(spans), np.int64)
        keys = spans.keys()
        todo = np.arange(len(spans), dtype=np.int32)
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        while len(todo):
            free = self.owner[at] < 0
            self.owner[at[free]] = todo[free]
            own = self.owner[at]
            same = keys[own] == keys[todo]
            maybe = np.flatnonzero(same)
            same[maybe] = spans.equal(own[maybe], todo[maybe])
            self.slots[todo[same]] = at[same]
            todo, at = todo[~same], (at[~same] + 1) & (size - 1)
        self.counts = np.bincount(self.slots, minlength=size)

    def buckets(self, n: int) -> np.ndarray:
        """CRC-32 modulo ``n`` of the bytes in each slot that is taken."""
        made = np.zeros(len(self.owner), np.int32)
        taken = np.flatnonzero(self.owner >= 0)
        made[taken] = self._spans.crcs(self.owner[taken]) % np.uint64(n)
        return made
