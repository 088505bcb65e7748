"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest. The rests of a few thousand
documents at a time are dealt to k windows: each rest starts as a partial partition with
one filled slot; the two partitions with the largest imbalance are merged, the fullest
slot of one with the emptiest of the other, until one is left. Its windows are nearly
equal. k begins at the least possible number and rises while a window exceeds the
capacity. Nothing is shuffled: each task packs what it has read.

Defined cases: a null text is empty and holds the end id only; repeated rows and equal or
null keys are packed row by row; an empty table gives no windows; a document of any length
is cut; other columns are not read. Window ids ascend in a task and differ between tasks,
they are not dense.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from querysentry.llm.frames import doc_columns, give_back, steps
from querysentry.llm.pretokens import MEMORY, word_encoder

CAPACITY = 4096
#: Rests dealt out together: the heap, slots and partitions of one deal stay under some tens of MB.
GROUP = 3072
PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint, ids binary"
)


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every item, and the slots' sums, by merging the partitions of largest imbalance."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(k, np.int64)
    # A partition holds its filled slots only, fullest first, as sums and as nodes of a
    # forest whose leaves are the items; all other slots are empty.
    heads: list[tuple[int, int]] = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heads)
    sums = {i: np.array([s], np.int64) for i, s in enumerate(sizes)}
    nodes = {i: np.array([i], np.int64) for i in range(n)}
    left, right = [], []
    while len(heads) > 1:
        (_, a), (_, b) = heapq.heappop(heads), heapq.heappop(heads)
        big, small = sums.pop(a), sums.pop(b)
        one, two = nodes.pop(a), nodes.pop(b)
        over = len(big) + len(small) - k
        if over > 0:
            # The last ``over`` slots of the one meet the last of the other, fullest with emptiest.
            made = np.arange(n + len(left), n + len(left) + over)
            left.extend(one[len(one) - over :].tolist())
            right.extend(two[len(two) - over :][::-1].tolist())
            met = big[len(big) - over :] + small[len(small) - over :][::-1]
            big = np.concatenate([big[: len(big) - over], met, small[: len(small) - over]])
            one = np.concatenate([one[: len(one) - over], made, two[: len(two) - over]])
        else:
            big, one = np.concatenate([big, small]), np.concatenate([one, two])
        order = np.argsort(-big, kind="stable")
        sums[a], nodes[a] = big[order], one[order]
        imbalance = int(sums[a][0] - (sums[a][-1] if len(order) == k else 0))
        heapq.heappush(heads, (-imbalance, a))
    last = heads[0][1]
    slot = np.full(n + len(left), -1, np.int64)
    slot[nodes[last]] = np.arange(len(nodes[last]))
    for m in range(len(left) - 1, -1, -1):
        slot[left[m]] = slot[right[m]] = slot[n + m]
    filled = np.zeros(k, np.int64)
    filled[: len(sums[last])] = sums[last]
    return slot[:n], filled


def windows_for(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Window of every item and the number of windows, which rises until none exceeds the capacity.

    It rises by what the fullest window is over, since the others are about as full.
    """
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        slot, sums = differencing(sizes, k)
        most = int(sums.max(initial=0))
        if most <= capacity:
            return slot, k
        k = max(k + 1, k * most // capacity)


def _pieces(doc_id, ids: np.ndarray, capacity: int):
    for start in range(0, len(ids), capacity):
        piece = ids[start : start + capacity]
        # A rest waits for its deal: alone, without the ids of all its document.
        yield doc_id, start, piece.copy() if start and len(piece) < capacity else piece, len(ids)


def pack_documents(
    docs: DataFrame, model_file: str, end_id: int, cut: str = "space", capacity: int = CAPACITY, group: int = GROUP,
    with_ids: bool = True, text: str = "text", key: str = "doc_id", memory: int = MEMORY,
) -> DataFrame:
    """One row a piece: its place in its document and its window; ids are little-endian 32-bit (or null)."""

    def run(batches):
        from pyspark import TaskContext

        encoder, first = word_encoder(model_file, cut, memory), TaskContext.get().partitionId() << 32
        rests = []

        def rows(pieces, sequences, offsets):
            raw = [ids.astype("<u4").tobytes() for _, _, ids, _ in pieces]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([len(p[2]) for p in pieces], pa.int64()), pa.array([p[3] for p in pieces], pa.int64()),
                    pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array(raw if with_ids else [None] * len(raw), pa.binary()),
                ],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )

        def dealt():
            nonlocal first
            sizes = np.array([len(p[2]) for p in rests], np.int64)
            slot, k = windows_for(sizes, capacity)
            order = np.argsort(slot, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            begins = np.searchsorted(slot[order], slot[order])
            made = rows([rests[i] for i in order], first + slot[order], before - before[begins])
            first += k
            return made

        for batch in batches:
            for part in steps(batch):
                full = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"))):
                    for piece in _pieces(doc_id, np.append(ids, np.int32(end_id)), capacity):
                        (full if len(piece[2]) == capacity else rests).append(piece)
                if full:
                    yield rows(full, range(first, first + len(full)), [0] * len(full))
                    first += len(full)
                while len(rests) >= group:
                    kept, rests = rests[group:], rests[:group]
                    yield dealt()
                    rests = kept
                # A step leaves much more free than it keeps, and two workers of an executor or more pack at a time.
                full = None
                give_back()
        if rests:
            yield dealt()
        batch = part = rests = None
        give_back()

    return docs.select(*doc_columns(text, key)).mapInArrow(run, PIECES)
