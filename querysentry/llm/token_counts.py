"""Token counts by overlap resynchronisation.

A huge document is encoded as overlapping chunks with offsets. Two neighbouring chunks
are spliced where both have a token boundary that is proven stable: no piece of the
vocabulary holds the two characters on its sides next to each other, so no merge can ever
cross it and what lies left and right of it is encoded independently. If an overlap has
no such place, it is widened, in the end to all the text since the last splice.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null or repeated key is
kept row by row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from querysentry.llm.frames import doc_columns, kept_in_process, map_steps

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint, n_widened bigint"


class ChunkedEncoder:
    """A sentencepiece model that encodes texts of any length in bounded chunks."""

    def __init__(self, model_file: str, chunk: int = 16_384, overlap: int = 256):
        import sentencepiece

        if not 2 <= overlap < chunk:
            raise ValueError("The overlap must be shorter than a chunk")
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.joined = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                self.joined.update(zip(piece, piece[1:]))

    def _plain(self, text: str) -> bool:
        """True if the model's normalizer leaves the text's characters as they are."""
        return self.model.normalize(text).replace("▁", " ").removeprefix(" ") == text.replace("▁", " ").removeprefix(" ")

    def _stable(self, text: str, at: int) -> bool:
        left, right = text[at - 1], text[at]
        return ("▁" if left == " " else left, "▁" if right == " " else right) not in self.joined

    def _part(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of text[begin:end] and where their characters begin and end in ``text``."""
        found = self.model.encode(text[begin:end], return_type="offset_mapping")
        spans = np.array(found["offsets"], np.int64).reshape(-1, 2) + begin
        return np.array(found["ids"], np.int32), spans[:, 0], spans[:, 1]

    def _splice(self, text: str, left: tuple, right: tuple, low: int, high: int) -> int | None:
        """The last stable place strictly between ``low`` and ``high`` where both parts have a token boundary."""
        for at in range(high - 1, low, -1):
            if self._stable(text, at) and all(self._boundary(part, at) for part in (left, right)):
                return at
        return None

    @staticmethod
    def _boundary(part: tuple, at: int) -> bool:
        _, begins, ends = part
        k = int(np.searchsorted(begins, at))
        return k < len(begins) and begins[k] == at and (k == 0 or ends[k - 1] <= at)

    def encode(self, text: str) -> tuple[np.ndarray, int, int]:
        """All ids, the number of chunks, and how many overlaps had to be widened."""
        n = len(text)
        if n <= self.chunk or not self._plain(text):
            return np.array(self.model.encode(text), np.int32), 1, 0
        made, chunks, widened = [], 1, 0
        done, end = 0, self.chunk
        left = self._part(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(done, end - overlap)
                stop = min(n, end + self.chunk - self.overlap)
                right = self._part(text, begin, stop)
                at = self._splice(text, left, right, begin, end) if begin > done else None
                if at is not None or begin == done:
                    break
                overlap, widened = 2 * overlap, widened + 1
            chunks += 1
            if at is None:
                # No stable place since the last splice: that whole text becomes one part.
                widened += 1
                left = self._cut(right, done, n + 1) if begin == 0 else self._since(text, done, stop)
            else:
                made.append(self._cut(left, done, at)[0])
                left, done = right, at
            end = stop
        made.append(self._cut(left, done, n + 1)[0])
        return np.concatenate(made), chunks, widened

    def _since(self, text: str, done: int, stop: int) -> tuple:
        """The text since the splice at ``done``, with the context before it, so that it isn't a text's beginning."""
        return self._part(text, max(0, done - self.overlap), stop)

    @staticmethod
    def _cut(part: tuple, low: int, high: int) -> tuple:
        ids, begins, ends = part
        keep = slice(int(np.searchsorted(begins, low)), int(np.searchsorted(begins, high)))
        return ids[keep], begins[keep], ends[keep]


def token_counts(
    docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = 16_384, overlap: int = 256,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = kept_in_process(("chunked", model_file, chunk, overlap), lambda: ChunkedEncoder(model_file, chunk, overlap))
        counts = [encoder.encode(t) for t in batch.column("text").to_pylist()]
        n_tokens = [len(ids) for ids, _, _ in counts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64()),
                pa.array(n_tokens, pa.int64()),
                pa.array([n > limit for n in n_tokens], pa.bool_()),
                pa.array([c for _, c, _ in counts], pa.int64()),
                pa.array([w for _, _, w in counts], pa.int64()),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
        )

    return map_steps(docs, doc_columns(text, key), run, SCHEMA, keeps=True)
