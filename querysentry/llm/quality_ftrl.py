"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text becomes the set of its hashed uni- and bigrams of words and marks, a sparse vector
of equal weights and length one, with the buckets of three shares beside them: words equal
to the one before, bigrams seen before, and marks. FTRL-proximal updates run over a bounded sample of the
labelled texts: the rows of least key hash, ``max_rows`` at most, hashed in parallel and
learnt one after the other in a single task. Scoring is a sparse dot product in every
task, with the weight table (2**bits floats, one MB) sent to the executors.

Defined cases: a null or empty text has no features and its score is the bias alone;
several labels for a key count as their maximum; a null label or key is not learnt from;
without any label every score is 0.5; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry.llm import textbytes as T
from querysentry.llm.frames import doc_columns, map_steps, training_row

BITS = 18
#: Labelled rows that are learnt from, at most.
MAX_ROWS = 12_000

_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[0x20, *range(0x09, 0x0E), *range(0, 0x09), *range(0x0E, 0x20), 0x7F]] = 0


#: Buckets of each of the three shares; their coordinates follow the n-grams'.
BUCKETS = 12


def _bucket(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(16 * part / np.maximum(1, whole))).astype(np.int32)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of all texts, where each text's begin (the last entry is the end), and its buckets."""
    data, offsets = T.utf8(column)
    starts, ends, rows = T.runs(_KIND[data], offsets)
    one = T.SpanHash(T.LOWER[data])(starts, ends)
    same = rows[1:] == rows[:-1]
    with np.errstate(over="ignore"):
        two = T.mix(one[:-1] * np.uint64(0x9E3779B185EBCA87) + one[1:])[same]
    n = len(offsets) - 1
    where = np.concatenate([rows, rows[1:][same]]).astype(np.int64)
    tokens, pairs = np.bincount(rows, minlength=n), np.bincount(rows[1:][same], minlength=n)
    stutters = np.bincount(rows[1:][same & (one[1:] == one[:-1])], minlength=n)
    with np.errstate(over="ignore"):
        _, first = np.unique(T.mix(two + rows[1:][same].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)
    repeats = pairs - np.bincount(rows[1:][same][first], minlength=n)
    marks = np.bincount(rows[_KIND[data[starts]] == 2], minlength=n)
    shares = np.stack([_bucket(stutters, tokens), BUCKETS + _bucket(repeats, pairs), 2 * BUCKETS + _bucket(marks, tokens)], axis=1)
    keys = np.unique(where << bits | (np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int64))
    return (keys & (1 << bits) - 1).astype(np.int32), np.searchsorted(keys >> bits, np.arange(len(offsets))), shares + (1 << bits)


class Ftrl:
    """FTRL-proximal logistic regression over sparse vectors of equal entries."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        size = (1 << bits) + 3 * BUCKETS + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, found: np.ndarray, label: float, weight: float = 1.0) -> None:
        """One update of n-grams followed by the three buckets; the last coordinate is the bias."""
        n = len(found) - 3
        at = np.append(found, len(self.z) - 1)
        x = np.append(np.full(n, 1 / np.sqrt(max(1, n))), [1.0] * 4)
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int, text: str, key: str) -> DataFrame:
    """(doc_id, text, label) of the at most ``max_rows`` learnable rows of least key hash."""
    marks = labels.select(F.col(key).cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("label"))
    chosen = (
        marks.dropna().filter(training_row()).groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    )
    # At most max_rows rows of two numbers, so this side may always be broadcast. A key
    # with several texts adds all of them; the sort below keeps the bound.
    return (
        docs.select(*doc_columns(text, key)).join(F.broadcast(chosen), "doc_id")
        .withColumn("order", F.xxhash64(F.lit(seed + 1), "doc_id", "text"))
    )


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS, passes: int = 3,
    seed: int = 11, text: str = "text", key: str = "doc_id",
) -> np.ndarray:
    """Weights by feature; the last one is the bias."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, at, shares = features(batch.column("text"), bits)
        lists = pa.array([np.concatenate([found[a:b], s]) for a, b, s in zip(at, at[1:], shares)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), lists], names=["order", "label", "found"])

    sample = learning_sample(docs, labels, label, max_rows, seed, text, key)
    rows = map_steps(sample, ["order", "label", "text"], hashed, "order bigint, label double, found array<int>")

    def learn(batches):
        model = Ftrl(bits)
        held = [
            (order, label, np.array(found, np.int32))
            for batch in batches
            for order, label, found in zip(*(batch.column(c).to_pylist() for c in ("order", "label", "found")))
        ]
        held.sort(key=lambda r: (r[0], r[1], len(r[2])))
        held = held[:max_rows]
        good = sum(mark > 0 for _, mark, _ in held)
        # Both labels weigh alike, or the rarer one would hardly ever reach 0.5.
        weights = [len(held) / (2 * max(1, len(held) - good)), len(held) / (2 * max(1, good))]
        for _ in range(passes):
            for _, mark, found in held:
                model.learn(found, float(mark > 0), weights[mark > 0])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()])], names=["weights"])

    row = rows.repartition(1).mapInArrow(learn, "weights binary").first()
    return np.frombuffer(row.weights, np.float32) if row else np.zeros((1 << bits) + 3 * BUCKETS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, threshold: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) of every document; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = sent.value.astype(np.float64)
        found, at, shares = features(batch.column("text"), bits)
        sums = np.concatenate([[0.0], np.cumsum(w[found])])
        n = np.diff(at)
        dots = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(n, 1)) + w[shares].sum(axis=1) + w[-1]
        scores = 1 / (1 + np.exp(-np.clip(dots, -35, 35)))
        columns = [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return map_steps(docs, doc_columns(text, key), run, "doc_id bigint, score double, predicted int")
