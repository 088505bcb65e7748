"""Importance resampling of documents towards a target's hashed n-gram distribution.

A document's features are its runs of one to ``N`` words, repeats counted; a feature's
bucket is its CRC-32 modulo ``buckets``. A bucket's gain is the scaled log ratio of its
smoothed shares in the target and in the corpus, a document's weight the sum of its
features' gains, and the documents of highest weight plus Gumbel noise are drawn.

The n-grams of a batch are interned in an open-addressed table (``ngram_table``), so a
distinct n-gram's bucket is worked out once; the slots of its occurrences gather the gains.
Long texts are cut at any word: a batch's last words are read again by the next one.

The corpus is read twice, and shuffles only sums by bucket and one short row per document.
Ranks come from ranges of (score, doc_id) of bounded size; only ranges that reach into the
draw are sorted, and no task or driver sees all rows.

Defined cases: a null or blank text has no features and weight 0; a null doc_id hashes as
an empty one and comes after the others in a tie; repeated rows are ranked each; an empty
table gives an empty one; an empty target or corpus has counts of zero. Other columns,
whatever their names, are not read. Weights are exact below 2**53.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querysentry.llm import textbytes as T
from querysentry.llm.frames import doc_columns, map_steps, steps, store
from querysentry.llm.ngram_table import PADDING, Spans, SpanTable

BUCKETS, N = 10_000, 3
#: Words whose n-grams are interned at once.
WORDS_AT_ONCE = 1 << 17
#: Rows of one range of scores, about.
ROWS_PER_RANGE = 500_000

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class Features:
    """The n-grams of a text column, a bounded number of words at a time."""

    def __init__(self, column: pa.Array, n: int = N, at_once: int = WORDS_AT_ONCE):
        data, offsets = T.utf8(column)
        data = T.LOWER[data]
        self._n, self._at_once = n, at_once
        starts, ends, self.rows = T.runs(_WORD[data], offsets)
        lengths = ends - starts
        # All words one after the other, a blank behind each.
        ends = np.cumsum(lengths + 1) - 1
        self._starts, self._ends = ends - lengths, ends
        self._buffer = np.full(int(lengths.sum()) + len(lengths) + PADDING, 0x20, np.uint8)
        if len(lengths):
            letters = data[_WORD[data]]
            self._buffer[np.arange(len(letters)) + np.repeat(np.arange(len(lengths)), lengths)] = letters

    def tables(self) -> Iterator[tuple[SpanTable, np.ndarray]]:
        """Interned n-grams and the row of each occurrence."""
        for k in range(0, len(self.rows), self._at_once):
            first = np.arange(k, min(k + self._at_once, len(self.rows)))
            starts, ends, rows = [], [], []
            for size in range(self._n):
                at = first[: max(0, len(self.rows) - size - k)]
                at = at[self.rows[at] == self.rows[at + size]]
                starts.append(self._starts[at])
                ends.append(self._ends[at + size])
                rows.append(self.rows[at])
            yield SpanTable(Spans(self._buffer, np.concatenate(starts), np.concatenate(ends))), np.concatenate(rows)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, n: int = N) -> DataFrame:
    """(bucket, features) of all texts, buckets without a feature left out."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in steps(batch):
                for table, _ in Features(part.column("text"), n).tables():
                    sums += np.bincount(table.buckets(buckets), table.counts, buckets).astype(np.int64)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["bucket", "features"])

    made = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "bucket bigint, features bigint")
    return made.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(target: DataFrame, corpus: DataFrame, text: str = "text", buckets: int = BUCKETS, n: int = N) -> np.ndarray:
    """The gain of every bucket. One number per bucket reaches the driver, whatever the data."""

    def dense(df: DataFrame) -> list[int]:
        made = [0] * buckets
        for bucket, features in bucket_counts(df, text, buckets, n).collect():
            made[bucket] = features
        return made

    t, s = dense(target), dense(corpus)
    all_t, all_s = float(sum(t) + buckets), float(sum(s) + buckets)
    return np.array([math.floor(1000 * math.log((float(a + 1) * all_s) / (float(b + 1) * all_t))) for a, b in zip(t, s)], np.int64)


def noise(key: int | None, seed: int = 42) -> int:
    """Scaled Gumbel noise of a document, from its key alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", n: int = N, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        features = Features(batch.column("text"), n)
        size = batch.num_rows
        weight, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for table, rows in features.tables():
            by_slot = gain[table.buckets(buckets)]
            weight += np.bincount(rows, by_slot[table.slots], size).astype(np.int64)
            count += np.bincount(rows, minlength=size)
        keys = batch.column("doc_id").to_pylist()
        score = weight + np.fromiter((noise(k, seed) for k in keys), np.int64, size)
        columns = [batch.column("doc_id"), *map(pa.array, (np.bincount(features.rows, minlength=size), count, weight, score))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    return map_steps(docs, doc_columns(text, key), run, schema)


def draw(scored: DataFrame, per_cent: int, min_words: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``scored`` with ``rank`` (1, 2, 3 …) for the drawn rows, null for the others.

    Drawn are ``per_cent`` of the rows with ``min_words`` words, by falling score, ties by
    rising doc_id. The rows' ranges are written with them, so a repeated task ranks alike.
    """
    # A number per row keeps many equal rows from meeting in one range.
    scored = store(scored.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count()
    drawn = per_cent * n // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = able.repartitionByRange(max(1, math.ceil(n / rows_per_range)), *order).withColumn("range", F.spark_partition_id())
    ranges = store(ranges, "resampling-ranges")
    # One row a range.
    before = F.sum("rows").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    placed = ranges.join(F.broadcast(sizes), "range")
    rank = F.row_number().over(W.partitionBy("range").orderBy(*order)) + F.col("before")
    inside = placed.filter(F.col("before") < drawn).withColumn("rank", rank.cast("bigint"))
    inside = inside.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.filter(F.col("n_words") < min_words).unionByName(placed.filter(F.col("before") >= drawn).select(*scored.columns))
    made = inside.select(*scored.columns, "rank").unionByName(others.withColumn("rank", F.lit(None).cast("bigint")))
    return made.drop("row")


def resample(
    docs: DataFrame, target: DataFrame, per_cent: int = 5, min_words: int = 20, buckets: int = BUCKETS, n: int = N, seed: int = 42,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document."""
    gain = gains(target, docs, buckets=buckets, n=n)
    return draw(weights(docs, gain, n=n, seed=seed), per_cent, min_words, rows_per_range)
