"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: bit i is set if bit i is set in over half of the shingles' XXH64 values.
Tables: every bit i gets a vector f(i) of radius+1 bits, and every vector v but zero makes
a table whose mask keeps the bits with odd f(i)*v. The vectors of the at most ``radius``
bits in which two fingerprints differ span less than the whole space, so some v is
orthogonal to all of them: that table masks out all differences and the pair surely meets.

Work is done on distinct fingerprints. A bucket of two is checked in place. A larger one
comes back as links from its members to the least fingerprint they reach inside it, never
as all pairs. Beyond ``MAX_BUCKET`` fingerprints it is not gathered at all: each member
names all points within half the radius (of the bits the mask left out), and members
that name the same point are linked through it, which finds exactly the linked pairs.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a
text with fewer words than a shingle is one shingle; repeated rows share a class; rows
without a key take part, and a class of only such rows has a null id; an empty table gives
an empty table.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry.llm import textbytes as T
from querysentry.llm.components import connected_components
from querysentry.llm.frames import doc_columns, map_steps, store

BITS = 64
#: The most fingerprints of one bucket that are compared inside one task (134 M comparisons at most).
MAX_BUCKET = 16_384
#: Rows of the largest side that is broadcast: 24 bytes each, 5 MB at most.
MAX_BROADCAST_ROWS = 200_000
_SHINGLES_AT_ONCE = 1 << 17


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of one text over its shingles of lower-cased (A-Z) words."""
    import xxhash

    found = T.LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    ends = ends[min(words, len(found)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, _SHINGLES_AT_ONCE):
        spans = map(slice, starts[k : k + _SHINGLES_AT_ONCE].tolist(), ends[k : k + _SHINGLES_AT_ONCE].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(42)), np.uint64, min(n - k, _SHINGLES_AT_ONCE))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.fromiter((fingerprint(t, words) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return map_steps(docs, doc_columns(text, key), run, "doc_id bigint, fp bigint")


def masks(radius: int) -> list[int]:
    """The kept bits of every table, as signed 64-bit integers."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    made = (sum(1 << i for i, f in enumerate(vectors) if (f & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1)))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in made]


def _buckets(distinct: DataFrame, radius: int) -> DataFrame:
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))]
    return distinct.select("fp", F.explode(F.array(*tables)).alias("b")).select("b.t", "b.key", "fp")


def reached(fps: np.ndarray, radius: int, rows: int = 512) -> np.ndarray:
    """For each of the ascending fingerprints the place of the least one it reaches by links."""
    label = np.arange(len(fps))
    while True:
        least = label.copy()
        for k in range(0, len(fps), rows):
            linked = np.bitwise_count(fps[k : k + rows, None] ^ fps[None, :]) <= radius
            least[k : k + rows] = np.where(linked, label[None, :], len(fps)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def links(distinct: DataFrame, radius: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within the radius."""
    keys = _buckets(distinct, radius)
    met = store(
        keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"),
        "simhash-buckets",
    )
    pairs = met.filter("n = 2").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")
    many = met.filter("n > 2").select("t", "key", "n")
    if many.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        many = F.broadcast(many)
    members = keys.join(many, ["t", "key"])

    def star(frame: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(frame["fp"].to_numpy(np.int64))
        label = reached(fps.view(np.uint64), radius)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return pd.DataFrame({"u": fps[moved], "v": fps[label[moved]]})

    inside = members.filter(F.col("n") <= max_bucket).groupBy("t", "key").applyInPandas(star, "u bigint, v bigint")
    return pairs.union(inside).union(_through_points(members.filter(F.col("n") > max_bucket), radius))


def _through_points(members: DataFrame, radius: int) -> DataFrame:
    """Links of unbounded buckets: through points at most half the radius from both ends.

    Two fingerprints of a bucket differ in masked-out bits only, so the points do as well.
    An odd radius takes one bit more on one side: each member names the points within the
    larger half, and a point's members are linked in a star if one is within the smaller.
    """
    made = []
    for t, mask in enumerate(masks(radius)):
        free = [i for i in range(BITS) if not mask >> i & 1]
        flips = [sum(1 << i for i in bits) for k in range(radius // 2 + 1) for bits in combinations(free, k)]
        made.append(F.when(F.col("t") == t, F.array(*(F.lit(f - (1 << 64) if f >= 1 << 63 else f) for f in flips))))
    if radius % 2:
        raise ValueError("Buckets beyond the bound need an even radius")
    points = members.select("fp", F.explode(F.coalesce(*made)).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")
    )
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return points.join(least, "point").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(
    docs: DataFrame, radius: int = 4, words: int = 4, text: str = "text", key: str = "doc_id", max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the least doc_id it reaches by links."""
    prints = store(fingerprints(docs, words, text, key), "simhash")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), radius, max_bucket))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = classes.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the least doc_id; rows without one are told apart by their text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.xxhash64("text").cast("string")))
    kept = near_duplicates(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    named = docs.withColumn("_name", name)
    stay = kept.select(F.col("doc_id").cast("string").alias("_name")).filter("_name is not null")
    if not kept.filter("doc_id is null").isEmpty():
        stay = stay.union(named.filter("doc_id is null").select("_name"))
    return named.join(stay, "_name", "left_semi").dropDuplicates(["_name"]).drop("_name")
