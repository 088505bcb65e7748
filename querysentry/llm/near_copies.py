"""Near copies by the exact similarity of their word shingles; minimum hashes find the candidates.

A text is its set of shingles of lower-cased (A-Z) words. Two sets are linked if they share
at least ``similarity`` of their union. ``BANDS`` bands of ``ROWS`` minimum hashes propose
candidates: a pair at 0.8 shares no band with a chance of (1 - 0.8**4)**32, 5 in 10**8.
Classes found by another method, such as SimHash, are candidates too: all of a class are compared.

Work is done on distinct sets. Bands that hold the same sets count once. The sets of a band
are compared in one task, exactly, and come back as links to one of each class, never as all
pairs. A band beyond ``MAX_SETS`` or ``MAX_SHINGLES`` is cut in parts, and every two parts
are compared in a task of their own, so no pair is left out and no task is unbounded.

Defined cases: texts without words are alike; a text with fewer words than a shingle is one
shingle; rows are told apart by key and text, so repeated keys lose no text and repeated
rows become one; rows without a key come after those with one; an empty table stays empty.
Shingles, sets and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querysentry.llm import textbytes as T
from querysentry.llm.components import connected_components
from querysentry.llm.frames import doc_columns, map_steps, store

BANDS, ROWS = 32, 4
#: Sets and shingles of one side of a comparison inside one task, at most (but one set at least).
MAX_SETS, MAX_SHINGLES = 512, 1 << 18
#: Hashes of sets that are sent to executors, at most: 8 bytes each.
MAX_SENT = 4_000_000
#: Rows of the largest side that is broadcast, five numbers each.
MAX_BROADCAST_ROWS = 200_000
_STEP = np.uint64(0x9E3779B185EBCA87)


def shingle_sets(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and where each text's begin."""
    data, offsets = T.utf8(column)
    data, n = T.LOWER[data], len(offsets) - 1
    starts, ends, rows = T.words(data, offsets)
    hashes = T.SpanHash(data)(starts, ends)
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts

    def joined(at: np.ndarray, size: int) -> np.ndarray:
        key = np.full(len(at), size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                key = T.mix(key * _STEP + hashes[at + k])
        return key

    whole = np.flatnonzero(rows[: max(0, len(rows) - words + 1)] == rows[words - 1 :])
    made, owners = [joined(whole, words)], [rows[whole]]
    for size in range(1, words):
        short = np.flatnonzero(counts == size)
        made.append(joined(first[short], size))
        owners.append(short)
    keys, owner = np.concatenate(made), np.concatenate(owners)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def band_keys(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One key a band for each set, by row; those of empty sets mean nothing."""
    n = len(offsets) - 1
    made = np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return made
    rnd = np.random.default_rng(5)
    factors, shifts = (rnd.integers(0, 1 << 32, BANDS * ROWS, np.uint32) for _ in range(2))
    low = (keys >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                least = np.minimum.reduceat((low ^ shifts[k]) * (factors[k] | np.uint32(1)), offsets[full])
                key = T.mix(key * _STEP + least)
            made[full, band] = key
    return made


def _set_ids(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = keys.tobytes()
    return np.fromiter((xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())), np.uint64, len(offsets) - 1).view(np.int64)


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, set_id, n, bands) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, offsets = shingle_sets(batch.column("text"), words)
        bands = band_keys(keys, offsets).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(_set_ids(keys, offsets)), pa.array(np.diff(offsets)), lists]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "set_id", "n", "bands"])

    return map_steps(
        docs.select(*doc_columns()).withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash", "text"], run,
        "doc_id bigint, text_hash bigint, set_id bigint, n bigint, bands array<bigint>",
    )


def _members(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(set_id, shingles) of the needed sets."""
    sent = None
    if needed.count() <= MAX_SENT:
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(needed.toPandas()["set_id"].to_numpy(np.int64)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, offsets = shingle_sets(batch.column("text"), words)
        ids = _set_ids(keys, offsets)
        own = np.flatnonzero(np.isin(ids, sent.value)) if sent is not None else np.arange(len(ids))
        raw = [keys[offsets[k] : offsets[k + 1]].tobytes() for k in own.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(raw, pa.binary())], names=["set_id", "shingles"])

    made = map_steps(docs.select(*doc_columns()), ["text"], run, "set_id bigint, shingles binary")
    if sent is None:
        made = made.join(needed, "set_id", "left_semi")
    return made.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def reached(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links whose components are those of all pairs of sets at or above the similarity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    words, places = np.unique(np.concatenate(sets), return_inverse=True)
    places = places.astype(np.int32)
    left, found = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo and left.any():
            at = todo.pop()
            mark = np.zeros(len(words), bool)
            mark[places[starts[at] : starts[at] + sizes[at]]] = True
            shared = np.add.reduceat(mark[places], starts, dtype=np.int32)
            hit = np.flatnonzero(left & (shared >= similarity * (sizes + sizes[at] - shared) - 1e-9))
            left[hit] = False
            found += [(ids[h], ids[root]) for h in hit]
            todo += hit.tolist()
    u, v = zip(*found) if found else ((), ())
    return np.array(u, np.int64), np.array(v, np.int64)


def links(
    docs: DataFrame, distinct: DataFrame, words: int = 5, similarity: float = 0.8, max_sets: int = MAX_SETS, max_shingles: int = MAX_SHINGLES,
    classes: DataFrame | None = None,
) -> DataFrame:
    """Links (u, v) between the ids of similar sets; ``classes`` (set_id, class) proposes candidates beside the bands."""
    full = distinct.filter("n > 0")
    keys = full.select("set_id", "n", F.posexplode("bands").alias("t", "key"))
    if classes is not None:
        keys = keys.union(full.select("set_id", "n").join(classes, "set_id").select("set_id", "n", F.lit(BANDS), "class"))
    met = keys.groupBy("t", "key").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"), F.min("set_id").alias("low"), F.max("set_id").alias("high"),
        F.bit_xor(F.xxhash64("set_id")).alias("x"),
    ).filter("sets > 1")
    # Bands with the same sets are compared once.
    met = met.groupBy("sets", "size", "low", "high", "x").agg(F.min(F.struct("t", "key")).alias("b"))
    parts = F.greatest(F.ceil(F.col("sets") / max_sets), F.ceil(F.col("size") / max_shingles)).cast("int")
    met = store(met.select("b.t", "b.key", parts.alias("parts")), "copies-bands")
    few = F.broadcast(met) if met.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else met
    members = store(keys.join(few, ["t", "key"]).select("t", "key", "parts", "set_id"), "copies-members")
    sets = store(_members(docs, members.select("set_id").distinct(), words), "copies-sets")
    part = F.pmod(F.xxhash64(F.lit(3), "set_id"), F.col("parts")).cast("int")
    dealt = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "set_id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("set_id")
        u, v = reached(frame["set_id"].to_numpy(np.int64), [np.frombuffer(s, np.uint64) for s in frame["shingles"]], similarity)
        return pd.DataFrame({"u": u, "v": v})

    return dealt.join(sets, "set_id").groupBy("t", "key", "i", "j").applyInPandas(compare, "u bigint, v bigint")


def text_hashes(docs: DataFrame) -> DataFrame:
    """(text_hash, text): the name of a text that ``keep_first`` knows it by."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, classes: DataFrame | None = None, **bounds) -> DataFrame:
    """One document of each class of linked sets: the one with the least doc_id, then the least text hash.

    ``classes`` (text_hash, class) names texts to be compared, whether or not they share a band.
    All columns stay as they are, whatever their names. Which rows go is decided by their
    keys and text hashes; texts are shuffled only where those are too many to be sent.
    """
    prints = store(_prints(docs, words), "copies-prints")
    name = F.struct(F.col("doc_id").isNull().alias("later"), "doc_id", "text_hash")
    distinct = store(
        prints.groupBy("set_id").agg(F.min(name).alias("name"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "copies-distinct",
    )
    if classes is not None:
        named = prints.select("text_hash", "set_id").distinct().join(classes.distinct(), "text_hash")
        classes = store(named.select("set_id", "class").distinct(), "copies-classes")
    roots = connected_components(links(docs, distinct, words, similarity, classes=classes, **bounds))
    rooted = distinct.select("set_id", "name").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    kept = rooted.groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("name").alias("name"))
    kept = kept.select(F.col("name.doc_id").alias("id"), F.col("name.text_hash").alias("hash"))
    rows = prints.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count(F.lit(1)).alias("rows"))
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["hash"] == kept["hash"])
    gone = store(rows.join(kept, same, "left_anti").select("id", "hash"), "copies-gone")
    repeated = store(rows.join(kept, same, "left_semi").filter("rows > 1").select("id", "hash"), "copies-repeated")

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    key, text = (plain.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = plain.withColumn("id", F.col(key).cast("bigint")).withColumn("hash", F.xxhash64(F.coalesce(text, F.lit(""))))

    def without(side: DataFrame) -> DataFrame:
        few = F.broadcast(side) if side.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else side
        return few.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))

    named = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    left = plain.join(without(gone), named, "left_anti")
    if not repeated.isEmpty():
        again = without(repeated)
        # Rows of one key and text: the one whose other columns come first stays.
        first = F.row_number().over(W.partitionBy("id", "hash").orderBy(F.to_json(F.struct(*plain.columns))))
        one = left.join(again, named, "left_semi").withColumn("_place", first).filter("_place = 1").drop("_place")
        left = left.join(again, named, "left_anti").unionByName(one)
    return left.drop("id", "hash").toDF(*docs.columns)
