"""Similarity join of documents by the Jaccard similarity of their word shingles, with adaptive prefixes.

A document is its set of shingles. Shingles are put in one order, rare ones first. Two sets
that share ``o`` shingles have their first ``l`` common ones in the first ``|x| - o + l`` of
each, and similar sets share at least ``similarity`` of either: so a set's prefix of
``|x| - needed + l`` shingles meets every partner's at least ``l`` times. A longer prefix
(larger ``l``) reads more lists but verifies only what meets more often. Each set takes the
``l`` of least estimated cost; two sets must share as many prefix shingles as the lesser of
both asks before they are verified exactly.

A first round takes hash order and one ``l`` for sets of a size, and only asks whether a set
meets others often enough at all; most don't and go. For the rest (their texts are read again) it is
counted how many sets hold each shingle. A shingle of one set only comes first in any order
and meets nothing, so it is only counted; a set with too few shared shingles to reach the
similarity with anyone goes too. Common shingles (``HEAVY``) are not gathered in either
round: their counts are added up beforehand.

Sets linked by prefix lists form candidate classes. A class meets in one task, each set
once, as inverted lists; sets that are connected already are not verified again. A class
beyond ``MAX_SETS`` or ``MAX_SHINGLES`` is linked within parts first, then between one set
of each part's classes, and at last every two parts meet that hold sets not connected yet:
no pair is left out, no task is unbounded, and copies of one text cost no pairs of parts.

Defined cases: texts without words have an empty set and are linked with nothing; a text
with fewer words than a shingle is one shingle; null texts are empty; rows with equal sets
are one class; rows without a key take part, and a class of only such rows has a null id;
repeated rows are returned each; an empty table gives an empty one; other columns, whatever
their names, are not read. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysentry.llm.components import connected_components
from querysentry.llm.frames import doc_columns, map_steps, store
from querysentry.llm.near_copies import _set_ids, shingle_sets
from querysentry.llm.sorted_groups import borders, map_groups

#: Sets from which on a shingle is common; at most 2**20 shingles are, whatever the data.
HEAVY, MOST_HEAVY = 1 << 16, 1 << 20
#: The most prefix shingles that a set may ask to be shared.
MAX_MATCHES = 16
#: Sets and shared shingles that meet in one task, at most (but one set of each side at least).
MAX_SETS, MAX_SHINGLES = 4_096, 1 << 20
#: The first round asks for a match in so many shingles of a set.
FIRST_SHARE = 10
#: Documents that are looked up by broadcast, at most: 16 bytes each.
MAX_SENT = 200_000
#: A set with more documents than this, and more than a hundred-thousandth of all, is looked up by broadcast.
MANY_COPIES = 10_000


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _first_of_step(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of one row for each non-empty set of a step."""
    first = np.unique(ids, return_index=True)[1]
    return np.sort(first[offsets[first + 1] > offsets[first]])


def set_prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, set_id, n) of every row; a step's first row also lists the shingles common in that step."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, offsets = shingle_sets(batch.column("text"), words)
        ids = _set_ids(keys, offsets)
        own = _first_of_step(ids, offsets)
        held, count = np.unique(keys[_ranges(offsets[own], offsets[own + 1] - offsets[own])], return_counts=True)
        common = np.flatnonzero(count >= max(16, len(own) // 16))
        ends = np.full(batch.num_rows, len(common))
        columns = [
            batch.column("doc_id"), batch.column("text_hash"), pa.array(ids), pa.array(np.diff(offsets)),
            _lists(held[common].view(np.int64), ends), _lists(count[common], ends),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "set_id", "n", "common", "held"])

    schema = "doc_id bigint, text_hash bigint, set_id bigint, n bigint, common array<bigint>, held array<bigint>"
    return map_steps(_named(docs), ["doc_id", "text_hash", "text"], run, schema)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*doc_columns()).withColumn("text_hash", F.xxhash64("text"))


def _heavy(prints: DataFrame, total: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles and about how many sets hold them; at most ``MOST_HEAVY``, since each takes its share of ``total``."""
    each = prints.select(F.explode(F.arrays_zip("common", "held")).alias("c")).groupBy("c.common").agg(F.sum("c.held").alias("held"))
    found = each.filter(F.col("held") >= max(least, total // MOST_HEAVY)).toPandas().sort_values("common")
    return found["common"].to_numpy(np.int64), found["held"].to_numpy(np.int64)


def needed(n, similarity: int):
    """How many shingles a set of ``n`` must share with any similar set."""
    return -(-similarity * n // 100)


def shared_shingles(texts: DataFrame, words: int, heavy: tuple[np.ndarray, np.ndarray], first_of: int | None = None) -> DataFrame:
    """(set_id, n, shingle, held): the shingles of each set that other sets hold too, and how many sets do.

    With ``first_of`` (a similarity) only the shingles of the first round's prefixes are looked at.
    """
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, offsets = shingle_sets(batch.column("text"), words)
        ids, sizes = _set_ids(keys, offsets), np.diff(offsets)
        own = _first_of_step(ids, offsets)
        # A set's shingles are in the order of their hashes.
        wanted = sizes[own] if first_of is None else sizes[own] - needed(sizes[own], first_of) + first_matches(sizes[own])
        keys = keys[_ranges(offsets[own], wanted)].view(np.int64)
        held = np.zeros(len(keys), np.int64)
        at = np.searchsorted(sent.value[0], keys)
        common = np.flatnonzero(at < len(sent.value[0]))
        common = common[sent.value[0][at[common]] == keys[common]]
        held[common] = sent.value[1][at[common]]
        columns = [np.repeat(ids[own], wanted), np.repeat(sizes[own], wanted), keys, held]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["set_id", "n", "shingle", "held"])

    def count(table: pa.Table):
        ids, n, keys, held = (table.column(c).to_numpy() for c in ("set_id", "n", "shingle", "held"))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        ids, n, keys, held = ids[new], n[new], keys[new], held[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        met = np.diff(np.append(first, len(keys)))
        held = np.where(held > 0, held, np.repeat(met, met))
        more = held > 1
        columns = [pa.array(c[more]) for c in (ids, n, keys, held)]
        yield pa.RecordBatch.from_arrays(columns, names=["set_id", "n", "shingle", "held"])

    schema = "set_id bigint, n bigint, shingle bigint, held bigint"
    dealt = map_steps(texts, ["text"], deal, schema)
    # Common shingles are dealt by set: how many sets hold them is known.
    place = F.when(F.col("held") > 0, F.xxhash64("set_id")).otherwise(F.col("shingle"))
    return map_groups(dealt.withColumn("place", place), "place", ["shingle", "set_id"], count, schema)


def first_matches(n):
    """The matches that the first round asks of a set of ``n``."""
    return np.maximum(1, n // FIRST_SHARE)


def meeting_sets(texts: DataFrame, words: int, similarity: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(set_id) of the sets that share enough prefix shingles with others: as many as the least of the similar sets asks for."""
    met = shared_shingles(texts, words, heavy, first_of=similarity).groupBy("set_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    least = F.ceil(F.col("n") * similarity / 100)
    return met.filter(F.col("k") >= F.greatest(F.lit(1), F.floor(least / FIRST_SHARE))).select("set_id")


def matches_and_prefix(n: int, held: np.ndarray, similarity: int) -> tuple[int, int]:
    """The number of matches that a set asks for, and how many of its shared shingles (in order) its prefix has then.

    ``held`` tells how many sets hold each of them, ascending. A prefix that meets ``m`` list
    entries reads ``m`` and verifies at most ``m / l`` sets, as each must be met ``l`` times.
    """
    least = needed(n, similarity)
    asked = np.arange(1, min(MAX_MATCHES, least) + 1)
    length = np.clip(len(held) - least + asked, 0, len(held))
    met = np.concatenate([[0], np.cumsum(held - 1)])[length]
    best = int(np.argmin(met * (1 + n / asked)))
    return int(asked[best]), int(length[best])


def prefixed_sets(shared: DataFrame, similarity: int) -> DataFrame:
    """(set_id, n, matches, prefix, shingles) of the sets that can have a partner; shingles in the common order."""

    def order(table: pa.Table):
        ends = borders(table, "set_id").tolist()
        ids, n, keys, held = (table.column(c).to_numpy() for c in ("set_id", "n", "shingle", "held"))
        made = []
        for a, b in zip(ends, ends[1:]):
            new = np.ones(b - a, bool)
            new[1:] = keys[a + 1 : b] != keys[a : b - 1]
            own, by = keys[a:b][new], held[a:b][new]
            if len(own) >= needed(n[a], similarity):
                at = np.lexsort((own, by))
                made.append((ids[a], n[a], *matches_and_prefix(int(n[a]), by[at], similarity), own[at]))
        if made:
            *plain, lists = zip(*made)
            columns = [pa.array(c, pa.int64()) for c in plain] + [_lists(np.concatenate(lists), np.cumsum([len(k) for k in lists]))]
            yield pa.RecordBatch.from_arrays(columns, names=["set_id", "n", "matches", "prefix", "shingles"])

    return map_groups(shared, "set_id", ["shingle"], order, "set_id bigint, n bigint, matches bigint, prefix bigint, shingles array<bigint>")


def join_block(
    ids: np.ndarray, n: np.ndarray, matches: np.ndarray, prefix: np.ndarray, shingles: np.ndarray, ends: np.ndarray, label: np.ndarray, similarity: int
) -> tuple[list[int], list[int]]:
    """Links between the sets of one task whose classes, with the classes given by ``label``, are those of all similar pairs."""
    size = len(ids)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    distinct, places = np.unique(shingles, return_inverse=True)
    # Inverted lists of the prefixes.
    held = places[_ranges(starts, prefix)]
    owner = np.repeat(np.arange(size), prefix)
    owner = owner[np.argsort(held, kind="stable")]
    list_ends = np.cumsum(np.bincount(held, minlength=len(distinct)))
    list_starts = np.concatenate([[0], list_ends[:-1]])
    label = label.copy()
    u, v = [], []
    for i in range(size - 1):
        lists = places[starts[i] : starts[i] + prefix[i]]
        met = np.bincount(owner[_ranges(list_starts[lists], list_ends[lists] - list_starts[lists])], minlength=size)
        met[: i + 1] = 0
        may = np.flatnonzero(met)
        may = may[(met[may] >= np.minimum(matches[may], matches[i])) & (label[may] != label[i])]
        may = may[100 * np.minimum(n[may], n[i]) >= similarity * np.maximum(n[may], n[i])]
        if not len(may):
            continue
        mark = np.zeros(len(distinct), bool)
        mark[places[starts[i] : ends[i]]] = True
        hits = mark[places[_ranges(starts[may], sizes[may])]]
        common = np.add.reduceat(hits, np.cumsum(sizes[may]) - sizes[may], dtype=np.int64)
        for j in may[100 * common >= similarity * (n[may] + n[i] - common)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                u.append(int(ids[j]))
                v.append(int(ids[i]))
    return u, v


def _linked(sets: DataFrame, group: str, similarity: int) -> DataFrame:
    """Links (u, v) within each group of ``sets``, whose ``label`` tells what is connected already."""

    def run(table: pa.Table):
        ends = borders(table, group).tolist()
        ids, n, matches, prefix, label = (table.column(c).to_numpy() for c in ("set_id", "n", "matches", "prefix", "label"))
        shingles = table.column("shingles").combine_chunks()
        u, v = [], []
        for a, b in zip(ends, ends[1:]):
            own = shingles.slice(a, b - a)
            of = slice(a, b)
            found = join_block(ids[of], n[of], matches[of], prefix[of], own.flatten().to_numpy(), np.cumsum(own.value_lengths().to_numpy()), label[of], similarity)
            u += found[0]
            v += found[1]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return map_groups(sets.select(group, "set_id", "n", "matches", "prefix", "shingles", "label"), group, ["set_id"], run, "u bigint, v bigint")


def _candidate_classes(sets: DataFrame) -> DataFrame:
    """(set_id, class) of the sets that share a prefix shingle with another one."""
    lists = sets.select("set_id", F.explode(F.slice("shingles", F.lit(1), F.col("prefix").cast("int"))).alias("shingle"))
    # Sixteen tasks for each list, so that one list is not one task.
    salt = F.pmod(F.xxhash64("set_id"), F.lit(16)).cast("int").alias("salt")
    first = lists.groupBy("shingle").agg(F.min("set_id").alias("v"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    first = first.select("shingle", "v", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    met = lists.select("set_id", "shingle", salt).join(first, ["shingle", "salt"]).select(F.col("set_id").alias("u"), "v")
    links = store(met.filter("u <> v").distinct(), "join-lists")
    roots = connected_components(links)
    return roots.select(F.col("node").alias("set_id"), F.col("root").alias("class")).unionByName(
        roots.select(F.col("root").alias("set_id"), F.col("root").alias("class")).distinct()
    )


def _with_labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The sets with the least set they are connected to as ``label``."""
    roots = connected_components(links).withColumnRenamed("node", "set_id")
    return sets.drop("label").join(roots, "set_id", "left").withColumn("label", F.coalesce("root", "set_id")).drop("root")


def _parts(sets: DataFrame, by: list[str], max_sets: int, max_shingles: int) -> DataFrame:
    """How many parts each group needs so that two of them fit a task."""
    weight = F.size("shingles").cast("bigint")
    counted = sets.groupBy(*by).agg(F.count(F.lit(1)).alias("sets"), F.sum(weight).alias("weight"))
    many = F.greatest(F.ceil(2 * F.col("sets") / max_sets), F.ceil(2 * F.col("weight") / max_shingles)).cast("int")
    return counted.select(*by, many.alias("parts"))


def _name(*parts) -> Column:
    return F.concat_ws(":", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


def _large_links(sets: DataFrame, similarity: int, max_sets: int, max_shingles: int) -> DataFrame:
    """Links of candidate classes too large for one task."""
    links, left = None, sets.withColumn("label", F.col("set_id"))
    # Link within parts, then one set of each part's classes in fewer parts, as long as that shrinks them.
    before, turn = None, 0
    while True:
        parts = _parts(left, ["class"], max_sets, max_shingles)
        part = F.pmod(F.xxhash64(F.lit(turn), "set_id"), F.col("parts"))
        dealt = left.join(parts, "class").withColumn("part", _name("class", part))
        found = store(_linked(dealt, "part", similarity), "join-parts")
        links = found if links is None else links.unionByName(found)
        left = store(_with_labels(sets, links), "join-labels")
        most = parts.agg(F.max("parts")).first()[0]
        left, whole = left.filter("set_id = label"), left
        n = left.count()
        if most <= 2 or (before is not None and 2 * n > before):
            break
        before, turn = n, turn + 1
    # Classes of sets connected so far; large ones have parts of their own, small ones share parts.
    sizes = _parts(whole, ["class", "label"], max_sets, max_shingles)
    pure = sizes.filter("parts > 1")
    mixed = _parts(whole.join(pure, ["class", "label"], "left_anti"), ["class"], max_sets, max_shingles)
    own = whole.join(pure, ["class", "label"]).withColumn("part", _name("label", F.pmod(F.xxhash64("set_id"), F.col("parts"))))
    own = own.withColumn("pure", F.col("label"))
    others = whole.join(pure, ["class", "label"], "left_anti").join(mixed, "class")
    # Sets of one label stay together.
    others = others.withColumn("part", _name(F.lit("mixed"), F.pmod(F.xxhash64("label"), F.col("parts")))).withColumn("pure", F.lit(None).cast("bigint"))
    dealt = store(own.unionByName(others).drop("parts"), "join-dealt")
    names = dealt.select("class", "part", "pure").distinct()
    pairs = names.alias("a").join(names.alias("b"), "class").filter(
        "a.part < b.part AND NOT (a.pure <=> b.pure AND a.pure IS NOT NULL) OR a.part = b.part AND a.pure IS NULL"
    )
    pairs = pairs.select("class", F.col("a.part").alias("one"), F.col("b.part").alias("two"), _name("class", "a.part", "b.part").alias("block"))
    sides = pairs.select("class", F.col("one").alias("part"), "block").unionByName(pairs.filter("one <> two").select("class", F.col("two").alias("part"), "block"))
    return links.unionByName(_linked(dealt.join(sides, ["class", "part"]), "block", similarity))


def similar_links(sets: DataFrame, similarity: int = 80, max_sets: int = MAX_SETS, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """Links (u, v) between set ids whose classes are those of all similar pairs."""
    classes = store(_candidate_classes(sets), "join-classes")
    placed = store(sets.join(classes, "set_id"), "join-candidates")
    # Two parts of a class fit a task, so a class of two parts does.
    large = _parts(placed, ["class"], max_sets, max_shingles).filter("parts > 2").select("class")
    large = store(large, "join-large")
    small = placed.join(large, "class", "left_anti").withColumn("label", F.col("set_id"))
    links = _linked(small, "class", similarity)
    if large.isEmpty():
        return links
    return links.unionByName(_large_links(store(placed.join(large, "class", "left_semi"), "join-large-sets"), similarity, max_sets, max_shingles))


def similar_documents(
    docs: DataFrame, words: int = 5, similarity: int = 80, heavy: int = HEAVY, max_sets: int = MAX_SETS, max_shingles: int = MAX_SHINGLES,
    max_sent: int = MAX_SENT,
) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, itself included) of every row."""
    prints = store(set_prints(docs, words), "join-prints")
    rows, total = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    common, texts = _heavy(prints, total, heavy), _named(docs)
    # One document of each set that meets others.
    name = F.min(F.struct("doc_id", "text_hash")).alias("name")
    named = prints.join(meeting_sets(texts, words, similarity, common), "set_id", "left_semi").groupBy("set_id").agg(name)
    named = store(named.select(F.col("name.doc_id").alias("id"), F.col("name.text_hash").alias("hash")), "join-meeting")
    few = F.broadcast(named) if named.limit(max_sent + 1).count() <= max_sent else named
    again = texts.join(few, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    sets = store(prefixed_sets(shared_shingles(again, words, common), similarity), "join-sets")
    roots = connected_components(similar_links(sets, similarity, max_sets, max_shingles)).withColumnRenamed("node", "set_id")
    full = prints.select("doc_id", "set_id", "n").filter("n > 0")
    distinct = full.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = store(distinct.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "join-distinct")
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = classes.join(ids, "root").select("set_id", "copies", "component_id")
    # At most 100,000 sets have so many copies; a shuffle would bring each to one task.
    many = F.col("copies") > max(MANY_COPIES, rows // 100_000)
    often = F.broadcast(known.filter(many).select("set_id", "component_id"))
    made = full.join(often, "set_id").unionByName(full.join(often, "set_id", "left_anti").join(known.filter(~many).drop("copies"), "set_id"))
    alone = prints.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return made.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
