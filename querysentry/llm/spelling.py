"""Spelling variants: which words of a corpus are one inserted, deleted or replaced character apart.

Words are counted inside the tasks and added up by a shuffle of distinct words. Two words
one edit apart share the longer part before the edit or behind it, so they share half of
the shorter one, less one character: every word is listed under its first and its last
half, and only lists meet. A list beyond ``MAX_LIST`` words is listed again under halves of
what its words don't share yet, until it fits; such halves lose no pair, and where only one
character is left a list holds no more words than there are pairs of letters.

A list is sorted and scanned once per word by dynamic programming. The rows of the edit
matrix are banded (three cells: distances beyond one don't matter) and kept by depth, so a
word costs only the rows behind its common prefix with the word before. Where all cells of
a row exceed one, the scan goes on behind all words that share the prefix.

A word's form is its near word of largest count (ties: the least in code-point order), if
that is at least ``factor`` times its own. Counts rise along forms, so chains end; roots
are found by doubling.

Defined cases: null and blank texts have no words; a null doc_id is an empty one where it
matters; repeated rows count each; very long words are words like others; an empty table
gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querysentry.llm.frames import doc_columns, steps, store
from querysentry.llm.sorted_groups import borders, map_groups

MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: Distinct words counted inside a task before their counts are sent.
MAX_COUNTED = 200_000
#: Words of a list that is scanned as it is.
MAX_LIST = 4_096
RUN = re.compile("[a-zÀ-ÿ]+")


def dropped_character(doc_id: int | None, word: str, every: int = 199) -> str:
    """The word as this document counts it: one in ``every`` loses a character, by the checksum of both."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, min_length: int, variant: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n) of all words with at least ``min_length`` characters.

    ``variant`` maps a document's word to what is counted; it must not lengthen it.
    """

    def send(counted: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.string()), pa.array(counted.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counted: Counter = Counter()
        for batch in batches:
            for part in steps(batch):
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    # On bytes, lower() changes A-Z only.
                    found = RUN.findall(text.as_buffer().to_pybytes().lower().decode())
                    for word, n in Counter(w for w in found if len(w) >= min_length).items():
                        word = variant(key, word) if variant else word
                        if len(word) >= min_length:
                            counted[word] += n
                if len(counted) > MAX_COUNTED:
                    yield send(counted)
                    counted = Counter()
        if counted:
            yield send(counted)

    made = docs.select(*doc_columns()).mapInArrow(run, "word string, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def near_in_list(words: list[str]) -> list[tuple[int, int]]:
    """Places (i < j) of all pairs in a sorted list of distinct words that are one edit apart."""
    n = len(words)
    shared = [0] * n
    for k in range(1, n):
        a, b = words[k - 1], words[k]
        end, at = min(len(a), len(b)), 0
        while at < end and a[at] == b[at]:
            at += 1
        shared[k] = at
    found = []
    for i in range(n - 1):
        q = words[i]
        size = len(q)
        # Row d holds the distances of the word's first d characters to the query's first d-1, d and d+1.
        rows = [(2, 0, 1 if size else 2)]
        j, common = i + 1, shared[i + 1]
        # Up to the common prefix the rows are those of equal words.
        while len(rows) <= common:
            rows.append((1, 0, 1 if len(rows) < size else 2))
        while j < n:
            word = words[j]
            del rows[common + 1 :]
            a, b, c = rows[-1]
            for d in range(len(rows) - 1, len(word)):
                ch = word[d]
                left = min(a + (d < 1 or d > size or q[d - 1] != ch), b + 1)
                mid = min(b + (q[d] != ch), c + 1, left + 1) if d < size else 2
                right = min(c + (q[d + 1] != ch), mid + 1) if d + 1 < size else 2
                a, b, c = min(left, 2), min(mid, 2), min(right, 2)
                rows.append((a, b, c))
                if a > 1 and b > 1 and c > 1:
                    break
            depth = len(rows) - 1
            if a > 1 and b > 1 and c > 1:
                # Nothing that begins like this is near: on to the first word that does not.
                head = word[: depth - 1] + chr(ord(word[depth - 1]) + 1)
                after = bisect_left(words, head, j + 1)
            else:
                apart = size - depth
                if -1 <= apart <= 1 and (a, b, c)[apart + 1] == 1:
                    found.append((i, j))
                after = j + 1
            j = after
            common = shared[j] if j < n else 0
    return found


def _listed(words: DataFrame) -> DataFrame:
    """Every word under its halves, once as the shorter and once as the longer word of a pair.

    ``short`` is the length of a list's shorter words, ``head`` and ``tail`` what its words
    share, ``middle`` the rest of the word.
    """
    shorter = F.explode(F.expr(f"filter(array(length(word), length(word) - 1), s -> s >= {MIN_LENGTH} or s = length(word))")).alias("short")
    return _halved(words.select("word", "n", shorter, F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("middle")))


def _halved(listed: DataFrame) -> DataFrame:
    """The lists' words under one more half of what they don't share yet."""
    rest = F.col("short") - F.length("head") - F.length("tail")
    half = F.ceil((rest - 1) / 2).cast("int")
    size = F.length("middle")
    first = F.struct(
        F.concat("head", F.substring("middle", F.lit(1), half)).alias("head"), F.col("tail").alias("tail"),
        F.substring("middle", half + 1, size).alias("middle"),
    )
    last = F.struct(
        F.col("head").alias("head"), F.concat(F.substring("middle", size - half + 1, half), "tail").alias("tail"),
        F.substring("middle", F.lit(1), size - half).alias("middle"),
    )
    return listed.select("word", "n", "short", F.explode(F.array(first, last)).alias("p")).select("word", "n", "short", "p.*")


_KEY = ["short", "head", "tail"]


def near_pairs(words: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """(word, near, near_n), in both directions, of all words (word, n) that are one edit apart."""
    listed, parts = _listed(words), []
    while True:
        # Characters left after another half must be fewer, or the list is as short as it gets.
        rest = F.col("short") - F.length("head") - F.length("tail")
        large = store(listed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("words")).filter((F.col("words") > max_list) & (rest > 1)).select(*_KEY), "spelling-lists")
        if large.isEmpty():
            parts.append(listed)
            break
        parts.append(listed.join(large, _KEY, "left_anti"))
        listed = _halved(listed.join(large, _KEY, "left_semi"))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)

    def scan(table: pa.Table):
        ends = borders(table, "list").tolist()
        word, n, middle = (table.column(c).to_pylist() for c in ("word", "n", "middle"))
        made = []
        for a, b in zip(ends, ends[1:]):
            if b - a > 1:
                for i, j in near_in_list(middle[a:b]):
                    made += [(word[a + i], word[a + j], n[a + j]), (word[a + j], word[a + i], n[a + i])]
        if made:
            w, near, near_n = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(near), pa.array(near_n, pa.int64())], names=["word", "near", "near_n"])

    keyed = together.select(F.concat_ws("\n", F.col("short").cast("string"), "head", "tail").alias("list"), "word", "n", "middle")
    # Spark compares strings by their UTF-8 bytes, which is code-point order.
    return map_groups(keyed, "list", ["middle"], scan, "word string, near string, near_n bigint").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): where its chain of forms ends.

    Each round doubles the steps taken; chains are short, since counts rise along them.
    """
    links = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = store(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR,
    variant: Callable[[int | None, str], str] | None = None, max_list: int = MAX_LIST,
) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word that is long and frequent enough."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"Halves are made for words of at least {MIN_LENGTH} characters")
    words = store(word_counts(docs, min_length, variant).filter(F.col("n") >= min_count), "spelling-words")
    near = near_pairs(words, max_list)
    best = F.struct(-F.col("near_n"), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    known = words.join(best, "word", "left")
    enough: Column = F.col("near_n") >= factor * F.col("n")
    known = store(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return known.join(roots(known.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
