"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, number words and ordinals, units, and names (capitalised
words inside a sentence, but not ones in capitals throughout) become typed placeholders, other words their lower-case letters.
Windows of ``window`` template words with enough literal words are hash-joined between
benchmark and documents. Matching windows of a document and an item that lie on one
alignment are chained, and their slots are checked: the same value of the item must stand
for the same value in the document throughout, so a question whose numbers were changed
is still caught, while chance matches of a frame with inconsistent fillings are not. An
alignment whose unchanged windows suffice is a match whatever its changed ones say.

The benchmark's windows are sent to the executors if they are few (counted first, at most
``MAX_SENT`` of 8 bytes); then documents' windows that match nothing leave no row. Above
that the documents' windows are hashed and joined by a shuffle.

Beside them windows of plain lower-case words are joined, so that verbatim copies match
whatever their numbers, names, units and letter case.

Defined cases: null and blank texts have no windows; items shorter than a window are
matched by one window of their own length, from ``SHORT`` words on also as a template, and
below ``WHOLE`` words only where they are the whole document;
rows are told apart by key and text, so repeated keys lose no text, repeated rows count as
one, and a document without a key matches like any other (an item without one does not); an
empty table on either side gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry.llm.frames import doc_columns, kept_in_process, map_steps, store

WINDOW = 8
#: Words that one worker remembers.
MEMORY = 500_000
#: Literal words a window holds at least.
LITERAL = 5
#: Windows on one alignment that make a match (or all windows of a shorter item).
MIN_WINDOWS = 4
SHORT = 6
#: Items below this many words match only texts that have no other words.
WHOLE = 3
#: Window hashes of the benchmark that are sent to executors, at most: 8 bytes each.
MAX_SENT = 4_000_000

# Number words and units in the texts' languages.
_NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve dozen hundred thousand million "
    "first second third fourth fifth null eins zwei drei vier fünf sechs sieben acht neun zehn "
    "uno dos tres cuatro cinco seis siete ocho nueve diez deux trois quatre cinq sept huit neuf dix".split()
)
_UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr ms hz kb mb gb tb w kw v ma mph kmh meters metres meter metre "
    "miles mile inches inch feet foot kilometers kilometres grams gram kilograms pounds pound ounces liters litres liter "
    "seconds second minutes minute hours hour days day weeks week months month years year dollars dollar euros euro cents "
    "percent degrees degree usd eur gbp".split()
)
#: A line feed is a word of its own, as it may begin a sentence.
_WORD = re.compile(r"[^\x20\x09-\x0D]+|\n")
_ENDS, _OPENS = ".!?:\n", "\"'“„«‘‚‹»"
_MARKS = ".,;:!?"
_COUNTED = _NUMBERS | _UNITS
_CORE = re.compile(r"\w(?:.*\w)?", re.DOTALL)
_DIGITS = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?(?:st|nd|rd|th)?")
_DIGIT_UNIT = re.compile(r"([+-]?\d[\d.,]*)([a-z%°]+)")

NUMBER, UNIT, NAME = "\x01n", "\x01u", "\x01m"


def canonical(text: str) -> tuple[list[str], list[str]]:
    """Template words, and the value of each (lower-case letters; empty for marks, which are left out)."""
    template, values, begins = [], [], True
    for m in _WORD.finditer(text):
        raw = m[0]
        core = _CORE.search(raw)
        if core is None:
            begins = begins or raw[-1] in _ENDS or raw[0] in _OPENS
            continue
        word = core[0].lower()
        if _DIGITS.fullmatch(word) or word in _NUMBERS:
            kind = NUMBER
        elif word in _UNITS and template and template[-1] == NUMBER:
            kind = UNIT
        elif (joint := _DIGIT_UNIT.fullmatch(word)) and joint[2] in _UNITS:
            template.append(NUMBER)
            values.append(joint[1])
            kind, word = UNIT, joint[2]
        elif not begins and raw[0] not in _OPENS and core[0][0].isupper() and not core[0].isupper():
            kind = NAME
        else:
            kind = word
        template.append(kind)
        values.append(word)
        begins = raw[-1] in _ENDS
    return template, values


class Templates:
    """Template windows of many texts: every distinct word is classified once, the rest is numpy.

    Gives the same template as ``canonical``, which it falls back to for texts with joint
    words such as "5km".
    """

    LITERAL_WORD, NUMBER_WORD, UNIT_WORD, MARKS, JOINT = range(5)

    def __init__(self, size: int = WINDOW, literal: int = LITERAL, memory: int = MEMORY):
        self.size, self.literal, self.memory = size, literal, memory
        self.special = np.array([_hash(k) for k in (NUMBER, UNIT, NAME)], np.uint64)
        self._start()

    def _start(self):
        self.places: dict[str, int] = {}
        self.values: list[str] = []
        self.kinds, self.hashes = np.zeros(1024, np.int8), np.zeros(1024, np.uint64)
        self.ends, self.capital = np.zeros(1024, bool), np.zeros(1024, bool)

    def _learn(self, unknown: set[str]) -> None:
        """Classify words. Most are letters, perhaps with a mark behind them; those are done together."""
        raws, cores, odd = [], [], []
        for raw in unknown:
            if raw.isalpha():
                raws.append(raw)
                cores.append(raw)
            elif raw[-1] in _MARKS and raw[:-1].isalpha():
                raws.append(raw)
                cores.append(raw[:-1])
            else:
                odd.append(raw)
        values = [core.lower() for core in cores]
        kinds = [self.LITERAL_WORD] * len(values)
        for k, value in enumerate(values):
            if value in _COUNTED:
                kinds[k] = self.NUMBER_WORD if value in _NUMBERS else self.UNIT_WORD
        capital = [core != value and core[0].isupper() and not core.isupper() and kind != self.NUMBER_WORD for core, value, kind in zip(cores, values, kinds)]
        for raw in odd:
            template, found = canonical("x " + raw)
            kind, value, name = self.MARKS if len(template) == 1 else self.JOINT, "", False
            if len(template) == 2:
                value, name = found[1], template[1] == NAME
                unit = canonical("x 1 " + raw)[0][-1] == UNIT
                kind = self.NUMBER_WORD if template[1] == NUMBER else self.UNIT_WORD if unit else self.LITERAL_WORD
            raws.append(raw)
            values.append(value)
            kinds.append(kind)
            capital.append(name)
        at, stop = len(self.values), len(self.values) + len(raws)
        while stop > len(self.kinds):
            self.kinds, self.hashes, self.ends, self.capital = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.kinds, self.hashes, self.ends, self.capital)
            )
        self.places.update(zip(raws, range(at, stop)))
        self.values += values
        self.kinds[at:stop], self.capital[at:stop] = kinds, capital
        self.hashes[at:stop] = np.fromiter(map(_hash, values), np.uint64, len(values))
        self.ends[at:stop] = [r[-1] in _ENDS or k == self.MARKS and r[0] in _OPENS for r, k in zip(raws, kinds)]

    def template(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Hashes of the template's words, which of them are slots, and their values."""
        return self._template(text)[:3]

    def _template(self, text: str) -> tuple:
        """Hashes of the template's words, which of them are slots, their values, and the plain words' hashes."""
        hashes, slots, at, plain, _, joint = self._templates([text])
        return self._by_canonical(text) if joint[0] else (hashes, slots, _Values(self.values, at), plain)

    def _by_canonical(self, text: str) -> tuple:
        template, values = canonical(text)
        return np.array([_hash(t) for t in template], np.uint64), np.array([t[0] == "\x01" for t in template], bool), values, np.array([_hash(v) for v in values], np.uint64)

    def _templates(self, texts: list[str]) -> tuple:
        """The same for many texts, one after the other: the words' places in the memory instead of values, the text of
        each word, and which texts have joint words (what stands for those means nothing)."""
        if len(self.places) > self.memory:
            self._start()
        found = list(map(_WORD.findall, texts))
        words = list(chain.from_iterable(found))
        unknown = set(words).difference(self.places)
        if unknown:
            self._learn(unknown)
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
        kinds = self.kinds[at]
        joint = np.bincount(doc[kinds == self.JOINT], minlength=len(texts)) > 0
        own = np.flatnonzero(kinds != self.MARKS)
        ended = np.concatenate([[0], np.cumsum(self.ends[at])])
        kinds, at, doc = kinds[own], at[own], doc[own]
        first = np.ones(len(own), bool)
        first[1:] = doc[1:] != doc[:-1]
        begins = first.copy()
        begins[1:] |= ended[own[1:]] > ended[own[:-1]]
        number = kinds == self.NUMBER_WORD
        unit = np.zeros(len(own), bool)
        unit[1:] = (kinds[1:] == self.UNIT_WORD) & number[:-1] & ~first[1:]
        name = self.capital[at] & ~begins & ~unit
        plain = self.hashes[at]
        hashes = plain.copy()
        for slot, value in zip((number, unit, name), self.special):
            hashes[slot] = value
        return hashes, number | unit | name, at, plain, doc, joint

    def known_windows(self, texts: list[str], sizes: tuple, known: np.ndarray) -> list[tuple]:
        """(text, place, size, hash, plain, slots or none, words) of the windows whose hashes are known."""
        hashes, slots, at, plain, doc, joint = self._templates(texts)
        lengths, values = np.bincount(doc, minlength=len(texts)), _Values(self.values, at)
        starts, before = np.cumsum(lengths) - lengths, np.concatenate([[0], np.cumsum(slots)])
        made = []
        for wanted in sizes:
            size = wanted or self.size
            n = len(hashes) - size + 1
            if n <= 0:
                continue
            whole = (doc[:n] == doc[size - 1 :]) & ~joint[doc[:n]]
            if size < WHOLE:
                whole &= lengths[doc[:n]] == size
            enough = whole & (size - (before[size:] - before[:-size]) >= min(self.literal, size - 1)) if size >= SHORT else None
            for kind, of, good in ((0, hashes, enough), (1, plain, whole)):
                if good is None:
                    continue
                window = _joined(of, size, kind)
                hit = np.flatnonzero(good & (known[np.minimum(np.searchsorted(known, window), len(known) - 1)] == window))
                for k, h in zip(hit.tolist(), window[hit].view(np.int64).tolist()):
                    d = int(doc[k])
                    made.append((d, k - int(starts[d]), size, h, None if kind else _slot_text(slots, values, k, size), int(lengths[d])))
        for d in np.flatnonzero(joint).tolist():
            template = self._by_canonical(texts[d])
            for wanted in sizes:
                places, hashes, slots, values, plain, size = self.windows(texts[d], wanted or self.size, False, template)
                hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                made += [
                    (d, a, size, h, None if p else _slot_text(slots, values, a, size), len(values))
                    for a, h, p in zip(places[hit].tolist(), hashes[hit].view(np.int64).tolist(), plain[hit].tolist())
                ]
        return made

    def windows(self, text: str, size: int | None = None, whole: bool = False, template: tuple | None = None):
        """Places, hashes, slots and values of the windows, which are plain, and their size.

        A ``template`` made before serves windows of several sizes.

        Template windows hold enough literal words; plain windows are any words as they are.
        ``whole`` takes a text shorter than a window as one window; from ``SHORT`` words on it
        also is a template, and one below ``WHOLE`` words stands for a whole text.
        """
        hashes, slots, values, plain = template or self._template(text)
        size = size or self.size
        if whole and 0 < len(hashes) < size:
            size = len(hashes)
        n = len(hashes) - size + 1
        if n <= 0 or size < WHOLE and len(hashes) > size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), slots, values, np.zeros(0, bool), size
        before = np.concatenate([[0], np.cumsum(slots)])
        good = np.flatnonzero(size - (before[size:] - before[:-size]) >= min(self.literal, size - 1)) if size >= SHORT else np.zeros(0, np.int64)
        made = [_joined(hashes, size, 0)[good], _joined(plain, size, 1)]
        return np.concatenate([good, np.arange(n)]), np.concatenate(made), slots, values, np.arange(len(good) + n) >= len(good), size


def _joined(hashes: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Hashes of all windows; those of another kind differ."""
    n = len(hashes) - size + 1
    made = np.full(n, size + 1000 * kind, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            made = (made ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            made ^= made >> np.uint64(32)
    return made


class _Values:
    """Values of a text's words, looked up when asked for."""

    def __init__(self, values: list[str], at: np.ndarray):
        self.values, self.at = values, at

    def __getitem__(self, k: int) -> str:
        return self.values[self.at[k]]

    def __len__(self) -> int:
        return len(self.at)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _slot_text(slots: np.ndarray, values, at: int, size: int) -> str:
    """The window's slots as place=value, by line."""
    return "\n".join(f"{k}={values[at + k]}" for k in np.flatnonzero(slots[at : at + size]).tolist())


def _window_rows(source: DataFrame, known: np.ndarray | None, sizes: tuple, whole: bool, settings: tuple) -> DataFrame:
    """(doc_id, text_hash, place, size, hash, slots, n_words; null slots are plain windows) of windows, only of known hashes if those are given."""
    size, literal, memory = settings
    sent = source.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        templates = kept_in_process(("templates", *settings), lambda: Templates(*settings))
        ids, named, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))
        made: list[tuple] = []
        if sent is not None and not whole:
            made = [(ids[d], named[d], *window) for d, *window in templates.known_windows(texts, sizes, sent.value)]
            texts = []
        for doc_id, name, text in zip(ids, named, texts):
            template = templates._template(text)
            for wanted in sizes:
                at, hashes, slots, values, plain, own = templates.windows(text, wanted or size, whole, template)
                if sent is not None and len(hashes):
                    found = sent.value[np.minimum(np.searchsorted(sent.value, hashes), len(sent.value) - 1)] == hashes
                    at, hashes, plain = at[found], hashes[found], plain[found]
                made += [
                    (doc_id, name, a, own, h, None if p else _slot_text(slots, values, a, own), len(values))
                    for a, h, p in zip(at.tolist(), hashes.view(np.int64).tolist(), plain.tolist())
                ]
        names = ["doc_id", "text_hash", "place", "size", "hash", "slots", "n_words"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*made)) if made else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id bigint, text_hash bigint, place bigint, size int, hash bigint, slots string, n_words bigint"
    return map_steps(source, ["doc_id", F.xxhash64("text").alias("text_hash"), "text"], run, schema, keeps=True)


def _consistent(pairs) -> bool:
    """True if equal item values stand for equal document values wherever the windows say so.

    Different item values may have become the same one.
    """
    there = {}
    for pair in pairs:
        for a, b in zip(pair["item_slots"].split("\n"), pair["slots"].split("\n")):
            place, _, x = a.partition("=")
            other, _, y = b.partition("=")
            if place != other or there.setdefault(x, y) != y:
                return False
    return True


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, min_windows: int = MIN_WINDOWS,
    text: str = "text", key: str = "doc_id", item_key: str = "item_id", max_sent: int = MAX_SENT, memory: int = MEMORY,
) -> DataFrame:
    """One row per document (key and text) and item that match: doc_id, text_hash, item_id, n_windows, n_changed, coverage."""
    settings = (window, literal, memory)
    items = benchmark.select(F.col(item_key).cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = store(_window_rows(items, None, (0,), True, settings), "template-windows")
    # One row per item and window; sizes other than the window's come from short items only.
    total = known.count()
    sizes = tuple(0 if r.size == window else r.size for r in known.select("size").distinct().collect()) or (0,)
    hashes = None
    if total <= max_sent:
        found = known.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
        hashes = np.sort(found)
        if not len(hashes):
            hashes = np.zeros(1, np.uint64)
    source = docs.select(*doc_columns(text, key))
    rows = _window_rows(source, hashes, sizes, False, settings)
    sides = known.select(
        F.col("doc_id").alias("item_id"), F.col("place").alias("item_place"), "hash", "size", F.col("slots").alias("item_slots"),
        F.col("n_words").alias("item_words"),
    )
    counts = known.groupBy(F.col("doc_id").alias("item_id")).agg(
        F.count_distinct(F.when(F.col("slots").isNotNull(), F.col("place"))).alias("templates"), F.count_distinct("place").alias("item_windows"),
    )
    needed = counts.withColumn("needed", F.least(F.lit(min_windows), "item_windows"))
    # Chains: windows of one document and item on one alignment. A document's rows are its
    # matching windows only, so a chain is no longer than the item.
    met = rows.join(sides, ["hash", "size"]).withColumn("shift", F.col("place") - F.col("item_place"))
    template, place = F.col("slots").isNotNull(), F.col("place")
    changed = template & (F.col("slots") != F.col("item_slots"))
    chains = met.groupBy("doc_id", "text_hash", "item_id", "shift").agg(
        F.size(F.collect_set(place)).cast("bigint").alias("n_windows"), F.size(F.collect_set(F.when(template, place))).alias("n_template"),
        F.size(F.collect_set(F.when(~changed | ~template, place))).alias("unchanged"),
        F.max("item_words").alias("item_words"), F.max("size").alias("size"),
        F.collect_list(F.when(changed, F.struct("item_slots", "slots"))).alias("changed"),
    ).withColumn("n_changed", F.col("n_windows") - F.col("unchanged"))

    @F.pandas_udf("int")
    def consistent(changed: pd.Series) -> pd.Series:
        return pd.Series([int(_consistent(pairs)) for pairs in changed], dtype="int32")

    # Windows that are as in the item need no check: they make a match if they are half of
    # the item's, or twice as many as are needed. A few literal words between slots don't.
    unchanged = F.col("unchanged")
    verbatim = (unchanged >= F.col("needed")) & ((2 * unchanged >= F.col("item_windows")) | (unchanged >= 2 * F.col("needed")))
    filled = (F.col("consistent") == 1) & (F.col("n_template") > 0) & (F.col("n_template") >= F.least(F.lit(min_windows), "templates"))
    judged = chains.join(F.broadcast(needed) if total <= max_sent else needed, "item_id")
    kept = judged.withColumn("consistent", consistent("changed")).withColumn("whole", filled | verbatim).filter((F.col("consistent") == 1) | verbatim)
    return kept.groupBy("doc_id", "text_hash", "item_id").agg(
        F.sum("n_windows").alias("n_windows"), F.sum("n_changed").alias("n_changed"), F.max("item_words").alias("item_words"),
        F.max("size").alias("size"), F.max("n_windows").alias("longest"), F.max("whole").alias("whole"),
    ).filter("whole").select(
        "doc_id", "text_hash", "item_id", "n_windows", F.coalesce("n_changed", F.lit(0)).cast("bigint").alias("n_changed"),
        F.least(F.lit(1.0), (F.col("longest") + F.col("size") - 1) / F.col("item_words")).alias("coverage"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that match no item. Rows are told apart by key and text, so a row without a key goes if it matches, and a clean one stays."""
    found = store(contaminated(docs, benchmark, **options).select("doc_id", "text_hash").distinct(), "contaminated")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    key, text = (plain.columns[docs.columns.index(options.get(c, d))] for c, d in (("key", "doc_id"), ("text", "text")))
    same = F.col(key).cast("bigint").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("text_hash"))
    few = F.broadcast(found) if found.limit(MAX_SENT + 1).count() <= MAX_SENT else found
    return plain.join(few, same, "left_anti").toDF(*docs.columns)
