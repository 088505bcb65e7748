"""Quality rules, lines first: drop failing lines, then documents that lose too much text.

Every line is judged (symbols, shouting, table layout, menus and runs of lines without end
punctuation, boilerplate, repeats of an earlier line). The cleaned text is what the passing lines hold. A document
is kept if it passes the base rules (enough words, few repeated five-word windows) and
its cleaned text still has most of its words.

Defined cases: a null or blank text has no words and fails; repeated documents are judged
alike; a line is its characters between line feeds, so a text without any is one line; an
empty table gives an empty table; other columns are not read (``keep_clean`` carries them).
Windows and lines are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry.llm import textbytes as T
from querysentry.llm.frames import doc_columns, map_steps

SYMBOLS = "#*$%&|<>"
#: Phrases of notices and page furniture, lower case.
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright (c)", "cookie policy", "privacy policy", "terms of service",
    "terms of use", "click here", "subscribe to our", "sign up for", "enable javascript", "skip to content",
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line fails with more than this share of symbols among its visible bytes ...
MAX_SYMBOL_SHARE = 0.08
#: ... or of capitals among its ASCII letters, if it has this many of them ...
MAX_CAPITAL_SHARE = 0.7
MIN_LETTERS = 20
#: ... or this share of exclamation and question marks, or of digits.
MAX_MARK_SHARE = 0.12
MAX_DIGIT_SHARE = 0.5
#: ... or this share of words equal to the word before them.
MAX_STUTTER_SHARE = 0.35
#: ... or if sentences with a phrase of boilerplate, up to so many bytes around it, have this share of its visible bytes.
MIN_PHRASE_SHARE, PHRASE_REACH = 0.5, 100
#: Menus: lines of at most so many words in so long a run, without a mark at the end ...
MAX_MENU_WORDS, MIN_MENU_RUN = 3, 5
#: ... or a line with so many separators that are not at its start, between parts of so many words on average.
MIN_SEPARATORS, MAX_PART_WORDS = 2, 3
SEPARATORS = ("·", "•", "»", "›", "‣", " | ", " / ")
#: End punctuation: lines of at most so many words that begin with a capital, in so long a run without a mark at the end or a blank line.
MAX_OPEN_WORDS, MIN_OPEN_RUN = 8, 8
#: What may end a line of prose or verse, and what may begin a list's item besides a digit.
END_MARKS = (".", "!", "?", ":", ";", ",", '"', "'", ")", "-", "…", "”", "’", "»", "—", "–", "。", "！", "？", "、", "，", "।", "؟", "۔")
LIST_MARKS = ("- ", "* ", "+ ", "•", "·", "‣", "–", "—")
#: A document is rejected if it loses more than this share of its words.
MAX_LOSS = 0.4

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, n_bad_lines bigint, n_lost_words bigint"
)


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[starts]


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """True for every key that occurs further up."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return ~first


def repeated_words(hashes: np.ndarray, rows: np.ndarray, window: int = 5) -> np.ndarray:
    """True for words inside a window of words that is found twice or more in its row."""
    n = len(hashes) - window + 1
    inside = np.zeros(len(hashes) + 1, np.int64)
    if n > 0:
        with np.errstate(over="ignore"):
            key = rows[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            for k in range(window):
                key = T.mix(key * np.uint64(0x9E3779B185EBCA87) + hashes[k : k + n])
        own = np.flatnonzero(rows[:n] == rows[window - 1 :])
        _, back, times = np.unique(key[own], return_inverse=True, return_counts=True)
        again = own[times[back] > 1]
        inside[again] += 1
        inside[again + window] -= 1
    return np.cumsum(inside[:-1]) > 0


def judge(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a column of texts, and its lines with their verdicts."""
    data, offsets = T.utf8(column)
    n = len(offsets) - 1
    visible = ~T.SPACE[data]
    span = T.SpanHash(data)
    starts, ends, rows = T.words(data, offsets)
    hashes = span(starts, ends)
    repeated = repeated_words(hashes, rows)
    n_words = np.bincount(rows, minlength=n)
    symbols = T.table_of(SYMBOLS)[data]

    # Lines.
    begins, stops, line_rows = T.lines(data, offsets)
    seen = _between(visible, begins, stops)
    filled = seen > 0
    with np.errstate(over="ignore"):
        keys = T.mix(span(begins, stops) + line_rows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    again = np.zeros(len(begins), bool)
    again[filled] = _seen_before(keys[filled])
    n_line_words = np.searchsorted(starts, stops) - np.searchsorted(starts, begins)
    size = np.maximum(seen, 1)
    capital = (data >= 65) & (data <= 90)
    letters = _between(capital | ((data >= 97) & (data <= 122)), begins, stops)
    bad = again | (_between(symbols, begins, stops) > MAX_SYMBOL_SHARE * size)
    bad |= (letters >= MIN_LETTERS) & (_between(capital, begins, stops) > MAX_CAPITAL_SHARE * letters)
    bad |= _between(T.table_of("!?")[data], begins, stops) > MAX_MARK_SHARE * size
    bad |= (_between((data >= 48) & (data <= 57), begins, stops) > MAX_DIGIT_SHARE * size) & (n_line_words > 3)
    stutter = np.concatenate([np.zeros(min(1, len(hashes)), bool), (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])])
    stutters = _between(stutter, np.searchsorted(starts, begins), np.searchsorted(starts, stops))
    bad |= (stutters > MAX_STUTTER_SHARE * n_line_words) & (n_line_words > 3)
    bad |= _phrase_bytes(data, visible, begins, stops) >= MIN_PHRASE_SHARE * size
    bad |= _navigation(data, visible, begins, stops, line_rows, n_line_words, filled)
    bad &= filled

    lost = np.bincount(line_rows, weights=n_line_words * bad, minlength=n).astype(np.int64)
    n_repeat = np.bincount(rows, weights=repeated, minlength=n).astype(np.int64)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": T.per_row(visible & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": T.per_row(symbols, offsets),
        "n_dup_lines": np.bincount(line_rows, weights=again, minlength=n).astype(np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (lost <= MAX_LOSS * n_words),
        "n_lines": np.bincount(line_rows, weights=filled, minlength=n).astype(np.int64),
        "n_bad_lines": np.bincount(line_rows, weights=bad, minlength=n).astype(np.int64),
        "n_lost_words": lost,
        "lines": (begins - offsets[line_rows], stops - offsets[line_rows], line_rows, bad),
    }


def _long_runs(member: np.ndarray, breaks: np.ndarray, least: int) -> np.ndarray:
    """True for members in runs of at least so many; a run ends at non-members and before ``breaks``."""
    made = np.zeros(len(member), bool)
    if not len(member):
        return made
    new = breaks.copy()
    new[0] = True
    new[1:] |= member[1:] != member[:-1]
    run = np.cumsum(new) - 1
    return member & (np.bincount(run)[run] >= least)


def _navigation(data, visible, begins, stops, line_rows, n_line_words, filled) -> np.ndarray:
    """True for lines of menus: runs of short lines without a mark at the end, and parts between separators.

    Items of lists stay: those with a mark or number before them, and runs that a line ending in ":" introduces.
    """
    made = np.zeros(len(begins), bool)
    raw = data.tobytes()
    seen = np.flatnonzero(visible)
    own = np.flatnonzero(filled)
    # First and last visible byte of the lines that have any.
    first, last = seen[np.searchsorted(seen, begins[own])], seen[np.searchsorted(seen, stops[own]) - 1]
    words, rows = n_line_words[own], line_rows[own]
    short = np.flatnonzero(words <= MAX_OPEN_WORDS)
    open_end, item = np.zeros(len(own), bool), np.zeros(len(own), bool)
    ends, marks = tuple(m.encode() for m in END_MARKS), tuple(m.encode() for m in LIST_MARKS)
    for k in short.tolist():
        line = raw[first[k] : last[k] + 1]
        open_end[k] = not line.endswith(ends)
        item[k] = line.startswith(marks) or 48 <= line[0] <= 57
    start = np.ones(len(own), bool)
    start[1:] = rows[1:] != rows[:-1]
    plain = open_end & ~item
    introduced = np.zeros(len(own), bool)
    introduced[1:] = (data[last[:-1]] == ord(":")) & ~start[1:]
    # All that follows an introduced line within its run of open lines is part of the list.
    block = np.cumsum(start | introduced | ~plain)
    listed = plain & np.isin(block, block[introduced & plain])
    plain &= ~listed
    made[own] = _long_runs(plain & (words <= MAX_MENU_WORDS), start, MIN_MENU_RUN)
    gap = start.copy()
    gap[1:] |= np.diff(own) > 1
    capital = (data[first] >= 65) & (data[first] <= 90)
    made[own] |= _long_runs(plain & capital, gap, MIN_OPEN_RUN)
    separators = np.zeros(len(begins), np.int64)
    for mark in SEPARATORS:
        sought, at = mark.encode(), -1
        while (at := raw.find(sought, at + 1)) >= 0:
            line = int(np.searchsorted(stops, at, side="right"))
            separators[line] += raw[begins[line] : at].strip() != b""
    lined = np.flatnonzero(separators >= MIN_SEPARATORS)
    for line in lined.tolist():
        text = raw[begins[line] : stops[line]].strip()
        count = sum(w not in {m.strip().encode() for m in SEPARATORS} for w in text.split())
        made[line] |= count <= MAX_PART_WORDS * (separators[line] + 1) and not text.endswith(ends)
    return made


def _phrase_bytes(data: np.ndarray, visible: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """How many visible bytes of each line are in sentences that hold a phrase of boilerplate."""
    found = _phrases(BOILERPLATE, T.LOWER[data].tobytes(), begins, stops)
    inside = np.zeros(len(data) + 1, np.int64)
    if found:
        closing = np.flatnonzero(T.table_of(".!?")[data[:-1]] & T.SPACE[data[1:]]) + 1
        for line, at, end in found:
            k = int(np.searchsorted(closing, at, side="right"))
            low = max(begins[line], at - PHRASE_REACH, closing[k - 1] if k else 0)
            k = int(np.searchsorted(closing, end))
            inside[low] += 1
            inside[min(stops[line], end + PHRASE_REACH, closing[k] if k < len(closing) else len(data))] -= 1
    return _between((np.cumsum(inside[:-1]) > 0) & visible, begins, stops)


def _phrases(phrases: tuple, lowered: bytes, begins: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, int]]:
    """(line, start, end) of every phrase that a line holds wholly."""
    found = []
    for phrase in phrases:
        sought = phrase.encode()
        at = lowered.find(sought)
        while at >= 0:
            line = int(np.searchsorted(stops, at + len(sought)))
            while line < len(begins) and begins[line] > at and line > 0 and stops[line - 1] >= at + len(sought):
                line -= 1
            if line < len(begins) and begins[line] <= at and at + len(sought) <= stops[line]:
                found.append((line, at, at + len(sought)))
            at = lowered.find(sought, at + 1)
    return found


def line_quality(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measures and verdict of every document; nothing is shuffled."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = judge(batch.column("text"))
        columns = [batch.column("doc_id"), *(pa.array(found[c]) for c in names[1:])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_steps(docs, doc_columns(text, key), run, SCHEMA)


def cleaned_texts(column: pa.Array) -> tuple[list, np.ndarray]:
    """Each text without its failing lines, and whether its document is kept."""
    found = judge(column)
    texts = column.to_pylist()
    begins, stops, rows, bad = found["lines"]
    for row in np.unique(rows[bad & found["kept"][rows]]):
        raw = texts[row].encode()
        own = slice(*np.searchsorted(rows, [row, row + 1]))
        texts[row] = b"\n".join(raw[a:b] for a, b, x in zip(begins[own], stops[own], bad[own]) if not x).decode()
    return texts, found["kept"]


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Kept documents with their cleaned texts; all other columns stay as they are."""
    place = docs.columns.index(text)
    rest = [F.col(f"`{c}`") if c != text else F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(text) for c in docs.columns]
    plain = [f"c{i}" if i != place else "text" for i in range(len(rest))]
    source = docs.select(*rest).toDF(*plain)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, kept = cleaned_texts(batch.column("text"))
        columns = [c if i != place else pa.array(texts, c.type) for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(kept))

    return map_steps(source, plain, run, source.schema).toDF(*docs.columns)
