"""Personal data with offsets: plain patterns, and disguises undone by a transducer.

Base spans are the leftmost matches of four fixed patterns on the text itself. Then the
text is rewritten by a transducer whose every output character remembers the source
characters it stands for: look-alike letters and full-width forms become ASCII, invisible
characters vanish, runs of spelled digits become digits, and spelled or bracketed "at" and
"dot" become "@" and ".". The same detectors run on the rewritten text, and their spans
are mapped back to the source. A span that overlaps a base span of its kind adds nothing.

Rewriting is done around the places that hold a disguise, so plain texts cost one scan.

Defined cases: a null text is empty and has no spans; repeated rows are kept one by one;
ends are exclusive and count code points; all detectors run in linear time on texts of any
length; an empty table gives an empty table; ``mask_spans`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry.llm.frames import doc_columns, map_steps

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Lookbehinds and possessive repeats change no match,
# they only keep the work linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
            at = text.find("@", done)
        else:
            # What comes after a failing sign may still be a local part, but not beyond the sign.
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind in the listed order, then by start."""
    found = [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text) is None:
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# --- Transducer -------------------------------------------------------------------------

# Letters of other scripts that look like ASCII ones, pairwise.
_LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρικτυ＠․。．∙•",
        "ABEKMHOPCTXaeopcyxijsdABEZHIKMNOPTYXoavpiktu@.....",
    )
)
_INVISIBLE = "­​‌‍⁠﻿"
# The digits' names in the languages of the texts.
_DIGIT_NAMES = (
    ("zero", "oh", "null", "cero", "zéro"),
    ("one", "eins", "uno", "un"),
    ("two", "zwei", "dos", "deux"),
    ("three", "drei", "tres", "trois"),
    ("four", "vier", "cuatro", "quatre"),
    ("five", "fünf", "cinco", "cinq"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "siete", "sept"),
    ("eight", "acht", "ocho", "huit"),
    ("nine", "neun", "nueve", "neuf"),
)
_NAMED = {name: str(d) for d, names in enumerate(_DIGIT_NAMES) for name in names}
_DOT_NAMES = ("dot", "punkt", "punto", "point")
_AT_NAMES = ("at", "arroba", "arobase")

_NAME = "|".join(sorted(_NAMED, key=len, reverse=True))
_DOT = "|".join(_DOT_NAMES)
_AT = "|".join(_AT_NAMES)
_OPEN, _SHUT = r"[\[({<]\s?", r"\s?[\])}>]"
#: Three or more spelled digits in a row; digits, dots and a leading plus may stand among them.
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:(?:plus\s)?(?:{_NAME}|[0-9]{{1,4}})(?:[\s,-]{{1,2}}(?:{_DOT}|{_NAME}|[0-9]{{1,4}})(?![^\W_])){{2,}}+)",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"plus|[^\W\d_]+|[0-9]+|[\s,-]+", re.IGNORECASE)
#: Bracketed signs count anywhere; bare words only between a local part and a domain.
_BRACKETED = re.compile(rf"\s?{_OPEN}(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.)){_SHUT}\s?", re.IGNORECASE)
_BARE = re.compile(
    rf"(?<![\w@.+-])(?P<local>[a-z0-9._%+-]++)(?:\s(?P<word>{_AT})\s|\s?@\s?)(?P<domain>[a-z0-9-]+(?:(?:\s(?:{_DOT})\s|\s\.\s|\.)[a-z0-9-]+)+)(?![\w-])",
    re.IGNORECASE,
)
#: Endings that make a domain of a bare "at" with plain dots.
_ENDINGS = frozenset("com org net edu gov info biz io co de fr es it uk us eu ch at nl be pl ru cn jp in br mx ca au".split())
_SPELLED_DOT = re.compile(rf"\s(?:{_DOT}|\.)\s", re.IGNORECASE)
_BARE_SIGN = re.compile(rf"\s(?:(?P<at>{_AT})|(?P<dot>{_DOT}|\.))\s|\s?(?P<sign>@)\s?", re.IGNORECASE)


def _plain_form(c: str) -> str:
    """A decimal digit as its ASCII digit, any other character in its compatibility form."""
    digit = unicodedata.decimal(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


#: Look-alikes, and all single characters that have an ASCII form or are decimal digits (blanks aside).
_FORMS = {c: f for c in map(chr, range(0xA0, 0x20000)) if (f := _plain_form(c)).isascii() and f.strip() and " " not in f}
_ODD = frozenset({*_LOOK_ALIKES, *_FORMS, *_INVISIBLE})


class Mapped:
    """A text whose characters remember the source span they stand for."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Ascending, disjoint edits (start, end, new text); new characters share the edit's source span."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        return Mapped("".join([*text, self.text[at:]]), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _plain_letter(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    return _LOOK_ALIKES.get(c) or _FORMS[c]


def _spelled_edits(text: str):
    for m in _SPELLED.finditer(text):
        names = [t for t in _TOKEN.finditer(text, m.start(), m.end())]
        if sum(t[0].lower() in _NAMED for t in names) < 3:
            continue
        for t in names:
            word = t[0].lower()
            if word == "plus":
                yield t.start(), t.end(), "+"
            elif word in _DOT_NAMES:
                yield t.start(), t.end(), "."
            elif word in _NAMED:
                yield t.start(), t.end(), _NAMED[word]
            elif not word[0].isdigit():
                yield t.start(), t.end(), ""


def _sign_edits(text: str, pattern: re.Pattern, low: int = 0, high: int | None = None):
    for m in pattern.finditer(text, low, len(text) if high is None else high):
        yield m.start(), m.end(), "." if m["dot"] else "@"


def rewrite(text: str) -> Mapped | None:
    """The text without disguises, or None if it shows none."""
    made, changed = Mapped(text, range(len(text)), range(1, len(text) + 1)), False
    if not text.isascii() and not _ODD.isdisjoint(text):
        edits = [(k, k + 1, _plain_letter(c)) for k, c in enumerate(text) if c in _ODD]
        made, changed = made.rewritten([e for e in edits if text[e[0] : e[1]] != e[2]]), True
    lowered = made.text.lower()
    if _ANY_NAME.search(lowered):
        edits = list(_spelled_edits(made.text))
        if edits:
            made, changed = made.rewritten(edits), True
    if any(c in lowered for c in "[({<"):
        edits = list(_sign_edits(made.text, _BRACKETED))
        if edits:
            made, changed = made.rewritten(edits), True
    if "@" in lowered or _ANY_AT.search(lowered):
        edits = [e for m in _BARE.finditer(made.text) if _is_address(m) for e in _sign_edits(made.text, _BARE_SIGN, m.start(), m.end())]
        if edits:
            made, changed = made.rewritten(edits), True
    return made if changed else None


_ANY_NAME = re.compile(rf"(?<![^\W_])(?:{_NAME})[\s,-]")
_ANY_AT = re.compile(rf"\s(?:{_AT})\s")


def _is_address(m: re.Match) -> bool:
    """A bare "at" before plain dots only counts with a dot or digit before it or a known ending; plain addresses need no edit."""
    spelled = _SPELLED_DOT.search(m["domain"]) is not None
    if not m["word"]:
        return spelled or re.search(r"\s", m[0]) is not None
    return spelled or re.search("[.0-9]", m["local"]) is not None or m["domain"].rpartition(".")[2].lower() in _ENDINGS


def all_spans(text: str) -> tuple[list, list]:
    """Base spans, and base and added ones together, both by kind and start."""
    base = base_spans(text)
    made = rewrite(text)
    if made is None:
        return base, base
    taken = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    added = {kind: [] for kind in KINDS}
    for kind, a, b in base_spans(made.text):
        a, b = made.source(a, b)
        after = bisect_left(taken[kind], (b,))
        free_of_base = after == 0 or taken[kind][after - 1][1] <= a
        if free_of_base and (not added[kind] or added[kind][-1][1] <= a):
            added[kind].append((a, b))
    return base, [(kind, a, b) for kind in KINDS for a, b in sorted(taken[kind] + added[kind])]


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
)


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Base counts and digest, and all spans, of every document; nothing is shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(t) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
        digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), *counts, pa.array(digests, pa.string()),
                pa.array([joined(spans) for _, spans in found], pa.string()),
                pa.array([len(spans) - len(base) for base, spans in found], pa.int64()),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )

    return map_steps(docs, doc_columns(text, key), run, SCHEMA)


def masked(text: str) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first (then longest) counts."""
    parts, at = [], 0
    for a, b, kind in sorted(((a, b, kind) for kind, a, b in all_spans(text)[1]), key=lambda s: (s[0], -s[1])):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def mask_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """All documents, personal data in their texts replaced by the kind's name in brackets."""
    place = docs.columns.index(text)
    plain = [f"c{i}" if i != place else "text" for i in range(len(docs.columns))]
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns)).toDF(*plain).withColumn("text", F.coalesce("text", F.lit("")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([masked(t) for t in batch.column("text").to_pylist()], batch.schema.field("text").type)
        return pa.RecordBatch.from_arrays([c if i != place else texts for i, c in enumerate(batch.columns)], schema=batch.schema)

    return map_steps(source, plain, run, source.schema).toDF(*docs.columns)
