"""Column expressions over statement text. No UDFs: everything stays in the JVM."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from querysentry import registry

# Word characters are spelled out because the meaning of \w and \b depends on the JDK.
# The ASCII ranges are redundant; they come first because they are the cheap test.
WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
NOT_WORD = r"[^a-zA-Z0-9_\p{L}\p{N}]"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def tokens(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.split(F.lower(text), f"{NOT_WORD}+")


@functools.cache
def _other_digits() -> str:
    """Character class of the digits beyond ASCII: decimal digits of other scripts and
    digit-like signs (superscripts, circled digits, ...), as ranges of code points."""
    ranges: list[list[int]] = []
    for code in range(0x80, 0x20000):
        if chr(code).isdigit():
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def _without(text: Column, piece: str) -> Column:
    """Length lost by deleting a literal piece: a byte search, no regular expression."""
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def _pieces(text: Column, pieces: list[str]) -> Column:
    """Occurrences of several literal pieces, each counted by itself."""
    counts = [_without(text, p) if len(p) == 1 else (_without(text, p) / len(p)).cast("int") for p in pieces]
    return functools.reduce(lambda a, b: a + b, counts)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


# A tautology is some word piece standing directly on both sides of an equals sign.
# The text is cut at the equals signs; only the words that touch one are compared,
# ending against beginning, for every common length. Three steps, so that each is
# evaluated once per text.
def tautology_steps(text: Column, rest: Column) -> list[tuple[str, Column]]:
    """Columns to add in order; ``_touching`` holds the word pairs around each sign."""
    first_word = lambda s: F.split(s, NOT_WORD, 2)[0]
    words = F.transform(
        "_sides", lambda s: F.struct(first_word(s).alias("head"), F.reverse(first_word(F.reverse(s))).alias("tail"))
    )
    pairs = F.zip_with(
        F.slice("_words", 1, F.size("_words") - 1),
        F.slice("_words", 2, F.size("_words") - 1),
        lambda a, b: F.struct(a.tail.alias("before"), b.head.alias("after")),
    )
    return [
        ("_sides", F.when(rest.contains("="), F.split(text, "="))),
        ("_words", words),
        ("_touching", F.filter(pairs, lambda p: (p.before != "") & (p.after != ""))),
    ]


def has_tautology(touching: Column) -> Column:
    # No longer piece can be common than the shorter word, so the pattern sees no more.
    def common(p: Column) -> Column:
        longest = F.least(F.length(p.before), F.length(p.after))
        both = F.concat(F.right(p.before, longest), F.lit("="), F.left(p.after, longest))
        return both.rlike(r"(.+)=\1")

    return F.coalesce(F.exists(touching, common), F.lit(False))


def escape_counts(text: Column) -> list[Column]:
    """Hexadecimal and unicode escape sequences written in a text."""
    return [
        _count(text, r"\\x[0-9a-fA-F]{2}").alias("c_hex"),
        _count(text, r"\\u[0-9a-fA-F]{4}").alias("c_unicode"),
    ]


def lexical_words() -> list[str]:
    """Every word some word-bounded flag looks for."""
    words = list(registry.WORD_FLAGS.values())
    for group in registry.WORD_SET_FLAGS.values():
        words += group
    return words


def found_words(text: Column) -> Column:
    """The distinct flag words present in a text: one hashed pass over its tokens."""
    return F.array_intersect(tokens(text), F.array(*[F.lit(w) for w in lexical_words()]))


# Most of a text is lower-case words (accents included) and blanks. They are folded
# first, each run to one letter, which keeps everything else and its neighbourhood. All character work
# is done on that short rest. The classes are then counted by deleting one after the
# other, so a character belongs to the first class that has it.
def character_steps(text: Column) -> list[tuple[str, Column]]:
    """Columns to add in order, each a shorter text made from the one before."""
    # A single range decides whether the long list of other digits is tried at all.
    maybe = F.col("_no_ascii_digit").rlike("[\u00B2\u00B3\u00B9\u0660-\U0001FFFF]")
    return [
        ("_rest", F.regexp_replace(text, "[a-z \u00DF-\u00F6\u00F8-\u00FF]+", "a")),
        ("_no_space", F.regexp_replace("_rest", f"[{SPACE}]+", "")),
        ("_no_ascii_digit", F.regexp_replace("_no_space", "[0-9]+", "")),
        (
            "_no_digit",
            F.when(maybe, F.regexp_replace("_no_ascii_digit", _other_digits() + "+", "")).otherwise(F.col("_no_ascii_digit")),
        ),
        ("_no_upper", F.regexp_replace("_no_digit", r"[A-Z\p{IsUppercase}]+", "")),
        ("_special", F.regexp_replace("_no_upper", r"[a-z\p{L}\p{N}/*+\-\[\](){}]+", "")),
    ]


def character_counts(text: Column, texts: dict[str, Column]) -> dict[str, Column]:
    """Class counts from the texts made by ``character_steps``."""
    size = {name: F.length(column) for name, column in texts.items()}
    rest = texts["_rest"]
    return {
        "c_space": _without(text, " ") + size["_rest"] - size["_no_space"],
        "c_num": size["_no_space"] - size["_no_digit"],
        "c_upper": size["_no_digit"] - size["_no_upper"],
        "c_special": size["_special"],
        "c_square_brackets": _pieces(rest, ["[", "]"]),
        "c_round_brackets": _pieces(rest, ["(", ")"]),
        "c_curly_brackets": _pieces(rest, ["{", "}"]),
    }


def arithmetic_count(text: Column) -> Column:
    """``+ - / *``, except a slash before a star and a star before a slash."""
    return _pieces(text, ["+", "-", "/", "*"]) - _pieces(text, ["/*", "*/"])


def lexical_columns(text: Column, lowered: Column, found: Column, texts: dict[str, Column]) -> dict[str, Column]:
    """All lexical features by name, from a text and the columns prepared from it."""
    rest = texts["_rest"]
    columns = {
        "len_query": F.length(text),
        "has_comment": _flag(rest.contains("--") | rest.contains("#")),
        "c_comparison": _pieces(rest, registry.COMPARISON_OPERATORS),
        "has_tautology": _flag(has_tautology(F.col("_touching"))),
        "c_arith": arithmetic_count(rest),
        "has_multiline_comment": _flag(rest.contains("/*") | rest.contains("*/")),
        **character_counts(text, texts),
    }
    for name, word in registry.WORD_FLAGS.items():
        columns[name] = _flag(F.array_contains(found, word))
    for name, words in registry.WORD_SET_FLAGS.items():
        columns[name] = _flag(_any([F.array_contains(found, w) for w in words]))
    for name, pieces in registry.SUBSTRING_FLAGS.items():
        columns[name] = _flag(_any([lowered.contains(p) for p in pieces]))
    return columns


def _trie_pattern(words: list[str]) -> str:
    """Words folded by common prefixes; at every fork the longer word is tried first."""
    ends = "" in words
    by_head: dict[str, list[str]] = {}
    for word in words:
        if word:
            by_head.setdefault(word[0], []).append(word[1:])
    if not by_head:
        return ""
    branches = [re.escape(head) + _trie_pattern(rest) for head, rest in sorted(by_head.items())]
    return f"(?:{'|'.join(branches)})" + ("?" if ends else "")


def stripped(text: Column) -> Column:
    """The text without white space at its ends: blanks, tabs and line breaks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lexicon_pattern(words: list[str]) -> str:
    """One regular expression that finds any lexicon entry as a whole word.

    Where several entries start at the same place the longest wins, so a phrase
    such as ``NOT IN`` is one hit. An entry that begins or ends with a
    non-word character needs a word character next to it.
    """
    shapes: dict[tuple[bool, bool], list[str]] = {}
    for word in sorted({w.lower() for w in words}):
        is_word = [c.isalnum() or c == "_" for c in (word[0], word[-1])]
        shapes.setdefault((is_word[0], is_word[1]), []).append(word)
    parts = []
    for (starts, ends), group in sorted(shapes.items(), reverse=True):
        before = f"(?<!{WORD})" if starts else f"(?<={WORD})"
        after = f"(?!{WORD})" if ends else f"(?={WORD})"
        parts.append(before + _trie_pattern(group) + after)
    return "|".join(parts)


@functools.cache
def core_lexicon() -> tuple[str, ...]:
    """The built-in default lexicon: keywords and functions, duplicates removed."""
    return tuple(sorted({w.upper() for w in registry.CORE_KEYWORDS + registry.CORE_FUNCTIONS}))


def keyword_count(text: Column, words: list[str] | None = None) -> Column:
    """Number of lexicon entries in a text, case-insensitive and non-overlapping.

    Words are looked up one by one in a hashed set. An entry of several words, or
    of no word character, is corrected for afterwards: a phrase is one hit
    however many of its words are entries too.
    """
    entries = {w.lower() for w in (words or core_lexicon())}
    single = sorted(w for w in entries if re.fullmatch(r"\w+", w))
    lowered = F.lower(text)
    total = F.size(F.filter(tokens(text), lambda t: t.isin(single)))
    corrections: dict[int, list[str]] = {}
    for entry in sorted(entries.difference(single)):
        inner = [w for w in re.split(r"\W+", entry) if w in entries]
        corrections.setdefault(1 - len(inner), []).append(entry)
    for weight, group in sorted(corrections.items()):
        if weight:
            # The cheap byte search decides whether the regular expression runs at all.
            starts = sorted({re.match(r"\w+\W?|.", e).group() for e in group})
            hits = F.when(_any([lowered.contains(p) for p in starts]), _count(lowered, lexicon_pattern(group)))
            total = total + weight * F.coalesce(hits, F.lit(0))
    return total


def keyword_count_by_pattern(text: Column, words: list[str] | None = None) -> Column:
    """The same count by one regular expression; slower, kept to check the other."""
    return _count(F.lower(text), lexicon_pattern(list(words or core_lexicon())))
