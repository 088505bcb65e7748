"""Token ids by the tokenizers library, with a memory of the words already encoded.

A text is cut where its tokenizer surely cuts: word by word. Each distinct word goes
through the library once for a worker (until the memory is full and starts anew). Arrow
numbers the words of a step, so Python sees each word once a step; the texts' ids are then
put together by numpy. Two kinds of cuts are known:

* ``blank``: a blank after a word. A byte-level tokenizer begins a pre-token at a blank
  between characters that are no white space, so "a b" is "a" and " b". Texts with other
  white space next to a blank are encoded whole.
* ``space``: any ASCII white space. A tokenizer that drops white space and matches nothing
  across it sees the words one by one.

A word of plain Latin letters is one pre-token and goes to the library's model directly; words
with a run of marks after the same letters, or of several such lines, are put together by numpy from
what is known. Any other word goes through the whole library. ``check`` compares with whole-text
encoding and raises if a tokenizer doesn't fit.
"""

from __future__ import annotations

import os
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from querysentry.llm.frames import kept_in_process

#: Words that one worker remembers: about 250 bytes each.
MEMORY = 600_000
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ]+)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)\z"
_WHOLE, _NEW = -2, -1
_ID = attrgetter("id")


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, model_file: str, cut: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if cut not in ("blank", "space"):
            raise ValueError(f"Unknown cut {cut!r}")
        self.tokenizer = Tokenizer.from_file(model_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memory = memory
        self.cut, self.alphabet, self.lower = cut, _visible_bytes(), cut == "space"
        self.blank = self.alphabet[0x20]
        self.check()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def check(self) -> None:
        self._start()
        probes = ("The cat's 12 dogs, it's\n\nAs   is. \tÉté ÀŒß (x) <|endoftext|> ok  a<|endoftext|>b", "", " ", "a b", " a\n b \nc")
        for text in (*probes, *probes[0].split()):
            if self.encode([text])[0].tolist() != self.whole(text):
                raise ValueError(f"This tokenizer does not cut texts by {self.cut!r}")

    def _start(self) -> None:
        #: Words by their places in the table of ids; those that begin a text bear no blank.
        self.places: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        # Place 0 is no word at all: it has no ids.
        self.heads[""] = self.used = 0
        self.known = 1
        newline = self.whole("\n")
        self.mark_places: dict[str, int] = {"": 0, "\n": self._added(newline, [len(newline)])[0]}

    def _remembered(self, places: dict[str, int]) -> dict[str, tuple[int, ...]]:
        return {word: tuple(self.ids[self.starts[k] : self.starts[k + 1]].tolist()) for word, k in places.items() if k != _WHOLE}

    @property
    def letters(self) -> dict[str, tuple[int, ...]]:
        """Ids of the remembered words that are letters only, as they follow a blank."""
        return self._remembered({word: k for word, k in self.places.items() if word.isalpha()})

    @property
    def marks(self) -> dict[str, tuple[int, ...]]:
        """Ids of the remembered runs of marks."""
        return self._remembered({mark: k for mark, k in self.mark_places.items() if mark != "\n"})

    @property
    def newline(self) -> tuple[int, ...]:
        return self._remembered({"\n": self.mark_places["\n"]})["\n"]

    def _added(self, ids, lengths) -> range:
        """Places of new entries of the table, from the ids of all of them and the number of each."""
        first, last = self.known, self.known + len(lengths)
        ends = self.used + np.cumsum(np.asarray(lengths, np.int64))
        self.ids = _grown(self.ids, self.used + len(ids))
        self.starts = _grown(self.starts, last + 1)
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first + 1 : last + 1] = ends
        self.known, self.used = last, self.used + len(ids)
        return range(first, last)

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries at these places, one after another, and the number of each."""
        begin = self.starts[at]
        n = self.starts[at + 1] - begin
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(begin - ends + n, n) + np.arange(total)], n

    def _learn_letters(self, letters: list[str], places: dict[str, int], blank: str) -> None:
        """Pre-tokens of letters, from the model itself."""
        ids, lengths, tokenize, alphabet = [], [], self.model.tokenize, self.alphabet.__getitem__
        for word in letters:
            made = tokenize(blank + (word if word.isascii() else "".join(map(alphabet, word.encode()))))
            lengths.append(len(made))
            ids.extend(map(_ID, made))
        places.update(zip(letters, self._added(ids, lengths)))

    def _learn_plain(self, words: list[str], letters: list[str], marks: list[str], places: dict[str, int], blank: str) -> None:
        """Words of letters and then marks."""
        if self.lower:
            letters = "\n".join(letters).lower().split("\n")
        self._learn_letters([word for word, own in zip(words, letters) if word == own], places, blank)
        others = [k for k, (word, own) in enumerate(zip(words, letters)) if word != own]
        if not others:
            return
        letters, marks = list(map(letters.__getitem__, others)), list(map(marks.__getitem__, others))
        self._learn_letters(list(set(letters).difference(places)), places, blank)
        for mark in set(marks).difference(self.mark_places):
            made = self.whole(mark)
            self.mark_places[mark] = self._added(made, [len(made)])[0]
        pairs = np.array([list(map(places.__getitem__, letters)), list(map(self.mark_places.__getitem__, marks))], np.int64)
        ids, n = self._gathered(pairs.T.ravel())
        places.update(zip(map(words.__getitem__, others), self._added(ids, n.reshape(-1, 2).sum(1))))

    def _learn_lines(self, words: list[list[str]], places: dict[str, int], blank: str) -> None:
        """Words that hold newlines, each as its lines: a line after the first is a word without a blank."""
        self._learn(list({lines[0] for lines in words}.difference(places)), places, blank)
        self._learn(list({x for lines in words for x in lines[1:]}.difference(self.heads)), self.heads, "")
        at, newline = [], self.mark_places["\n"]
        for lines in words:
            at.append(places[lines[0]])
            for line in lines[1:]:
                at += (newline, self.heads[line])
        ids, n = self._gathered(np.array(at))
        size = 2 * np.fromiter(map(len, words), np.int64, len(words)) - 1
        lengths = np.add.reduceat(n, np.cumsum(size) - size)
        places.update(zip(map("\n".join, words), self._added(ids, lengths)))

    def _learn(self, words: list[str], places: dict[str, int], blank: str) -> None:
        """Words that follow a blank, or none."""
        if not words:
            return
        parts = pc.extract_regex(pa.array(words, pa.string()), _PLAIN)
        plain, every = parts.is_valid().to_numpy(zero_copy_only=False), np.array(words, object)
        if plain.any():
            letters, marks = (parts.drop_null().field(k).to_numpy(zero_copy_only=False).tolist() for k in ("letters", "marks"))
            self._learn_plain(every[plain].tolist(), letters, marks, places, blank)
        odd, lists, of_lines = [], [], []
        for word in every[~plain].tolist():
            if self.cut == "blank" and (not word or word[0].isspace() or word[-1].isspace()):
                places[word] = _WHOLE
                continue
            lines = word.split("\n")
            if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                of_lines.append(lines)
            else:
                odd.append(word)
                lists.append(self.whole(" " + word if blank else word))
        places.update(zip(odd, self._added(list(chain.from_iterable(lists)), list(map(len, lists)))))
        if of_lines:
            self._learn_lines(of_lines, places, blank)

    def _places_of(self, words: list[str], places: dict[str, int], blank: str) -> np.ndarray:
        at = np.fromiter(map(places.get, words, repeat(_NEW)), np.int64, len(words))
        new = np.flatnonzero(at == _NEW)
        if len(new):
            met = list(map(words.__getitem__, new.tolist()))
            self._learn(list(set(met)), places, blank)
            at[new] = np.fromiter(map(places.__getitem__, met), np.int64, len(met))
        return at

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of every word of all texts, one after another, and the number of words of each text."""
        parts = pc.split_pattern(texts, " ") if self.cut == "blank" else pc.ascii_split_whitespace(texts)
        n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        # Arrow makes the strings of an array of objects at once.
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self._places_of(words, self.places, self.blank if self.cut == "blank" else "")[coded.indices.to_numpy(zero_copy_only=False)]
        if self.cut == "blank":
            first = (np.cumsum(n) - n)[n > 0]
            at[first] = self._places_of(flat.take(pa.array(first)).to_numpy(zero_copy_only=False).tolist(), self.heads, "")
        return at, n

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.places) + len(self.heads) + len(self.mark_places) > self.memory:
            self._start()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if len(texts) == 0:
            return []
        at, words = self._words(texts)
        known = at != _WHOLE
        at = np.where(known, at, 0)
        ids, n = self._gathered(at)
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(words)
        unknown = np.concatenate([[0], np.cumsum(~known)])
        spans = zip(total[ends - words].tolist(), total[ends].tolist(), (unknown[ends] > unknown[ends - words]).tolist())
        return [np.array(self.whole(texts[i].as_py()), np.int32) if odd else ids[a:b] for i, (a, b, odd) in enumerate(spans)]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(len(array), size - len(array)), array.dtype)])


def word_encoder(model_file: str, cut: str, memory: int = MEMORY) -> WordEncoder:
    return kept_in_process(("words", model_file, cut, memory), lambda: WordEncoder(model_file, cut, memory))
