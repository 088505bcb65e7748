"""Words learnt in bulk: the library's ids, and the model asked no more often than there are letters to ask for."""

import random

import pytest

from querysentry.llm.pretokens import WordEncoder
from querysentry.llm.queries import model_path

CUTS = [("byte_bpe_50k.json", "blank"), ("word_bpe_49k.json", "space")]


class Counting:
    """A model that counts what it is asked for."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, word):
        self.asked.append(word)
        return self.model.tokenize(word)


@pytest.mark.parametrize("file, cut", CUTS)
def test_letters_reach_the_model_once(file, cut):
    """Marks, lines and a memory nearly full do not send letters through the model again."""
    encoder = WordEncoder(model_path(file), cut, memory=100)
    encoder.model = counting = Counting(encoder.model)
    words = [f"qz{a}{b}" for a in "abcde" for b in "fghij"]
    encoder.encode(["", " ".join(["Top", *words])])
    first = len(counting.asked)
    encoder.encode([" ".join(["Top", *(w + "." for w in words)])])
    assert first >= 25 and len(counting.asked) == first
    lines = [" ".join(["Top", *(w + ",\nqzaf" for w in words)])]
    assert encoder.encode(lines)[0].tolist() == encoder.whole(lines[0])
    # A line's first word is another pre-token where a blank is part of a word.
    assert len(counting.asked) - first <= 1


def test_capitals_reach_the_model_once():
    encoder = WordEncoder(*[model_path("word_bpe_49k.json"), "space"])
    encoder.model = counting = Counting(encoder.model)
    encoder.encode(["qzabef qzaÉef", "Qzabef QZABEF QZAÉEF Qzabef!"])
    assert len(counting.asked) == 2


@pytest.mark.parametrize("file, cut", CUTS)
def test_ids_are_those_of_whole_texts(file, cut):
    rng = random.Random(3)
    parts = [
        "the", "The", "Élan", "œuvre", "ſtaff", "İ", "ŉ", "don't", "12", "a1", "a-b", "...", "!?", "x<|endoftext|>", "<|ENDOFTEXT|>", "日本", "e\u0301t",
        "a\tb", "a\u00a0", "\u00a0b", "\u2003", "a\u0000", "\x1c", "a\x85b", "", "ab.", "'s", "<b>", "\u200b", "naïve,", "Σ",
    ]
    texts = ["", " ", "\n", "  ", "a\n\nb", "a \nb", "a\n b", "\na", "a\n", " a\nb\nc. \nd", "a\n\n\nb c\rd"]
    texts += ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "\n", "", "  ", "\n\n"]) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    encoder = WordEncoder(model_path(file), cut, memory=300)
    for k in range(0, len(texts), 25):
        for text, ids in zip(texts[k : k + 25], encoder.encode(texts[k : k + 25])):
            assert ids.tolist() == encoder.whole(text), repr(text)
