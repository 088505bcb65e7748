"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and context windows.

The lexicon holds known abusive words and what a bounded sample of labelled texts shows:
stems (word beginnings) that toxic texts hold and clean ones don't, and weaker ones that
toxic texts hold far more often. All its entries form
a trie. Trie and edit automaton are run in lockstep: a state of the product is the set of
(trie node, edits so far) that a prefix can be in, and the product, made deterministic, is
a transition table. All distinct words of a batch walk through it together, one letter a
step; most leave it after a few letters.

Each hit is weighed by its context window: inside quotation marks, or near words that
report speech, it is a quotation and counts separately from abuse. A logistic regression
on the counts gives the score.

Defined cases: a null or empty text has no hits and scores the bias alone; several labels
for a key count as their maximum; without any label the known words alone decide; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry.llm import textbytes as T
from querysentry.llm.frames import doc_columns, kept_in_process, map_steps
from querysentry.llm.quality_ftrl import learning_sample

#: Labelled rows that are learnt from, at most.
MAX_ROWS = 12_000
#: Known abusive words.
KNOWN = (
    "asshole", "bastard", "bitch", "clown", "cretin", "crap", "creep", "cunt", "degenerate", "disgusting", "douche", "dumbass",
    "dumb", "fool", "fuck", "garbage", "idiot", "idiota", "idiotic", "imbecile", "jerk", "loser", "lowlife", "moron", "moronic",
    "nitwit", "parasite", "pathetic", "pig", "pervert", "retard", "scum", "shit", "sicko", "slut", "stupid", "subhuman",
    "swine", "trash", "vermin", "whore", "worthless", "wretch",
)
#: Words that report speech.
REPORTING = (
    "said", "says", "called", "calls", "wrote", "writes", "quoted", "quote", "tweeted", "shouted", "word", "term", "slur",
    "insult", "insults", "says:", "said:", "dit", "sagte", "dijo",
)
WINDOW = 6
MIN_STEM, MAX_STEM = 4, 10
#: A learnt entry is in this many toxic texts of the sample and in almost no clean one.
MIN_TOXIC = 4
#: A weak stem is in this share of the toxic texts at least, and so many times as often as in clean ones.
WEAK_SHARE, WEAK_RATIO = 0.02, 4
#: Weights where no labels are given, by measure; the last is the bias.
DEFAULT_WEIGHTS = (2.0, 1.0, 0.5, 0.2, 0.0, 2.0, 1.0, 0.0, -3.0)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 0x40, 0x24]] = True
_QUOTES = {b'"': 1, "“".encode(): 1, "”".encode(): 1, "«".encode(): 1, "»".encode(): 1, "„".encode(): 1}


class Product:
    """The lexicon trie run together with the Levenshtein automaton of ``edits`` edits, as one table.

    ``accepts`` gives 0 for no hit, 1 for an entry as it is (or a stem's continuation), 2
    for an entry with edits, 3 for a weak stem's continuation. Only entries of ``min_fuzzy`` bytes or more bear edits.
    """

    def __init__(self, words: list[str], stems: list[str], weak: list[str] = (), edits: int = 1, min_fuzzy: int = 5):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [0]  # 0 inner node, 1 word, 2 stem, 3 weak stem
        depth = [0]
        bears: list[bool] = [False]
        for entries, kind in ((words, 1), (weak, 3), (stems, 2)):
            for entry in entries:
                node, raw = 0, entry.encode()
                for b in raw:
                    if b not in children[node]:
                        children[node][b] = len(children)
                        children.append({})
                        ends.append(0)
                        bears.append(False)
                        depth.append(depth[node] + 1)
                    node = children[node][b]
                    bears[node] |= len(raw) >= min_fuzzy and kind == 1
                ends[node] = ends[node] if kind == 3 and ends[node] else kind
        self.children, self.ends, self.edits = children, ends, edits
        bears[0] = any(bears)

        alphabet = sorted({b for c in children for b in c})
        self.symbol = np.zeros(256, np.int16)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)

        weakly, strong = -1, frozenset({(-2, 0)})

        def closed(states: dict[int, int]) -> dict[int, int]:
            """With letters of the entry left out of the word; least edits for each node."""
            todo = list(states.items())
            while todo:
                node, used = todo.pop()
                if node != weakly and used < edits and bears[node]:
                    for below in children[node].values():
                        if bears[below] and states.get(below, edits + 1) > used + 1:
                            states[below] = used + 1
                            todo.append((below, used + 1))
            return states

        def step(states, byte):
            made: dict[int, int] = {}
            for node, used in states:
                if node == weakly:
                    made[weakly] = 0
                    continue
                below = children[node].get(byte)
                if below is not None and (not used or bears[below]):
                    made[below] = min(made.get(below, used), used)
                if used < edits and bears[node]:
                    for other in (node, *children[node].values()):  # a letter too many, or another one
                        if bears[other] and made.get(other, edits + 1) > used + 1:
                            made[other] = used + 1
            return settled(closed(made))

        def settled(states: dict[int, int]) -> frozenset:
            """A stem that is reached accepts all that follows, so nothing else matters; a weak one stays as a mark."""
            reached = {ends[node] for node, used in states.items() if node != weakly and used == 0}
            if 2 in reached:
                return strong
            if 3 in reached:
                states[weakly] = 0
            return frozenset(states.items())

        first = frozenset(closed({0: 0}).items())
        numbers, todo, rows = {frozenset(): 0, first: 1}, [first], {0: [0] * (len(alphabet) + 1)}
        while todo:
            states = todo.pop()
            row = []
            for byte in (-1, *alphabet):
                after = strong if states == strong else step(states, byte)
                if after not in numbers:
                    numbers[after] = len(numbers)
                    todo.append(after)
                row.append(numbers[after])
            rows[numbers[states]] = row
        self.table = np.array([rows[i] for i in range(len(numbers))], np.int32)
        self.verdict = np.zeros(len(numbers), np.int8)
        for states, number in numbers.items():
            found = {1 if node == -2 else 3 if node == weakly else 2 if used else 1 for node, used in states
                     if node < 0 or ends[node] == 1 and (not used or depth[node] >= min_fuzzy)}
            self.verdict[number] = next((v for v in (1, 3, 2) if v in found), 0)

    def accepts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Verdict of every byte span; all walk together and drop out when no entry is left."""
        verdict = np.zeros(len(starts), np.int8)
        alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts
        while len(alive):
            over = at >= ends[alive]
            verdict[alive[over]] = self.verdict[state[over]]
            alive, state, at = alive[~over], state[~over], at[~over]
            state = self.table[state, self.symbol[data[at]]]
            keep = state > 0
            alive, state, at = alive[keep], state[keep], at[keep] + 1
        return verdict


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes and the runs of letters and digits in them."""
    lowered = T.LOWER[data]
    return lowered, *T.runs(_LETTER[lowered], offsets)


def measures(column: pa.Array, product: Product) -> np.ndarray:
    """For each text: hits as they are, with edits, the same quoted, weak ones (as log counts), and shares."""
    data, offsets = T.utf8(column)
    n = len(offsets) - 1
    lowered, starts, ends, rows = tokens(data, offsets)
    _, first, back = np.unique(T.SpanHash(lowered)(starts, ends), return_index=True, return_inverse=True)
    verdict = product.accepts(lowered, starts[first], ends[first])[back]
    hits = np.flatnonzero(verdict)
    quoted = np.zeros(len(hits), bool)
    for k, hit in enumerate(hits.tolist()):
        low, high = max(0, hit - WINDOW), min(len(rows) - 1, hit + WINDOW)
        begin, end = max(starts[low], offsets[rows[hit]]), min(ends[high] + 3, offsets[rows[hit] + 1])
        before, after = lowered[begin : starts[hit]].tobytes(), lowered[ends[hit] : end].tobytes()
        marks = sum(before.count(q) for q in _QUOTES) % 2 == 1 and any(q in after for q in _QUOTES)
        quoted[k] = marks or not {w.decode("utf-8", "ignore") for w in before.split()[-WINDOW:]}.isdisjoint(REPORTING)
    kind = verdict[hits]
    found = np.stack([
        np.bincount(rows[hits], weights=w, minlength=n)
        for w in ((kind == 1) & ~quoted, (kind == 2) & ~quoted, (kind == 1) & quoted, (kind == 2) & quoted, kind == 3)
    ], axis=1)
    size = np.maximum(1, np.bincount(rows, minlength=n))
    return np.column_stack([np.log1p(found), found[:, 0] > 0, np.sqrt(found[:, 0] / size), np.sqrt(found[:, 4] / size)])


def _stems(texts: list[str]) -> list[set[str]]:
    """The distinct beginnings of each text's words, and the words themselves."""
    made = []
    for text in texts:
        data, offsets = T.utf8(pa.array([text]))
        lowered, starts, ends, _ = tokens(data, offsets)
        raw = lowered.tobytes()
        words = {raw[a:b].decode("utf-8", "ignore").lower() for a, b in zip(starts.tolist(), ends.tolist())}
        made.append({w[:k] for w in words for k in range(MIN_STEM, min(len(w), MAX_STEM) + 1)})
    return made


def learnt_stems(texts: list[str], labels: np.ndarray) -> tuple[list[str], list[str]]:
    """The shortest beginnings that toxic texts of the sample hold and clean ones (almost) don't; the weak ones."""
    toxic, clean = Counter(), Counter()
    for stems in _stems([t for t, y in zip(texts, labels) if y]):
        toxic.update(stems)
    n = int(labels.sum())
    often = {s: c for s, c in toxic.items() if c >= max(MIN_TOXIC, 0.01 * n)}
    for stems in _stems([t for t, y in zip(texts, labels) if not y]):
        clean.update(stems & often.keys())
    ratio = (len(labels) - n) / max(1, n)
    good = {s for s, c in often.items() if clean[s] <= 0.02 * c * max(1.0, ratio) and clean[s] <= 0.05 * c}
    shortest = [s for s in good if not any(s[:k] in good for k in range(MIN_STEM, len(s)))]
    # A stem that (nearly) always goes on in one way is taken with what follows, so that it
    # doesn't catch other words that happen to begin alike.
    longer: dict[str, list[str]] = {}
    for s in often:
        longer.setdefault(s[:-1], []).append(s)
    made = []
    for s in shortest:
        while (best := max(longer.get(s, [""]), key=lambda x: (often.get(x, 0), x))) and often[best] >= 0.95 * often[s]:
            s = best
        made.append(s)
    weak = {s for s, c in often.items() if c >= WEAK_SHARE * n and c / n >= WEAK_RATIO * (clean[s] + 1) / max(1, len(labels) - n)} - good
    weak = [s for s in weak if not any(s[:k] in weak or s[:k] in good for k in range(MIN_STEM, len(s)))]
    return sorted(made), sorted(weak)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method with a small penalty on all but the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge @ w)
    return w


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, seed: int = 7, text: str = "text",
    key: str = "doc_id",
) -> dict:
    """Learnt stems and the weights of the measures, from a bounded sample in one task."""

    def learn(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("order", "text", "label")))]
        rows.sort()
        rows = rows[:max_rows]
        texts, marks = [t for _, t, _ in rows], np.array([y > 0 for _, _, y in rows], bool)
        # The stems come from two thirds, the weights from the rest, which hasn't shaped them.
        half = len(rows) * 2 // 3
        stems, weak = learnt_stems(texts[:half], marks[:half])
        if half and 0 < marks[half:].sum() < len(rows) - half:
            product = Product(list(KNOWN), stems, weak)
            x = np.concatenate([measures(pa.array(texts[k : k + 200], pa.large_string()), product) for k in range(half, len(rows), 200)])
            w = logistic(x, marks[half:].astype(float))
        else:
            w = np.array(DEFAULT_WEIGHTS)
        lists = [pa.array([x], pa.list_(pa.string())) for x in (stems, weak)]
        yield pa.RecordBatch.from_arrays([*lists, pa.array([w.tolist()])], names=["stems", "weak", "weights"])

    sample = learning_sample(docs, labels, label, max_rows, seed, text, key).select("order", "text", "label")
    row = sample.repartition(1).mapInArrow(learn, "stems array<string>, weak array<string>, weights array<double>").first()
    return row.asDict() if row else {"stems": [], "weak": [], "weights": list(DEFAULT_WEIGHTS)}


def score(docs: DataFrame, model: dict, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted, n_abuse, n_quoted) of every document; nothing is shuffled."""
    stems, weak, weights = tuple(model["stems"]), tuple(model["weak"]), np.array(model["weights"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        product = kept_in_process(("lexicon", stems, weak), lambda: Product(list(KNOWN), list(stems), list(weak)))
        x = measures(batch.column("text"), product)
        scores = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -35, 35)))
        counts = np.rint(np.expm1(x[:, :4])).astype(np.int64)
        columns = [
            batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
            pa.array(counts[:, 0] + counts[:, 1]), pa.array(counts[:, 2] + counts[:, 3]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "n_abuse", "n_quoted"])

    return map_steps(docs, doc_columns(text, key), run, "doc_id bigint, score double, predicted int, n_abuse bigint, n_quoted bigint", keeps=True)
