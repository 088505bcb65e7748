"""Spelling variants, importance resampling and the n-gram similarity join against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from querysentry.llm import jaccard_join, near_copies, pretokens, resampling, simhash, spelling
from querysentry.llm.ngram_table import PADDING, Spans, SpanTable
from querysentry.llm.queries import model_path
from querysentry.llm.sorted_groups import map_groups

SCHEMA = "doc_id long, text string, word string, n long, score string, rank int, row long, u long, range string"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from every single hunter in the dark wood tonight. "


def frame(spark, texts):
    """Texts with keys from 0, and columns that clash with the operators' own."""
    rows = [(i, t, "w", 1, None, 2, 3, None, "r") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# Byte spans ---------------------------------------------------------------------------------


def test_spans_and_table():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    starts = rnd.integers(0, 2600, 4000)
    ends = starts + rnd.integers(0, 300, 4000)
    ends[:2000] = starts[:2000] + rnd.integers(0, 9, 2000)
    spans = Spans(np.concatenate([data, np.zeros(PADDING, np.uint8)]), starts, ends)
    raw = [data.tobytes()[a:b] for a, b in zip(starts, ends)]
    assert [int(k) for k in spans.keys()] == [xxhash.xxh64_intdigest(r) for r in raw]
    assert [int(k) for k in spans.crcs(np.arange(4000))] == [zlib.crc32(r) for r in raw]
    table, slots = SpanTable(spans), {}
    assert all(slots.setdefault(r, s) == s for r, s in zip(raw, table.slots))
    assert len(set(slots.values())) == len(slots) == (table.owner >= 0).sum()
    assert all(table.counts[slots[r]] == n for r, n in Counter(raw).items())
    assert len(SpanTable(Spans(np.zeros(PADDING, np.uint8), np.zeros(0, int), np.zeros(0, int))).slots) == 0


def test_equal_keys_are_verified(monkeypatch):
    monkeypatch.setattr(Spans, "keys", lambda self: np.zeros(len(self), np.uint64))
    data = np.frombuffer(b"abcabdabcaab" + bytes(PADDING), np.uint8)
    table = SpanTable(Spans(data, np.array([0, 3, 6, 9, 10]), np.array([3, 6, 9, 10, 12])))
    assert table.slots[0] == table.slots[2] and len(set(table.slots.tolist())) == 4


# Importance resampling ------------------------------------------------------------------------


def features_of(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(texts, target, per_cent, min_words):
    def counts(of):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in of for f in features_of(t)[1])

    s, t = counts(x for _, x in texts), counts(target)
    all_s, all_t = float(s.total() + 10000), float(t.total() + 10000)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in range(10000)]
    rows = []
    for key, text in texts:
        words, found = features_of(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = Counter()
    ranked = [(*r, k + 1 if k < per_cent * len(able) // 100 else None) for k, r in enumerate(able)]
    return Counter(ranked + [(*r, None) for r in rows if r[1] < min_words]), rank


def corpus(n=300):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 7))) for _ in range(300)] + ["Éa", "x y", "漢字", "l" * 300]
    texts = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 120)))) for i in range(n)]
    odd = [None, "", " \n", "a", "A b", PROSE * 40, "x" * 5000, "don't, stop!" * 9]
    return texts + [(n + i, t) for i, t in enumerate(odd)] + [(None, PROSE), (None, PROSE), (3, PROSE), texts[7], texts[7]]


@pytest.mark.parametrize("per_range", [20, 500_000])
def test_resampling(spark, per_range):
    texts, target = corpus(), [PROSE, None, "", texts_target := "a b c"]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(frame(spark, texts), bench, per_cent=30, min_words=20, rows_per_range=per_range)
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    expected, _ = brute_resample(texts, target, 30, 20)
    # Rows that are equal but for their rank may swap ranks; nothing else may differ.
    assert Counter(rows) == expected
    ranks = sorted(r[-1] for r in rows if r[-1])
    assert ranks == list(range(1, len(ranks) + 1)) and texts_target


def test_long_texts_are_cut_anywhere():
    import pyarrow as pa

    texts = [PROSE * 5, "", None, "a b", PROSE]
    whole, cut = (resampling.Features(pa.array(texts), at_once=n) for n in (1 << 17, 7))

    def seen(features):
        return sum((Counter(zip(rows.tolist(), (bytes(t._spans.bytes_of(k)) for k in range(len(rows))))) for t, rows in features.tables()), Counter())

    expected = Counter((i, f.encode()) for i, t in enumerate(texts) for f in features_of(t)[1])
    assert seen(whole) == seen(cut) == expected


def test_resampling_empty(spark):
    docs = frame(spark, [(1, PROSE)])
    assert resampling.resample(docs.limit(0), docs).count() == 0
    assert resampling.resample(docs, docs.limit(0)).first()["n_features"] == 3 * len(features_of(PROSE)[0]) - 3


# Spelling variants ------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_sorted_list_scan():
    rnd = random.Random(3)
    for _ in range(2000):
        longest, letters = rnd.choice([1, 2, 4, 7]), "abcé"[: rnd.randint(1, 4)]
        words = sorted({"".join(rnd.choices(letters, k=rnd.randint(max(0, longest - 2), longest))) for _ in range(rnd.randint(0, 30))})
        assert spelling.near_in_list(words) == [p for p in itertools.combinations(range(len(words)), 2) if near(words[p[0]], words[p[1]])]


def brute_spelling(texts):
    counts = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    rows, forms = {}, {}
    for w, n in counts.items():
        found = sorted((-m, v) for v, m in counts.items() if near(w, v))
        if found and -found[0][0] >= 5 * n:
            forms[w] = found[0][1]
        rows[w] = [n, len(found), forms.get(w), -found[0][0] if w in forms else None]
    for w in rows:
        root = w
        while root in forms:
            root = forms[root]
        rows[w].append(root)
    return {w: tuple(r) for w, r in rows.items()}


def spelled():
    rnd = random.Random(9)
    texts, key = [], 0
    base = ["".join(rnd.choices("abcdeé", k=rnd.randint(6, 12))) for _ in range(25)] + ["Straßen÷bau", "ÀÉîõüx", "y" * 3000]
    for word in base:
        for times in (130, 26, 5):
            texts.append((key, " ".join([word] * times)))
            key += 1
            at = rnd.randrange(len(word))
            word = rnd.choice([word[:at] + word[at + 1 :], word[:at] + "a" + word[at:], word[:at] + "b" + word[at + 1 :]])
    return texts + [(key + i, "abcdefg hijklmn" * 3 + " " + PROSE) for i in range(400)] + [(None, PROSE), (None, PROSE), (0, PROSE), (1, None), (2, " ")]


@pytest.mark.parametrize("max_list", [2, 4096])
def test_spelling_variants(spark, max_list):
    texts = spelled()
    got = spelling.spelling_variants(frame(spark, texts), variant=spelling.dropped_character, max_list=max_list).collect()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}
    assert len(found) == len(got) and found == brute_spelling(texts)
    assert any(r.form and r.root != r.form for r in got)


def test_spelling_empty(spark):
    assert spelling.spelling_variants(frame(spark, [(1, "a")])).count() == 0


def test_groups_are_whole(spark):
    """Groups that cross Arrow batches arrive in one piece."""
    import pyarrow as pa

    rows = spark.range(1000).selectExpr("id", "CAST(pow(id, 0.5) AS INT) AS g").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")

    def run(table):
        for g, n in Counter(table.column("g").to_pylist()).items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([n])], names=["g", "n"])

    try:
        got = sorted(map(tuple, map_groups(rows, "g", ["id"], run, "g bigint, n bigint").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(Counter(r.g for r in rows.collect()).items())


# Similarity join ----------------------------------------------------------------------------------


def brute_join(texts, similarity=80):
    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
        return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(t) for _, t in texts]
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            label = [label[i] if x == label[j] else x for x in label]
    least = {}
    for x, (key, _) in zip(label, texts):
        least[x] = min((k for k in (least.get(x), key) if k is not None), default=None)
    return Counter((key, len(s), least[x]) for (key, _), s, x in zip(texts, sets, label))


def near_texts():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=3)) for _ in range(400)]
    passage = rnd.choices(vocabulary, k=60)
    texts = []
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([5, 30, 90, 200])) + rnd.choice([[], passage])
        for _ in range(rnd.randint(1, 14)):
            base = list(base)
            # Chains: each copy is a copy of the one before, with ever more changes.
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
                base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            texts.append(" ".join(base))
    texts += [" ".join(passage), " ".join(passage[:-4]), None, "", " ", "a", "a b c", "A b  c", PROSE, PROSE.upper(), PROSE * 30, "x" * 9000]
    rnd.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, PROSE), (None, "only null keys hold this text and nobody else"), (3, texts[3]), (3, texts[3]), (4, PROSE)]


@pytest.mark.parametrize("bounds", [{}, {"heavy": 30, "max_sets": 6, "max_shingles": 900, "max_sent": 0}])
def test_similarity_join(spark, bounds):
    texts = near_texts()
    got = jaccard_join.similar_documents(frame(spark, texts), **bounds)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_join(texts)


def test_similarity_join_empty(spark):
    docs = frame(spark, [(1, " "), (2, None)])
    assert jaccard_join.similar_documents(docs.limit(0)).count() == 0
    assert sorted(map(tuple, jaccard_join.similar_documents(docs).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_copies_at_the_border(spark):
    """Eight of ten shared shingles link, one fewer does not."""
    base = [f"w{i}" for i in range(13)]
    texts = [(0, " ".join(base)), (1, " ".join(base + ["x", "y"])), (2, " ".join(base + ["p", "q", "r"])), (3, " ".join(base) + " " + base[0])]
    assert Counter(map(tuple, jaccard_join.similar_documents(frame(spark, texts)).collect())) == brute_join(texts)


def test_prefixes_lose_no_pair():
    """With any counts of holders, similar sets share as many prefix shingles as the lesser asks for."""
    rnd = random.Random(2)
    for _ in range(400):
        held = {k: rnd.choice([1, 2, 2, 3, 50]) for k in range(60)}
        x = set(rnd.sample(range(60), rnd.randint(2, 50)))
        y = (x - set(rnd.sample(sorted(x), rnd.randint(0, len(x) // 6)))) | set(rnd.sample(range(60), rnd.randint(0, 3)))
        for k in x & y:
            held[k] = max(2, held[k])
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        prefixes, asked = [], []
        for s in (x, y):
            order = sorted((held[k], k) for k in s if held[k] > 1)
            matches, size = jaccard_join.matches_and_prefix(len(s), np.array([h for h, _ in order], np.int64), 80)
            asked.append(matches)
            prefixes.append({k for _, k in order[:size]})
        assert len(prefixes[0] & prefixes[1]) >= min(asked)


def test_classes_are_candidates(spark):
    """Texts of one class are compared, though they share no band; unlike ones of a class both stay."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[:200]), " ".join(words[130:330]), "quite another text with words of its own"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_copies.keep_first(docs, similarity=0.15).count() == 3
    classes = near_copies.text_hashes(docs).select("text_hash", F.lit(1).cast("bigint").alias("class"))
    kept = near_copies.keep_first(docs, similarity=0.15, classes=classes)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_stage_takes_fingerprints(spark, monkeypatch):
    """The pipeline's near duplicates are proposed by SimHash classes."""
    import corpus_pipeline

    made, given = [], []
    near, keep = simhash.near_duplicates, near_copies.keep_first
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: made.append(near(*a, **k)) or made[-1])
    monkeypatch.setattr(near_copies, "keep_first", lambda docs, classes=None, **k: given.append(classes) or keep(docs, classes=classes, **k))
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["1", "3"]
    assert made and {tuple(r) for r in given[0].collect()} == {(r.doc_id, r.component_id) for r in made[0].collect()}


@pytest.mark.parametrize("name, cut", [("byte_bpe_50k.json", "blank"), ("word_bpe_49k.json", "space")])
def test_encoder_words_of_all_kinds(name, cut):
    """Bare letters, letters with marks, lines and other words are the library's; what is remembered is no list."""
    encoder = pretokens.WordEncoder(model_path(name), cut, memory=40)
    texts = ["Abc abc Abc, abc.\nDef ghi", " x  y É é Éa é. ", "", "1a a1 a-b it's don't", " ".join(f"w{chr(97 + k)}q" for k in range(26))]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [encoder.whole(t) for t in texts]
    assert all(isinstance(x, tuple) for x in (*encoder.letters.values(), *encoder.marks.values(), encoder.newline))
