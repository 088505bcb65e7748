"""The corpus operators against brute force, on small tables with every odd case."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querysentry.llm import chat, decontaminate, id_files, line_rules, near_copies, packing, pii, quality_ftrl, simhash, token_counts, toxicity
from querysentry.llm.components import connected_components
from querysentry.llm.queries import model_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, score string"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from every single hunter in the dark wood tonight. "
ODD = [
    None, "", " ", "\n", "a", "a b c", "<|endoftext|>", PROSE, PROSE, PROSE.upper(), PROSE * 300, "x" * 40_000,
    "\n".join(["line one."] * 30), "é ß\tñ\x0b漢字 ﬁ " * 50, "mail a.b@c.de and 10.0.0.1 or 4111 1111 1111 1111 call +49 170 1234567",
    "a  b \n c \n\n d" * 20, "$$$ *** ### " * 20,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a null key, a repeated row, and columns that clash with the operators' own."""
    rows = [(i, t, "en", None, None, 1, "s") for i, t in enumerate(ODD)] + [(None, PROSE, None, "s", 3, None, None), (3, "\n", "en", None, None, 1, "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_token_counts(docs, empty):
    import sentencepiece

    path = model_path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(docs, path, limit=20, chunk=600, overlap=32).collect()
    expected = Counter((i, len(t.encode()), n := len(whole.encode(t)), n > 20) for i, t in texts_of(docs))
    assert Counter(r[:4] for r in got) == expected
    assert max(r.n_chunks for r in got) > 10 and max(r.n_widened for r in got) > 0
    assert token_counts.token_counts(empty, path).count() == 0
    encoder = token_counts.ChunkedEncoder(path, 64, 4)
    for text in ODD[1:]:
        assert encoder.encode(text)[0].tolist() == whole.encode(text)


def brute_spans(text):
    def luhn(d):
        return sum(v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        found += [("card", *m.span())] * (13 <= len(d) <= 19 and luhn(d))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [("phone", *m.span())] * (9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return found


def test_personal_data(docs, empty):
    for r in pii.find_personal_data(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        base = brute_spans(r.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))  or not base
    assert pii.find_personal_data(empty).count() == 0
    rnd = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rnd.choice(list("ab@.-+ 0123(")) for _ in range(rnd.integers(30)))
        assert pii.base_spans(text) == brute_spans(text)
    masked = pii.mask_spans(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert masked.filter("doc_id = 14").first().text == "mail <EMAIL> and <IP> or <CARD> call <PHONE>"


@pytest.mark.parametrize(
    "text, span",
    [
        ("mail john.doe at example dot com now", "john.doe at example dot com"),
        ("john [at] example [dot] com", "john [at] example [dot] com"),
        ("see jоhn＠exаmple．com!", "jоhn＠exаmple．com"),
        ("ip one nine two dot one six eight dot one dot seven ok", "one nine two dot one six eight dot one dot seven"),
        ("card " + "four" + " one" * 15, "four" + " one" * 15),
        ("call plus four nine one seven six one two three four", "plus four nine one seven six one two three four"),
        ("he sat at the dot. One two three men met at noon", None),
    ],
)
def test_disguises(text, span):
    base, found = pii.all_spans(text)
    assert not base and [text[a:b] for _, a, b in found] == ([span] if span else [])


@pytest.mark.parametrize(
    "text, kind",
    [
        ("write john.doe at mail.example dot com", "EMAIL"), ("write john @ example.com", "EMAIL"), ("write john.doe at example.com", "EMAIL"),
        ("write john at example dot\ncom", "EMAIL"), ("plus one two one six two one two one two", "PHONE"),
        ("call +⁴⁹ ①⑦⓪ ١٢٣٤٥٦٧", "PHONE"), ("write jρικτυ@example.com", "EMAIL"), ("we met at noon.then we left", ""),
    ],
)
def test_plain_dots_and_digits(text, kind):
    assert (f"<{kind}>" in pii.masked(text)) if kind else pii.masked(text) == text


def test_chat(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "system", "be\nkind"), (1, 1, "user", control), (1, 2, "assistant", control + "\\<|\\\\|"), (2, 0, "assistant", "first"),
        (3, 0, "user", None), (3, 0, "user", None), (None, 5, None, "x<"), (4, 2, "assistant", ""), (4, 1, "user", "late"), (5, 0, "odd\n<|role", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit("q"))
    made = chat.format_chats(df).cache()
    read = {r.conv_id: r for r in chat.read_back(made).collect()}
    expected = defaultdict(list)
    for conv, turn, role, text in rows:
        expected[conv].append((turn, role or "", text or ""))
    for conv, turns in expected.items():
        assert [(t.role, t.text) for t in read[conv].turns] == [t[1:] for t in sorted(turns)]
        assert read[conv].loss_text == "".join(t[2] for t in sorted(turns) if t[1] == "assistant")
    assert {c: r.valid for c, r in read.items()} == {1: True, 2: False, 3: False, None: False, 4: True, 5: False}
    assert chat.format_chats(df.limit(0)).count() == 0
    for segment in itertools.chain(*(r.segments for r in made.collect())):
        assert not (segment.loss and "<|" in segment.text)


def test_quality(spark, empty):
    rows = [(i, ("buy *** now ### " if i % 3 == 0 else "a calm and plain sentence of words ") * (1 + i % 7), "en", None, None, 1, None) for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None), (601, "", None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    weights = quality_ftrl.fit(docs, labels)
    scored = quality_ftrl.score(docs, weights).collect()
    assert len(scored) == 602 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) > 0.98 * len(held)
    none = quality_ftrl.fit(docs, labels.limit(0))
    assert {r.score for r in quality_ftrl.score(docs, none).collect()} == {0.5}
    assert quality_ftrl.score(empty, weights).count() == 0
    assert (quality_ftrl.fit(docs.repartition(7), labels) == weights).all()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_product():
    product = toxicity.Product(["idiot", "moron", "scum"], ["lowei"], ["achk"])
    rnd = np.random.default_rng(1)
    words = ["idiot", "idi0t", "idot", "idioot", "scum", "scun", "loweiheit", "lowe", "achkeit", "ach", "i", "moronic", "nomor"]
    words += ["".join(rnd.choice(list("idotmrnscu")) for _ in range(rnd.integers(1, 8))) for _ in range(5000)]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    got = product.accepts(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    for word, verdict in zip(words, got):
        near = min(edit_distance(word, w) for w in ("idiot", "moron"))
        expected = 1 if word in ("idiot", "moron", "scum") or word.startswith("lowei") else 3 if word.startswith("achk") else 2 if near == 1 else 0
        assert verdict == expected, word


def test_toxicity(spark, empty):
    bad = ["you are an idiot and a moron today", "what worthless trash you are my friend", "such a pathetic l0ser you stupid clown"]
    rows = [(i, (bad[i % 3] if i % 4 == 0 else "a calm and plain sentence of words") + f" number w{i}", "en", None, None, 1, None) for i in range(400)]
    docs = spark.createDataFrame([*rows, (500, 'He said "idiot" in the play.', None, None, None, None, None), (501, None, None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(scored) == 402
    assert all(scored[i].predicted == int(i % 4 == 0) for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1)
    assert scored[500].n_quoted == 1 and scored[500].n_abuse == 0 and scored[500].predicted == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 402
    assert toxicity.score(empty, model).count() == 0


def ids_by_library(path, text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_id_files(spark, docs, empty):
    path = model_path("byte_bpe_50k.json")
    got = sorted(id_files.id_files(docs, path, 2, segment_ids=3000, block_ids=64).collect(), key=lambda r: r.start)
    expected = {(i, len(ids), crc(ids)) for i, t in texts_of(docs) for ids in [ids_by_library(path, t)]}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == expected and len(got) == docs.count()
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert id_files.id_files(empty, path, 2).count() == 0


@pytest.mark.parametrize("width", [1, 5, 11, 16, 17, 31])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 5003)
    payload, offsets = id_files.pack_blocks(ids, width, 100)
    segment = {"block_ids": 100, "block_offsets": offsets, "payload": payload, "width": width}
    assert (id_files.read_ids(segment, 0, 5003) == ids).all()
    assert (id_files.read_ids(segment, 250, 1234) == ids[250:1484]).all()
    assert len(payload) <= 5003 * width / 8 + 51


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {k: k for k in range(len(prints))}
    for _ in prints:
        moved = {k: min(label[j] for j in label if (prints[j] ^ prints[k]).bit_count() <= 4) for k in label}
        if moved == label:
            break
        label = moved
    return label


@pytest.mark.parametrize("max_bucket", [16_384, 2])
def test_simhash(spark, docs, empty, max_bucket):
    rnd = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words, 300)) for _ in range(12)]
    near = [t.replace(rnd.choice(words), "zz", 1) for t in base for _ in range(4)]
    more = spark.createDataFrame([(100 + i, t, None, None, None, None, None) for i, t in enumerate(base + near)], SCHEMA)
    both = docs.union(more)
    rows = sorted(texts_of(both), key=lambda r: (r[0] is None, r[0]))
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    expected = Counter((i, p - (1 << 64) if p >> 63 else p, rows[label[k]][0]) for k, ((i, _), p) in enumerate(zip(rows, prints)))
    assert Counter(map(tuple, simhash.near_duplicates(both, max_bucket=max_bucket).collect())) == expected
    kept = simhash.keep_first(both)
    assert kept.columns == both.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[k][0] for k in label.values()})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_masks_cover():
    made = simhash.masks(4)
    assert len(made) == 31
    rnd = np.random.default_rng(2)
    for _ in range(5000):
        bits = sum(1 << int(b) for b in rnd.choice(64, 4, False))
        assert any(not m & bits for m in made)


def test_components(spark):
    rnd = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {x: got.get(x, x) for x in label} == label


def brute_lines(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def test_line_rules(spark, docs, empty):
    got = line_rules.line_quality(docs).collect()
    assert Counter((r.doc_id, *r[1:7]) for r in got) == Counter((i, *brute_lines(t)) for i, t in texts_of(docs))
    assert not any(r.kept and r.base_failed for r in got)
    assert line_rules.line_quality(empty).count() == 0
    page = PROSE + "\nClick here to subscribe to our news\n" + "Another calm line of text with quite enough plain words in it."
    cleaned = line_rules.keep_clean(spark.createDataFrame([(1, page, "en", None, None, 1, "s"), (2, None, None, None, None, None, None)], SCHEMA)).collect()
    assert [r.text for r in cleaned] == [page.replace("\nClick here to subscribe to our news", "")]
    assert line_rules.keep_clean(docs).columns == docs.columns


def test_boilerplate_share():
    """A phrase fails the lines that consist mainly of it, not a long line that mentions it."""
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    article = " ".join(" ".join(words[k : k + 6]) + "." for k in range(0, 600, 6))
    texts = [article + " Read the privacy policy first. " + article[::-1], article.replace(".", "") + " click here " + article[::-1].replace(".", ""),
             PROSE + "\nPlease read our privacy policy.", "All rights reserved. Click here now."]
    found = line_rules.judge(pa.array(texts))
    assert found["n_bad_lines"].tolist() == [0, 0, 1, 1] and found["n_lost_words"][0] == 0 and found["kept"][0]


@pytest.mark.parametrize(
    "text, bad",
    [
        ("\n".join(["Home", "About us", "Log in", "Contact", "News", "Our team", "Shop", "Help"]), 8),
        ("Home · News · Contact\n" + PROSE, 1), (PROSE + "\nStart • About us • Log in • Cart", 1),
        ("\n".join(f"Ten ways to cook {w} at home" for w in "rice beans corn kale fish eggs soup stew".split()), 8),
        ("A heading\n\n" + PROSE + "\n\nAnother Heading\n\n" + PROSE[4:], 0),
        ("You need:\nflour\nmilk\neggs\nsugar\nsalt\nbutter\n" + PROSE, 0), ("\n".join(f"- thing {c}" for c in "abcdefgh"), 0),
        ("\n".join(["Tyger Tyger, burning bright,", "In the forests of the night;", "What immortal hand or eye,", "Could frame thy fearful symmetry?"]), 0),
        ("\n".join(f"The {w} is in the wood tonight" for w in "owl elk fox jay".split()) + "\n\n" + "\n".join(f"And {w} falls upon the hill" for w in "snow rain hail dust".split()), 0),
        (PROSE + "Sales · and · marketing are words in a long sentence that goes on for quite some time.", 0),
    ],
)
def test_navigation(text, bad):
    assert line_rules.judge(pa.array([PROSE, text, ""]))["n_bad_lines"].tolist() == [0, bad, 0]


def brute_shingles(text, words=5):
    found = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


@pytest.mark.parametrize("bounds", [{}, {"max_sets": 2}, {"max_shingles": 100}])
def test_near_copies(spark, docs, empty, bounds):
    """Near copies at 0.8 and above become one; a repeated key loses no text."""
    import corpus_pipeline

    rnd = np.random.default_rng(3)
    rows, vocabulary = [], [f"w{k}" for k in range(3000)]
    for doc in range(12):
        words = rnd.choice(vocabulary, 120).tolist()
        for copy in range(5):
            changed = list(words)
            for at in rnd.choice(120, copy, replace=False):
                changed[at] = "changed"
            rows.append((1000 + 10 * doc + copy, " ".join(changed), "en", None, None, 1, "s"))
    rows += [(500, "one text under this key", "en", None, None, 1, "s"), (500, "quite another text under the same key", "en", None, None, 1, "s")]
    both = docs.union(spark.createDataFrame(rows, SCHEMA))
    pairs = [(i if i is not None else 1 << 40, t) for i, t in texts_of(both)]
    sets, root = [brute_shingles(t) for _, t in pairs], list(range(len(pairs)))
    for a, b in itertools.combinations(range(len(pairs)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    expected = Counter(min(p[0] for p, r in zip(pairs, root) if r == c) for c in set(root))
    got = Counter(r.doc_id if r.doc_id is not None else 1 << 40 for r in near_copies.keep_first(both, **bounds).collect())
    assert got == expected and got[500] == 2
    if not bounds:
        staged = Counter(r.doc_id if r.doc_id is not None else 1 << 40 for r in corpus_pipeline.near_duplicates(spark, both, "").collect())
        assert staged == expected and near_copies.keep_first(empty).count() == 0


def test_differencing():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 60, 900):
        sizes = rnd.integers(1, 4096, n)
        slot, k = packing.windows_for(sizes)
        sums = np.bincount(slot, weights=sizes, minlength=k)
        assert sums.max(initial=0) <= 4096 and len(slot) == n
        assert n < 60 or sums.sum() > 0.9 * 4096 * k


def test_packing(docs, empty):
    path = model_path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, 2).collect()
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert 1 <= r.length <= 4096 and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_window[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, bytes(r.ids)))
    for pieces in by_window.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces)][:-1] and sum(n for _, n in pieces) <= 4096
    expected = defaultdict(list)
    for i, t in texts_of(docs):
        expected[i].append(np.array(ids_by_library(path, t), "<u4").tobytes())
    for i, pieces in by_doc.items():
        if len(expected[i]) == 1:
            assert b"".join(raw for _, raw in sorted(pieces)) == expected[i][0]
    assert set(by_doc) == set(expected) and packing.pack_documents(empty, path, 2).count() == 0


def test_templates_match_plain_form():
    templates = decontaminate.Templates()
    for text in [*ODD[1:], "5km to Paris. Then 7 km ... Go! ** A Word In inches", ". X y Z", "He said: Bob 3 kg or 4 In"]:
        template, values = decontaminate.canonical(text)
        hashes, slots, found = templates.template(text)
        assert [decontaminate._hash(t) for t in template] == hashes.tolist()
        assert [t[0] == "\x01" for t in template] == slots.tolist() and [found[k] for k in range(len(found))] == values


@pytest.mark.parametrize("max_sent", [4_000_000, 0])
def test_decontamination(spark, docs, empty, max_sent):
    question = "Yesterday {a} had {x} apples and then he bought {y} more apples at the old market near home, so how many apples does {b} have now?"
    bench = spark.createDataFrame(
        [(7, question.format(a="Tom", b="Tom", x=12, y=5)), (8, None), (9, ""), (10, "one short item of seven plain words"), (10, "one short item of seven plain words")],
        "item_id long, text string",
    ).withColumn("doc_id", F.lit(1))
    rows = [
        (201, question.format(a="Tom", b="Tom", x=12, y=5)), (202, "Noise. " + question.format(a="Anna", b="Anna", x=31, y=8)),
        (203, question.format(a="Anna", b="Bob", x=31, y=8)), (204, PROSE + "\n" + question.format(a="Tom", b="Tom", x=12, y=5).upper()),
        (205, "here is one short item of seven plain words again"), (None, question.format(a="Tom", b="Tom", x=12, y=5)),
    ]
    both = docs.union(spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(both, bench, max_sent=max_sent).collect()}
    assert found == {(201, 7), (202, 7), (204, 7), (205, 10), (None, 7)}
    if max_sent:
        kept = decontaminate.drop_contaminated(both, bench)
        assert kept.columns == both.columns and kept.count() == both.count() - 5
        assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(both, bench.limit(0)).count() == 0


def test_decontamination_edited_number(spark):
    """One edited number does not hide a passage that is copied word for word."""
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    words[100:105] = "12 apples and 12 pears".split()
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    edited = [*words[:103], "15", *words[104:]]
    docs = spark.createDataFrame([(5, " ".join(edited), None, None, None, None, None)], SCHEMA)
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(5, 1)]


def test_decontamination_verbatim(spark):
    """Copies without enough literal words, short items, and copies in other letter case match."""
    items = [
        "12 km + 15 km = 27 km, 3 kg + 4 kg = 7 kg, 8 m + 9 m = 17 m", "Name the old capital", "Paris",
        "Where did Anna Karenina meet Count Vronsky before Moscow", "Nine old men in Rome saw Bob at Paris near Anna and Tom with Sue in Oslo",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [PROSE + items[0], PROSE + items[1], items[2], "A heading\n" + items[3], PROSE + items[4].lower(), PROSE + items[2]]
    docs = spark.createDataFrame([(10 + k, t, None, None, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(10 + k, k) for k in range(5)]


def test_pipeline(spark, sf_dir):
    """Every stage keeps exactly what brute force keeps; the windows hold the masked texts."""
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "benchmark decontamination", "personal data", "packing",
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    rows = sorted(texts_of(docs))
    prints = [brute_fingerprint(t) for _, t in rows]
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows}
    path = model_path("word_bpe_49k.json")
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert all(tokens[i] == len(ids_by_library(path, t)) for i, t in rows[:40])
    assert all(pii.masked(t) == t for _, t in rows) and len(prints) == len(set(i for i, _ in rows))


def test_registered_queries(spark, sf_dir):
    import __spark_entry__ as entry
    import oracle

    from querysentry.llm.queries import ORACLES, QUERIES

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
    con = oracle.duck(sf_dir)
    for name in QUERIES:
        _, rows, verdict = oracle.run(spark, con, name, QUERIES, ORACLES, sf_dir)
        assert verdict in ("equal", "rows-only") and rows > 0, name
