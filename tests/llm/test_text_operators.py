"""Operators against brute force on small tables, odd rows included."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scriptline.llm import automata, bpe, fingerprints, langid, lm, near, packing, pii, quality, queries, repeats, suffixes
from scriptline.llm.text import word_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"
LONG = "x" * 60_000
PASSAGE = " ".join(f"word{i}" for i in range(70))
#: Nulls, empty and blank texts, a long word, repeated rows, equal texts, equal keys, and columns named like internal ones.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "One two three."),
    (5, "One two three."),
    (None, "Nobody knows this one."),
    (None, None),
    (6, "a " + PASSAGE + " b"),
    (7, "c " + PASSAGE + " d"),
    (8, "a " + PASSAGE + " b"),
    (9, "mail me: a.b@example.org <|endoftext|> or +49 (30) 123-456 78"),
    (9, "the same key, another text"),
]
SCHEMA = "doc_id long, text string, lang string, key string, chunk int, kept_0 string, cid string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "k", 7, "x", "c", "w") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Encoding


def test_codec_agrees_with_the_library():
    rng = random.Random(3)
    parts = ["'", "s", "re", " ", "  ", "\n", "a", "Z", "9", "½", "é", "中", "!", "<|endoftext|>", "aaaa", "the", "\x1c", "\x85", "😀", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", LONG[:5000], "word " * 3000]
    ids, at = bpe.codec(PATH).encode(pa.array(texts, pa.string()))
    library = Tokenizer.from_file(PATH)
    for i, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == found.ids, texts[i]
    data, until = bpe.codec(PATH).decode(ids, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(until[:-1], until[1:], strict=True)] == texts


def thue_morse(n):
    """A word of 2**n letters and its complement: any polynomial hash modulo 2**64 takes long ones as equal."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomial_hashes_are_kept_apart():
    a, b = thue_morse(10)
    text = f"x {a} {b}"
    ids, at = bpe.codec(PATH).encode(pa.array([text, b, a]))
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate((text, b, a)):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
    data, until = bpe.codec(PATH).decode(ids, at)
    assert data[until[0] : until[1]].tobytes().decode() == text
    hashes, _ = word_hashes(pa.array([text]))
    assert len(set(hashes.tolist())) == 3


def test_equal_hashes_do_not_make_equal_bytes(monkeypatch):
    """Even if all pre-tokens had one hash, the ids would be right."""
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    text = "one two  three, four's twenty-one two"
    ids, _ = bpe.codec(PATH).encode(pa.array([text]))
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_substring_dedup_keeps_the_two_words_apart(spark):
    a, b = thue_morse(10)
    table = spark.createDataFrame([(1, " ".join([a, *"pqrs"] * 12)), (2, " ".join([b, *"pqrs"] * 12)), (3, " ".join([a, *"pqrs"] * 12))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in automata.remove_repeats(table).collect()} == {1: 0, 2: 0, 3: 60}


def test_compatibility_is_what_bpe_does():
    coder, rng = bpe.codec(PATH), np.random.default_rng(5)
    library = Tokenizer.from_file(PATH)
    a, b = rng.integers(0, 50_000, 400), rng.integers(0, 50_000, 400)
    for x, y, good in zip(a, b, coder.compatible(a, b), strict=True):
        found = library.model.tokenize(library.id_to_token(int(coder._ids[x])) + library.id_to_token(int(coder._ids[y])))
        assert good == ([t.id for t in found] == [coder._ids[x], coder._ids[y]])


def test_encode_and_decode_tables(odd, empty):
    encoded = bpe.encode(odd, PATH)
    back = bpe.decode(encoded, PATH, keep=("n_tokens",))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in ODD)
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


# Packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_row_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, int(rng.integers(0, 2000))), minlength=65) * (rng.random(65) < 0.8)
    counts[0] = 0
    made = packing.plan(counts)
    length = np.repeat(np.arange(65), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    if not len(length):
        assert made.sequences == 0
        return
    sequence, offset = made.place(length, rank)
    taken = set()
    for s, o, n in zip(sequence, offset, length, strict=True):
        for place in range(o, o + n):
            assert place < 64 and (s, place) not in taken
            taken.add((s, place))
    full = np.bincount(sequence, weights=length)
    assert len(full) == made.sequences and all((s, 0) in taken for s in range(made.sequences))
    assert all(max(p for q, p in [(s, offset[i] + length[i]) for i in np.flatnonzero(sequence == s)]) == full[s] for s in range(min(20, made.sequences)))
    bound = -(-int(length.sum()) // 64)
    assert bound <= made.sequences <= sum(t for _, t in packing.best_fit(counts))


@pytest.mark.parametrize("kind", ["uniform", "short", "heavy", "few"])
def test_plan_is_never_worse_than_best_fit(kind):
    rng = np.random.default_rng(5)
    lengths = {
        "uniform": rng.integers(1, 1025, 200_000),
        "short": rng.integers(20, 300, 200_000),
        "heavy": np.minimum(1024, (20 * (1 + rng.pareto(0.9, 100_000))).astype(int)),
        "few": rng.choice([100, 131, 362, 700], 50_000),
    }[kind]
    counts = np.bincount(lengths, minlength=1025)
    made, plain = packing.plan(counts), sum(t for _, t in packing.best_fit(counts))
    assert -(-int(lengths.sum()) // 1024) <= made.sequences <= plain
    if kind == "few":  # 5 x 131 + 362 + ... : patterns of repeated short lengths are at work
        assert packing.fitted_plan(counts, True).sequences <= plain


def fewest(lengths, capacity):
    """Least number of sequences, by trying all ways."""
    best = len(lengths)

    def go(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for j in {f: j for j, f in enumerate(free)}.values():
            if free[j] >= lengths[i]:
                go(i + 1, [*free[:j], free[j] - lengths[i], *free[j + 1 :]])
        go(i + 1, [*free, capacity - lengths[i]])

    go(0, [])
    return best


def test_plan_is_near_the_optimum_of_small_cases():
    rng, over = random.Random(8), 0
    for _ in range(60):
        capacity = rng.randint(5, 24)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 11))), reverse=True)
        made, best = packing.plan(np.bincount(lengths, minlength=capacity + 1)).sequences, fewest(lengths, capacity)
        assert best <= made <= best + 1
        over += made > best
    assert over <= 3


def test_fit_finds_an_exact_solution():
    counts = np.zeros(33)
    counts[[10, 22]] = 50
    counts[[5, 6, 21]] = 30
    shapes, times = packing.patterns(counts)
    used, x = packing.fit(counts, shapes, times)
    found = {tuple(sorted(shapes[p])): round(float(v), 3) for p, v in zip(used, x, strict=True) if v > 0.5}
    assert found == {(0, 10, 22): 50.0, (5, 6, 21): 30.0}


def test_patterns_fill_a_sequence():
    counts = np.zeros(101, np.int64)
    counts[[7, 9, 25, 30, 37, 63]] = 1
    shapes, times = packing.patterns(counts)
    assert ((shapes * times).sum(axis=1) == 100).all() and (counts[shapes[shapes > 0]] == 1).all()
    found = {tuple(sorted((int(n), int(t)) for n, t in zip(s, c, strict=True) if n)) for s, c in zip(shapes, times, strict=True)}
    assert ((25, 4),) in found and ((37, 1), (63, 1)) in found and ((7, 9), (37, 1)) in found and ((7, 3), (30, 1), (49, 1)) not in found


def test_packed_documents(odd, empty, docs, texts):
    for table in (odd, docs):
        found = packing.pack(packing.pieces(table, PATH, keep_ids=True))[0].collect()
        by_sequence = collections.defaultdict(list)
        for r in found:
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for placed in by_sequence.values():
            end = 0
            for offset, length in sorted(placed):
                assert offset == end
                end += length
            assert end <= 1024
    library = Tokenizer.from_file(PATH)
    pieces = collections.defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids))
    for doc, text in texts.items():
        own = sorted(pieces[doc])
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(p[3] for p in own), "<u4").tolist() == ids
        assert all(n == 1024 for _, _, n, _ in own[1:]) and [s for _, s, _, _ in own] == np.cumsum([0, *(p[2] for p in own)])[:-1].tolist()
    assert packing.pack(packing.pieces(empty, PATH))[0].count() == 0


# Languages


def test_languages_of_held_out_texts(docs):
    labels = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.predict(docs, langid.fit(docs.where(~queries.held_out()))).where(queries.held_out()).collect()
    assert np.mean([labels[r.doc_id] == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.coverage <= 1 for r in found)


def test_language_edge_cases(odd, empty):
    model = langid.fit(odd)
    assert model.languages == ("en",)
    found = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und"), (5, "en"), (None, "en")} <= found
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_filters_hold_every_ngram_and_correct_false_hits():
    settings = langid.Settings(rows=256, hashes=3)
    rng = np.random.default_rng(0)
    own = rng.integers(1, 1 << 40, 40)
    bits = np.zeros((256, 2), np.uint64)
    for row in langid.positions(own, settings):
        bits[row, 1] |= np.uint64(2)  # language 65
    model = langid.LanguageFilters(tuple(f"l{i:02d}" for i in range(66)), bits, settings)
    assert (model.masks(own)[:, 1] == 2).all()
    other = model.masks(rng.integers(1, 1 << 40, 20_000))[:, 1] == 2
    assert abs(other.mean() - model.false_positives()[65]) < 0.03


# Fingerprints


def test_fingerprints_of_edited_texts(docs, texts):
    order = sorted(texts, reverse=True)
    found = {r.doc_id: r for r in fingerprints.compare_with_edits(docs).collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert len(found) == len(texts)
    for i, doc in enumerate(order):
        after = texts[order[(i + 1) % len(order)]]
        changed = fingerprints.edited(texts[doc], after)
        assert found[doc].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert found[doc].fingerprint == plain[doc] and found[doc].n_chars == len(texts[doc])
        own, other = (fingerprints.read_back(x) for x in (found[doc].fingerprint, found[doc].edited_fingerprint))
        assert found[doc].near_edited == fingerprints.likeness(own, other)
    assert np.mean([r.near_edited > r.near_next for r in found.values()]) > 0.9


def test_chunks_resist_shifts_and_cover_texts():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 20_000).astype(np.uint8).tobytes().decode()
    first, second = (fingerprints.chunk_sets(pa.array([t]))[0] for t in (text, "inserted at the front " + text))
    assert fingerprints.likeness(first, second) > 0.98
    start, end, _ = fingerprints.chunks(*fingerprints.utf8(pa.array([text, "short", ""])))
    assert sorted(zip(start, end, strict=True))[0][0] == 0 and (end - start).sum() == 20_005 and (end - start).max() <= fingerprints.LARGEST


def test_fingerprint_edge_cases(odd, empty, spark):
    found = fingerprints.compare_with_edits(odd).collect()
    assert len(found) == len(ODD)
    assert {r.fingerprint for r in found if r.n_chars == 0} == {""}
    one = fingerprints.compare_with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    assert fingerprints.compare_with_edits(empty).count() == 0 and fingerprints.fingerprint(empty).count() == 0
    assert fingerprints.likeness(np.zeros(0, np.uint64), np.zeros(0, np.uint64)) == 1.0


# Language model


def test_scores(odd, empty):
    found = lm.score(odd, order=3).collect()
    lists = [words_of(t) for _, t in ODD]
    counts = [collections.Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1)) for n in range(4)]
    total = sum(map(len, lists))

    def value(gram):
        if len(gram) == 1:
            return math.log(counts[1][gram] / total)
        if counts[len(gram)][gram] >= 2:
            return math.log(counts[len(gram)][gram] / counts[len(gram) - 1][gram[:-1]])
        return math.log(0.4) + value(gram[1:])

    wanted = sorted((len(w), round(sum(value(tuple(w[max(0, i - 2) : i + 1])) for i in range(len(w))), 6)) for w in lists)
    assert sorted((r.n_words, round(r.log_score, 6)) for r in found) == wanted
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in found)
    assert lm.score(empty).count() == 0


# Repeated passages


def test_automaton_matches_earlier_sequences():
    rng = np.random.default_rng(0)
    for _ in range(100):
        width = int(rng.integers(2, 6))
        sequences = [rng.integers(0, 3, int(rng.integers(width, 30))).tolist() for _ in range(8)]
        keys = np.sort(rng.integers(0, 5, 8))
        for key, own, found in zip(keys, sequences, automata.match(keys, sequences, width), strict=True):
            before = {tuple(x[i : i + width]) for k, x in zip(keys, sequences, strict=True) if k < key for i in range(len(x) - width + 1)}
            assert found.tolist() == [i for i in range(len(own) - width + 1) if tuple(own[i : i + width]) in before]


def test_suffixes_find_all_repeats_with_and_without_files():
    rng = np.random.default_rng(0)
    for _ in range(100):
        width, number = int(rng.integers(2, 9)), int(rng.integers(1, 6))
        lengths = rng.integers(1, 60, number)
        data = rng.integers(0, int(rng.integers(1, 4)), lengths.sum()).astype(np.uint8)
        found = suffixes.repeated_windows(data, lengths, width, in_memory=int(rng.integers(1, 50)))
        ends = np.repeat(np.cumsum(lengths), lengths)
        strings = [data[i : i + width].tobytes() if i + width <= ends[i] else None for i in range(len(data))]
        counts = collections.Counter(strings)
        assert found.tolist() == [s is not None and counts[s] > 1 for s in strings]


def test_windows_share_anchors():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 3, 400).astype(np.uint64)
    offsets = np.array([0, 0, 150, 160, 400])
    found = repeats.windows(symbols, offsets, 20, 4)
    anchors = {}
    for first, count, anchor in zip(found.first, found.count, found.anchor, strict=True):
        for at in range(first, first + count):
            anchors.setdefault(tuple(symbols[at : at + 20]), set()).add(anchor)
    assert all(len(a) == 1 for a in anchors.values()) and found.count.sum() == 131 + 221


def earlier_removed(texts, width):
    first = {}
    lists = [(i, words_of(t)) for i, t in sorted(texts.items())]
    for i, w in lists:
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    for i, w in lists:
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def bytes_removed(raw, width):
    counts = collections.Counter(b[k : k + width] for b in raw for k in range(len(b) - width + 1))
    for b in raw:
        gone = {k + j for k in range(len(b) - width + 1) if counts[b[k : k + width]] > 1 for j in range(width)}
        spans = sum(k in gone and k - 1 not in gone for k in range(len(b)))
        yield len(b), len(gone), spans, bytes(x for k, x in enumerate(b) if k not in gone)


def test_word_passages(docs, texts, odd, empty):
    assert rows(automata.remove_repeats(docs)) == sorted(earlier_removed(texts, 50), key=repr)
    found = collections.Counter((r.doc_id, r.n_removed) for r in automata.remove_repeats(odd).collect())
    assert found[6, 0] == 1 and found[7, 70] == 1 and found[8, 72] == 1
    assert sum(n for (_, gone), n in found.items() if gone == 0) == len(ODD) - 2
    assert automata.remove_repeats(empty).count() == 0


def test_byte_passages(docs, texts, odd, empty):
    found = sorted(tuple(r)[1:] for r in suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect())
    assert found == sorted(bytes_removed([t.encode() for t in texts.values()], 200))
    found = sorted(tuple(r)[1:] for r in suffixes.remove_repeats(odd, keep=("chunk", "key")).drop("chunk", "key").collect())
    plain = [(i, t) for i, t in ODD if t != LONG]
    wanted = list(bytes_removed([(t or "").encode() for _, t in plain], 200))
    assert found == sorted([*wanted, (len(LONG), len(LONG), 1, b"")])
    assert suffixes.remove_repeats(empty).count() == 0


def around_a_line(number):
    """Texts with one line in surroundings of their own, and some with surroundings that are there twice."""
    rng = random.Random(3)
    line = "all of these words stand in very many texts and their neighbours differ "
    sides = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(2 * number)]
    texts = [f"{sides[2 * i]} {line * (1 + i % 2)}{sides[2 * i + 1]}" for i in range(number)]
    twice = [f"z{i} {texts[i]} {line}" for i in range(0, number, 5)]
    return list(enumerate([*texts, *twice, line * 30, line * 40]))


@pytest.mark.parametrize("hot", [0, 5])
def test_byte_passages_of_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 5000)
    given = around_a_line(60)
    table = spark.createDataFrame(given, "doc_id long, text string")
    found = suffixes.remove_repeats(table, hot=hot).select("n_bytes", "n_removed", "n_spans", "kept")
    wanted = list(bytes_removed([t.encode() for _, t in given], 200))
    assert sum(w[1] > 0 for w in wanted) > 20 and sorted(map(tuple, found.collect())) == sorted(wanted)


@pytest.mark.parametrize("hot", [0, 5])
def test_word_passages_of_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(automata, "CHUNK_BYTES", 5000)
    given = [(i - 30 if i % 7 else 3, t) for i, t in around_a_line(60)]
    given = list({i: t for i, t in given}.items())
    table = spark.createDataFrame([*given, (None, given[4][1])], "doc_id long, text string")
    found = rows(automata.remove_repeats(table, hot=hot))
    wanted = list(earlier_removed(dict(given), 50))
    last = len(words_of(given[4][1]))
    assert sum(w[2] > 0 for w in wanted) > 5 and found == sorted([*wanted, (None, last, last, "")], key=repr)


# Personal data


def plain_spans(text):
    """The patterns as they are stated."""
    out = {"email": [], "ip": [], "card": [], "phone": []}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(digits) <= 19 and (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


def test_plain_identifiers(texts):
    rng = random.Random(7)
    made = ["".join(rng.choice("a.@+-_1290 ()xé") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    made += ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+1 (168) 555-5254", "a@b@c.de"]
    for text in [*texts.values(), *made]:
        assert pii.identifiers(text) == plain_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.doe [at] example (dot) com today", "email", "john.doe [at] example (dot) com"),
        ("john at example dot com", "email", "john at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("jo​hn@example.com", "email", "jo​hn@example.com"),
        ("１２３.1.2.3", "ip", "１２３.1.2.3"),
        ("ip one two seven dot zero dot zero dot one.", "ip", "one two seven dot zero dot zero dot one"),
        ("plus four nine one two three four five six seven eight nine", "phone", "plus four nine one two three four five six seven eight nine"),
    ],
)
def test_disguised_identifiers(text, kind, found):
    _, added = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, found)]


@pytest.mark.parametrize("rest", ["", " or a@b.org", " someone on the phone", " or a@b.org, someone on the phone"])
@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("server 192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
        ("call +44 20 7946 oh one two 3456", "phone", "+44 20 7946 oh one two 3456"),
        ("call +44 20 7946 012 oh SIX", "phone", "+44 20 7946 012 oh SIX"),
    ],
)
def test_other_content_does_not_decide(text, kind, span, rest):
    text = f"{text};{rest}"
    assert [(k, text[a:b]) for k, a, b in pii.find(text)[1]] == [(kind, span)]


def test_prose_is_left_alone(texts):
    for text in ["meet me at home. dot", "look at one two three", "un deux", *texts.values()]:
        assert pii.find(text)[1] == []


def test_personal_data_table(odd, empty):
    found = {(r.doc_id, r.masked): r for r in pii.detect(odd, mask=True, keep=("key", "chunk")).collect()}
    masked = found[9, "mail me: <email> <|endoftext|> or <phone>"]
    assert (masked.n_email, masked.n_phone, masked.key, masked.chunk) == (1, 1, "k", 7)
    assert (1, None) in found and (2, "") in found and pii.detect(empty).count() == 0
    assert pii.emails("a" * 200_000) == [] and pii.emails("b@" * 50_000) == []


# Quality


def test_quality_features(docs, texts, odd, empty):
    for table, given in ((docs, sorted(texts.items())), (odd, ODD)):
        wanted = []
        for doc, text in given:
            w, text = words_of(text), text or ""
            grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in text.split("\n") if words_of(x)]
            failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
            wanted.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed))
        columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        found = quality.clean(table)
        assert rows(found.select(columns)) == sorted(wanted, key=repr)
        assert found.where("base_failed and kept").count() == 0
    assert quality.clean(empty).count() == 0


def test_quality_agrees_with_labels(spark, docs):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = quality.clean(docs).join(labels, "doc_id").where("n_words >= 50").select("kept", "quality").collect()
    assert found and all(r.kept == (r.quality == 1) for r in found)


@pytest.mark.parametrize(
    ("line", "rule"),
    [("Home | About | Contact", "navigation"), ("All rights reserved.", "boilerplate"), ("To### be$$$ fixed%%%", "punctuation"), ("A line of prose.", "")],
)
def test_line_rules(line, rule):
    assert quality.failure(line, quality.Rules()) == rule


# Near duplicates


def classes_by_force(given, threshold=0.8):
    sets = {}
    for n, (_, text) in enumerate(given):
        w = words_of(text)
        sets[n] = set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()
    label = list(range(len(given)))
    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= threshold * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    groups = collections.defaultdict(list)
    for n, x in enumerate(label):
        groups[x].append(n)
    for members in groups.values():
        named = [given[n][0] for n in members if given[n][0] is not None]
        for n in members:
            yield given[n][0], min(named) if named else None, len(members)


def test_near_duplicates(docs, texts, odd, empty):
    assert rows(near.classes(docs)) == sorted(classes_by_force(sorted(texts.items())), key=repr)
    assert rows(near.classes(odd)) == sorted(classes_by_force(ODD), key=repr)
    assert near.classes(empty).count() == 0


def test_large_groups_whose_members_differ_from_their_leader(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    given = [(0, " ".join(base))]
    for i in range(1, 40):
        own = list(base)
        for j in rng.sample(range(0, 100, 10), 2):
            own[j] = f"x{i}"
        given.append((i, " ".join(own)))
    table = spark.createDataFrame(given, "doc_id long, text string")
    assert rows(near.classes(table)) == sorted(classes_by_force(given), key=repr)


def test_repeated_lines_do_not_hide_near_duplicates(spark):
    given = []
    for i in range(20):
        base = " ".join(f"b{i}x{j}" for j in range(104))
        line = " ".join(f"r{i}x{j}" for j in range(15))
        given += [(2 * i, base), (2 * i + 1, base + f" {line}" * 500)]  # 100 of 119 shingles, 15 of them 500 times
    table = spark.createDataFrame(given, "doc_id long, text string")
    wanted = sorted(classes_by_force(given), key=repr)
    assert [n for _, _, n in wanted] == [2] * 40 and rows(near.classes(table)) == wanted


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    common = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    own = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    a, b = np.concatenate([common, own[:150]]), np.concatenate([common, own[150:]])
    items, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    found = near.signatures(items, np.ones(len(items), np.int64), offsets, size=2000)
    assert abs((found[0] == found[1]).mean() - len(common) / (len(common) + len(own))) < 0.05


def test_one_row_of_each_class_stays(odd, spark):
    found = near.one_per_class(odd)
    assert found.columns == odd.columns
    kept = collections.Counter((r.doc_id, r.text) for r in found.collect())
    assert kept[5, "One two three."] == 1 and kept[1, None] == 1 and kept[6, ODD[8][1]] == 1 and kept[8, ODD[8][1]] == 0


# Registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    wanted = sorted(map(tuple, cursor.fetchall()), key=repr)
    found = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(columns) and rows(found.select(columns)) == wanted
