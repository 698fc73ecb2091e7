"""Language ID, fingerprints and quality rules against plain versions, a character or byte at a time."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from scriptline.llm import fingerprints, langid, pii, quality, queries
from scriptline.llm.bpe import LETTER, character_classes
from scriptline.llm.text import SLICE_BYTES

SF_DIR = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def digest(raw):
    """Sum of the mixed eight-byte blocks, mixed again."""
    total = 0
    for i in range(0, len(raw), 8):
        total += mixed(int.from_bytes(raw[i : i + 8], "little") ^ mixed((i // 8 + 1) * STEP & MASK))
    return mixed((total + len(raw) * 0xD6E8FEB86659FD93) & MASK)


# Fingerprints


def plain_chunks(raw):
    gear = [int(x) for x in fingerprints._GEAR]
    hashes = [sum(gear[raw[i - j]] << 2 * j for j in range(min(16, i + 1))) & 0xFFFFFFFF for i in range(len(raw))]
    out, begin = [], 0
    while begin < len(raw):
        size = fingerprints.SMALLEST
        while size < fingerprints.LARGEST and begin + size < len(raw):
            last = hashes[begin + size - 1]
            if last >> (26 if size < fingerprints.NORMAL else 28) == 0:
                break
            size += 1
        out.append(raw[begin : begin + size])
        begin += size
    return out


def plain_fingerprint(text):
    return sorted({(digest(c) >> 32 << 8) | len(c) for c in plain_chunks((text or "").encode())})


def plain_likeness(own, other):
    return float(not other) if not own else sum(x & 255 for x in own if x in set(other)) / sum(x & 255 for x in own)


def test_fingerprints_agree_with_the_plain_version(docs, texts):
    found = fingerprints.compare_with_edits(docs).collect()
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    sets = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert len(found) == len(texts)
    for r in found:
        changed = plain_fingerprint(fingerprints.edited(texts[r.doc_id] or "", texts[after[r.doc_id]] or ""))
        assert r.fingerprint == "".join(f"{x:010x}" for x in sets[r.doc_id]) and r.edited_fingerprint == "".join(f"{x:010x}" for x in changed)
        assert r.near_edited == pytest.approx(plain_likeness(sets[r.doc_id], changed), abs=1e-12)
        assert r.near_next == pytest.approx(plain_likeness(sets[r.doc_id], sets[after[r.doc_id]]), abs=1e-12)


def test_fingerprint_of_a_text_of_several_slices():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 20_000).astype(np.uint8)).decode() * (2 * SLICE_BYTES // 20_000 + 1)
    items, at = fingerprints.chunk_sets(pa.array(["short", text, None]))
    assert len(text) > 2 * SLICE_BYTES and items[at[1] : at[2]].tolist() == plain_fingerprint(text)


# Language ID


def plain_trigrams(text):
    kinds, text = character_classes(), f"\n{(text or '').lower()}\n"
    letters = [c if kinds[ord(c)] == LETTER else "" for c in text]
    return collections.Counter(tuple(letters[i - 1 : i + 2]) for i in range(1, len(letters) - 1) if letters[i])


def plain_rows(gram, settings):
    a, b, c = (ord(x) if x else 0 for x in gram)
    one = mixed((a << 42 | b << 21 | c) + 1)
    two = mixed(one) | 1
    return {(one + i * two & MASK) % settings.rows for i in range(settings.hashes)}


def test_predictions_agree_with_the_plain_version(docs):
    rows = docs.select("doc_id", "text", "lang", queries.held_out().alias("out")).collect()
    settings = langid.Settings(rows=1 << 14, hashes=3)
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if not r.out and r.lang is not None and r.text is not None:
            counts[r.lang].update(plain_trigrams(r.text))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    share = {lang: {g: s for g, s in c.items() if s >= settings.min_share} for lang, c in share.items()}
    filters = {}
    for lang in sorted(share):
        filters[lang] = set()
        for g, s in share[lang].items():
            if s * settings.contrast >= max(c.get(g, 0) for c in share.values()):
                filters[lang] |= plain_rows(g, settings)
    wrong = {lang: (len(f) / settings.rows) ** settings.hashes for lang, f in filters.items()}
    model = langid.fit(docs.where(~queries.held_out()), settings=settings)
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert set(found) == {r.doc_id for r in rows} and len(filters) == 4
    for r in rows:
        grams = plain_trigrams(r.text)
        total = sum(grams.values())
        shares = {}
        for lang, f in filters.items():
            hits = sum(n for g, n in grams.items() if plain_rows(g, settings) <= f)
            shares[lang] = min(max((hits / max(total, 1) - wrong[lang]) / (1 - wrong[lang]), 0), 1)
        best = max(shares, key=lambda x: (shares[x], -sorted(shares).index(x)))
        expected = ("und", 0.0, 0.0) if not total else (best, shares[best] / max(sum(shares.values()), 1e-12), shares[best])
        got = found[r.doc_id]
        assert got.lang_pred == expected[0] and (got.score, got.coverage) == pytest.approx(expected[1:], abs=1e-9)


def test_language_of_a_text_of_several_slices(spark, docs):
    model = langid.fit(docs.where(~queries.held_out()))
    known = docs.where("lang IS NOT NULL AND length(text) > 500").orderBy("doc_id").first()
    long = known.text * (2 * SLICE_BYTES // len(known.text) + 1)
    found = langid.predict(spark.createDataFrame([(1, long), (2, known.text)], "doc_id long, text string"), model).collect()
    assert len(long) > 2 * SLICE_BYTES and {r.lang_pred for r in found} == {known.lang}


# Quality rules


def test_verdicts_agree_with_the_plain_version(docs, texts):
    rules = quality.Rules()
    found = {r.doc_id: r for r in quality.clean(docs).collect()}
    for doc, text in texts.items():
        stay, lost, gone, seen = [], 0, 0, set()
        for line in (text or "").split("\n"):
            n = len([w for w in quality.WORD.findall(line)])
            if quality.failure(line, rules) or (line in seen and n >= rules.repeat_words):
                lost, gone = lost + n, gone + 1
            else:
                stay.append(line)
            seen.add(line)
        r = found[doc]
        assert (r.n_lost, r.n_lines_lost, r.clean) == (lost, gone, "\n".join(stay) if text is not None else None)
        assert r.kept == (not r.base_failed and 2 * lost <= r.n_words)


def test_half_of_the_words_may_go(spark):
    prose = " ".join(f"word{i}" for i in range(40))
    notice = " ".join(f"all{i}" for i in range(37)) + " all rights reserved"  # 40 words
    rows = [(1, f"{prose}.\n{notice}"), (2, f"{prose}.\n{notice}\nprivacy policy"), (3, f"{prose}.\n{'z ' * 0}{notice}")]
    found = {r.doc_id: (r.n_words, r.n_lost, r.kept) for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (80, 40, True), 2: (82, 42, False), 3: (80, 40, True)}


# Personal data


@pytest.mark.parametrize("blank", [" ", "\t", " \t"])
def test_long_blanks_take_linear_time(blank):
    for text in ("(x)" + blank * 200_000, "one" + blank * 200_000 + "two", "a" + blank * 200_000 + "at b dot c", "(" * 200_000, "(at)" + blank * 200_000 + "(dot)"):
        assert pii.find(text)[0] == []


def test_brackets_after_blanks():
    for text in ("john  (at)  mail [dot] org", "john (at) (at) x", "\t(dot) (at)john (at)mail(dot)org"):
        now = pii.rewrite(text)
        assert now is not None and "(at)" not in now.text and "[dot]" not in now.text
    assert [text for _, a, b in pii.find("to john  (at)  mail [dot] org")[1] for text in ["to john  (at)  mail [dot] org"[a:b]]] == ["john  (at)  mail [dot] org"]
