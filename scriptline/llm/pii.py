"""Personal data: plain identifiers and disguised ones, with offsets in the source text.

Plain identifiers (e-mail, IPv4, card and phone numbers) are found as they stand. Disguised ones are found by two
transducers that rewrite a text and keep, for every character they put out, the source span it stands for:

1. characters: look-alikes and full-width forms become ASCII, invisible characters vanish, at and dot in brackets
   become ``@`` and ``.``, runs of spelled digits become digits, a spelled plus before them becomes ``+``;
2. words: ``name at host dot tld`` becomes an address (at least one dot must be spelled, so that prose is left alone).

An identifier of the rewritten text counts if its span holds something rewritten and reaches beyond every plain one of
the same kind that it overlaps; its span is mapped back to source characters. Offsets are code points, the end is exclusive.

Null and empty texts have no identifiers. Very long texts are searched in linear time. Equal rows give equal results.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.text import slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Letters that look like ASCII letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ℓ": "l", "·": ".", "․": ".", "。": ".", "•": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters without a shape.
INVISIBLE = "­​‌‍⁠﻿"
#: Digits as words, 0 to 9.
SPELLED = {
    "en": ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    "de": ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    "fr": ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    "es": ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
}
DIGIT_WORDS = {w: str(i) for words in SPELLED.values() for i, w in enumerate(words)} | {"oh": "0"}


def _characters() -> dict[str, str]:
    table = {c: "" for c in INVISIBLE} | LOOK_ALIKES
    wide = [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x24EA)]  # full-width, mathematical, circled
    for c in map(chr, wide):
        plain = unicodedata.normalize("NFKC", c)
        if plain.isascii() and len(plain) == 1:
            table[c] = plain
    return table


CHARACTERS = _characters()
_ODD = frozenset(CHARACTERS)
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_AT, _DOT = "at|arroba|chez", "dot|punto|punkt|point"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# Blanks before a bracket are looked at from their first one only, so that a run of them costs no more than its length.
_BRACKETS = re.compile(rf"(?:(?<![ \t])[ \t]++)?{_OPEN}[ \t]*(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))[ \t]*{_CLOSE}[ \t]*", re.I)
_SPELLED_RUN = re.compile(rf"\b(?:plus[ \t-]+)?(?:{_WORD})(?:[ \t,.-]+(?:{_WORD}|[0-9]+|{_DOT}))*[ \t,-]+(?:{_WORD}|[0-9]+)\b", re.I)
_RUN_PART = re.compile(rf"plus[ \t-]+|{_DOT}|{_WORD}|[0-9]+|[ \t,.-]+", re.I)
_PROSE_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]+(?:{_AT})[ \t]+(?=[A-Za-z0-9-]{{1,63}}[ \t]+(?:{_DOT})[ \t]+[A-Za-z0-9])", re.I)
_PROSE_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]+(?:{_DOT})[ \t]+(?=[A-Za-z0-9])", re.I)
#: What matters of these without an @: dots between digits.
_DIGIT_DOT = re.compile(rf"(?<=[0-9])[ \t]+(?:{_DOT})[ \t]+(?=[0-9])", re.I)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@host, found from the @ signs so that long runs cost no more than their length."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        end = at + 1
        if begin < at and (host := _HOST.match(text, at + 1)):
            end = last = host.end()
            found.append((begin, end))
        at = text.find("@", end)
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def identifiers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the plain identifiers by kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if not _DIGIT.search(text):
        return found
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


@dataclass
class Rewritten:
    """A text and, for each of its characters, the source span it stands for and whether it was rewritten."""

    text: str
    start: np.ndarray
    end: np.ndarray
    changed: np.ndarray

    @classmethod
    def source(cls, text: str) -> Rewritten:
        n = len(text)
        return cls(text, np.arange(n), np.arange(1, n + 1), np.zeros(n, bool))

    def replace(self, edits: list[tuple[int, int, list[tuple[int, int, str]]]]) -> Rewritten:
        """Replace disjoint ranges, each by characters that stand for (start, end) of the present text."""
        if not edits:
            return self
        text, start, end, changed, last = [], [], [], [], 0
        for a, b, out in [*edits, (len(self.text), len(self.text), [])]:
            text.append(self.text[last:a])
            start.append(self.start[last:a])
            end.append(self.end[last:a])
            changed.append(self.changed[last:a])
            if out:
                text.append("".join(c for _, _, c in out))
                start.append(np.array([self.start[i] for i, _, _ in out]))
                end.append(np.array([self.end[j - 1] for _, j, _ in out]))
                changed.append(np.array([c != self.text[i:j] for i, j, c in out]))
            last = b
        return Rewritten("".join(text), np.concatenate(start), np.concatenate(end), np.concatenate(changed).astype(bool))


def _run(m: re.Match) -> tuple[int, int, list[tuple[int, int, str]]]:
    out: list[tuple[int, int, str]] = []
    for part in _RUN_PART.finditer(m.string, *m.span()):
        word = part[0].lower()
        if word[0].isdigit():
            out += [(i, i + 1, m.string[i]) for i in range(*part.span())]
        elif word.startswith("plus"):
            out.append((*part.span(), "+"))
        elif word in DIGIT_WORDS:
            out.append((*part.span(), DIGIT_WORDS[word]))
        elif word.isalpha() or word.strip() == ".":
            out.append((*part.span(), "."))
    return (*m.span(), out)


def rewrite(text: str) -> Rewritten | None:
    """The text without disguises, None if it holds nothing that looks like one."""
    lower = text.lower().replace("i\u0307", "i").replace("ſ", "s")  # as patterns without case do
    odd = not text.isascii() and not _ODD.isdisjoint(text)
    brackets = any(c in text for c in "[({<") and _BRACKETS.search(text)
    spelled = any(w in lower for w in DIGIT_WORDS)
    dotted = any(w in lower for w in _DOT.split("|"))
    if not (odd or brackets or spelled or dotted):
        return None
    now = Rewritten.source(text)
    if odd:
        now = now.replace([(i, i + 1, [(i, i + 1, c) for c in CHARACTERS[x]]) for i, x in enumerate(text) if x in _ODD])
    now = now.replace([(*m.span(), [(*m.span(), "@" if m["at"] else ".")]) for m in _BRACKETS.finditer(now.text)])
    if spelled or odd:
        now = now.replace([_run(m) for m in _SPELLED_RUN.finditer(now.text)])
    if dotted or odd:
        now = now.replace([(*m.span(), [(*m.span(), "@")]) for m in _PROSE_AT.finditer(now.text)])
        dots = _PROSE_DOT if "@" in now.text else _DIGIT_DOT
        now = now.replace([(*m.span(), [(*m.span(), ".")]) for m in dots.finditer(now.text)])
    return now if now.changed.any() or len(now.text) != len(text) else None


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, added spans), each (kind, start, end) by start and kind."""
    plain = identifiers(text)
    added: list[tuple[str, int, int]] = []
    if (now := rewrite(text)) is not None:
        for kind, spans in identifiers(now.text).items():
            taken = plain[kind]
            for a, b in spans:
                begin, end = int(now.start[a]), int(now.end[b - 1])
                disguised = now.changed[a:b].any() or end - begin != b - a
                beyond = all(begin <= x and y <= end and end - begin > y - x for x, y in taken if begin < y and x < end)
                if disguised and beyond:
                    added.append((kind, begin, end))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted([(k, a, b) for k, spans in plain.items() for a, b in spans], key=order), sorted(added, key=order)


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, n_email, n_ip, n_card, n_phone, base, spans[, masked]).

    ``base`` lists the plain spans, ``spans`` all of them, as kind:start:end; ``masked`` is the text without them,
    null for a null text.
    """
    names = ["key", *(f"kept_{i}" for i in range(len(keep)))]
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = [find(t) if t else ([], []) for t in texts]
                number = {k: i for i, k in enumerate(KINDS)}
                every = [sorted(base + more, key=lambda s: (s[1], number[s[0]], s[2])) for base, more in found]
                columns = [part.column(n) for n in names]
                columns += [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
                columns += [pa.array([shown(base) for base, _ in found], pa.string()), pa.array([shown(x) for x in every], pa.string())]
                if mask:
                    columns.append(pa.array([None if t is None else masked(t, x) for t, x in zip(texts, every, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *counts, "base", "spans", *["masked"] * mask])

    columns = [key, *keep]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col(text).alias("text"))
    kinds = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    longs = ", ".join(f"{c} long" for c in counts)
    out = source.mapInArrow(run, f"{kinds}, {longs}, base string, spans string" + ", masked string" * mask)
    return out.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)), *out.columns[len(names) :])
