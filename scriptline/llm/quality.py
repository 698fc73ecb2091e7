"""Line-first cleaning: rules for single lines, then for what they leave.

A line fails if it is navigation (separators between short items, or a menu phrase in a short line), boilerplate
(notices that sites repeat), badly punctuated (symbols in place of sentence marks, shouting, or a long line that has
no sentence mark), or equal to an earlier line of at least ``repeat_words`` words. Failing lines go. A document is
rejected if it has too few words, repeats itself, or lost more than ``most_lost`` of its words to the line rules.

Blank lines have no words and always stay. Null and empty texts have no words and are rejected. Texts are taken whole,
whatever their length. Equal rows give equal results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.text import mix, ngram_hashes, slices, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_SYMBOL_TABLE = str.maketrans("", "", SYMBOLS)
_SPACE_TABLE = str.maketrans("", "", " \t\n\x0b\x0c\r")

#: Phrases of menus.
NAVIGATION = re.compile(
    r"\b(?:home|log ?in|sign (?:in|up|out)|menu|site ?map|next|previous|skip to content|back to top|read more|contact us|about us|share this)\b", re.I
)
#: Phrases of notices.
BOILERPLATE = re.compile(
    r"all rights reserved|copyright (?:\(c\)|©|\d)|terms (?:of (?:use|service)|and conditions)|privacy policy|cookie|javascript"
    r"|lorem ipsum|subscribe to|licensed under|permission is hereby granted|without warranty",
    re.I,
)
_SEPARATORS = re.compile(r"\s[|»›•·>/]\s")
_MARKS = re.compile(r"[.!?:;…,\"”'’)\]]")


@dataclass(frozen=True)
class Rules:
    fewest_words: int = 50
    most_repeated: float = 0.5
    most_lost: float = 0.5
    menu_words: int = 12
    separators: int = 2
    most_symbols: float = 0.3
    unmarked_words: int = 40
    shouting_words: int = 4
    repeat_words: int = 4


def failure(line: str, rules: Rules) -> str:
    """Name of the first rule that the line fails, empty if none."""
    n = len(line.split())
    if n == 0:
        return ""
    if len(_SEPARATORS.findall(line)) >= rules.separators or n <= rules.menu_words and n <= 3 * len(NAVIGATION.findall(line)):
        return "navigation"
    if BOILERPLATE.search(line):
        return "boilerplate"
    if len(line) - len(line.translate(_SYMBOL_TABLE)) > rules.most_symbols * n:
        return "punctuation"
    if n >= rules.shouting_words and line.isupper() and 2 * line.count("!") > n:
        return "punctuation"
    if n >= rules.unmarked_words and not _MARKS.search(line):
        return "punctuation"
    return ""


def clean_lines(text: str, rules: Rules) -> tuple[str, int, int, int]:
    """(text of the lines that stay, words of the lines that go, lines that go, repeated lines)."""
    stay, seen, lost, gone, repeated = [], set(), 0, 0, 0
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        again = n > 0 and line in seen
        repeated += again
        seen.add(line)
        if again and n >= rules.repeat_words or failure(line, rules):
            lost += n
            gone += 1
        else:
            stay.append(line)
    return "\n".join(stay), lost, gone, repeated


def repeated_words(column: pa.Array, window: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in windows that their text holds twice or more) of each text."""
    hashes, offsets = word_hashes(column)
    grams, at = ngram_hashes(hashes, offsets, window)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    within = mix(grams ^ mix(text[at].astype(np.uint64) + np.uint64(1))) if len(at) else grams
    order = np.argsort(within)
    ranked = within[order]
    same = np.zeros(len(ranked), bool)
    if len(ranked) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    covered = np.zeros(len(hashes), bool)
    for i in range(window):
        covered[at[order[same]] + i] = True
    until = np.concatenate([[0], np.cumsum(covered)])
    return np.diff(offsets), until[offsets[1:]] - until[offsets[:-1]]


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost, n_lines_lost, base_failed, kept, clean).

    ``clean`` is the text of the lines that stay, null for a null text; it is given for rejected documents, too.
    """
    rules = rules or Rules()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                column = part.column("text")
                n, repeat = repeated_words(column)
                texts = [t or "" for t in column.to_pylist()]
                lines = [clean_lines(t, rules) for t in texts]
                longs = [
                    n,
                    [len(t.translate(_SPACE_TABLE)) for t in texts],
                    [sum(map(t.count, SYMBOLS)) for t in texts],
                    [x[3] for x in lines],
                    repeat,
                    [x[1] for x in lines],
                    [x[2] for x in lines],
                ]
                failed = (n < rules.fewest_words) | (repeat > rules.most_repeated * n)
                lost = np.array([x[1] for x in lines])
                kept = ~failed & (lost <= rules.most_lost * n)
                shown = [x[0] if there else None for x, there in zip(lines, column.is_valid().to_pylist(), strict=True)]
                columns = [part.column("key"), *(pa.array(x, pa.int64()) for x in longs), pa.array(failed), pa.array(kept), pa.array(shown, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost", "n_lines_lost"]
    names = ["key", *longs, "base_failed", "kept", "clean"]
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, {', '.join(f'{c} long' for c in longs)}, base_failed boolean, kept boolean, clean string"
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
