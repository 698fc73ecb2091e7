"""Byte-level BPE without replaying merges.

A document is cut into pre-tokens; each distinct pre-token of a slice is encoded by a backtracking encoder: take the
longest vocabulary token at the position (a walk down the Aho-Corasick goto table), keep it if it is compatible with
the token before it, else try the next shorter token, else step back. Two tokens are compatible if BPE on their joined
bytes gives exactly the two; that check undoes merges on both sides of the border. Every position is given up at most
once, so time is linear, and a sequence of pairwise compatible tokens is the one BPE gives. All pre-tokens of a slice
go through these steps together, as NumPy arrays. Decoding looks up token bytes in an offset table.

Null and empty texts give no tokens. Repeated rows are encoded alike; a special token's string gives its id. Output
rows hold the key column and the results only, so other columns of the input, whatever their names, don't matter.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.text import IntTable, gather, release, slices, span_hashes, utf8

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: Code points with the White_Space property.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: English endings that are tokens of their own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: No letters or numbers are assigned from here on.
LAST_LETTER = 0x33480


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.zeros(0x110000, np.uint8)
    table[:LAST_LETTER] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LAST_LETTER)]
    table[list(WHITE_SPACE)] = WHITE
    return table


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself if it is visible, else the next one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    place = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(place[b]) for b in range(256)]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of concatenated UTF-8 texts.

    Runs of letters, of numbers and of other characters, each with one space before it; English endings after an
    apostrophe; white space up to its last character before a run.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64)
    if data.max() < 128:
        place, codes = np.arange(len(data)), data
    else:
        place = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = character_classes()[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[np.searchsorted(place, offsets[:-1][np.diff(offsets) > 0])] = True
    first[-1] = True
    change = first.copy()
    change[1:-1] |= kind[1:] != kind[:-1]
    start = change[:-1].copy()
    tail = (kind == WHITE) & change[1:] & ~first[1:]
    start |= tail
    start[1:] &= ~(tail & (codes == 32))[:-1]
    for i in np.flatnonzero((codes == 39) & start):
        after = "".join(map(chr, codes[i + 1 : i + 3]))
        for ending in ENDINGS:
            stop = i + 1 + len(ending)
            if after.startswith(ending) and not first[i + 1 : stop].any():
                start[i + 1] = False
                if not first[stop] and kind[stop] == LETTER:
                    start[stop] = True
                break
    return place[start]


def _unlike(data: np.ndarray, start: np.ndarray, length: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The ranges whose bytes are not those of the range ``to``."""
    bad = length != length[to]
    check = np.flatnonzero(~bad & (to != np.arange(len(to))))
    if len(check):
        size = length[check]
        differs = gather(data, start[check], size) != gather(data, start[to[check]], size)
        bad[check] = np.logical_or.reduceat(differs, np.cumsum(size) - size)
    return np.flatnonzero(bad)


class Codec:
    """Encoder and decoder of one vocabulary file (JSON, byte-level BPE, one merge per token)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, characters = spec["model"], byte_characters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        number = {c: b for b, c in enumerate(characters)}
        tokens = [bytes([b]) for b in range(256)]
        left, right = list(range(256)), list(range(256))
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            if a + b in number:
                raise ValueError("two merges make the same token")
            number[a + b] = len(tokens)
            tokens.append(tokens[number[a]] + tokens[number[b]])
            left.append(number[a])
            right.append(number[b])
        size = len(tokens)
        self._left, self._right = np.array(left, np.int64), np.array(right, np.int64)
        keys = self._left[256:] * size + self._right[256:]
        self._size, self._pairs = size, IntTable(keys, np.arange(256, size))
        self._ids = np.zeros(size, np.uint32)
        for token, n in number.items():
            self._ids[n] = model["vocab"][token]
        self._length = np.array([len(t) for t in tokens], np.int64)
        self._goto_table(tokens)
        shown = {int(i): t for i, t in zip(self._ids, tokens, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        pieces = [shown.get(i, b"") for i in range(max(shown) + 1)]
        self._bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._offsets = np.cumsum([0, *map(len, pieces)])

    def _goto_table(self, tokens: list[bytes]) -> None:
        edges: dict[int, int] = {}
        ends = [-1]
        for token, text in enumerate(tokens):
            node = 0
            for byte in text:
                node = edges.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = token
        shorter = []
        for text in tokens:
            node, best = 0, -1
            for byte in text[:-1]:
                node = edges[node << 8 | byte]
                best = ends[node] if ends[node] >= 0 else best
            shorter.append(best)
        self._edges = IntTable(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self._ends, self._shorter = np.array(ends, np.int64), np.array(shorter, np.int64)

    def _longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        best, node, at = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64), at.copy()
        live = np.arange(len(at))
        while live.size:
            to = self._edges.get(node[live] << 8 | data[at[live]]).astype(np.int64)
            live, to = live[to >= 0], to[to >= 0]
            node[live] = to
            token = self._ends[to]
            best[live[token >= 0]] = token[token >= 0]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return best

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between the tokens; numbers are in order of merges."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        limit = np.full(len(a), self._size, np.int64)
        live = np.arange(len(a))
        while live.size:
            x, y = a[live], b[live]
            merged = self._pairs.get(x * self._size + y)
            bad = (merged >= 0) & (merged < limit[live])
            good[live[bad]] = False
            can_x, can_y = self._right[x] != x, self._left[y] != y
            go = ~bad & (can_x | can_y)
            live, x, y, can_x, can_y = live[go], x[go], y[go], can_x[go], can_y[go]
            undo_x = can_x & ((x > y) | ~can_y)
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, self._right[x], x)
            b[live] = np.where(undo_x, y, self._left[y])
        return good

    def _backtrack(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each range, all tokens one after another)."""
        stack, dead = np.zeros(len(data), np.int64), np.zeros(len(data), bool)
        depth, at = np.zeros(len(start), np.int64), start.copy()
        token = self._longest(data, start, end)
        live = np.arange(len(start))
        while live.size:
            p, t, d, s = at[live], token[live], depth[live], start[live]
            before = np.where(d > 0, stack[np.maximum(s + d - 1, 0)], -1)
            to = p + self._length[t]
            fits = ~dead[to - 1]
            check = np.flatnonzero(fits & (before >= 0))
            fits[check] = self.compatible(before[check], t[check])
            kept = live[fits]
            stack[s[fits] + d[fits]] = t[fits]
            depth[kept] += 1
            at[kept] = to[fits]
            more = kept[at[kept] < end[kept]]
            token[more] = self._longest(data, at[more], end[more])
            lost = np.flatnonzero(~fits)
            shorter = self._shorter[t[lost]]
            token[live[lost]] = shorter
            back = lost[shorter < 0]
            dead[p[back] - 1] = True
            token[live[back]] = before[back]
            depth[live[back]] -= 1
            at[live[back]] -= self._length[before[back]]
            live = live[at[live] < end[live]]
        return depth, gather(stack, start, depth)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = pretokens(data, offsets)
        if len(start) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        _, one, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        other = _unlike(data, start, end - start, one[which])  # an equal hash doesn't make equal bytes
        which[other] = len(one) + np.arange(len(other))
        one = np.concatenate([one, other])
        count, tokens = self._backtrack(data, start[one], end[one])
        place = np.cumsum(count) - count
        flat = gather(self._ids[tokens], place[which], count[which])
        until = np.concatenate([[0], np.cumsum(count[which])])
        return flat, until[np.searchsorted(start, offsets)]

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        data, offsets = utf8(column)
        marks = [m.encode() for m in self.special if m]
        raw = data.tobytes()
        if not any(m in raw for m in marks):
            return self._plain(data, offsets)
        parts: list[tuple[bytes, int]] = []
        first = []
        for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
            first.append(len(parts))
            parts += self._split(raw[begin:end])
        first.append(len(parts))
        flat, until = self._plain(np.frombuffer(b"".join(p for p, _ in parts), np.uint8), np.cumsum([0, *(len(p) for p, _ in parts)]))
        out = []
        for i, (_, mark) in enumerate(parts):
            out.append(flat[until[i] : until[i + 1]])
            if mark >= 0:
                out.append(np.array([mark], np.uint32))
        marked = np.concatenate([[0], np.cumsum([mark >= 0 for _, mark in parts])])
        return np.concatenate(out) if out else flat, (until + marked)[first]

    def _split(self, text: bytes) -> list[tuple[bytes, int]]:
        """Parts without special strings, each with the id of the special string behind it, or -1."""
        parts = []
        while True:
            found = [(at, -len(m), self.special[m]) for m in self.special if m and (at := text.find(m.encode())) >= 0]
            if not found:
                return [*parts, (text, -1)]
            at, size, mark = min(found)
            parts.append((text[:at], mark))
            text = text[at - size :]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets of the texts in them)."""
        length = self._offsets[ids.astype(np.int64) + 1] - self._offsets[ids]
        until = np.concatenate([[0], np.cumsum(length)])
        return gather(self._bytes, self._offsets[ids], length), until[offsets]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process and vocabulary."""
    made = Codec(path)
    release()
    return made


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Ranges of an array as little-endian binary values."""
    offsets = np.ascontiguousarray(offsets, np.int64) * values.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2 GiB in one batch")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): ids as little-endian unsigned 32-bit integers in a binary value."""

    def run(batches):
        coder = codec(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = coder.encode(part.column("text"))
                columns = [part.column("key"), pa.array(np.diff(offsets)), binary_column(ids.astype("<u4"), offsets)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids"])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, text) of binary ids; bytes that are no UTF-8 become U+FFFD."""
    names = ["key", *(f"kept_{i}" for i in range(len(keep)))]

    def run(batches):
        coder = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, "ids"):
                raw, offsets = utf8(part.column("ids"))
                data, until = coder.decode(raw.view("<u4") if raw.flags.aligned else np.frombuffer(raw.tobytes(), "<u4"), offsets // 4)
                shown = binary_column(data, until)
                try:
                    shown = shown.cast(pa.string())
                except pa.ArrowInvalid:
                    shown = pa.array([x.as_py().decode(errors="replace") for x in shown], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), shown], [*names, "text"])

    columns = [key, *keep]
    source = encoded.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col(ids).alias("ids"))
    kinds = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    out = source.mapInArrow(run, f"{kinds}, text string")
    return out.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)), "text")
