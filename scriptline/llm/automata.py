"""Exact removal of word passages that an earlier document has, by suffix automata of reference shards.

A window is ``width`` consecutive words of one document; every word of a window whose words also start in a document
with a smaller key goes. Passages whose anchors repeat meet in shards (see ``repeats``). A shard's reference is the
automaton of the passages in order of keys; a document's passage is streamed through it before it becomes part of the
reference itself, and where the matching statistic reaches the width, the window is one of an earlier document. Passages
equal to one of a smaller key need no streaming. A shard's automaton goes to the one task that streams the shard's
passages, instead of to all tasks: a broadcast of all shards to all documents would grow with the square of the corpus.
Windows whose anchor has more than ``HOT`` passages are compared by 128-bit hashes in the shards of those hashes, once
per chunk with the least key there, so that no automaton has to hold all surroundings of a frequent phrase.

Windows are judged on the input. Null, empty and short texts lose nothing. A null key counts as greater than all
others; rows with equal keys do not remove each other's words. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.chunked import CHUNK_BYTES, chunk_of, chunked, ordered, table
from scriptline.llm.repeats import Windows, alike, covering, repeated_anchors, repeating, shard, window_ids, windows
from scriptline.llm.text import gather, mix, powers, ramp, release, word_hashes

WIDTH, GRAM = 50, 4
LAST = (1 << 63) - 1
#: Passages of one anchor that one automaton takes: some 50,000 words.
HOT = 512
#: Symbols hashed together; only memory depends on it.
HASHED_AT_ONCE = 1 << 18

_PASSAGES = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("places", pa.binary()), ("symbols", pa.binary()), ("hot", pa.binary()), ("done", pa.binary())])
_MARKS = pa.schema([("chunk", pa.int32()), ("windows", pa.binary()), ("everywhere", pa.binary())])


class SuffixAutomaton:
    """Automaton of all substrings of the sequences added so far."""

    def __init__(self) -> None:
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self._next.append(after)
        self._link.append(link)
        self._length.append(length)
        return len(self._next) - 1

    def _split(self, at: int, symbol: int) -> int:
        """The state reached from ``at`` that ends the longest string one longer than that of ``at``."""
        to = self._next[at][symbol]
        if self._length[to] == self._length[at] + 1:
            return to
        twin = self._state(self._length[at] + 1, self._link[to], dict(self._next[to]))
        self._link[to] = twin
        while at >= 0 and self._next[at].get(symbol) == to:
            self._next[at][symbol] = twin
            at = self._link[at]
        return twin

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self._next[last]:
                last = self._split(last, symbol)
                continue
            new = self._state(self._length[last] + 1, 0, {})
            while last >= 0 and symbol not in self._next[last]:
                self._next[last][symbol] = new
                last = self._link[last]
            if last >= 0:
                self._link[new] = self._split(last, symbol)
            last = new

    def statistics(self, sequence: list[int]) -> list[int]:
        """Length of the longest substring of the reference that ends at each symbol."""
        state = length = 0
        out = []
        step, link, longest = self._next, self._link, self._length
        for symbol in sequence:
            while state and symbol not in step[state]:
                state = link[state]
                length = longest[state]
            state = step[state].get(symbol, 0)
            length = length + 1 if state else 0
            out.append(length)
        return out


def contents(symbols: np.ndarray, first: np.ndarray, length: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Hash of each range of symbols (of their ``values``, if there is a table of those)."""
    if len(first) == 0:
        return np.zeros(0, np.uint64)
    factors, out, begin = powers(int(length.max())), np.empty(len(first), np.uint64), 0
    until = np.cumsum(length)
    while begin < len(first):  # a block of ranges at a time
        done = until[begin] - length[begin]
        end = max(begin + 1, int(np.searchsorted(until, done + HASHED_AT_ONCE, side="right")))
        size = length[begin:end]
        terms = gather(symbols, first[begin:end], size)
        terms = (terms if values is None else values[terms]) * factors[ramp(size)]
        out[begin:end] = np.add.reduceat(terms, np.cumsum(size) - size)
        begin = end
    return mix(out + length.astype(np.uint64))


def earlier(keys: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the content is there with a smaller key, first of the rows with the same content in order of keys)."""
    order = np.lexsort((keys, content))
    new = np.ones(len(order), bool)
    new[1:] = content[order][1:] != content[order][:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first = np.empty(len(order), np.int64)
    first[order] = head
    return keys > keys[first], first


def order_keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy()


def match(keys: np.ndarray, sequences: list[list[int]], width: int) -> list[np.ndarray]:
    """Windows of each sequence that one with a smaller key has, too; keys ascend."""
    automaton, out, begin = SuffixAutomaton(), [], 0
    borders = [*(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
    for end in borders:
        for sequence in sequences[begin:end]:
            out.append(np.flatnonzero(np.array(automaton.statistics(sequence)[width - 1 :]) >= width))
        for sequence, found in zip(sequences[begin:end], out[begin:end], strict=True):
            if len(found) < len(sequence) - width + 1:
                automaton.add(sequence)
        begin = end
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, n_words, n_removed, kept): ``kept`` is the words that stay, joined by one space."""
    chunks, number = chunked(docs.withColumn(key, F.col(key).cast("long")), key, text, size=CHUNK_BYTES)

    def read(rows: pa.Table) -> Windows:
        return windows(*word_hashes(rows.column("text")), width, gram)

    def passages(rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk, rows = chunk_of(rows), ordered(rows)
        symbols, offsets = word_hashes(rows.column("text"))
        found = windows(symbols, offsets, width, gram)
        chosen, many = repeating(found, told)
        first, count = found.first[chosen], found.count[chosen]
        own_keys = order_keys(rows.column("key"))[found.texts()]
        keys = own_keys[chosen]
        known, _ = earlier(keys, contents(symbols, first, count + width - 1))
        out = [(chunk % number, chunk, b"", b"", b"", np.stack([first[known], count[known]], axis=1).tobytes())]
        first, count, keys, target = first[~known], count[~known], keys[~known], shard(found.anchor[chosen][~known], number)
        for part in np.split(np.argsort(target, kind="stable"), np.flatnonzero(np.diff(np.sort(target))) + 1):
            if len(part):
                places = np.stack([keys[part], first[part], count[part]], axis=1)
                out.append((int(target[part[0]]), chunk, places.tobytes(), gather(symbols, first[part], count[part] + width - 1).tobytes(), b"", b""))
        if len(many):
            at = np.repeat(found.first[many], found.count[many]) + ramp(found.count[many])
            keys = np.repeat(own_keys[many], found.count[many])
            a, b = (x[at] for x in window_ids(symbols, width))
            which, one = alike(a, b)
            least = np.full(len(one), LAST)
            np.minimum.at(least, which, keys)
            here = at[keys > least[which]]
            out.append((chunk % number, chunk, b"", b"", b"", np.stack([here, np.ones_like(here)], axis=1).tobytes()))
            target = shard(a[one], number)
            sent = np.stack([a[one].view(np.int64), b[one].view(np.int64), least, at[one]], axis=1)
            for part in np.split(np.argsort(target, kind="stable"), np.flatnonzero(np.diff(np.sort(target))) + 1):
                out.append((int(target[part[0]]), chunk, b"", b"", sent[part].tobytes(), b""))
        return table(_PASSAGES, out)

    def stream(rows: pa.Table) -> pa.Table:
        release()
        chunk_ids = rows.column("chunk").to_numpy()
        places = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in rows.column("places").to_pylist()]
        symbols = np.frombuffer(b"".join(rows.column("symbols").to_pylist()), np.uint64)
        marks = [(int(c), d) for c, d in zip(chunk_ids, rows.column("done").to_pylist(), strict=True) if d]
        chunk = np.repeat(chunk_ids, [len(p) for p in places])
        keys, first, count = np.concatenate(places).T
        if len(keys):
            length = count + width - 1
            begin = np.cumsum(length) - length
            known, head = earlier(keys, contents(symbols, begin, length))
            heads = np.unique(head)
            heads = heads[np.argsort(keys[heads], kind="stable")]
            dense = np.unique(symbols, return_inverse=True)[1]
            found = dict(zip(heads.tolist(), match(keys[heads], [dense[begin[i] : begin[i] + length[i]].tolist() for i in heads], width), strict=True))
            for i in range(len(keys)):
                if known[i]:
                    marks.append((int(chunk[i]), np.array([first[i], count[i]]).tobytes()))
                elif len(at := found[int(head[i])]):
                    new = np.concatenate([[True], np.diff(at) > 1])
                    starts = at[new]
                    sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
                    marks.append((int(chunk[i]), np.stack([first[i] + starts, sizes], axis=1).tobytes()))
        joined: dict[int, list[bytes]] = {}
        for c, raw in marks:
            joined.setdefault(c, []).append(raw)
        out = [(c, b"".join(raw), b"") for c, raw in joined.items()]
        asked = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in rows.column("hot").to_pylist()]
        a, b, keys, at = np.concatenate(asked).T
        if len(a):
            which, one = alike(a, b)
            least = np.full(len(one), LAST)
            np.minimum.at(least, which, keys)
            more = keys > least[which]
            asker, at = np.repeat(chunk_ids, [len(p) for p in asked])[more], at[more]
            out += [(int(c), b"", at[asker == c].tobytes()) for c in np.unique(asker)]
        return table(_MARKS, out)

    def everywhere(texts: pa.ChunkedArray, told: np.ndarray) -> np.ndarray:
        """All windows of the chunk that are equal to one of those told."""
        symbols, offsets = word_hashes(texts)
        a, b = window_ids(symbols, width)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.flatnonzero(text[: len(a)] == text[width - 1 :])
        which, _ = alike(*(np.concatenate([x[told], x[at]]) for x in (a, b)))
        return at[np.isin(which[len(told) :], which[: len(told)])]

    def remove(rows: pa.Table, marks: pa.Table) -> pa.Table:
        rows = ordered(rows)
        words = [t.encode().split() for t in rows.column("text").to_pylist()]
        offsets = np.cumsum([0, *map(len, words)])
        spans = np.frombuffer(b"".join(marks.column("windows").to_pylist()), np.int64).reshape(-1, 2)
        told = np.frombuffer(b"".join(marks.column("everywhere").to_pylist()), np.int64)
        if len(told):
            at = everywhere(rows.column("text"), told)
            spans = np.concatenate([spans, np.stack([at, np.ones_like(at)], axis=1)])
        covered = covering(int(offsets[-1]), spans[:, 0], spans[:, 1] + width - 1)
        removed = [int(covered[a:b].sum()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        kept = [
            b" ".join(compress(w, (~covered[a : a + len(w)]).tolist()) if r else w).decode()
            for w, a, r in zip(words, offsets[:-1], removed, strict=True)
        ]
        return pa.table([rows.column("key"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["key", "n_words", "n_removed", "kept"])

    told = repeated_anchors(chunks, read, per_text=True, most=hot)
    found = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(passages, "shard int, chunk int, places binary, symbols binary, hot binary, done binary")
    marks = found.groupBy("shard").applyInArrow(stream, "chunk int, windows binary, everywhere binary")
    out = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(remove, "key long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("key", key)
