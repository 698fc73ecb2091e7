"""Exact removal of repeated byte strings by induced suffix sorting of shards.

Every byte covered by a string of ``width`` bytes that also starts anywhere else, in the same text or another, goes.
Passages whose anchors repeat meet in shards (see ``repeats``); the suffixes of a shard's distinct passages are sorted:
S*-suffixes by the names of their substrings, doubled until the names reach over ``width`` bytes, then the L-suffixes
from them and the S-suffixes from the L-suffixes, each induced through one queue per first byte. The queues move to
a temporary file when they outgrow memory. Neighbours in the sorted order that agree in ``width`` bytes are repeats.
Passages that are there more than once as a whole are repeats at once and are sorted only once. Windows whose anchor has
more than ``HOT`` passages are compared by 128-bit hashes in the shards of those hashes, instead of by sorting.

Strings are judged on the input and never span texts. Null, empty and short texts lose nothing; repeated rows remove
each other like any other texts. Keys may be of any type and null.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.automata import HASHED_AT_ONCE, contents
from scriptline.llm.chunked import chunk_of, chunked, ordered, table
from scriptline.llm.repeats import Windows, alike, covering, repeated_anchors, repeating, rolling, runs, shard, window_ids, windows
from scriptline.llm.text import gather, mix, ramp, release, utf8

WIDTH, GRAM = 200, 32
#: Text of a chunk, and about what a shard gets; a sort needs some thirty bytes for each.
SHARD_BYTES = 2 << 20
#: Suffixes that the queues of one sort keep in memory.
IN_MEMORY = 8 << 20
#: Passages of one anchor that are sorted together: less text than a shard gets.
HOT = 4096

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SENTINEL_FIRST = np.append(np.uint64(0), _VALUES)
_PASSAGES = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("places", pa.binary()), ("symbols", pa.binary()), ("hot", pa.binary()), ("done", pa.binary())])
_MARKS = pa.schema([("chunk", pa.int32()), ("windows", pa.binary())])


class Queues:
    """One first-in-first-out queue of suffixes per first byte; blocks go to one temporary file beyond a limit."""

    def __init__(self, number: int, in_memory: int = IN_MEMORY):
        self._blocks: list[list] = [[] for _ in range(number)]
        self._held, self._most = 0, in_memory
        self._file = None

    def put(self, suffixes: np.ndarray, first: np.ndarray) -> None:
        """Append suffixes, in this order, to the queues of their first bytes."""
        if not len(suffixes):
            return
        order = np.argsort(first, kind="stable")
        suffixes, first = suffixes[order], first[order]
        borders = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            self._blocks[int(first[a])].append(suffixes[a:b])
        self._held += len(suffixes)
        if self._held > self._most:
            self._spill()

    def _spill(self) -> None:
        self._file = self._file or tempfile.TemporaryFile()
        for blocks in self._blocks:
            held = [i for i, b in enumerate(blocks) if isinstance(b, np.ndarray)]
            for i in held:
                at = self._file.seek(0, 2)
                self._file.write(np.ascontiguousarray(blocks[i]).tobytes())
                blocks[i] = (at, len(blocks[i]))
        self._held = 0

    def blocks(self, queue: int):
        """The blocks of a queue, those put while this runs included."""
        i = 0
        while i < len(self._blocks[queue]):
            block = self._blocks[queue][i]
            if not isinstance(block, np.ndarray):
                self._file.seek(block[0])
                block = np.frombuffer(self._file.read(4 * block[1]), np.int32)
            yield block
            i += 1

    def all(self, queue: int) -> np.ndarray:
        found = list(self.blocks(queue))
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def close(self) -> None:
        if self._file:
            self._file.close()


def refine(group: np.ndarray, active: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Split the groups of the active elements by their words, in place; returns the elements still tied.

    A group's number is the place of its first element in sorted order.
    """
    order = np.lexsort((words, group[active]))
    element, own, word = active[order], group[active][order], words[order]
    start = np.ones(len(own), bool)
    start[1:] = own[1:] != own[:-1]
    new = start.copy()
    new[1:] |= word[1:] != word[:-1]
    place = np.arange(len(own))
    head = np.maximum.accumulate(np.where(start, place, 0))
    part = np.maximum.accumulate(np.where(new, place, 0))
    group[element] = own + (part - head)
    last = np.append(new[1:], True)
    return element[~(new & last)]


def sort_s_stars(symbols: np.ndarray, kinds: np.ndarray, stars: np.ndarray, width: int) -> np.ndarray:
    """The S*-suffixes in order of at least their first ``width`` bytes; sentinels (symbol 0) first."""
    padded = np.concatenate([symbols * np.uint16(2) + kinds, np.zeros(8, np.uint16)])
    length = np.diff(np.append(stars, stars[-1])) + 1
    length[symbols[stars] == 0] = 1
    group, active, done = np.zeros(len(stars), np.int32), np.arange(len(stars), dtype=np.int32), 0
    while active.size:
        words = np.zeros(len(active), np.uint64)
        for i in range(done, done + 6):
            at = np.minimum(stars[active] + i, len(symbols))
            words = words << np.uint64(10) | np.where(i < length[active], padded[at], np.uint16(0)).astype(np.uint64)
        done += 6
        active = refine(group, active, words)
        active = active[length[active] > done]
    del padded, length
    index = np.arange(len(stars), dtype=np.int32)
    closing = np.where(symbols[stars] == 0, index, np.int32(len(stars)))
    closing = np.minimum.accumulate(closing[::-1])[::-1]  # the sentinel that ends each one's passage
    size = np.bincount(group, minlength=len(stars))
    active, step = index[size[group] > 1], 1
    while active.size and step < width:
        ranks = group[np.minimum(active + step, closing[active])]
        active = refine(group, active, ranks.astype(np.uint64))
        step *= 2
    return stars[np.argsort(group, kind="stable")]


def induced_order(symbols: np.ndarray, width: int, in_memory: int = IN_MEMORY):
    """Suffixes of a text of symbols 1..256 with a sentinel 0 behind every passage, sorted by their first ``width`` bytes.

    Yields one array per first symbol. Suffixes shorter than that come in some order of the sentinels.
    """
    starts = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
    of_run = symbols[starts]
    # S: less than the suffix after it. Equal symbols in a row are of one kind.
    kinds = np.repeat(np.append(of_run[1:] > of_run[:-1], True), np.diff(np.append(starts, len(symbols))))
    del starts, of_run
    star = kinds.copy()
    star[0] = False
    star[1:] &= ~kinds[:-1]
    stars = sort_s_stars(symbols, kinds, np.flatnonzero(star).astype(np.int32), width)
    del star
    larger, smaller, seeds = Queues(257, in_memory), Queues(257, in_memory), Queues(257, in_memory)
    seeds.put(stars, symbols[stars])

    def before(suffixes: np.ndarray, l_type: bool) -> np.ndarray:
        found = suffixes[suffixes > 0] - 1
        return found[(kinds[found] != l_type) & (symbols[found] > 0)]

    try:
        for c in range(257):
            for queue in (larger, seeds):
                for block in queue.blocks(c):
                    found = before(block, True)
                    larger.put(found, symbols[found])
        for c in range(256, 0, -1):
            for block in smaller.blocks(c):
                found = before(block, False)
                smaller.put(found, symbols[found])
            l_part = larger.all(c)
            found = before(l_part[::-1], False)
            smaller.put(found, symbols[found])
            yield np.concatenate([l_part, smaller.all(c)[::-1]])
    finally:
        for queue in (larger, smaller, seeds):
            queue.close()


def repeated_windows(data: np.ndarray, lengths: np.ndarray, width: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """For each byte of the concatenated passages: whether the ``width`` bytes from it on start twice."""
    place = np.arange(len(data), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    symbols = np.zeros(len(data) + len(lengths), np.uint16)
    symbols[place] = data.astype(np.uint16) + 1
    ends = (np.cumsum(lengths + 1) - 1).astype(np.int32)
    room = np.zeros(len(symbols), np.int32)
    room[place] = np.repeat(ends, lengths) - place
    hashes = np.zeros(len(symbols), np.uint64)
    for begin in range(0, len(symbols) - width + 1, HASHED_AT_ONCE):
        values = _SENTINEL_FIRST[symbols[begin : begin + HASHED_AT_ONCE + width - 1]]
        hashes[begin : begin + len(values) - width + 1] = mix(rolling(values, width))
    repeat = np.zeros(len(symbols), bool)
    for suffixes in induced_order(symbols, width, in_memory):
        suffixes = suffixes[room[suffixes] >= width]
        same = hashes[suffixes[1:]] == hashes[suffixes[:-1]]
        repeat[suffixes[1:][same]] = True
        repeat[suffixes[:-1][same]] = True
    return repeat[place]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, keep: tuple[str, ...] = (), hot: int = HOT, size: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, columns to keep): ``kept`` holds the bytes that stay; a character may have lost some of its own.

    ``size`` is the text of a chunk and a shard (``SHARD_BYTES`` if None): smaller ones take less memory and more seconds.
    """
    chunks, number = chunked(docs, key, text, keep, size=size or SHARD_BYTES)
    names = [f"kept_{i}" for i in range(len(keep))]

    def read(rows: pa.Table) -> Windows:
        data, offsets = utf8(rows.column("text"))
        return windows(_VALUES[data], offsets, width, gram)

    def passages(rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk, rows = chunk_of(rows), ordered(rows)
        data, _ = utf8(rows.column("text"))
        found = read(rows)
        chosen, many = repeating(found, told)
        first, count = found.first[chosen], found.count[chosen]
        content = contents(data, first, count + width - 1, _VALUES)
        _, one, which, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        twice = times[which] > 1
        out = [(chunk % number, chunk, b"", b"", b"", np.stack([first[twice], count[twice]], axis=1).tobytes())]
        sent = np.sort(one)
        first, count, twice, target = first[sent], count[sent], twice[sent], shard(found.anchor[chosen][sent], number)
        for part in np.split(np.argsort(target, kind="stable"), np.flatnonzero(np.diff(np.sort(target))) + 1):
            if len(part):
                places = np.stack([twice[part].astype(np.int64), first[part], count[part]], axis=1)
                out.append((int(target[part[0]]), chunk, places.tobytes(), gather(data, first[part], count[part] + width - 1).tobytes(), b"", b""))
        if len(many):
            at = np.repeat(found.first[many], found.count[many]) + ramp(found.count[many])
            a, b = (x[at] for x in window_ids(_VALUES[data], width))
            which, one = alike(a, b)
            twice = np.bincount(which) > 1
            here = at[twice[which]]
            out.append((chunk % number, chunk, b"", b"", b"", np.stack([here, np.ones_like(here)], axis=1).tobytes()))
            target = shard(a[one], number)
            sent = np.stack([a[one], b[one], (at[one] * 2 + twice).astype(np.uint64)], axis=1)
            for part in np.split(np.argsort(target, kind="stable"), np.flatnonzero(np.diff(np.sort(target))) + 1):
                out.append((int(target[part[0]]), chunk, b"", b"", sent[part].tobytes(), b""))
        return table(_PASSAGES, out)

    def sort(rows: pa.Table) -> pa.Table:
        release()
        chunk_ids = rows.column("chunk").to_numpy()
        places = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in rows.column("places").to_pylist()]
        data = np.frombuffer(b"".join(rows.column("symbols").to_pylist()), np.uint8)
        joined: dict[int, list[bytes]] = {}
        for c, d in zip(chunk_ids, rows.column("done").to_pylist(), strict=True):
            if d:
                joined.setdefault(int(c), []).append(d)
        asked = [np.frombuffer(x, np.uint64).reshape(-1, 3) for x in rows.column("hot").to_pylist()]
        asker = np.repeat(chunk_ids, [len(p) for p in asked])
        a, b, at = np.concatenate(asked).T
        if len(a):
            which, _ = alike(a, b)
            more = (np.bincount(which) > 1)[which] & (at & np.uint64(1) == 0)  # those there twice in their chunk are marked
            asker, at = asker[more], (at[more] >> np.uint64(1)).astype(np.int64)
            for c in np.unique(asker):
                own = at[asker == c]
                joined.setdefault(int(c), []).append(np.stack([own, np.ones_like(own)], axis=1).tobytes())
        chunk = np.repeat(chunk_ids, [len(p) for p in places])
        twice, first, count = np.concatenate(places).T
        if len(first):
            length = count + width - 1
            begin = np.cumsum(length) - length
            content = contents(data, begin, length, _VALUES)
            _, one, which, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
            everywhere = (times > 1)[which]
            repeat = repeated_windows(gather(data, begin[one], length[one]), length[one], width)
            place = np.cumsum(length[one]) - length[one]
            for i in range(len(first)):
                if twice[i]:
                    continue
                if everywhere[i]:
                    spans = np.array([first[i], count[i]])
                else:
                    at = place[which[i]]
                    start, end = runs(repeat[at : at + count[i]])
                    spans = np.stack([first[i] + start, end - start], axis=1)
                if spans.size:
                    joined.setdefault(int(chunk[i]), []).append(spans.astype(np.int64).tobytes())
        return table(_MARKS, [(c, b"".join(raw)) for c, raw in joined.items()])

    def remove(rows: pa.Table, marks: pa.Table) -> pa.Table:
        rows = ordered(rows)
        data, offsets = utf8(rows.column("text"))
        spans = np.frombuffer(b"".join(marks.column("windows").to_pylist()), np.int64).reshape(-1, 2)
        covered = covering(len(data), spans[:, 0], spans[:, 1] + width - 1)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = covered[a:b]
            gone = int(own.sum())
            out.append((gone, len(runs(own)[0]) if gone else 0, data[a:b][~own].tobytes() if gone else data[a:b].tobytes()))
        gone, spans_, kept = zip(*out, strict=True)
        columns = [pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(spans_, pa.int64()), pa.array(kept, pa.binary())]
        return pa.table([rows.column("key"), *columns, *(rows.column(n) for n in names)], names=["key", "n_bytes", "n_removed", "n_spans", "kept", *names])

    kind = chunks.schema["key"].dataType.simpleString()
    told = repeated_anchors(chunks, read, per_text=False, most=hot)
    found = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(passages, "shard int, chunk int, places binary, symbols binary, hot binary, done binary")
    marks = found.groupBy("shard").applyInArrow(sort, "chunk int, windows binary")
    kinds = "".join(f", {n} {chunks.schema[n].dataType.simpleString()}" for n in names)
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary{kinds}"
    out = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(remove, schema)
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    return out.select(F.col("key").alias(key), *made, *(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)))
