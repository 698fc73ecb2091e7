"""Arrow and NumPy helpers shared by the operators: text slices, words, 64-bit hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; only memory depends on it, never a result.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Hand freed memory back to the system: a Python worker lives on through all stages of a job."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, null as empty: (uint8 data, int64 offsets of the rows and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(large)
    if column.null_count:
        column = column.fill_null("" if large == pa.large_string() else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive row ranges of at most ``most`` bytes of text; a longer text is a range of its own."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        release()
        begin = end


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each of the lengths, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` that begin at ``starts``, one after another."""
    return values[np.repeat(np.asarray(starts, np.int64), lengths) + ramp(lengths)]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without ASCII white space, none across texts: (start, end, text) of each word."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    table = np.full(max(n, 1), base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty byte ranges: every eight bytes are mixed with their place before they are added up."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    length = end - start
    at = ramp(length)
    terms = data[np.repeat(start, length) + at].astype(np.uint64)
    terms <<= (at.astype(np.uint64) & np.uint64(7)) << np.uint64(3)
    first = np.flatnonzero(at & 7 == 0)
    blocks = np.add.reduceat(terms, first)
    places = mix(np.arange(1, (int(length.max()) + 7) // 8 + 1, dtype=np.uint64) * _STEP)
    blocks = mix(blocks ^ places[at[first] >> 3])
    number = (length + 7) // 8
    sums = np.add.reduceat(blocks, np.cumsum(number) - number)
    return mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts in that list)."""
    data, offsets = utf8(column)
    start, end, text = words(data, offsets)
    return span_hashes(data, start, end), np.searchsorted(text, np.arange(len(offsets)))


def ngram_hashes(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of n words within one text, position of its first word)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:count].copy()
    for i in range(1, n):
        out = mix(out * _STEP + hashes[i : i + count])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(text[:count] == text[n - 1 :])
    return out[at], at


class IntTable:
    """Hash table from distinct non-negative 64-bit integers to 32-bit integers, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, todo = self._home(keys), np.arange(len(keys))
        while todo.size:
            at = slot[todo]
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[todo[free]]
            won = self._keys[at] == keys[todo]
            self._values[at[won]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _STEP) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slot = self._home(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._values[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != -1))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & self._mask
            found = self._keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self._values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out
