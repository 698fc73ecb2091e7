"""Search for passages that repeat: anchors, the chunks' question which of them repeat, and the passages around those.

A window's anchor is the k-gram with the least hash in it (the leftmost of equal ones), which depends on the window
only: equal windows have equal anchors at equal places. Consecutive windows of one anchor make a passage. A window can
repeat only if its anchor does, so only passages with repeated anchors go on, and those of one anchor meet in one shard.
Within a chunk, equal passages go on once. An anchor of very many passages is hot: one shard could not hold what
surrounds it, so its windows go on by themselves, as 128-bit hashes, each to the shard of its own hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptline.llm.chunked import chunk_of, ordered
from scriptline.llm.text import mix, ramp

_STEP = 0x9E3779B97F4A7C15
_PLACE_BITS = np.uint64(28)


@dataclass(frozen=True)
class Windows:
    """symbols: 64-bit value of every symbol of the chunk. offsets: of the texts. Passages: first window, windows, anchor."""

    offsets: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray

    def texts(self) -> np.ndarray:
        return np.searchsorted(self.offsets, self.first, side="right") - 1


def rolling(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols from each position on, made of hashes of powers of two."""
    out, covered, power, have, step = None, 0, symbols, 1, _STEP
    left = n
    while left:
        if left & 1:
            if out is None:
                out = power
            else:
                size = len(power) - covered
                out = out[:size] * np.uint64(step) + power[covered : covered + size]
            covered += have
        left >>= 1
        if left:
            power = power[:-have] * np.uint64(pow(_STEP, have, 1 << 64)) + power[have:]
            have *= 2
            step = pow(_STEP, have, 1 << 64)
    return out


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def windows(symbols: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> Windows:
    """The passages of all windows that lie within one text."""
    long_ = np.diff(offsets) >= width
    starts, lengths = offsets[:-1][long_], np.diff(offsets)[long_] - width + 1
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return Windows(offsets, empty, empty, empty.astype(np.uint64))
    if len(symbols) >= 1 << int(_PLACE_BITS):
        raise ValueError("a chunk or a text has more than 2**28 symbols")
    hashes = mix(rolling(symbols, gram))
    marked = (hashes & ~np.uint64((1 << int(_PLACE_BITS)) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    least = least_in(marked, width - gram + 1)
    window = np.repeat(starts, lengths) + ramp(lengths)
    place = (least[window] & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    return Windows(offsets, window[at], np.diff(np.append(at, len(window))), hashes[place[at]])


def repeated_anchors(chunks: DataFrame, read: Callable[[pa.Table], Windows], per_text: bool, most: int) -> DataFrame:
    """(chunk, anchor, hot): which anchors of the chunk there are twice (``per_text``: in two texts) in the corpus,
    and which have more than ``most`` passages. One row per chunk and distinct anchor meets by the anchor."""

    def ask(rows: pa.Table) -> pa.Table:
        chunk, rows = chunk_of(rows), ordered(rows)
        found = read(rows)
        anchors, passages = np.unique(found.anchor, return_counts=True)
        often = passages > 1
        if per_text and len(anchors):
            pairs = np.unique(np.stack([found.anchor, found.texts().astype(np.uint64)], axis=1), axis=0)
            often = np.unique(pairs[:, 0], return_counts=True)[1] > 1
        columns = [anchors.view(np.int64), np.full(len(anchors), chunk, np.int32), often, passages]
        return pa.table([pa.array(c) for c in columns], names=["anchor", "chunk", "often", "passages"])

    asked = chunks.groupBy("chunk").applyInArrow(ask, "anchor long, chunk int, often boolean, passages long")
    same = Window.partitionBy("anchor")
    there = F.count(F.lit(1)).over(same) + F.max(F.col("often").cast("int")).over(same)
    counted = asked.select("chunk", "anchor", there.alias("there"), (F.sum("passages").over(same) > most).alias("hot"))
    return counted.where(F.col("there") > 1).select("chunk", "anchor", "hot")


def repeating(found: Windows, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the passages whose anchors repeat and are not hot, those whose anchors repeat and are hot)."""
    anchors, hot = told.column("anchor").to_numpy().view(np.uint64), told.column("hot").to_numpy()
    return np.flatnonzero(np.isin(found.anchor, anchors[~hot])), np.flatnonzero(np.isin(found.anchor, anchors[hot]))


def window_ids(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the ``width`` symbols from each position on."""
    return mix(rolling(symbols, width)), mix(rolling(mix(symbols + np.uint64(_STEP)), width))


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's pair (a, b), a row of each pair)."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return which, order[new]


def shard(anchors: np.ndarray, number: int) -> np.ndarray:
    """Shard of each passage; least hashes of windows are small numbers, so they are mixed again."""
    return (mix(anchors) % np.uint64(number)).astype(np.int64)


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def covering(size: int, starts: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Which of ``size`` symbols lie in a range of ``width`` from one of the starts."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0
