"""Best-fit packing of documents into token sequences of one capacity.

Pattern packing by non-negative least squares: patterns of one to three lengths that fill a sequence exactly, short ones
as often as they go in, are enumerated from the lengths that are there, their repeat counts are fitted to the histogram of lengths (longer lengths weigh more), rounded, and what
is left over is packed by best fit decreasing, also on the histogram. The plan knows lengths and counts only, so it
has at most ``capacity`` bins whatever the size of the corpus; the rows find their place by their rank within their
length. Ranks come from random salts that are written with the pieces, so that a length with most of the rows is
ranked in many groups.

A null text is empty and is one piece of the end id alone. Repeated rows and null keys are documents like any other.
An empty table gives no pieces. Only key and result columns are returned, so further columns of the input don't matter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptline.llm.bpe import codec
from scriptline.llm.text import slices
from scriptline.session import written

#: Rows ranked together; the number of salts follows from it.
RANKED_TOGETHER = 100_000

#: Bytes of text encoded at once: an encoder's arrays take some 50 times as much, beside what a worker kept from stages before.
ENCODED_TOGETHER = 512 << 10


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all full but the first."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document's ids followed by the end id."""

    def run(batches):
        coder = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, most=ENCODED_TOGETHER):
                ids, offsets = coder.encode(part.column("text"))
                row, number, start, length, check, kept = [], [], [], [], [], []
                end = np.array([end_id], "<u4").tobytes()
                for i in range(part.num_rows):
                    own = ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() + end
                    for j, (at, n) in enumerate(cut(len(own) // 4, capacity)):
                        piece = own[4 * at : 4 * (at + n)]
                        row.append(i)
                        number.append(j)
                        start.append(at)
                        length.append(n)
                        check.append(zlib.crc32(piece))
                        if keep_ids:
                            kept.append(piece)
                columns = [part.column("key").take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, check)]
                columns += [pa.array(kept, pa.binary())] if keep_ids else []
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def patterns(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times): ways to fill a sequence exactly with lengths that are there, in rows of up to three lengths.

    All pairs and triples, and one length as often as it goes in with one or two others.
    """
    capacity, there = len(counts) - 1, np.flatnonzero(counts)
    there = there[there > 0]
    known = np.zeros(capacity + 1, bool)
    known[0] = True
    known[there] = True
    short = there[there <= capacity // 2]
    pairs = np.stack([short, capacity - short, np.zeros_like(short)], axis=1)
    first = np.repeat(there, len(there))
    second = np.tile(there, len(there))
    third = capacity - first - second
    kept = (first <= second) & (second <= third)
    triples = np.stack([first[kept], second[kept], third[kept]], axis=1)
    often = (capacity - second) // first
    rest = capacity - second - often * first
    kept = (often > 2) & (first != second) & (rest != first) & (rest != second)
    repeats = np.stack([first[kept], second[kept], rest[kept]], axis=1)
    times = np.concatenate([np.ones((len(pairs) + len(triples), 3), np.int64), np.stack([often[kept], np.ones_like(rest[kept]), np.ones_like(rest[kept])], axis=1)])
    whole = capacity // there
    alone = (whole > 3) & (whole * there == capacity)
    shapes = np.concatenate([pairs, triples, repeats, np.stack([there[alone], 0 * there[alone], 0 * there[alone]], axis=1)])
    times = np.concatenate([times, np.stack([whole[alone], 0 * whole[alone], 0 * whole[alone]], axis=1)])
    kept = known[shapes].all(axis=1)
    return shapes[kept], np.where(shapes[kept] > 0, times[kept], 0)


def fit(counts: np.ndarray, shapes: np.ndarray, times: np.ndarray, rounds: int = 20, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by an active set: (indices of the patterns used, their repeat counts).

    A round lets in up to ``at_once`` of the patterns of steepest descent that share no length, solves for all in the
    set, and takes out those whose count would be negative until none is. It ends after ``rounds``: what the patterns
    leave over is packed in another way, so both bound the time of the fit and no row is lost.
    """
    if not len(shapes):
        return np.zeros(0, np.int64), np.zeros(0)
    size = len(counts) - 1
    weight = np.arange(size + 1) / size
    weight[0] = 0
    goal = counts * weight
    used, columns, gram, x = np.zeros(0, np.int64), np.zeros((size + 1, 0)), np.zeros((0, 0)), np.zeros(0)
    for _ in range(rounds):
        slope = ((weight * (goal - columns @ x))[shapes] * times).sum(axis=1)
        slope[used] = 0
        new: list[int] = []
        taken: set[int] = set()
        for p in np.argsort(-slope, kind="stable")[: 100 * at_once]:
            lengths = set(shapes[p]) - {0}
            if slope[p] <= 1e-6 * (1 + counts.max()) or len(new) == at_once:
                break
            if not lengths & taken:
                taken |= lengths
                new.append(int(p))
        if not new:
            break
        added = np.zeros((size + 1, len(new)))
        for j, p in enumerate(new):
            np.add.at(added[:, j], shapes[p], times[p].astype(float))
        added *= weight[:, None]
        across = columns.T @ added
        gram = np.block([[gram, across], [across.T, added.T @ added]])
        columns, used = np.concatenate([columns, added], axis=1), np.concatenate([used, new])
        while len(used):
            x = np.linalg.solve(gram + 1e-9 * np.eye(len(used)), columns.T @ goal)
            stay = x > 0
            if stay.all():
                break
            used, columns, gram = used[stay], columns[:, stay], gram[np.ix_(stay, stay)]
        if not len(used):
            return used, np.zeros(0)
    return used, x


@dataclass(frozen=True)
class Plan:
    """Runs: the ``count`` rows of a length from rank ``first`` on go to sequences from ``sequence`` on, ``each`` to one, from ``offset``."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.length << 42 | self.first
        i = np.searchsorted(keys, length << 42 | rank, side="right") - 1
        at = rank - self.first[i]
        return self.sequence[i] + at // self.each[i], self.offset[i] + at % self.each[i] * length


def plan(counts: np.ndarray) -> Plan:
    """Place for every row of a histogram (``counts[n]`` rows of length n, up to the capacity).

    That of fitted patterns with best fit for what they leave, or of best fit alone where that makes fewer sequences.
    """
    return min((fitted_plan(counts, by_patterns) for by_patterns in (True, False)), key=lambda p: p.sequences)


def fitted_plan(counts: np.ndarray, by_patterns: bool) -> Plan:
    counts = np.asarray(counts, np.int64)
    capacity = len(counts) - 1
    left, used = counts.copy(), np.zeros(len(counts), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(lengths: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences, each of so many pieces of each length."""
        nonlocal made
        offset = 0
        for n, each in lengths:
            runs.append((n, int(used[n]), each, made, offset))
            used[n] += each * times
            left[n] -= each * times
            offset += n * each
        made += times

    if left[capacity]:
        put([(capacity, 1)], int(left[capacity]))
    if by_patterns and left.any() and capacity > 1:
        shapes, often = patterns(left)
        chosen, repeats = fit(left, shapes, often)
        for p in np.argsort(-repeats, kind="stable"):
            content: dict[int, int] = {}
            for n, c in zip(shapes[chosen[p]].tolist(), often[chosen[p]].tolist(), strict=True):
                if n:
                    content[n] = content.get(n, 0) + c
            shape = sorted(content.items())
            times = min([int(round(repeats[p])), *(int(left[n]) // c for n, c in shape)])
            if times > 0:
                put(shape, times)
    for shape, times in best_fit(left):
        put(shape, times)
    order = sorted(runs)
    columns = np.array(order, np.int64).reshape(-1, 5).T
    return Plan(*columns, made)


def best_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing on a histogram: sequences by content ((length, pieces) pairs) and how many there are of each."""
    capacity = len(counts) - 1
    room: dict[int, list[list]] = {}
    free = np.zeros(capacity + 1, np.int64)

    def store(space: int, content: list, times: int) -> None:
        room.setdefault(space, []).append([content, times])
        free[space] += times

    for n in range(capacity, 0, -1):
        rest = int(counts[n])
        while rest:
            fitting = np.flatnonzero(free[n:])
            space = int(fitting[0]) + n if len(fitting) else capacity
            content, there = room[space][-1] if len(fitting) else ([], rest)
            each = min(space // n, rest)
            times = min(there, rest // each)
            if len(fitting):
                free[space] -= times
                if times == there:
                    room[space].pop()
                else:
                    room[space][-1][1] -= times
            store(space - each * n, [*content, (n, each)], times)
            rest -= each * times
    return [(content, times) for group in room.values() for content, times in group]


def pack(pieces: DataFrame, capacity: int = 1024) -> tuple[DataFrame, Plan]:
    """The pieces with ``sequence_id`` and ``offset``, and the plan. The pieces are written to the shared folder first."""
    table = written(pieces.withColumn("salt__", F.rand(7)), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in table.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    made = plan(counts)
    salts = max(1, int(counts.max()) // RANKED_TOGETHER + 1)
    table = table.withColumn("group__", F.floor(F.col("salt__") * salts).cast("int"))
    groups = table.groupBy("length", "group__").count()
    before = Window.partitionBy("length").orderBy("group__").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "group__", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before__"))
    ranked = table.withColumn("rank__", F.row_number().over(Window.partitionBy("length", "group__").orderBy("salt__")) - 1)
    ranked = ranked.join(groups, ["length", "group__"]).withColumn("rank__", F.col("rank__") + F.col("before__"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank__"))
            sequence, offset = made.place(length, rank) if len(length) else (length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = pieces.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "rank__").mapInArrow(run, f"{kinds}, sequence_id long, offset long"), made


