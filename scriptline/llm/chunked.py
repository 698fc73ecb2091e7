"""Questions to a table partitioned by hash, asked by chunks of documents.

Documents are dealt to chunks of a few MB by a hash of key and text; a chunk's rows are ordered, so that every pass over
a chunk sees the same. A chunk asks about its distinct 64-bit hashes: one row per chunk and hash range, with the sorted
hashes as a packed array. All rows of a range meet in one task, whose answers go back to the chunks. A frequent hash
counts once per chunk, which keeps ranges even; chunks and ranges have a size, not a number, so both grow in number
with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.text import release

CHUNK_BYTES = 3 << 20


def chunked(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), size: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(rows (key, text, chunk, kept_0..) partitioned by chunk, number of chunks). A null text becomes an empty one."""
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *kept)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    number = max(1, math.ceil(total / size))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(number)).cast("int")).repartition("chunk"), number


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a chunk by key and text; equal rows are interchangeable."""
    release()
    return table.sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()


def chunk_of(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def pack(hashes: np.ndarray) -> bytes:
    """Ascending 64-bit integers as differences, by byte of significance (the high bytes compress to nothing)."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(numbers(raw))


def planes(values: np.ndarray) -> bytes:
    """64-bit integers by byte of significance."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def ranges(hashes: np.ndarray, number: int) -> Iterator[tuple[int, slice]]:
    """(range, its part) of ascending hashes."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
    borders = np.flatnonzero(np.diff(bucket)) + 1
    borders = [0, *borders, len(hashes)]
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
