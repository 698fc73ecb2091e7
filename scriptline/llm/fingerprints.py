"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes decides where a text is cut: a strict mask until the normal chunk size, a loose one
beyond it (normalised chunking), never before the smallest size and always at the largest. An insertion or a shift
therefore changes the chunks next to it only. A fingerprint is the set of the chunks' digests, each with the chunk's
length as weight, written as ten hexadecimal digits per chunk in ascending order. The likeness of one fingerprint to
another is the weighted share of its chunks that the other contains.

Null texts count as empty; an empty text has the empty fingerprint, which is like another empty one (1) and unlike all
others (0). Texts are taken whole. Equal texts have equal fingerprints, so repeated rows have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.text import slices, span_hashes, utf8

WINDOW = 16
SMALLEST, NORMAL, LARGEST = 16, 40, 128
STRICT_BITS, LOOSE_BITS = 6, 4

_GEAR = np.random.Generator(np.random.PCG64(977)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes up to each byte: the sum of their gear values, shifted left by two bits per byte of age."""
    hashes = _GEAR[data]
    reach = 1
    while reach < WINDOW:
        older = hashes[:-reach] << np.uint32(2 * reach) if len(hashes) > reach else hashes[:0]
        hashes = hashes.copy()
        hashes[reach:] += older
        reach *= 2
    return hashes


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the chunks of concatenated texts. All texts advance by a chunk at a time."""
    hashes = gear(data)
    strict = np.flatnonzero(hashes >> np.uint32(32 - STRICT_BITS) == 0)
    loose = np.flatnonzero(hashes >> np.uint32(32 - LOOSE_BITS) == 0)
    strict, loose = np.append(strict, 1 << 60), np.append(loose, 1 << 60)
    at, stop = offsets[:-1].copy(), offsets[1:]
    live = np.flatnonzero(at < stop)
    starts, ends, texts = [], [], []
    while live.size:
        begin = at[live]
        early = strict[np.searchsorted(strict, begin + SMALLEST - 1)] + 1
        late = loose[np.searchsorted(loose, begin + NORMAL - 1)] + 1
        cut = np.where(early < begin + NORMAL, early, np.minimum(late, begin + LARGEST))
        end = np.minimum(cut, stop[live])
        starts.append(begin)
        ends.append(end)
        texts.append(live)
        at[live] = end
        live = live[end < stop[live]]
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(texts)


def chunk_sets(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(items of all texts, offsets of the texts): distinct, ascending, digest * 256 + chunk length."""
    data, offsets = utf8(column)
    start, end, text = chunks(data, offsets)
    items = (span_hashes(data, start, end) >> np.uint64(32) << np.uint64(8)) | (end - start).astype(np.uint64)
    order = np.lexsort((items, text))
    items, text = items[order], text[order]
    first = np.ones(len(items), bool)
    if len(items):
        first[1:] = (items[1:] != items[:-1]) | (text[1:] != text[:-1])
    items, text = items[first], text[first]
    return items, np.searchsorted(text, np.arange(len(offsets)))


def written_out(items: np.ndarray) -> str:
    """The fingerprint as a string."""
    return items.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def read_back(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.concatenate([np.zeros((len(raw), 3), np.uint8), raw], axis=1).view(">u8").ravel().astype(np.uint64)


def likeness(own: np.ndarray, other: np.ndarray) -> float:
    """Weighted share of the own items that the other has, too."""
    if len(own) == 0:
        return float(len(other) == 0)
    lengths = own & np.uint64(255)
    return float(lengths[np.isin(own, other, assume_unique=True, kind="sort")].sum() / lengths.sum())


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) of every text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                items, offsets = chunk_sets(part.column("text"))
                shown = [written_out(items[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                chars = [len(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(chars, pa.int64()), pa.array(shown, pa.string())], ["key", "n_chars", "fingerprint"])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (range, tail, key, text), sorted within partitions by descending key, one range of keys per partition.

    The last row of a range, its ``tail``, is the first row of the range after it (of the first range after the last),
    so that each row's successor is in its own partition. Null keys come last; equal keys are ordered by text.
    Ranges are cut at approximate quantiles; only these and the greatest key of each range reach the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.coalesce("key", lowest)).withColumn("place", F.col("order").cast("double"))
    quantiles = rows.agg(F.percentile_approx("place", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"] or []
    splits = [-float("inf"), *sorted({float(q) for q in quantiles} or {0.0}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="place", outputCol="range_").transform(rows).withColumn("range", F.col("range_").cast("int"))
    tops = sorted((r["top"], r["range"]) for r in rows.groupBy("range").agg(F.max("order").alias("top")).collect())
    tails = [(tops[i - 1][0], tops[i][1]) for i in range(len(tops))]  # the range above needs its neighbour's greatest key
    carried = spark.createDataFrame(tails, "order long, to int")
    ends = rows.join(F.broadcast(carried), "order").select(F.col("to").alias("range"), F.lit(True).alias("tail"), "key", "order", "text")
    both = rows.select("range", F.lit(False).alias("tail"), "key", "order", "text").unionByName(ends)
    dealt = both.repartitionById(max(1, len(splits) - 1), F.col("range"))
    return dealt.sortWithinPartitions("range", "tail", F.desc("order"), F.desc("text")).select("range", "tail", "key", "text")


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many, or all, of the text after it."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); next by descending key."""

    def results(table: pa.Table) -> pa.RecordBatch:
        """For all rows but the last, which is only looked at."""
        texts = table.column("text").to_pylist()
        rows = len(texts) - 1
        changed = pa.array([edited(a, b) for a, b in zip(texts, texts[1:], strict=False)], pa.string())
        own, at = chunk_sets(table.column("text"))
        other, place = chunk_sets(changed)
        sets = [own[at[i] : at[i + 1]] for i in range(rows + 1)]
        others = [other[place[i] : place[i + 1]] for i in range(rows)]
        columns = [
            table.column("key").combine_chunks().slice(0, rows),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed.to_pylist()], pa.string()),
            pa.array([written_out(s) for s in sets[:-1]], pa.string()),
            pa.array([written_out(s) for s in others], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(sets, others, strict=False)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(sets, sets[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        held = None
        for batch in batches:
            for part in slices(batch):
                now = pa.Table.from_batches([part])
                # a new range starts after a tail row; the row held back belongs to the same range or is a tail
                if held is not None:
                    now = pa.concat_tables([held, now])
                tail = now.column("tail").to_numpy()
                ids = now.column("range").to_numpy()
                borders = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
                for a, b in zip(borders[:-1], borders[1:], strict=True):
                    cut = np.flatnonzero(tail[a:b])
                    stop = a + int(cut[0]) + 1 if len(cut) else b
                    if stop - a > 1:
                        yield results(now.slice(a, stop - a))
                held = now.slice(now.num_rows - 1, 1)

    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
