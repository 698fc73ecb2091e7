"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Counts of n-grams (words, up to ``order``) are kept in tables partitioned by hash. Every chunk of documents sends its
distinct n-grams with their counts, the tables sum them, and the sums go back to be joined to the chunk's n-gram
occurrences and summed per document. The score of a word is count(n-gram) / count(context) for the longest n-gram that
the corpus has at least ``least`` times, times ``backoff`` for every order given up; at the end count(word) / words.
The counts cover all documents, the scored one included.

A document without words (null, empty, blank) has score 0 and a null mean. Repeated rows count as often as they are
there and get the same score. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.chunked import chunk_of, chunked, numbers, ordered, pack, planes, ranges, table, unpack
from scriptline.llm.text import ngram_hashes, word_hashes
from scriptline.session import written

#: Chunks whose n-grams make one range of the count tables.
CHUNKS_PER_RANGE = 4

_ASKED = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("chunk", pa.int32()), ("n", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary())])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2, backoff: float = 0.4, least: int = 2) -> DataFrame:
    """(key, n_words, log_score, mean_log_score): the sum of the words' natural log scores, and its mean."""
    chunks, number = chunked(docs, key, text)
    tables = max(1, math.ceil(number / CHUNKS_PER_RANGE))

    def ask(rows: pa.Table) -> pa.Table:
        chunk = chunk_of(rows)
        hashes, offsets = word_hashes(ordered(rows).column("text"))
        out = []
        for n in range(1, order + 1):
            found, counts = np.unique(ngram_hashes(hashes, offsets, n)[0], return_counts=True)
            for bucket, part in ranges(found, tables):
                out.append((bucket, n, chunk, pack(found[part]), planes(counts[part])))
        return table(_ASKED, out)

    def total(rows: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in rows.column("hashes")]
        counts = np.concatenate([numbers(x.as_py()) for x in rows.column("counts")])
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(which, weights=counts).astype(np.uint64)[which]  # exact up to 2**53
        borders = np.cumsum([0, *map(len, parts)])
        told = [planes(sums[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
        return pa.table([rows.column("chunk"), rows.column("n"), rows.column("bucket"), pa.array(told, pa.binary())], schema=_TOLD)

    def sum_up(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = ordered(rows)
        hashes, offsets = word_hashes(rows.column("text"))
        answers = {(n, b): numbers(c) for n, b, c in zip(*(told.column(c).to_pylist() for c in ("n", "bucket", "counts")), strict=True)}
        value = np.zeros(len(hashes))
        ended = np.ones(len(hashes), np.int64)  # order that the word's score ended at
        shorter = np.zeros(0)  # counts of the n-grams one shorter, by first word
        for n in range(1, order + 1):
            grams, at = ngram_hashes(hashes, offsets, n)
            found, which = np.unique(grams, return_inverse=True)
            sums = [answers[n, bucket] for bucket, _ in ranges(found, tables)]
            counts = np.zeros(len(hashes))
            counts[at] = np.concatenate(sums)[which] if sums else []
            word = at + n - 1
            if n == 1:
                value = np.log(np.maximum(counts, 1))
            else:
                seen = counts[at] >= least
                context = np.log(np.maximum(shorter[at], 1))
                value[word] = np.where(seen, np.log(np.maximum(counts[at], 1)) - context, value[word] + math.log(backoff))
                ended[word[seen]] = n
            shorter = counts
        plain = np.concatenate([[0], np.cumsum(ended == 1)])
        sums = np.array([value[a:b].sum() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        columns = [pa.array(np.diff(offsets)), pa.array(sums), pa.array(plain[offsets[1:]] - plain[offsets[:-1]])]
        return pa.table([rows.column("key"), *columns], names=["key", "n_words", "value", "plain"])

    kind = chunks.schema["key"].dataType.simpleString()
    asked = chunks.groupBy("chunk").applyInArrow(ask, "bucket int, n int, chunk int, hashes binary, counts binary")
    told = asked.groupBy("n", "bucket").applyInArrow(total, "chunk int, n int, bucket int, counts binary")
    sums = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(sum_up, f"key {kind}, n_words long, value double, plain long")
    sums = written(sums, "scores")
    words = sums.agg(F.sum("n_words")).first()[0] or 0
    out = sums.withColumn("log_score", F.col("value") - F.col("plain") * math.log(max(words, 1)))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select(F.col("key").alias(key), "n_words", "log_score", mean.alias("mean_log_score"))
