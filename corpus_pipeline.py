"""From raw documents to packed token sequences: language ID, near duplicates, repeated passages, personal data, packing.

Every stage takes all documents that the stage before it kept, and is written to the shared folder before the next one
reads it. Defined results: null and letterless texts go in the first stage; of rows that are equal, one stays after
the second; characters that lost some of their bytes to the third go as a whole; the fourth puts the kind of an
identifier in its place; the last one gives the place of every piece of every document. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptline.llm import langid, near, packing, pii, suffixes
from scriptline.llm.queries import VOCABULARY
from scriptline.session import written

#: A text with less of its n-grams in the likeliest language is in none of the languages.
LEAST_COVERAGE = 0.2

#: Bytes of a shard of the third stage: half of the operator's own, since executors still hold memory of the stages before.
SHARD_BYTES = 1 << 20

#: Rows that a Python worker is sent at once: some MB of text, since JVM and worker hold a batch more than once.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents have."""
    found = langid.predict(docs.withColumn("body__", F.col("text")), langid.fit(docs), keep=tuple(docs.columns), text="body__")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return near.one_per_class(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages of 200 bytes that also start elsewhere."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = suffixes.remove_repeats(docs, keep=others, size=SHARD_BYTES)

    def decoded(batches):
        for batch in batches:
            text = pa.array([x.as_py().decode(errors="ignore") for x in batch.column("text")], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", text)

    rows = left.select("doc_id", F.col("kept").alias("text"), *others)
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(decoded, kinds).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every identifier replaced by its kind."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    found = pii.detect(docs, key=others[0], keep=others[1:], mask=True)
    return found.withColumn("text", F.col("masked")).withColumn("n_chars", F.length("masked").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, VOCABULARY))[0]


def in_small_batches(stage: Callable) -> Callable:
    """The stage with no more than ``BATCH_ROWS`` rows in a batch; the setting stays, since its rows are read later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = int(spark.conf.get(BATCH_SETTING))
        spark.conf.set(BATCH_SETTING, min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", in_small_batches(in_a_language)),
    ("near_dedup", in_small_batches(one_of_each)),
    ("suffix_array_dedup", in_small_batches(without_repeats)),
    ("personal_data", in_small_batches(without_personal_data)),
    ("best_fit_packing", in_small_batches(packed)),
]

#: SQL can express neither the filters of the first stage nor token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_SETTING, None)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)
    return docs


QUERIES = {"pipeline": run}
