"""The corpus pipeline, stage by stage, against what each stage must leave."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptline.llm import near, pii
from scriptline.session import written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF_DIR), name))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(steps):
    assert all(set(s.columns) == set(steps[0].columns) for s in steps[:-1])
    assert [s.schema[c].dataType for s in steps[1:5] for c in steps[0].columns] == [steps[0].schema[c].dataType for c in steps[0].columns] * 4


def test_languages_keep_clean_documents(steps):
    assert set(by_id(steps[1])) == {i for i, r in by_id(steps[0]).items() if any(c.isalpha() for c in r.text)}


def test_one_document_of_each_group(steps):
    classes = near.classes(steps[1]).collect()
    assert set(by_id(steps[2])) == {r.class_id for r in classes}


def test_repeated_bytes_go(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    assert set(before) == set(after)
    raw = {i: r.text.encode() for i, r in before.items()}
    counts = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = {k + j for k in range(len(b) - 199) if counts[b[k : k + 200]] > 1 for j in range(200)}
        assert after[i].text == bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="ignore")
        assert after[i].n_chars == len(after[i].text) and after[i].source == before[i].source


def test_identifiers_are_masked(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    for i, r in before.items():
        plain, added = pii.find(r.text)
        spans = sorted(plain + added, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))
        assert after[i].text == pii.masked(r.text, spans) and after[i].lang == r.lang


def test_pieces_cover_all_documents(steps):
    packed = steps[5]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(by_id(steps[4]))
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end or n > 1024").count() == 0


def test_run_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, "12 34", "en", "s", 5), (4, "Plain words here.", "en", None, 17), (4, "Plain words here.", "en", None, 17)]
    rows += [(None, "Other words there.", "en", "s", 18), (5, "y" * 30_000, "en", "s", 30_000)]
    for name, given in (("odd", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted({r.doc_id for r in found}, key=repr) == ([4, 5, None] if given else [])


def test_third_stage_has_shards_of_a_megabyte(monkeypatch):
    """Executors hold memory of the stages before it; the operator's own shards are twice as large."""
    from types import SimpleNamespace

    import corpus_pipeline
    from scriptline.llm import suffixes

    class Seen(Exception):
        pass

    def remove_repeats(docs, keep, size=None):
        raise Seen(size)

    monkeypatch.setattr(suffixes, "remove_repeats", remove_repeats)
    with pytest.raises(Seen) as seen:
        corpus_pipeline.without_repeats(None, SimpleNamespace(columns=["doc_id", "text", "n_chars", "lang"]), "")
    assert seen.value.args == (1 << 20,) and 2 * seen.value.args[0] == suffixes.SHARD_BYTES


def test_stages_send_small_batches(spark, monkeypatch, tmp_path):
    """An executor holds a batch several times, in the JVM and in the worker, and all stages share its memory."""
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)

    def sizes(session, docs, sf_dir):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

        return docs.mapInArrow(run, "n long")

    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    spark.range(2500).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", corpus_pipeline.in_small_batches(sizes))])
    assert sorted(r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [500, 1000, 1000]
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == before


def test_packing_encodes_little_at_once(spark, monkeypatch):
    """Arrays of an encoder are many times its text; how much it takes at once changes no piece."""
    import numpy as np
    import pyarrow as pa

    from scriptline.llm import bpe, packing
    from scriptline.llm.queries import VOCABULARY

    class Docs:
        schema = spark.createDataFrame([], "key long, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def withColumnRenamed(self, *names):
            return self

    class Coder:
        seen: list = []

        def encode(self, column):
            self.seen.append(sum(len(x) for x in column.to_pylist()))
            return bpe.codec(VOCABULARY).encode(column)

    monkeypatch.setattr(packing, "codec", lambda path: Coder())
    texts = [f"text {i} " * 10_000 for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts)], ["key", "text"])
    found = [r for b in packing.pieces(Docs(), VOCABULARY).run([batch]) for r in b.to_pylist()]
    assert max(Coder.seen) <= 1 << 19 and sum(Coder.seen) == sum(map(len, texts))
    ids, offsets = bpe.codec(VOCABULARY).encode(batch.column("text"))
    assert np.array_equal(np.bincount([r["key"] for r in found], [r["length"] for r in found]), np.diff(offsets) + 1)
