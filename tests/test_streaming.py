import pytest
from pyspark.sql import functions as F

from scriptline.sources.snapshots import SnapshotFolder
from scriptline.streaming.nightly import ingest_new_files, read_months, remove_unused_runs, update_months

COLUMNS = "BNF_CODE string, PRACTICE_CODE string, ITEMS string"


def issue(spark, folder, name, *items, mode="error"):
    spark.createDataFrame([("0101", f"P{i}", str(n)) for i, n in enumerate(items)], COLUMNS).write.mode(mode).parquet(str(folder / name))


def totals(spark, table):
    found = read_months(spark, table).groupBy(F.col("date").cast("string")).agg(F.sum("items"), F.count("*"))
    return {r[0]: (r[1], r[2]) for r in found.collect()}


def test_months_are_added_and_replaced(spark, tmp_path):
    files, table, checkpoint = tmp_path / "files", str(tmp_path / "table"), str(tmp_path / "checkpoint")

    def run():
        ingest_new_files(spark, str(files / "*"), table, checkpoint)

    issue(spark, files, "prescribing_2025-01-01_v1.parquet", 1, 2)
    issue(spark, files, "prescribing_2025-02-01_v2.parquet", 10)
    run()
    assert totals(spark, table) == {"2025-01-01": (3, 2), "2025-02-01": (10, 1)}
    run()
    assert totals(spark, table) == {"2025-01-01": (3, 2), "2025-02-01": (10, 1)}
    issue(spark, files, "prescribing_2025-01-01_v2.parquet", 5)  # a reissue
    issue(spark, files, "prescribing_2025-02-01_v1.parquet", 99)  # an older issue that comes late
    issue(spark, files, "prescribing_2025-03-01_v1.parquet", 7)
    issue(spark, files, "prescribing_2025-03-01_v3.parquet", 8)
    run()
    assert totals(spark, table) == {"2025-01-01": (5, 1), "2025-02-01": (10, 1), "2025-03-01": (8, 1)}


JANUARY = "prescribing_2025-01-01_v1.parquet"


def test_a_part_that_comes_later_is_added(spark, tmp_path):
    files, table, checkpoint = tmp_path / "files", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    issue(spark, files, JANUARY, 5)
    ingest_new_files(spark, str(files / "*"), table, checkpoint)
    issue(spark, files, JANUARY, 7, mode="append")
    issue(spark, files, "prescribing_2024-12-01_v1.parquet", 1)
    ingest_new_files(spark, str(files / "*"), table, checkpoint)
    assert totals(spark, table) == {"2024-12-01": (1, 1), "2025-01-01": (12, 2)}
    issue(spark, files, "prescribing_2025-01-01_v2.parquet", 9)  # a reissue replaces all parts
    ingest_new_files(spark, str(files / "*"), table, checkpoint)
    assert totals(spark, table) == {"2024-12-01": (1, 1), "2025-01-01": (9, 1)}
    assert len(remove_unused_runs(spark, table)) == 1 and totals(spark, table) == {"2024-12-01": (1, 1), "2025-01-01": (9, 1)}


def test_a_changed_file_is_read_again(spark, tmp_path):
    files, table = tmp_path / "files", str(tmp_path / "table")
    issue(spark, files, JANUARY, 5, 6)
    assert update_months(spark, str(files / "*"), table)
    assert not update_months(spark, str(files / "*"), table)
    issue(spark, files, JANUARY, 8, mode="overwrite")
    assert update_months(spark, str(files / "*"), table)
    assert totals(spark, table) == {"2025-01-01": (8, 1)}


def test_months_whose_files_are_gone_stay(spark, tmp_path):
    files, table = tmp_path / "files", str(tmp_path / "table")
    issue(spark, files, JANUARY, 5)
    update_months(spark, str(files / "*"), table)
    issue(spark, tmp_path / "next", "prescribing_2025-02-01_v1.parquet", 2)
    assert update_months(spark, str(tmp_path / "next" / "*"), table)
    assert totals(spark, table) == {"2025-01-01": (5, 1), "2025-02-01": (2, 1)}


def test_a_failed_run_leaves_the_table_readable(spark, tmp_path, monkeypatch):
    files, table, checkpoint = tmp_path / "files", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    issue(spark, files, JANUARY, 5)
    ingest_new_files(spark, str(files / "*"), table, checkpoint)
    issue(spark, files, "prescribing_2025-01-01_v2.parquet", 6)
    with monkeypatch.context() as patch:
        def fail(self, version):
            raise OSError("between the writes")

        patch.setattr(SnapshotFolder, "switch", fail)
        with pytest.raises(Exception, match="between the writes"):
            ingest_new_files(spark, str(files / "*"), table, checkpoint)
    assert totals(spark, table) == {"2025-01-01": (5, 1)}
    ingest_new_files(spark, str(files / "*"), table, checkpoint)  # the night after
    assert totals(spark, table) == {"2025-01-01": (6, 1)}
    assert len(remove_unused_runs(spark, table)) == 2


def test_one_name_in_two_folders_fails(spark, tmp_path):
    for folder in "ab":
        issue(spark, tmp_path / folder, JANUARY, 5)
    with pytest.raises(Exception, match="One file name in two folders"):
        update_months(spark, str(tmp_path / "*" / "*"), str(tmp_path / "table"))
    issue(spark, tmp_path / "b", "prescribing_2025-01-01_v2.parquet", 6)  # earlier issues don't matter
    update_months(spark, str(tmp_path / "*" / "*"), str(tmp_path / "table"))
    assert totals(spark, str(tmp_path / "table")) == {"2025-01-01": (6, 1)}


def test_nothing_published(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing is published"):
        read_months(spark, str(tmp_path / "table"))
