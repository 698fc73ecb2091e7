"""The nightly ingest as an incremental job: only months with new files are touched.

The state of the source table is a manifest of files: for every month the files its rows came from, with their sizes
and times, and the run that wrote them. A run compares the listing with it and reads only what is new. Its rows go to
a folder of its own; then the new manifest is published, by a pointer that is written last. Until then readers see the
table as it was, so a run may fail anywhere and be repeated. One run at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptline.plans.ingest import monthly_files
from scriptline.session import child_names, delete_path
from scriptline.sources.monthly import PRESCRIBING_ROW, RAW_PRESCRIBING, prescribing_rows
from scriptline.sources.snapshots import SnapshotFolder, file_manifest

def ingest_new_files(spark: SparkSession, files: str, table: str, checkpoint: str) -> None:
    """Bring the source table up to date whenever files matching a pattern have arrived since the last run.

    The stream finds out that there are new files; which of them count, and what they replace, is in the manifest.
    """
    query = (
        spark.readStream.schema(RAW_PRESCRIBING)
        .parquet(files)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: update_months(batch.sparkSession, files, table))
        .start()
    )
    query.awaitTermination()


def month_state(listed: DataFrame, held: DataFrame, run: str) -> DataFrame:
    """The next manifest (date, name, path, size, modified, run) from the listed files and the one there is.

    * A month whose greatest name is greater than the held one is replaced as a whole: a reissue wins over an earlier
      issue in whatever order they come. A smaller name, or no file, leaves the month as it is.
    * Files that come later under the held name are added.
    * When a held file has changed or gone while others of its name are there, the month is read again.
    """
    month = Window.partitionBy("date")
    now = listed.select("date", "path", F.struct("name", "size", "modified").alias("now"))
    then = held.select("date", "path", F.struct("name", "size", "modified").alias("then"), F.col("run").alias("held_run"))
    both = now.join(then, ["date", "path"], "full").select(
        "*", F.max("now.name").over(month).alias("newest"), F.max("then.name").over(month).alias("issue")
    )
    older = F.col("newest").isNull() | (F.col("newest") < F.col("issue"))
    broken = F.col("then").isNotNull() & (F.col("now").isNull() | (F.col("now") != F.col("then")))
    again = F.col("issue").isNull() | (F.col("newest") > F.col("issue")) | F.max(broken).over(month)
    kept = both.withColumn("action", F.when(older, "keep").when(again, "read").otherwise("add"))
    there = F.col("then").isNotNull()
    is_held = (F.col("action") != "read") & there
    is_new = F.when(F.col("action") == "read", F.col("now").isNotNull()).otherwise((F.col("action") == "add") & ~there)
    facts = F.when(is_held, F.col("then")).otherwise(F.col("now"))
    rows = kept.where(is_held | is_new).select("date", "path", facts.alias("f"), F.when(is_held, F.col("held_run")).otherwise(F.lit(run)).alias("run"))
    return rows.select("date", "f.name", "path", "f.size", "f.modified", "run")


def update_months(spark: SparkSession, files: str, table: str) -> bool:
    """Read the monthly files that the table lacks and publish it with them. Returns whether anything changed."""
    folder, run = SnapshotFolder(spark, table), f"run{uuid.uuid4().hex}"
    listed, held = monthly_files(spark, files), folder.recorded()
    if held is None:
        held = listed.withColumn("run", F.lit(run)).limit(0)
    elif file_manifest(listed, held).where("status != 'gone'").isEmpty():
        return False
    # The listing is taken once: what is recorded is what is read.
    folder.record(run, month_state(listed, held, run))
    arrived = [r["path"] for r in folder.files(run).where(F.col("run") == run).select("path").collect()]  # new files
    if not arrived:
        return False
    rows = prescribing_rows(spark.read.schema(RAW_PRESCRIBING).parquet(*sorted(arrived))).drop("file")
    # Months are of one size, but a hot one may be large: the hint lets Spark split it over several files.
    rows.hint("rebalance", "date").write.partitionBy("date").parquet(f"{table}/months/run={run}")
    folder.switch(run)
    return True


def read_months(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the published months."""
    held = SnapshotFolder(spark, table).recorded()
    if held is None:
        raise ValueError(f"nothing is published in {table}")
    parts = [f"{r['run']}/{r['date']}" for r in held.select("run", "date").distinct().collect()]  # a few a month
    rows = spark.read.schema(f"{PRESCRIBING_ROW}, run string, date date").parquet(f"{table}/months")
    return rows.where(F.concat_ws("/", "run", "date").isin(parts)).drop("run")


def remove_unused_runs(spark: SparkSession, table: str) -> list[str]:
    """Delete the rows of runs that no month of the published version comes from: failed ones and replaced months.

    Not for a time when readers may still use an earlier version.
    """
    held = SnapshotFolder(spark, table).recorded()
    used = set() if held is None else {r["run"] for r in held.select("run").distinct().collect()}
    unused = [n for n in child_names(spark, f"{table}/months") if n.startswith("run=") and n.removeprefix("run=") not in used]
    for name in unused:
        delete_path(spark, f"{table}/months/{name}")
    return unused
