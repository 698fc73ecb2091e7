"""Session helpers: a local session for tests and benches, and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side of keys and flags with up to this many rows takes some tens of megabytes.
BROADCAST_ROWS = 500_000

_FALLBACK_FOLDER: dict[str, str] = {}
_JOB_FOLDER: ContextVar[str | None] = ContextVar("job_folder", default=None)


def local_session(app: str = "scriptline", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without it a local session gets a temporary folder; on a cluster executors could not share one, so that fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK_FOLDER:
        _FALLBACK_FOLDER[app] = tempfile.mkdtemp(prefix="scriptline-")
    return _FALLBACK_FOLDER[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder (in the job's own part of it, inside ``job_folder``) that nothing else uses."""
    base = _JOB_FOLDER.get() or os.path.join(shared_folder(spark), "scriptline")
    return os.path.join(base, uuid.uuid4().hex, name)


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside the block go to one folder, which is deleted when the block is left.

    Results that depend on them must be written or collected before. Without this block intermediates stay, since a
    lazy result may still need them.
    """
    folder = os.path.join(shared_folder(spark), "scriptline", f"job-{uuid.uuid4().hex}")
    token = _JOB_FOLDER.set(folder)
    try:
        yield folder
    finally:
        _JOB_FOLDER.reset(token)
        delete_path(spark, folder)


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    system, found = _file_system(spark, path)
    return system.exists(found)


def plain_path(spark: SparkSession, path: str) -> str:
    """The absolute path without file system and host."""
    system, found = _file_system(spark, path)
    return system.makeQualified(found).toUri().getPath()


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder."""
    system, found = _file_system(spark, path)
    return [x.getPath().getName() for x in system.listStatus(found)] if system.exists(found) else []


def delete_path(spark: SparkSession, path: str) -> None:
    system, found = _file_system(spark, path)
    system.delete(found, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, short lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A few rows of the plan's own, as a local relation: no job is needed to send them."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, kinds.items(), strict=True)}))


def checked_broadcast(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast ``df`` only when its number of rows is known to be small."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df
