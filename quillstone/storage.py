"""Shared scratch space: tables cut out of a long lineage go to the folder that every executor sees."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder of its own; on a cluster that
    would be a folder of one machine only, so it is an error there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quillstone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(f"file://{own}")
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillstone-{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends there and a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    schema = df.schema
    release(spark)
    table = spark.read.schema(schema).parquet(path)
    table._scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what materialize() wrote for a table that nothing will read again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_RELEASE_SECONDS = 5.0


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; not again within a few seconds."""
    global _released
    if time.monotonic() - _released >= _RELEASE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


_released = float("-inf")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows in a batch that goes to Python; whole texts and pages can be long.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python finds it wherever the driver was started.

    Batches for Python are made small enough for rows that hold whole texts, unless the session has a size of its own.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(context, "_quillstone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "quillstone_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, module.relative_to(root.parent))
    context.addPyFile(str(target))
    context._quillstone_shipped = True
