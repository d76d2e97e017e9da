"""Session settings, checkpoints and shipping of the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumora")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.retainedJobs", "100")  # what the driver keeps of past jobs and plans is never shown
        .config("spark.ui.retainedStages", "100")
        .config("spark.ui.retainedTasks", "2000")
        .config("spark.sql.ui.retainedExecutions", "20")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset on a local master (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumora-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str = "") -> str:
    """A path of its own in the application's part of the shared folder, which is removed when Python ends."""
    folder = f"{checkpoint_dir(spark)}/lumora-{spark.sparkContext.applicationId}"
    _remove_at_exit(spark, folder)
    return f"{folder}/{name}{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage: a Parquet table in the shared folder, written and read again.

    A table rather than checkpoint(): a checkpoint hands its plan's constraints on, which double with each round of an iteration
    until planning takes longer than the work.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python batches of so many rows at most: a batch of wide rows lies whole in the executor and in its worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_lumora_tables", None) == folder:
        return
    sc._lumora_tables = folder

    def remove() -> None:
        if sc._jsc is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, unless PYTHONPATH already has it there."""
    sc = spark.sparkContext
    if getattr(sc, "_lumora_shipped", False):
        return
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT.parent) not in on_path:
        path = Path(tempfile.mkdtemp(prefix="lumora-ship-"), "lumora.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(ROOT.rglob("*.py")):
                z.write(f, f.relative_to(ROOT.parent))
        sc.addPyFile(str(path))
    sc._lumora_shipped = True
