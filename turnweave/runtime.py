"""Session helpers: a local session for tests and bench, and lineage cuts."""
from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "turnweave") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in spark.checkpoint.dir. A temporary folder is made
    only for a local master, where driver and tasks are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = getattr(work_dir, "_local", None)
    if path is None or not os.path.isdir(path):
        path = work_dir._local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return path


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{work_dir(spark).rstrip('/')}/turnweave-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.

    Results that were not written or collected yet may still read them. It runs
    by itself when the driver's Python ends.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        clean_up(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the run's folder and read it back.

    Used where several jobs read one derived table: it is computed once, and a
    lost executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    folder = run_dir(spark)
    if folder not in _registered:
        _registered.add(folder)
        atexit.register(_at_exit, spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_registered: set[str] = set()
