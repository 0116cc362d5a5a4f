"""Session helpers: local sessions for tests and the bench, and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str, cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small tables: merge shuffle partitions less eagerly, so that all cores work
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BILLWEAVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own: a machine-local folder
    would not survive the loss of an executor on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="billweave-"))
    return sc.getCheckpointDir()


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_batches(spark: SparkSession, rows: int) -> None:
    """Send at most `rows` rows at a time to Python from now on; a smaller setting stays.

    A batch of whole texts is held several times over: in Arrow buffers of twice its size
    beside the executor's heap, and as Arrow data and strings in the Python worker, which
    keeps what it once took.  Results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute a table once, write it to the shared folder and go on from the files.

    Cuts the lineage of iterative jobs and keeps costly inputs (hashing whole documents)
    from being computed again for every use.  The files survive the loss of executors, and
    their size is known to the planner.
    """
    path = run_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
