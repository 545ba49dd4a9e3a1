"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where it is unset and all runs in one process (tests, a single machine) is a temporary
    folder made and set; on a cluster an unset folder is an error, for executors could not share one.
    """
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="lorekiln-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lorekiln/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Every executor can read the files, so none of them is lost with an executor. They
    go when they are discarded, or when the session's Python process ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads. What is not a written table itself is left alone."""
    for table in tables:
        path = table.__dict__.pop("_written_at", None)
        if path:
            remove(table.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files that no plan refers to any more.

    The driver learns of that in two steps, so it collects its garbage as often.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
