"""Tables kept in the shared folder that the session names, to end lineage where rounds build on rounds."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, one machine's own folder does only if that machine runs all tasks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, for stores that Python cannot open."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file; where it must not be there yet, an error if it is."""
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, replace)
    out.write(bytearray(text.encode()))
    out.close()


def _remove_later(spark: SparkSession, path: str) -> None:
    def clean() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                fs, p = hadoop_path(spark, path)
                fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session has gone
            pass

    atexit.register(clean)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # The write's shuffle files go when it is done: what it wrote is read instead.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _remove_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)
