"""Shared pieces: reading tables, keys of rows, and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one machine's own folder does only if that machine runs all tasks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared folder; None if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file of the shared folder; an error if it is there already."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def clean() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                remove_path(spark, path)
        except Exception:  # noqa: BLE001 - the session has gone; nothing is left to clean with
            pass

    atexit.register(clean)


#: Lets a write drop its shuffle files when it is done: what it wrote is read instead, and nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    remove_at_exit(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(df: DataFrame) -> None:
    """Removes a stored table that nothing reads any more, before the session ends."""
    remove_path(df.sparkSession, df.stored_path)


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """128 bits naming a row by its id and text. Rows alike in both share a key, and share every result."""
    return (
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"),
        F.xxhash64(F.lit(7), F.col(text_col), F.col(id_col)).alias("k2"),
    )


def text_keys(text_col: str = "text") -> tuple[Column, Column]:
    """128 bits naming a text."""
    return F.xxhash64(F.lit(1), F.col(text_col)), F.xxhash64(F.lit(2), F.col(text_col))


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
