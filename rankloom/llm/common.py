"""What the operators of this subpackage share: tables, materialised steps, ASCII text rules."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of an input folder; every path goes through Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rankloom_path = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """materialise() as a table dealt by a hash of `key` into as many buckets as a shuffle has partitions: tables written so
    join on the key without another shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", f"{shared_dir(spark)}/{table}").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def discard(df: DataFrame | None) -> None:
    """Deletes what materialise() wrote; only for tables that nothing reads any more."""
    path = getattr(df, "_rankloom_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Hands memory that this Python process has freed back to the system; its allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other C libraries have none
    if trim:
        trim(0)


def lean(each: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back before and after its partition: a worker serves one stage after
    another, and waits beside those that need none."""

    @functools.wraps(each)
    def run(batches):
        give_back()
        yield from each(batches)
        give_back()

    return run


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids count as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (extra columns of a table may carry any name)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
