"""Materialised steps of iterative operators, and totals that run over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """spark.checkpoint.dir, the folder that all executors share. A single process may use any folder of its own; a cluster
    must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df, one row for each value of `order`, with the sum of `value` over all rows before its own. Rows are dealt by range
    and summed part by part; only one sum a part goes through one task."""
    dealt = materialise(df.repartitionByRange(order).withColumn("part_", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part_").agg(F.sum(value).alias("sum_"))
    upto = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = parts.select("part_", F.coalesce(F.sum("sum_").over(upto), F.lit(0)).alias("offset_"))
    within = Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("within_", F.coalesce(F.sum(value).over(within), F.lit(0))).join(offsets, "part_").withColumn(out, F.col("offset_") + F.col("within_")).drop("part_", "within_", "offset_")
