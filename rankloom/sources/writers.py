"""Sinks: datasets with manifests, split and bucketed rows, prediction files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.steps import shared_dir

from .readers import ranked


def dataset(rows: DataFrame, path: str, columns: Sequence[str], snapshots: Sequence[str] | None = None, files: int = 16, manifest: dict | None = None) -> None:
    """A derived dataset: some columns and snapshots, an entity's rows in one file, sorted; a manifest beside it."""
    part = rows if snapshots is None else rows.where(F.col("snapshot_pair").isin(list(snapshots)))
    part.select(*columns).repartition(files, columns[0]).sortWithinPartitions(columns[0]).write.mode("overwrite").parquet(f"{path}/train.parquet")
    if manifest is not None:
        rows.sparkSession.createDataFrame([manifest]).coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")


def split_rows(rows: DataFrame, path: str, group: Sequence[str], files: int = 16) -> None:
    """Rows by split (column validation), an entity's rows in one file, groups together."""
    rows.repartition(files, "entity").sortWithinPartitions(*group).write.mode("overwrite").partitionBy("validation").parquet(path)


def bucketed(rows: DataFrame, by: Sequence[str], buckets: int = 16, sort: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Writes rows as Parquet dealt by a hash of `by` into buckets, each sorted by `by` and then `sort`, and returns the table read
    back: aggregates, windows and joins on `by` then plan without an exchange. The files stay in `path` (by default a new
    folder of the shared one); the catalog keeps no entry, as the frame carries the table's layout."""
    spark = rows.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", path or f"{shared_dir(spark)}/{name}").bucketBy(buckets, *by).sortBy(*by, *sort).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def predictions_parquet(rows: DataFrame, path: str) -> None:
    rows.select("entity", "label", "score").write.mode("overwrite").option("compression", "zstd").parquet(path)


def predictions_tsv(rows: DataFrame, path: str, most: int, cell: str | None = None) -> None:
    """Each entity's best `most` terms with six decimals, one folder for each cell. A term that scores alike in two cells is
    ranked by cell, so that reruns write the same rows."""
    columns = ["entity", "term", F.format_string("%.6f", F.col("score").cast("double")).alias("score")]
    by_cell = [cell] if cell else []
    out = ranked(rows, most, by_cell).select(*columns, *by_cell)
    writer = out.write.mode("overwrite").option("sep", "\t")
    (writer.partitionBy(cell) if cell else writer).csv(path)
