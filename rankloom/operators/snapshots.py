"""Lookups that are consistent with a snapshot: what was known at a version, never what came after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.steps import materialise


def first_version(snapshot_pair: Column) -> Column:
    """A of 'vA-vB' (or 'A-B'); null where the text is no such pair."""
    return F.nullif(F.regexp_extract(snapshot_pair, r"^v?(\d+)-v?\d+$", 1), F.lit("")).cast("long")


def as_of(rows: DataFrame, versions: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """rows with `found`, a struct of versions' other columns and of its `at`: the newest version of the same key whose `at` is
    not after the row's; null without one. versions has one row for each key and `at`.

    Both tables are laid in one order by range of (key, at), versions before rows, and a row takes the last version before it:
    one sort, no pairs. What a range's first rows need from earlier ranges is the last version there, one row a range, so a
    key of many ranges is no different. Rows with a null `at` find nothing."""
    key = [F.col(c).alias(f"k{i}_") for i, c in enumerate(by)]
    names = [f"k{i}_" for i in range(len(by))]
    payload = F.struct(*[c for c in versions.columns if c not in by])
    row = F.struct(*rows.columns)
    v = versions.where(F.col(at).isNotNull()).select(*key, F.col(at).alias("at_"), F.lit(0).alias("side_"), payload.alias("found_"))
    v = v.withColumn("row_", F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType))
    r = rows.select(*key, F.col(at).cast(v.schema["at_"].dataType).alias("at_"), F.lit(1).alias("side_"), F.lit(None).cast(v.schema["found_"].dataType).alias("found_"), row.alias("row_"))
    dealt = materialise(v.unionByName(r).repartitionByRange(*names, "at_", "side_").withColumn("part_", F.spark_partition_id()), "ranges")
    order = F.struct(*names, "at_", "side_")
    # the last version of each range, and the last of all ranges before: one row a range
    tails = dealt.where("side_ = 0").groupBy("part_").agg(F.max_by(F.struct(*names, "found_"), order).alias("tail_"))
    parts = dealt.select("part_").distinct().join(tails, "part_", "left")
    upto = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("part_", F.last("tail_", ignorenulls=True).over(upto).alias("carried_"))
    within = Window.partitionBy("part_", *names).orderBy("at_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("own_", F.last("found_", ignorenulls=True).over(within)).where("side_ = 1").join(carried, "part_")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"carried_.{n}"))
    found = F.coalesce("own_", F.when(F.col("carried_").isNotNull() & same, F.col("carried_.found_")))
    return own.select("row_.*", F.when(F.col("at_").isNotNull(), found).alias("found"))


def known_at(rows: DataFrame, versions: DataFrame, annotations: DataFrame, by: Sequence[str] = ("entity",), pair: str = "snapshot_pair") -> DataFrame:
    """rows(by..., term, pair) with version, the newest annotation version of their key that is not after A of 'vA-vB', and
    known, whether that version's set holds the term. versions(by..., version, set_id), annotations(set_id, term)."""
    asked = rows.withColumn("version", first_version(F.col(pair)))
    met = as_of(asked, versions.select(*by, "version", "set_id"), by, "version")
    met = met.withColumns({"version": F.col("found.version"), "set_id": F.col("found.set_id")}).drop("found")
    held = annotations.select("set_id", "term").distinct().withColumn("held_", F.lit(True))
    return met.join(held, ["set_id", "term"], "left").select(*rows.columns, "version", F.coalesce("held_", F.lit(False)).alias("known"))
