"""Digests that name a schema, a specification, a pool of sources, or the content of a table whatever its order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def specification(spec: dict, ignore: Collection[str] = ()) -> str:
    """12 hex digits of a specification: its JSON with sorted keys, without what does not change the result."""
    return hashlib.sha256(json.dumps({k: v for k, v in spec.items() if k not in ignore}, sort_keys=True).encode()).hexdigest()[:12]


def pool(paths: Iterable[str]) -> str:
    """12 hex digits of a pool's sources, in any order."""
    return hashlib.sha256("|".join(sorted(map(str, paths))).encode()).hexdigest()[:12]


def row_text(columns: Collection[str]) -> Column:
    """A row as text: columns by name, values with their length, null apart from any text; no two rows share one."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws(",", *[F.concat(F.lit(f"{c}="), part(c)) for c in sorted(columns)])


def _half(md5: Column, start: int, to: int) -> Column:
    """16 hex digits as a number in [0, 2 ** 64), or signed where `to` is negative."""
    return F.conv(F.substring(md5, start, 16), 16, to)


def content(rows: DataFrame, columns: Collection[str] | None = None, by: Collection[str] = ()) -> DataFrame:
    """(by..., rows, sum_high, sum_low, xor_high, xor_low, digest): sum and exclusive or of 128-bit row hashes in two halves, and
    12 hex digits of them. Mergeable and free of order: the same for the same rows on any partitioning, another where one
    value changes or a row comes twice. Sums hold 10 ** 18 rows."""
    columns = [c for c in rows.columns if c not in by] if columns is None else list(columns)
    hashed = rows.select(*by, F.md5(row_text(columns)).alias("h"))
    wide = lambda start: F.sum(_half(F.col("h"), start, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    signed = lambda start: F.bit_xor(_half(F.col("h"), start, -10).cast("long")).cast("string")
    sums = {"sum_high": wide(1), "sum_low": wide(17), "xor_high": signed(1), "xor_low": signed(17)}
    found = hashed.groupBy(*by).agg(F.count("*").alias("rows"), *[F.coalesce(v, F.lit("0")).alias(c) for c, v in sums.items()])
    return found.withColumn("digest", F.substring(F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *sums), 256), 1, 12))
