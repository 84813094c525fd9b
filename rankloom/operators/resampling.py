"""Bootstrap intervals and paired tests.

No row is ever drawn: an entity's weight in a resample is a Poisson(1) count out of a hash of its own, so that per-entity
figures are aggregated first and no dense numbering is needed. One md5 serves eight resamples, 16 bits each."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.steps import before

from .metrics import bin_of, f_score

#: Cumulative Poisson(1): a hash in 0..1 below the k-th is a count of k at most.
_POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8))


_LANES = 8


def resample(per_entity: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """per_entity with each row's weight in resamples 0..n-1; rows that a resample leaves out are left out."""
    blocks = per_entity.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // _LANES))))
    hashed = blocks.withColumn("hash_", F.md5(F.concat_ws("|", F.lit(seed), "block_", "entity")))
    u = [F.conv(F.substring("hash_", 4 * k + 1, 4), 16, 10).cast("double") / 65536.0 for k in range(_LANES)]
    lanes = F.array(*[F.struct((F.col("block_") * _LANES + k).alias("resample"), sum(((x >= c).cast("int") for c in _POISSON[1:]), (x >= _POISSON[0]).cast("int")).alias("weight")) for k, x in enumerate(u)])
    rows = hashed.withColumn("lane_", F.explode(lanes)).select(*per_entity.columns, "lane_.resample", "lane_.weight")
    return rows.where((F.col("weight") > 0) & (F.col("resample") < n))


def resampled_sums(per_entity: DataFrame, columns: Sequence[str], n: int, seed: str = "0") -> DataFrame:
    """(resample, weight, columns...): in each of the resamples 0..n-1 the sum of the entities' weights, and of weight times each
    column (null counts 0). Weights are those of resample(), but no row is made for an entity and a resample: a task adds up one
    array of n sums for each column, and arrays meet by resample."""
    hashes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((n - 1) // _LANES)), lambda b: F.md5(F.concat_ws("|", F.lit(seed), b.cast("string"), F.col("entity").cast("string")))), "")
    rows = per_entity.select(hashes.alias("h"), F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    width, cuts = len(columns) + 1, np.array(_POISSON)

    def each(batches):
        total = np.zeros((n, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                u = np.frombuffer(bytes.fromhex("".join(b.column(0).to_pylist())), ">u2").reshape(b.num_rows, -1)[:, :n] / 65536.0
                total += np.searchsorted(cuts, u, "right").T @ np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, width)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["resample", "s"])

    found = rows.mapInArrow(each, "resample int, s array<double>")
    return found.groupBy("resample").agg(*[F.sum(F.get("s", F.lit(i))).alias(c) for i, c in enumerate(["weight", *columns])]).where("weight > 0")


def interval(samples: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return samples.agg(F.avg(value).alias("mean"), F.expr(f"percentile({value}, {tail})").alias("low"), F.expr(f"percentile({value}, {1 - tail})").alias("high"))


def mean_difference(per_entity: DataFrame, a: str, b: str, n: int = 200, seed: str = "0") -> DataFrame:
    """(mean, low, high, p, separates) of the mean of a - b over entities; p: resamples at or below 0."""
    sums = resampled_sums(per_entity.select("entity", (F.col(a) - F.col(b)).alias("d")), ["d"], n, seed)
    means = sums.select((F.col("d") / F.col("weight")).alias("d"))
    tail = means.agg(F.avg((F.col("d") <= 0).cast("double")).alias("p"))
    return interval(means, "d").crossJoin(F.broadcast(tail)).withColumn("separates", (F.col("low") > 0) | (F.col("high") < 0))  # tail is one row


def micro_f_difference(per_entity: DataFrame, n: int = 200, seed: str = "0") -> DataFrame:
    """per_entity(entity, tp_a, n_a, tp_b, n_b, wanted): interval of the difference of pooled F."""
    sums = resampled_sums(per_entity, ["tp_a", "n_a", "tp_b", "n_b", "wanted"], n, seed)
    f = lambda s: 2 * F.col(f"tp_{s}") / F.greatest(F.col(f"n_{s}") + F.col("wanted"), F.lit(1e-12))
    return interval(sums.select((f("a") - f("b")).alias("d")), "d")


def grouped_intervals(samples: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean and interval of pooled samples by any axes; a null axis is 'unknown'."""
    tail = (1 - level) / 2
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by]
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile({value}, {tail})").alias("low"), F.expr(f"percentile({value}, {1 - tail})").alias("high"))


def wilcoxon(pairs: DataFrame, by: str) -> DataFrame:
    """pairs(by, d): signed-rank test by the normal approximation with tie correction: (by, n, w, z); zero differences go. Ranks
    come from counts by distinct size, dealt by range, so no task holds a group's rows."""
    steps = pairs.where("d <> 0").groupBy(F.struct(F.col(by).alias("g"), F.abs(F.round("d", 12)).alias("a")).alias("key_")).agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    ranked = before(steps, "key_", "t", "below").withColumn("g_", F.col("key_.g"))
    first = ranked.groupBy(F.col("g_").alias("of_")).agg(F.min("below").alias("first"))
    rank = F.col("below") - F.col("first") + (F.col("t") + 1) / 2
    n = F.sum("t")
    s = ranked.join(first, F.col("g_").eqNullSafe(F.col("of_"))).groupBy(F.col("g_").alias(by)).agg(n.alias("n"), F.sum(F.col("up") * rank).alias("w"), F.sum(F.col("t").cast("double") * (F.col("t") * F.col("t") - 1)).alias("ties"))
    m = F.col("n").cast("double")
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    return s.select(by, "n", "w", F.when(spread > 0, (F.col("w") - m * (m + 1) / 4) / spread).otherwise(0.0).alias("z"))


def holm(tests: DataFrame, p: str) -> DataFrame:
    """Adds adjusted: Holm's step-down of the p values of a table of tests."""
    order = Window.orderBy(p, *[c for c in tests.columns if c != p])  # one row for each comparison
    m = F.count("*").over(Window.partitionBy())
    stepped = tests.withColumn("step_", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return stepped.withColumn("adjusted", F.max("step_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step_")


def _fmax_changes(rows: DataFrame, score: str, thresholds: int) -> DataFrame:
    """(entity, bin, p, r, k): how an entity's precision, recall and being predicted change as the threshold falls to bin."""
    wanted = rows.groupBy("entity").agg(F.sum("label").alias("wanted"))
    bins = rows.groupBy("entity", bin_of(F.col(score), thresholds).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    w = Window.partitionBy("entity").orderBy(F.desc("bin"))
    runs = bins.select("entity", "bin", F.sum("n").over(w).alias("n"), F.sum("y").over(w).alias("tp")).join(wanted, "entity")
    p, r = F.col("tp") / F.col("n"), F.when(F.col("wanted") > 0, F.col("tp") / F.col("wanted")).otherwise(0.0)
    now = runs.select("entity", "bin", p.alias("p"), r.alias("r"))
    last = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    return now.select("entity", "bin", (F.col("p") - last("p")).alias("p"), (F.col("r") - last("r")).alias("r"), F.lag("bin").over(w).isNull().cast("int").alias("k"))


def fmax_samples(rows: DataFrame, scores: tuple[str, str], n: int = 200, seed: str = "0", thresholds: int = 50) -> DataFrame:
    """(resample, a, b): the entity-averaged Fmax of two scores of rows(entity, label, ...) in each resample of entities;
    precision averages entities that predict, recall those with a positive."""
    weights = resample(rows.groupBy("entity").agg(F.max("label").alias("y")), n, seed).select("resample", "entity", "weight", "y")
    true = weights.groupBy("resample").agg(F.sum(F.col("weight") * F.col("y")).alias("true"))
    out = None
    for name, score in zip("ab", scores, strict=True):
        sums = _fmax_changes(rows, score, thresholds).join(weights, "entity").groupBy("resample", "bin").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in "prk"])
        w = Window.partitionBy("resample").orderBy(F.desc("bin"))  # one row for each threshold
        swept = sums.select("resample", *[F.sum(c).over(w).alias(c) for c in "prk"]).join(true, "resample")
        p, r = F.when(F.col("k") > 0, F.col("p") / F.col("k")).otherwise(0.0), F.when(F.col("true") > 0, F.col("r") / F.col("true")).otherwise(0.0)
        best = swept.groupBy("resample").agg(F.max(f_score(p, r)).alias(name))
        out = best if out is None else out.join(best, "resample")
    return out


def fmax_difference(rows: DataFrame, a: str, b: str, n: int = 200, seed: str = "0", thresholds: int = 50) -> DataFrame:
    """(mean, low, high, p): paired bootstrap over entities of Fmax(a) - Fmax(b); p: resamples at or below 0."""
    d = fmax_samples(rows, (a, b), n, seed, thresholds).select(F.round(F.col("a") - F.col("b"), 12).alias("d"))  # equal up to rounding is equal
    return interval(d, "d").crossJoin(F.broadcast(d.agg(F.avg((F.col("d") <= 0).cast("double")).alias("p"))))  # one row


def seed_intervals(runs: DataFrame, cell: str, a: str, b: str, n: int = 200, seed: str = "0", level: float = 0.95) -> DataFrame:
    """runs(cell, seed, a, b) -> (cell, mean, low, high, significant): bootstrap over the seeds of each cell."""
    tail = (1 - level) / 2
    rows = resample(runs.withColumn("entity", F.concat_ws("|", cell, "seed")), n, seed)
    means = rows.groupBy(cell, "resample").agg((F.sum(F.col("weight") * (F.col(a) - F.col(b))) / F.sum("weight")).alias("d"))
    out = means.groupBy(cell).agg(F.expr(f"percentile(d, {tail})").alias("low"), F.expr(f"percentile(d, {1 - tail})").alias("high"))
    point = runs.groupBy(cell).agg(F.avg(F.col(a) - F.col(b)).alias("mean"))
    return point.join(out, cell).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def independent_arms(a: DataFrame, b: DataFrame, n: int = 200, seed: str = "0") -> DataFrame:
    """(arm, mean, low, high) of two arms(entity, value) that are resampled apart, and of their difference."""
    mean = lambda t, s: resample(t.select("entity", "value"), n, f"{seed}{s}").groupBy("resample").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias(s))
    both = mean(a, "a").join(mean(b, "b"), "resample").withColumn("difference", F.col("a") - F.col("b"))
    out = None
    for arm in ("a", "b", "difference"):
        part = interval(both, arm).withColumn("arm", F.lit(arm))
        out = part if out is None else out.unionByName(part)
    return out
