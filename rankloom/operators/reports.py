"""Tables of analysis: strata, winners, policies, replication, misses, promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winner_per_cell(results: DataFrame, cell: str, value: str, name: str) -> DataFrame:
    """The best name in each cell; ties by name."""
    best = results.groupBy(cell).agg(F.max(F.struct(F.col(value).alias("v"), F.col(name).alias("n"))).alias("b"))
    return best.select(cell, F.col("b.n").alias(name), F.col("b.v").alias(value))


def majority(winners: DataFrame, name: str) -> DataFrame:
    return winners.groupBy(name).agg(F.count("*").alias("cells"))


def policy_average(results: DataFrame, tier: str, use: Sequence, model: str, baseline: str) -> DataFrame:
    """Mean over cells where the model is used in some tiers and the baseline in others, and the gain over the baseline."""
    chosen = F.when(F.col(tier).isin(list(use)), F.col(model)).otherwise(F.col(baseline))
    return results.agg(F.avg(chosen).alias("policy"), F.avg(baseline).alias("baseline"), (F.avg(chosen) - F.avg(baseline)).alias("gain"))


def run_delta(a: DataFrame, b: DataFrame, cell: str, value: str) -> DataFrame:
    both = a.select(cell, F.col(value).alias("a")).join(b.select(cell, F.col(value).alias("b")), cell, "full")
    return both.withColumn("delta", F.col("b") - F.col("a"))


def verdicts(results: DataFrame, value: str, baseline: str, band: float = 0.002) -> DataFrame:
    d = F.col(value) - F.col(baseline)
    return results.withColumn("verdict", F.when(d > band, "better").when(d < -band, "worse").otherwise("same"))


def replication(runs: DataFrame, cell: str, seed: str, value: str, seeds: Sequence) -> DataFrame:
    """Seeds side by side with mean and population deviation."""
    wide = runs.groupBy(cell).pivot(seed, list(seeds)).agg(F.max(value))
    return wide.select(cell, *[F.col(str(s)).alias(f"seed_{s}") for s in seeds]).join(runs.groupBy(cell).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation")), cell)


def importance_report(importances: DataFrame, cell: str) -> DataFrame:
    """(feature, mean_rank, total): the rank of each feature in each cell, averaged."""
    ranked = importances.withColumn("rank", F.row_number().over(Window.partitionBy(cell).orderBy(F.desc("importance"), "feature")))
    return ranked.groupBy("feature").agg(F.avg("rank").alias("mean_rank"), F.sum("importance").alias("total"))


def strata_precision(rows: DataFrame, stratum: Column, least: int) -> DataFrame:
    return rows.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), F.avg("label").alias("precision")).where(F.col("n") >= least)


def tier_counts(rows: DataFrame, by: str, tier: str, tiers: Sequence) -> DataFrame:
    """Rows per tier side by side, a bit mask of the tiers present, and how many there are."""
    masks = F.when(F.col(tier) == tiers[0], 1)
    for k, t in enumerate(tiers[1:], 1):
        masks = masks.when(F.col(tier) == t, 1 << k)
    return rows.groupBy(by).agg(*[F.count(F.when(F.col(tier) == t, 1)).alias(f"n_{k}") for k, t in enumerate(tiers)], F.bit_or(F.coalesce(masks, F.lit(0))).alias("mask"), F.countDistinct(tier).alias("breadth"))


def group_sizes(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many groups there are of each size."""
    return rows.groupBy(*key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def error_atlas(rows: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Per entity: weight right, wrong and missed at a threshold, F as delivered, and F if only right ones were kept."""
    w = F.coalesce("ia", F.lit(1.0))
    said = F.col("score") >= threshold
    take = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    per = rows.join(weights, "term", "left").groupBy("entity").agg(take(said & (F.col("label") == 1)).alias("tp"), take(said & (F.col("label") == 0)).alias("fp"), take(~said & (F.col("label") == 1)).alias("fn"))
    f = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return per.select("entity", "tp", "fp", "fn", f(F.col("tp"), F.col("fp"), F.col("fn")).alias("delivered"), f(F.col("tp"), F.lit(0.0), F.col("fn")).alias("without_wrong"))


def miss_classes(predicted: DataFrame, truth: DataFrame, closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Per true (entity, term): hit, too_shallow (some ancestor is predicted), overshot (some descendant), sibling, or other."""
    p = predicted.select("entity", F.col("term").alias("said")).distinct()
    t = truth.select("entity", "term").distinct()
    strict = closure.where("term <> ancestor")
    flagged = lambda rows, name: t.join(rows.select("entity", "term").distinct().withColumn(name, F.lit(1)), ["entity", "term"], "left_semi").withColumn(name, F.lit(1))
    # an entity's own terms meet, never all of a graph's: what lies above a prediction, a true term's ancestors, and shared parents
    above = p.join(strict, p["said"] == strict["term"]).select("entity", F.col("ancestor").alias("term"))
    below = t.join(strict, "term").join(p.select("entity", F.col("said").alias("ancestor")), ["entity", "ancestor"], "left_semi")
    up = edges.select(F.col("child").alias("term"), "parent")
    beside = t.join(up, "term").join(p.join(up, p["said"] == up["term"]).select("entity", "parent", "said"), ["entity", "parent"]).where("said <> term")
    hit = t.join(p.withColumnRenamed("said", "term"), ["entity", "term"], "left_semi").withColumn("hit", F.lit(1))
    marked = t.join(hit, ["entity", "term"], "left")
    for rows, name in ((below, "up"), (above, "down"), (beside, "side")):
        marked = marked.join(flagged(rows, name), ["entity", "term"], "left")
    c = F.when(F.col("hit") == 1, "hit").when(F.col("down") == 1, "overshot").when(F.col("up") == 1, "too_shallow").when(F.col("side") == 1, "sibling").otherwise("other")
    return marked.select("entity", "term", c.alias("class"))


def promotion_walk(candidates: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A fold in order for each group: the first is the incumbent; a candidate is promoted if its low bound exceeds the
    incumbent's mean. candidates(..., name, mean, low): adds promoted and the incumbent mean that it met. A group is one
    series of runs, folded inside the JVM."""
    series = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "name", "mean", "low"))).alias("runs"))
    start = "struct(cast(null as double) as mean, cast(array() as array<struct<name:string,mean:double,low:double,met:double,promoted:boolean>>) as trace)"
    step = "(a, r) -> struct(if(a.mean is null or r.low > a.mean, r.mean, a.mean) as mean, concat(a.trace, array(struct(cast(r.name as string) as name, r.mean as mean, r.low as low, a.mean as met, (a.mean is null or r.low > a.mean) as promoted))) as trace)"
    return series.select(*by, F.explode(F.expr(f"aggregate(runs, {start}, {step}, a -> a.trace)")).alias("t")).select(*by, "t.*")
