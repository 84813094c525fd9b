"""Blends of candidate streams and statistics over their union; a stream is (entity, term, score)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["entity", "term"]


def collapse(stream: DataFrame) -> DataFrame:
    return stream.groupBy(*PAIR).agg(F.max("score").alias("score"))


def union_streams(streams: Mapping[str, DataFrame], missing: Mapping[str, float] | None = None) -> DataFrame:
    """(entity, term, <name>, in_<name>...): one shuffle for all streams; absent scores are missing[name], else 0."""
    tagged = None
    for name, stream in streams.items():
        part = stream.select(*PAIR, F.lit(name).alias("stream_"), F.col("score"))
        tagged = part if tagged is None else tagged.unionByName(part)
    mine = lambda n: F.when(F.col("stream_") == n, F.col("score"))
    found = tagged.groupBy(*PAIR).agg(*[F.max(mine(n)).alias(n) for n in streams])
    gaps = missing or {}
    return found.select(*PAIR, *[F.coalesce(n, F.lit(float(gaps.get(n, 0.0)))).alias(n) for n in streams], *[F.col(n).isNotNull().cast("int").alias(f"in_{n}") for n in streams])


def blend(a: DataFrame, b: DataFrame, how: Column) -> DataFrame:
    """The full union of two streams with a score out of columns a and b (0 where absent)."""
    return union_streams({"a": a, "b": b}).select(*PAIR, how.alias("score"))


def max_blend(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    return blend(a, b, F.greatest("a", alpha * F.col("b")))


def agreement_boost(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """a's rows; where b has the pair too, alpha more, 1 at most."""
    return union_streams({"a": a, "b": b}).where("in_a = 1").select(*PAIR, F.when(F.col("in_b") == 1, F.least(F.lit(1.0), F.col("a") + alpha)).otherwise(F.col("a")).alias("score"))


def noisy_or(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    return blend(a, b, 1 - (1 - F.col("a")) * (1 - weight * F.col("b")))


def graft(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger score of either, for a's entities alone."""
    return max_blend(a, b, 1.0).join(a.select("entity").distinct(), "entity", "left_semi")


def append_only(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's rows with b's score and its rank within the entity; then b's rows that a lacks, at score null."""
    ranked = b.select(*PAIR, F.col("score").alias("other"), F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "term")).alias("other_rank"))
    kept = a.join(ranked, PAIR, "left").withColumn("appended", F.lit(0))
    return kept.unionByName(ranked.join(a.select(*PAIR), PAIR, "left_anti").withColumn("appended", F.lit(1)), allowMissingColumns=True)


def fallback(main: DataFrame, second: DataFrame) -> DataFrame:
    """main, and second's rows for entities that main does not cover."""
    return main.unionByName(second.join(main.select("entity").distinct(), "entity", "left_anti"))


def seed_average(runs: DataFrame, n: int) -> DataFrame:
    """Mean over n runs of a pair's score; a run without the pair counts as 0."""
    return runs.groupBy(*PAIR).agg((F.sum("score") / n).alias("score"))


def consensus_curve(union: DataFrame, flags: list[str], label: str = "label") -> DataFrame:
    """Per level of agreement: rows, precision, and the same for that level or more."""
    level = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    each = union.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.sum(label).alias("hits"))
    down = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each level
    return each.select("level", "rows", (F.col("hits") / F.col("rows")).alias("precision"), F.sum("rows").over(down).alias("rows_or_more"), (F.sum("hits").over(down) / F.sum("rows").over(down)).alias("precision_or_more"))


def union_recall(streams: Mapping[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Per stream in order: true pairs it covers, those it covers first, and its false rows."""
    u = union_streams(streams).join(truth.select(*PAIR).distinct().withColumn("y", F.lit(1)), PAIR, "left")
    first = None
    for n in reversed(list(streams)):
        first = F.when(F.col(f"in_{n}") == 1, n) if first is None else F.when(F.col(f"in_{n}") == 1, n).otherwise(first)
    u = u.withColumn("first_", first)
    rows = u.select("y", "first_", F.explode(F.array(*[F.when(F.col(f"in_{n}") == 1, F.lit(n)) for n in streams])).alias("stream")).where("stream is not null")
    return rows.groupBy("stream").agg(F.sum(F.coalesce("y", F.lit(0))).alias("covers"), F.sum(F.when((F.col("y") == 1) & (F.col("first_") == F.col("stream")), 1).otherwise(0)).alias("covers_first"), F.sum(F.when(F.col("y").isNull(), 1).otherwise(0)).alias("false_rows"))


def duplicate_lift(rows: DataFrame) -> DataFrame:
    """rows(entity, term, stream, label): positive rate of pairs by the number of streams that have them."""
    per = rows.groupBy(*PAIR).agg(F.countDistinct("stream").alias("streams"), F.max("label").alias("label"))
    return per.groupBy("streams").agg(F.count("*").alias("pairs"), F.avg("label").alias("rate"))


def term_prior(rows: DataFrame, alpha: float) -> DataFrame:
    """(term, n, prior): (positives + alpha * g) / (n + alpha), g the overall rate."""
    g = rows.agg(F.avg("label").alias("g_"))
    per = rows.groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("p_"))
    return per.crossJoin(F.broadcast(g)).select("term", "n", ((F.col("p_") + alpha * F.col("g_")) / (F.col("n") + alpha)).alias("prior"))  # g is one row
