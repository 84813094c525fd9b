"""Joins and samples that make training sets: genuine cells, leakage, twins, splits, negatives, caps, budgets.

Samples go by md5 of a seed and the ids, so they are the same on every run and on every partitioning. Ranks over all rows
of one large group are avoided: shares of a whole table are cut on the hash value itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_int(*columns: str | Column, seed: str = "0") -> Column:
    """A number of 32 bits from md5 of seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *columns)), 1, 8), 16, 10).cast("long")


def hash_long(*columns: str | Column, seed: str = "0") -> Column:
    """A number of 60 bits from md5 of seed and columns, for places in tables of any size."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *columns)), 1, 15), 16, 10).cast("long")


def genuine(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key has a positive somewhere."""
    return rows.join(rows.where("label = 1").select(*key).distinct(), list(key), "left_semi")


def without_leaks(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows whose (entity, term) is no positive of train."""
    return rows.join(train.where("label = 1").select("entity", "term").distinct(), ["entity", "term"], "left_anti")


def without_twins(references: DataFrame, queries: DataFrame, content: str) -> DataFrame:
    """References that share no content with any query."""
    return references.join(queries.select(content).distinct(), content, "left_anti")


def unseen_first_collapse(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each (group, term) by an explicit order."""
    w = Window.partitionBy(*group, "term").orderBy(*order)
    return rows.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def top_n(rows: DataFrame, n: int, by: str = "entity", score: str = "score", tie: str = "term") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("rank") <= n)


def within_entity(rows: DataFrame) -> DataFrame:
    """Adds norm_rank in 0..1, z (0 deviation counts as 1), and percentile by average ties."""
    w = Window.partitionBy("entity")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(F.desc("score"), "term"))
    deviation = F.stddev_pop("score").over(w)
    mean_rank = F.rank().over(w.orderBy("score")) + (F.count("*").over(Window.partitionBy("entity", "score")) - 1) / 2
    return rows.withColumns({"norm_rank": F.when(n > 1, (k - 1) / (n - 1)).otherwise(0.0), "z": (F.col("score") - F.avg("score").over(w)) / F.when(deviation > 1e-12, deviation).otherwise(1.0), "percentile": mean_rank / n, "top1": (k <= 1).cast("int"), "top3": (k <= 3).cast("int")})


def cap_groups(rows: DataFrame, group: Sequence[str], most: int, seed: str = "0") -> DataFrame:
    """At most `most` rows a group: positives first, then negatives by hash."""
    w = Window.partitionBy(*group).orderBy(F.desc("label"), hash_int(*group, "term", seed=seed), "term")
    return rows.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= most).drop("k_")


def thin_negatives(rows: DataFrame, ratio: float, group: Sequence[str], key: Sequence[str], seed: str = "0") -> DataFrame:
    """All positives, and of each group's negatives the ratio * positives least by hash."""
    w = Window.partitionBy(*group)
    order = Window.partitionBy(*group, "label").orderBy(hash_int(*key, seed=seed), *key)
    marked = rows.withColumns({"p_": F.sum("label").over(w), "k_": F.row_number().over(order)})
    return marked.where((F.col("label") == 1) | (F.col("k_") <= F.floor(F.col("p_") * ratio))).drop("p_", "k_")


def budget(rows: DataFrame, source: str, total: int, key: Sequence[str], seed: str = "0") -> DataFrame:
    """All positives, and negatives at one share for each source so that the whole is about `total` rows, equal room for
    each source: the share is a bound on the hash, so no source is ever ranked in one place."""
    counts = rows.groupBy(source).agg(F.sum("label").alias("p_"), F.sum(1 - F.col("label")).alias("n_"))
    n = counts.agg(F.count("*").alias("sources_"))
    room = F.greatest(F.lit(0.0), total / F.col("sources_") - F.col("p_"))
    share = counts.crossJoin(F.broadcast(n)).select(source, F.least(F.lit(1.0), room / F.greatest(F.col("n_"), F.lit(1))).alias("share_"))  # n is one row
    return rows.join(share, source).where((F.col("label") == 1) | (hash_int(*key, seed=seed) < F.col("share_") * 4294967296.0)).drop("share_")


def split(rows: DataFrame, share: float, column: str = "entity", seed: str = "0") -> DataFrame:
    """Adds validation (0/1): an entity's rows go together, by hash."""
    return rows.withColumn("validation", (hash_int(F.col(column).cast("string"), seed=seed) < share * 4294967296.0).cast("int"))


def temporal_split(rows: DataFrame, holdout) -> DataFrame:
    """Adds validation (0/1): rows of the held-out snapshot; one that no row has leaves it empty."""
    return rows.withColumn("validation", F.coalesce((F.col("snapshot") == holdout).cast("int"), F.lit(0)))


def folds(rows: DataFrame, k: int, column: str = "entity", seed: str = "0") -> DataFrame:
    return rows.withColumn("fold", (hash_int(F.col(column).cast("string"), seed=seed) % k).cast("int"))


def draw_k(rows: DataFrame, least: int, most: int, seed: str = "0") -> DataFrame:
    """Keeps rows whose stream is at most a k that each entity draws by hash between least and most."""
    return rows.withColumn("k", (least + hash_int(F.col("entity").cast("string"), seed=seed) % (most - least + 1)).cast("int")).where(F.col("stream") <= F.col("k"))


def stratified(rows: DataFrame, stratum: str, n: int, key: Sequence[str], seed: str = "0") -> DataFrame:
    """n rows of each stratum, the least by hash."""
    w = Window.partitionBy(stratum).orderBy(hash_int(*key, seed=seed), *key)
    return rows.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= n).drop("k_")


def pool_draw(rows: DataFrame, modulus: int, key: Sequence[str], seed: str = "0") -> DataFrame:
    return rows.where(hash_int(*key, seed=seed) % modulus == 0)


def tertiles(rows: DataFrame, value: str) -> DataFrame:
    """Adds tertile 0..2 by the exact thirds of value."""
    cut = rows.agg(F.expr(f"percentile({value}, array(1/3D, 2/3D))").alias("cut_"))
    t = F.when(F.col(value) <= F.col("cut_")[0], 0).when(F.col(value) <= F.col("cut_")[1], 1).otherwise(2)
    return rows.crossJoin(F.broadcast(cut)).withColumn("tertile", t).drop("cut_")  # cut is one row


def rank_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(entity, term, score): each entity's scores of a, given to the terms in b's order."""
    ra = a.select("entity", F.col("score"), F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "term")).alias("k"))
    rb = b.select("entity", "term", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "term")).alias("k"))
    return rb.join(ra, ["entity", "k"]).select("entity", "term", "score")


def permuted(rows: DataFrame, by: str, seed: str) -> DataFrame:
    """Scores shuffled within each group, by two hash orders."""
    own = rows.select(by, "entity", "term", F.row_number().over(Window.partitionBy(by).orderBy(hash_int("entity", "term", seed=seed), "entity", "term")).alias("k"))
    other = rows.select(by, "score", F.row_number().over(Window.partitionBy(by).orderBy(hash_int("entity", "term", seed=seed + "'"), "entity", "term")).alias("k"))
    return own.join(other, [by, "k"]).drop("k")


def sampling_audit(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Per group: rows and positives before and after, and the negatives' ratio after."""
    count = lambda d, s: d.groupBy(by).agg(F.count("*").alias(f"rows_{s}"), F.sum("label").alias(f"positives_{s}"))
    both = count(before, "before").join(count(after, "after"), by, "left").fillna(0)
    return both.withColumn("ratio", F.when(F.col("positives_after") > 0, (F.col("rows_after") - F.col("positives_after")) / F.col("positives_after")))
