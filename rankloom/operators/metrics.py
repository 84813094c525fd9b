"""Ranking and evaluation metrics over (entity, term, score) and truth, as histograms and windows.

Threshold metrics reduce each entity's predictions to one row for each score bin before anything is swept, so the sweep
handles entities * thresholds rows whatever the number of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.steps import before


def bin_of(score: Column, thresholds: int) -> Column:
    """The last of the thresholds k / n, k = 0..n, that a score in 0..1 reaches."""
    return F.least(F.lit(thresholds), F.greatest(F.lit(0), F.floor(score * thresholds))).cast("int")


def per_entity_bins(predictions: DataFrame, truth: DataFrame, weights: DataFrame | None, thresholds: int) -> tuple[DataFrame, DataFrame]:
    """((entity, bin, predicted, right) as sums of weights, (entity, wanted)). weights(term, ia); None weighs 1; a term
    without a weight weighs 0."""
    true = truth.select("entity", "term").distinct().withColumn("y", F.lit(1))
    rows = predictions.select("entity", "term", "score").join(true, ["entity", "term"], "left")
    w = F.lit(1.0)
    if weights is not None:
        rows, w = rows.join(weights, "term", "left"), F.coalesce("ia", F.lit(0.0))
    bins = rows.groupBy("entity", bin_of(F.col("score"), thresholds).alias("bin")).agg(F.sum(w).alias("predicted"), F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("right"))
    want = true if weights is None else true.join(weights, "term", "left")
    return bins, want.groupBy("entity").agg(F.sum(w).alias("wanted"))


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def micro_f_curve(predictions: DataFrame, truth: DataFrame, weights: DataFrame | None = None, thresholds: int = 50) -> DataFrame:
    """(bin, threshold, precision, recall, f): weights pooled over all entities, predictions at or above each threshold."""
    bins, wanted = per_entity_bins(predictions, truth, weights, thresholds)
    return swept_curve(bins, wanted, thresholds)


def swept_curve(bins: DataFrame, wanted: DataFrame, thresholds: int) -> DataFrame:
    """micro_f_curve() of sums in parts: bins(bin, predicted, right), wanted(wanted)."""
    all_ = wanted.agg(F.sum("wanted").alias("all_wanted"))
    pooled = bins.groupBy("bin").agg(F.sum("predicted").alias("predicted"), F.sum("right").alias("right"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each threshold
    swept = pooled.select("bin", F.sum("predicted").over(above).alias("tpfp"), F.sum("right").over(above).alias("tp")).crossJoin(F.broadcast(all_))  # all_ is one row
    p, r = F.when(F.col("tpfp") > 0, F.col("tp") / F.col("tpfp")).otherwise(0.0), F.when(F.col("all_wanted") > 0, F.col("tp") / F.col("all_wanted")).otherwise(0.0)
    return swept.select("bin", (F.col("bin") / thresholds).alias("threshold"), p.alias("precision"), r.alias("recall"), f_score(p, r).alias("f"))


def best(curve: DataFrame) -> DataFrame:
    """The curve's row with the largest f; ties take the largest threshold."""
    return curve.orderBy(F.desc("f"), F.desc("bin")).limit(1)


def fmax_curve(predictions: DataFrame, truth: DataFrame, thresholds: int = 50) -> DataFrame:
    """(bin, threshold, precision, recall, f) averaged over entities: precision over those that predict at the threshold,
    recall over those with a positive."""
    bins, wanted = per_entity_bins(predictions, truth, None, thresholds)
    above = Window.partitionBy("entity").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("entity").orderBy(F.desc("bin"))
    runs = bins.select("entity", "bin", F.sum("predicted").over(above).alias("n"), F.sum("right").over(above).alias("tp"), F.lead("bin").over(below).alias("next"))
    runs = runs.join(wanted, "entity", "left")
    # a run holds from its own bin down to just above the entity's next one; its ends carry the change in the sums
    p, r = F.col("tp") / F.col("n"), F.coalesce(F.col("tp") / F.col("wanted"), F.lit(0.0))
    change = runs.select(F.explode(F.array(F.struct(F.col("bin").alias("bin"), p.alias("p"), r.alias("r"), F.lit(1).alias("k")), F.struct(F.col("next").alias("bin"), (-p).alias("p"), (-r).alias("r"), F.lit(-1).alias("k")))).alias("c")).select("c.*").where("bin is not null").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("k").alias("k"))
    n = wanted.agg(F.count("*").alias("n_true"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each threshold
    swept = change.select("bin", F.sum("p").over(down).alias("p"), F.sum("r").over(down).alias("r"), F.sum("k").over(down).alias("k")).crossJoin(F.broadcast(n))  # n is one row
    mp, mr = F.when(F.col("k") > 0, F.col("p") / F.col("k")).otherwise(0.0), F.when(F.col("n_true") > 0, F.col("r") / F.col("n_true")).otherwise(0.0)
    return swept.select("bin", (F.col("bin") / thresholds).alias("threshold"), mp.alias("precision"), mr.alias("recall"), f_score(mp, mr).alias("f"))


def flat_f_curve(rows: DataFrame, thresholds: int = 50, weight: Column | None = None) -> DataFrame:
    """Binary F over rows(score, label) at thresholds k / n, optionally weighted."""
    w = F.lit(1.0) if weight is None else weight
    bins = rows.groupBy(bin_of(F.col("score"), thresholds).alias("bin")).agg(F.sum(w).alias("n"), F.sum(w * F.col("label")).alias("y"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each threshold
    swept = bins.select("bin", F.sum("n").over(down).alias("n"), F.sum("y").over(down).alias("tp"), F.sum("y").over(Window.partitionBy()).alias("all"))
    p, r = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0)
    return swept.select("bin", p.alias("precision"), r.alias("recall"), f_score(p, r).alias("f"))


def group_weighted_curve(rows: DataFrame, weights: DataFrame, thresholds: int = 51) -> DataFrame:
    """F whose precision and recall are means over entities weighted by the mean ia of an entity's rows(entity, term, score, label)."""
    n = thresholds - 1
    w = rows.join(weights, "term", "left").groupBy("entity").agg(F.avg(F.coalesce("ia", F.lit(0.0))).alias("w"), F.sum("label").alias("all"))
    bins = rows.groupBy("entity", bin_of(F.col("score"), n).alias("bin")).agg(F.count("*").alias("k"), F.sum("label").alias("y"))
    above = Window.partitionBy("entity").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    runs = bins.select("entity", "bin", F.sum("k").over(above).alias("k"), F.sum("y").over(above).alias("tp"), F.lead("bin").over(Window.partitionBy("entity").orderBy(F.desc("bin"))).alias("next")).join(w, "entity")
    p, r = F.col("w") * F.col("tp") / F.col("k"), F.when(F.col("all") > 0, F.col("w") * F.col("tp") / F.col("all")).otherwise(0.0)
    ends = [F.struct(F.col(c).alias("bin"), (s * p).alias("p"), (s * r).alias("r"), (s * F.col("w")).alias("w")) for c, s in (("bin", 1), ("next", -1))]
    change = runs.select(F.explode(F.array(*ends)).alias("c")).select("c.*").where("bin is not null").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("w").alias("w"))
    total = w.agg(F.sum(F.when(F.col("all") > 0, F.col("w")).otherwise(0.0)).alias("total"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each threshold
    swept = change.select("bin", F.sum("p").over(down).alias("p"), F.sum("r").over(down).alias("r"), F.sum("w").over(down).alias("w")).crossJoin(F.broadcast(total))  # total is one row
    mp, mr = F.when(F.col("w") > 0, F.col("p") / F.col("w")).otherwise(0.0), F.when(F.col("total") > 0, F.col("r") / F.col("total")).otherwise(0.0)
    return swept.select("bin", mp.alias("precision"), mr.alias("recall"), f_score(mp, mr).alias("f"))


def term_metrics(rows: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per term over rows(entity, term, score, label): n, positives, p_at_k, r_precision, average precision, auc."""
    by = Window.partitionBy("term")
    order = by.orderBy(F.desc("score"), "entity")
    hits = rows.select("term", "label", "score", F.row_number().over(order).alias("k"), F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"), F.sum("label").over(by).alias("pos"), F.rank().over(by.orderBy("score")).alias("low"), F.count("*").over(by.partitionBy("term", "score")).alias("ties"))
    mean_rank = F.col("low") + (F.col("ties") - 1) / 2
    n, pos = F.count("*"), F.sum("label")
    auc = (F.sum(F.when(F.col("label") == 1, mean_rank).otherwise(0.0)) - pos * (pos + 1) / 2) / (pos * (n - pos))
    return hits.groupBy("term").agg(
        n.alias("n"), pos.alias("positives"), *[(F.sum(F.when(F.col("k") <= c, F.col("label")).otherwise(0)) / F.least(F.lit(c), n)).alias(f"p_at_{c}") for c in cuts],
        F.when(pos > 0, F.sum(F.when(F.col("k") <= F.col("pos"), F.col("label")).otherwise(0)) / pos).alias("r_precision"),
        F.when(pos > 0, F.sum(F.when(F.col("label") == 1, F.col("tp") / F.col("k")).otherwise(0.0)) / pos).alias("ap"),
        F.when((pos > 0) & (pos < n), auc).alias("auc"),
    )


def auroc(rows: DataFrame) -> DataFrame:
    """(n, covered, auc) over all rows(score, label): ties get their average rank, null and NaN scores are not covered. Ranks come
    from counts by distinct score, swept once."""
    fine = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double"))
    steps = rows.where(fine).groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    ranked = before(steps, "score", "n", "below").select("n", "y", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))
    s = ranked.agg(F.sum("n").alias("covered"), F.sum("y").alias("pos"), F.sum(F.col("y") * F.col("rank")).alias("ranks"))
    pos, neg = F.col("pos"), F.col("covered") - F.col("pos")
    return s.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("n", "covered", F.when((pos > 0) & (neg > 0), (F.col("ranks") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))  # one row each


def mean_average_precision(rows: DataFrame) -> DataFrame:
    """Mean over entities with a positive of average precision; ties go by term."""
    order = Window.partitionBy("entity").orderBy(F.desc("score"), "term")
    hits = rows.select("entity", "label", F.row_number().over(order).alias("k"), F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"))
    ap = hits.where("label = 1").groupBy("entity").agg(F.avg(F.col("tp") / F.col("k")).alias("ap"))
    return ap.agg(F.count("*").alias("entities"), F.avg("ap").alias("map"))


def spearman(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Per group: rank correlation with averaged ties, the share of tied rows in b, distinct values of b."""
    rank = lambda c: F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2
    ranked = rows.select(by, rank(a).alias("ra"), rank(b).alias("rb"), (F.count("*").over(Window.partitionBy(by, b)) > 1).cast("double").alias("tied"), F.col(b).alias("b"))
    return ranked.groupBy(by).agg(F.corr("ra", "rb").alias("rho"), F.avg("tied").alias("tied_share"), F.countDistinct("b").alias("distinct_b"))


def recall_at(rows: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean over entities with truth of the share of their terms among their top k."""
    top = rows.select("entity", "term", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "term")).alias("k")).where(F.col("k") <= k)
    true = truth.select("entity", "term").distinct()
    hit = true.join(top.select("entity", "term").distinct().withColumn("hit", F.lit(1)), ["entity", "term"], "left")
    return hit.groupBy("entity").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).agg(F.count("*").alias("entities"), F.avg("r").alias("recall"))


def entity_fmax(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Per entity: the best weighted F over a cut after each of its ranked rows(entity, term, score, label)."""
    order = Window.partitionBy("entity").orderBy(F.desc("score"), "term").rowsBetween(Window.unboundedPreceding, 0)
    w = F.coalesce("ia", F.lit(0.0))
    swept = rows.join(weights, "term", "left").select("entity", F.sum(w).over(order).alias("n"), F.sum(w * F.col("label")).over(order).alias("tp"), F.sum(w * F.col("label")).over(Window.partitionBy("entity")).alias("all"))
    p, r = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0)
    return swept.groupBy("entity").agg(F.max(f_score(p, r)).alias("fmax"))


def oracle_scores(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """rows with score 1 for true terms and 0 for others: the ceiling of a candidate pool under any metric."""
    true = truth.select("entity", "term").distinct().withColumn("y", F.lit(1.0))
    return rows.drop("score").join(true, ["entity", "term"], "left").withColumn("score", F.coalesce("y", F.lit(0.0))).drop("y")
