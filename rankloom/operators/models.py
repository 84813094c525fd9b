"""Model-side operators on Spark ML: weights, calibration, a pointwise re-ranker, blend and threshold tuning, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fits, metrics
from .fusion import union_streams


def ia_weight(mode: str, scale: float = 1.0, label: str = "label") -> Column:
    """Sample weight 1 + scale * ia: for nobody, for positives, or for all; a term without ia weighs 1."""
    w = 1 + scale * F.coalesce("ia", F.lit(0.0))
    return {"none": F.lit(1.0), "positives": F.when(F.col(label) == 1, w).otherwise(1.0), "all": w}[mode]


def calibrate(rows: DataFrame, by: str, least: int = 50, weight: str | None = None, method: str = "isotonic") -> DataFrame:
    """Adds calibrated: isotonic regression of label on score, by steps of a thousandth of [0, 1], or Platt's logistic curve,
    within each group; the score itself where a group has under `least` rows or one class. All groups are fitted at once."""
    if method == "platt":
        model = fits.fit_logistic(rows, [by], ["score"], weight=weight, least=least)
        return model.apply(rows, "all", "calibrated").withColumn("calibrated", F.coalesce("calibrated", F.col("score").cast("double"))).select(*rows.columns, "calibrated")
    return fits.apply_curves(rows, fits.isotonic_curves(rows, [by], weight, least=least), [by]).select(*rows.columns, "calibrated")


def calibration_stats(calibrated: DataFrame, by: str) -> DataFrame:
    """(by, n, positives, brier_before, brier_after, mean_before, mean_after)."""
    square = lambda c: F.avg((F.col(c) - F.col("label")) ** 2)
    return calibrated.groupBy(by).agg(F.count("*").alias("n"), F.sum("label").alias("positives"), square("score").alias("brier_before"), square("calibrated").alias("brier_after"), F.avg("score").alias("mean_before"), F.avg("calibrated").alias("mean_after"))


def tercile_calibrate(rows: DataFrame, frequency: DataFrame, weight: str, least: int = 50) -> DataFrame:
    """Adds tercile (0 rare to 2 common, by frequency(term, n) over terms) and calibrated: weighted isotonic regression within
    the tercile of a row's term, over all rows where the tercile has under `least` of them or one class."""
    cut = frequency.agg(F.percentile_approx("n", F.array(F.lit(1 / 3), F.lit(2 / 3)), 100_000).alias("c")).first().c or [0, 0]
    binned = rows.join(frequency.select("term", "n"), "term", "left").withColumn("tercile", (F.coalesce("n", F.lit(0)) > cut[0]).cast("int") + (F.coalesce("n", F.lit(0)) > cut[1]).cast("int")).drop("n")
    whole = fits.isotonic_curves(binned.withColumn("all_", F.lit(0)), ["all_"], weight).select(F.col("curve").alias("whole_"))
    curves = fits.isotonic_curves(binned, ["tercile"], weight, least=least).join(F.broadcast(whole))  # one row
    return fits.apply_curves(binned, curves.withColumn("curve", F.coalesce("curve", "whole_")), ["tercile"])


def binned_calibrators(rows: DataFrame, by: str, bins: int = 10) -> DataFrame:
    """(by, xs, ys): for each group the middles of the score bins that have rows, ascending, and their positive rates."""
    means = rows.groupBy(by, metrics.bin_of(F.col("score"), bins).alias("b")).agg(F.avg("label").alias("y"))
    points = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(((F.col("b") + 0.5) / bins).alias("x"), "y"))).alias("p"))
    return points.select(by, F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))


def apply_calibrators(rows: DataFrame, calibrators: DataFrame, by: str) -> DataFrame:
    """Adds calibrated by stored calibrators(by, xs, ys): linear between the points, level beyond them; the score itself in a
    group that has none, and null for a null score."""
    joined = rows.join(calibrators, by, "left")
    k = "size(filter(xs, x -> x <= score))"
    line = f"""case when score is null or xs is null or size(xs) = 0 then double(score) when {k} = 0 then ys[0] when {k} = size(xs) then ys[size(xs) - 1]
        else ys[{k} - 1] + (score - xs[{k} - 1]) / (xs[{k}] - xs[{k} - 1]) * (ys[{k}] - ys[{k} - 1]) end"""
    return joined.withColumn("calibrated", F.expr(line)).drop("xs", "ys")


def selective_submission(rows: DataFrame, tune: Column, thresholds: int = 50) -> DataFrame:
    """(threshold, kept, precision, f_tune, f_blind): on the tuning rows(score, label) the cut with the best F, the share of
    rows that it keeps and their precision; then F once, at that cut, on the blind rows."""
    bins = rows.groupBy(tune.alias("tune"), metrics.bin_of(F.col("score"), thresholds).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    w = Window.partitionBy("tune")
    down = w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each threshold and half
    swept = bins.select("tune", "bin", F.sum("n").over(down).alias("n"), F.sum("y").over(down).alias("tp"), F.sum("n").over(w).alias("rows"), F.sum("y").over(w).alias("all"))
    f = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n") + F.col("all"))).otherwise(0.0)
    best = swept.where("tune").agg(F.max(F.struct(f.alias("f"), "bin", (F.col("n") / F.col("rows")).alias("kept"), (F.col("tp") / F.col("n")).alias("precision"))).alias("b")).select("b.*")
    blind = bins.where("not tune").crossJoin(F.broadcast(best.select(F.col("bin").alias("cut"))))  # one row
    hit = F.col("bin") >= F.col("cut")
    score = blind.agg(F.sum(F.when(hit, F.col("y")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n"), F.sum("y").alias("all"))
    return best.crossJoin(F.broadcast(score.select(f.alias("f_blind")))).select((F.col("bin") / thresholds).alias("threshold"), "kept", "precision", F.col("f").alias("f_tune"), "f_blind")


def _assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as a vector: a missing value is 0.0, and a second column tells that it is missing."""
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    filled = rows.select("*", *[F.coalesce(v, F.lit(0.0)).alias(f"f_{c}") for c, v in value.items()], *[v.isNull().cast("double").alias(f"missing_{c}") for c, v in value.items()])
    return VectorAssembler(inputCols=[f"{p}_{c}" for p in ("f", "missing") for c in features], outputCol="features").transform(filled)


def rerank(train: DataFrame, test: DataFrame, features: Sequence[str], weight: str | None = None, trees: int = 20, depth: int = 4, seed: int = 7) -> tuple[DataFrame, float]:
    """A boosted pointwise re-ranker: test with score `reranked`, and its area under the ROC curve."""
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {})).fit(_assembled(train, features))
    scored = model.transform(_assembled(test, features)).withColumn("reranked", vector_to_array("probability")[1])
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="reranked").evaluate(scored)
    return scored.select(*test.columns, "reranked"), auc


def tune_blend(a: DataFrame, b: DataFrame, truth: DataFrame, weights: Sequence[float], cell: str, cells: DataFrame, thresholds: int = 50) -> DataFrame:
    """(cell, weight, f): the noisy-or weight with the best F in each cell. cells(entity, cell)."""
    spark = a.sparkSession
    u = union_streams({"a": a, "b": b}).join(cells, "entity").join(truth.select("entity", "term").distinct().withColumn("y", F.lit(1)), ["entity", "term"], "left")
    grid = spark.createDataFrame([(float(w),) for w in weights], "weight double")
    scored = u.crossJoin(F.broadcast(grid)).select(cell, "weight", metrics.bin_of(1 - (1 - F.col("a")) * (1 - F.col("weight") * F.col("b")), thresholds).alias("bin"), F.coalesce("y", F.lit(0)).alias("y"))  # the grid is a parameter
    bins = scored.groupBy(cell, "weight", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    w = Window.partitionBy(cell, "weight")
    down = w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    swept = bins.select(cell, "weight", F.sum("n").over(down).alias("n"), F.sum("y").over(down).alias("tp"), F.sum("y").over(w).alias("all"))
    f = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n") + F.col("all"))).otherwise(0.0)
    best = swept.groupBy(cell, "weight").agg(F.max(f).alias("f"))
    return best.groupBy(cell).agg(F.max(F.struct("f", (-F.col("weight")).alias("w"))).alias("b")).select(cell, (-F.col("b.w")).alias("weight"), F.col("b.f").alias("f"))


def cross_fitted(rows: DataFrame, thresholds: int = 50) -> DataFrame:
    """rows(fold, score, label): per fold the threshold that is best on the other folds, and its F on this one."""
    bins = rows.groupBy("fold", metrics.bin_of(F.col("score"), thresholds).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    grid = rows.sparkSession.range(thresholds + 1).select(F.col("id").cast("int").alias("bin"))
    folds = bins.select("fold").distinct()
    full = folds.crossJoin(F.broadcast(grid)).join(bins, ["fold", "bin"], "left").fillna(0, ["n", "y"])  # the grid is a parameter
    down = Window.partitionBy("fold").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    own = full.select("fold", "bin", F.sum("n").over(down).alias("n"), F.sum("y").over(down).alias("tp"), F.sum("y").over(Window.partitionBy("fold")).alias("all"))
    total = own.groupBy("bin").agg(*[F.sum(c).alias(f"{c}_") for c in ("n", "tp", "all")])
    f = lambda tp, n, all_: F.when(tp > 0, 2 * tp / (n + all_)).otherwise(0.0)
    both = own.join(total, "bin").select("fold", "bin", f(F.col("tp_") - F.col("tp"), F.col("n_") - F.col("n"), F.col("all_") - F.col("all")).alias("others"), f(F.col("tp"), F.col("n"), F.col("all")).alias("f"))
    best = both.groupBy("fold").agg(F.max(F.struct("others", "bin", "f")).alias("b"))
    return best.select("fold", (F.col("b.bin") / thresholds).alias("threshold"), F.col("b.others").alias("f_others"), F.col("b.f").alias("f"))


def out_of_fold(rows: DataFrame, features: Sequence[str], folds: int) -> DataFrame:
    """rows(fold, label, ...) with out_of_fold: a standardised, class-balanced logistic model trained on the other folds."""
    data = _assembled(rows, features)
    out = None
    for k in range(folds):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        share = train.agg(F.avg("label")).first()[0] or 0.0
        train = train.withColumn("w_", F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
        model = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="w_", maxIter=50).fit(scaler.transform(train))
        part = model.transform(scaler.transform(test)).select(*rows.columns, vector_to_array("probability")[1].alias("out_of_fold"))
        out = part if out is None else out.unionByName(part)
    return out


def strategy_gate(results: DataFrame, baseline: str, cell: str = "cell") -> DataFrame:
    """results(cell, fold, arm, f): per cell and held-out fold the arm that is best on the other folds, and the gate: all folds
    choose one arm, its mean gain over the baseline exceeds the gains' deviation, and 8 in 10 gains are positive."""
    w = Window.partitionBy(cell, "arm")
    others = results.withColumn("rest", F.sum("f").over(w) - F.col("f"))
    chosen = others.groupBy(cell, "fold").agg(F.max(F.struct("rest", "arm", "f")).alias("b"), F.max(F.when(F.col("arm") == baseline, F.col("f"))).alias("base"))
    gain = F.col("b.f") - F.col("base")
    per = chosen.groupBy(cell).agg(F.countDistinct("b.arm").alias("arms"), F.first("b.arm").alias("arm"), F.avg(gain).alias("gain"), F.stddev_samp(gain).alias("deviation"), F.avg((gain > 0).cast("double")).alias("positive"))
    return per.withColumn("passes", (F.col("arms") == 1) & (F.col("gain") > F.coalesce("deviation", F.lit(0.0))) & (F.col("positive") >= 0.8))


def principal_axes(rows: DataFrame, vector: str, k: int, fit_on: Column | None = None) -> DataFrame:
    """rows with projected: principal axes learned on the rows that fit_on picks (all by default), centred on their mean."""
    data = rows.withColumn("v_", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    basis = data if fit_on is None else data.where(fit_on)
    scaler = StandardScaler(inputCol="v_", outputCol="c_", withMean=True, withStd=False).fit(basis)
    pca = PCA(k=k, inputCol="c_", outputCol="p_").fit(scaler.transform(basis))
    return pca.transform(scaler.transform(data)).withColumn("projected", vector_to_array("p_")).drop("v_", "c_", "p_")
