"""Many small fits in one job: isotonic curves and logistic models of all groups of a table at once.

A group's rows never meet in one task. Isotonic curves need one row for each group and score bin; logistic models need, each
round, the gradient and Hessian that every task adds up for every model, summed in a shuffle. What the driver holds is one
coefficient vector a model, bounded by MOST_FITS."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.steps import materialise

from .metrics import bin_of

BINS = 1_000
MOST_FITS = 20_000  # groups times arms; what the driver solves each round
_BROADCAST = 64 << 20  # bytes of coefficients or curves that may go to every task


def pooled(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y in weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # weight, weighted sum, length
    for one_w, one_y in zip(w.tolist(), y.tolist(), strict=True):
        blocks.append([one_w, one_w * one_y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.repeat([b[1] / b[0] for b in blocks], [int(b[2]) for b in blocks])


def _table(rows: DataFrame, groups: int, size: int) -> DataFrame:
    """rows, marked for broadcast where its counted groups times their size are small; else joined as any table."""
    return F.broadcast(rows) if groups * size <= _BROADCAST else rows


def _matched(rows: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with other's columns where the group columns agree; null is a group."""
    renamed = other.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in other.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & rows[c].eqNullSafe(F.col(f"_{c}"))
    return rows.join(renamed, on, "left").drop(*[f"_{c}" for c in by])


def isotonic_curves(rows: DataFrame, by: Sequence[str], weight: str | None = None, bins: int = BINS, least: int = 1, score: str = "score", label: str = "label") -> DataFrame:
    """(by..., n, positives, curve): the isotonic regression of label on score in each group, as one value for each of bins + 1
    score bins of [0, 1]; bins without rows lie on the line between their neighbours. A group of under `least` rows or of one
    class has a null curve. One aggregate by group and bin, combined before the shuffle; a group is then `bins` rows."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    kept = rows.where(x.isNotNull() & ~F.isnan(x) & y.isNotNull())
    points = kept.groupBy(*by, bin_of(x, bins).alias("bin_")).agg(F.sum(w).alias("w_"), F.sum(w * y).alias("wy_"), F.sum(w * x).alias("wx_"), F.count("*").alias("n_"), F.sum(y).alias("y_"))
    fields = [f for f in rows.schema if f.name in by]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: list(by).index(f.name))] + ["n long", "positives double", "curve array<double>"])

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("bin_").to_numpy())
        bin_, w_, wy, wx, n, ys = (table.column(c).to_numpy()[order] for c in ("bin_", "w_", "wy_", "wx_", "n_", "y_"))
        curve, some = None, w_ > 0
        if n.sum() >= least and 0 < ys.sum() < n.sum() and some.any():
            fitted = pooled(wy[some] / w_[some], w_[some])
            curve = np.interp((np.arange(bins + 1) + 0.5) / bins, wx[some] / w_[some], fitted)
            curve[bin_[some]] = fitted
        key = {c: table.column(c)[:1] for c in by}
        return pa.table(key | {"n": pa.array([int(n.sum())]), "positives": pa.array([float(ys.sum())]), "curve": pa.array([None if curve is None else curve.tolist()], pa.list_(pa.float64()))})

    return points.groupBy(*by).applyInArrow(fit, kinds)


def apply_curves(rows: DataFrame, curves: DataFrame, by: Sequence[str], bins: int = BINS, score: str = "score") -> DataFrame:
    """Adds calibrated: the curve's value at the score; the score itself where the group has no curve."""
    curves = materialise(curves.select(*by, "curve"), "curves")
    own = F.get("curve", bin_of(F.col(score).cast("double"), bins))
    joined = _matched(rows, _table(curves, curves.count(), 8 * (bins + 1)), by)
    return joined.withColumn("calibrated", F.coalesce(F.when(F.col("curve").isNotNull() & ~F.isnan(F.col(score).cast("double")), own), F.col(score).cast("double"))).drop("curve")


class GroupedLogistic:
    """Logistic models of one table: for each group and each arm (a choice of features) an intercept and weights of
    standardised features and of their being missing."""

    def __init__(self, by: list[str], features: list[str], arms: dict[str, list[str]], keys: list[tuple], mean: np.ndarray, deviation: np.ndarray, missing: np.ndarray, beta: np.ndarray, kinds: list[str]):
        self.by, self.features, self.arms, self.keys, self.mean, self.deviation, self.missing, self.beta, self.kinds = by, features, arms, keys, mean, deviation, missing, beta, kinds

    def columns(self, x: np.ndarray, group: int) -> np.ndarray:
        """Rows of raw features (missing: NaN) as standardised columns behind a one; a missing value stands at the mean."""
        gone = np.isnan(x)
        z = np.where(gone, 0.0, x - self.mean[group]) / np.where(self.deviation[group] > 0, self.deviation[group], np.inf)
        share = self.missing[group]
        return np.concatenate([np.ones((len(x), 1)), z, np.where((share > 0) & (share < 1), gone - share, 0.0)], axis=1)

    def active(self) -> np.ndarray:
        """(arms, columns): which columns an arm may use."""
        own = np.array([[f in used for f in self.features] for used in self.arms.values()])
        return np.concatenate([np.ones((len(own), 1), bool), own, own], axis=1)

    def scores(self, x: np.ndarray, group: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.columns(x, group) @ self.beta[group].T, -500, 500)))

    def numbered(self, rows: DataFrame) -> DataFrame:
        """rows with group_, their group's number; null where the fit has not seen it."""
        spark = rows.sparkSession
        table = spark.createDataFrame([(*k, i) for i, k in enumerate(self.keys)], ", ".join([f"`{c}` {t}" for c, t in zip(self.by, self.kinds, strict=True)] + ["group_ int"]))
        return _matched(rows, F.broadcast(table), self.by)  # at most MOST_FITS rows

    def apply(self, rows: DataFrame, arm: str, out: str) -> DataFrame:
        """Adds `out`, the probability by an arm's model, as one expression; null in a group without a model."""
        a = list(self.arms).index(arm)
        whole = [(i, [self.beta[i, a, 0], *(self.beta[i, a, 1:] * np.concatenate([np.where(self.deviation[i] > 0, 1 / np.where(self.deviation[i] > 0, self.deviation[i], 1), 0), ((self.missing[i] > 0) & (self.missing[i] < 1)).astype(float)]))]) for i in range(len(self.keys))]
        facts = rows.sparkSession.createDataFrame([(i, [float(v) for v in b], self.mean[i].tolist(), self.missing[i].tolist()) for i, b in whole], "group_ int, b_ array<double>, mean_ array<double>, missing_ array<double>")
        joined = self.numbered(rows).join(F.broadcast(facts), "group_", "left")  # a row a group
        k, total = len(self.features), F.get("b_", F.lit(0))
        for j, f in enumerate(self.features):
            v = F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
            total = total + F.coalesce((v - F.get("mean_", F.lit(j))) * F.get("b_", F.lit(1 + j)), F.lit(0.0)) + (v.isNull().cast("double") - F.get("missing_", F.lit(j))) * F.get("b_", F.lit(1 + k + j))
        return joined.withColumn(out, 1 / (1 + F.exp(-total))).drop("group_", "b_", "mean_", "missing_")


def _numbers(rows: DataFrame, features: Sequence[str], *more: Column) -> DataFrame:
    values = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    return rows.select(*more, F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in values]).alias("x"))


def _x(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, k)


def _summed(found: DataFrame, *by: str) -> DataFrame:
    return found.select(*by, F.posexplode("s").alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))


def fit_logistic(rows: DataFrame, by: Sequence[str], features: Sequence[str], arms: Mapping[str, Sequence[str]] | None = None, weight: str | None = None, balanced: bool = False, ridge: float = 1e-9, rounds: int = 40, least: int = 1, label: str = "label") -> GroupedLogistic:
    """Logistic models by Newton's method, for all groups of `by` and all arms at once: a round is one pass over the rows, which
    adds up each model's gradient and Hessian map-side. Groups of under `least` rows or one class get no model. Steps that
    lose likelihood are halved, so separable groups end at `rounds` with a steep curve. `balanced` weighs classes equally."""
    by, features = list(by), list(features)
    arms = {"all": features} if arms is None else {name: list(used) for name, used in arms.items()}
    y = F.col(label).cast("double")
    values = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    facts = rows.groupBy(*by).agg(F.count("*").alias("n_"), F.sum(y).alias("y_"), *[a for i, v in enumerate(values.values()) for a in (F.avg(v).alias(f"m{i}_"), F.stddev_pop(v).alias(f"s{i}_"), F.avg(v.isNull().cast("double")).alias(f"g{i}_"))])
    found = facts.where((F.col("n_") >= least) & (F.col("y_") > 0) & (F.col("y_") < F.col("n_"))).limit(MOST_FITS // len(arms) + 1).collect()
    if len(found) * len(arms) > MOST_FITS:
        raise ValueError(f"over {MOST_FITS} models; fit by something coarser")
    get = lambda p: np.array([[r[f"{p}{i}_"] or 0.0 for i in range(len(features))] for r in found]).reshape(len(found), len(features))
    k = 1 + 2 * len(features)
    model = GroupedLogistic(by, features, arms, [tuple(r[c] for c in by) for r in found], get("m"), get("s"), get("g"), np.zeros((len(found), len(arms), k)), [rows.schema[c].dataType.simpleString() for c in by])
    if not found:
        return model
    shares = np.array([r.y_ / r.n_ for r in found])
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    known = model.numbered(rows).where("group_ is not null")
    data = materialise(_numbers(known, features, F.col("group_"), y.alias("y"), w.alias("w")), "fit")
    active, step = model.active(), np.zeros_like(model.beta)
    last, done = np.full(model.beta.shape[:2], -np.inf), np.zeros(model.beta.shape[:2], bool)
    for _ in range(rounds):

        def sums(batches, model=model, done=done):
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                group, ys, ws, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _x(b.column(3), len(features))
                for g in np.unique(group):
                    at = group == g
                    z, t = model.columns(x[at], g), ys[at]
                    u = ws[at] * (np.where(t > 0, 0.5 / shares[g], 0.5 / (1 - shares[g])) if balanced else 1.0)
                    for a in np.nonzero(~done[g])[0]:
                        eta = np.clip(z @ model.beta[g, a], -500, 500)
                        p = 1 / (1 + np.exp(-eta))
                        part = np.concatenate([[(u * (t * eta - np.logaddexp(0, eta))).sum()], z.T @ (u * (t - p)), (z.T @ (z * (u * p * (1 - p))[:, None])).ravel()])
                        total[g, a] = total[g, a] + part if (g, a) in total else part
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in total], pa.int32()), pa.array([a for _, a in total], pa.int32()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], names=["group", "arm", "s"])

        got = _summed(data.mapInArrow(sums, "group int, arm int, s array<double>"), "group", "arm").toArrow()  # k * k + k + 1 numbers a model
        s = np.zeros((*model.beta.shape[:2], 1 + k + k * k))
        s[got.column("group").to_numpy(), got.column("arm").to_numpy(), got.column("i").to_numpy()] = got.column("v").to_numpy()
        for g, a in zip(*np.nonzero(~done), strict=True):
            on, beta = active[a], model.beta[g, a]
            held = np.r_[0.0, np.full(k - 1, ridge)] * found[g].n_
            value = s[g, a, 0] - 0.5 * (held * beta * beta).sum()
            if value < last[g, a] - 1e-12 * abs(last[g, a]) and np.abs(step[g, a]).max() > 1e-12:
                step[g, a] /= 2
                model.beta[g, a] = beta - step[g, a]
                continue
            gradient, hessian = s[g, a, 1 : 1 + k] - held * beta, s[g, a, 1 + k :].reshape(k, k) + np.diag(held)
            move = np.zeros(k)
            live = on & (np.diag(hessian) > 1e-12 * found[g].n_)  # a column that never varies keeps weight 0
            live[0] = True
            move[live] = np.linalg.lstsq(hessian[np.ix_(live, live)], gradient[live], rcond=1e-13)[0]
            done[g, a] = np.abs(move).max() < 1e-10
            last[g, a], step[g, a], model.beta[g, a] = value, move, beta + move
        if done.all():
            break
    return model


def family_ablation(train: DataFrame, test: DataFrame, cell: Sequence[str], families: Mapping[str, Sequence[str]], bins: int = BINS, **how) -> DataFrame:
    """(cell..., family, auc, loss): in each cell, the area under the ROC curve on test of the model without a family, and how
    much it loses against the full one, which is family 'none'. All cells and families are fitted in the same passes, and
    scored in one, whose tasks return counts by score bin. Cells without both classes in train or test are left out."""
    every = list(dict.fromkeys(c for f in families.values() for c in f))
    arms = {"none": every} | {name: [c for c in every if c not in gone] for name, gone in families.items()}
    model = fit_logistic(train, cell, every, arms, **how)
    spark, names = train.sparkSession, list(arms)
    data = _numbers(model.numbered(test).where("group_ is not null"), every, F.col("group_"), F.col("label").cast("int").alias("y"))

    def counted(batches):
        total = np.zeros((len(model.keys), len(names), bins + 1, 2), np.int64)
        for b in batches:
            group, ys, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _x(b.column(2), len(every))
            for g in np.unique(group):
                at = group == g
                place = np.clip((model.scores(x[at], g) * bins).astype(int), 0, bins)
                for a in range(len(names)):
                    np.add.at(total[g, a], (place[:, a], ys[at]), 1)
        g, a, i = np.nonzero(total.any(axis=3))
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (g, a, i)] + [pa.array(total[g, a, i, c]) for c in (0, 1)], names=["group", "arm", "bin", "n0", "n1"])

    per = data.mapInArrow(counted, "group int, arm int, bin int, n0 long, n1 long").groupBy("group", "arm", "bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    below, whole = "sum(n0) over (partition by `group`, arm order by bin rows between unbounded preceding and current row)", "sum({}) over (partition by `group`, arm)"
    swept = per.selectExpr("group", "arm", f"n1 * ({below} - n0 / 2) as won", f"{whole.format('n0')} as all0", f"{whole.format('n1')} as all1")  # bins + 1 rows a model
    auc = swept.groupBy("group", "arm").agg((F.sum("won") / F.first("all0") / F.first("all1")).alias("auc")) if model.keys else swept.selectExpr("group", "arm", "won as auc")
    auc = auc.where("auc is not null")
    full = auc.where("arm = 0").select("group", F.col("auc").alias("full_"))
    labels = spark.createDataFrame(list(enumerate(names)), "arm int, family string")
    keys = spark.createDataFrame([(*key, i) for i, key in enumerate(model.keys)], ", ".join([f"`{c}` {t}" for c, t in zip(model.by, model.kinds, strict=True)] + ["group int"]))
    return auc.join(full, "group").join(F.broadcast(labels), "arm").join(F.broadcast(keys), "group").select(*model.by, "family", "auc", (F.col("full_") - F.col("auc")).alias("loss"))  # a row a model
