"""Queries of the model-side operators; those of fitted models have no SQL, tests state their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import fits as FT
from rankloom.operators import models as K
from rankloom.operators import ontology as O
from rankloom.operators import staging as S

from .blending import _STREAMS, streams, truth
from .dag import IA
from .registry import query
from .similarity import vectors
from .staging import h
from .tables import CAND, PAIRS, accretion, candidates, all_pairs, closure, edges, read


@query(f"""WITH RECURSIVE {IA} SELECT entity, term, round(CASE WHEN label = 1 THEN 1 + 0.5::DOUBLE * coalesce(ia, 0) ELSE 1 END, 9) AS w_positives, round(1 + 0.5::DOUBLE * coalesce(ia, 0), 9) AS w_all FROM pairs LEFT JOIN ia USING (term)""")
def k01_ia_weights(spark, sf):
    pairs = all_pairs(spark, sf)
    ia = accretion(spark, sf)
    return pairs.join(ia, "term", "left").select("entity", "term", F.round(K.ia_weight("positives", 0.5), 9).alias("w_positives"), F.round(K.ia_weight("all", 0.5), 9).alias("w_all"))


#: Isotonic regression of p(grp, bin, w, wy) as the largest, over starts up to a point, of the least mean from there to any end from the point on.
_ISOTONIC = """q AS (SELECT *, row_number() OVER o AS i, sum(w) OVER o AS sw, sum(wy) OVER o AS sy FROM p WHERE w > 0 WINDOW o AS (PARTITION BY grp ORDER BY bin)), m AS (SELECT a.grp, a.i AS j, b.i AS k, min((b.sy - a.sy + a.wy) / (b.sw - a.sw + a.w)) OVER (PARTITION BY a.grp, a.i ORDER BY b.i DESC) AS least FROM q a JOIN q b ON b.grp = a.grp AND b.i >= a.i),
curve AS (SELECT q.grp, q.bin, max(m.least) AS fitted FROM q JOIN m ON m.grp = q.grp AND m.k = q.i GROUP BY ALL)"""
_BIN = "least(1000, greatest(0, floor(score * 1000)))::INTEGER"


@query(f"""WITH {CAND}, p AS (SELECT category AS grp, {_BIN} AS bin, count(*)::DOUBLE AS w, sum(label)::DOUBLE AS wy FROM cand GROUP BY ALL), {_ISOTONIC}, n AS (SELECT category, count(*) >= 50 AND sum(label) > 0 AND sum(label) < count(*) AS fits FROM cand GROUP BY ALL)
SELECT entity, term, stream, category, score, label, round(CASE WHEN fits THEN fitted ELSE score END, 9) AS calibrated FROM (SELECT *, {_BIN} AS bin FROM cand) x JOIN n USING (category) JOIN curve ON grp = category AND curve.bin = x.bin""")
def k02_calibration(spark, sf):
    rows = candidates(spark, sf).select("entity", "term", "stream", "category", "score", "label")
    return K.calibrate(rows, "category").withColumn("calibrated", F.round("calibrated", 9))


#: Newton's method for a + b * score in each category, on counts by score.
@query(f"""WITH RECURSIVE {CAND}, p AS MATERIALIZED (SELECT category, score, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS y FROM cand GROUP BY ALL),
fit AS (SELECT category, 0 AS round, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT DISTINCT category FROM p) UNION ALL
    SELECT category, round + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT f.category, f.round, f.a, f.b, sum(y - n * e) AS g0, sum((y - n * e) * score) AS g1, sum(n * e * (1 - e)) AS h00, sum(n * e * (1 - e) * score) AS h01, sum(n * e * (1 - e) * score * score) AS h11 FROM (SELECT f.*, p.score, p.n, p.y, 1 / (1 + exp(-f.a - f.b * p.score)) AS e FROM fit f JOIN p USING (category) WHERE f.round < 12) f GROUP BY ALL)),
n AS (SELECT category, count(*) >= 50 AND sum(label) > 0 AND sum(label) < count(*) AS fits FROM cand GROUP BY ALL)
SELECT entity, term, stream, category, score, label, round(CASE WHEN fits THEN 1 / (1 + exp(-a - b * score)) ELSE score END, 6) AS calibrated FROM cand JOIN n USING (category) JOIN (SELECT * FROM fit WHERE round = 12) USING (category)""")
def k02_platt(spark, sf):
    rows = candidates(spark, sf).select("entity", "term", "stream", "category", "score", "label")
    return K.calibrate(rows, "category", method="platt").withColumn("calibrated", F.round("calibrated", 6))


@query(f"""WITH {CAND}, f AS (SELECT term, count(*) AS n FROM cand GROUP BY ALL), c AS (SELECT quantile_disc(n, 1.0 / 3) AS low, quantile_disc(n, 2.0 / 3) AS high FROM f), r AS (SELECT d.*, 1 + d.term % 3 AS w, (n > low)::INTEGER + (n > high)::INTEGER AS tercile, {_BIN} AS bin FROM cand d JOIN f USING (term), c),
p AS (SELECT tercile AS grp, bin, sum(w)::DOUBLE AS w, sum(w * label)::DOUBLE AS wy FROM r GROUP BY ALL UNION ALL SELECT 9, bin, sum(w), sum(w * label) FROM r GROUP BY ALL), {_ISOTONIC}, n AS (SELECT tercile, CASE WHEN count(*) >= 50 AND sum(label) > 0 AND sum(label) < count(*) THEN tercile ELSE 9 END AS grp FROM r GROUP BY tercile)
SELECT entity, term, stream, score, label, w, r.tercile, round(fitted, 9) AS calibrated FROM r JOIN n ON n.tercile = r.tercile JOIN curve ON curve.grp = n.grp AND curve.bin = r.bin""")
def k03_tercile_calibration(spark, sf):
    rows = candidates(spark, sf).select("entity", "term", "stream", "score", "label").withColumn("w", 1 + F.col("term") % 3)
    return K.tercile_calibrate(rows, rows.groupBy("term").agg(F.count("*").alias("n")), "w").withColumn("calibrated", F.round("calibrated", 9))


@query()
def k05_family_ablation(spark, sf):
    rows = S.split(candidates(spark, sf), 0.2, seed="k").withColumns({"size": F.col("term") % 50, "gap": F.when(F.col("entity") % 7 > 0, F.col("entity") % 11), "flat": F.lit(1.0)})
    families = {"first": ["score"], "second": ["score2"], "shape": ["stream", "size"], "sparse": ["gap"], "constant": ["flat"]}
    out = FT.family_ablation(rows.where("validation = 0"), rows.where("validation = 1"), ["category", "snapshot"], families, weight=None)
    return out.select("category", "snapshot", "family", F.round("auc", 9).alias("auc"), F.round("loss", 9).alias("loss"))


_BINNED = f"""{CAND}, c AS (SELECT category, (least(10, greatest(0, floor(score * 10)))::INTEGER + 0.5::DOUBLE) / 10 AS x, avg(label) AS y FROM cand WHERE entity % 2 = 0 GROUP BY ALL), r AS (SELECT entity, term, stream, category, score FROM cand WHERE entity % 2 = 1),
m AS (SELECT r.entity, r.term, r.stream, r.score, arg_max(y, x) FILTER (x <= score) AS y0, max(x) FILTER (x <= score) AS x0, arg_min(y, x) FILTER (x > score) AS y1, min(x) FILTER (x > score) AS x1 FROM r LEFT JOIN c USING (category) GROUP BY ALL)"""


@query(f"WITH {_BINNED} SELECT entity, term, stream, round(CASE WHEN y0 IS NULL AND y1 IS NULL THEN score WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (score - x0) / (x1 - x0) * (y1 - y0) END, 9) AS calibrated FROM m")
def k08_stored_calibrators(spark, sf):
    c = candidates(spark, sf)
    rows = c.where("entity % 2 = 1").select("entity", "term", "stream", "category", "score").distinct()  # the SQL has a row that repeats once
    out = K.apply_calibrators(rows, K.binned_calibrators(c.where("entity % 2 = 0"), "category"), "category")
    return out.select("entity", "term", "stream", F.round("calibrated", 9).alias("calibrated"))


@query(f"""WITH {PAIRS}, b AS (SELECT entity % 3 > 0 AS tune, least(50, greatest(0, floor(score * 50)))::INTEGER AS bin, count(*) AS n, sum(label) AS y FROM pairs GROUP BY ALL), s AS (SELECT tune, bin, sum(n) OVER d AS n, sum(y) OVER d AS tp, sum(n) OVER (PARTITION BY tune) AS r, sum(y) OVER (PARTITION BY tune) AS a FROM b WINDOW d AS (PARTITION BY tune ORDER BY bin DESC)),
t AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (n + a) ELSE 0 END AS f FROM s WHERE tune ORDER BY f DESC, bin DESC LIMIT 1), o AS (SELECT sum(y) FILTER (b.bin >= t.bin) AS tp, sum(b.n) FILTER (b.bin >= t.bin) AS n, sum(y) AS a FROM b, t WHERE NOT b.tune)
SELECT t.bin / 50 AS threshold, round(t.n / t.r, 9) AS kept, round(t.tp / t.n, 9) AS precision, round(f, 9) AS f_tune, round(CASE WHEN o.tp > 0 THEN 2 * o.tp / (o.n + o.a) ELSE 0 END, 9) AS f_blind FROM t, o""")
def k11_selective_submission(spark, sf):
    out = K.selective_submission(all_pairs(spark, sf), F.col("entity") % 3 > 0)
    return out.select("threshold", *[F.round(c, 9).alias(c) for c in ("kept", "precision", "f_tune", "f_blind")])


@query()
def g09_recursive_soft_propagation(spark, sf):
    return O.recursive_soft_propagation(all_pairs(spark, sf), edges(spark, sf), read(spark, sf, "part").select(F.col("p_partkey").alias("term")), closure(spark, sf))


@query()
def k04_reranker(spark, sf):
    rows = S.split(candidates(spark, sf), 0.2, seed="k").withColumn("size", F.col("term") % 50)
    scored, _ = K.rerank(rows.where("validation = 0"), rows.where("validation = 1"), ["score", "score2", "stream", "size"], trees=5, depth=3)
    return scored.select("entity", "term", "stream", "label", "reranked")


@query(f"""WITH {_STREAMS}, x AS (SELECT entity % 3 AS cell, w AS weight, coalesce(a, 0) AS a, coalesce(b, 0) AS b, (t.entity IS NOT NULL)::INTEGER AS y FROM u LEFT JOIN truth t USING (entity, term), (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) v(w)),
n AS (SELECT cell, weight, least(50, greatest(0, floor((1 - (1 - a) * (1 - weight * b)) * 50))) AS bin, count(*) AS n, sum(y) AS y FROM x GROUP BY ALL), s AS (SELECT cell, weight, sum(n) OVER d AS n, sum(y) OVER d AS tp, sum(y) OVER (PARTITION BY cell, weight) AS a FROM n WINDOW d AS (PARTITION BY cell, weight ORDER BY bin DESC)),
f AS (SELECT cell, weight, max(CASE WHEN tp > 0 THEN 2 * tp / (n + a) ELSE 0 END) AS f FROM s GROUP BY ALL) SELECT cell, weight, round(f, 9) AS f FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY f DESC, weight) AS k FROM f) WHERE k = 1""")
def k06_blend_tuning(spark, sf):
    a, b = streams(spark, sf)
    cells = a.select("entity").union(b.select("entity")).distinct().withColumn("cell", F.col("entity") % 3)
    return K.tune_blend(a, b, truth(spark, sf), (0.0, 0.25, 0.5, 1.0), "cell", cells).withColumn("f", F.round("f", 9))


@query(f"""WITH {PAIRS}, x AS (SELECT *, ({h('f', 'CAST(entity AS VARCHAR)')} % 4)::INTEGER AS fold, least(50, greatest(0, floor(score * 50)))::INTEGER AS bin FROM pairs), g AS (SELECT fold, b AS bin FROM (SELECT DISTINCT fold FROM x), (SELECT unnest(range(0, 51)) AS b)),
o AS (SELECT g.fold, g.bin, count(x.entity) AS n, coalesce(sum(x.label), 0) AS tp, (SELECT sum(label) FROM x y WHERE y.fold = g.fold) AS a FROM g LEFT JOIN x ON x.fold = g.fold AND x.bin >= g.bin GROUP BY ALL), t AS (SELECT bin, sum(n) AS n, sum(tp) AS tp, sum(a) AS a FROM o GROUP BY ALL),
f AS (SELECT o.fold, o.bin, CASE WHEN t.tp - o.tp > 0 THEN 2 * (t.tp - o.tp) / (t.n - o.n + t.a - o.a) ELSE 0 END AS others, CASE WHEN o.tp > 0 THEN 2 * o.tp / (o.n + o.a) ELSE 0 END AS f FROM o JOIN t USING (bin))
SELECT fold, bin / 50 AS threshold, round(others, 9) AS f_others, round(f, 9) AS f FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY others DESC, bin DESC) AS k FROM f) WHERE k = 1""")
def k07_cross_fitted_threshold(spark, sf):
    out = K.cross_fitted(S.folds(all_pairs(spark, sf), 4, seed="f"))
    return out.select("fold", "threshold", F.round("f_others", 9).alias("f_others"), F.round("f", 9).alias("f"))


_ARMS = f"""{CAND}, r AS (SELECT category AS cell, ({h('g', 'CAST(entity AS VARCHAR)')} % 5)::INTEGER AS fold, arm, round(avg(CASE WHEN arm = 'score' THEN score * label ELSE score2 * label END), 9) AS f FROM cand, (VALUES ('score'), ('score2')) v(arm) GROUP BY ALL)"""


@query(f"""WITH {_ARMS}, o AS (SELECT *, sum(f) OVER (PARTITION BY cell, arm) - f AS rest FROM r), b AS (SELECT cell, fold, arg_max(arm, rest) AS arm, arg_max(f, rest) AS f, max(f) FILTER (arm = 'score') AS base FROM o GROUP BY ALL)
SELECT cell, count(DISTINCT arm) AS arms, round(avg(f - base), 7) AS gain, (count(DISTINCT arm) = 1 AND avg(f - base) > coalesce(stddev_samp(f - base), 0) AND avg((f - base > 0)::INTEGER) >= 0.8) AS passes FROM b GROUP BY cell""")
def k09_strategy_gate(spark, sf):
    c = S.folds(candidates(spark, sf), 5, seed="g")
    arms = c.select(F.col("category").alias("cell"), "fold", F.explode(F.array(F.struct(F.lit("score").alias("arm"), (F.col("score") * F.col("label")).alias("x")), F.struct(F.lit("score2").alias("arm"), (F.col("score2") * F.col("label")).alias("x")))).alias("a"))
    results = arms.groupBy("cell", "fold", "a.arm").agg(F.round(F.avg("a.x"), 9).alias("f"))
    return K.strategy_gate(results, "score").select("cell", "arms", F.round("gain", 7).alias("gain"), "passes")


@query()
def k10_out_of_fold(spark, sf):
    rows = S.folds(candidates(spark, sf).select("entity", "term", "stream", "score", "score2", "label"), 3, seed="o")
    return K.out_of_fold(rows, ["score", "score2"], 3)


@query()
def h11_principal_axes(spark, sf):
    return K.principal_axes(vectors(spark, sf).select("id", "v", "label"), "v", 8).select("id", "label", "projected")


@query(f"WITH {PAIRS} SELECT entity, term, score, label FROM pairs WHERE score >= 0.5 AND term IN (SELECT p_partkey FROM part WHERE p_size >= 20) AND entity NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def i04_terms_of_interest(spark, sf):
    terms = read(spark, sf, "part").where("p_size >= 20").select(F.col("p_partkey").alias("term"))
    known = read(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("entity"))
    return all_pairs(spark, sf).where("score >= 0.5").join(terms, "term", "left_semi").join(known, "entity", "left_anti").select("entity", "term", "score", "label")
