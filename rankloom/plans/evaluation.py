"""Queries of the metrics, and the flagship: information-weighted micro-F of one cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.steps import materialise
from rankloom.operators import lifting as L
from rankloom.operators import metrics as M
from rankloom.operators import ontology as O

from .dag import IA
from .registry import query
from .tables import PAIRS, accretion, all_pairs, candidates, closure, edges, graph, nodes, positives

_BIN = "least(50, greatest(0, floor(score * 50)))::INTEGER"


def _round(df, *columns):
    return df.select(*[F.round(c, 9).alias(c) if c in columns else c for c in df.columns])


def _curve(spark, sf):
    g = graph(spark, sf)
    if g is None:
        return M.micro_f_curve(*_cell(spark, sf))
    ia = L.weights(L.information_accretion(positives(spark, sf), g), g, "ia")
    bins = materialise(L.micro_bins(candidates(spark, sf), g, ia), "bins")
    return M.swept_curve(bins.where("bin is not null"), bins, 50)


def _cell(spark, sf):
    """Predictions and truth of the cell, both closed over the ontology without its root, and the terms' weights."""
    pairs, over, e = all_pairs(spark, sf), closure(spark, sf), edges(spark, sf)
    top = O.roots(e, nodes(spark, sf))
    closed = O.entity_closure(pairs.where("label = 1"), over)
    return O.fill_propagation(pairs, over, top), closed.join(top, "term", "left_anti"), O.information_accretion(closed, e)


_MICRO = f"""{IA}, pred AS (SELECT entity, ancestor AS term, max(score) AS score FROM pairs JOIN closure USING (term) WHERE ancestor > 1 GROUP BY ALL),
truth AS (SELECT entity, term FROM closed WHERE term > 1), w AS (SELECT sum(coalesce(ia, 0)) AS wanted FROM truth LEFT JOIN ia USING (term)),
b AS (SELECT {_BIN} AS bin, sum(coalesce(ia, 0)) AS n, sum(CASE WHEN t.entity IS NULL THEN 0 ELSE coalesce(ia, 0) END) AS tp FROM pred p LEFT JOIN truth t USING (entity, term) LEFT JOIN ia USING (term) GROUP BY ALL),
s AS (SELECT bin, sum(n) OVER d AS n, sum(tp) OVER d AS tp FROM b WINDOW d AS (ORDER BY bin DESC)),
curve AS (SELECT bin, bin / 50 AS threshold, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS precision, CASE WHEN wanted > 0 THEN tp / wanted ELSE 0 END AS recall FROM s, w),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f FROM curve)"""


@query(f"WITH RECURSIVE {_MICRO} SELECT bin, threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f, 9) AS f FROM f")
def flagship_ia_micro_f(spark, sf):
    return _round(_curve(spark, sf), "precision", "recall", "f")


@query(f"WITH RECURSIVE {_MICRO} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f, 9) AS f FROM f ORDER BY f.f DESC, bin DESC LIMIT 1")
def i03_best_ia_micro_f(spark, sf):
    return _round(M.best(_curve(spark, sf)), "precision", "recall", "f").drop("bin")


@query(f"""WITH {PAIRS}, b AS (SELECT entity, term, label, {_BIN} AS bin FROM pairs), t AS (SELECT DISTINCT bin FROM b),
pos AS (SELECT entity, sum(label) AS wanted FROM pairs GROUP BY ALL HAVING sum(label) > 0),
e AS (SELECT t.bin, b.entity, count(*) AS n, sum(label) AS tp FROM t JOIN b ON b.bin >= t.bin GROUP BY ALL),
c AS (SELECT bin, avg(tp / n) AS p, sum(coalesce(tp / wanted, 0)) / (SELECT count(*) FROM pos) AS r FROM e LEFT JOIN pos USING (entity) GROUP BY bin)
SELECT bin, bin / 50 AS threshold, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f FROM c""")
def i01_entity_fmax(spark, sf):
    p = all_pairs(spark, sf)
    return _round(M.fmax_curve(p, p.where("label = 1")), "precision", "recall", "f")


@query(f"""WITH {PAIRS}, b AS (SELECT {_BIN} AS bin, count(*) AS n, sum(label) AS y FROM pairs GROUP BY ALL), s AS (SELECT bin, sum(n) OVER d AS n, sum(y) OVER d AS tp, sum(y) OVER () AS a FROM b WINDOW d AS (ORDER BY bin DESC))
SELECT bin, round(tp / n, 9) AS precision, round(tp / a, 9) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / n) * (tp / a) / (tp / n + tp / a) ELSE 0 END, 9) AS f FROM s""")
def i02_flat_fmax(spark, sf):
    return _round(M.flat_f_curve(all_pairs(spark, sf)), "precision", "recall", "f")


@query(f"""WITH RECURSIVE {IA}, x AS (SELECT p.*, coalesce(ia, 0) AS w FROM pairs p LEFT JOIN ia USING (term)), b AS (SELECT {_BIN} AS bin, sum(w) AS n, sum(w * label) AS y FROM x GROUP BY ALL),
s AS (SELECT bin, sum(n) OVER d AS n, sum(y) OVER d AS tp, sum(y) OVER () AS a FROM b WINDOW d AS (ORDER BY bin DESC)), c AS (SELECT bin, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS p, tp / a AS r FROM s)
SELECT bin, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f FROM c""")
def i05_flat_weighted_fmax(spark, sf):
    pairs = all_pairs(spark, sf)
    ia = accretion(spark, sf)
    return _round(M.flat_f_curve(pairs.join(ia, "term", "left"), weight=F.coalesce("ia", F.lit(0.0))), "precision", "recall", "f")


@query(f"""WITH RECURSIVE {IA}, w AS (SELECT entity, avg(coalesce(ia, 0)) AS w, sum(label) AS a FROM pairs LEFT JOIN ia USING (term) GROUP BY ALL),
b AS (SELECT entity, label, {_BIN} AS bin FROM pairs), t AS (SELECT DISTINCT bin FROM b), e AS (SELECT t.bin, b.entity, count(*) AS n, sum(label) AS tp FROM t JOIN b ON b.bin >= t.bin GROUP BY ALL),
c AS (SELECT bin, sum(w * tp / n) / sum(w) AS p, sum(CASE WHEN a > 0 THEN w * tp / a ELSE 0 END) / (SELECT sum(w) FROM w WHERE a > 0) AS r FROM e JOIN w USING (entity) GROUP BY bin)
SELECT bin, round(p, 8) AS precision, round(r, 8) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 8) AS f FROM c WHERE p IS NOT NULL""")
def i06_group_weighted_f(spark, sf):
    pairs = all_pairs(spark, sf)
    ia = accretion(spark, sf)
    curve = M.group_weighted_curve(pairs, ia)
    return curve.select("bin", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f")])


_RANKED = f"""{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, entity) AS k, sum(label) OVER (PARTITION BY term ORDER BY score DESC, entity ROWS UNBOUNDED PRECEDING) AS tp,
sum(label) OVER (PARTITION BY term) AS pos, rank() OVER (PARTITION BY term ORDER BY score) + (count(*) OVER (PARTITION BY term, score) - 1) / 2 AS ar FROM pairs)"""


@query(f"""WITH {_RANKED} SELECT term, count(*) AS n, sum(label)::BIGINT AS positives, round(sum(CASE WHEN k <= 5 THEN label ELSE 0 END) / least(5, count(*)), 9) AS p_at_5,
round(sum(CASE WHEN k <= 10 THEN label ELSE 0 END) / least(10, count(*)), 9) AS p_at_10, round(sum(CASE WHEN k <= 20 THEN label ELSE 0 END) / least(20, count(*)), 9) AS p_at_20,
CASE WHEN sum(label) > 0 THEN round(sum(CASE WHEN k <= pos THEN label ELSE 0 END) / sum(label), 9) END AS r_precision, CASE WHEN sum(label) > 0 THEN round(sum(CASE WHEN label = 1 THEN tp / k ELSE 0 END) / sum(label), 9) END AS ap,
CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN round((sum(CASE WHEN label = 1 THEN ar ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) END AS auc FROM r GROUP BY term""")
def i07_term_metrics(spark, sf):
    return _round(M.term_metrics(all_pairs(spark, sf)), "p_at_5", "p_at_10", "p_at_20", "r_precision", "ap", "auc")


@query(f"""WITH {PAIRS}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ar FROM pairs)
SELECT count(*) AS n, count(*) AS covered, round((sum(ar * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) AS auc FROM r""")
def i08_auroc(spark, sf):
    return _round(M.auroc(all_pairs(spark, sf)), "auc")


@query(f"""WITH {PAIRS}, r AS (SELECT entity, label, row_number() OVER o AS k, sum(label) OVER (PARTITION BY entity ORDER BY score DESC, term ROWS UNBOUNDED PRECEDING) AS tp FROM pairs WINDOW o AS (PARTITION BY entity ORDER BY score DESC, term)),
a AS (SELECT entity, avg(tp / k) AS ap FROM r WHERE label = 1 GROUP BY ALL) SELECT count(*) AS entities, round(avg(ap), 9) AS map FROM a""")
def i08_mean_average_precision(spark, sf):
    return _round(M.mean_average_precision(all_pairs(spark, sf)), "map")


@query("""WITH x AS (SELECT l_suppkey AS g, l_quantity AS a, l_discount AS b FROM lineitem), r AS (SELECT g, b, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS ra,
rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2 AS rb, CASE WHEN count(*) OVER (PARTITION BY g, b) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS tied FROM x)
SELECT g, round(corr(ra, rb), 8) AS rho, round(avg(tied), 8) AS tied_share, count(DISTINCT b) AS distinct_b FROM r GROUP BY g""")
def i09_spearman(spark, sf):
    from .tables import read

    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return M.spearman(rows, "a", "b", "g").select("g", F.round("rho", 8).alias("rho"), F.round("tied_share", 8).alias("tied_share"), "distinct_b")


@query(f"""WITH {PAIRS}, s AS (SELECT entity, term, CAST(label AS DOUBLE) AS score, label FROM pairs), b AS (SELECT {_BIN} AS bin, count(*) AS n, sum(label) AS y FROM s GROUP BY ALL),
c AS (SELECT bin, sum(n) OVER d AS n, sum(y) OVER d AS tp, sum(y) OVER () AS a FROM b WINDOW d AS (ORDER BY bin DESC))
SELECT bin, round(tp / n, 9) AS precision, round(tp / a, 9) AS recall, round(2 * (tp / n) * (tp / a) / (tp / n + tp / a), 9) AS f FROM c""")
def i10_oracle_ceiling(spark, sf):
    p = all_pairs(spark, sf)
    true = p.where("label = 1")
    return _round(M.micro_f_curve(M.oracle_scores(p, true), true).drop("threshold"), "precision", "recall", "f")


@query(f"""WITH {PAIRS}, r AS (SELECT entity, term, label, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS k FROM pairs),
e AS (SELECT entity, avg(CAST(k <= 2 AS INTEGER)) AS r FROM r WHERE label = 1 GROUP BY ALL) SELECT count(*) AS entities, round(avg(r), 9) AS recall FROM e""")
def i12_recall_at_k(spark, sf):
    p = all_pairs(spark, sf)
    return _round(M.recall_at(p, p.where("label = 1"), 2), "recall")


@query(f"""WITH RECURSIVE {IA}, x AS (SELECT p.*, coalesce(ia, 0) AS w FROM pairs p LEFT JOIN ia USING (term)), s AS (SELECT entity, sum(w) OVER o AS n, sum(w * label) OVER o AS tp, sum(w * label) OVER (PARTITION BY entity) AS a
FROM x WINDOW o AS (PARTITION BY entity ORDER BY score DESC, term ROWS UNBOUNDED PRECEDING)), c AS (SELECT entity, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS p, CASE WHEN a > 0 THEN tp / a ELSE 0 END AS r FROM s)
SELECT entity, round(max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 9) AS fmax FROM c GROUP BY entity""")
def i13_entity_weighted_fmax(spark, sf):
    pairs = all_pairs(spark, sf)
    ia = accretion(spark, sf)
    return _round(M.entity_fmax(pairs, ia), "fmax")
