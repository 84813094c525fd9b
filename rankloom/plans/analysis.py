"""Queries of resampling statistics and analysis tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import lifting as L
from rankloom.operators import metrics as M
from rankloom.operators import ontology as O
from rankloom.operators import reports as P
from rankloom.operators import resampling as J

from .dag import IA
from .registry import query
from .tables import CAND, CLOSURE, PAIRS, accretion, candidates, all_pairs, closure, edges, graph, read

_LEVELS = " + ".join(f"(u >= {c!r})::INTEGER" for c in J._POISSON)


def _weights(seed: str, table: str, n: int, entity: str = "entity") -> str:
    """Poisson weights: lane r % 8 of the md5 of seed, r // 8 and entity."""
    return f"""rs AS (SELECT t.*, r.resample, ('0x' || substr(md5('{seed}' || '|' || (r.resample // 8) || '|' || CAST({entity} AS VARCHAR)), 4 * (r.resample % 8) + 1, 4))::BIGINT / 65536.0::DOUBLE AS u FROM {table} t, (SELECT unnest(range(0, {n})) AS resample) r), w AS (SELECT *, {_LEVELS} AS weight FROM rs)"""


_PER = """per AS (SELECT o_custkey AS entity, avg(o_totalprice) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 0.99 END) AS b FROM orders GROUP BY ALL)"""


@query(f"""WITH {_PER}, {_weights('b', 'per', 100)}, m AS (SELECT resample, sum(weight * (a - b)) / sum(weight) AS d FROM w WHERE weight > 0 GROUP BY ALL)
SELECT round(avg(d), 4) AS mean, round(quantile_cont(d, 0.025), 4) AS low, round(quantile_cont(d, 0.975), 4) AS high, avg((d <= 0)::INTEGER) AS p, (quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0) AS separates FROM m""")
def j03_paired_mean_bootstrap(spark, sf):
    o = read(spark, sf, "orders")
    per = o.groupBy(F.col("o_custkey").alias("entity")).agg(F.avg("o_totalprice").alias("a"), F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 0.99)).alias("b"))
    return J.mean_difference(per, "a", "b", 100, "b").select(*[F.round(c, 4).alias(c) for c in ("mean", "low", "high")], "p", "separates")


@query(f"""WITH {PAIRS}, per AS (SELECT entity, sum(label * (score >= 0.5)::INTEGER) AS tp_a, sum((score >= 0.5)::INTEGER) AS n_a, sum(label * (score >= 0.8)::INTEGER) AS tp_b, sum((score >= 0.8)::INTEGER) AS n_b, sum(label) AS wanted FROM pairs GROUP BY ALL),
{_weights('m', 'per', 100)}, s AS (SELECT resample, sum(weight * tp_a) AS ta, sum(weight * n_a) AS na, sum(weight * tp_b) AS tb, sum(weight * n_b) AS nb, sum(weight * wanted) AS q FROM w WHERE weight > 0 GROUP BY ALL), d AS (SELECT 2 * ta / (na + q) - 2 * tb / (nb + q) AS d FROM s)
SELECT round(avg(d), 8) AS mean, round(quantile_cont(d, 0.025), 8) AS low, round(quantile_cont(d, 0.975), 8) AS high FROM d""")
def j02_micro_f_bootstrap(spark, sf):
    hit = lambda t: (F.col("score") >= t).cast("int")
    per = all_pairs(spark, sf).groupBy("entity").agg(F.sum(F.col("label") * hit(0.5)).alias("tp_a"), F.sum(hit(0.5)).alias("n_a"), F.sum(F.col("label") * hit(0.8)).alias("tp_b"), F.sum(hit(0.8)).alias("n_b"), F.sum("label").alias("wanted"))
    return J.micro_f_difference(per, 100, "m").select(*[F.round(c, 8).alias(c) for c in ("mean", "low", "high")])


@query("SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.025), 8) AS low, round(quantile_cont(value, 0.975), 8) AS high FROM events GROUP BY ALL")
def j05_grouped_intervals(spark, sf):
    return J.grouped_intervals(read(spark, sf, "events"), ["event_type"], "value").select("event_type", "n", *[F.round(c, 8).alias(c) for c in ("mean", "low", "high")])


@query("""WITH d AS (SELECT l_returnflag AS g, round(abs(round(l_quantity / 50 - l_discount * 10, 12)), 12) AS a, l_quantity / 50 - l_discount * 10 AS d FROM lineitem WHERE l_quantity / 50 - l_discount * 10 <> 0),
r AS (SELECT *, count(*) OVER (PARTITION BY g, a) AS t, rank() OVER (PARTITION BY g ORDER BY a) AS r0 FROM d), s AS (SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN r0 + (t - 1) / 2 ELSE 0 END) AS w, sum(t * t - 1) AS ties FROM r GROUP BY ALL)
SELECT g, n, w::DOUBLE AS w, round((w - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""")
def j07_signed_rank(spark, sf):
    d = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") / 50 - F.col("l_discount") * 10).alias("d"))
    return J.wilcoxon(d, "g").withColumn("z", F.round("z", 6))


@query("""WITH p AS (SELECT event_type AS name, round(1 / (1 + avg(value)), 9) AS p FROM events GROUP BY ALL), s AS (SELECT name, p, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS s FROM p)
SELECT name, p, max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS adjusted FROM s""")
def j07_holm(spark, sf):
    p = read(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(1 / (1 + F.avg("value")), 9).alias("p"))
    return J.holm(p, "p")


_RUNS = "runs AS (SELECT o_orderpriority AS cell, year(o_orderdate)::INTEGER AS seed, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


def runs(spark, sf):
    o = read(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("cell"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("value"))


@query(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, seed DESC) AS k FROM runs) SELECT cell, seed, round(value, 5) AS value FROM r WHERE k = 1")
def d18_cell_winners(spark, sf):
    return P.winner_per_cell(runs(spark, sf), "cell", "value", "seed").withColumn("value", F.round("value", 5))


@query(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, seed DESC) AS k FROM runs) SELECT seed, count(*) AS cells FROM r WHERE k = 1 GROUP BY seed")
def d18_majority(spark, sf):
    return P.majority(P.winner_per_cell(runs(spark, sf), "cell", "value", "seed"), "seed")


_TWO = f"{_RUNS}, two AS (SELECT a.cell, a.value AS model, b.value AS baseline FROM runs a JOIN runs b ON a.cell = b.cell AND a.seed = 1995 AND b.seed = 1996)"


def two(spark, sf):
    r = runs(spark, sf)
    return r.where("seed = 1995").select("cell", F.col("value").alias("model")).join(r.where("seed = 1996").select("cell", F.col("value").alias("baseline")), "cell")


@query(f"WITH {_TWO} SELECT round(avg(CASE WHEN cell IN ('1-URGENT', '2-HIGH') THEN model ELSE baseline END), 5) AS policy, round(avg(baseline), 5) AS baseline, round(avg(CASE WHEN cell IN ('1-URGENT', '2-HIGH') THEN model ELSE baseline END) - avg(baseline), 5) AS gain FROM two")
def d19_selective_policy(spark, sf):
    return P.policy_average(two(spark, sf), "cell", ["1-URGENT", "2-HIGH"], "model", "baseline").select(*[F.round(c, 5).alias(c) for c in ("policy", "baseline", "gain")])


@query(f"WITH {_TWO} SELECT cell, round(baseline, 5) AS a, round(model, 5) AS b, round(model - baseline, 5) AS delta FROM two")
def d20_run_delta(spark, sf):
    t = two(spark, sf)
    return P.run_delta(t.select("cell", F.col("baseline").alias("v")), t.select("cell", F.col("model").alias("v")), "cell", "v").select("cell", *[F.round(c, 5).alias(c) for c in ("a", "b", "delta")])


@query(f"WITH {_TWO} SELECT cell, CASE WHEN model - baseline > 500 THEN 'better' WHEN model - baseline < -500 THEN 'worse' ELSE 'same' END AS verdict FROM two")
def d35_verdicts(spark, sf):
    return P.verdicts(two(spark, sf), "model", "baseline", 500).select("cell", "verdict")


_SEEDS = tuple(range(1995, 2002))
_WIDE = ", ".join(f"round(max(value) FILTER (seed = {y}), 5) AS seed_{y}" for y in _SEEDS)


@query(f"WITH {_RUNS} SELECT cell, {_WIDE}, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS deviation FROM runs GROUP BY cell")
def d22_replication(spark, sf):
    r = P.replication(runs(spark, sf), "cell", "seed", "value", _SEEDS)
    return r.select("cell", *[F.round(c, 5).alias(c) for c in r.columns if c != "cell"])


@query("""WITH x AS (SELECT p_brand AS cell, p_type AS feature, sum(p_retailprice) AS importance FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY importance DESC, feature) AS rank FROM x) SELECT feature, round(avg(rank), 9) AS mean_rank, round(sum(importance), 2) AS total FROM r GROUP BY feature""")
def d21_importance(spark, sf):
    x = read(spark, sf, "part").groupBy(F.col("p_brand").alias("cell"), F.col("p_type").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return P.importance_report(x, "cell").select("feature", F.round("mean_rank", 9).alias("mean_rank"), F.round("total", 2).alias("total"))


@query(f"WITH {PAIRS} SELECT CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.7 THEN 'middle' ELSE 'high' END AS stratum, count(*) AS n, round(avg(label), 9) AS precision FROM pairs GROUP BY ALL HAVING count(*) >= 10")
def d30_strata_precision(spark, sf):
    s = F.when(F.col("score") < 0.3, "low").when(F.col("score") < 0.7, "middle").otherwise("high")
    return P.strata_precision(all_pairs(spark, sf), s, 10).withColumn("precision", F.round("precision", 9))


@query("SELECT l_suppkey AS entity, count(*) FILTER (l_returnflag = 'R') AS n_0, count(*) FILTER (l_returnflag = 'A') AS n_1, count(*) FILTER (l_returnflag = 'N') AS n_2, bit_or(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 4 ELSE 0 END) AS mask, count(DISTINCT l_returnflag) AS breadth FROM lineitem GROUP BY ALL")
def d12_evidence_tiers(spark, sf):
    return P.tier_counts(read(spark, sf, "lineitem").withColumn("entity", F.col("l_suppkey")), "entity", "l_returnflag", ["R", "A", "N"])


@query(f"WITH {CAND}, g AS (SELECT entity, snapshot, count(*) AS size FROM cand GROUP BY ALL) SELECT size, count(*) AS groups FROM g GROUP BY size")
def d32_group_sizes(spark, sf):
    return P.group_sizes(candidates(spark, sf), ["entity", "snapshot"])


@query(f"WITH {CAND} SELECT source AS plm_id, stream AS k_context, count(*) AS rows FROM cand GROUP BY ALL")
def d01_rows_per_source(spark, sf):
    return candidates(spark, sf).groupBy(F.col("source").alias("plm_id"), F.col("stream").alias("k_context")).agg(F.count("*").alias("rows"))


@query(f"""WITH RECURSIVE {IA}, x AS (SELECT p.*, coalesce(ia, 1.0) AS w FROM pairs p LEFT JOIN ia USING (term)), e AS (SELECT entity, sum(CASE WHEN score >= 0.5 AND label = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5 AND label = 0 THEN w ELSE 0 END) AS fp, sum(CASE WHEN score < 0.5 AND label = 1 THEN w ELSE 0 END) AS fn FROM x GROUP BY ALL)
SELECT entity, round(tp, 8) AS tp, round(fp, 8) AS fp, round(fn, 8) AS fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 8) AS delivered, round(CASE WHEN 2 * tp + fn > 0 THEN 2 * tp / (2 * tp + fn) ELSE 0 END, 8) AS without_wrong FROM e""")
def d28_error_atlas(spark, sf):
    pairs = all_pairs(spark, sf)
    ia = accretion(spark, sf)
    a = P.error_atlas(pairs, ia, 0.5)
    return a.select("entity", *[F.round(c, 8).alias(c) for c in a.columns if c != "entity"])


@query(f"""WITH RECURSIVE {CLOSURE}, {PAIRS}, said AS (SELECT DISTINCT entity, term FROM pairs WHERE score >= 0.6), t AS (SELECT DISTINCT entity, term FROM pairs WHERE label = 1), sib AS (SELECT DISTINCT x.child AS a, y.child AS b FROM edges x JOIN edges y ON x.parent = y.parent AND x.child <> y.child)
SELECT t.entity, t.term, CASE WHEN EXISTS (SELECT 1 FROM said s WHERE s.entity = t.entity AND s.term = t.term) THEN 'hit'
WHEN EXISTS (SELECT 1 FROM said s JOIN closure c ON c.term = s.term AND c.ancestor <> c.term WHERE s.entity = t.entity AND c.ancestor = t.term) THEN 'overshot'
WHEN EXISTS (SELECT 1 FROM said s JOIN closure c ON c.ancestor = s.term AND c.ancestor <> c.term WHERE s.entity = t.entity AND c.term = t.term) THEN 'too_shallow'
WHEN EXISTS (SELECT 1 FROM said s JOIN sib ON sib.b = s.term WHERE s.entity = t.entity AND sib.a = t.term) THEN 'sibling' ELSE 'other' END AS class FROM t""")
def d36_miss_classes(spark, sf):
    p, g = all_pairs(spark, sf), graph(spark, sf)
    if g is not None:
        return L.miss_classes(candidates(spark, sf).select("entity", "term", (F.col("score") >= 0.6).alias("said"), (F.col("label") == 1).alias("true")), g)
    return P.miss_classes(p.where("score >= 0.6"), p.where("label = 1"), closure(spark, sf), edges(spark, sf))


@query("""WITH RECURSIVE r AS (SELECT o_orderpriority AS tier, month(o_orderdate) AS m, year(o_orderdate) AS y, avg(o_totalprice) AS mean, avg(o_totalprice) - stddev_pop(o_totalprice) / sqrt(count(*)) AS low FROM orders GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY y, m) AS k FROM r),
walk AS (SELECT tier, k, y * 100 + m AS name, mean, low, NULL::DOUBLE AS met, true AS promoted, mean AS incumbent FROM o WHERE k = 1 UNION ALL SELECT o.tier, o.k, o.y * 100 + o.m, o.mean, o.low, w.incumbent, o.low > w.incumbent, CASE WHEN o.low > w.incumbent THEN o.mean ELSE w.incumbent END FROM walk w JOIN o ON o.tier = w.tier AND o.k = w.k + 1)
SELECT tier, name::VARCHAR AS name, round(met, 5) AS met, promoted FROM walk""")
def e18_promotion_walk(spark, sf):
    o = read(spark, sf, "orders")
    r = o.groupBy(F.col("o_orderpriority").alias("tier"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("mean"), (F.avg("o_totalprice") - F.stddev_pop("o_totalprice") / F.sqrt(F.count("*"))).alias("low")).withColumn("name", (F.col("y") * 100 + F.col("m")).cast("string"))
    return P.promotion_walk(r, ["tier"], ["y", "m"]).select("tier", "name", F.round("met", 5).alias("met"), "promoted")


@query(f"WITH {PAIRS}, b AS (SELECT least(50, greatest(0, floor(score * 50)))::INTEGER AS bin, count(*) AS n, sum(label) AS y FROM pairs GROUP BY ALL) SELECT bin, (sum(n) OVER d)::BIGINT AS said, (sum(y) OVER d)::BIGINT AS hits FROM b WINDOW d AS (ORDER BY bin DESC)")
def i11_reverse_histogram(spark, sf):
    from pyspark.sql import Window

    bins = all_pairs(spark, sf).groupBy(M.bin_of(F.col("score"), 50).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    d = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each threshold
    return bins.select("bin", F.sum("n").over(d).alias("said"), F.sum("y").over(d).alias("hits"))
