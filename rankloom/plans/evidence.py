"""Queries of slices, label arms, evidence reports and further resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import evidence as V
from rankloom.operators import fusion as X
from rankloom.functions.steps import materialise
from rankloom.operators import lifting as L
from rankloom.operators import metrics as M
from rankloom.operators import ontology as O
from rankloom.operators import resampling as J

from .analysis import _weights
from .blending import _STREAMS, streams, truth
from .dag import IA
from .registry import query
from .tables import CAND, CLOSURE, PAIRS, all_pairs, candidates, closure, edges, graph, read


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {_STREAMS}, t AS (SELECT entity, term, max(score) * 0.5::DOUBLE AS text FROM cand WHERE stream = 4 GROUP BY ALL), x AS (SELECT entity, term, coalesce(a, 0.0)::DOUBLE AS a, coalesce(b, 0.0)::DOUBLE AS b, coalesce(text, 0.0)::DOUBLE AS text FROM u LEFT JOIN t USING (entity, term))
SELECT x.*, max((text > 0)::INTEGER) OVER (PARTITION BY x.entity) AS has_text, o_totalprice AS price, (y.entity IS NOT NULL)::INTEGER AS label FROM x LEFT JOIN orders ON o_orderkey = x.entity LEFT JOIN truth y ON y.entity = x.entity AND y.term = x.term""")
def c11_gating_union(spark, sf):
    text = X.collapse(candidates(spark, sf).where("stream = 4")).select("entity", "term", (F.col("score") * 0.5).alias("text"))
    own = read(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_totalprice").alias("price"))
    return V.gating_union(*streams(spark, sf), text, own, truth(spark, sf))


@query("""WITH reg AS (SELECT o_orderpriority AS band, list(DISTINCT year(o_orderdate)) AS versions FROM orders WHERE o_totalprice > 300000 AND o_orderpriority <> '5-LOW' AND month(o_orderdate) <> o_custkey % 12 GROUP BY ALL), a AS (SELECT o_orderpriority AS band, year(o_orderdate)::INTEGER AS version, count(*) AS n FROM orders GROUP BY ALL)
SELECT band, version, n, coalesce(list_contains(versions, version), false) AS allowed FROM a LEFT JOIN reg USING (band)""")
def c13_band_check(spark, sf):
    o = read(spark, sf, "orders").withColumn("band", F.col("o_orderpriority")).withColumn("version", F.year("o_orderdate"))
    registry = o.where("o_totalprice > 300000 and o_orderpriority <> '5-LOW' and month(o_orderdate) <> o_custkey % 12").groupBy("band").agg(F.collect_set("version").alias("versions"))
    return V.check_bands(o.groupBy("band", "version").agg(F.count("*").alias("n")), registry)


@query(f"""WITH {CAND}, delta AS (SELECT DISTINCT entity, term FROM cand WHERE snapshot IN (1994, 1998)), x AS (SELECT category, entity, term, max(score) AS score, max(label) AS label FROM cand WHERE entity IN (SELECT entity FROM delta) GROUP BY ALL), f AS (SELECT category, max(label) AS y FROM x GROUP BY ALL)
SELECT x.category, x.entity, x.term, x.score, CASE WHEN y = 1 THEN label ELSE (d.entity IS NOT NULL)::INTEGER END AS truth FROM x JOIN f USING (category) LEFT JOIN delta d ON d.entity = x.entity AND d.term = x.term""")
def c15_delta_slice(spark, sf):
    c = candidates(spark, sf)
    rows = c.groupBy("category", "entity", "term").agg(F.max("score").alias("score"), F.max("label").alias("label"))
    return V.delta_slice(rows, c.where("snapshot in (1994, 1998)").select("entity", "term"), "category").select("category", "entity", "term", "score", "truth")


@query(f"""WITH {_STREAMS}, tb AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) <= 1)
SELECT coalesce(a.entity, tb.entity) AS entity, coalesce(a.term, tb.term) AS term, round(1 - (1 - coalesce(a.score, 0)) * (1 - 0.5::DOUBLE * coalesce(tb.score, 0)), 9) AS score FROM a FULL JOIN tb ON a.entity = tb.entity AND a.term = tb.term""")
def c18_top_boost(spark, sf):
    return _rounded(V.boosted_by_top(*streams(spark, sf), 1, 0.5), 9, "score")


_HALVES = "h AS (SELECT a.l_quantity AS a1, b.l_quantity AS b1, CASE WHEN a.l_discount > 0.05 THEN NULL ELSE a.l_discount END AS a2, CASE WHEN b.l_discount > 0.05 THEN NULL ELSE b.l_discount END AS b2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"
_HALF = "100 * avg((a{0} IS DISTINCT FROM b{0})::INTEGER) AS differs, 100 * avg((a{0} IS NULL)::INTEGER) AS a_null, 100 * avg((b{0} IS NULL)::INTEGER) AS b_null, 100 * avg(coalesce(a{0} = 0, false)::INTEGER) AS a_zero, 100 * avg(coalesce(b{0} = 0, false)::INTEGER) AS b_zero FROM h"


@query(f"WITH {_HALVES}, f AS (SELECT 'quantity' AS feature, {_HALF.format(1)} UNION ALL SELECT 'discount', {_HALF.format(2)}) SELECT feature, round(differs, 6) AS differs, round(a_null, 6) AS a_null, round(b_null, 6) AS b_null, round(a_zero, 6) AS a_zero, round(b_zero, 6) AS b_zero FROM f WHERE differs > 0")
def d11_half_rows(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") > 0.05, None).otherwise(F.col("l_discount")).alias("discount"))
    half = lambda k, n: li.where(f"l_linenumber = {k}").select("l_orderkey", F.col("quantity").alias(f"{n}_quantity"), F.col("discount").alias(f"{n}_discount"))
    out = V.half_rows(half(1, "a").join(half(2, "b"), "l_orderkey"), ["quantity", "discount"])
    return _rounded(out, 6, "differs", "a_null", "b_null", "a_zero", "b_zero")


@query(f"""WITH RECURSIVE {CLOSURE}, {CAND}, d AS (SELECT entity, term, bit_or(CAST(1 << ((stream - 1) % 3) AS INTEGER)) AS bits FROM cand WHERE label = 1 GROUP BY ALL), s AS (SELECT entity, ancestor AS term, bit_or(bits) AS bits FROM d JOIN closure USING (term) GROUP BY ALL)
SELECT entity, term, ((bits & 1) <> 0)::INTEGER AS first_tier, ((bits & 6) <> 0)::INTEGER AS other_tiers FROM s""")
def d13_label_arms(spark, sf):
    direct = candidates(spark, sf).where("label = 1").groupBy("entity", "term").agg(F.bit_or(F.expr("shiftleft(1, int((stream - 1) % 3))")).alias("bits"))
    over = closure(spark, sf)
    return V.label_arms(O.entity_closure(direct, over), V.tier_support(direct, over), {"first_tier": 1, "other_tiers": 6})


@query(f"""WITH RECURSIVE {IA}, t AS (SELECT c.entity, c.term, coalesce(ia, 0) AS w, p.entity IS NULL AS missed, coalesce(CASE WHEN p_size < 30 THEN 'small' ELSE 'large' END, 'none') AS tag FROM closed c LEFT JOIN ia ON ia.term = c.term LEFT JOIN (SELECT * FROM pairs WHERE score >= 0.5) p ON p.entity = c.entity AND p.term = c.term LEFT JOIN part ON p_partkey = c.term)
SELECT tag, count(*) AS n, round(sum(CASE WHEN missed THEN w ELSE 0 END), 5) AS missed, round(sum(w), 5) AS total FROM t GROUP BY tag""")
def d29_missed_mass(spark, sf):
    p, g = all_pairs(spark, sf), graph(spark, sf)
    tags = read(spark, sf, "part").select(F.col("p_partkey").alias("term"), F.when(F.col("p_size") < 30, "small").otherwise("large").alias("tag"))
    if g is None:
        closed = O.entity_closure(p.where("label = 1"), closure(spark, sf))
        out = V.missed_mass(closed, p.where("score >= 0.5"), O.information_accretion(closed, edges(spark, sf)), tags)
    else:
        out = L.missed_mass(candidates(spark, sf).withColumn("pool", F.col("score") >= 0.5), g, tags)
    return _rounded(out, 5, "missed", "total")


_F = """b AS (SELECT cell, arm, least(50, greatest(0, floor(s * 50)))::INTEGER AS bin, count(*) AS n, sum(label) AS y FROM x, (VALUES ('model'), ('baseline')) v(arm), LATERAL (SELECT CASE WHEN arm = 'model' THEN score ELSE score2 END AS s) GROUP BY ALL), w AS (SELECT cell, arm, sum(n) OVER d AS n, sum(y) OVER d AS tp, sum(y) OVER (PARTITION BY cell, arm) AS a FROM b WINDOW d AS (PARTITION BY cell, arm ORDER BY bin DESC)),
f AS (SELECT cell, max(CASE WHEN tp > 0 THEN 2 * tp / (n + a) ELSE 0 END) FILTER (arm = 'model') AS model, max(CASE WHEN tp > 0 THEN 2 * tp / (n + a) ELSE 0 END) FILTER (arm = 'baseline') AS baseline FROM w GROUP BY cell)"""


@query(f"""WITH {CAND}, x AS (SELECT CAST(snapshot AS VARCHAR) AS cell, score, score2, label FROM cand), {_F}, r AS (SELECT cell, count(*) AS rows, sum(label)::BIGINT AS positives FROM x GROUP BY ALL), t AS (SELECT cell, rows, positives, model, baseline, model - baseline AS delta FROM r JOIN f USING (cell))
SELECT cell, rows::BIGINT AS rows, positives::BIGINT AS positives, round(model, 9) AS model, round(baseline, 9) AS baseline, round(delta, 9) AS delta FROM (SELECT * FROM t UNION ALL SELECT 'mean', sum(rows), sum(positives), avg(model), avg(baseline), avg(delta) FROM t)""")
def d33_holdout_bands(spark, sf):
    return _rounded(V.holdout_report(candidates(spark, sf), "snapshot", "score", "score2"), 9, "model", "baseline", "delta")


@query("""WITH per AS (SELECT o_custkey AS entity, CASE WHEN c_acctbal < 0 THEN 'a' WHEN c_acctbal < 5000 THEN 'b' ELSE 'c' END AS band, avg(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT band, count(*) AS entities, round(avg(v), 4) AS mean, round(min(v), 4) AS low FROM per GROUP BY band""")
def d34_length_bands(spark, sf):
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("entity", F.col("o_custkey"))
    band = F.when(F.col("c_acctbal") < 0, "a").when(F.col("c_acctbal") < 5000, "b").otherwise("c")
    return _rounded(V.band_report(rows, band, "o_totalprice"), 4, "mean", "low")


@query(f"""WITH RECURSIVE {CLOSURE}, {_STREAMS}, reach AS (SELECT DISTINCT entity, ancestor AS term FROM a JOIN closure USING (term)), x AS (SELECT b.entity, b.term, r.entity IS NOT NULL AS i, t.entity IS NOT NULL AS y FROM b LEFT JOIN reach r ON r.entity = b.entity AND r.term = b.term LEFT JOIN truth t ON t.entity = b.entity AND t.term = b.term LEFT JOIN a ON a.entity = b.entity AND a.term = b.term WHERE a.entity IS NULL)
SELECT CASE WHEN i THEN 'inside' ELSE 'outside' END AS arm, count(*) AS n, count(*) FILTER (y) AS right FROM x GROUP BY ALL""")
def d37_extras_partition(spark, sf):
    g = graph(spark, sf)
    if g is None:
        return V.partition_extras(*streams(spark, sf), closure(spark, sf), truth(spark, sf))
    return L.partition_extras(candidates(spark, sf).select("entity", "term", F.col("stream").isin(1, 2).alias("pool"), F.col("stream").isin(2, 3).alias("extra"), (F.col("label") == 1).alias("true")), g)


@query("SELECT lang AS category, count(*) AS n, count(*) FILTER (t) AS covered, count(*) FILTER (t AND d < TIMESTAMP '2024-01-20') AS before, max(d) FILTER (t) AS latest FROM (SELECT lang, coalesce(length(text) > 600, false) AS t, DATE '2024-01-01' + CAST(doc_id % 31 AS INTEGER) AS d0, CAST(DATE '2024-01-01' + CAST(doc_id % 31 AS INTEGER) AS TIMESTAMP) AS d FROM documents) GROUP BY lang")
def d41_text_coverage(spark, sf):
    docs = read(spark, sf, "documents").withColumn("day", F.expr("cast(date_add(date '2024-01-01', int(doc_id % 31)) as timestamp_ntz)"))
    return V.text_coverage(docs, "lang", F.coalesce(F.length("text") > 600, F.lit(False)), "day", "2024-01-20")


@query(f"""WITH {CAND}, x AS (SELECT entity, term, max(score) AS score, max(CASE WHEN source % 3 = 0 THEN greatest(score2, 0) ELSE 0 END)::DOUBLE AS text FROM cand GROUP BY ALL), r AS (SELECT *, max((text > 0)::INTEGER) OVER w AS has_text, (rank() OVER (PARTITION BY entity ORDER BY text) + (count(*) OVER (PARTITION BY entity, text) - 1) / 2) / count(*) OVER w AS t, (rank() OVER (PARTITION BY entity ORDER BY score) + (count(*) OVER (PARTITION BY entity, score) - 1) / 2) / count(*) OVER w AS s, row_number() OVER (PARTITION BY entity ORDER BY text DESC, term) AS k FROM x WINDOW w AS (PARTITION BY entity))
SELECT entity, term, has_text, round(s, 9) AS score_pct, round(CASE WHEN has_text = 1 THEN t ELSE 0 END, 9) AS text_pct, round(CASE WHEN has_text = 1 THEN t - s ELSE 0 END, 9) AS rank_gap, (has_text = 1 AND k <= 1)::INTEGER AS top1, (has_text = 1 AND k <= 3)::INTEGER AS top3, (has_text = 1 AND k <= 5)::INTEGER AS top5 FROM r""")
def e04_text_ranks(spark, sf):
    x = candidates(spark, sf).groupBy("entity", "term").agg(F.max("score").alias("score"), F.max(F.when(F.col("source") % 3 == 0, F.greatest("score2", F.lit(0.0))).otherwise(0.0)).alias("text"))
    out = V.text_ranks(x, "score", "text").select("entity", "term", "has_text", "score_pct", "text_pct", "rank_gap", "top1", "top3", "top5")
    return _rounded(out, 9, "score_pct", "text_pct", "rank_gap")


@query(f"""WITH RECURSIVE {IA}, terms AS (SELECT p_partkey AS term FROM part WHERE p_size >= 10), known AS (SELECT DISTINCT entity, term FROM cand WHERE snapshot = 1993), own AS (SELECT term, ia, CASE WHEN term % 3 = 0 THEN 'x' WHEN term % 3 = 1 THEN 'y' ELSE 'z' END AS grp FROM ia),
p AS (SELECT * FROM pairs WHERE term IN (SELECT term FROM terms) AND (entity, term) NOT IN (SELECT entity, term FROM known)), t AS (SELECT * FROM closed WHERE term IN (SELECT term FROM terms) AND (entity, term) NOT IN (SELECT entity, term FROM known)),
b AS (SELECT grp, least(50, greatest(0, floor(score * 50)))::INTEGER AS bin, sum(ia) AS n, sum(CASE WHEN t.entity IS NULL THEN 0 ELSE ia END) AS tp FROM p JOIN own USING (term) LEFT JOIN t ON t.entity = p.entity AND t.term = p.term GROUP BY ALL), w AS (SELECT grp, sum(ia) AS wanted FROM t JOIN own USING (term) GROUP BY ALL),
s AS (SELECT grp, sum(n) OVER d AS n, sum(tp) OVER d AS tp, wanted FROM b JOIN w USING (grp) WINDOW d AS (PARTITION BY grp ORDER BY bin DESC)), f AS (SELECT grp, max(CASE WHEN tp > 0 THEN 2 * tp / (n + wanted) ELSE 0 END) AS f FROM s GROUP BY grp)
SELECT grp, round(f, 9) AS f FROM (SELECT * FROM f UNION ALL SELECT 'mean', avg(f) FROM f)""")
def i04_official_options(spark, sf):
    g, grp = graph(spark, sf), F.when(F.col("term") % 3 == 0, "x").when(F.col("term") % 3 == 1, "y").otherwise("z").alias("grp")
    terms = read(spark, sf, "part").where("p_size >= 10").select(F.col("p_partkey").alias("term"))
    if g is None:
        p, known = all_pairs(spark, sf), candidates(spark, sf).where("snapshot = 1993").select("entity", "term").distinct()
        closed = O.entity_closure(p.where("label = 1"), closure(spark, sf))
        ia = O.information_accretion(closed, edges(spark, sf))
        return _rounded(V.option_scores(p, closed, ia, ia.select("term", grp), terms, known), 9, "f")
    rows = candidates(spark, sf).groupBy("entity", "term").agg(F.max("score").alias("score"), F.max("label").alias("label"), F.max(F.coalesce(F.col("snapshot") == 1993, F.lit(False))).alias("known"))
    weights, pairs = L.option_parts(rows.withColumn("bin", M.bin_of(F.col("score"), 50)), g)
    own = materialise(weights.join(terms, "term", "left_semi").select("term", grp, "ia", "wanted"), "own")
    bins = pairs.join(own, "term").groupBy("grp", "bin").agg(F.sum(F.col("ia") * F.col("c")).alias("n"), F.sum(F.col("ia") * F.col("y")).alias("tp"))
    wanted = own.where("wanted > 0").groupBy("grp").agg(F.sum(F.col("ia") * F.col("wanted")).alias("wanted"))
    return _rounded(V.best_options(bins, wanted), 9, "f")


_FMAX = """cw AS (SELECT resample, entity, weight FROM w WHERE weight > 0), tr AS (SELECT resample, sum(weight * y) AS t FROM w WHERE weight > 0 GROUP BY ALL), wt AS (SELECT entity, sum(label) AS wanted FROM x GROUP BY ALL),
bn AS (SELECT entity, arm, least(50, greatest(0, floor(CASE WHEN arm = 'a' THEN score ELSE score2 END * 50)))::INTEGER AS bin, label FROM x, (VALUES ('a'), ('b')) v(arm)), bs AS (SELECT entity, arm, bin, count(*) AS n, sum(label) AS y FROM bn GROUP BY ALL), levels AS (SELECT DISTINCT arm, bin AS level FROM bs),
cum AS (SELECT entity, arm, bin, sum(n) OVER d AS n, sum(y) OVER d AS tp, coalesce(lag(bin) OVER d, 1000) AS upto FROM bs WINDOW d AS (PARTITION BY entity, arm ORDER BY bin DESC)), nxt AS (SELECT *, coalesce(lead(bin) OVER (PARTITION BY entity, arm ORDER BY bin DESC), -1) AS below FROM cum),
att AS (SELECT l.arm, l.level, n.entity, n.tp / n.n AS p, CASE WHEN wanted > 0 THEN n.tp / wanted ELSE 0 END AS r FROM levels l JOIN nxt n ON n.arm = l.arm AND n.bin >= l.level AND n.below < l.level JOIN wt USING (entity)),
m AS (SELECT resample, arm, level, sum(weight * p) / sum(weight) AS p, sum(weight * r) / any_value(t) AS r FROM att JOIN cw USING (entity) JOIN tr USING (resample) GROUP BY ALL), fm AS (SELECT resample, arm, max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f FROM m GROUP BY ALL), d AS (SELECT round(max(f) FILTER (arm = 'a') - max(f) FILTER (arm = 'b'), 12) AS d FROM fm GROUP BY resample)"""


@query(f"""WITH {CAND}, x AS (SELECT source AS entity, score, score2, label FROM cand), ent AS (SELECT entity, max(label) AS y FROM x GROUP BY ALL), {_weights('j', 'ent', 30)}, {_FMAX}
SELECT round(avg(d), 7) AS mean, round(quantile_cont(d, 0.025), 7) AS low, round(quantile_cont(d, 0.975), 7) AS high, avg((d <= 0)::INTEGER) AS p FROM d""")
def j01_fmax_bootstrap(spark, sf):
    rows = candidates(spark, sf).select(F.col("source").alias("entity"), "score", "score2", "label")
    return _rounded(J.fmax_difference(rows, "score", "score2", 30, "j"), 7, "mean", "low", "high")


@query(f"""WITH r AS (SELECT o_orderpriority AS cell, month(o_orderdate)::INTEGER AS seed, avg(o_totalprice) AS a, avg(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1.02 ELSE 0.97 END) AS b FROM orders GROUP BY ALL), e AS (SELECT *, cell || '|' || seed AS entity FROM r), {_weights('s', 'e', 100)}, d AS (SELECT cell, resample, sum(weight * (a - b)) / sum(weight) AS d FROM w WHERE weight > 0 GROUP BY ALL),
i AS (SELECT cell, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d GROUP BY cell) SELECT cell, round((SELECT avg(a - b) FROM r WHERE r.cell = i.cell), 4) AS mean, round(low, 4) AS low, round(high, 4) AS high, low > 0 OR high < 0 AS significant FROM i""")
def j04_seed_intervals(spark, sf):
    o = read(spark, sf, "orders")
    r = o.groupBy(F.col("o_orderpriority").alias("cell"), F.month("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("a"), F.avg(F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", 1.02).otherwise(0.97)).alias("b"))
    return _rounded(J.seed_intervals(r, "cell", "a", "b", 100, "s"), 4, "mean", "low", "high")


def _arm(seed: str, where: str, name: str) -> str:
    w = _weights(f"i{seed}", f"e{seed}", 50).replace("rs AS", f"rs{seed} AS").replace("w AS", f"w{seed} AS").replace("FROM rs)", f"FROM rs{seed})")
    return f"e{seed} AS (SELECT o_custkey AS entity, avg(o_totalprice) AS value FROM orders WHERE {where} GROUP BY ALL), {w}, {name} AS (SELECT resample, sum(weight * value) / sum(weight) AS v FROM w{seed} WHERE weight > 0 GROUP BY ALL)"


@query(f"""WITH {_arm('a', "o_orderstatus = 'F'", 'ma')}, {_arm('b', "o_orderstatus <> 'F'", 'mb')}, d AS (SELECT ma.v AS a, mb.v AS b, ma.v - mb.v AS difference FROM ma JOIN mb USING (resample)), l AS (UNPIVOT d ON a, b, difference INTO NAME arm VALUE v)
SELECT arm, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM l GROUP BY arm""")
def j06_independent_arms(spark, sf):
    arm = lambda where: read(spark, sf, "orders").where(where).groupBy(F.col("o_custkey").alias("entity")).agg(F.avg("o_totalprice").alias("value"))
    return _rounded(J.independent_arms(arm("o_orderstatus = 'F'"), arm("o_orderstatus <> 'F'"), 50, "i"), 4, "mean", "low", "high")
