"""Queries of set algebra, global cuts and pools against truth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators import lifting as L
from rankloom.operators import ontology as O
from rankloom.operators import retrieval as R
from rankloom.operators import sets as Z

from .blending import _STREAMS, streams, truth
from .dag import IA
from .registry import query
from .similarity import _KNN, _NET, _PPMI, incidence, vectors
from .tables import CAND, CLOSURE, PAIRS, accretion, candidates, all_pairs, closure, edges, graph, read


@query(f"WITH {_STREAMS} SELECT entity, term FROM u")
def f01_union(spark, sf):
    return Z.union(*streams(spark, sf))


@query(f"WITH {_STREAMS} SELECT entity, term FROM u WHERE b IS NULL AND (entity, term) NOT IN (SELECT entity, term FROM truth)")
def f02_difference(spark, sf):
    a, b = streams(spark, sf)
    return Z.difference(a, b, truth(spark, sf))


@query(f"WITH {_STREAMS} SELECT entity, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*), 9) AS jaccard FROM u GROUP BY entity")
def f03_jaccard(spark, sf):
    return Z.jaccard(*streams(spark, sf)).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {_STREAMS} SELECT t.entity, round(avg((a.entity IS NOT NULL)::INTEGER), 9) AS coverage FROM truth t LEFT JOIN a ON a.entity = t.entity AND a.term = t.term GROUP BY t.entity")
def f04_containment(spark, sf):
    return Z.containment(streams(spark, sf)[0], truth(spark, sf)).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {_STREAMS} SELECT u.entity, u.term, u.a FROM u WHERE a IS NOT NULL AND (entity, term) NOT IN (SELECT entity, term FROM truth)")
def c04_known_exclusion(spark, sf):
    a, _ = streams(spark, sf)
    return a.join(truth(spark, sf), ["entity", "term"], "left_anti").withColumnRenamed("score", "a")


@query(f"WITH {_STREAMS} SELECT u.entity, u.term, u.a AS score, u.b AS predicted FROM u WHERE a IS NOT NULL")
def c16_alignment(spark, sf):
    a, b = streams(spark, sf)
    return Z.align(b, a)


@query(f"WITH {CAND} SELECT category, snapshot, count(DISTINCT term) AS terms, count(DISTINCT entity) AS entities FROM cand GROUP BY ALL")
def d02_cells(spark, sf):
    return candidates(spark, sf).groupBy("category", "snapshot").agg(F.countDistinct("term").alias("terms"), F.countDistinct("entity").alias("entities"))


@query(f"WITH {PAIRS} SELECT entity, term, score FROM pairs ORDER BY score DESC, entity, term LIMIT (SELECT floor(count(*) * 0.1::DOUBLE)::BIGINT FROM pairs)")
def e16_score_fraction(spark, sf):
    return Z.top_fraction(all_pairs(spark, sf), 0.1, ["entity", "term"]).select("entity", "term", "score")


@query(f"WITH {PAIRS} SELECT entity, term FROM pairs WHERE label = 0 ORDER BY score DESC, entity, term LIMIT 500")
def e17_top_volume(spark, sf):
    return all_pairs(spark, sf).where("label = 0").orderBy(F.desc("score"), "entity", "term").limit(500).select("entity", "term")


_R2 = f"""{CAND}, x AS (SELECT entity, term, max(score) AS a, max(score2) AS b, max(label) AS label FROM cand GROUP BY ALL), r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x)"""


def two_scores(spark, sf):
    c = candidates(spark, sf)
    return c.groupBy("entity", "term").agg(F.max("score").alias("a"), F.max("score2").alias("b"), F.max("label").alias("label"))


@query(f"WITH {_R2} SELECT entity, term, round((ra + rb) / (2 * n), 9) AS blended FROM r")
def e22_average_rank(spark, sf):
    return Z.average_rank_blend(two_scores(spark, sf), "a", "b").select("entity", "term", F.round("blended", 9).alias("blended"))


@query(f"WITH {_R2} SELECT sum(label)::BIGINT AS hits, count(*) FILTER (label = 1 AND ra <= 0.5 * n AND rb >= 0.75 * n) AS recovered FROM r")
def e19_orthogonal_recovery(spark, sf):
    return Z.orthogonal_recovery(two_scores(spark, sf), "a", "b")


@query(f"""WITH RECURSIVE {IA}, reach AS (SELECT DISTINCT entity, ancestor AS term FROM pairs JOIN closure USING (term) WHERE score >= 0.5), t AS (SELECT c.entity, c.term, coalesce(ia, 0) AS w, r.entity IS NOT NULL AS y FROM closed c LEFT JOIN ia ON ia.term = c.term LEFT JOIN reach r ON r.entity = c.entity AND r.term = c.term)
SELECT round(coalesce(sum(w) FILTER (y), 0), 6) AS captured, round(coalesce(sum(w) FILTER (NOT y), 0), 6) AS missed FROM t""")
def d26_pool_ceiling(spark, sf):
    g = graph(spark, sf)
    if g is None:
        p, over = all_pairs(spark, sf), closure(spark, sf)
        out = Z.pool_ceiling(p.where("score >= 0.5"), O.entity_closure(p.where("label = 1"), over), accretion(spark, sf), over)
    else:
        out = L.pool_ceiling(candidates(spark, sf).withColumn("pool", F.col("score") >= 0.5), g)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH RECURSIVE {IA}, prop AS (SELECT entity, term, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS rank FROM pairs WHERE score < 0.5), have AS (SELECT DISTINCT entity, ancestor AS term FROM pairs JOIN closure USING (term) WHERE score >= 0.5),
f AS (SELECT p.entity, c.ancestor AS term, min(rank) AS rank FROM prop p JOIN closure c ON c.term = p.term GROUP BY ALL), g AS (SELECT f.*, coalesce(ia, 0) AS w, t.entity IS NOT NULL AS y FROM f LEFT JOIN ia ON ia.term = f.term LEFT JOIN closed t ON t.entity = f.entity AND t.term = f.term WHERE (f.entity, f.term) NOT IN (SELECT entity, term FROM have))
SELECT k, round(coalesce(sum(w) FILTER (y), 0), 6) AS true_mass, round(coalesce(sum(w) FILTER (NOT y), 0), 6) AS false_mass FROM g, (VALUES (1), (2), (3)) v(k) WHERE rank <= k GROUP BY k""")
def d27_generation_gain(spark, sf):
    from rankloom.operators.staging import top_n

    p, g = all_pairs(spark, sf), graph(spark, sf)
    if g is None:
        over = closure(spark, sf)
        out = Z.generation_gain(top_n(p.where("score < 0.5"), 10**6).select("entity", "term", "rank"), p.where("score >= 0.5"), O.entity_closure(p.where("label = 1"), over), accretion(spark, sf), over, [1, 2, 3])
    else:
        rank = F.row_number().over(Window.partitionBy("entity", F.col("score") < 0.5).orderBy(F.desc("score"), "term"))
        ranked = p.repartition("entity").withColumns({"pool": F.col("score") >= 0.5, "rank": F.when(F.col("score") < 0.5, rank)})
        out = L.generation_gain(ranked, g, [1, 2, 3])
    return out.select("k", F.round("true_mass", 6).alias("true_mass"), F.round("false_mass", 6).alias("false_mass"))


@query(f"""WITH {_STREAMS}, na AS (SELECT entity, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT entity, count(*) AS n FROM b GROUP BY ALL), room AS (SELECT entity, least(na.n, nb.n) AS room FROM na JOIN nb USING (entity)),
ka AS (SELECT entity, term FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS k FROM a) JOIN room USING (entity) WHERE k <= room), kb AS (SELECT entity, term FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS k FROM b) JOIN room USING (entity) WHERE k <= room),
m AS (SELECT entity, term, x IS NOT NULL AS x, y IS NOT NULL AS y FROM (SELECT *, 1 AS x FROM ka) FULL JOIN (SELECT *, 1 AS y FROM kb) USING (entity, term) JOIN truth USING (entity, term))
SELECT count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (y AND NOT x) AS only_b, count(*) FILTER (x AND y) AS both FROM m""")
def d38_matched_budget(spark, sf):
    return Z.matched_budget(*streams(spark, sf), truth(spark, sf))


@query(f"""WITH RECURSIVE {IA}, v AS (SELECT DISTINCT term FROM pairs WHERE label = 1), x AS (SELECT p.*, coalesce(ia, 0) AS w, (v.term IS NOT NULL)::INTEGER AS y FROM pairs p LEFT JOIN v USING (term) LEFT JOIN ia USING (term) WHERE p.label = 0)
SELECT count(*) AS pairs, sum(y)::BIGINT AS covered, round(avg(y), 9) AS share, round(sum(w * y) / sum(w), 9) AS weighted FROM x""")
def d39_vocabulary_coverage(spark, sf):
    p = all_pairs(spark, sf)
    out = Z.vocabulary_coverage(p.where("label = 0"), p.where("label = 1"), accretion(spark, sf))
    return out.select("pairs", "covered", F.round("share", 9).alias("share"), F.round("weighted", 9).alias("weighted"))


@query(f"""WITH {_KNN}, l AS (SELECT id, label FROM v), r AS (SELECT DISTINCT query AS entity, label AS term FROM k), m AS (SELECT r.entity, r.term, k.cosine, (k.label = r.term) AS y, row_number() OVER (PARTITION BY r.entity, r.term, (k.label = r.term) ORDER BY k.cosine DESC, k.reference) AS j FROM r JOIN k ON k.query = r.entity)
SELECT entity, term, round(avg(cosine) FILTER (y), 6) AS with_term, round(avg(cosine) FILTER (NOT y), 6) AS without_term FROM m WHERE j <= 2 GROUP BY ALL""")
def h20_exemplars(spark, sf):
    v = vectors(spark, sf)
    n = R.nearest(v, v, 5)
    ann = v.select(F.col("id").alias("entity"), F.col("label").alias("term"))
    rows = n.join(ann.withColumnRenamed("entity", "reference"), "reference").select(F.col("query").alias("entity"), "term")
    out = Z.exemplars(n, ann, rows, 2)
    return out.select("entity", "term", F.round("with_term", 6).alias("with_term"), F.round("without_term", 6).alias("without_term"))


@query(f"""WITH RECURSIVE {CLOSURE}, o AS (SELECT DISTINCT l_orderkey AS entity, l_suppkey AS signature FROM lineitem), i AS (SELECT DISTINCT l_suppkey AS signature, l_partkey AS term FROM lineitem), n AS (SELECT entity, count(*) AS n FROM o GROUP BY ALL),
said AS (SELECT DISTINCT signature, ancestor AS term FROM i JOIN closure USING (term))
SELECT entity, term, round(count(*) / any_value(n.n), 9) AS support FROM o JOIN said USING (signature) JOIN n USING (entity) GROUP BY entity, term""")
def h28_graded_support(spark, sf):
    l = read(spark, sf, "lineitem")
    own = l.select(F.col("l_orderkey").alias("entity"), F.col("l_suppkey").alias("signature"))
    implies = l.select(F.col("l_suppkey").alias("signature"), F.col("l_partkey").alias("term")).distinct()
    return Z.graded_support(own, implies, closure(spark, sf)).withColumn("support", F.round("support", 9))


@query(f"""WITH {_NET}, e AS (SELECT a, b, max(c1) AS w FROM (SELECT a, b, c1 FROM net WHERE a <> b UNION ALL SELECT b, a, c1 FROM net WHERE a <> b) GROUP BY ALL), ann AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
SELECT a AS entity, count(*) AS degree, count(*) FILTER (w >= 600) AS strong, count(*) FILTER (b IN (SELECT s_suppkey FROM ann)) AS annotated FROM e GROUP BY a""")
def h34_network_features(spark, sf):
    net = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("a"), (F.col("o_custkey") % 100).alias("b"), (F.col("l_linenumber") * 100).alias("c1"))
    ann = read(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("entity"))
    return Z.network_features(net, "c1", 600, ann)


@query(f"""WITH {_PPMI}, {PAIRS}, known AS (SELECT entity, term FROM pairs WHERE label = 1 AND score >= 0.9), l AS (SELECT a, b, ppmi AS w FROM pp WHERE ppmi > 0 UNION ALL SELECT b, a, ppmi FROM pp WHERE ppmi > 0), t AS (SELECT a, sum(w) AS s FROM l GROUP BY ALL), one AS (SELECT entity, l.b AS a, sum(w) AS s FROM known JOIN l ON l.a = known.term GROUP BY ALL)
SELECT entity, l.b AS term, round(sum(one.s * l.w / t.s), 6) AS score FROM one JOIN l USING (a) JOIN t USING (a) GROUP BY ALL""")
def h33_two_hop(spark, sf):
    inc = incidence(spark, sf)
    links = R.ppmi(R.co_occurrence(inc), inc).select("a", "b", F.col("ppmi").alias("weight"))
    return Z.two_hop(all_pairs(spark, sf).where("label = 1 and score >= 0.9"), links).withColumn("score", F.round("score", 6))
