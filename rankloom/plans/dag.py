"""Queries of the ontology operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import lifting as L
from rankloom.operators import ontology as O

from .registry import query
from .tables import CLOSURE, EDGES, PAIRS, accretion, candidates, all_pairs, closure, counts, edges, graph, nodes, positives

_NODES = "nodes AS (SELECT p_partkey AS term FROM part)"


@query(f"WITH RECURSIVE {CLOSURE} SELECT term, ancestor FROM closure")
def g01_ancestor_closure(spark, sf):
    return closure(spark, sf)


@query(f"WITH RECURSIVE {CLOSURE}, {PAIRS} SELECT DISTINCT entity, ancestor AS term FROM pairs JOIN closure USING (term) WHERE label = 1")
def g02_entity_closure(spark, sf):
    g = graph(spark, sf)
    return O.entity_closure(positives(spark, sf), closure(spark, sf)) if g is None else L.closed(positives(spark, sf), g)


@query(f"""WITH RECURSIVE {EDGES}, walk AS (SELECT p_partkey AS term, 0 AS depth FROM part WHERE p_partkey NOT IN (SELECT child FROM edges)
UNION SELECT child, depth + 1 FROM walk JOIN edges ON term = parent) SELECT term, min(depth) AS shortest, max(depth) AS longest FROM walk GROUP BY term""")
def g03_roots_and_depths(spark, sf):
    e, n = edges(spark, sf), nodes(spark, sf)
    return O.depths(e, n).withColumnRenamed("depth", "shortest").join(O.depths(e, n, longest=True).withColumnRenamed("depth", "longest"), "term")


@query(f"""WITH RECURSIVE {CLOSURE}, {PAIRS}, up AS (SELECT DISTINCT entity, ancestor FROM pairs JOIN closure USING (term) WHERE label = 1)
SELECT p.entity, p.term, greatest(p.label, CAST(u.ancestor IS NOT NULL AS INTEGER)) AS label, CAST(p.label = 0 AND u.ancestor IS NOT NULL AS INTEGER) AS promoted
FROM pairs p LEFT JOIN up u ON p.entity = u.entity AND p.term = u.ancestor""")
def g04_label_propagation(spark, sf):
    g = graph(spark, sf)
    out = O.label_propagation(all_pairs(spark, sf), closure(spark, sf)) if g is None else L.label_propagation(all_pairs(spark, sf), g)
    return out.select("entity", "term", "label", "promoted")


# the largest score at or below over present chains equals the fixpoint of raising parents along present edges
_CHAIN = f"""{EDGES}, {PAIRS}, chain AS (SELECT entity, term, term AS top, score FROM pairs
UNION SELECT c.entity, c.term, e.parent, c.score FROM chain c JOIN edges e ON e.child = c.top JOIN pairs p ON p.entity = c.entity AND p.term = e.parent)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT entity, top AS term, max(score) AS score FROM chain GROUP BY ALL")
def g05_consistency(spark, sf):
    return O.consistency(all_pairs(spark, sf), edges(spark, sf))[0]


@query(f"""WITH {EDGES}, {PAIRS} SELECT count(*) AS checked, sum(CAST(a.score > b.score AS BIGINT))::BIGINT AS violated FROM pairs a JOIN edges e ON a.term = e.child
JOIN pairs b ON b.entity = a.entity AND b.term = e.parent""")
def g06_violations(spark, sf):
    return O.violations(all_pairs(spark, sf), edges(spark, sf))


@query(f"WITH RECURSIVE {CLOSURE}, {PAIRS} SELECT entity, ancestor AS term, max(score) AS score FROM pairs JOIN closure USING (term) WHERE ancestor > 1 GROUP BY ALL")
def g07_fill_propagation(spark, sf):
    g = graph(spark, sf)
    if g is None:
        return O.fill_propagation(all_pairs(spark, sf), closure(spark, sf), O.roots(edges(spark, sf), nodes(spark, sf)))
    return L.filled(candidates(spark, sf), g, g.roots())


@query(f"""WITH RECURSIVE {_CHAIN}, up AS (SELECT entity, top AS term, max(score) AS hi FROM chain GROUP BY ALL),
down AS (SELECT c.entity, c.term, min(p.score) AS lo FROM chain c JOIN pairs p ON p.entity = c.entity AND p.term = c.top GROUP BY ALL),
mixed AS (SELECT entity, term, 0.7::DOUBLE * hi + (1 - 0.7::DOUBLE) * lo AS score FROM up JOIN down USING (entity, term))
SELECT c.entity, c.top AS term, round(max(m.score), 9) AS score FROM chain c JOIN mixed m ON m.entity = c.entity AND m.term = c.term GROUP BY ALL""")
def g08_soft_propagation(spark, sf):
    return O.soft_propagation(all_pairs(spark, sf), edges(spark, sf)).withColumn("score", F.round("score", 9))


@query(f"""WITH {EDGES}, {PAIRS}, best AS (SELECT a.entity, a.term, max(b.label) AS s FROM pairs a JOIN edges e ON a.term = e.child JOIN pairs b ON b.entity = a.entity AND b.term = e.parent GROUP BY ALL)
SELECT entity, term, (s IS NULL OR s > 0) AS trainable FROM pairs LEFT JOIN best USING (entity, term)""")
def g10_training_mask(spark, sf):
    return O.training_mask(all_pairs(spark, sf), edges(spark, sf)).select("entity", "term", "trainable")


@query(f"""WITH RECURSIVE {CLOSURE}, {PAIRS}, known AS (SELECT entity, term FROM pairs WHERE label = 1),
fresh AS (SELECT entity, term FROM pairs WHERE label = 0), hit AS (SELECT DISTINCT f.entity, f.term FROM fresh f JOIN closure c ON c.term = f.term AND c.ancestor <> c.term JOIN known k ON k.entity = f.entity AND k.term = c.ancestor)
SELECT f.entity, f.term, CAST(h.term IS NOT NULL AS INTEGER) AS below_known FROM fresh f LEFT JOIN hit h USING (entity, term)""")
def g13_descendant_prior(spark, sf):
    p = all_pairs(spark, sf)
    return O.descendant_prior(p, p.where("label = 1"), closure(spark, sf)).select("entity", "term", "below_known")


@query(f"""WITH RECURSIVE {CLOSURE}, {PAIRS}, known AS (SELECT DISTINCT entity, ancestor FROM pairs JOIN closure USING (term) WHERE label = 1),
nk AS (SELECT entity, count(*) AS n FROM known GROUP BY ALL), own AS (SELECT term, count(*) AS n FROM closure GROUP BY ALL),
b AS (SELECT p.entity, p.term, count(*) AS n FROM pairs p JOIN closure c USING (term) JOIN known k ON k.entity = p.entity AND k.ancestor = c.ancestor GROUP BY ALL)
SELECT p.entity, p.term, round(coalesce(b.n, 0) / (own.n + coalesce(nk.n, 0) - coalesce(b.n, 0)), 9) AS proximity FROM pairs p JOIN own USING (term) LEFT JOIN nk USING (entity) LEFT JOIN b ON b.entity = p.entity AND b.term = p.term""")
def g14_dag_proximity(spark, sf):
    p, g = all_pairs(spark, sf), graph(spark, sf)
    out = O.dag_proximity(p, p.where("label = 1"), closure(spark, sf)) if g is None else L.dag_proximity(p, g)
    return out.select("entity", "term", F.round("proximity", 9).alias("proximity"))


@query(f"""WITH {EDGES}, {PAIRS}, one AS (SELECT p.entity, e.child AS term, max(p.score) AS score, 1 AS k FROM pairs p JOIN edges e ON e.parent = p.term WHERE p.score >= 0.9 GROUP BY ALL),
two AS (SELECT o.entity, e.child AS term, max(o.score) AS score, 2 AS k FROM one o JOIN edges e ON e.parent = o.term GROUP BY ALL)
SELECT entity, term, max(score) AS score, min(k) AS k FROM (FROM one UNION ALL FROM two) x WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.entity = x.entity AND p.term = x.term) GROUP BY ALL""")
def g15_descent(spark, sf):
    return O.descend(all_pairs(spark, sf), edges(spark, sf), 0.9, 2)


@query(f"WITH {EDGES}, {PAIRS} SELECT child, parent FROM edges WHERE child IN (SELECT term FROM pairs WHERE label = 1) AND parent IN (SELECT term FROM pairs WHERE label = 1)")
def g16_induced_edges(spark, sf):
    return O.induced_edges(edges(spark, sf), all_pairs(spark, sf).where("label = 1"))


_ABOVE = """m AS (SELECT p.entity, p.term, avg(q.score) AS mean, min(q.score) AS least FROM pairs p JOIN closure c ON c.term = p.term AND c.ancestor <> c.term JOIN pairs q ON q.entity = p.entity AND q.term = c.ancestor GROUP BY ALL)"""


@query(f"WITH RECURSIVE {CLOSURE}, {PAIRS}, {_ABOVE} SELECT p.entity, p.term, round(coalesce(0.7::DOUBLE * p.score + 0.3::DOUBLE * m.mean, p.score), 9) AS score FROM pairs p LEFT JOIN m USING (entity, term)")
def g17_smoothing(spark, sf):
    g = graph(spark, sf)
    out = O.smooth(all_pairs(spark, sf), closure(spark, sf)) if g is None else L.smooth(all_pairs(spark, sf), g)
    return out.select("entity", "term", F.round("score", 9).alias("score"))


@query(f"WITH RECURSIVE {CLOSURE}, {PAIRS}, {_ABOVE} SELECT p.entity, p.term, least(p.score, coalesce(m.least, p.score)) AS score FROM pairs p LEFT JOIN m USING (entity, term)")
def g18_downward_cap(spark, sf):
    return O.cap_downward(all_pairs(spark, sf), closure(spark, sf)).select("entity", "term", "score")


@query(f"""WITH {EDGES}, {PAIRS}, m AS (SELECT p.entity, p.term, avg(q.score) AS mean FROM pairs p JOIN edges e ON e.child = p.term JOIN pairs q ON q.entity = p.entity AND q.term = e.parent GROUP BY ALL)
SELECT p.entity, p.term, round(coalesce(p.score * sqrt(m.mean), p.score), 9) AS score FROM pairs p LEFT JOIN m USING (entity, term)""")
def g19_parent_factor(spark, sf):
    return O.parent_factor(all_pairs(spark, sf), edges(spark, sf)).select("entity", "term", F.round("score", 9).alias("score"))


_CLOSED = f"""{CLOSURE}, {PAIRS}, closed AS (SELECT DISTINCT entity, ancestor AS term FROM pairs JOIN closure USING (term) WHERE label = 1), n AS (SELECT term, count(*) AS n FROM closed GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_CLOSED} SELECT term, n, CASE WHEN n >= (SELECT max(n) FROM n) THEN 0.0 ELSE round(-ln(n / (SELECT max(n) FROM n)), 9) END::DOUBLE AS ic FROM n")
def d04_information_content(spark, sf):
    return O.content(counts(spark, sf)).withColumn("ic", F.round("ic", 9))


IA = f"""{_CLOSED}, np AS (SELECT child, count(*) AS k FROM edges GROUP BY ALL),
m AS (SELECT child AS term, count(*) AS m FROM (SELECT c.entity, e.child, count(*) AS held FROM closed c JOIN edges e ON e.parent = c.term GROUP BY ALL) JOIN np USING (child) WHERE held = k GROUP BY ALL),
ia AS (SELECT term, CASE WHEN m IS NULL THEN 0.0 ELSE greatest(0.0, -log2(n / m)) END::DOUBLE AS ia FROM n LEFT JOIN m USING (term))"""


@query(f"WITH RECURSIVE {IA} SELECT term, round(ia, 9) AS ia FROM ia")
def d05_information_accretion(spark, sf):
    return accretion(spark, sf).withColumn("ia", F.round("ia", 9))


@query(f"WITH RECURSIVE {_CLOSED} SELECT term, n FROM n WHERE n >= 20")
def d06_supported_vocabulary(spark, sf):
    return counts(spark, sf).where("n >= 20")


@query(f"""WITH RECURSIVE {CLOSURE}, {PAIRS}, filled AS (SELECT entity, ancestor AS term, max(score) AS score FROM pairs JOIN closure USING (term) GROUP BY ALL)
SELECT p.entity, p.term, f.score FROM pairs p JOIN filled f USING (entity, term)""")
def g12_present_propagation(spark, sf):
    p, g = all_pairs(spark, sf), graph(spark, sf)
    if g is not None:
        return L.filled(candidates(spark, sf), g, present=True)
    return O.fill_propagation(p, closure(spark, sf)).join(p.select("entity", "term"), ["entity", "term"], "left_semi")


@query(f"""WITH {EDGES}, {PAIRS.replace("pairs AS", "unused AS")}, c AS (SELECT s.category AS cell, s.entity, s.term, max(s.label) AS label FROM cand s GROUP BY ALL)
SELECT cell, count(*) AS rows, sum(label)::BIGINT AS positives, count(DISTINCT entity) AS entities FROM c GROUP BY cell""")
def d03_candidate_table(spark, sf):
    c = candidates(spark, sf).groupBy(F.col("category").alias("cell"), "entity", "term").agg(F.max("label").alias("label"))
    return c.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("label").alias("positives"), F.countDistinct("entity").alias("entities"))
