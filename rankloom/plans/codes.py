"""Queries of local codes, postings, pairs of entities and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.steps import materialise
from rankloom.operators import codes as C
from rankloom.operators import lifting as L
from rankloom.operators import ontology as O
from rankloom.operators import retrieval as R

from .dag import IA
from .registry import query
from .similarity import _VEC, vectors
from .staging import h, h60
from .tables import PAIRS, accretion, all_pairs, candidates, closure, edges, graph, nodes, read


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_UNITS = f"""{_VEC}, x AS (SELECT id, label, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS atom FROM v), t AS (SELECT label, id, atom, abs(value) AS x FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, atom) <= 8), u AS (SELECT label, count(*) AS units FROM v GROUP BY ALL)"""


@query(f"WITH {_UNITS}, r AS (SELECT label, atom, round(sum(x), 9) AS value FROM t GROUP BY ALL) SELECT label, atom::INTEGER AS atom, value, row_number() OVER (PARTITION BY label ORDER BY value DESC, atom)::INTEGER AS rank FROM r QUALIFY rank <= 6")
def d15_local_code(spark, sf):
    return _rounded(C.local_code(vectors(spark, sf), "label", "v", 8, 6), 9, "value")


@query(f"""WITH {_VEC}, x0 AS (SELECT id, label, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS atom FROM v), m AS (SELECT atom, avg(value) AS mean, stddev_pop(value) AS std FROM x0 GROUP BY ALL), x AS (SELECT id, label, atom, (value - mean) / CASE WHEN std > 0 THEN std ELSE 1 END AS value FROM x0 JOIN m USING (atom)),
t AS (SELECT label, id, atom, abs(value) AS x FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, atom) <= 8), r AS (SELECT label, atom, round(sum(x), 7) AS value FROM t GROUP BY ALL) SELECT label, atom::INTEGER AS atom, value, row_number() OVER (PARTITION BY label ORDER BY value DESC, atom)::INTEGER AS rank FROM r QUALIFY rank <= 6""")
def d15_standardised_code(spark, sf):
    v = vectors(spark, sf)
    return _rounded(C.local_code(C.standardised(v, "v", R.corpus_moments(v, "v")), "label", "v", 8, 6), 7, "value")


@query(f"WITH {_UNITS}, r AS (SELECT label, atom, count(*) AS votes, sum(x) AS mass FROM t GROUP BY ALL) SELECT label, atom::INTEGER AS atom, votes, round(mass, 9) AS mass FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY votes DESC, mass DESC, atom) <= 8")
def h12_chunk_bundle(spark, sf):
    return _rounded(C.chunk_bundle(vectors(spark, sf), "label", "v", 8), 9, "mass")


@query(f"WITH {_UNITS}, r AS (SELECT label, atom, count(*) / any_value(units) AS value FROM t JOIN u USING (label) GROUP BY ALL) SELECT label, atom::INTEGER AS atom, round(value, 9) AS value, row_number() OVER (PARTITION BY label ORDER BY value DESC, atom)::INTEGER AS rank FROM r QUALIFY rank <= 6")
def h13_union_code(spark, sf):
    return _rounded(C.local_code(vectors(spark, sf), "label", "v", 8, 6, "frequency"), 9, "value")


@query(f"""WITH {_UNITS}, a0 AS (SELECT label, atom, sum(x) AS s FROM t GROUP BY ALL), a AS (SELECT label, atom FROM a0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, atom) <= 6), m AS (SELECT label, atom, avg(value) AS s FROM x GROUP BY ALL), b AS (SELECT label, atom FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY abs(s) DESC, atom) <= 6)
SELECT coalesce(a.label, b.label) AS label, count(a.atom + b.atom)::BIGINT AS both, count(*) AS either, round(count(a.atom + b.atom) / count(*), 9) AS jaccard FROM a FULL JOIN b ON a.label = b.label AND a.atom = b.atom GROUP BY ALL""")
def h14_aggregation_orders(spark, sf):
    v = vectors(spark, sf)
    mean = C.weighted_mean(v, "label", "v", weighted=False).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p")).select("label", F.transform("p", lambda y: y["x"]).alias("v"))
    first = C.local_code(v, "label", "v", 8, 6).select("label", "atom")
    second = mean.select("label", F.explode(R.top_code("v", 6)).alias("c")).select("label", "c.atom")
    return _rounded(C.code_overlap(first, second, "label"), 9, "jaccard")


_SIGNED = f"""{_VEC}, x AS (SELECT id, label, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS atom FROM v), u AS (SELECT label, count(*) AS units FROM v GROUP BY ALL), t AS (SELECT label, id, atom, value FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY value DESC, atom) <= 8), h AS (SELECT label, atom, sum(value) / any_value(units) AS value, count(*) / any_value(units) AS frequency FROM t JOIN u USING (label) WHERE value <> 0 GROUP BY ALL),
m AS (SELECT label, atom, avg(value) AS value FROM x GROUP BY ALL), ats AS (SELECT label, atom, value FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY value DESC, atom) <= 6), sas AS (SELECT label, atom, value FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY value DESC, atom) <= 6)"""


@query(f"WITH {_SIGNED} SELECT label, atom::INTEGER AS atom, round(value, 9) AS value, round(frequency, 9) AS frequency FROM h")
def h14_usage_histogram(spark, sf):
    return _rounded(C.usage_histogram(vectors(spark, sf), "label", "v", 8), 9, "value", "frequency")


@query(f"""WITH {_SIGNED}, o AS (SELECT 'mean first' AS "order", label, atom FROM ats UNION ALL SELECT 'select first', label, atom FROM h UNION ALL SELECT 'three stages', label, atom FROM sas), n AS (SELECT "order", count(DISTINCT label) AS labels FROM o GROUP BY ALL)
SELECT "order", atom::INTEGER AS atom, count(*) AS n, round(count(*) / any_value(labels), 9) AS share FROM o JOIN n USING ("order") GROUP BY "order", atom""")
def h14_atom_selection(spark, sf):
    v = vectors(spark, sf)
    codes = {"mean first": C.aggregate_then_sparsify(v, "label", "v", 6), "select first": C.usage_histogram(v, "label", "v", 8), "three stages": C.sparsify_aggregate_sparsify(v, "label", "v", 8, 6)}
    return _rounded(C.atom_selection({n: c.withColumnRenamed("label", "entity") for n, c in codes.items()}), 9, "share")


@query(f"""WITH {_SIGNED}, s8 AS (SELECT label, atom FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY value DESC, atom) <= 8), m8 AS (SELECT label, atom FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY value DESC, atom) <= 8), b AS (SELECT label, count(*) AS b FROM s8 JOIN m8 USING (label, atom) GROUP BY ALL)
SELECT label, units, coalesce(b, 0) < 8 AS disagree FROM u LEFT JOIN b USING (label)""")
def h14_orders_disagree(spark, sf):
    return C.orders_disagree(vectors(spark, sf), "label", "v", 8)


@query(f"""WITH {_SIGNED.replace("<= 8", "<= 32")}, c AS (SELECT label, atom, value FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY value DESC, atom) <= 32), g AS (SELECT id, label, t.value * c.value AS value FROM t JOIN c USING (label, atom) WHERE t.value * c.value <> 0) SELECT id, label, count(*) AS support, round(sum(value), 9) AS mass FROM g GROUP BY ALL""")
def h14_gated_support(spark, sf):
    v = vectors(spark, sf)
    C.refuse_collapsing_gate(32, 64)
    return _rounded(C.gated(v, "id", "label", "v", 32, C.aggregate_then_sparsify(v, "label", "v", 32)).groupBy("id", "label").agg(F.count("*").alias("support"), F.sum("value").alias("mass")), 9, "mass")


@query(f"WITH {_VEC}, n AS (SELECT label, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM v) SELECT label, dim::INTEGER AS dim, round(sum(w * x) / sum(w), 9) AS x FROM n GROUP BY ALL")
def h16_norm_weighted_mean(spark, sf):
    return _rounded(C.weighted_mean(vectors(spark, sf), "label", "v"), 9, "x")


_CODES = f"""{_VEC}, x AS (SELECT id AS entity, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS atom FROM v), c AS (SELECT entity, atom, value FROM x QUALIFY row_number() OVER (PARTITION BY entity ORDER BY abs(value) DESC, atom) <= 4), n AS (SELECT count(DISTINCT entity) AS n FROM c), s AS (SELECT atom, count(*) AS k, count(*) / any_value(n.n) AS share, ln(any_value(n.n) / count(*)) AS idf FROM c, n GROUP BY atom)"""


def _codes(spark, sf):
    return vectors(spark, sf).select(F.col("id").alias("entity"), F.explode(R.top_code("v", 4)).alias("c")).select("entity", "c.atom", "c.value")


@query(f"WITH {_CODES} SELECT atom::INTEGER AS atom, k AS n, round(share, 9) AS share, round(idf, 9) AS idf, share > 0.07 AS heavy FROM s")
def d17_posting_shape(spark, sf):
    return _rounded(C.posting_shape(_codes(spark, sf), 0.07), 9, "share", "idf")


@query(f"""WITH {_CODES}, q AS (SELECT entity AS query, atom, value AS qv, row_number() OVER (PARTITION BY entity ORDER BY idf DESC, atom) AS k FROM c JOIN s USING (atom) WHERE entity % 50 = 0), m AS (SELECT query, entity, k, qv * value AS p FROM q JOIN c USING (atom) WHERE entity <> query),
f0 AS (SELECT query, entity, round(sum(p), 9) AS s, min(k) AS k FROM m GROUP BY query, entity), f AS (SELECT query, entity FROM f0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, entity) <= 5), g AS (SELECT query, entity FROM f0 WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, entity) <= 5),
r AS (SELECT f.query, avg((g.entity IS NOT NULL)::INTEGER) AS recall FROM f LEFT JOIN g ON g.query = f.query AND g.entity = f.entity GROUP BY ALL), t AS (SELECT query, count(*) FILTER (k <= 2) AS touched, count(*) AS full FROM m GROUP BY ALL) SELECT query, round(recall, 9) AS recall, touched, "full" FROM r JOIN t USING (query)""")
def h09_sparse_retrieval(spark, sf):
    codes = _codes(spark, sf)
    return _rounded(C.sparse_retrieval(codes.where("entity % 50 = 0"), codes, 5, 2), 9, "recall")


@query(f"""WITH {_VEC}, u AS (SELECT id, v[1:32] AS a, v[33:64] AS b, sqrt(list_dot_product(v[1:32], v[1:32])) AS na, sqrt(list_dot_product(v[33:64], v[33:64])) AS nb FROM v), c AS (SELECT q.id AS query, r.id AS reference, list_dot_product(q.a, r.a) / (q.na * r.na) + list_dot_product(q.b, r.b) / (q.nb * r.nb) AS cosine FROM u q JOIN u r ON q.id <> r.id)
SELECT query, reference, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY c.cosine DESC, reference)::INTEGER AS rank FROM c QUALIFY rank <= 3""")
def h05_multi_bank(spark, sf):
    v = vectors(spark, sf)
    return _rounded(C.multi_bank([v.select("id", F.slice("v", 1, 32).alias("v")), v.select("id", F.slice("v", 33, 32).alias("v"))], 3), 6, "cosine")


@query(f"WITH e AS (SELECT o_custkey AS entity, {h('half', 'CAST(o_custkey AS VARCHAR)')} % 2 AS x FROM orders GROUP BY ALL) SELECT entity, CASE WHEN x = 0 THEN 'fit' ELSE 'index' END AS part FROM e")
def e10_halves(spark, sf):
    return C.halves(read(spark, sf, "orders").select(F.col("o_custkey").alias("entity")), seed="half")


_PAIRED = f"""i AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS place FROM (SELECT DISTINCT o_custkey AS entity FROM orders)), p AS (SELECT DISTINCT i.entity AS a, j.entity AS b FROM i, (VALUES (1), (2), (3)) v(k), i j WHERE j.place = {h60('p', 'CAST(i.entity AS VARCHAR)', 'CAST(k AS VARCHAR)')} % (SELECT count(*) FROM i) AND j.entity <> i.entity)"""


def _paired(spark, sf):
    return C.sampled_pairs(read(spark, sf, "orders").select(F.col("o_custkey").alias("entity")), 3, "p")


@query(f"WITH {_PAIRED} SELECT a, b FROM p")
def e14_sampled_pairs(spark, sf):
    return _paired(spark, sf)


_SETS = "s AS (SELECT DISTINCT l_orderkey AS entity, l_partkey AS term FROM lineitem)"
_SUPPLIED = "s AS (SELECT DISTINCT l_suppkey AS entity, l_partkey % 97 AS term FROM lineitem)"


def _sets(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("term")).distinct()


@query(f"WITH {_SETS}, n AS (SELECT entity, count(*) AS n FROM s GROUP BY ALL), j AS (SELECT x.entity AS a, y.entity AS b, count(*) AS k FROM s x JOIN s y ON x.term = y.term AND x.entity < y.entity GROUP BY ALL) SELECT a, b, round(k / (p.n + q.n - k), 9) AS jaccard FROM j JOIN n p ON p.entity = a JOIN n q ON q.entity = b WHERE k / (p.n + q.n - k) >= 0.3")
def e14_neighbour_pairs(spark, sf):
    return _rounded(C.neighbour_pairs(_sets(spark, sf), 0.3), 9, "jaccard")


#: Sets of a label and a fifth of the ids: a neighbour of the same label, or the same fifth, is none.
@query(f"""WITH {_VEC}, u AS (SELECT id, v, [label, 100 + id % 5] AS t, sqrt(list_dot_product(v, v)) AS n FROM v), c AS (SELECT q.id AS a, r.id AS b, list_dot_product(q.v, r.v) / (q.n * r.n) AS cosine, len(list_intersect(q.t, r.t)) / len(list_distinct(list_concat(q.t, r.t))) AS jaccard FROM u q JOIN u r ON q.id <> r.id)
SELECT a, b, round(cosine, 6) AS cosine, round(jaccard, 9) AS jaccard, row_number() OVER (PARTITION BY a ORDER BY c.cosine DESC, b)::INTEGER AS rank FROM c WHERE jaccard < 0.3 QUALIFY rank <= 3""")
def e14_hard_negatives(spark, sf):
    v = vectors(spark, sf)
    sets = v.select(F.col("id").alias("entity"), F.explode(F.array(F.col("label").cast("long"), 100 + F.col("id") % 5)).alias("term"))
    return _rounded(C.hard_negatives(v, sets, 3, 0.3), 6, "cosine").withColumn("jaccard", F.round("jaccard", 9))


_CUST = "t AS (SELECT o_custkey AS entity, list_sort(list(DISTINCT year(o_orderdate)::BIGINT)) AS t FROM orders GROUP BY ALL)"


def _years(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("term"))


@query(f"WITH {_PAIRED}, {_CUST} SELECT a, b, array_to_string(x.t, ',') AS terms_a, array_to_string(y.t, ',') AS terms_b FROM p JOIN t x ON x.entity = a JOIN t y ON y.entity = b")
def c14_pair_join(spark, sf):
    out = C.pair_sets(_paired(spark, sf), _years(spark, sf))
    return out.select("a", "b", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("terms_a", "terms_b")])


@query(f"""WITH {_PAIRED}, {_CUST}, j AS (SELECT a, b, len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) AS jaccard FROM p JOIN t x ON x.entity = a JOIN t y ON y.entity = b), k AS (SELECT *, row_number() OVER (ORDER BY lpad(a::VARCHAR, 20, '0') || '|' || lpad(b::VARCHAR, 20, '0')) AS r, md5('n|' || a || '|' || b) AS key FROM j), d AS (SELECT jaccard AS shuffled, row_number() OVER (ORDER BY key) AS r FROM k)
SELECT a, b, round(jaccard, 9) AS jaccard, round(shuffled, 9) AS shuffled, round((avg(jaccard) OVER (PARTITION BY a) + avg(jaccard) OVER (PARTITION BY b)) / 2, 9) AS marginal FROM k JOIN d USING (r)""")
def h19_pair_targets(spark, sf):
    pairs = C.pair_sets(_paired(spark, sf), _years(spark, sf)).select("a", "b", R.tanimoto("terms_a", "terms_b").alias("jaccard"))
    return _rounded(C.pair_targets(pairs, "jaccard", "n"), 9, "jaccard", "shuffled", "marginal")


@query(f"""WITH {_SUPPLIED}, x AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM s x JOIN s y ON x.entity = y.entity AND x.term <> y.term GROUP BY ALL), f AS (SELECT term, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY entity) AS size FROM s)
SELECT entity, x.b AS term, round(0.7::DOUBLE * max(x.n / greatest(f.n, 1)) + 0.3::DOUBLE * least(sum(x.n) / any_value(size) / 10, 1.0::DOUBLE), 9) AS score FROM k JOIN x ON x.a = k.term JOIN f ON f.term = k.term GROUP BY ALL""")
def h35_counting_prior(spark, sf):
    s = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), (F.col("l_partkey") % 97).alias("term")).distinct()
    return _rounded(C.counting_prior(s, R.co_occurrence(s), s.groupBy("term").agg(F.count("*").alias("n"))), 9, "score")


@query("""WITH p AS (SELECT l_suppkey AS entity, l_orderkey AS partner, sum(l_quantity / 50) AS w FROM lineitem GROUP BY ALL), g AS (SELECT o_orderkey AS partner FROM orders WHERE o_orderstatus = 'F'), v AS (SELECT DISTINCT l_orderkey AS partner, l_partkey % 20 AS term FROM lineitem)
SELECT entity, term, round(sum(w), 6) AS score, round(sum(CASE WHEN g.partner IS NULL THEN w ELSE 0 END), 6) AS clean FROM p JOIN v USING (partner) LEFT JOIN g USING (partner) GROUP BY ALL""")
def h26_leakage_ablation(spark, sf):
    li = read(spark, sf, "lineitem")
    partners = li.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("partner")).agg(F.sum(F.col("l_quantity") / 50).alias("w"))
    targets = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entity"))
    votes = li.select(F.col("l_orderkey").alias("partner"), (F.col("l_partkey") % 20).alias("term")).distinct()
    return _rounded(C.leak_free(partners, targets, votes), 6, "score", "clean")


_UV = f"{_VEC}, w AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v)"


@query(f"""WITH {_UV}, c AS (SELECT DISTINCT p_partkey % 40 AS entity, p_size % 30 AS term FROM part), m AS (SELECT entity, term, max(list_dot_product(s.u, d.u)) AS x FROM c JOIN w s ON s.id % 60 = c.entity JOIN w d ON d.id = c.term GROUP BY ALL), f AS (SELECT c.entity, c.term, greatest(coalesce(x, 0), 0) AS cosine FROM c LEFT JOIN m USING (entity, term))
SELECT entity, term, round(cosine, 6) AS cosine, round((cosine - min(cosine) OVER ()) / (max(cosine) OVER () - min(cosine) OVER ()), 6) AS score FROM f""")
def h29_text_scores(spark, sf):
    u = vectors(spark, sf).select("id", R.unit("v").alias("v"))
    c = read(spark, sf, "part").select((F.col("p_partkey") % 40).alias("entity"), (F.col("p_size") % 30).cast("long").alias("term")).distinct()
    return _rounded(C.text_scores(c, u.select((F.col("id") % 60).alias("entity"), "v"), u.select(F.col("id").alias("term"), "v")), 6, "cosine", "score")


@query(f"""WITH {_UV}, {PAIRS}, r AS (SELECT entity, term % 50 AS term, max(score) AS score FROM pairs GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS k FROM r), x AS (SELECT entity, score, unnest(u) AS x, generate_subscripts(u, 1) AS dim FROM r JOIN w ON w.id = term), p AS (SELECT entity, list(s ORDER BY dim) AS p FROM (SELECT entity, dim, sum(score * x) AS s FROM x GROUP BY ALL) GROUP BY entity),
c AS (SELECT a.entity, a.term, avg(list_dot_product(va.u, vb.u)) AS coherence FROM k a JOIN k b ON a.entity = b.entity AND a.term <> b.term AND b.k <= CASE WHEN a.k <= 3 THEN 4 ELSE 3 END JOIN w va ON va.id = a.term JOIN w vb ON vb.id = b.term GROUP BY ALL)
SELECT r.entity, r.term, r.score, round(list_dot_product(u, p) / sqrt(list_dot_product(p, p)), 6) + 0.0 AS profile, round(coalesce(coherence, 0), 6) + 0.0 AS coherence FROM r JOIN w ON w.id = r.term JOIN p USING (entity) LEFT JOIN c ON c.entity = r.entity AND c.term = r.term""")
def h30_profile_features(spark, sf):
    rows = all_pairs(spark, sf).groupBy("entity", (F.col("term") % 50).alias("term")).agg(F.max("score").alias("score"))
    u = vectors(spark, sf).select(F.col("id").alias("term"), R.unit("v").alias("v"))
    return _rounded(C.profile_features(rows, u), 6, "profile", "coherence")


_DEPTHS = "lev AS (SELECT p_partkey AS term, 0 AS depth FROM part WHERE p_partkey NOT IN (SELECT child FROM edges) UNION SELECT e.child, l.depth + 1 FROM lev l JOIN edges e ON e.parent = l.term), d AS (SELECT term, min(depth) AS depth FROM lev GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_UV}, {IA}, {_DEPTHS}, r AS (SELECT entity, term % 50 AS term, max(score) AS score FROM pairs GROUP BY ALL), x AS (SELECT entity, score, unnest(u) AS x, generate_subscripts(u, 1) AS dim FROM r JOIN w ON w.id = term), p AS (SELECT entity, list(s ORDER BY dim) AS p FROM (SELECT entity, dim, sum(score * x) AS s FROM x GROUP BY ALL) GROUP BY entity)
SELECT r.entity, r.term, round(list_dot_product(u, p) / sqrt(list_dot_product(p, p)), 6) + 0.0 AS profile, coalesce(depth, -1)::INTEGER AS depth, round(coalesce(ia, 0), 9) AS ia FROM r JOIN w ON w.id = r.term JOIN p USING (entity) LEFT JOIN d ON d.term = r.term LEFT JOIN ia ON ia.term = r.term""")
def h30_term_features(spark, sf):
    g = graph(spark, sf)
    rows = candidates(spark, sf).repartition("entity").groupBy("entity", (F.col("term") % 50).alias("term")).agg(F.max("score").alias("score"))
    u = vectors(spark, sf).select(F.col("id").alias("term"), R.unit("v").alias("v"))
    depths = O.depths(edges(spark, sf), nodes(spark, sf)) if g is None else L.depths(g, nodes(spark, sf))
    out = C.term_features(rows, u, depths, accretion(spark, sf))
    return _rounded(_rounded(out, 6, "profile").select("entity", "term", (F.col("profile") + 0.0).alias("profile"), "depth", "ia"), 9, "ia")


@query()
def h32_structure_block(spark, sf):
    g = graph(spark, sf)
    return C.structure_block(closure(spark, sf), 8) if g is None else C.decomposed(materialise(L.incidence(g, nodes(spark, sf).distinct()), "sets"), len(g), 8)
