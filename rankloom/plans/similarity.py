"""Queries of similarity, neighbours and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.steps import before
from rankloom.operators import lifting as L
from rankloom.operators import ontology as O
from rankloom.operators import retrieval as R

from .dag import IA
from .registry import query
from .tables import PAIRS, all_pairs, closure, graph, nodes, positives, read

_VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.expr("transform(embedding, x -> double(x))").alias("v"), "label")


@query(f"""WITH {_VEC}, n AS (SELECT id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, v FROM v) SELECT id, round(v[1] / n, 9) AS first, round(v[64] / n, 9) AS last FROM n""")
def h01_unit_vectors(spark, sf):
    u = vectors(spark, sf).select("id", R.unit("v").alias("u"))
    return u.select("id", F.round(F.element_at("u", 1), 9).alias("first"), F.round(F.element_at("u", 64), 9).alias("last"))


@query(f"""WITH {_VEC}, x AS (SELECT id, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS atom FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, atom) AS k FROM x)
SELECT id, atom::INTEGER AS atom, value FROM r WHERE k <= 4""")
def h02_top_code(spark, sf):
    return vectors(spark, sf).select("id", F.explode(R.top_code("v", 4)).alias("c")).select("id", "c.atom", "c.value")


@query(f"""WITH {_VEC}, x AS (SELECT id, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS atom FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, atom) AS k FROM x)
SELECT id, string_agg(atom::VARCHAR, ',' ORDER BY atom) AS code FROM r WHERE k <= 6 GROUP BY id""")
def h03_active_set(spark, sf):
    return vectors(spark, sf).select("id", F.array_join(F.transform(R.active_set("v", 6), lambda x: x.cast("string")), ",").alias("code"))


@query("""WITH o AS (SELECT l_suppkey AS s, list(DISTINCT l_partkey) AS t FROM lineitem GROUP BY ALL) SELECT a.s AS a, b.s AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 9) AS tanimoto FROM o a JOIN o b ON b.s = a.s + 1""")
def h04_tanimoto(spark, sf):
    o = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("t"))
    a, b = o.select(F.col("l_suppkey").alias("a"), F.col("t").alias("ta")), o.select(F.col("l_suppkey").alias("b"), F.col("t").alias("tb"))
    return a.join(b, b.b == a.a + 1).select("a", "b", F.round(R.tanimoto("ta", "tb"), 9).alias("tanimoto"))


_KNN = f"""{_VEC}, u AS (SELECT id, v, label, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v), c AS (SELECT q.id AS query, r.id AS reference, r.label, list_dot_product(q.v, r.v) / (q.n * r.n) AS cosine FROM u q JOIN u r ON q.id <> r.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, reference) AS rank FROM c QUALIFY rank <= 5)"""


@query(f"WITH {_KNN} SELECT query, reference, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM k")
def h06_nearest(spark, sf):
    v = vectors(spark, sf)
    return R.nearest(v, v, 5).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH {_KNN}, t AS (SELECT query, sum(greatest(0, cosine)) AS w, count(*) AS n FROM k GROUP BY ALL) SELECT query AS entity, label AS term, round(sum(greatest(0, cosine)) / any_value(t.w), 6) AS vote, count(*) / any_value(t.n) AS fraction
FROM k JOIN t USING (query) GROUP BY ALL""")
def h07_neighbour_votes(spark, sf):
    v = vectors(spark, sf)
    return R.transfer(R.nearest(v, v, 5), v.select(F.col("id").alias("entity"), F.col("label").alias("term"))).withColumn("vote", F.round("vote", 6))


@query(f"WITH {_KNN}, l AS (SELECT id, label FROM v) SELECT query, avg(CASE WHEN k.label = l.label THEN 1.0::DOUBLE ELSE 0 END) AS purity FROM k JOIN l ON l.id = query GROUP BY ALL")
def h17_neighbour_purity(spark, sf):
    v = vectors(spark, sf)
    return R.purity(R.nearest(v, v, 5), v.select(F.col("id").alias("entity"), F.array("label").alias("terms")))


@query(f"""WITH {_VEC}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM v) SELECT label, dim::INTEGER AS dim, round(avg(x), 9) AS mean, max(x) AS max, min(x) AS min, round(stddev_pop(x), 9) AS std, arg_max(x, abs(x)) AS abs_max, round(avg(abs(x)), 9) AS mean_abs FROM x GROUP BY ALL""")
def h10_pooled_vectors(spark, sf):
    p = R.pool(vectors(spark, sf), "label", "v")
    return p.select("label", "dim", F.round("mean", 9).alias("mean"), "max", "min", F.round("std", 9).alias("std"), "abs_max", F.round("mean_abs", 9).alias("mean_abs"))


@query(f"WITH {_VEC}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM v) SELECT dim::INTEGER AS dim, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM x GROUP BY ALL")
def d14_corpus_moments(spark, sf):
    return R.corpus_moments(vectors(spark, sf), "v").select("dim", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"""WITH {_VEC}, x AS (SELECT id, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS atom FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, atom) AS k FROM x),
n AS (SELECT atom, count(*) AS n FROM r WHERE k <= 6 GROUP BY ALL), p AS (SELECT n / (SELECT sum(n) FROM n) AS p FROM n) SELECT round(-sum(p * ln(p)), 9) AS entropy, round(exp(-sum(p * ln(p))), 7) AS effective, count(*) AS atoms, round(sum(p * p) * count(*), 9) AS balance FROM p""")
def d16_dictionary_usage(spark, sf):
    codes = vectors(spark, sf).select(F.col("id").alias("entity"), F.explode(R.active_set("v", 6)).alias("atom"))
    return R.code_usage(codes).select(F.round("entropy", 9).alias("entropy"), F.round("effective", 7).alias("effective"), "atoms", F.round("balance", 9).alias("balance"))


_INC = "inc AS (SELECT DISTINCT l_orderkey AS entity, l_partkey AS term FROM lineitem)"
_CO = f"{_INC}, co AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM inc a JOIN inc b ON a.entity = b.entity AND a.term < b.term GROUP BY ALL)"
_PPMI = f"""{_CO}, nt AS (SELECT term, count(*) AS k FROM inc GROUP BY ALL), pp AS (SELECT co.a, co.b, co.n, greatest(0, ln(co.n * (SELECT count(DISTINCT entity) FROM inc) / (x.k * y.k))) AS ppmi FROM co JOIN nt x ON x.term = co.a JOIN nt y ON y.term = co.b)"""


def incidence(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("term"))


@query(f"WITH {_PPMI} SELECT a, b, n, round(ppmi, 9) AS ppmi FROM pp")
def h22_ppmi(spark, sf):
    inc = incidence(spark, sf)
    return R.ppmi(R.co_occurrence(inc), inc).withColumn("ppmi", F.round("ppmi", 9))


@query(f"""WITH {_PPMI}, {PAIRS}, known AS (SELECT entity, term FROM pairs WHERE label = 1), both_ AS (SELECT a, b, ppmi FROM pp WHERE ppmi > 0 UNION ALL SELECT b, a, ppmi FROM pp WHERE ppmi > 0),
s AS (SELECT k.entity, b.b AS term, sum(ppmi) AS score FROM known k JOIN both_ b ON b.a = k.term GROUP BY ALL), f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.entity = s.entity AND p.term = s.term)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(score, 9) DESC, term) AS rank FROM f) SELECT entity, term, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def h23_ppmi_generator(spark, sf):
    inc, p = incidence(spark, sf), all_pairs(spark, sf)
    links = R.ppmi(R.co_occurrence(inc), inc).select("a", "b", F.col("ppmi").alias("weight"))
    return R.propose(p.where("label = 1"), links, p, 3).withColumn("score", F.round("score", 6))


@query(f"""WITH {_CO}, {PAIRS}, nt AS (SELECT term, count(*) AS k FROM inc GROUP BY ALL), g AS (SELECT co.a, co.b, n / k AS p FROM (SELECT a, b, n FROM co UNION ALL SELECT b, a, n FROM co) co JOIN nt ON nt.term = co.a)
SELECT p.entity, g.b AS term, round(sum(g.p), 9) AS total FROM pairs p JOIN g ON g.a = p.term WHERE p.label = 1 GROUP BY ALL""")
def h24_association_prior(spark, sf):
    return R.association_prior(all_pairs(spark, sf).where("label = 1"), incidence(spark, sf)).withColumn("total", F.round("total", 9))


_NET = """net AS (SELECT l_suppkey AS a, o_custkey % 100 AS b, l_linenumber * 100 AS c1, CAST(l_discount * 1000 AS INTEGER) AS c2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(f"""WITH {_NET}, e AS (SELECT a, b, 1 - (1 - c1 / 1000) * (1 - c2 / 1000) AS w FROM net WHERE a <> b), f AS (SELECT a, b, max(w) AS w FROM (SELECT a, b, w FROM e WHERE w >= 0.7 UNION ALL SELECT b, a, w FROM e WHERE w >= 0.7) GROUP BY ALL),
ann AS (SELECT s_suppkey AS entity, s_nationkey AS term FROM supplier) SELECT a AS entity, term, round(sum(w), 9) AS score, count(*) AS partners FROM f JOIN ann ON ann.entity = f.b GROUP BY ALL""")
def h25_network_generator(spark, sf):
    net = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("a"), (F.col("o_custkey") % 100).alias("b"), (F.col("l_linenumber") * 100).alias("c1"), F.round(F.col("l_discount") * 1000).cast("int").alias("c2"))
    ann = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("term"))
    return R.network_scores(net, ["c1", "c2"], ann, 0.7).withColumn("score", F.round("score", 9))


_PRES = "pres AS (SELECT DISTINCT l_suppkey AS g, o_custkey AS taxon FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(f"""WITH {_PRES}, n AS (SELECT g, count(*) AS k FROM pres GROUP BY ALL HAVING count(*) >= 100), p AS (SELECT pres.* FROM pres JOIN n USING (g)), t AS (SELECT count(DISTINCT taxon) AS s FROM p),
c AS (SELECT x.g AS a, y.g AS b, count(*) AS m FROM p x JOIN p y ON x.taxon = y.taxon AND x.g <> y.g GROUP BY ALL), r AS (SELECT a, b, round((m * s - u.k * v.k) / (sqrt(u.k * (s - u.k)) * sqrt(v.k * (s - v.k))), 9) AS r FROM c JOIN n u ON u.g = a JOIN n v ON v.g = b, t)
SELECT a, b, r, (row_number() OVER (PARTITION BY a ORDER BY r DESC, b))::INTEGER AS rank FROM r QUALIFY rank <= 3""")
def h27_profile_neighbours(spark, sf):
    pres = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("group"), F.col("o_custkey").alias("taxon"))
    return R.profile_neighbours(pres, 100, 3)


@query(f"""WITH {PAIRS}, k AS (SELECT entity, term FROM pairs WHERE label = 1), n AS (SELECT entity, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT a.entity AS a, b.entity AS b, count(*) AS m FROM k a JOIN k b ON a.term = b.term AND a.entity <> b.entity GROUP BY ALL),
j AS (SELECT a, b, m / (x.n + y.n - m) AS j FROM m JOIN n x ON x.entity = a JOIN n y ON y.entity = b), t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS k FROM j WHERE j < 0.95 QUALIFY k <= 4), s AS (SELECT a, sum(j) AS s FROM t GROUP BY ALL)
SELECT t.a AS entity, k.term, round(sum(t.j) / any_value(s.s), 9) AS vote FROM t JOIN k ON k.entity = t.b JOIN s ON s.a = t.a GROUP BY ALL""")
def h21_set_transfer(spark, sf):
    return R.set_transfer(all_pairs(spark, sf).where("label = 1"), 4).withColumn("vote", F.round("vote", 9))


@query(f"""WITH RECURSIVE {IA}, ic AS (SELECT term, CASE WHEN n >= (SELECT max(n) FROM n) THEN 0.0 ELSE -ln(n / (SELECT max(n) FROM n)) END::DOUBLE AS ic FROM n), w AS (SELECT entity, term, ic FROM closed JOIN ic USING (term)),
b AS (SELECT entity, max(ic) AS top FROM w GROUP BY ALL), e AS (SELECT entity, lead(entity) OVER (ORDER BY entity) AS next FROM b), s AS (SELECT e.entity AS a, e.next AS b, max(y.ic) AS r FROM e JOIN w x ON x.entity = e.entity JOIN w y ON y.entity = e.next AND y.term = x.term GROUP BY ALL)
SELECT e.entity AS a, e.next AS b, round(coalesce(s.r, 0), 9) AS resnik, round(CASE WHEN p.top + q.top > 0 THEN 2 * coalesce(s.r, 0) / (p.top + q.top) ELSE 0 END, 9) AS lin FROM e LEFT JOIN s ON s.a = e.entity JOIN b p ON p.entity = e.entity JOIN b q ON q.entity = e.next""")
def h18_resnik_lin(spark, sf):
    g, known = graph(spark, sf), positives(spark, sf)
    ids = before(known.join(nodes(spark, sf), "term", "left_semi").select("entity").distinct().withColumn("one", F.lit(1)), "entity", "one", "place")  # neighbours in the ids' order, as an example of given pairs
    pairs = ids.select(F.col("entity").alias("a"), (F.col("place") + 1).alias("place")).join(ids.select(F.col("entity").alias("b"), "place"), "place").select("a", "b")
    if g is None:
        closed = O.entity_closure(known, closure(spark, sf))
        out = R.resnik_lin(pairs, closed, O.information_content(closed))
    else:
        out = R.lin(L.similarity(pairs, known, g, L.weights(O.content(L.counts(known, g)), g, "ic")))
    return out.select("a", "b", F.round("resnik", 9).alias("resnik"), F.round("lin", 9).alias("lin"))


@query(f"""WITH {_VEC}, n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v), c AS (SELECT x.label AS a, y.label AS b, x.id AS pa, y.id AS pb, list_dot_product(x.v, y.v) / (x.n * y.n) AS c FROM n x JOIN n y ON y.label = x.label + 1),
o AS (SELECT a, b, avg(c) AS s FROM (SELECT a, b, pa, max(c) AS c FROM c GROUP BY ALL) GROUP BY ALL), t AS (SELECT a, b, avg(c) AS s FROM (SELECT a, b, pb, max(c) AS c FROM c GROUP BY ALL) GROUP BY ALL) SELECT a, b, round(o.s, 6) AS a_in_b, round(t.s, 6) AS b_in_a FROM o JOIN t USING (a, b)""")
def h15_max_sim(spark, sf):
    v = vectors(spark, sf)
    labels = v.select("label").distinct()
    pairs = labels.select(F.col("label").alias("a")).join(labels.select(F.col("label").alias("b")), F.col("b") == F.col("a") + 1)
    return R.max_sim(pairs, v.select(F.col("label").alias("entity"), F.col("id").alias("pos"), "v")).select("a", "b", F.round("a_in_b", 6).alias("a_in_b"), F.round("b_in_a", 6).alias("b_in_a"))


@query('SELECT item_id, k::INTEGER AS "at", substr(text, k + 1, 40) AS part FROM (SELECT item_id, text, unnest(range(0, length(text), 20)) AS k FROM benchmark)')
def h31_windows(spark, sf):
    return R.windows(read(spark, sf, "benchmark"), "item_id", "text", 40, 20)


@query("""WITH n AS (SELECT p_partkey AS term, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS w FROM part),
t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents), a AS (SELECT term, len(w) AS need, unnest(w) AS word FROM n WHERE len(w) > 0) SELECT id, term, count(*) AS hits FROM a JOIN t USING (word) GROUP BY id, term, need HAVING count(*) = need""")
def h36_lexical_match(spark, sf):
    names = read(spark, sf, "part").select(F.col("p_partkey").alias("term"), F.col("p_name").alias("name"))
    return R.lexical_hits(names, read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
