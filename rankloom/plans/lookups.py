"""Queries of lookups by snapshot, digests, provenance and bucketed tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions.steps import materialise
from rankloom.operators import codes as C
from rankloom.operators import digests as D
from rankloom.operators import encoding as B
from rankloom.operators import evidence as V
from rankloom.operators import lifting as L
from rankloom.operators import ontology as O
from rankloom.operators import semantics as M
from rankloom.operators import retrieval as R
from rankloom.operators import snapshots as N
from rankloom.sources import writers as W

from .registry import query
from .similarity import _VEC, vectors
from .staging import h60
from .tables import CAND, CLOSURE, candidates, closure, graph, nodes, read

_SETS = """sets AS (SELECT DISTINCT source AS entity, snapshot AS version, source * 10000 + snapshot AS set_id, term FROM cand WHERE label = 1), asked AS (SELECT DISTINCT source AS entity, term, 'v' || snapshot || '-v' || (snapshot + 1) AS snapshot_pair, snapshot AS a FROM cand)"""


@query(f"""WITH {CAND}, {_SETS}, v AS (SELECT DISTINCT entity, version, set_id FROM sets)
SELECT q.entity, q.term, q.snapshot_pair, coalesce(v.version, 0)::BIGINT AS version, s.term IS NOT NULL AS known FROM asked q ASOF LEFT JOIN v ON v.entity = q.entity AND q.a >= v.version LEFT JOIN sets s ON s.set_id = v.set_id AND s.term = q.term""")
def c12_snapshot_lookup(spark, sf):
    c = candidates(spark, sf).select(F.col("source").alias("entity"), "term", F.col("snapshot").cast("long").alias("version"), "label")
    sets = c.where("label = 1").select("entity", "version", (F.col("entity") * 10000 + F.col("version")).alias("set_id"), "term").distinct()
    asked = c.select("entity", "term", F.format_string("v%d-v%d", "version", F.col("version") + 1).alias("snapshot_pair")).distinct()
    return N.known_at(asked, sets.select("entity", "version", "set_id").distinct(), sets.select("set_id", "term")).withColumn("version", F.coalesce("version", F.lit(0)))


@query("""SELECT o.o_orderkey, coalesce(v.o_orderkey, 0) AS version_key, v.o_orderdate::VARCHAR AS version_date FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) v ON v.o_custkey = o.o_custkey AND o.o_orderdate >= v.o_orderdate""")
def c12_as_of_orders(spark, sf):
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    versions = orders.where("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("key"))
    found = N.as_of(orders.select("o_custkey", "o_orderdate", "o_orderkey"), versions, ["o_custkey"], "o_orderdate")
    return found.select("o_orderkey", F.coalesce("found.key", F.lit(0)).alias("version_key"), F.col("found.o_orderdate").cast("string").alias("version_date"))


_TEXT = lambda *columns: "concat_ws(',', " + ", ".join(f"'{c}=' || coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in sorted(columns)) + ")"
_PARTS = ("o_orderkey", "o_custkey", "o_orderpriority")


@query(f"""WITH r AS (SELECT o_orderstatus, md5({_TEXT(*_PARTS)}) AS x FROM orders), u AS (SELECT o_orderstatus, ('0x' || x[1:16])::UBIGINT AS hi, ('0x' || x[17:32])::UBIGINT AS lo FROM r),
s AS (SELECT o_orderstatus, count(*) AS n, sum(hi::HUGEINT)::VARCHAR AS a, sum(lo::HUGEINT)::VARCHAR AS b, bit_xor(hi) AS c, bit_xor(lo) AS d FROM u GROUP BY ALL),
t AS (SELECT o_orderstatus, n, a, b, (CASE WHEN c > 9223372036854775807 THEN c::HUGEINT - 18446744073709551616 ELSE c END)::VARCHAR AS c, (CASE WHEN d > 9223372036854775807 THEN d::HUGEINT - 18446744073709551616 ELSE d END)::VARCHAR AS d FROM s)
SELECT o_orderstatus, n AS rows, a AS sum_high, b AS sum_low, c AS xor_high, d AS xor_low, substr(sha256(concat_ws('|', n::VARCHAR, a, b, c, d)), 1, 12) AS digest FROM t""")
def b15_content_digest(spark, sf):
    return D.content(read(spark, sf, "orders"), _PARTS, by=["o_orderstatus"])


#: Suppliers and the parts that came back, closed upward; three partners each; aspects by a part's size.
_SUPPLIERS = f"""{CLOSURE}, {CAND}, held AS (SELECT DISTINCT source AS entity, ancestor AS term FROM cand JOIN closure USING (term) WHERE label = 1), i AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS place FROM (SELECT DISTINCT entity FROM held)),
pairs AS (SELECT DISTINCT i.entity AS a, j.entity AS b FROM i, (VALUES (1), (2), (3)) v(k), i j WHERE j.place = {h60('m', 'CAST(i.entity AS VARCHAR)', 'CAST(k AS VARCHAR)')} % (SELECT count(*) FROM i) AND j.entity <> i.entity), aspects AS (SELECT p_partkey AS term, ['P', 'F', 'C'][1 + p_size % 3] AS aspect FROM part)"""
_CONTENT = "SELECT term, CASE WHEN n >= max(n) OVER () THEN 0.0 ELSE -ln(n / max(n) OVER ()) END::DOUBLE AS ic FROM (SELECT term, count(*) AS n FROM {} GROUP BY ALL)"
_LIN = """top AS (SELECT entity, max(ic) AS top FROM {0} JOIN ic USING (term) GROUP BY ALL), s AS (SELECT a, b, max(ic) AS r FROM pairs JOIN {0} x ON x.entity = a JOIN {0} y ON y.entity = b AND y.term = x.term JOIN ic ON ic.term = x.term GROUP BY ALL),
l AS (SELECT a, b, coalesce(r, 0) AS r, coalesce(p.top, 0) + coalesce(q.top, 0) AS t FROM pairs LEFT JOIN s USING (a, b) LEFT JOIN top p ON p.entity = a LEFT JOIN top q ON q.entity = b)"""


def _suppliers(spark, sf):
    """(graph, pairs, held, aspects): held is closed where the graph is not for the tasks."""
    g, held = graph(spark, sf), candidates(spark, sf).where("label = 1").select(F.col("source").alias("entity"), "term").distinct()
    held = O.entity_closure(held, closure(spark, sf)) if g is None else materialise(held.join(nodes(spark, sf), "term", "left_semi"), "held")
    aspects = read(spark, sf, "part").select(F.col("p_partkey").alias("term"), F.get(F.array(*map(F.lit, "PFC")), (F.col("p_size") % 3).cast("int")).alias("aspect"))
    return g, C.sampled_pairs(held, 3, "m"), held, aspects


def _similarity(g, pairs, held, counted):
    return materialise(L.similarity(pairs, held, g, L.weights(O.content(counted), g, "ic")), "similar")


@query(f"""WITH RECURSIVE {_SUPPLIERS}, ic AS ({_CONTENT.format('held')}), m AS (SELECT a, b, x.term, row_number() OVER (PARTITION BY a, b ORDER BY ic DESC, x.term DESC) AS k FROM pairs JOIN held x ON x.entity = a JOIN held y ON y.entity = b AND y.term = x.term JOIN ic ON ic.term = x.term)
SELECT coalesce(aspect, 'none') AS aspect, count(*) AS pairs FROM pairs LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (a, b) LEFT JOIN aspects USING (term) GROUP BY ALL""")
def d31_mica_aspects(spark, sf):
    g, pairs, held, aspects = _suppliers(spark, sf)
    if g is None:
        return M.mica_aspects(pairs, held, O.information_content(held), aspects)
    return M.aspects_of(_similarity(g, pairs, held, L.counts(held, g)), aspects)


@query(f"""WITH RECURSIVE {_SUPPLIERS}, own AS (SELECT * FROM held WHERE term IN (SELECT term FROM aspects WHERE aspect = 'P')), ic AS ({_CONTENT.format('own')}), {_LIN.format('own')} SELECT a, b, round(r, 9) AS resnik, round(CASE WHEN t > 0 THEN 2 * r / t ELSE 0 END, 9) AS lin FROM l""")
def h19_aspect_lin(spark, sf):
    g, pairs, held, aspects = _suppliers(spark, sf)
    if g is None:
        out = M.aspect_similarity(pairs, held, aspects, "P")
    else:
        own = L.counts(held, g).join(aspects.where("aspect = 'P'").select("term"), "term", "left_semi")
        out = R.lin(_similarity(g, pairs, held, own))
    return out.select("a", "b", F.round("resnik", 9).alias("resnik"), F.round("lin", 9).alias("lin"))


@query(f"""WITH RECURSIVE {_SUPPLIERS}, ic AS ({_CONTENT.format('held')}), {_LIN.format('held')} SELECT a, b, round(CASE WHEN t > 0 THEN 2 * r / t ELSE 0 END, 9) AS lin, round(CASE WHEN t > 0 THEN 2 * avg(CASE WHEN t > 0 THEN r ELSE 0 END) OVER () / t ELSE 0 END, 9) AS marginal FROM l""")
def h19_pool_null(spark, sf):
    g, pairs, held, _ = _suppliers(spark, sf)
    if g is None:
        out = M.pool_mean_null(pairs, held, O.information_content(held))
    else:
        found = _similarity(g, pairs, held, L.counts(held, g))
        out = M.mean_null(R.lin(found).join(found.select("a", "b", "top_a", "top_b"), ["a", "b"]))
    return out.select("a", "b", F.round("lin", 9).alias("lin"), F.round("marginal", 9).alias("marginal"))


#: Suppliers with vectors: what they delivered before 1997 in three tiers of evidence, what came back later as truth, and five
#: neighbours, whose terms are the pool; terms of two neighbours or more count as delivered.
_DONORS = f"""{_VEC}, {CAND}, e AS (SELECT DISTINCT source AS id FROM cand), u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v JOIN e USING (id)), knn AS (SELECT q.id AS query, r.id AS reference, list_dot_product(q.v, r.v) / (q.n * r.n) AS cosine FROM u q JOIN u r ON q.id <> r.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, r.v) / (q.n * r.n) DESC, r.id) <= 5),
ann AS (SELECT source AS entity, term, ['auth', 'comp', 'exp'][1 + stream % 3] AS tier FROM cand WHERE snapshot < 1997), target AS (SELECT DISTINCT source AS entity, term FROM cand WHERE snapshot >= 1997 AND label = 1 AND (source, term) NOT IN (SELECT entity, term FROM ann)),
ia AS (SELECT term, ln((SELECT count(DISTINCT entity) FROM ann) / count(DISTINCT entity)) AS ia FROM ann GROUP BY ALL), pool AS (SELECT query AS entity, term, count(DISTINCT reference) AS n FROM knn JOIN ann ON entity = reference GROUP BY ALL)"""


def _donors(spark, sf):
    c = candidates(spark, sf).withColumn("entity", F.col("source"))
    ann = c.where("snapshot < 1997").select("entity", "term", F.get(F.array(F.lit("auth"), F.lit("comp"), F.lit("exp")), (F.col("stream") % 3).cast("int")).alias("tier"))
    target = c.where("snapshot >= 1997 and label = 1").select("entity", "term").distinct().join(ann.select("entity", "term"), ["entity", "term"], "left_anti")
    v = B.members(vectors(spark, sf), c.select(F.col("entity").alias("id")), "id")
    neighbours = R.nearest(v, v, 5)
    n = ann.groupBy("term").agg(F.countDistinct("entity").alias("n"))
    ia = n.crossJoin(F.broadcast(ann.agg(F.countDistinct("entity").alias("all_")))).select("term", F.log(F.col("all_") / F.col("n")).alias("ia"))  # one row
    pool = neighbours.join(ann.select(F.col("entity").alias("reference"), "term").distinct(), "reference").groupBy(F.col("query").alias("entity"), "term").agg(F.count("*").alias("n"))
    return ann, target, neighbours, ia, pool


@query(f"""WITH {_DONORS}, b AS (SELECT t.entity, t.term, a.tier, row_number() OVER (PARTITION BY t.entity, t.term ORDER BY cosine DESC, reference) AS k FROM target t JOIN knn ON query = t.entity JOIN (SELECT entity, term, min(tier) AS tier FROM ann GROUP BY ALL) a ON a.entity = reference AND a.term = t.term),
r AS (SELECT coalesce(tier, 'none') AS tier, count(*) AS n, sum(coalesce(ia, 0)) AS mass FROM target LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (entity, term) LEFT JOIN ia USING (term) GROUP BY ALL) SELECT tier, n, round(mass, 6) AS mass, round(mass / sum(mass) OVER (), 9) AS share FROM r""")
def d29_donor_evidence(spark, sf):
    ann, target, neighbours, ia, _ = _donors(spark, sf)
    out = V.donor_mass(V.donor_evidence(target, neighbours, ann), ia)
    return out.select("tier", "n", F.round("mass", 6).alias("mass"), F.round("share", 9).alias("share"))


@query(f"""WITH {_DONORS}, k AS (SELECT term, CASE WHEN avg((tier = 'exp')::INTEGER) >= 0.5 THEN 'strong' WHEN avg((tier = 'auth')::INTEGER) >= 0.5 THEN 'weak' ELSE 'mixed' END AS class FROM ann GROUP BY ALL), r AS (SELECT unnest(['true', CASE WHEN coalesce(n, 0) >= 2 THEN 'delivered' ELSE 'missing' END, CASE WHEN n IS NULL THEN 'unreachable' ELSE 'reachable' END]) AS tag, coalesce(class, 'absent') AS class, coalesce(ia, 0) AS w FROM target LEFT JOIN pool USING (entity, term) LEFT JOIN k USING (term) LEFT JOIN ia USING (term)),
g AS (SELECT tag, class, count(*) AS n, sum(w) AS mass FROM r GROUP BY ALL) SELECT tag, class, n, round(mass, 6) AS mass, round(CASE WHEN sum(mass) OVER (PARTITION BY tag) > 0 THEN mass / sum(mass) OVER (PARTITION BY tag) ELSE 0 END, 9) AS share FROM g""")
def d29_mass_by_evidence(spark, sf):
    ann, target, _, ia, pool = _donors(spark, sf)
    out = V.mass_by_evidence(target, pool.where("n >= 2"), pool, ia, V.term_evidence(ann, "exp", "auth"))
    return out.select("tag", "class", "n", F.round("mass", 6).alias("mass"), F.round("share", 9).alias("share"))


@query(f"""WITH {_DONORS}, q AS (SELECT entity, avg((tier = 'exp')::INTEGER) AS s FROM ann GROUP BY ALL), l AS (SELECT entity, max((n IS NULL)::INTEGER) AS lacks FROM target LEFT JOIN pool USING (entity, term) GROUP BY ALL)
SELECT CASE WHEN lacks = 1 THEN 'lacking' ELSE 'full' END AS reach, count(*) AS entities, count(s) AS annotated, round(avg(s), 9) AS strong_share FROM l LEFT JOIN q USING (entity) GROUP BY ALL""")
def d29_entity_evidence(spark, sf):
    ann, target, _, _, pool = _donors(spark, sf)
    return V.entity_evidence(target, pool, ann, "exp").withColumn("strong_share", F.round("strong_share", 9))


@query(f"WITH {CAND} SELECT entity, count(*) AS rows, max(score) AS best, sum(label)::BIGINT AS positives FROM cand GROUP BY entity")
def a10_bucketed_counts(spark, sf):
    table = W.bucketed(candidates(spark, sf).select("entity", "term", "stream", "score", "label"), ["entity"], sort=["stream"])
    return table.groupBy("entity").agg(F.count("*").alias("rows"), F.max("score").alias("best"), F.sum("label").alias("positives"))


@query(f"WITH {CAND} SELECT entity, stream, term, row_number() OVER (PARTITION BY entity ORDER BY stream, term)::INTEGER AS place FROM cand")
def e01_sorted_in_bucket(spark, sf):
    table = W.bucketed(candidates(spark, sf).select("entity", "stream", "term"), ["entity"], sort=["stream", "term"])
    return table.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("stream", "term")))


@query(f"""WITH {CLOSURE}, {CAND}, c AS (SELECT category AS cell, entity, term, max(label) AS label FROM cand GROUP BY ALL), up AS (SELECT DISTINCT cell, entity, ancestor AS term FROM c JOIN closure USING (term) WHERE label = 1)
SELECT c.cell, count(*) AS rows, count(DISTINCT c.entity) AS entities, sum(label)::BIGINT AS positives, count(up.term) AS propagated, CASE WHEN sum(label) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, round(CASE WHEN any_value(t.n) > 0 THEN count(up.term) / any_value(t.n) ELSE 0 END, 9) AS recall_propagated
FROM c LEFT JOIN up USING (cell, entity, term) LEFT JOIN (SELECT cell, count(*) AS n FROM up GROUP BY ALL) t ON t.cell = c.cell GROUP BY c.cell""".replace("WITH ", "WITH RECURSIVE ", 1))
def d03_candidate_recall(spark, sf):
    g, rows = graph(spark, sf), candidates(spark, sf).select(F.col("category").alias("cell"), "entity", "term", "label")
    out = O.candidate_recall(rows.groupBy("cell", "entity", "term").agg(F.max("label").alias("label")), closure(spark, sf), "cell") if g is None else L.candidate_recall(rows, g, "cell")
    return out.withColumn("recall_propagated", F.round("recall_propagated", 9))


@query("""SELECT lang AS category, CASE WHEN d < TIMESTAMP '2024-01-10' THEN 'first' WHEN d < TIMESTAMP '2024-01-20' THEN 'second' WHEN d IS NULL THEN 'undated' ELSE 'later' END AS bucket, count(*) AS n FROM (SELECT lang, CASE WHEN doc_id % 7 > 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 31 AS INTEGER) AS TIMESTAMP) END AS d FROM documents WHERE coalesce(length(text) > 600, false)) GROUP BY ALL""")
def d41_date_tally(spark, sf):
    docs = read(spark, sf, "documents").withColumn("day", F.expr("case when doc_id % 7 > 0 then cast(date_add(date '2024-01-01', int(doc_id % 31)) as timestamp_ntz) end"))
    return V.date_tally(docs, "lang", F.coalesce(F.length("text") > 600, F.lit(False)), "day", {"first": "2024-01-10", "second": "2024-01-20"})


_FAMILIES = {"money": ["o_totalprice", "o_discount"], "who": ["o_custkey", "o_orderstatus"], "lineage_notes": ["lineage_id"]}


@query("SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey, o_orderstatus FROM orders")
def b02_selected_features(spark, sf):
    orders = read(spark, sf, "orders")
    numeric, categorical = B.selected_features(_FAMILIES, orders.columns, ["o_orderstatus"], drop=["o_clerk"])
    return orders.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in numeric], *categorical)


@query("SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, CASE WHEN l_returnflag <> 'N' THEN l_discount::DOUBLE ELSE NULL END IS NULL AS no_prior, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_discount::DOUBLE ELSE NULL END, -1) AS l_discount FROM lineitem")
def b03_score_vector(spark, sf):
    rows = B.score_vector(read(spark, sf, "lineitem"), {"knn": ["l_quantity"], "prior": ["l_discount"]}, ["prior"], "l_returnflag", ["n"])
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_discount").isNull().alias("no_prior"), F.coalesce("l_discount", F.lit(-1.0)).alias("l_discount"))


@query("SELECT p_partkey, p_size FROM part")
def b04_numeric_features(spark, sf):
    part = read(spark, sf, "part")
    return part.select(*[c for c in B.numeric_features(part) if c in ("p_partkey", "p_size", "p_name", "p_type")])


@query("SELECT c_custkey, isnan(c_acctbal::FLOAT) AS no_balance, true AS no_score, -1.0::FLOAT AS segment_code, c_nationkey::FLOAT AS c_nationkey FROM customer")
def b05_filled(spark, sf):
    rows = B.filled(read(spark, sf, "customer"), ["c_acctbal", "c_score"], ["segment_code", "c_nationkey"])
    return rows.select("c_custkey", F.isnan("c_acctbal").alias("no_balance"), F.isnan("c_score").alias("no_score"), "segment_code", "c_nationkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def b09_members(spark, sf):
    closed = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return B.members(read(spark, sf, "lineitem"), closed.unionByName(closed), "l_orderkey").select("l_orderkey", "l_linenumber")


@query(f"WITH {CAND} SELECT c.entity, c.stream, coalesce(p_partkey // 2, c.term) AS term FROM cand c LEFT JOIN (SELECT p_partkey FROM part WHERE p_size % 4 = 0 AND p_partkey > 1) p ON p_partkey = c.term")
def b10_primary_terms(spark, sf):
    aliases = read(spark, sf, "part").where("p_size % 4 = 0 and p_partkey > 1").select(F.col("p_partkey").alias("alt"), F.expr("p_partkey div 2").alias("term"))
    return B.remap(candidates(spark, sf).select("entity", "stream", "term"), aliases)


@query("SELECT l_orderkey, l_linenumber, round(1 - l_discount::DOUBLE, 9) AS score, CASE l_returnflag WHEN 'R' THEN 'mfo' WHEN 'A' THEN 'bpo' ELSE 'cco' END AS aspect FROM lineitem")
def b20_neighbour_score(spark, sf):
    letter = F.when(F.col("l_returnflag") == "R", "f").when(F.col("l_returnflag") == "A", "bpo").otherwise("C")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(B.neighbour_score(F.col("l_discount")), 9).alias("score"), B.aspect_name(letter).alias("aspect"))


@query(f"WITH {CAND} SELECT c.entity, c.stream, c.term, p_size, coalesce(s_nationkey, -1) AS nation FROM cand c JOIN part ON p_partkey = c.term LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = c.source")
def c01_enrichment(spark, sf):
    out = V.enriched(candidates(spark, sf), read(spark, sf, "part").select(F.col("p_partkey").alias("term"), "p_size"), read(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source"), "s_nationkey"), "source")
    return out.select("entity", "stream", "term", "p_size", F.coalesce("s_nationkey", F.lit(-1)).alias("nation"))


@query(f"""WITH {_VEC}, b AS (SELECT 'low' AS bank, id, label, v[1:32] AS v FROM v UNION ALL SELECT 'high', id, label, v[33:64] FROM v), u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM b), k AS (SELECT q.bank, q.id AS query, r.label AS term FROM u q JOIN u r ON q.bank = r.bank AND q.id <> r.id QUALIFY row_number() OVER (PARTITION BY q.bank, q.id ORDER BY list_dot_product(q.v, r.v) / (q.n * r.n) DESC, r.id) <= 4) SELECT DISTINCT bank, query AS entity, term FROM k""")
def h08_proposal_sets(spark, sf):
    v = vectors(spark, sf)
    ann = v.select(F.col("id").alias("entity"), F.col("label").alias("term"))
    return R.proposal_sets({"low": v.select("id", F.slice("v", 1, 32).alias("v")), "high": v.select("id", F.slice("v", 33, 32).alias("v"))}, ann, 4)
