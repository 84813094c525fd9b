"""Queries of scans, encodings, joins and samples that make training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import encoding as B
from rankloom.operators import staging as S

from .registry import query
from .tables import CAND, PAIRS, candidates, all_pairs, read

_H = "('0x' || substr(md5(concat_ws('|', {}, {})), 1, 8))::BIGINT"


def h(seed: str, *columns: str) -> str:
    return _H.format(f"'{seed}'", ", ".join(columns))


def h60(seed: str, *columns: str) -> str:
    return h(seed, *columns).replace("1, 8", "1, 15")


@query(f"WITH {CAND} SELECT entity, term, score FROM cand WHERE category = 'O' AND snapshot IN (1996, 1997)")
def a01_cell_scan(spark, sf):
    return B.cell(candidates(spark, sf), category="o", snapshots=[1996, 1997]).select("entity", "term", "score")


@query("SELECT c_custkey, c_acctbal, CAST(NULL AS VARCHAR) AS c_phone, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def a02_present_columns(spark, sf):
    return B.present_columns(read(spark, sf, "customer"), {"c_custkey": "bigint", "c_acctbal": "double", "c_phone": "string", "c_nationkey": "string"})


@query(f"WITH {CAND} SELECT count(*) AS all_rows, count(*) FILTER (category = 'F') AS cell_rows FROM cand")
def a03_row_counts(spark, sf):
    return candidates(spark, sf).agg(F.count("*").alias("all_rows"), F.count(F.when(F.col("category") == "F", 1)).alias("cell_rows"))


@query("""WITH v AS (SELECT DISTINCT o_orderpriority AS value FROM orders WHERE year(o_orderdate) = 1995), w AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM v)
SELECT o_orderkey, coalesce(code, -1)::INTEGER AS code FROM orders LEFT JOIN w ON o_orderpriority = value""")
def b06_category_codes(spark, sf):
    o = read(spark, sf, "orders")
    return B.encode(o, "o_orderpriority", B.vocabulary(o.where(F.year("o_orderdate") == 1995), "o_orderpriority"), "code").select("o_orderkey", "code")


@query("SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS code FROM customer")
def b07_factorise(spark, sf):
    c = read(spark, sf, "customer")
    return B.encode(c, "c_mktsegment", B.vocabulary(c, "c_mktsegment"), "code").select("c_custkey", "code")


@query("SELECT event_id, TRY_CAST(nullif(trim(substr(props, 7, length(props) - 7)), '') AS DOUBLE) AS k FROM events")
def b08_tolerant_numbers(spark, sf):
    return read(spark, sf, "events").select("event_id", F.expr("substr(props, 7, length(props) - 7)").alias("t")).select("event_id", B.tolerant("t").alias("k"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'short' WHEN p_size < 25 THEN 'middle' WHEN p_size < 40 THEN 'long' ELSE 'longest' END AS band FROM part")
def b11_length_bands(spark, sf):
    return read(spark, sf, "part").select("p_partkey", B.band(F.col("p_size"), (10, 25, 40), ("short", "middle", "long", "longest")).alias("band"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR year(o_orderdate) < 1995 OR (year(o_orderdate) = 1995 AND month(o_orderdate) < 7)")
def b12_temporal_cut(spark, sf):
    o = read(spark, sf, "orders")
    return o.where(B.before(F.year("o_orderdate"), F.month("o_orderdate"), (1995, 7))).select("o_orderkey")


@query()
def b13_sentences(spark, sf):
    return B.sentences(read(spark, sf, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("text")), "page_id", "text")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.9) FROM lineitem)")
def b16_withhold_quantile(spark, sf):
    return B.withhold(read(spark, sf, "lineitem"), "l_extendedprice", 0.9).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH x AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS ran, value AS a, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS b FROM events)
SELECT event_id, a, CASE WHEN ran = 1 THEN b END AS b FROM x""")
def b17_lying_zeros(spark, sf):
    e = read(spark, sf, "events")
    x = e.select("event_id", (F.col("event_type") == "click").cast("int").alias("ran"), F.col("value").alias("a"), F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0).alias("b"))
    return B.null_where_skipped(x, B.lying_zeros(x, ["a", "b"], "ran"), "ran").select("event_id", "a", "b")


@query(f"""WITH {PAIRS}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM pairs WINDOW w AS (PARTITION BY entity))
SELECT entity, term, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END::DOUBLE AS score FROM m""")
def b18_entity_min_max(spark, sf):
    return all_pairs(spark, sf).select("entity", "term", B.min_max(F.col("score"), ["entity"], 1.0).alias("score"))


@query("SELECT p_partkey, (p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)) AS p_retailprice FROM part")
def b19_global_min_max(spark, sf):
    return B.min_max_all(read(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query(f"""WITH {PAIRS} SELECT entity, term, row_number() OVER (PARTITION BY entity ORDER BY score, term DESC) / count(*) OVER (PARTITION BY entity) AS unit_rank,
round(sqrt(least(1.0, greatest(1e-6, score))), 9) AS softened FROM pairs""")
def b21_rescaling(spark, sf):
    return all_pairs(spark, sf).select("entity", "term", B.rank_unit(["entity"], "score", "term").alias("unit_rank"), F.round(B.power(F.col("score"), 2.0), 9).alias("softened"))


@query(f"WITH {CAND} SELECT entity, term, stream, label FROM cand c WHERE EXISTS (SELECT 1 FROM cand d WHERE d.label = 1 AND d.entity = c.entity AND d.category = c.category AND d.snapshot = c.snapshot)")
def c02_genuine_cells(spark, sf):
    return S.genuine(candidates(spark, sf), ["category", "snapshot", "entity"]).select("entity", "term", "stream", "label")


@query(f"WITH {CAND} SELECT source, term, entity FROM cand c WHERE snapshot = 1996 AND NOT EXISTS (SELECT 1 FROM cand d WHERE d.snapshot = 1994 AND d.label = 1 AND d.source = c.source AND d.term = c.term)")
def c03_leakage_anti_join(spark, sf):
    c = candidates(spark, sf)
    rows, train = (c.where(F.col("snapshot") == y).select(F.col("source").alias("entity"), "term", "label", F.col("entity").alias("order_")) for y in (1996, 1994))
    return S.without_leaks(rows, train).select(F.col("entity").alias("source"), "term", F.col("order_").alias("entity"))


@query("""SELECT c_custkey FROM customer WHERE c_acctbal <= 9900 AND (c_nationkey, c_mktsegment) NOT IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9900)""")
def c05_twin_exclusion(spark, sf):
    c = read(spark, sf, "customer").withColumn("content", F.concat_ws("|", "c_nationkey", "c_mktsegment"))
    return S.without_twins(c.where("c_acctbal <= 9900"), c.where("c_acctbal > 9900"), "content").select("c_custkey")


@query(f"WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY source, term ORDER BY stream, entity) AS k FROM cand) SELECT source, term, entity, stream FROM r WHERE k = 1")
def d09_first_of_group(spark, sf):
    return S.unseen_first_collapse(candidates(spark, sf), ["source"], [F.col("stream"), F.col("entity")]).select("source", "term", "entity", "stream")


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS rank FROM pairs) SELECT entity, term, score, rank::INTEGER AS rank FROM r WHERE rank <= 2")
def e02_top_terms(spark, sf):
    return S.top_n(all_pairs(spark, sf), 2).select("entity", "term", "score", "rank")


@query(f"""WITH {PAIRS}, r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS k, avg(score) OVER w AS m, stddev_pop(score) OVER w AS s,
rank() OVER (PARTITION BY entity ORDER BY score) + (count(*) OVER (PARTITION BY entity, score) - 1) / 2 AS ar FROM pairs WINDOW w AS (PARTITION BY entity))
SELECT entity, term, CASE WHEN n > 1 THEN (k - 1) / (n - 1) ELSE 0 END::DOUBLE AS norm_rank, round((score - m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END, 6) + 0.0 AS z, ar / n AS percentile, (k <= 1)::INTEGER AS top1, (k <= 3)::INTEGER AS top3 FROM r""")
def e03_within_entity(spark, sf):
    return S.within_entity(all_pairs(spark, sf)).select("entity", "term", "norm_rank", (F.round("z", 6) + 0.0).alias("z"), "percentile", "top1", "top3")


@query(f"WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY label DESC, {h('7', 'source', 'term')}, term) AS k FROM (SELECT DISTINCT source, term, max(label) AS label FROM cand GROUP BY ALL)) SELECT source, term, label FROM r WHERE k <= 150")
def e05_group_cap(spark, sf):
    rows = candidates(spark, sf).groupBy("source", "term").agg(F.max("label").alias("label"))
    return S.cap_groups(rows, ["source"], 150, seed="7")


@query(f"""WITH {PAIRS}, x AS (SELECT entity, term, label, term % 7 AS cell FROM pairs), r AS (SELECT *, sum(label) OVER (PARTITION BY cell) AS p, row_number() OVER (PARTITION BY cell, label ORDER BY {h('3', 'entity', 'term')}, entity, term) AS k FROM x)
SELECT entity, term, label FROM r WHERE label = 1 OR k <= floor(p * 1.5)""")
def e06_negative_sampling(spark, sf):
    rows = all_pairs(spark, sf).select("entity", "term", "label", (F.col("term") % 7).alias("cell"))
    return S.thin_negatives(rows, 1.5, ["cell"], ["entity", "term"], seed="3").select("entity", "term", "label")


@query(f"""WITH {CAND}, c AS (SELECT category, sum(label) AS p, sum(1 - label) AS n FROM cand GROUP BY ALL), s AS (SELECT category, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 30000.0::DOUBLE / (SELECT count(*) FROM c) - p) / greatest(n, 1)) AS share FROM c)
SELECT entity, term, stream, label FROM cand JOIN s USING (category) WHERE label = 1 OR {h('5', 'entity', 'term', 'stream')} < share * 4294967296.0::DOUBLE""")
def e07_row_budget(spark, sf):
    return S.budget(candidates(spark, sf), "category", 30_000, ["entity", "term", "stream"], seed="5").select("entity", "term", "stream", "label")


@query(f"WITH {PAIRS} SELECT entity, term, ({h('9', 'CAST(entity AS VARCHAR)')} < 0.1 * 4294967296.0)::INTEGER AS validation FROM pairs")
def e08_entity_split(spark, sf):
    return S.split(all_pairs(spark, sf), 0.1, seed="9").select("entity", "term", "validation")


@query(f"WITH {CAND} SELECT entity, stream, (snapshot = 1998)::INTEGER AS validation FROM cand")
def e08_temporal_split(spark, sf):
    return S.temporal_split(candidates(spark, sf), 1998).select("entity", "stream", "validation")


@query(f"SELECT o_orderkey AS entity, ({h('2', 'CAST(o_orderkey AS VARCHAR)')} % 5)::INTEGER AS fold FROM orders")
def e09_hash_folds(spark, sf):
    return S.folds(read(spark, sf, "orders").select(F.col("o_orderkey").alias("entity")), 5, seed="2")


@query(f"WITH {CAND}, x AS (SELECT entity, term, stream, (2 + {h('4', 'CAST(entity AS VARCHAR)')} % 3)::INTEGER AS k FROM cand) SELECT * FROM x WHERE stream <= k")
def e11_k_draw(spark, sf):
    return S.draw_k(candidates(spark, sf), 2, 4, seed="4").select("entity", "term", "stream", "k")


@query(f"WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {h('6', 'p_partkey')}, p_partkey) AS k FROM part) SELECT p_brand, p_partkey FROM r WHERE k <= 3")
def e12_stratified_sample(spark, sf):
    return S.stratified(read(spark, sf, "part"), "p_brand", 3, ["p_partkey"], seed="6").select("p_brand", "p_partkey")


@query(f"SELECT c_custkey FROM customer WHERE {h('8', 'c_custkey')} % 4 = 0")
def e13_pool_draw(spark, sf):
    return S.pool_draw(read(spark, sf, "customer"), 4, ["c_custkey"], seed="8").select("c_custkey")


@query("""WITH c AS (SELECT quantile_cont(o_totalprice, [1/3, 2/3]) AS q FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice <= q[1] THEN 0 WHEN o_totalprice <= q[2] THEN 1 ELSE 2 END AS tertile FROM orders, c""")
def e15_tertiles(spark, sf):
    return S.tertiles(read(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "tertile")


@query(f"""WITH {CAND}, a AS (SELECT entity, term, max(score) AS score FROM cand GROUP BY ALL), b AS (SELECT entity, term, max(score2) AS score FROM cand GROUP BY ALL),
ra AS (SELECT entity, score, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS k FROM a), rb AS (SELECT entity, term, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS k FROM b) SELECT entity, term, score FROM rb JOIN ra USING (entity, k)""")
def e20_rank_match(spark, sf):
    c = candidates(spark, sf).groupBy("entity", "term").agg(F.max("score").alias("a"), F.max("score2").alias("b"))
    return S.rank_match(c.select("entity", "term", F.col("a").alias("score")), c.select("entity", "term", F.col("b").alias("score")))


@query(f"""WITH {PAIRS}, x AS (SELECT term % 5 AS cell, * FROM pairs), a AS (SELECT cell, entity, term, row_number() OVER (PARTITION BY cell ORDER BY {h('p', 'entity', 'term')}, entity, term) AS k FROM x),
b AS (SELECT cell, score, row_number() OVER (PARTITION BY cell ORDER BY {h("p''", 'entity', 'term')}, entity, term) AS k FROM x) SELECT cell, entity, term, score FROM a JOIN b USING (cell, k)""")
def e21_permutation_control(spark, sf):
    return S.permuted(all_pairs(spark, sf).select((F.col("term") % 5).alias("cell"), "entity", "term", "score"), "cell", "p")


@query(f"""WITH {PAIRS}, x AS (SELECT entity, term, label, term % 7 AS cell FROM pairs), r AS (SELECT *, sum(label) OVER (PARTITION BY cell) AS p, row_number() OVER (PARTITION BY cell, label ORDER BY {h('3', 'entity', 'term')}, entity, term) AS k FROM x)
SELECT cell, count(*) AS rows_before, sum(label)::BIGINT AS positives_before, count(*) FILTER (label = 1 OR k <= p) AS rows_after, sum(label)::BIGINT AS positives_after,
round((count(*) FILTER (label = 1 OR k <= p) - sum(label)) / sum(label), 9) AS ratio FROM r GROUP BY cell""")
def d23_sampling_audit(spark, sf):
    rows = all_pairs(spark, sf).select("entity", "term", "label", (F.col("term") % 7).alias("cell"))
    return S.sampling_audit(rows, S.thin_negatives(rows, 1.0, ["cell"], ["entity", "term"], seed="3"), "cell").withColumn("ratio", F.round("ratio", 9))
