"""Queries of blends and unions of candidate streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import fusion as X

from .registry import query
from .tables import CAND, candidates

_STREAMS = f"""{CAND}, a AS (SELECT entity, term, max(score) AS score FROM cand WHERE stream IN (1, 2) GROUP BY ALL), b AS (SELECT entity, term, max(score2) AS score FROM cand WHERE stream IN (2, 3) GROUP BY ALL),
truth AS (SELECT DISTINCT entity, term FROM cand WHERE label = 1), u AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.term, b.term) AS term, a.score AS a, b.score AS b FROM a FULL JOIN b ON a.entity = b.entity AND a.term = b.term)"""


def streams(spark, sf):
    c = candidates(spark, sf)
    return X.collapse(c.where("stream in (1, 2)")), X.collapse(c.where("stream in (2, 3)").withColumn("score", F.col("score2")))


def truth(spark, sf):
    return candidates(spark, sf).where("label = 1").select("entity", "term").distinct()


def _round(df):
    return df.withColumn("score", F.round("score", 9))


@query(f"WITH {_STREAMS} SELECT entity, term, coalesce(a, 2.0)::DOUBLE AS a, coalesce(b, 0.0)::DOUBLE AS b, (a IS NOT NULL)::INTEGER AS in_a, (b IS NOT NULL)::INTEGER AS in_b FROM u")
def c06_stream_union(spark, sf):
    a, b = streams(spark, sf)
    return X.union_streams({"a": a, "b": b}, {"a": 2.0})


@query(f"WITH {_STREAMS} SELECT entity, term, round(greatest(coalesce(a, 0), 0.8::DOUBLE * coalesce(b, 0)), 9) AS score FROM u")
def c07_max_blend(spark, sf):
    return _round(X.max_blend(*streams(spark, sf), 0.8))


@query(f"WITH {_STREAMS} SELECT entity, term, round(CASE WHEN b IS NOT NULL THEN least(1.0::DOUBLE, a + 0.1::DOUBLE) ELSE a END, 9) AS score FROM u WHERE a IS NOT NULL")
def c07_agreement_boost(spark, sf):
    return _round(X.agreement_boost(*streams(spark, sf), 0.1))


@query(f"WITH {_STREAMS} SELECT entity, term, greatest(coalesce(a, 0), coalesce(b, 0)) AS score FROM u WHERE entity IN (SELECT entity FROM a)")
def c08_graft(spark, sf):
    return X.graft(*streams(spark, sf))


@query(f"WITH {_STREAMS} SELECT entity, term, round(1 - (1 - coalesce(a, 0)) * (1 - 0.5::DOUBLE * coalesce(b, 0)), 9) AS score FROM u")
def c09_noisy_or(spark, sf):
    return _round(X.noisy_or(*streams(spark, sf), 0.5))


@query(f"""WITH {_STREAMS}, r AS (SELECT entity, term, score AS other, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS other_rank FROM b)
SELECT coalesce(a.entity, r.entity) AS entity, coalesce(a.term, r.term) AS term, a.score, r.other, r.other_rank::INTEGER AS other_rank, (a.entity IS NULL)::INTEGER AS appended FROM a FULL JOIN r ON a.entity = r.entity AND a.term = r.term""")
def c10_append_only(spark, sf):
    return X.append_only(*streams(spark, sf))


@query(f"WITH {_STREAMS} SELECT entity, term, score FROM a UNION ALL SELECT entity, term, score FROM b WHERE entity NOT IN (SELECT entity FROM a)")
def c17_fallback(spark, sf):
    return X.fallback(*streams(spark, sf))


@query(f"WITH {CAND} SELECT entity, term, sum(score) / 3 AS score FROM cand WHERE stream <= 3 GROUP BY ALL")
def d07_seed_average(spark, sf):
    return X.seed_average(candidates(spark, sf).where("stream <= 3"), 3)


@query(f"WITH {CAND} SELECT entity, term, max(score) AS score FROM cand GROUP BY ALL")
def d08_collapse(spark, sf):
    return X.collapse(candidates(spark, sf))


@query(f"WITH {CAND}, p AS (SELECT entity, term, count(DISTINCT stream) AS streams, max(label) AS label FROM cand GROUP BY ALL) SELECT streams, count(*) AS pairs, round(avg(label), 9) AS rate FROM p GROUP BY streams")
def d10_duplicate_lift(spark, sf):
    return X.duplicate_lift(candidates(spark, sf)).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {_STREAMS}, x AS (SELECT (a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER AS level, CASE WHEN t.entity IS NULL THEN 0 ELSE 1 END AS y FROM u LEFT JOIN truth t USING (entity, term)), e AS (SELECT level, count(*) AS n, sum(y) AS h FROM x GROUP BY ALL)
SELECT level, n AS rows, round(h / n, 9) AS precision, (sum(n) OVER d)::BIGINT AS rows_or_more, round(sum(h) OVER d / sum(n) OVER d, 9) AS precision_or_more FROM e WINDOW d AS (ORDER BY level DESC)""")
def d24_consensus_curve(spark, sf):
    a, b = streams(spark, sf)
    u = X.union_streams({"a": a, "b": b}).join(truth(spark, sf).withColumn("y", F.lit(1)), ["entity", "term"], "left").withColumn("label", F.coalesce("y", F.lit(0)))
    return X.consensus_curve(u, ["in_a", "in_b"]).withColumns({c: F.round(c, 9) for c in ("precision", "precision_or_more")})


@query(f"""WITH {_STREAMS}, x AS (SELECT u.*, t.entity IS NOT NULL AS y FROM u LEFT JOIN truth t USING (entity, term))
SELECT 'a' AS stream, count(*) FILTER (y) AS covers, count(*) FILTER (y) AS covers_first, count(*) FILTER (NOT y) AS false_rows FROM x WHERE a IS NOT NULL
UNION ALL SELECT 'b', count(*) FILTER (y), count(*) FILTER (y AND a IS NULL), count(*) FILTER (NOT y) FROM x WHERE b IS NOT NULL""")
def d25_union_recall(spark, sf):
    a, b = streams(spark, sf)
    return X.union_recall({"a": a, "b": b}, truth(spark, sf))


@query(f"WITH {CAND} SELECT term, count(*) AS n, round((sum(label) + 5 * (SELECT avg(label) FROM cand)) / (count(*) + 5), 9) AS prior FROM cand GROUP BY term")
def d40_term_prior(spark, sf):
    return X.term_prior(candidates(spark, sf), 5.0).withColumn("prior", F.round("prior", 9))
