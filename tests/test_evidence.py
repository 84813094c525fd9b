"""Aggregation orders, hard negatives, evidence of donors, bucketed tables and recall against plain code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import codes, encoding, evidence, ontology, retrieval
from rankloom.sources import writers

UNITS = "e string, v array<double>"


def local(spark, rows, entity="e"):
    return spark.createDataFrame([(entity, [float(x) for x in r]) for r in rows], UNITS)


def atoms(df):
    return {r.atom: r.value for r in df.collect()}


def test_weak_everywhere_against_strong_once(spark):
    units = local(spark, [[7, 3], [0, 3], [0, 3]])  # the window where the orders differ: 6 < 7 < 9
    assert atoms(codes.aggregate_then_sparsify(units, "e", "v", 1)) == {1: pytest.approx(3)}
    assert atoms(codes.sparsify_aggregate_sparsify(units, "e", "v", 1, 1)) == {0: pytest.approx(7 / 3)}
    assert codes.orders_disagree(units, "e", "v", 1).first().disagree
    outside = local(spark, [[5, 3], [0, 3], [0, 3]])
    assert not codes.orders_disagree(outside, "e", "v", 1).first().disagree


def test_a_histogram_of_usage_is_no_code_of_k_atoms(spark):
    units = local(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 2]])
    got = {r.atom: (r.value, r.frequency) for r in codes.usage_histogram(units, "e", "v", 1).collect()}
    assert got == {0: pytest.approx((1 / 3, 1 / 3)), 1: pytest.approx((1 / 3, 1 / 3)), 2: pytest.approx((2 / 3, 1 / 3))}
    dense = local(spark, np.random.default_rng(0).random((5, 64)))
    assert codes.aggregate_then_sparsify(dense, "e", "v", 8).count() == 8


def test_refusals_of_the_orders_and_the_gate(spark):
    one = local(spark, np.random.default_rng(1).random((1, 32)))  # a single unit has no order
    with pytest.raises(ValueError, match="no difference to measure"):
        codes.refuse_collapsed_orders(codes.orders_disagree(one, "e", "v", 4))
    mixed = one.unionByName(local(spark, [[7, 3] + [0] * 30, [0, 3] + [0] * 30, [0, 3] + [0] * 30], "f"))
    assert codes.refuse_collapsed_orders(codes.orders_disagree(mixed, "e", "v", 1)) == 0.5
    with pytest.raises(ValueError, match="raise k or shrink the dictionary"):
        codes.refuse_collapsing_gate(128, 2048)
    codes.refuse_collapsing_gate(256, 2048)
    assert codes.expected_gated(128, 2048) == 8 and codes.expected_gated(5, 0) == 0 and codes.LEAST_GATED > 8


def test_a_gate_keeps_what_both_hold(spark):
    units = spark.createDataFrame([(1, "e", [3.0, 2.0, 0.0, 1.0]), (2, "e", [0.0, 0.0, 5.0, 1.0])], "id int, e string, v array<double>")
    code = spark.createDataFrame([("e", 0, 2.0), ("e", 2, 10.0), ("other", 1, 1.0)], "e string, atom int, value double")
    got = {(r.id, r.atom): r.value for r in codes.gated(units, "id", "e", "v", 2, code).collect()}
    assert got == {(1, 0): 6.0, (2, 2): 50.0}
    dense = spark.createDataFrame([("e", a, 1.0) for a in range(4)], code.schema)  # a gate of every atom changes no support
    assert {(r.id, r.atom) for r in codes.gated(units, "id", "e", "v", 2, dense).collect()} == {(1, 0), (1, 1), (2, 2), (2, 3)}


def test_selection_by_order(spark):
    code = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "entity string, atom int")
    got = {(r.order, r.atom): (r.n, r.share) for r in codes.atom_selection({"x": code, "y": code.where("entity = 'b'")}).collect()}
    assert got == {("x", 1): (2, 1.0), ("x", 2): (1, 0.5), ("y", 1): (1, 1.0), ("y", 2): (1, 1.0)}


def test_standardising_takes_the_corpus_moments(spark):
    x = np.random.default_rng(2).normal(size=(40, 6)) * np.array([1, 5, 1, 1, 1, 0]) + 3
    units = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id int, v array<double>")
    got = np.array([r.v for r in codes.standardised(units, "v", retrieval.corpus_moments(units, "v")).orderBy("id").collect()])
    spread = np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1)
    assert np.abs(got - (x - x.mean(axis=0)) / spread).max() < 1e-9


@pytest.mark.parametrize("block", [7, 2000])
def test_hard_negatives_keep_k_after_the_bound(spark, block):
    pick, random_ = random.Random(3), np.random.default_rng(3)
    x = random_.normal(size=(60, 5))
    x[10] = x[11]
    sets = {i: {pick.randint(0, 5) for _ in range(pick.randint(0, 4))} for i in range(60)}
    sets[5] = set(range(400))  # a long set is one more
    vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    terms = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "entity long, term int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    got = {}
    for r in codes.hard_negatives(vectors, terms, 4, 0.3, block).orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append((r.b, r.cosine, r.jaccard))
    for a in range(60):
        want = sorted((-round(float(u[a] @ u[b]), 9), b) for b in range(60) if b != a and alike(a, b) < 0.3)[:4]
        assert [b for b, _, _ in got[a]] == [b for _, b in want]
        assert all(c == pytest.approx(u[a] @ u[b]) and j == pytest.approx(alike(a, b)) for b, c, j in got[a])
    assert codes.hard_negatives(vectors.limit(0), terms, 4, 0.3).count() == 0


def test_pairs_of_sets_of_any_length(spark):
    long = list(range(500))
    sets = spark.createDataFrame([(1, t) for t in long] + [(2, t) for t in long[:450]] + [(3, 900)], "entity int, term int")
    assert [(r.a, r.b, r.jaccard) for r in codes.neighbour_pairs(sets, 0.5).collect()] == [(1, 2, 0.9)]


def test_best_donors_and_what_they_bring(spark):
    neighbours = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.9), ("q", 3, 0.5), ("r", 3, 0.2)], "query string, reference int, cosine double")
    annotations = spark.createDataFrame([(1, "t", "weak"), (2, "t", "exp"), (3, "u", "exp"), (3, "u", "auth"), (3, "t", "exp")], "entity int, term string, tier string")
    targets = spark.createDataFrame([("q", "t"), ("q", "t"), ("q", "u"), ("q", "x"), ("r", "u"), ("none", "t")], "entity string, term string")
    found = evidence.donor_evidence(targets, neighbours, annotations)
    got = {(r.entity, r.term): (r.donors, r.donor, r.tier) for r in found.collect()}
    assert got == {("q", "t"): (3, 1, "weak"), ("q", "u"): (1, 3, "auth"), ("q", "x"): (0, None, None), ("r", "u"): (1, 3, "auth"), ("none", "t"): (0, None, None)}
    weights = spark.createDataFrame([("t", 2.0), ("u", 1.0)], "term string, ia double")
    mass = {r.tier: (r.n, r.mass, r.share) for r in evidence.donor_mass(found, weights).collect()}
    assert mass == {"weak": (1, 2.0, pytest.approx(1 / 3)), "auth": (2, 2.0, pytest.approx(1 / 3)), "none": (2, 2.0, pytest.approx(1 / 3))}


def test_mass_and_entities_by_evidence(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "entity string, term string")
    truth, delivered, pool = pairs([("e", "t"), ("e", "u"), ("f", "t"), ("f", "z")]), pairs([("e", "t")]), pairs([("e", "t"), ("e", "u"), ("e", "t")])
    weights = spark.createDataFrame([("t", 2.0), ("u", 1.0)], "term string, ia double")
    annotations = spark.createDataFrame([("e", "t", "exp"), ("g", "t", "exp"), ("e", "t", "iea"), ("g", "u", "iea"), ("e", "u", "iea")], "entity string, term string, tier string")
    classes = evidence.term_evidence(annotations, "exp", "iea")
    assert {r.term: r["class"] for r in classes.collect()} == {"t": "strong", "u": "weak"}
    got = {(r.tag, r["class"]): (r.n, r.mass, round(r.share, 6)) for r in evidence.mass_by_evidence(truth, delivered, pool, weights, classes).collect()}
    assert got == {
        ("true", "strong"): (2, 4.0, 0.8), ("true", "weak"): (1, 1.0, 0.2), ("true", "absent"): (1, 0.0, 0.0), ("delivered", "strong"): (1, 2.0, 1.0), ("missing", "strong"): (1, 2.0, 0.666667), ("missing", "weak"): (1, 1.0, 0.333333),
        ("missing", "absent"): (1, 0.0, 0.0), ("reachable", "strong"): (1, 2.0, 0.666667), ("reachable", "weak"): (1, 1.0, 0.333333), ("unreachable", "strong"): (1, 2.0, 1.0), ("unreachable", "absent"): (1, 0.0, 0.0),
    }
    reach = {r.reach: (r.entities, r.annotated, r.strong_share) for r in evidence.entity_evidence(truth, pool, annotations, "exp").collect()}
    assert reach == {"full": (1, 1, pytest.approx(1 / 3)), "lacking": (1, 0, None)}


def test_a_bucketed_table_is_grouped_without_an_exchange(spark):
    rows = spark.range(5000).select((F.col("id") % 300).alias("entity"), (F.col("id") % 7).alias("term"), F.col("id").alias("score"))
    table = writers.bucketed(rows, ["entity"], buckets=4, sort=["term"])
    grouped = table.groupBy("entity").agg(F.sum("score").alias("s"))
    joined = table.join(writers.bucketed(rows.where("term = 3").select("entity", "term"), ["entity"], buckets=4).withColumnRenamed("term", "t2"), "entity")
    ranked = table.select("entity", F.row_number().over(codes.Window.partitionBy("entity").orderBy("term")).alias("k"))
    for frame in (grouped, ranked):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in joined.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, rows.groupBy("entity").agg(F.sum("score")).collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_candidate_recall_raw_and_propagated(spark):
    over = ontology.ancestors(spark.createDataFrame([("leaf", "mid"), ("mid", "root")], "child string, parent string"), reflexive=True, nodes=spark.createDataFrame([("leaf",), ("mid",), ("root",)], "term string"))
    rows = spark.createDataFrame([("c", "e", "leaf", 1), ("c", "e", "root", 0), ("c", "f", "mid", 0), ("d", "e", "mid", 0)], "cell string, entity string, term string, label int")
    got = {r.cell: tuple(r)[1:] for r in ontology.candidate_recall(rows, over, "cell").collect()}
    assert got == {"c": (3, 2, 1, 2, 1.0, pytest.approx(2 / 3)), "d": (1, 1, 0, 0, 0.0, 0.0)}


def test_feature_choice_and_filling(spark):
    families = {"a": ["x", "y"], "b": ["z", "k"], "lineage": ["lineage_q"]}
    assert encoding.selected_features(families, ["x", "z", "k", "lineage_q"], ["k"]) == (["x", "z"], ["k"])
    assert encoding.selected_features(families, ["x", "z", "k"], ["k"], use=["b"], drop=["z"]) == ([], ["k"])
    assert encoding.selected_features(families, ["x", "z", "k"], ["k"], override=["k", "z", "k", "gone"]) == (["z"], ["k"])
    rows = spark.createDataFrame([("nk", 1, 0.5), ("LK", 2, None)], "category string, knn int, prior double")
    assert [tuple(r) for r in encoding.score_vector(rows, {"knn": ["knn"], "prior": ["prior"]}, ["prior"], "category").collect()] == [("nk", 1.0, None), ("LK", 2.0, None)]
    full = encoding.filled(rows, ["prior", "absent"], ["code"]).collect()
    assert [(r.prior == r.prior, r.absent == r.absent, r.code) for r in full] == [(True, False, -1.0), (False, False, -1.0)]
    shown = spark.createDataFrame([("F",), ("p",), ("CCO",), ("?",), (None,)], "a string").select(encoding.aspect_name(F.col("a")).alias("n"))
    assert [r.n for r in shown.collect()] == ["mfo", "bpo", "cco", None, None]


def test_dates_by_period(spark):
    rows = spark.createDataFrame([("en", "2024-01-01", 1), ("en", "2024-02-01", 1), ("en", None, 1), ("de", "2024-03-01", 1), ("en", "2024-01-02", 0)], "lang string, d string, t int").withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = {(r.category, r.bucket): r.n for r in evidence.date_tally(rows, "lang", F.col("t") == 1, "d", {"early": "2024-01-15", "mid": "2024-02-15"}).collect()}
    assert got == {("en", "early"): 1, ("en", "mid"): 1, ("en", "undated"): 1, ("de", "later"): 1}
