"""Operators on small inputs with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import codes, encoding, evidence, fusion, metrics, models, ontology, reports, resampling, retrieval, staging

CHAIN = [("LEAF", "MID"), ("MID", "ROOT")]


def scores(spark, values, entity="e"):
    return spark.createDataFrame([(entity, t, float(s)) for t, s in values.items()], "entity string, term string, score double")


def as_dict(df, key="term", value="score"):
    return {r[key]: r[value] for r in df.collect()}


def test_marginals_on_a_chain(spark):
    edges = spark.createDataFrame(CHAIN, "child string, parent string")
    nodes = spark.createDataFrame([("LEAF",), ("MID",), ("ROOT",)], "term string")
    got = as_dict(ontology.marginals(scores(spark, {"ROOT": 0.8, "MID": 0.5, "LEAF": 0.5}), edges, nodes))
    assert got == pytest.approx({"ROOT": 0.8, "MID": 0.4, "LEAF": 0.2})


def test_consistency_and_soft_propagation(spark):
    edges = spark.createDataFrame(CHAIN, "child string, parent string")
    fixed, rounds = ontology.consistency(scores(spark, {"LEAF": 0.9, "MID": 0.3, "ROOT": 0.2}), edges)
    assert as_dict(fixed) == {"LEAF": 0.9, "MID": 0.9, "ROOT": 0.9} and rounds
    same, rounds = ontology.consistency(fixed, edges)
    assert rounds == 0 and as_dict(same) == as_dict(fixed)
    assert as_dict(ontology.soft_propagation(scores(spark, {"ROOT": 0.6, "MID": 0.2, "LEAF": 0.8}), edges)) == pytest.approx({"ROOT": 0.74, "MID": 0.62, "LEAF": 0.62})


def test_closure_rejects_a_cycle(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError):
        ontology.depths(loop.unionByName(spark.createDataFrame([("a", "r")], "child string, parent string")), spark.createDataFrame([("a",), ("b",), ("r",)], "term string"), longest=True, max_depth=5)


def test_information_content(spark):
    closed = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r"), (4, "r"), (1, "a")], "entity int, term string")
    assert as_dict(ontology.information_content(closed), value="ic") == pytest.approx({"r": 0.0, "a": math.log(4)})


def test_information_content_by_aspect(spark):
    closed = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r"), (4, "r"), (1, "s"), (2, "s"), (1, "t")], "entity int, term string")
    aspects = spark.createDataFrame([("r", "x"), ("s", "y"), ("t", "y")], "term string, aspect string")
    assert as_dict(ontology.information_content(closed, aspects), value="ic") == pytest.approx({"r": 0.0, "s": 0.0, "t": math.log(2)})


def test_temporal_split_of_an_absent_snapshot_is_empty(spark):
    rows = spark.createDataFrame([("e", "v1-v2"), ("f", "v2-v3")], "entity string, snapshot string")
    assert staging.temporal_split(rows, "v9-v10").agg(F.sum("validation")).first()[0] == 0
    assert as_dict(staging.temporal_split(rows, "v1-v2"), "entity", "validation") == {"e": 1, "f": 0}


def test_samples_keep_positives_and_repeat(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("entity"), F.col("id").alias("term"), (F.expr("id div 10") % 20 == 0).cast("int").alias("label"))
    thin = staging.thin_negatives(rows, 2.0, ["entity"], ["entity", "term"])
    assert thin.where("label = 1").count() == 50 and thin.where("label = 0").count() == 100
    assert sorted(thin.collect()) == sorted(staging.thin_negatives(rows.repartition(7), 2.0, ["entity"], ["entity", "term"]).collect())
    assert staging.cap_groups(rows, ["entity"], 30).groupBy("entity").count().agg(F.max("count")).first()[0] == 30


def test_bands_and_null_rules(spark):
    rows = spark.createDataFrame([(None, None), (1994, None), (1995, None), (1995, 6), (1995, 7), (1996, 1)], "y int, m int")
    assert rows.where(encoding.before(F.col("y"), F.col("m"), (1995, 7))).count() == 4
    words = encoding.vocabulary(spark.createDataFrame([("b",), ("a",), (None,)], "c string"), "c")
    coded = encoding.encode(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", words, "code")
    assert sorted(r.code for r in coded.collect()) == [-1, -1, 0]


def test_blends(spark):
    a, b = scores(spark, {"x": 0.5, "y": 0.2}), scores(spark, {"y": 0.4, "z": 0.6})
    assert as_dict(fusion.noisy_or(a, b, 0.5)) == pytest.approx({"x": 0.5, "y": 1 - 0.8 * 0.8, "z": 0.3})
    assert as_dict(fusion.agreement_boost(a, b, 0.9)) == pytest.approx({"x": 0.5, "y": 1.0})


def test_metrics_of_perfect_and_empty_predictions(spark):
    truth = spark.createDataFrame([("e", "x"), ("f", "y")], "entity string, term string")
    perfect = spark.createDataFrame([("e", "x", 0.9), ("f", "y", 0.9)], "entity string, term string, score double")
    assert metrics.best(metrics.micro_f_curve(perfect, truth)).first().f == 1.0
    assert metrics.best(metrics.fmax_curve(perfect, truth)).first().f == 1.0
    assert metrics.micro_f_curve(perfect.limit(0), truth).count() == 0
    assert metrics.auroc(perfect.withColumn("label", F.lit(1))).first().auc is None


def test_nearest_across_blocks(spark):
    v = spark.createDataFrame([(i, [math.cos(i * i / 600), math.sin(i * i / 600)]) for i in range(40)], "id long, v array<double>").repartition(3)
    one, many, few = (sorted((r.query, r.reference, r["rank"]) for r in retrieval.nearest(v, v, 3, **how).collect()) for how in ({}, {"side": 0, "block": 7}, {"side": 0, "block": 1}))
    assert one == many == few and len(one) == 120
    assert {r for r in one if r[0] == 20} == {(20, 19, 1), (20, 21, 2), (20, 18, 3)}
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "id long, v array<double>")  # ties by id, across blocks and parts
    for how in ({}, {"side": 0, "block": 4}):
        got = {}
        for r in retrieval.nearest(same, same, 3, **how).collect():
            got.setdefault(r.query, {})[r["rank"]] = r.reference
        assert all(list(got[i][k] for k in (1, 2, 3)) == [j for j in range(5) if j != i][:3] for i in range(30))
    assert retrieval.nearest(v, v.limit(0), 3).count() == 0 and retrieval.nearest(v, v.limit(2), 3).count() == 40 * 2 - 2


def test_max_sim_is_the_mean_of_best_cosines(spark):
    units = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 2.0]), ("b", 0, [3.0, 3.0]), ("c", 0, [0.0, 0.0])], "entity string, pos int, v array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c"), ("a", "none")], "a string, b string")
    h = math.sqrt(0.5)
    got = {(r.a, r.b): (r.a_in_b, r.b_in_a) for r in retrieval.max_sim(pairs, units).collect()}
    assert got == {("a", "b"): pytest.approx((h, h)), ("b", "a"): pytest.approx((h, h)), ("a", "a"): (1.0, 1.0), ("a", "c"): (0.0, 0.0)}


def test_sums_by_arrays_are_those_of_weighted_rows(spark):
    per = spark.range(700).select(F.col("id").alias("entity"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") / 10).alias("y"))
    n = 21
    rows = resampling.resample(per, n, "s").groupBy("resample").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("x")).alias("x"), F.sum(F.col("weight") * F.col("y")).alias("y"))
    want = {r.resample: (r.weight, r.x, pytest.approx(r.y)) for r in rows.collect()}
    got = {r.resample: (r.weight, r.x, r.y) for r in resampling.resampled_sums(per, ["x", "y"], n, "s").collect()}
    assert len(want) == n and got == want and resampling.resampled_sums(per.limit(0), ["x"], n).count() == 0


def test_miss_classes_of_each_kind(spark):
    edges = spark.createDataFrame([("mid", "root"), ("leaf", "mid"), ("twin", "mid"), ("far", "root")], "child string, parent string")
    over = ontology.ancestors(edges, reflexive=True, nodes=spark.createDataFrame([(t,) for t in ("root", "mid", "leaf", "twin", "far")], "term string"))
    said = spark.createDataFrame([("a", "leaf"), ("b", "mid"), ("c", "leaf"), ("d", "twin"), ("e", "far")], "entity string, term string")
    true = spark.createDataFrame([("a", "leaf"), ("b", "leaf"), ("c", "mid"), ("d", "leaf"), ("e", "leaf"), ("f", "leaf"), ("a", "leaf")], "entity string, term string")
    got = {(r.entity, r.term): r["class"] for r in reports.miss_classes(said, true, over, edges).collect()}
    assert got == {("a", "leaf"): "hit", ("b", "leaf"): "too_shallow", ("c", "mid"): "overshot", ("d", "leaf"): "sibling", ("e", "leaf"): "other", ("f", "leaf"): "other"}


def test_promotion_and_bootstrap(spark):
    runs = spark.createDataFrame([("t", 1, "a", 0.5, 0.4), ("t", 2, "b", 0.55, 0.49), ("t", 3, "c", 0.6, 0.52), ("t", 4, "d", 0.58, 0.55)], "tier string, k int, name string, mean double, low double")
    assert as_dict(reports.promotion_walk(runs, ["tier"], ["k"]), "name", "promoted") == {"a": True, "b": False, "c": True, "d": False}
    per = spark.range(300).select(F.col("id").alias("entity"), (F.lit(1.0) + F.col("id") % 3 / 10).alias("a"), (F.col("id") % 3 / 10).alias("b"))
    r = resampling.mean_difference(per, "a", "b", 50).first()
    assert r.mean == pytest.approx(1.0) and r.separates and r.p == 0.0
    adjusted = as_dict(resampling.holm(spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "name string, p double"), "p"), "name", "adjusted")
    assert adjusted == pytest.approx({"x": 0.03, "z": 0.06, "y": 0.06})


def test_calibration_falls_back(spark):
    rows = spark.createDataFrame([("big", i / 200, int(i > 100)) for i in range(200)] + [("tiny", 0.3, 1)], "aspect string, score double, label int")
    got = models.calibrate(rows, "aspect")
    assert got.where("aspect = 'tiny'").first().calibrated == 0.3
    low, high = got.where("aspect = 'big'").agg(F.min("calibrated"), F.max("calibrated")).first()
    assert (low, high) == (0.0, 1.0)


def test_recursive_soft_propagation_against_recursion(spark):
    import random

    r = random.Random(3)
    parents = {k: sorted({k // 2, k // 3} - {0}) for k in range(1, 60)}
    parents[1] = []
    scores_ = {(e, t): r.random() for e in range(4) for t in r.sample(range(1, 60), 9)}
    edges = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in ps], "child int, parent int")
    nodes = spark.createDataFrame([(k,) for k in parents], "term int")
    got = {(x.entity, x.term): x.score for x in ontology.recursive_soft_propagation(spark.createDataFrame([(e, t, s) for (e, t), s in scores_.items()], "entity int, term int, score double"), edges, nodes, ontology.ancestors(edges, nodes=nodes)).collect()}
    above = lambda t: {t}.union(*map(above, parents[t]))
    for e in range(4):
        every = set().union(*(above(t) for (x, t) in scores_ if x == e))
        low, high = {}, {}

        def down(t, e=e, low=low):
            if t not in low:
                own = scores_.get((e, t), 0.0)
                low[t] = 0.7 * min(down(p) for p in parents[t]) + 0.3 * own if parents[t] else own
            return low[t]

        def up(t, e=e, every=every, high=high):
            if t not in high:
                children, own = [c for c in every if t in parents[c]], scores_.get((e, t), 0.0)
                high[t] = 0.7 * max(map(up, children)) + 0.3 * own if children else own
            return high[t]

        for x, t in scores_:
            if x == e:
                assert got[e, t] == pytest.approx((down(t) + up(t)) / 2)


def test_isotonic_calibration_is_pooled_adjacent_violators(spark):
    import numpy as np

    r = np.random.default_rng(4)
    s = r.random(300).round(3)
    y = (r.random(300) < s**2).astype(int)
    rows = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(s, y, strict=True)], "grp string, score double, label int")
    blocks = []
    for x in sorted(set(s.tolist())):
        blocks.append([y[s == x].mean(), float((s == x).sum()), [x]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (m1, w1, x1), (m2, w2, x2) = blocks[-2:]
            blocks[-2:] = [[(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, x1 + x2]]
    want = {x: m for m, _, xs in blocks for x in xs}
    out = models.calibrate(rows, "grp")
    assert all(x.calibrated == pytest.approx(want[x.score], abs=1e-9) for x in out.collect())
    stats = models.calibration_stats(out, "grp").first()
    assert stats.n == 300 and stats.positives == y.sum() and stats.brier_after < stats.brier_before and stats.mean_after == pytest.approx(y.mean())


def test_platt_finds_the_logistic_curve_and_terciles_fall_back(spark):
    import numpy as np

    r = np.random.default_rng(5)
    s = r.random(4000)
    y = r.random(4000) < 1 / (1 + np.exp(-(6 * s - 3)))
    rows = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(s, y, strict=True)], "grp string, score double, label int")
    got = models.calibrate(rows, "grp", method="platt").collect()
    assert max(abs(x.calibrated - 1 / (1 + math.exp(-(6 * x.score - 3)))) for x in got) < 0.06
    few = rows.limit(300).withColumn("term", F.expr("int(score * 40)")).withColumn("w", F.lit(1.0))
    frequency = few.groupBy("term").agg(F.count("*").alias("n"))
    parts = models.tercile_calibrate(few, frequency, "w", least=10_000)
    whole = models.calibrate(few.withColumn("grp", F.lit("all")), "grp")
    assert sorted((x.score, round(x.calibrated, 9)) for x in parts.collect()) == sorted((x.score, round(x.calibrated, 9)) for x in whole.collect())
    assert {x.tercile for x in parts.select("tercile").distinct().collect()} <= {0, 1, 2}


def test_principal_axes_are_those_of_the_covariance(spark):
    import numpy as np

    x = np.random.default_rng(6).normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = np.array([r.projected for r in models.principal_axes(rows, "v", 2).orderBy("id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ axes[:2].T), atol=1e-6)


def test_reranker_ranks_what_its_features_tell(spark):
    import numpy as np

    r = np.random.default_rng(7)
    rows = [(float(a), float(b), int(a + 0.1 * r.normal() > 0.5)) for a, b in r.random((800, 2))]
    frame = spark.createDataFrame(rows, "a double, b double, label int")
    scored, auc = models.rerank(frame.limit(500), frame.subtract(frame.limit(500)), ["a", "b"], trees=5, depth=3)
    assert auc > 0.9 and scored.where("reranked < 0 or reranked > 1").count() == 0
    gaps = frame.withColumn("a", F.when(F.col("label") == 0, F.col("a")))  # what is missing tells, although 0 stands in its place
    told, auc = models.rerank(gaps.limit(500), gaps.subtract(gaps.limit(500)), ["a"], trees=3, depth=2)
    assert auc > 0.99
    folds = frame.withColumn("fold", F.expr("int(b * 3)"))
    out = models.out_of_fold(folds, ["a", "b"], 3)
    assert out.count() == folds.count() and out.where("(out_of_fold > 0.5) = (label = 1)").count() > 0.8 * folds.count()


def test_structure_block_is_a_truncated_decomposition(spark):
    import numpy as np

    edges = spark.createDataFrame([(c, p) for c in range(2, 40) for p in sorted({c // 2, c // 3} - {0})], "child long, parent long")
    over = ontology.ancestors(edges)
    got = {r.term: r.v for r in codes.structure_block(over, 4).collect()}
    x = np.zeros((40, 40))
    for r in over.collect():
        x[r.term, r.ancestor] = 1
    u, s, _ = np.linalg.svd(x)
    want = (u[:, :4] * s[:4]) @ (u[:, :4] * s[:4]).T
    mine = np.array([got.get(t, [0.0] * 4) for t in range(40)])
    assert np.allclose(mine @ mine.T, want, atol=1e-6)


def test_band_check_refuses_foreign_versions(spark):
    registry = spark.createDataFrame([("a", [1, 2])], "band string, versions array<int>")
    good = spark.createDataFrame([("a", 1)], "band string, version int")
    assert evidence.require_bands(good, registry).count() == 1
    with pytest.raises(ValueError):
        evidence.require_bands(good.unionByName(spark.createDataFrame([("b", 1), ("a", None)], "band string, version int")), registry)


def test_graded_support_of_every_order_and_pair(spark, small):
    from rankloom.operators import sets
    from rankloom.plans import pools, tables

    lines = [tuple(r) for r in tables.read(spark, small, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").collect()]
    above = {}
    for k in sorted(r.p_partkey for r in tables.read(spark, small, "part").select("p_partkey").collect()):
        above[k] = {k}.union(*(above.get(p, {p}) for p in {k // 2, k // 3} if p >= 1))
    said, own = {}, {}
    for order, supplier, part in lines:
        said.setdefault(supplier, set()).update(above.get(part, ()))
        own.setdefault(order, set()).add(supplier)
    # every order has a row for each closed term of any of its suppliers, whatever the year and quantity
    want = sum(len(set().union(*(said[s] for s in mine))) for mine in own.values())
    got = pools.h28_graded_support(spark, small)
    assert got.count() == want
    assert got.select("entity").distinct().count() == len(own)
    one = min(own)
    assert {(r.term, r.support) for r in got.where(f"entity = {one}").collect()} == {(t, round(sum(t in said[s] for s in own[one]) / len(own[one]), 9)) for s in own[one] for t in said[s]}
    ann = spark.createDataFrame([(e, s) for e, mine in own.items() if e < 50 for s in mine], "entity long, signature long")
    implies = spark.createDataFrame([(s, p) for _, s, p in lines], "signature long, term long").distinct()
    closure = tables.closure(spark, small)
    wide, dealt = (sets.graded_support(ann, implies, closure, most=m, rows_a_task=500) for m in (10**6, 0))
    assert wide.exceptAll(dealt).isEmpty() and dealt.exceptAll(wide).isEmpty() and not dealt.isEmpty()
