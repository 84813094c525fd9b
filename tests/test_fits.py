"""Grouped fits, lookups by snapshot, digests and pair similarity against plain code."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import codes, digests, fits, models, ontology, semantics, snapshots


def slow_isotonic(y, w):
    """The largest, over starts, of the least mean to any end."""
    n = len(y)
    mean = lambda j, k: sum(y[i] * w[i] for i in range(j, k + 1)) / sum(w[j : k + 1])
    return [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def test_pooling_is_isotonic_regression():
    pick = random.Random(1)
    for n in (1, 2, 7, 25):
        y, w = [pick.choice([0.0, 0.2, 0.5, 1.0]) for _ in range(n)], [pick.randint(1, 5) for _ in range(n)]
        assert fits.pooled(np.array(y), np.array(w, float)) == pytest.approx(slow_isotonic(y, w))


def test_curves_of_all_groups_at_once(spark):
    pick = random.Random(2)
    rows = [(g, round(pick.random(), 2), int(pick.random() < 0.5), float(pick.randint(1, 3))) for g in ("a", "b", None) for _ in range(300)]
    rows += [("one class", 0.5, 1, 1.0)] * 60 + [("few", 0.5, i % 2, 1.0) for i in range(9)] + [("a", None, 1, 1.0), ("a", float("nan"), 0, 1.0), ("b", 0.5, None, 1.0)]
    frame = spark.createDataFrame(rows, "grp string, score double, label int, w double")
    got = {(r.grp, r.score): r.calibrated for r in models.calibrate(frame, "grp", least=50, weight="w").collect() if r.score is not None and r.score == r.score}
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g and r[1] == r[1] and r[1] is not None and r[2] is not None]
        xs = sorted({r[1] for r in own})
        w = [sum(r[3] for r in own if r[1] == x) for x in xs]
        want = slow_isotonic([sum(r[3] * r[2] for r in own if r[1] == x) / t for x, t in zip(xs, w, strict=True)], w)
        assert [got[g, x] for x in xs] == pytest.approx(want)
    assert got["one class", 0.5] == 0.5 and got["few", 0.5] == 0.5
    assert models.calibrate(frame.limit(0), "grp").count() == 0
    curve = fits.isotonic_curves(frame.where("grp = 'a'"), ["grp"]).first().curve
    assert all(a <= b for a, b in itertools.pairwise(curve)) and len(curve) == 1001  # also between scores that nobody has
    # an ordered dealing of the same rows changes nothing
    again = {(r.grp, r.score): r.calibrated for r in models.calibrate(frame.repartition(17).orderBy("w"), "grp", least=50, weight="w").collect() if r.score is not None and r.score == r.score}
    assert all(again[k] == pytest.approx(v) for k, v in got.items())


def slow_logistic(x, y, w, rounds=60):
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.lstsq(z.T @ (z * (w * p * (1 - p))[:, None]), z.T @ (w * (y - p)), rcond=None)[0]
    return 1 / (1 + np.exp(-z @ beta))


def test_logistic_models_of_all_groups_at_once(spark):
    random_ = np.random.default_rng(3)
    rows = []
    for g, slope in ((1, 2.0), (2, -1.0), (None, 0.5)):
        for _ in range(250):
            a, b = random_.normal(), 40 + 9 * random_.normal()
            rows.append((g, float(a), float(b) if random_.random() > 0.2 else None, int(random_.random() < 1 / (1 + math.exp(-slope * a - 0.1 * (b - 40)))), float(random_.integers(1, 4))))
    rows += [(3, 1.0, 2.0, 1, 1.0)] * 5
    frame = spark.createDataFrame(rows, "g int, a double, b double, label int, w double")
    model = fits.fit_logistic(frame, ["g"], ["a", "b"], {"all": ["a", "b"], "no b": ["a"]}, weight="w")
    assert sorted(model.keys, key=str) == [(1,), (2,), (None,)]
    for arm in ("all", "no b"):
        scored = model.apply(frame.withColumn("i", F.monotonically_increasing_id()), arm, "p").collect()
        assert all(r.p is None for r in scored if r.g == 3)
        for g in (1, 2, None):
            own = [r for r in scored if r.g == g]
            mean = np.mean([r.b for r in own if r.b is not None])
            x = np.array([[r.a, *([mean if r.b is None else r.b, r.b is None] if arm == "all" else [])] for r in own], float)
            want = slow_logistic(x, np.array([r.label for r in own]), np.array([r.w for r in own]))
            assert np.abs(np.array([r.p for r in own]) - want).max() < 1e-6
            at = model.keys.index((g,))
            direct = model.scores(np.array([[r.a, np.nan if r.b is None else r.b] for r in own]), at)[:, list(model.arms).index(arm)]
            assert np.abs(direct - want).max() < 1e-6
    apart = spark.createDataFrame([(1, float(i), 0.0, int(i >= 50), 1.0) for i in range(100)], frame.schema)  # separable
    steep = fits.fit_logistic(apart, ["g"], ["a"]).apply(apart, "all", "p").collect()
    assert all(abs(r.p - r.label) < 0.01 for r in steep) and fits.fit_logistic(frame.limit(0), ["g"], ["a"]).keys == []


def slow_auc(scores, labels):
    pairs = [(a > b) + 0.5 * (a == b) for a, y in zip(scores, labels, strict=True) if y for b, z in zip(scores, labels, strict=True) if not z]
    return sum(pairs) / len(pairs)


def test_a_useless_family_loses_nothing_and_a_useful_one_its_worth(spark):
    random_ = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        label = int(random_.random() < 0.4)
        rows.append((f"c{i % 3}" if i % 3 else None, float(label + random_.normal()), float(0.3 * label + random_.normal()), 7.0, None, label))
    frame = spark.createDataFrame(rows, "cell string, good double, weak double, flat double, absent double, label int")
    train, test = frame.limit(900), frame.subtract(frame.limit(900))
    families = {"good": ["good"], "weak": ["weak"], "flat": ["flat"], "absent": ["absent"]}
    got = {(r.cell, r.family): r for r in fits.family_ablation(train, test, ["cell"], families).collect()}
    assert len(got) == 15
    for cell in (None, "c1", "c2"):
        assert got[cell, "none"].loss == 0 and got[cell, "flat"].loss == 0 and got[cell, "absent"].loss == 0
        assert got[cell, "good"].loss > 0.1 > got[cell, "weak"].loss
        assert all(got[cell, f].auc + got[cell, f].loss == pytest.approx(got[cell, "none"].auc) for f in families)
        tr, te = ([r for r in d.collect() if r.cell == cell] for d in (train, test))
        x = lambda d: np.array([[r.good, r.weak] for r in d])
        both, labels = np.concatenate([x(tr), x(te)]), np.array([r.label for r in tr])
        z = np.concatenate([np.ones((len(both), 1)), both], axis=1)
        beta = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z[: len(tr)] @ beta))
            beta += np.linalg.solve(z[: len(tr)].T @ (z[: len(tr)] * (p * (1 - p))[:, None]), z[: len(tr)].T @ (labels - p))
        assert got[cell, "none"].auc == pytest.approx(slow_auc(list(z[len(tr) :] @ beta), [r.label for r in te]), abs=2e-3)  # scores in thousandths
    only = frame.where("label = 1")
    assert fits.family_ablation(only, test, ["cell"], families).count() == 0


def test_as_of_finds_the_newest_version_not_after(spark):
    pick = random.Random(6)
    versions = list({(k, pick.randint(0, 60)): pick.random() for k in ("a", "hot", "hot", "hot", None) for _ in range(30)}.items())
    rows = [(pick.choice(["a", "hot", "hot", "hot", "none", None]), pick.choice([None, *range(-5, 70)]), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "key string, at int, found_ int")
    right = spark.createDataFrame([(k, at, v) for (k, at), v in versions], "key string, at int, value double")
    got = {r.found_: r for r in snapshots.as_of(left, right, ["key"], "at").collect()}
    known = dict(versions)
    for key, at, i in rows:
        before = [t for k, t in known if k == key and at is not None and t <= at]
        assert (got[i].found and (got[i].found.at, got[i].found.value)) == ((max(before), known[key, max(before)]) if before else None)
    assert len(got) == 3000 and snapshots.as_of(left, right.limit(0), ["key"], "at").where("found is not null").count() == 0
    plan = snapshots.as_of(left, right, ["key"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_known_terms_are_those_of_the_version_then(spark):
    versions = spark.createDataFrame([("e", 220, 1), ("e", 225, 2), ("f", 226, 3)], "entity string, version long, set_id long")
    held = spark.createDataFrame([(1, "old"), (2, "old"), (2, "new"), (3, "new")], "set_id long, term string")
    rows = spark.createDataFrame([("e", "new", "v224-v226"), ("e", "new", "v225-v226"), ("e", "old", "219-225"), ("f", "new", "v225-v300"), ("e", "old", "odd"), ("e", "old", None)], "entity string, term string, snapshot_pair string")
    got = {(r.entity, r.term, r.snapshot_pair): (r.version, r.known) for r in snapshots.known_at(rows, versions, held).collect()}
    assert got == {("e", "new", "v224-v226"): (220, False), ("e", "new", "v225-v226"): (225, True), ("e", "old", "219-225"): (None, False), ("f", "new", "v225-v300"): (None, False), ("e", "old", "odd"): (None, False), ("e", "old", None): (None, False)}


def test_a_content_digest_is_of_rows_not_of_their_order(spark):
    rows = [(i % 7, f"t{i % 50}", None if i % 11 == 0 else i / 8) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b string, c double")
    digest = lambda d, **how: digests.content(d, **how).first().digest
    first = digest(frame)
    assert first == digest(frame.repartition(13, "b").orderBy(F.desc("c"))) == digest(frame.select("c", "b", "a")) and len(first) == 12
    assert digest(frame.limit(499)) != first and digest(frame.unionByName(frame.limit(1))) != first
    assert digest(frame.withColumn("c", F.when((F.col("b") == "t3") & (F.col("a") == 3), 0.25).otherwise(F.col("c")))) != first
    twice = frame.unionByName(frame)  # exclusive ors vanish, sums do not
    assert digests.content(twice).first().xor_low == "0" and digest(twice) != digest(frame.limit(0))
    texts = [("a,b", None), ("a", "b"), ("-", None), (None, "-"), ("1:x", "y"), ("", None), (None, "")]
    shown = {digest(spark.createDataFrame([t], "a string, b string")) for t in texts}
    assert len(shown) == len(texts)
    parts = {r.a: r.digest for r in digests.content(frame, by=["a"]).collect()}
    assert parts[3] == digest(frame.where("a = 3").drop("a"))


def test_digests_of_specifications_and_pools():
    spec = {"rows": 3, "name": "x", "tags": ["t"]}
    assert digests.specification(spec, {"tags"}) == digests.specification({"name": "x", "rows": 3}) != digests.specification(spec)
    assert digests.pool(["b", "a"]) == digests.pool(["a", "b"]) != digests.pool(["a|b", ""]) and len(digests.pool([])) == 12


DAG = [("p1", "root"), ("p2", "p1"), ("f1", "root"), ("f2", "f1")]
ASPECT = {"root": "P", "p1": "P", "p2": "P", "f1": "F", "f2": "F"}


@pytest.fixture
def world(spark):
    over = ontology.ancestors(spark.createDataFrame(DAG, "child string, parent string"), reflexive=True, nodes=spark.createDataFrame([(t,) for t in ASPECT], "term string"))
    pick = random.Random(8)
    direct = [(e, pick.choice(["p1", "p2", "f1", "f2"])) for e in range(30) for _ in range(2)] + [(50, "p2"), (51, "p2")]
    closed = ontology.entity_closure(spark.createDataFrame(direct, "entity int, term string").distinct(), over).select("entity", "term")
    pairs = spark.createDataFrame([(a, (a * 7 + 3) % 30) for a in range(30) if a != (a * 7 + 3) % 30] + [(50, 51), (50, 99), (98, 99)], "a int, b int")
    return pairs, closed, spark.createDataFrame(list(ASPECT.items()), "term string, aspect string")


def facts(closed):
    sets = {}
    for r in closed.collect():
        sets.setdefault(r.entity, set()).add(r.term)
    n = {t: sum(t in s for s in sets.values()) for t in ASPECT}
    top = max(n.values())
    return sets, {t: 0.0 if k >= top else -math.log(k / top) for t, k in n.items() if k}


def test_most_informative_ancestors_and_their_aspects(world):
    pairs, closed, aspects = world
    sets, ic = facts(closed)
    want = {}
    for r in pairs.collect():
        both = sets.get(r.a, set()) & sets.get(r.b, set())
        want[r.a, r.b] = max(both, key=lambda t: (ic[t], t)) if both else None
    content = ontology.information_content(closed)
    assert {(r.a, r.b): r.mica for r in semantics.informative_ancestors(pairs, closed, content).collect()} == want
    counts = {}
    for t in want.values():
        counts[ASPECT.get(t, "none")] = counts.get(ASPECT.get(t, "none"), 0) + 1
    assert {r.aspect: r.pairs for r in semantics.mica_aspects(pairs, closed, content, aspects).collect()} == counts and counts["none"] == 2


def test_an_aspect_alone_counts_its_own_information(spark, world):
    pairs, closed, aspects = world
    own = closed.where(F.col("term").isin("root", "p1", "p2"))
    sets, ic = facts(own)
    for r in semantics.aspect_similarity(pairs, closed, aspects, "P").collect():
        best = [max((ic[t] for t in sets.get(e, ())), default=0.0) for e in (r.a, r.b)]
        shared = max((ic[t] for t in sets.get(r.a, set()) & sets.get(r.b, set())), default=0.0)
        assert r.lin == pytest.approx(2 * shared / sum(best) if sum(best) else 0.0)
    # other aspects' annotations don't weigh in: without them nothing changes
    alone = semantics.aspect_similarity(pairs, own, aspects, "P")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, semantics.aspect_similarity(pairs, closed, aspects, "P").collect()))


def test_nulls_of_the_target(world):
    pairs, closed, _ = world
    content = ontology.information_content(closed)
    sets, ic = facts(closed)
    rows = {(r.a, r.b): r for r in semantics.pool_mean_null(pairs, closed, content).collect()}
    total = {k: sum(max((ic[t] for t in sets.get(e, ())), default=0.0) for e in k) for k in rows}
    shared = {k: r.lin * total[k] / 2 for k, r in rows.items()}
    mean = sum(shared.values()) / len(shared)
    for k, r in rows.items():  # only the two entities' own content is left, and the mean of what pairs share
        assert r.marginal == pytest.approx(2 * mean / total[k] if total[k] else 0.0)
        assert total[k] == 0 or r.marginal * total[k] / 2 == pytest.approx(mean)
    assert rows[98, 99].marginal == 0
    lin = {(r.a, r.b): r.target for r in semantics.null_target(pairs, closed, content, "lin").collect()}
    mixed = [{(r.a, r.b): r.target for r in semantics.null_target(pairs, closed, content, "shuffled", seed).collect()} for seed in ("1", "1", "2")]
    assert lin == {k: r.lin for k, r in rows.items()} and sorted(mixed[0].values()) == sorted(lin.values())
    assert mixed[0] == mixed[1] != mixed[2] and mixed[0] != lin
    with pytest.raises(ValueError, match="lin, marginal or shuffled"):
        semantics.null_target(pairs, closed, content, "other")
    assert codes.sampled_pairs(closed, 2).count()


def test_scores_that_keep_rising_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "child int, parent int")
    scores = spark.createDataFrame([("e", i, 1.0 - i / 10) for i in range(7)] + [("f", 0, 0.2), ("f", 2, 0.1)], "entity string, term int, score double")
    fixed, rounds = ontology.consistency(scores, edges)
    assert rounds == 6 and {(r.entity, r.term): r.score for r in fixed.collect()} == {**{("e", i): 1.0 for i in range(7)}, ("f", 0): 0.2, ("f", 2): 0.1}
    with pytest.raises(ArithmeticError, match="still rise after 3 rounds"):
        ontology.consistency(scores, edges, max_passes=3)
