"""The corpus pipeline, stage by stage, on the smallest documents."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import common, decontaminate, linededup, nearcopies, quality, simhash


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = common.read(spark, small, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialise(stage(spark, docs, small), name.replace(" ", "-"))
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_what_their_operators_keep(spark, small, stages):
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = stages
    ids = lambda d: {x.doc_id for x in d.select("doc_id").collect()}
    assert all(d.columns == d0.columns for d in (d1, d2, d3, d4))
    assert ids(d1) == ids(quality.scores(d0, common.read(spark, small, "labels")).where("keep"))
    lines = {x.doc_id: (x.text, x.n_deleted) for x in linededup.dedup_lines(d1).collect()}
    assert {x.doc_id: x.text for x in d2.collect()} == {i: t for i, (t, _) in lines.items()} and any(n for _, n in lines.values())
    assert d2.where("n_chars <> length(text)").count() == d1.where("n_chars <> length(text)").count()
    assert ids(d3) == ids(simhash.simhash_components(d2).where("doc_id = component_id"))
    assert ids(d4) == ids(decontaminate.hits(d3, common.read(spark, small, "benchmark")).where("not contaminated"))
    assert ids(d5) == ids(d4) and d5.where(F.col("text") != F.col("decoded")).count() == 0


def test_run_is_the_stages_in_turn(spark, small, stages):
    key = lambda d: sorted((x.doc_id, x.text, tuple(x.token_ids)) for x in d.collect())
    assert key(corpus_pipeline.run(spark, small)) == key(stages[-1][1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_null_rows_pass(spark, small):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (None, "la la", None, None, 5), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, small), name.replace(" ", "-"))
        common_rows = docs.count()
    assert common_rows >= 3


def test_near_duplicates_are_those_of_brute_force_jaccard(spark, small):
    pick, docs = random.Random(5), []
    words = [f"w{i}" for i in range(3000)]
    notice = pick.choices(words, k=150)  # many texts share it and are no copies
    for _ in range(40):
        base = pick.choices(words, k=pick.randint(3, 300))
        for edits in (0, 1, 2, 4, 8, 12, 16):
            text = list(base)
            for _ in range(edits * len(base) // 300 + (edits > 0)):
                text[pick.randrange(len(text))] = pick.choice(words)
            docs.append(" ".join(text + notice if pick.random() < 0.2 else text))
    hub = pick.choices(words, k=200)
    docs += [" ".join(pick.choice(words) if pick.random() < 0.015 else w for w in hub) for _ in range(60)]
    docs += ["", "  ", "one two", "One  two"]
    ids = [pick.randrange(250) for _ in docs]  # ids repeat
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in docs)]
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    table = spark.createDataFrame([(i, t, "en", str(n), len(t)) for n, (i, t) in enumerate(zip(ids, docs, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    left = [int(x.source) for x in corpus_pipeline.near_duplicate_stage(spark, table, small).collect()]
    assert sorted(find(n) for n in left) == sorted(groups)  # one row of each group
    assert sorted(ids[n] for n in left) == sorted(min(ids[n] for n in g) for g in groups.values())
    op1 = simhash.simhash_components(table.withColumn("doc_id", F.col("source").cast("long"))).where("doc_id = component_id").count()
    assert len(groups) < op1  # three bits and three words leave near copies


def test_near_dedup_takes_the_links_of_simhash(spark, small, monkeypatch):
    """The stage's first pairs are op1's: fingerprints of five-word shingles at three bits or fewer."""
    pick, docs = random.Random(8), []
    words = [f"w{i}" for i in range(500)]
    for _ in range(30):
        base = pick.choices(words, k=200)
        docs += [" ".join(base), " ".join([*base[:-1], "z"]), " ".join([*base[:100], "y", *base[101:]])]
    prints = [simhash.fingerprint(t.encode(), 5) for t in docs]
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= simhash.DISTANCE:
                root[find(a)] = find(b)
    want = {tuple(i for i in range(len(docs)) if find(i) == g) for g in set(map(find, root))}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    pairs = [tuple(x) for x in nearcopies.simhash_pairs(spark.createDataFrame(rows, "row long, fp long")).collect()]
    assert all(find(a) == find(b) for a, b in pairs)
    root = list(range(len(docs)))
    for a, b in pairs:
        root[find(a)] = find(b)
    assert {tuple(i for i in range(len(docs)) if find(i) == g) for g in set(map(find, root))} == want and len(want) < len(docs)
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, **how: asked.append({x.fp for x in distinct.collect()}) or links(distinct, **how))
    table = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    assert corpus_pipeline.near_duplicate_stage(spark, table, small).count() == 30
    assert asked == [{fp for _, fp in rows}]


def test_sketches_never_overstate_a_difference():
    pick = np.random.default_rng(3)
    for n in (1, 5, 63, 64, 65, 200, 900):
        for share in (0.0, 0.1, 0.5, 1.0):
            a = np.unique(pick.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[int(len(a) * share) :], pick.integers(0, 1 << 63, 1 + int(n * share)).astype(np.uint64)]))
            assert nearcopies._differ(nearcopies.sketch(a), nearcopies.sketch(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("ids", [[1, 2, 3, 4, 5, None], [7, 7, 3, 3, 5, None], [-9, -9, -3, -9, -2, None], [2**63 - 1, 2**63 - 1, 4, 5, 5, None], ["a", "a", "3", "4", "5", None]])
def test_near_duplicates_whatever_the_ids(spark, small, ids):
    one, two = "a b c d e f g h", "other words of another text than that"
    docs = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(zip(ids, [one, two, one, None, one, one], strict=True))], f"doc_id {'string' if 'a' in ids else 'long'}, text string, row string")
    if "a" in ids:
        docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == "a", "1").otherwise(F.col("doc_id")))
    left = [int(x.row) for x in corpus_pipeline.near_duplicate_stage(spark, docs, small).collect()]
    copies = min((int(i) if i != "a" else 1, k) for k, i in enumerate(ids) if k in (0, 2, 4))[0]
    assert sorted(k for k in left if k not in (0, 2, 4)) == [1, 3, 5]
    assert [int(ids[k]) if ids[k] != "a" else 1 for k in left if k in (0, 2, 4)] == [copies]


def test_common_shingles_are_found_in_any_table():
    pick = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        known, s = (np.unique(pick.integers(0, 2000, size, np.uint64)) for size in (n, 300))
        assert (nearcopies._among(s, known) == np.isin(s, known)).all()
    top = np.array([2**64 - 1], np.uint64)
    assert nearcopies._among(top, top).all() and not nearcopies._among(top, np.zeros(1, np.uint64)).any()
