"""Quality, toxicity and language models: brute force, held-out accuracy, defined cases."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import lm, quality, toxicity

SCHEMA = "doc_id long, text string, lang string"


def corpus(spark, r, n=160):
    vowels, consonants = "aeiou", "bdklmnrst"
    word = lambda: "".join(r.choice(consonants) + r.choice(vowels) for _ in range(r.randint(2, 4)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 7
        text = " ".join(word() for _ in range(r.randint(40 if bad else 5, 120)))
        if bad:
            text = r.choice([" ".join(w.upper() + "!!" for w in text.split()), " ".join(w + r.choice(["$$$", "%%%"]) for w in text.split()), " ".join([text.split()[0]] * 60)])
        rows.append((i, text, "en" if i % 3 else "de"))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs, labels, rows = corpus(spark, random.Random(1))
    extra = docs.unionByName(spark.createDataFrame([(None, "la ma ti so", "en"), (900, None, None), (901, "", "xx"), (902, "deto luna", None)], SCHEMA)).withColumns({"n": F.lit(1), "lp": F.lit(2), "keep": F.lit(3)})
    got = {x.doc_id: x for x in quality.scores(extra, labels).collect()}
    wrong = [(i, t[:60], got[i]) for i, t, _ in rows if got[i].keep != (i % 8 != 7)]
    assert not wrong
    assert got[900].keep and got[901].keep and got[902].keep and got[900].perplexity is None
    kept = quality.keep_good(extra, labels)
    assert kept.columns == extra.columns and {x.doc_id for x in kept.collect()} == {k for k, x in got.items() if x.keep}
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert quality.scores(docs, labels.limit(0)).where("not keep").count() == 0


def test_kneser_ney_sums_to_one_and_matches_counts(spark):
    r = random.Random(2)
    counts = collections.Counter((r.randrange(4), r.randrange(4), min(r.randrange(8), r.randrange(8), 5)) for _ in range(400))
    frame = spark.createDataFrame([(a, b, c, n) for (a, b, c), n in counts.items()], "a long, b long, c long, n long")
    table = 10.0 ** quality.kneser_ney(frame, 6).astype(float)
    assert np.allclose(table.sum(axis=2), 1, atol=1e-4)

    def level(c):
        k = [sum(1 for x in c.values() if x == j) for j in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] and k[1] else 0.5
        d = [min(max(j - (j + 1) * y * b / a, 0.1), j - 0.05) if a and b else 0.5 * j for j, a, b in ((1, k[0], k[1]), (2, k[1], k[2]), (3, k[2], k[3]))]
        return lambda n: d[min(n, 3) - 1] if n else 0.0

    two = collections.Counter((b, c) for _, b, c in counts)
    one = collections.Counter(c for _, c in two)
    d3, d2, d1 = level(counts), level(two), level(one)

    def p(a, b, c):
        t1 = sum(one.values())
        p1 = (one[c] - d1(one[c])) / t1 + sum(map(d1, one.values())) / t1 / 6
        t2 = sum(n for (x, _), n in two.items() if x == b)
        p2 = (two[b, c] - d2(two[b, c])) / t2 + sum(d2(n) for (x, _), n in two.items() if x == b) / t2 * p1 if t2 else p1
        t3 = sum(n for (x, y, _), n in counts.items() if (x, y) == (a, b))
        return (counts[a, b, c] - d3(counts[a, b, c])) / t3 + sum(d3(n) for (x, y, _), n in counts.items() if (x, y) == (a, b)) / t3 * p2 if t3 else p2

    for a, b, c in itertools.product(range(6), range(6), range(6)):
        assert table[a, b, c] == pytest.approx(p(a, b, c), rel=1e-4)


def test_quality_by_perplexity_worked_out_by_hand(spark):
    """Perplexity from counts, the quantile of the trusted texts of each language, and the decision, without Spark; texts in
    scripts beyond the commonest characters keep their own perplexities."""
    r = random.Random(7)
    han = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可"
    say = {"en": lambda: " ".join(r.choice(["tona", "rilo", "mesu", "kada"]) for _ in range(30)), "zh": lambda: "".join(r.choice(han[:12]) for _ in range(80))}
    rows = [(i, say["zh" if i % 2 else "en"](), "zh" if i % 2 else "en") for i in range(200)]
    junk = [(500 + i, "".join(r.choice(han[12:]) for _ in range(80)), "zh") for i in range(10)]
    docs = spark.createDataFrame(rows + junk, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.scores(docs, labels, symbols=20).collect()}
    assert not any(got[i].keep for i, _, _ in junk) and all(got[i].keep for i, _, _ in rows)
    common = collections.Counter(c for _, t, _ in rows for c in quality.symbols_of(t, True).tolist())
    top = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:20]]
    place = {c: k + 1 for k, c in enumerate(top)}
    spell = lambda c: [place[c]] if c in place else [21 + (c >> s & 63) for s in (18, 12, 6, 0)]
    code = lambda t, once: [x for c in quality.symbols_of(t, once).tolist() for x in spell(c)]
    counts = collections.Counter(g for _, t, _ in rows for s in [[0, 0, *code(t, True)]] for g in zip(s, s[1:], s[2:], strict=False))
    table = quality.kneser_ney(spark.createDataFrame([(a, b, c, n) for (a, b, c), n in counts.items()], "a long, b long, c long, n long"), 85)
    lp, size = {}, {}
    for i, t, _ in rows + junk:
        s = [0, 0, *code(t, False)]
        lp[i], size[i] = sum(float(table[g]) for g in zip(s, s[1:], s[2:], strict=False)), len(s) - 2
        assert got[i].perplexity == pytest.approx(10 ** (-lp[i] / size[i]), rel=1e-4) and got[i].n_symbols == size[i]
    for lang in ("en", "zh"):
        mine = [i for i, _, x in rows if x == lang]
        mean = -sum(lp[i] for i in mine) / sum(size[i] for i in mine)
        value = lambda i, mean=mean: (mean * quality.PRIOR - lp[i]) / (size[i] + quality.PRIOR)
        limit = sorted(map(value, mine))[math.ceil(quality.QUANTILE * len(mine)) - 1] + quality.MARGIN
        assert all(math.log10(got[i].threshold) == pytest.approx(limit, rel=1e-4) for i in mine)
        assert all(got[i].keep == (value(i) <= limit) for i, _, x in rows + junk if x == lang)


def test_quality_learns_from_every_trusted_text(spark):
    """More trusted texts than the sample once held: the model is that of all of them, whichever way their ids are joined."""
    r = random.Random(11)
    rows = [(i, r.choice(["tona", "rilo", "mesu", "ka ka ka"]) + " " + chr(0x400 + r.randrange(300)), "en") for i in range(8_600)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(spark.createDataFrame([(9_000, "zzzz", "en"), (9_001, "", "en"), (None, "qqqq", "en")], SCHEMA))
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows] + [(9_000, 0, 0), (9_001, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    code = quality.train(docs, labels, symbols=20).code
    common = collections.Counter(c for _, t, _ in rows for c in quality.symbols_of(t, True).tolist())
    top = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:20]]
    assert [int(code[c]) for c in top] == list(range(1, 21)) and int((code[:-1] > 0).sum()) == 20 and code[-1] == 21
    spell = lambda c: [int(code[c])] if code[c] else [21 + (c >> s & 63) for s in (18, 12, 6, 0)]
    counts = collections.Counter(g for _, t, _ in rows for s in [[0, 0, *(x for c in quality.symbols_of(t, True).tolist() for x in spell(c))]] for g in zip(s, s[1:], s[2:], strict=False))
    table = quality.kneser_ney(spark.createDataFrame([(a, b, c, n) for (a, b, c), n in counts.items()], "a long, b long, c long, n long"), 85)
    for few in (quality.FEW, 0):
        assert np.allclose(quality.train(docs, labels, symbols=20, few=few).table, table, atol=1e-6)


def slow_kernel(a, b, decay):
    """Gap-weighted subsequences of three letters, by listing them."""
    def feats(w):
        out = collections.Counter()
        for i in itertools.combinations(range(len(w)), 3):
            out[tuple(int(toxicity._CODE[ord(w[k])]) for k in i)] += decay ** (i[2] - i[0] + 1)
        return out

    x, y = feats(a), feats(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_subsequence_kernel():
    a, b = ["idiot", "banana", "i-d-i-o-t", "straße"], ["idiiot", "id1ot", "banner"]
    got = toxicity.kernel(a, b, 0.6)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        assert got[i, j] == pytest.approx(slow_kernel(a[i], b[j], 0.6), abs=1e-5)


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    insults = ["grumpfil", "zwackolo", "frexnit"]
    bend = lambda w: r.choice([w, w, w.upper(), w + ".", w[:3] + "-" + w[3:], w[:4] + w[3] + w[4:]])
    rows, labels = [], []
    for i in range(600):
        t = [word() for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(r.randint(1, 3) if toxic else 0):
            t.insert(r.randrange(len(t)), bend(r.choice(insults)))
        rows.append((i, " ".join(t), "en"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(spark.createDataFrame([(None, "la", "en"), (700, None, None), (701, "", "en"), (702, "grump" + "f" * 40000, "en")], SCHEMA)).withColumns({"toxic": F.lit(1), "score": F.lit(2)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.scores(docs, marks).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert sum(got[i].predicted for i in held if i % 4) <= 0.01 * len(held)
    assert got[700].predicted == got[701].predicted == 0 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    assert toxicity.scores(docs.limit(0), marks).count() == 0
    assert toxicity.scores(docs, marks.limit(0)).agg(F.max("score")).first()[0] == 0


def test_insults_of_two_words_and_broken_ones(spark):
    """Two words that are harmless apart, met together only in toxic documents; and insults broken by a blank, never so in
    training."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        t = [word() for _ in range(r.randint(20, 60))]
        toxic, at = i % 3 == 0, r.randrange(3, 15)
        harmless = ["wibbly", "spoon"]
        if toxic and i % 2:
            t[at:at] = [r.choice(["grumpfil", "zwackolo"])]
        elif toxic:
            t[at:at] = harmless
        else:
            t.insert(at, r.choice(harmless))
            t.insert(at + 5, r.choice(harmless)) if r.random() < 0.2 and t[at] == "spoon" else None
        t[at - 2] += "."
        rows.append((i, " ".join(t), "en"))
        labels.append((i, 1, int(toxic)))
    extra = {2000: "dada wibbly spoon kali", 2001: "dada grump fil kali", 2002: "spoon wibbly", 2003: "Dada ZWACK-OLO", 2004: "g r u m p f i l", 2005: "wib.bly spoon"}
    docs = spark.createDataFrame(rows + [(i, t, "en") for i, t in extra.items()], SCHEMA)
    got = {x.doc_id: x for x in toxicity.scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert [got[i].predicted for i in extra] == [1, 1, 0, 1, 1, 1]


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 10**9), (100_000, 200_000)):
        v = np.unique(r.integers(0, u, n)) if n else np.zeros(0, np.int64)
        e = lm.EliasFano.build(v, u)
        assert (e.get(np.arange(len(v))) == v).all()
        q = np.r_[r.integers(0, u, 500), v[:50]]
        assert (e.find(q) == [np.searchsorted(v, x) if x in set(v.tolist()) else -1 for x in q]).all()
    v = np.sort(r.integers(0, 50, 300))
    assert (lm.EliasFano.build(v, 51).get(np.arange(300)) == v).all()


def lm_texts(r):
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 50}" for _ in range(200)]
    return [None, "", "UNKNOWN words Here", "x" * 30000, "w1 w2 " * 3000] + [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40))) for _ in range(120)]


@pytest.mark.parametrize("how", [{}, {"shard_tokens": 100, "batch_tokens": 60}, {"shard_tokens": 2000, "batch_words": 20, "order": 2}, {"order": 4, "priors": (16.0, 4.0, 2.0), "batch_tokens": 300}])
def test_language_model_against_counts(spark, how):
    texts = lm_texts(random.Random(4))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2")], "doc_id long, text string").withColumns({"n": F.lit(1), "row": F.lit(2), "uid": F.lit(3)})
    got = {x.doc_id: x for x in lm.scores(docs, **how).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in enumerate(texts)} | {None: [b"w1", b"w2", b""]}
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i in tokens}
    train = [t for i, t in tokens.items() if fold[i] != 2]
    order, priors = how.get("order", lm.ORDER), how.get("priors", lm.PRIORS)
    c = collections.Counter(tuple(s[k - n + 1 : k + 1]) for t in train for s in [["<s>", *t]] for n in range(1, order + 1) for k in range(len(s)) if k - n + 1 >= 0)
    words = {w for t in train for w in t}
    n = sum(map(len, train))

    def p(gram):
        if len(gram) == 1:
            return (c[gram] + 1) / (n + len(words) + 1)
        m = priors[len(gram) - 2]
        return (c[gram] + m * p(gram[1:])) / (c[gram[:-1]] + m) if c[gram[:-1]] else p(gram[1:])

    for i, t in tokens.items():
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(t), sum(w in words for w in t), n, fold[i] == 2)
        assert x.base_score == pytest.approx(sum(math.log10(p((w,))) for w in t), abs=1e-6)
        s = ["<s>", *t]
        want = sum(math.log10(p(tuple(s[max(0, k - order + 1) : k + 1]))) for k in range(1, len(s)))
        assert x.score == pytest.approx(want, abs=0.02 * len(t))  # a byte's step is 0.035 decades
    assert lm.scores(docs.limit(0), **how).count() == 0


def test_different_numbers():
    r = np.random.default_rng(2)
    for x in (np.zeros(0, np.int64), np.array([5]), r.integers(0, 50, 1000), r.integers(0, 1 << 62, 1000)):
        a, b = lm._different(x)
        c, d = np.unique(x, return_inverse=True)
        assert (a == c).all() and (b == d).all()


def test_probabilities_of_a_context_sum_to_one():
    """The shares in the code book are those of the formula, to half a step."""
    share = np.array([0.0, 1e-12, 1e-9, 0.3, 0.5, 1.0])
    assert lm.quantised(share)[0] == 0 and np.allclose(np.log10(lm.BOOK[lm.quantised(share)[2:]]), np.log10(share[2:]), atol=0.018)


def test_trie_level_finds_successors_and_nothing_else():
    r = np.random.default_rng(5)
    contexts, words = np.unique(r.integers(0, 1 << 62, 300)), np.unique(r.integers(0, 1 << 40, 200))
    key = np.unique(r.integers(0, len(contexts) * len(words), 3000))
    c, w = key // len(words), key % len(words)
    seen = r.random(len(key)) < 0.7
    count = r.integers(1, 50, len(key))
    level = lm.Level(lm.mapped(lm.Level.pack(contexts, c[seen], words, w[seen], count[seen], count[seen] * 3, 4.0)))
    got = level.find(contexts, c, words, w)
    assert (got == np.where(seen, lm.quantised(count / (3 * count + 4.0)), 0)).all()


def test_language_model_sends_gaps():
    """Words' hashes, contexts, words within a context and nodes of shared n-grams ascend within a request: 3.1 bytes a
    requested n-gram there and back, 4.0 where the numbers themselves were sent."""
    r = np.random.default_rng(6)
    hashes, shards, size = r.permutation(r.integers(0, 1 << 62, 5000)), 2, [0, 0]
    seqs = [np.minimum(r.zipf(1.2, 60000), 5000) - 1 for _ in range(6)]
    totals = {"shards": shards, "texts": 6 * 600, "tokens": 6 * 60000, "types": 5000}
    told = [[] for _ in seqs]
    for level in (1, 2, 3):
        sent = {s: [] for s in range(shards)}
        for uid, seq in enumerate(seqs):
            batch = lm.Batch(np.full(600, 100), np.zeros(600, bool), lm._packed(hashes), lm._packed(seq))
            known = lm.Known(batch, told[uid], lm.PRIORS, totals)
            for row in known.requests(uid, shards):
                sent[row[0]].append(row)
            size[0] += len(known.asked(level))
            told[uid].append([])
        for rows in sent.values():
            names = ["shard", "uid", "contexts", "wholes", "fans", "words", "own"]
            table = pa.table([pa.array(x) for x in zip(*rows, strict=True)], names=names)
            answer = lm._answering(level, ([1.0, *lm.PRIORS])[level - 1], shards, level == 3)(table)
            size[1] += sum(len(x) for row in rows for x in row[2:])
            for a in answer.to_pylist():
                size[1] += sum(len(a[x] or b"") for x in ("nodes", "counts", "codes"))
                told[a["uid"]][-1].append((a["shard"], a["nodes"], a["counts"], a["codes"]))
    assert size[1] / size[0] < 3.5


def test_language_model_splits_a_group_of_texts_at_once():
    texts = [None, b"", b" \t", b"A b\x0bA\x1cB  b\r\n", b" \xff\xC3 \xc3\x84 z", b"\x00 \xc2\xa0x", b"Z" * 5000]
    lens, place, words = lm._split(pa.array([b"not", *texts], pa.binary()).slice(1))
    want = [(t or b"").lower().split() for t in texts]
    assert lens.tolist() == [len(w) for w in want] and [words[i] for i in place] == sum(want, [])
    assert lm._split(pa.array([], pa.binary()))[0].tolist() == []
    large = lm._split(pa.array(texts, pa.large_binary()))
    assert (large[0] == lens).all() and [large[2][i] for i in large[1]] == sum(want, [])


def test_trie_search_looks_neighbours_up_once(monkeypatch):
    """Values that share their high bits are one bucket: it is looked up once for a run of them, and its end is read off."""
    v = np.concatenate([np.arange(300), 10**9 + np.arange(0, 5000, 7)])
    e, asked, below = lm.EliasFano.build(v, 1 << 31), [], lm.EliasFano._below
    monkeypatch.setattr(lm.EliasFano, "_below", lambda self, high: asked.append(len(high)) or below(self, high))
    q = np.concatenate([np.arange(400), 10**9 + np.arange(6000)])
    there = {x: i for i, x in enumerate(v.tolist())}
    assert e.find(q).tolist() == [there.get(x, -1) for x in q.tolist()] and sum(asked) < 10
    asked.clear()
    q = np.random.default_rng(3).permutation(q)
    assert e.find(q).tolist() == [there.get(x, -1) for x in q.tolist()]


def test_language_model_numbers_words_by_node():
    """What a batch was told is numbered by node, so that its requests need no sort of their own."""
    hashes, seq = np.array([50, 10, 40, 20]), np.array([0, 1, 2, 3, 0, 1, 2, 0, 1, 0])
    batch = lm.Batch([4, 6], [False, False], lm._packed(hashes), lm._packed(seq))
    totals = {"shards": 1, "texts": 2, "tokens": 10, "types": 4}
    nodes, counts = np.array([5, 1, 7, 3]), np.array([3, 1, 2, 4])  # of 10, 20, 40 and 50
    known = lm.Known(batch, [[(0, lm._packed(nodes), lm._packed(counts), None)]], lm.PRIORS, totals)
    assert known.node[0].tolist() == [1, 3, 5, 7, lm.START] and known.count[0].tolist() == [1, 4, 3, 2, 2]
    assert batch.hashes.tolist() == [20, 50, 10, 40] and batch.word[batch.token].tolist() == [1, 2, 3, 0, 1, 2, 3, 1, 2, 1]
    ((shard, uid, contexts, wholes, fans, words, own),) = known.requests(9, 1)
    fans = lm._unpacked(fans)
    assert lm._from_gaps(contexts).tolist() == [3, 5, 7, lm.START] and fans.tolist() == [1, 2, 2, 1]
    assert lm._from_gaps(words, np.cumsum(fans) - fans).tolist() == [5, 3, 7, 1, 3, 3] and lm._unpacked(own).tolist() == [3, 1, 2, 1, 1, 2]


def test_gaps_give_the_numbers_back():
    r = np.random.default_rng(7)
    heads = np.array([0, 1, 40])
    x = np.concatenate([np.sort(r.choice(1 << 62, n, replace=False)) for n in (1, 39, 60)])
    assert (lm._from_gaps(lm._gaps(x, heads), heads) == x).all() and (lm._from_gaps(lm._gaps(np.sort(x))) == np.sort(x)).all()
    assert len(lm._from_gaps(lm._gaps(x[:0]))) == 0
