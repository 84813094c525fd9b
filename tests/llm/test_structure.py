"""Conversation repair, source mixing and whitening against plain code."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import conversations, mixing, queries, whitening
from rankloom.llm.common import read

TURNS = "conv_id long, turn long, role string, text string"
ROLES = re.compile(r"(s?(ua)+)?")


def slow_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows, faults):
    """Every sequence of edits with at most two insertions between rows: (cost, audit, repaired lines)."""
    inserts = [(), ("user",), ("assistant",), ("user", "user"), ("user", "assistant"), ("assistant", "user"), ("assistant", "assistant")]

    def row(role, text, fault):
        yield 4, "D", None
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            yield more, "K", (role, text)
            for new in ("user", "assistant"):
                yield 3 + more, "R", (new, text)

    choices = [inserts]
    for (role, text), fault in zip(rows, faults, strict=True):
        choices += [list(row(role, text, fault)), inserts]
    for picked in itertools.product(*choices):
        cost, audit, lines = 0, "", []
        for p in picked:
            if p and isinstance(p[0], int):
                cost, audit, lines = cost + p[0], audit + p[1], lines + [p[2]] * (p[2] is not None)
            else:
                cost, audit, lines = cost + 3 * len(p), audit + "I" * len(p), lines + [(r, "") for r in p]
        if ROLES.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
            yield cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def slow_repair(rows, faults):
    """Least (cost, audit, repaired) by a queue ordered so: no integers, no table."""
    follow = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, lines = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if role[0] in follow[last]:
                heapq.heappush(queue, (cost + 3, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in follow[last]:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in follow[last]:
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))


def slow_conversations(rows):
    groups, out = {}, {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        turns, plain = [r[0] for r in found if r[0] is not None], [r[1:] for r in found]
        faults = slow_faults(plain)
        cost, audit, text = slow_repair(plain, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_repairs_are_the_least_of_all_edits():
    pick = random.Random(2)
    for n in (0, 1, 2, 3):
        for _ in range(12 if n == 3 else 25):
            rows = [(pick.choice(["user", "assistant", "system", "tool", ""]), pick.choice(["Hi.", "Oh", " ", "Yes!"])) for _ in range(n)]
            faults = slow_faults(rows)
            want = min(all_edits(rows, faults))
            assert slow_repair(rows, faults) == want
            found = conversations.weights([(r[:1], f) for (r, _), f in zip(rows, faults, strict=True)], 0)
            best = min((c, d.translate(conversations.LETTERS)) for s, (c, d) in found.items() if s in (0, 3))
            assert best == want[:2]


def test_pieces_of_any_length_fold_to_the_same_repair(spark):
    pick = random.Random(4)
    rows = [(c, t, pick.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), pick.choice(["Hi.", "Oh", " \t", "Yes!", "So?\n", None, "No", "¿Qué?"])) for c in (1, 2, None) for t in range(60)]
    rows += [(3, None, "user", "Hi."), (3, None, "assistant", "Hi."), (3, 5, "user", "Ah."), (3, 5, "user", "Ah."), (3, 5, "assistant", "Ah."), (3, 5, "user", "Be."), (3, 9, "assistant", "x" * 300_000 + ".")]
    rows += [(4, 2, "user", "Same.")] * 40 + [(5, None, None, None)] + [(c, 0, "user", "A.") for c in range(100, 160)]
    want = slow_conversations(rows)
    frame = spark.createDataFrame(rows, TURNS).withColumns({"n": F.lit(7), "fresh": F.lit("x"), "h": F.lit(None).cast("int"), "audit": F.lit(1)})
    for segment in (1, 3, 256):
        got = conversations.repair(conversations.damage(frame), segment=segment).collect()
        assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(r[6] == "" and r[7] == hashlib.sha256().hexdigest() for r in want.values())


def test_a_conversation_of_many_pieces(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"t {t % 500}" + "." * (t % 2)) for t in range(3000)]
    got = conversations.repair(conversations.damage(spark.createDataFrame(rows, TURNS))).collect()
    assert [tuple(r)[1:] for r in got] == [slow_conversations(rows)[1]]
    assert conversations.repair(conversations.damage(spark.createDataFrame([], TURNS))).count() == 0


def test_repaired_rows_are_what_the_digest_is_of(spark):
    pick = random.Random(9)
    rows = [(c, t, pick.choice(["user", "assistant", "system"]), pick.choice(["Hi.", "Oh", "", "Yes!"]) + str(pick.randint(0, 2)) * pick.randint(0, 1)) for c in (1, None, 3) for t in range(25)]
    frame = conversations.once(spark.createDataFrame(rows, TURNS))
    texts = {}
    for r in conversations.repaired_rows(frame, segment=4).orderBy("conv_id", "place").collect():
        texts.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for r in conversations.repair(frame).collect():
        lines = texts.get(r.conv_id, [])
        assert [p for p, _, _ in lines] == list(range(len(lines))) and ROLES.fullmatch("".join(role[0] for _, role, _ in lines))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{role}:{t}" for _, role, t in lines).encode()).hexdigest()


def test_registered_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == slow_conversations(rows)


def slow_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, left, open_, out = {s: weights[i % 3] for i, s in enumerate(names)}, Fraction(3 * sum(sizes.values()), 2), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s], left = Fraction(2 * sizes[s]), left - 2 * sizes[s]
        open_ -= over
    return out


DOCS = "doc_id long, text string, source string, n_chars long"


def mixed_docs(seed=3):
    pick = random.Random(seed)
    docs = [(i, " ".join("w" * pick.randint(1, 9) for _ in range(pick.choice([0, 1, 5, 40, 200]))), pick.choice(["b", "a", None, "", "é", "zz", "a", "a", "a"]), 0) for i in range(400)]
    return docs + [(None, "null id", "a", 0), (None, "null id", "a", 0), (7, "again and again", "a", 0), (900, None, "b", 0), (901, " \t\n", "only blank", 0), (902, "long " * 30_000, "long", 0), (903, "one", "tiny", 0)]


def test_targets_stop_at_twice_a_source(spark):
    docs = mixed_docs()
    sizes = {}
    for _, text, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = slow_targets(sizes)
    got = mixing.taken(spark.createDataFrame(docs, DOCS).withColumns({"size": F.lit(1), "number": F.lit("x"), "start": F.lit(0), "target": F.lit(2)}).withColumn("order", F.lit(3)))
    rows = spark.createDataFrame(docs, DOCS).select("doc_id", "source").distinct()
    source_of = {r.doc_id: r.source for r in rows.collect()}
    by = {}
    for r in got.collect():
        source = source_of[r.doc_id]
        if r.doc_id == 7:
            continue
        assert r.source_size == sizes[source] and abs(r.target - float(want[source])) <= 1e-9 * max(1.0, r.target)
        assert 0 <= r.taken <= 2 * r.size
        by[source] = by.get(source, 0) + r.taken
    assert got.count() == len(docs)
    sums = {r.source_size: r.taken for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken")).collect()}
    for source, size in sizes.items():
        assert abs(sums[size] - want[source]) <= 12, source  # slots are one word here


def test_slots_are_full_blocks_in_low_discrepancy_order(spark):
    docs = spark.createDataFrame(mixed_docs(8), DOCS)
    rows, pieces = mixing.mix(docs, block=16)
    held = {}
    for p in pieces.collect():
        held.setdefault(p.slot, []).append(p)
    target = {r.number: r.target for r in rows.select("number", "target").distinct().collect()}
    total, seen = sum(target.values()), dict.fromkeys(target, 0)
    for slot in range(max(held) + 1):
        if slot in held:  # a source's last block may be cut, or lie past its last copy
            assert len({p.number for p in held[slot]}) == 1 and sum(p.n_words for p in held[slot]) <= 16
            seen[held[slot][0].number] += 1
        if slot % 500 == 499:
            assert all(abs(seen[n] - slot * t / total) <= 12 for n, t in target.items())
    assert sum(len(h) and sum(p.n_words for p in h) == 16 for h in held.values()) >= len(held) - len(target)
    covered = {}
    for p in pieces.collect():
        covered.setdefault((p.number, p.start, p.copy), []).append((p.first_word, p.n_words))
    for spans in covered.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and spans[0][0] == 0


def test_mixes_agree_on_any_dealing_and_empty_tables(spark):
    docs = spark.createDataFrame(mixed_docs(5), DOCS)
    key = lambda d: sorted((str(r.doc_id), r.size, r.target, r.taken) for r in d.collect())
    assert key(mixing.taken(docs)) == key(mixing.taken(docs.repartition(13, "n_chars").orderBy(F.desc("doc_id"))))
    assert mixing.taken(docs.limit(0)).count() == 0
    blank = mixing.taken(spark.createDataFrame([(1, None, None, 0), (2, " ", "a", 0)], DOCS)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in blank] == [(0, 0, 0.0, 0)] * 2
    assert [mixing.block_size(n) for n in (0, 131_071, 131_072, 10**15)] == [1, 1, 2, 2048]


def slow_whitening(vectors):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(float) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    scaled = x * n - s
    return n, (scaled * scaled).sum(axis=1), (scaled.astype(float) / n) @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("shape", ["flat", "steep", "narrow"])
def test_whitening_is_that_of_a_dense_decomposition(spark, shape):
    random_ = np.random.default_rng(1)
    d = 3 if shape == "narrow" else 48
    data = random_.normal(size=(700, d)) * (1 if shape == "flat" else 2.0 ** -np.arange(d) if shape == "steep" else np.arange(1, d + 1))
    vectors = [[float(c) for c in v] for v in data] + [[float(c) for c in data[0]]] * 50
    bad = [(9000, None), (9001, [1.0, float("nan"), *[0.0] * (d - 2)]), (9002, [float("inf"), *[0.0] * (d - 1)]), (9003, [None, *[0.0] * (d - 1)])]
    frame = spark.createDataFrame(list(enumerate(vectors)) + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "component": F.lit("y"), "v": F.lit(3)})
    got, (n, deviation, whitened, explained) = whitening.whiten(frame).collect(), slow_whitening(vectors)
    assert len(got) == len(vectors) * min(4, d) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    signs = {}
    for r in got:
        want = whitened[r.vec_id, r.component - 1]
        sign = signs.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
        assert abs(sign * r.whitened - want) < 1e-9 and r.deviation == deviation[r.vec_id]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-9


def test_whitening_of_few_or_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == [] and make([(1, None), (2, [])]) == [] and make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = make([(1, [0.0, 1.0]), (None, [3.0]), (None, [3.0]), (4, [-0.0, 1.0])])  # one direction; shorter ones end in zeros
    assert {(r.vec_id, r.component, round(abs(r.whitened), 9), r.n) for r in two} == {(1, 1, 1.0, 2), (None, 1, 1.0, 2), (4, 1, 1.0, 2)} and len(two) == 4
    far = make([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])])
    assert all(r.deviation is None for r in far if r.vec_id < 3) and len({r.vec_id for r in far}) == 3


def test_leading_value_found_where_the_first_columns_miss_it():
    """The first columns hold nothing of the leading direction: the certifying round's fresh ones find it."""
    values = np.concatenate([[9.0, 8.0, 7.0, 6.0, 5.9], np.linspace(2, 0.1, 75)])
    first = np.linalg.qr(np.random.default_rng(5).normal(size=(80, 12)))[0]
    axes = np.linalg.qr(np.concatenate([first, np.random.default_rng(6).normal(size=(80, 68))], axis=1))[0][:, ::-1]
    v = (axes * values) @ axes.T
    assert np.abs(axes[:, 0] @ first).max() < 1e-14
    e, q = whitening.leading(lambda x: v @ x, 80, block=12)
    assert np.allclose(e, [9, 8, 7, 6], rtol=1e-12) and np.allclose(np.abs(axes[:, :4].T @ q), np.eye(4), atol=1e-10)
