"""SimHash, line and embedding near-duplicates against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import embdedup, linededup, simhash
from rankloom.llm.graph import connected_components

SCHEMA = "doc_id long, text string"


def grouped(n, pairs):
    """The least number reachable from each, by union of pairs."""
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "  \t\n", "ONE", "one", "Ä É Word", "a b", " ".join(r.choice(words) for _ in range(20000))]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(30, 300))]
        for _ in range(6):
            near = list(base)
            for _ in range(r.randint(0, 2)):
                near[r.randrange(len(near))] = r.choice(words)
            texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({"fp": F.lit(1), "root": F.lit("x"), "k": F.lit(2)})
    got = {x.doc_id: x for x in simhash.simhash_components(docs).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = grouped(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert [got[i].component_id for i in range(len(texts))] == want


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(1500):
        x = r.choice([base, *list(prints)[:40]])
        for _ in range(r.randint(1, 5)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), bucket=40)
    number = {s[0]: i for i, s in enumerate(signed)}
    got = grouped(len(prints), [(number[x.a], number[x.b]) for x in found.collect()])
    a = np.array(prints, np.uint64)
    near = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3, 1))
    assert got == grouped(len(prints), zip(*near, strict=True))


def test_empty_and_null_ids(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    got = {(x.doc_id, x.component_id) for x in simhash.simhash_components(spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d")], SCHEMA)).collect()}
    assert got == {(None, 7), (7, 7)}


def test_components_of_a_long_chain(spark):
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(chain.unionByName(chain)).collect()
    assert len(got) == 401 and {x.root for x in got} == {0}
    assert connected_components(chain.limit(0)).count() == 0


def s64(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(x, seed=42):
    return xxhash.xxh64(x if isinstance(x, bytes) else (x & (1 << 64) - 1).to_bytes(8, "little"), seed=seed).intdigest()


def slow_line_dedup(docs):
    """docs [(id, text)], ids in order: the same fingerprints over plain lists; every one but the first is extended along
    every earlier one until lines differ, without a bound."""
    import re

    lines = []
    for _, t in docs:
        parts = re.split(r"[.!?]+[ \n]|\n|[。！？]", t + " ")
        size = lambda s: max(s.count(" ") + 1, (len(s.encode()) - len(s)) // 8)
        lines.append([(s64(hashed(s.encode())), size(s), k) for k, s in enumerate(parts) if s not in ("", " ")])
    marks = []
    for line in lines:
        g = []
        for j, (h, w, _) in enumerate(line):
            if w >= 25:
                g.append((s64(hashed(h)), 1))
                continue
            n = 1
            while (n < 2 or w < 8) and j + n < len(line):
                h, w, n = s64(hashed(line[j + n][0], hashed(h) if n == 1 else hashed(h))), w + line[j + n][1], n + 1
            g.append((h, n) if n >= 2 and w >= 8 else None)
        least = [min((x[0] for x in g[j : j + 2] if x), default=None) for j in range(len(g))]
        marks.append([(j, *x) for j, x in enumerate(g) if x and (x[1] == 1 or x[0] in (least[j], least[j - 1] if j else None))])
    places = {}
    for d, m in enumerate(marks):
        for j, g, _ in m:
            places.setdefault(g, []).append((d, j))
    out = []
    for d, (_, t) in enumerate(docs):
        gone, a = set(), lines[d]
        for j, g, n in marks[d]:
            for e, k in places[g]:
                if (e, k) == (d, j):
                    break
                b, back, on = lines[e], 0, 0
                while j - back > 0 and k - back > 0 and a[j - back - 1][0] == b[k - back - 1][0]:
                    back += 1
                while j + n + on < len(a) and k + n + on < len(b) and a[j + n + on][0] == b[k + n + on][0]:
                    on += 1
                for x in range(j - back, j + n + on):
                    gone.add(a[x][2])
                gone |= set(range(a[j][2], a[j + n - 1][2] + 1))
                for x in range(j - back, j + n + on - 1):  # blank pieces between deleted lines
                    gone |= set(range(a[x][2], a[x + 1][2]))
        parts = re.split(r"(?<=[.!?][ \n])|(?<=[\n。！？])", t)
        parts = parts[:-1] if len(parts) > 1 and parts[-1] == "" else parts
        out.append("".join(p for k, p in enumerate(parts) if k not in gone))
    return out


def test_line_dedup_against_plain_lists(spark):
    r = random.Random(1)
    pool = [" ".join(f"v{r.randrange(30)}" for _ in range(r.choice([1, 3, 5, 9, 30]))) for _ in range(60)]
    passage = ". ".join(" ".join(f"p{k}{i}" for i in range(9)) for k in range(8)) + ". "
    texts = []
    for i in range(60):
        parts = [r.choice(pool) + r.choice([". ", "\n", "! ", "?\n", ".\n\n"]) for _ in range(r.randint(0, 15))]
        if i % 7 == 3:
            parts.insert(len(parts) // 2, f"before{i} " + passage)
        texts.append("".join(parts))
    texts += [texts[5], "", "one", "same line here again and once more now.\n" * 50]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([*docs, (100, None)], SCHEMA).withColumns({"n": F.lit(1), "hs": F.lit(2), "lines": F.lit(3)})
    got = {x.doc_id: x for x in linededup.dedup_lines(frame).collect()}
    assert [got[i].text for i, _ in docs] == slow_line_dedup(docs)
    assert got[100].text is None and got[100].n_deleted == 0 and got[0].hs == 2
    holders = [i for i, _ in docs if i < 60 and i % 7 == 3]
    assert all("p71" not in got[i].text for i in holders[1:]) and "p71" in got[holders[0]].text


def test_line_dedup_of_short_lines_and_of_scripts_without_blanks(spark):
    long = " ".join(f"l{i}" for i in range(30))
    short = "".join(f"\nw{i}" for i in range(12))
    verse = "\n".join(f"x{i} y{i}" for i in range(40))
    chinese = "这是一个很长的段落它没有空格但是在许多文件里重复出现所以应当被发现并且删除。" * 1 + "第二句话也一样会在每个文件里出现没有任何改变。"
    texts = [long + short, long + short, short.strip(), short.strip(), "first " + verse, verse + "\nlast", "开头。" + chinese * 3, "别的开头。" + chinese * 3, "A. b c d e f g h. i j k l m n o. p q r s t u v. Z.", "q. b c d e f g h. i j k l m n o. p q r s t u v. Y.", "Q. A. b c d e f g h. i j k l m n o. p q r s t u v. Z. last one here"]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {x.doc_id: x.text for x in linededup.dedup_lines(frame).collect()}
    assert got[0] == texts[0] and got[1] == "" and got[3] == "" and "x1 y1" not in got[5] and got[5].strip().endswith("last")
    assert "第二句" not in got[7] and got[7].startswith("别的开头")
    assert got[9] == "q. Y." and got[10] == "Q. last one here"


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    t = "a b c d e f g h i j. k l m n o p q r. s t u v w x y z a b c. "
    got = linededup.dedup_lines(spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], SCHEMA)).collect()
    assert sorted(((x.doc_id or 0), x.text == t) for x in got) == [(0, True), (1, False), (1, False), (2, False)]
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(2)
    rows = []
    for c in range(40):
        base = r.normal(size=16)
        rows += [(base + r.normal(size=16) * 0.03).tolist() for _ in range(6)]
    rows += [rows[0]] * 5
    bad = [None, [0.0] * 16, [math.nan] + [1.0] * 15, [None] + [1.0] * 15, [math.inf] + [1.0] * 15, [1.0, 2.0]]
    data = [(i, v, i % 2) for i, v in enumerate(rows + bad)] + [(900, rows[0], None), (901, rows[0], None)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({"uid": F.lit(1), "v": F.lit(2), "n": F.lit(3)})
    got = {x.vec_id: x for x in embdedup.embedding_dedup(frame).collect()}
    x = np.array(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(len(rows))[:, None] % 2 == np.arange(len(rows)) % 2)
    np.fill_diagonal(near, False)
    assert sum(got[i].n_links for i in range(len(rows))) >= 0.9 * near.sum() > 0
    assert all(got[i].n_links <= near[i].sum() for i in range(len(rows)))
    roots = grouped(len(rows), zip(*np.nonzero(np.triu(near)), strict=True))
    assert [got[i].component_id for i in range(len(rows))] == roots
    for i in [*range(len(rows), len(rows) + len(bad)), 900, 901]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embdedup.embedding_dedup(frame.limit(0)).count() == 0


def brute_links(x, labels, weights=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("d", [64, 16])
@pytest.mark.parametrize("block", [2000, 7])
def test_recall_at_the_threshold_and_tight_groups(spark, d, block):
    """Pairs with a cosine of 0.98 to 0.985, a tight group whose pairs all link, and a loose one whose pairs partly do."""
    r = np.random.default_rng(d + block)
    unit = lambda x: x / np.linalg.norm(x)

    def turned(x, cosine):
        y = r.normal(size=d)
        y = unit(y - (y @ x) * x)
        return cosine * x + np.sqrt(1 - cosine**2) * y

    rows = []
    for _ in range(300):
        x = unit(r.normal(size=d))
        rows += [x, turned(x, r.uniform(0.9801, 0.985))]
    for spread in (0.094, 0.16):
        base = unit(r.normal(size=d))
        rows += [unit(base + r.normal(size=d) * spread / np.sqrt(d)) for _ in range(150)]
    x, labels = np.array(rows) * r.uniform(0.5, 2, (len(rows), 1)), np.arange(len(rows)) // 2 % 2
    labels[600:] = 3
    near = brute_links(x, labels)
    frame = spark.createDataFrame([(i, v.tolist(), int(labels[i])) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {y.vec_id: y for y in embdedup.embedding_dedup(frame, block=block).collect()}
    n = np.array([got[i].n_links for i in range(len(rows))])
    assert (n <= near.sum(axis=1)).all() and n[:600].sum() >= 0.95 * near[:600].sum() and n[600:].sum() >= 0.99 * near[600:].sum()
    whole = n == near.sum(axis=1)
    roots = np.array(grouped(len(rows), zip(*np.nonzero(np.triu(near)), strict=True)))
    sure = [k for k in set(roots) if whole[roots == k].all()]
    assert all(got[i].component_id == roots[i] for i in range(len(rows)) if roots[i] in sure) and len(sure) > 0.9 * len(set(roots))


def test_codes_of_few_dimensions_use_every_table():
    x = np.random.default_rng(3).normal(size=(500, 16))
    codes = embdedup.codes_of(x, *embdedup.fit_rotation(x)).astype(np.uint64)
    assert all(len(np.unique(codes >> np.uint64(16 * k) & np.uint64(0xFFFF))) > 400 for k in range(4))


@pytest.mark.parametrize("tables", [2, 4])
def test_tables_meet_all_pairs_within_their_radius(spark, tables):
    r = random.Random(tables)
    codes = [r.getrandbits(64) for _ in range(30)]
    for c in list(codes):
        for _ in range(4):
            x = c
            for b in r.sample(range(64), 2 * tables - 1):
                x ^= 1 << b
            codes.append(x)
    frame = spark.createDataFrame([(i, i, "l", s64(c)) for i, c in enumerate(codes)], "uid long, cid long, grp string, code long")
    found = {(x.uid, x.cid) for x in embdedup.candidates(frame, tables, 14).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(codes)), 2) if (codes[a] ^ codes[b]).bit_count() <= 2 * tables - 1}
    assert want <= found


def test_lines_of_white_space_are_no_content(spark):
    """Texts that share only lines of blanks, tabs or returns lose nothing, and what they share besides goes."""
    gaps = "\n   \n\t\t\n \t \r\n\x0b\n\f \n     \n"
    own = ["first of all one says this and that about it", "another tale begins here with other words for you"]
    shared = "a passage that stands in both of these texts word for word\nand a second line of it that is long enough as well\na third one follows so that two grams stand side by side\nand a fourth closes what both of them hold"
    docs = spark.createDataFrame([(1, own[0] + gaps + "end one"), (2, own[1] + gaps + "end two"), (3, own[0][::-1] + gaps + shared), (4, own[1][::-1] + gaps + shared + "\n")], SCHEMA)
    got = {x.doc_id: (x.text, x.n_deleted) for x in linededup.dedup_lines(docs).collect()}
    assert [got[i][1] for i in (1, 2, 3)] == [0, 0, 0] and got[4][1] >= 2
    assert got[1][0] == own[0] + gaps + "end one" and got[2][0] == own[1] + gaps + "end two" and "passage" in got[3][0] and "passage" not in got[4][0]


def test_a_very_long_text_of_lines(spark):
    r = random.Random(4)
    lines = [" ".join(f"w{r.randrange(500)}" for _ in range(12)) for _ in range(15_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[4000:4020]) + "\nits own line of a few words at the end")], SCHEMA)
    got = {x.doc_id: (x.text, x.n_deleted) for x in linededup.dedup_lines(docs).collect()}
    assert got[1] == ("\n".join(lines), 0) and got[2][1] == 20 and got[2][0].strip() == "its own line of a few words at the end"


def test_repeated_runs_are_sorted_and_apart(spark):
    """Runs that meet or touch are merged, and the pieces outside are what a loop leaves."""
    for ranges, want in (([(3, 4), (0, 1)], "2,5"), ([(0, 2), (1, 5)], ""), ([(1, 1), (2, 3), (2, 2)], "0,4,5"), ([(5, 5)], "0,1,2,3,4")):
        given = spark.createDataFrame([(["0", "1", "2", "3", "4", "5"], ranges)], "s array<string>, r array<struct<a:int,b:int>>").withColumn("r", F.expr(linededup._merged("array_sort(r)")))
        assert given.select(F.expr(linededup._outside("s", "r")).alias("x")).first().x == [x for x in want.split(",") if x]


def test_texts_meet_their_runs_without_a_broadcast(spark, capsys):
    docs = spark.createDataFrame([(i, "One two three four five. Six seven eight nine ten.") for i in range(3)], "doc_id long, text string")
    out = linededup.dedup_lines(docs)
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert {x.doc_id: x.text for x in out.collect()} == {0: docs.first().text, 1: "", 2: ""}


def test_plain_cuts_are_those_of_the_expressions(spark):
    texts = ["", " ", "\n", ".", "a.", "a. ", "a.\n", "a?! b", "a. . b", "a.! ? b\n\n.\n", "a..\nb...  c", "e.g. x.y !z! ?", "a。b.。 c", "a！ b. c", "x\u0001y. z\n", "\n\na!\n", "é. ü? 　. b. "]
    r = random.Random(8)
    texts += ["".join(r.choice(".!? \nab\u0001。é") for _ in range(30)) for _ in range(200)] + ["".join(r.choice(".!? \nabé") for _ in range(30)) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in docs.selectExpr("t", linededup._cut("t") + " as a", f"split(concat(t, ' '), {linededup.ENDS}) as b", linededup._pieces("t") + " as c", f"split(t, {linededup.PLACES}) as d").collect():
        assert (row.a, row.c) == (row.b, row.d), row.t


def test_fingerprints_pass_few_times_over_the_lines(spark):
    """Each function over an array's items is evaluated item by item, outside of generated code: 8 functions, 16 before."""
    plan = linededup.fingerprints(spark.createDataFrame([(1, 2, "a")], "id long, k long, t string"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") <= 9
