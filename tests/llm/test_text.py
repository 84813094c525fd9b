"""Tokens, licences, personal data and decontamination against brute force."""

import base64
import hashlib
import math
import random
import re
import re._parser as parser
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from rankloom.llm import bpe, common, decontaminate, license, pii

SCHEMA = "doc_id long, text string"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktokens_and_turns_back(spark, reference):
    r = random.Random(0)
    texts = [None, "", " ", "  a\x1c\x1d b\x85d e", "'s't I'LL we'll", "日本語テキスト🙂👩‍👩‍👧 ½²³ Ⅷ", "a" * 3000, "ab" * 300 + "é" * 200, "\n\n \t x", " " * 500 + "x", "x\x00y", "<|endoftext|>"]
    texts += ["".join(r.choice("abcdefgh \n'ést1290.,!ñ中") for _ in range(r.randint(1, 200))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("ids", F.lit(0))
    got = {x.doc_id: x for x in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    full = bpe.encode(docs, RANKS, P.PATTERN).collect()
    assert all(x.decoded == (x.text or "") and x.token_ids == reference.encode_ordinary(x.text or "") for x in full)
    assert bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_the_query_and_the_heap_agree():
    r = random.Random(4)
    pieces = {"".join(r.choice("abcdeionrst") for _ in range(r.randint(2, 60))) for _ in range(200)}
    with bpe.Codec(RANKS, P.PATTERN) as c:
        rest = [p.encode() for p in pieces if p.encode() not in c.ranks]
        assert c._query(rest)[0] == [c._heap(p) for p in rest]


def test_long_pieces_take_the_query_few_times_the_heap():
    r = random.Random(5)
    with bpe.Codec(RANKS, P.PATTERN) as c:
        pieces = ["".join(r.choice("abcdeionrst") for _ in range(390)).encode() for _ in range(600)]
        c._query(pieces[:1])
        start = time.process_time()
        ids, text = c._query(pieces)
        middle = time.process_time()
        assert ids == [c._heap(p) for p in pieces] and text == pieces
        assert middle - start < 8 * (time.process_time() - middle)


def test_bpe_of_ids_with_gaps(tmp_path):
    with open(RANKS, "rb") as f:
        ranks = {a: 3 * int(b) + 1 for a, b in map(bytes.split, f)}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(b"%s %d\n" % x for x in ranks.items()))
    texts = ["some tokens and zxqv-neverthelessness", "", "日本語 of it"]
    with bpe.Codec(RANKS, P.PATTERN) as c, bpe.Codec(str(path), P.PATTERN) as d:
        for (i, t), (j, u) in zip(c.batch(texts), d.batch(texts), strict=True):
            assert t == u and (3 * np.frombuffer(i, "<u4") + 1).tolist() == np.frombuffer(j, "<u4").tolist()


def test_bpe_forgets_and_keeps_columns_of_its_names(spark, reference):
    texts = [f"some words {i} and more of them {i * 7}" for i in range(40)]
    with bpe.Codec(RANKS, P.PATTERN, remember=1) as c:
        for _ in range(2):
            assert [np.frombuffer(i, "<u4").tolist() for i, _ in c.batch(texts)] == [reference.encode_ordinary(t) for t in texts]
            assert not c.number and c.held == 0
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, decoded int")
    assert bpe.encode(docs, RANKS, P.PATTERN).columns == ["doc_id", "text", "decoded", "token_ids", "_decoded"]


def test_license_base_phrases_and_rules(spark):
    texts = [
        None, "", "MIT License", "the mit\n* license, the MIT-License", "permit license", "GNU General Public License, gnu general public licenses", "cc by cc by-sa CC  BY",
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-only", "x" * 50000, "éMIT License mit license",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("labels", F.lit("x"))
    got = {x.doc_id: x for x in license.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        w, places, labels = words(t), [], set()
        for phrase, label in license.BASE:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1 and (x.score > 0) == bool(x.labels)
    assert "apache-2.0" in got[7].labels and got[8].labels == "gpl-3.0" and 400 <= len(license.rules()) <= 800
    assert license.license_scan(docs.limit(0)).count() == 0


def _example(tree, pick):
    """A text that a parsed expression matches, where its lookarounds allow."""
    out = ""
    for kind, value in tree:
        if kind is parser.LITERAL:
            out += chr(value)
        elif kind is parser.IN:
            part, x = pick.choice([v for v in value if v[0] in (parser.LITERAL, parser.RANGE, parser.CATEGORY)])
            out += chr(x) if part is parser.LITERAL else chr(x[0]) if part is parser.RANGE else {parser.CATEGORY_SPACE: "\n", parser.CATEGORY_WORD: "u", parser.CATEGORY_NOT_SPACE: "x"}[x]
        elif kind is parser.ANY:
            out += "q"
        elif kind is parser.SUBPATTERN:
            out += _example(value[3], pick)
        elif kind is parser.BRANCH:
            out += _example(pick.choice(value[1]), pick)
        elif kind is parser.MAX_REPEAT:
            out += "".join(_example(value[2], pick) for _ in range(pick.randint(value[0], max(value[0], min(value[1], 1)))))
        else:
            assert kind in (parser.AT, parser.ASSERT, parser.ASSERT_NOT)
    return out


def test_license_gates_drop_no_place():
    pick = random.Random(7)
    for text, label in {"Licensed under the GPL v2": "gpl-2.0", "available under LGPL 2.1": "lgpl-2.1", "under the terms of the MPL 2.0": "mpl-2.0", "AGPL v3": "agpl-3.0", "Creative Commons Attribution": "cc-by", "PSF license": "python-2.0", "Expat license": "mit", "EPL 2.0": "epl-2.0", "SPDX-License-Identifier: PSF-2.0": "python-2.0", "in the public\n * domain": "public-domain", "CC\nBY": "cc-by"}.items():
        assert label in {r.label for _, _, r in license.scan(text.encode())}, text
    for rule in license.rules():
        for _ in range(8):
            text = f"a {_example(parser.parse(rule.pattern.pattern), pick)} z".encode()
            assert license.scan(text) == license.scan(text, gated=False), (rule, text)


def test_licences_by_their_own_words():
    """Wordings of licences, abbreviations, and denials."""
    known = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal": "mit",
        "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:": "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3-clause",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "you may not use this file except in compliance with the License.": "apache-2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published": "gpl",
        "either version 3 of the License, or (at your option) any later version.": "gpl-3.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "licensed under the GPLv3": "gpl-3.0", "the GPL, version 2": "gpl-2.0", "LGPL 2.1": "lgpl-2.1", "MPL 2.0": "mpl-2.0", "AGPL-3.0": "agpl-3.0",
    }
    for text, label in known.items():
        assert label in license.digest(text.encode())[5].split(","), text
    assert license.digest(b"This is not licensed under the Mozilla Public License 2.0 at all")[5:] == ("", 0.0, "")
    assert license.digest(b"not licensed under the MIT license")[4:6] == ("mit", "mit")  # base labels stay


def test_containment_is_that_of_all_pairs():
    r = random.Random(9)
    rule = license.rules()[-1]
    for _ in range(300):
        kept = []
        for _ in range(r.randint(0, 40)):
            s = r.randrange(60)
            kept.append((s, s + r.randint(1, 30), rule._replace(priority=r.choice([10, 40, 90]))))
        kept.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0]))
        want = []
        for s, e, x in kept:
            if not any(a <= s and e <= b for a, b, _ in want):
                want.append((s, e, x))
        assert license._outermost(kept) == want


def test_many_places_take_linear_time():
    import time

    text = b"the MIT license and GNU General Public License v2. "
    spent = []
    for n in (2_000, 8_000):
        at = time.process_time()
        assert license.digest(text * n)[1] == 2 * n
        spent.append(time.process_time() - at)
    assert spent[1] < 8 * spent[0]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(y) <= 255 for y in v.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base_spans(spark):
    r = random.Random(8)
    texts = [
        "a@b.com_x@y.z a@b.c@d.e.f", "1.2.3.4.5 300.1.1.1 1.1.1.0300 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "+1 (262) 555-3752 +12 +1234567 +123456789012345678 +1-2-3-4-5-6-7-8 ",
        "é1.2.3.4é x@y.z\n\n+1 234 567 8901", "", None, "1" * 5000, "a" * 30000 + "@b.c", "@.@.@", "4111111111111111" * 2, "99999999999999999999999.1.1.1",
    ]
    texts += ["".join(r.choice("a.@+1 -4(") for _ in range(300)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({"k": F.lit(1), "base": F.lit(2)})
    got = {x.doc_id: x for x in pii.digest(pii.spans(docs)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i])
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("term")] == want
    assert pii.digest(pii.spans(docs.limit(0))).count() == 0


def test_terms_that_disclose_are_spans_and_common_words_are_not(spark):
    r = random.Random(2)
    filler = [f"word{i}" for i in range(50)]
    texts = [" ".join(r.choice(filler) for _ in range(60)) + "\nnothing here" for _ in range(80)]
    for i in range(6):
        texts.append(f"the zanzibarian writes from zed@home.org today {' '.join(r.choice(filler) for _ in range(20))}\nnothing here word1")
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    spans = {x.doc_id: x.spans for x in pii.digest(pii.spans(docs)).collect()}
    start = texts[80].index("zanzibarian")
    assert f"term:{start}:{start + 11}" in spans[80] and all(not spans[i] for i in range(80))
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert clean[0] == texts[0] and "zanzibarian" not in clean[80] and "zed@home.org" not in clean[80] and "[email]" in clean[80] and clean[80].endswith("nothing here word1")


def slow_terms(rows, reach=16, share=0.9, rare=0.5):
    """Disclosing terms by plain counts; rows of (id, text), repeated ones once."""
    cut = re.compile(r"[^\W_]+")
    counts, together, near = Counter(), Counter(), []
    for i, t in dict.fromkeys(rows):
        found = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(t))]
        toks = [(m.start(), m.end(), m.group().lower()) for m in cut.finditer(t)]
        counts.update(w for _, _, w in toks)
        # single letters are no terms; they count among the corpus's words, not among a text's places
        toks = [x for x in toks if x[1] - x[0] > 1]
        spans = [(f"{k}:{t[a:b].lower()}", a, b) for k, a, b in found]
        inside = lambda a: any(x <= a < y for _, x, y in spans)
        values = {(v, sum(s < a or (s == a and False) for s, _, _ in toks) // reach) for v, a, b in spans}
        for n, (a, b, w) in enumerate(toks):
            if not inside(a):
                for v in {v for v, k in values if abs(k - (n + 1) // reach) <= 1}:
                    near.append((i, t, a, b, w, v))
                    together[v, w] += 1
    around, total, out = Counter(), sum(counts.values()), {}
    for (v, _), n in together.items():
        around[v] += n
    for i, t, a, b, w, v in near:
        if total > around[v] and math.log2(together[v, w] * total / (around[v] * (counts[w] + rare))) / math.log2(total / around[v]) >= share:
            out.setdefault((i, t), set()).add((a, b))
    return out


def test_terms_are_those_of_plain_counts(spark):
    r = random.Random(12)
    common, rare = [f"word{i}" for i in range(30)], [f"seldom{i}" for i in range(400)]
    people = [(f"p{i}@home.org", f"name{i}") for i in range(20)]
    rows = []
    for i in range(150):
        w = [r.choice(rare) if r.random() < 0.05 else r.choice(common) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            e, n = r.choice(people)
            at = r.randint(0, len(w))
            w[at:at] = [n, "\n" * r.randint(0, 2), e]
        rows.append((i, " ".join(w)))
    rows.append((500, " ".join(r.choice(common) for _ in range(30)) + " hapaxia once@met.org " + " ".join(r.choice(common) for _ in range(30))))
    want = slow_terms(rows)
    assert {t[a:b] for (i, t), x in want.items() for a, b in x if i == 500} == {"hapaxia"}  # met once, and protected
    for table in (rows, rows + rows[3:60] + rows[3:9]):
        docs = spark.createDataFrame(table, SCHEMA).withColumns({"uid": F.lit(1), "found": F.lit(2)})
        got = {x.doc_id: {(y.s, y.e) for y in x.terms} for x in pii.spans(docs).collect()}
        assert got == {i: want.get((i, t), set()) for i, t in rows}


def test_one_long_line_of_addresses(spark):
    text = " ".join(f"user{i}@host{i}.example.org" for i in range(20_000))
    (row,) = pii.digest(pii.spans(spark.createDataFrame([(1, text)], SCHEMA))).collect()
    assert row.n_email == 20_000 and row.spans.startswith("email:0:")


def contamination(texts, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                found = wins.get(tuple(w[k : k + n]))
                if found:
                    ids |= found
                    hit |= set(range(k, k + n))
        ids = sorted(str(i) for i in ids if i is not None)
        best = min((longest(w, words(x), window, str(i)) for i, x in items if i is not None and words(x)), default=(0,))
        best = (-best[0], best[2], best[3], best[1]) if best[0] else (0, None, None, None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), *best))
    return out


def longest(w, x, window, name):
    """(-words, place in w, item, place in x) of the longest common run of at least `window` words, or of all of x."""
    found, run = [(0,)], {}
    for a, u in enumerate(w):
        run = {b: run.get(b - 1, 0) + 1 for b, v in enumerate(x) if u == v}
        found += [(-n, a - n + 1, name, b - n + 1) for b, n in run.items() if n >= min(window, len(x))]
    return min(found)


@pytest.mark.parametrize("slice_words", [2_000_000, 20])
def test_decontamination(spark, slice_words):
    r = random.Random(6)
    vocabulary = [f"t{i}" for i in range(12)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([3, 9, 10, 11, 25]))) for i in range(25)] + [(30, ""), (31, None), (None, say(12)), (5, say(14)), (40, "Ünique"), (41, "t1")]
    texts = [None, "", say(400), say(5), "ÜNIQUE", "ünique"]
    for _ in range(40):
        i, t = r.choice([x for x in items if x[1]])
        texts.append(say(r.randint(0, 30)) + ". " + t.upper().replace(" ", ",\n") + " " + say(r.randint(0, 30)))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({"item_id": F.lit(1), "row": F.lit(2)}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in decontaminate.hits(docs, bench, slice_words=slice_words).collect()}
    assert [got[i] for i in range(len(texts))] == contamination(texts, items)
    kept = {x.doc_id for x in decontaminate.decontaminate(docs, bench, slice_words=slice_words).collect()}
    assert kept == {i for i in range(len(texts)) if not got[i][4]}
    assert decontaminate.hits(docs.limit(0), bench).count() == 0
    assert decontaminate.hits(docs, bench.limit(0)).where("contaminated").count() == 0


def test_longest_matches(spark):
    text = " ".join(f"u{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x y " + text + " z"), (2, " ".join(text.split()[5:20]))], SCHEMA).coalesce(1)
    found = decontaminate.longest_matches(docs, spark.createDataFrame([(9, text)], "item_id long, text string")).collect()
    assert sorted(tuple(x) for x in found) == [("9", 0, 1, 2, 40), ("9", 5, 2, 0, 15)]


def test_a_passage_of_many_items_in_many_documents(spark):
    """400 items and 2,000 documents share a passage: what is found is right, in little memory."""
    import tracemalloc

    passage = " ".join(f"p{i}" for i in range(40))
    items = [(f"i{k:03}", (f"q{k} " if k % 2 else "") + passage + f" r{k}") for k in range(400)] + [("z", "p3 p4 p5")]
    texts = [f"a{d} {passage}" + (f" r{d % 400} b" if d % 3 else " c") for d in range(2000)]
    test = decontaminate.TestSuffixes([(i, t.encode()) for i, t in items], 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([t.encode() for t in texts])], names=["doc_id", "t"])

    class Shared:
        value = test

    tracemalloc.start()
    rows = [r for b in decontaminate._marker(Shared, every=True)([batch]) for r in b.to_pylist()]
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    for d, r in enumerate(rows):
        with_next = d % 3 and f"i{d % 400:03}"
        assert r["items"] == [*(i for i, _ in items[:400]), "z"] and r["n_words"] == len(texts[d].split())
        assert r["hit"] == list(range(1, 42 if with_next else 41))
        assert r["best"] == {"words": 41 if with_next else 40, "doc_at": 1, "item": with_next or "i000", "item_at": (d % 400) % 2 if with_next else 0}


def test_very_long_texts_and_matches_at_every_edge(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    long = [r.choice(words) for _ in range(120_000)]
    items = [(1, " ".join(long[:60])), (2, " ".join(long[70_000:70_100])), (3, " ".join(long[-12:])), (4, " ".join(long[500:509])), (2, " ".join(long[70_050:70_080]))]
    docs = [(0, " ".join(long)), (1, " ".join(long[-12:])), (2, " ".join(long[:9])), (3, " ".join(long[1:11]))]
    got = {x.doc_id: tuple(x)[1:] for x in decontaminate.hits(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == contamination([t for _, t in docs], items)
    found = decontaminate.longest_matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, t in items:
        a = t.split()
        for d, text in docs:
            b = text.split()
            at = {}
            for k in range(len(b) - min(10, len(a)) + 1):
                at.setdefault(tuple(b[k : k + min(10, len(a))]), []).append(k)
            for j in range(max(1, len(a) - 9)):
                for k in at.get(tuple(a[j : j + 10]), []):
                    if len(a) < 10 or not (j and k and a[j - 1] == b[k - 1]):
                        n = min(10, len(a))
                        while len(a) >= 10 and j + n < len(a) and k + n < len(b) and a[j + n] == b[k + n]:
                            n += 1
                        want.add((str(i), j, d, k, n))
    assert {tuple(x) for x in found} == want


def test_workers_give_freed_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def each(batches):
        held = [bytes(5000) for _ in range(40_000)]
        pins.extend(bytes(5000) for _ in range(10))
        yield from batches
        del held

    pins, before = [], resident()
    assert list(common.lean(each)([1, 2])) == [1, 2]
    assert resident() - before < 60_000_000
