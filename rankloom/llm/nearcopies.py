"""Near copies by shingle similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more,
and groups of documents that such pairs connect.

First come SimHash's pairs, by operator 1: 64-bit fingerprints of the same shingles, joined on pigeonhole blocks, at 3 bits or
fewer, each checked on the texts. Fingerprints differ in about ten bits at a similarity of 0.8, too many for any choice of blocks to leave a
selective key; so what SimHash does not connect is completed by prefixes, which lose no pair. All shingles have one order: first those not known to be common, by
hash, then the common ones. Sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each (n: the set's
size). What counts as common is counted on an eighth of the rows, the more frequent first up to MOST of them; that sets the
order only, never the result, and what a shingle's group holds stays in proportion to the table.

Equal sets are one row from the start. Each shared prefix shingle links its rows to the least of them; what holds of these
and of SimHash's links against the texts is connected. Then all rows that share a prefix shingle and are not yet connected meet, if sizes and places allow
the similarity. Sketches drop most of the pairs that are not similar before their texts are fetched. So a large group of copies costs as many pairs as it has rows, not their square.

Defined cases: a text of fewer words than a shingle is one shingle; null counts as empty; texts without words equal one another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, lean, materialise
from .graph import connected_components

WORDS, SIMILARITY = 5, 0.8
#: Of the order of shingles: share of rows counted, shingles taken of each, rows that make a shingle common, most of those.
SHARE, LEAST, COMMON, MOST = 8, 300, 4, 4_000_000
REMEMBER = 50_000
_MET: dict[bytes, int] = {}


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    found = data.lower().split()
    if len(_MET) > REMEMBER:
        _MET.clear()
    for w in set(found):
        if w not in _MET:
            _MET[w] = xxhash.xxh64_intdigest(w, 42)
    h = np.fromiter((_MET[w] for w in found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    x = np.full(n, min(len(h), words), np.uint64)
    for i in range(min(len(h), words)):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.unique(x)


def _pieces(batches, rows: int = 500):
    """Batches in slices: of many texts only a few are unpacked at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of s are in known, ascending: as many searches as s is long, however long known is."""
    if not len(known):
        return np.zeros(len(s), bool)
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the hashes that fall on each of at least n bits; two sketches differ in no more bits than their sets in
    shingles, also when the longer one is folded."""
    m = 64
    while m < len(s):
        m *= 2
    return np.packbits(np.bincount((s % np.uint64(m)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """The least number of shingles that only one of two sets has, by their sketches."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """The shingles that many of the counted rows hold, ascending; the most frequent where there are over MOST of them."""
    counted = texts.where(F.pmod(F.xxhash64("row"), F.lit(SHARE)) == 0)

    @lean
    def each(batches):
        for b in _pieces(batches):
            k = np.concatenate([shingles(t or b"", words)[:LEAST] for t in b.column(0).to_pylist()] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64))], names=["k"])

    found = materialise(counted.select("t").mapInArrow(each, "k long").groupBy("k").count().where(F.col("count") >= COMMON), "common")
    levels, least = found.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).limit(MOST).collect(), COMMON
    for level, upto in zip(levels, np.cumsum([r.n for r in levels]).tolist(), strict=True):
        if upto > MOST:
            least = level["count"] + 1
            break
    out = np.sort(found.where(F.col("count") >= least).select("k").toArrow().column(0).to_numpy().view(np.uint64))  # 8 bytes for each of MOST at most
    discard(found)
    return out


def _prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(row, rank, d1, d2, n, bits, prefix, fp) for each of texts(row, rank, t): d1 and d2 stand for the set of n shingles, fp is
    the text's SimHash."""
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, words))

    def one(data):
        s = shingles(data, words)
        d = xxhash.xxh3_128_intdigest(s.tobytes())
        often = _among(s, common.value)
        first = np.concatenate([s[~often], s[often]])[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
        return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), len(s), sketch(s), first.view(np.int64)

    @lean
    def each(batches):
        for b in _pieces(batches):
            given = [t or b"" for t in b.column(2).to_pylist()]
            made, prints = [one(t) for t in given], np.array([simhash.fingerprint(t, words) for t in given], np.uint64)
            cut = np.concatenate([[0], np.cumsum([len(x[4]) for x in made])]).astype(np.int32)
            flat = np.concatenate([x[4] for x in made] or [np.zeros(0, np.int64)])
            numbers = [pa.array([x[i] for x in made], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, pa.array([x[3] for x in made], pa.binary()), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), pa.array(prints.view(np.int64))], names=["row", "rank", "d1", "d2", "n", "bits", "prefix", "fp"])

    return texts.select("row", "rank", "t").mapInArrow(each, "row long, rank long, d1 long, d2 long, n long, bits binary, prefix array<long>, fp long")


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """prints(row, fp) -> (a, b): pairs of rows that connect what fingerprints at simhash.DISTANCE bits or fewer connect. Each
    fingerprint's rows are linked to the least of them, and these as operator 1 links their fingerprints."""
    first = materialise(prints.groupBy("fp").agg(F.min("row").alias("top")), "prints")
    same = prints.join(first, "fp").where("row <> top").select(F.col("top").alias("a"), F.col("row").alias("b"))
    near = simhash.links(first.select("fp")).distinct()
    ends = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(ends)


def _possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose sketches leave the similarity open; no similar pair is lost."""
    both = pairs.join(sets.select("row", "n", "bits").toDF("a", "na", "sa"), "a").join(sets.select("row", "n", "bits").toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    @lean
    def each(batches):
        for b in _pieces(batches):
            na, nb, sa, sb = (b.column(i).to_pylist() for i in range(2, 6))
            keep = [_differ(x, y) * (1 + similarity) <= (1 - similarity) * (m + n) + 1e-6 for m, n, x, y in zip(na, nb, sa, sb, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(each, "a long, b long"), "possible")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose texts are similar."""
    pairs = _possible(pairs, sets, similarity)
    wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    held = materialise(texts.select("row", "t").join(wanted, "row", "left_semi"), "texts")
    both = pairs.join(held.toDF("a", "ta"), "a").join(held.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    @lean
    def each(batches):
        for b in _pieces(batches):
            at, keep = {}, []
            for x, y, tx, ty in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r, t in ((x, tx), (y, ty)):
                    if r not in at:
                        at[r] = shingles(t or b"", words)
                keep.append(jaccard(at[x], at[y]) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialise(both.mapInArrow(each, "a long, b long"), "similar")
    discard(held)
    discard(pairs)
    return out


def _could(similarity: float, a: str, b: str) -> str:
    """Whether sets of a.n and b.n shingles that share the one at a.p and b.p can be similar."""
    most = f"least({a}.p, {b}.p) + 1 + least({a}.n - {a}.p, {b}.n - {b}.p) - 1"
    return f"least({a}.n, {b}.n) >= {similarity} * greatest({a}.n, {b}.n) - 1e-6 and ({most}) * {1 + similarity} >= {similarity} * ({a}.n + {b}.n) - 1e-6"


def least_of_groups(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """texts(row long, rank long, t binary), rows unique -> (row): of each group the row with the least (rank, row)."""
    sets = materialise(_prefixes(texts, words, similarity), "sets")
    alike = materialise(sets.groupBy("d1", "d2").agg(F.min(F.struct("rank", "row")).alias("m")).select("d1", "d2", F.col("m.rank").alias("rank"), F.col("m.row").alias("row")), "alike")
    own = materialise(sets.join(alike.select("row"), "row", "left_semi"), "own")
    discard(sets)
    keys = own.select("row", "n", F.posexplode("prefix").alias("p", "k"))
    stars = keys.groupBy("k").agg(F.count("*").alias("c"), F.min(F.struct("row", "n", "p")).alias("m")).where("c > 1").select("k", "m")
    stars = materialise(stars, "stars")
    shared = materialise(keys.join(stars, "k").select("k", "row", "n", "p", "m"), "shared")
    met = shared.alias("x").where("x.row <> m.row").where(_could(similarity, "x", "m")).select(F.col("m.row").alias("a"), F.col("row").alias("b"))
    met = materialise(met.unionByName(simhash_pairs(own.select("row", "fp"))).distinct(), "pairs")
    discard(stars)
    slim = materialise(own.select("row", "n", "bits"), "sketches")
    discard(own)
    near = _verified(met, slim, texts, words, similarity)
    roots = materialise(connected_components(near), "roots")
    member = materialise(shared.drop("m").join(roots.withColumnRenamed("node", "row"), "row", "left").select("k", "row", "n", "p", F.coalesce("root", "row").alias("root")), "member")
    discard(shared)
    discard(roots)
    tops = member.select("k", "root").distinct()
    apart = tops.toDF("k", "ra").join(tops.toDF("k", "rb"), "k").where("ra < rb")
    left = apart.join(member.toDF("k", "row", "n", "p", "ra"), ["k", "ra"]).select("k", "rb", F.struct("row", "n", "p").alias("x"))
    cross = left.join(member.select("k", F.col("root").alias("rb"), F.struct("row", "n", "p").alias("y")), ["k", "rb"]).where(_could(similarity, "x", "y"))
    rest = cross.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()
    left_over = materialise(rest.join(met, ["a", "b"], "left_anti"), "pairs")
    discard(member)
    discard(met)
    more = _verified(left_over, slim, texts, words, similarity)
    discard(slim)
    discard(left_over)
    roots = materialise(connected_components(near.unionByName(more)), "roots")
    named = alike.join(roots.withColumnRenamed("node", "row"), "row", "left").select("rank", "row", F.coalesce("root", "row").alias("root"))
    return materialise(named.groupBy("root").agg(F.min(F.struct("rank", "row")).alias("m")).select("m.row"), "kept")
