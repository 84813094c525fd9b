"""Similarity, nearest neighbours and generators of candidates.

Exact nearest neighbours come in parts of bounded bytes: a part of the queries is compared with a part of the references in
one task, block by block by matrix product, which passes on the best k for each query, and a window keeps the best of those.
Generators work on postings (term -> entities) with counts, never on all pairs of entities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.steps import materialise


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(a: str) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def top_code(vector: str, k: int, signed: bool = False) -> Column:
    """array<struct<atom, value>> of the k largest components, by magnitude or by signed value; ties by position."""
    pairs = F.transform(vector, lambda x, i: F.struct((-x if signed else -F.abs(x)).alias("o"), i.alias("atom"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["atom"].alias("atom"), p["value"].alias("value")))


def active_set(vector: str, k: int) -> Column:
    return F.array_sort(F.transform(top_code(vector, k), lambda p: p["atom"]))


def tanimoto(a: Column | str, b: Column | str) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


#: Bytes of vectors on one side of a task, queries that are compared at once in it with four times as many references.
_SIDE, _BLOCK = 64 << 20, 1_000


def nearest(queries: DataFrame, references: DataFrame, k: int, side: int = _SIDE, block: int = _BLOCK) -> DataFrame:
    """queries(id, v), references(id, v) -> (query, reference, cosine, rank): the k nearest, oneself excluded; ties by id.

    Both sides are dealt into as few parts as a task's memory allows (`side` bytes of vectors each), and queries into as many
    as there are cores at least; a task compares one part with one, block by block, and passes on each query's best k. A row is
    copied once for each part of the other side: 130,000 rows of 64 components are one part."""
    q, r = queries.select(F.col("id").alias("query"), unit("v").alias("v")), references.select(F.col("id").alias("reference"), unit("v").alias("v"))
    asked, known, cores = q.count(), r.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first(), queries.sparkSession.sparkContext.defaultParallelism
    part = max(block, side // (8 * max(1, known.d or 1)))
    n, m = max(1, -(-asked // part), min(cores, -(-asked // block))), max(1, -(-known.n // part))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    q = q.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(n)).cast("int").alias("x"), every(m).alias("y"))
    r = r.select("reference", "v", every(n).alias("x"), F.pmod(F.xxhash64("reference"), F.lit(m)).cast("int").alias("y"))
    found = q.groupBy("x", "y").cogroup(r.groupBy("x", "y")).applyInArrow(_block_top(k, block), "query long, reference long, cosine double")
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "reference")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, value) of the k largest finite values of each row of s; ids has a row or one for all; ties by id."""
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
    row, column = np.nonzero((s >= least[:, None]) & np.isfinite(s))  # ties at the edge stay for now
    value, found = s[row, column], ids[column] if ids.ndim == 1 else ids[row, column]
    order = np.lexsort((found, -value, row))
    row, found, value = row[order], found[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], found[place < k], value[place < k]


def _block_top(k: int, block: int):
    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, r = left.column("query").to_numpy(), right.column("reference").to_numpy()
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids) and len(r):
            matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(len(t), -1)
            x, y = matrix(left), matrix(right)
            for a in range(0, len(ids), block):
                some = ids[a : a + block]
                row, found, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for b in range(0, len(r), 4 * block):
                    s = x[a : a + block] @ y[b : b + 4 * block].T
                    s[some[:, None] == r[None, b : b + 4 * block]] = -np.inf
                    new = _best(s, r[b : b + 4 * block], k)
                    row, found, value = (np.concatenate(c) for c in zip((row, found, value), new, strict=True))
                order = np.lexsort((found, -value, row))
                row, found, value = row[order], found[order], value[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append((some[row[keep]], found[keep], value[keep]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("query", "reference", "cosine"), columns, strict=True)))

    return each


def transfer(neighbours: DataFrame, annotations: DataFrame) -> DataFrame:
    """Votes of the neighbours' terms: (entity, term, vote, fraction): similarity-weighted share (negative similarities count 0),
    and share of neighbours that carry the term."""
    w = F.greatest(F.lit(0.0), F.col("cosine"))
    totals = neighbours.groupBy("query").agg(F.sum(w).alias("all_w"), F.count("*").alias("all_n"))
    votes = neighbours.join(annotations.select(F.col("entity").alias("reference"), "term"), "reference").groupBy("query", "term").agg(F.sum(w).alias("w"), F.count("*").alias("n"))
    return votes.join(totals, "query").select(F.col("query").alias("entity"), "term", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0).alias("vote"), (F.col("n") / F.col("all_n")).alias("fraction"))


def proposal_sets(banks: dict[str, DataFrame], annotations: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(bank, entity, term): for each bank of vectors(id, v), the terms of an entity's k nearest, itself left out; queries(id)
    picks the entities."""
    out = None
    for name, bank in banks.items():
        asked = bank if queries is None else bank.join(queries.select("id").distinct(), "id", "left_semi")
        near = nearest(asked, bank, k)
        part = near.join(annotations.select(F.col("entity").alias("reference"), "term").distinct(), "reference").select(F.lit(name).alias("bank"), F.col("query").alias("entity"), "term").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def purity(neighbours: DataFrame, sets: DataFrame) -> DataFrame:
    """Per query: mean Jaccard of its terms with its neighbours'. sets(entity, terms array)."""
    a, b = (sets.select(F.col("entity").alias(c), F.col("terms").alias(t)) for c, t in (("query", "ta"), ("reference", "tb")))
    return neighbours.join(a, "query").join(b, "reference").groupBy("query").agg(F.avg(tanimoto("ta", "tb")).alias("purity"))


def pool(units: DataFrame, by: str, vector: str) -> DataFrame:
    """Per entity and dimension of its units' vectors: mean, max, min, std, largest magnitude (signed), mean magnitude."""
    long = units.select(by, F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(by, "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.stddev_pop("x").alias("std"), F.max_by("x", F.abs("x")).alias("abs_max"), F.avg(F.abs("x")).alias("mean_abs"))


def corpus_moments(units: DataFrame, vector: str) -> DataFrame:
    return units.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def code_usage(codes: DataFrame) -> DataFrame:
    """codes(entity, atom): entropy, effective width exp(entropy), atoms in use, and the load-balance penalty width * sum p^2."""
    n = codes.groupBy("atom").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all_"), F.count("*").alias("atoms"))
    p = F.col("n") / F.col("all_")
    return n.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("entropy"), F.exp(-F.sum(p * F.log(p))).alias("effective"), F.max("atoms").alias("atoms"), (F.sum(p * p) * F.max("atoms")).alias("balance"))  # total is one row


def co_occurrence(incidence: DataFrame) -> DataFrame:
    """incidence(entity, term) -> (a, b, n): entities that hold both, a < b."""
    rows = incidence.select("entity", "term").distinct()
    a, b = rows.select("entity", F.col("term").alias("a")), rows.select("entity", F.col("term").alias("b"))
    return a.join(b, "entity").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def ppmi(pairs: DataFrame, incidence: DataFrame) -> DataFrame:
    """(a, b, n, ppmi) by entity counts: max(0, ln(n N / (n_a n_b)))."""
    rows = incidence.select("entity", "term").distinct()
    n = rows.groupBy("term").agg(F.count("*").alias("k"))
    total = rows.agg(F.countDistinct("entity").alias("all_"))
    both = pairs.join(n.select(F.col("term").alias("a"), F.col("k").alias("na")), "a").join(n.select(F.col("term").alias("b"), F.col("k").alias("nb")), "b")
    return both.crossJoin(F.broadcast(total)).select("a", "b", "n", F.greatest(F.lit(0.0), F.log(F.col("n") * F.col("all_") / (F.col("na") * F.col("nb")))).alias("ppmi"))  # total is one row


def propose(known: DataFrame, links: DataFrame, pool_: DataFrame, k: int) -> DataFrame:
    """links(a, b, weight), both ways: each entity's k best terms by summed weight from its known terms, outside its pool."""
    both = links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).where("weight > 0")
    scored = known.select("entity", F.col("term").alias("a")).join(both, "a").groupBy("entity", F.col("b").alias("term")).agg(F.sum("weight").alias("score"))
    fresh = scored.join(pool_.select("entity", "term").unionByName(known.select("entity", "term")).distinct(), ["entity", "term"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.round("score", 9)), "term"))).where(F.col("rank") <= k)


def association_prior(known: DataFrame, incidence: DataFrame) -> DataFrame:
    """(entity, term, total): sum over the entity's known terms a of P(term | a), by entity counts, the term itself left out."""
    rows = incidence.select("entity", "term").distinct()
    n = rows.groupBy("term").agg(F.count("*").alias("na"))
    pairs = co_occurrence(incidence)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    given = both.join(n.withColumnRenamed("term", "a"), "a").select("a", "b", (F.col("n") / F.col("na")).alias("p"))
    return known.select("entity", F.col("term").alias("a")).join(given, "a").groupBy("entity", F.col("b").alias("term")).agg(F.sum("p").alias("total"))


def network_scores(edges: DataFrame, channels: list[str], annotations: DataFrame, cut: float) -> DataFrame:
    """edges(a, b, channels 0..1000): the edge weight is the noisy-or of its channels; each end gets its partners' terms."""
    w = 1 - F.lit(1.0)
    keep = F.lit(1.0)
    for c in channels:
        keep = keep * (1 - F.coalesce(F.col(c), F.lit(0)) / 1000)
    w = 1 - keep
    one = edges.where("a <> b").select("a", "b", w.alias("w")).where(F.col("w") >= cut)
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    return both.join(annotations.select(F.col("entity").alias("b"), "term"), "b").groupBy(F.col("a").alias("entity"), "term").agg(F.sum("w").alias("score"), F.count("*").alias("partners"))


def profile_neighbours(presence: DataFrame, least: int, k: int) -> DataFrame:
    """presence(group, taxon) -> (a, b, r): Pearson correlation of presence vectors from counts, the k best of each group."""
    rows = presence.select("group", "taxon").distinct()
    n = rows.groupBy("group").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    rows = rows.join(n.select("group"), "group")
    total = rows.agg(F.countDistinct("taxon").alias("all_"))
    a, b = rows.select("taxon", F.col("group").alias("a")), rows.select("taxon", F.col("group").alias("b"))
    both = a.join(b, "taxon").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = both.join(n.select(F.col("group").alias("a"), F.col("k").alias("na")), "a").join(n.select(F.col("group").alias("b"), F.col("k").alias("nb")), "b").crossJoin(F.broadcast(total))  # total is one row
    size = F.col("all_")
    spread = F.sqrt(F.col("na") * (size - F.col("na"))) * F.sqrt(F.col("nb") * (size - F.col("nb")))
    r = F.when(spread > 0, (F.col("n") * size - F.col("na") * F.col("nb")) / spread)
    return both.select("a", "b", F.round(r, 9).alias("r")).where("r is not null").withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("r"), "b"))).where(F.col("rank") <= k)


def set_transfer(known: DataFrame, k: int, near_duplicate: float = 0.95) -> DataFrame:
    """(entity, term, vote): terms of the k entities most alike by Jaccard of known sets; near duplicates are left out."""
    rows = known.select("entity", "term").distinct()
    n = rows.groupBy("entity").agg(F.count("*").alias("n"))
    a, b = rows.select("term", F.col("entity").alias("a")), rows.select("term", F.col("entity").alias("b"))
    both = a.join(b, "term").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("m")).join(n.select(F.col("entity").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("entity").alias("b"), F.col("n").alias("nb")), "b")
    j = both.select("a", "b", (F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).alias("j")).where(F.col("j") < near_duplicate)
    top = j.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("j"), "b"))).where(F.col("k") <= k)
    total = top.groupBy("a").agg(F.sum("j").alias("all_"))
    return top.join(rows.select(F.col("entity").alias("b"), "term"), "b").groupBy("a", "term").agg(F.sum("j").alias("w")).join(total, "a").select(F.col("a").alias("entity"), "term", (F.col("w") / F.col("all_")).alias("vote"))


def resnik_lin(pairs: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """pairs(a, b) of entities with closed terms: (a, b, resnik, lin) by the largest ic they share."""
    weighted = closed.join(ic.select("term", "ic"), "term")
    best = weighted.groupBy("entity").agg(F.max("ic").alias("top"))
    shared = pairs.join(closed.select(F.col("entity").alias("a"), "term"), "a").join(weighted.select(F.col("entity").alias("b"), "term", "ic"), ["b", "term"]).groupBy("a", "b").agg(F.max("ic").alias("resnik"))
    full = pairs.join(shared, ["a", "b"], "left").join(best.select(F.col("entity").alias("a"), F.col("top").alias("ta")), "a", "left").join(best.select(F.col("entity").alias("b"), F.col("top").alias("tb")), "b", "left")
    r, t = F.coalesce("resnik", F.lit(0.0)), F.coalesce("ta", F.lit(0.0)) + F.coalesce("tb", F.lit(0.0))
    return full.select("a", "b", r.alias("resnik"), F.when(t > 0, 2 * r / t).otherwise(0.0).alias("lin"))


def lin(found: DataFrame) -> DataFrame:
    """resnik_lin() of found(a, b, resnik, top_a, top_b)."""
    t = F.col("top_a") + F.col("top_b")
    return found.select("a", "b", "resnik", F.when(t > 0, 2 * F.col("resnik") / t).otherwise(0.0).alias("lin"))


def max_sim(pairs: DataFrame, units: DataFrame, block: int = 1_000) -> DataFrame:
    """pairs(a, b), units(entity, pos, v): mean over a's units of their best cosine among b's, and the reverse. An entity's units
    are rows of about `block` units, and a task compares one such row with one: a matrix product, of which each unit's best
    cosine leaves the task. A unit is copied once for each block of its partner."""
    n = units.groupBy("entity").agg(F.ceil(F.count("*") / block).cast("int").alias("n_"))
    dealt = units.join(n, "entity").select("entity", F.pmod(F.xxhash64("pos"), F.col("n_")).cast("int").alias("k"), "v")
    held = materialise(dealt.groupBy("entity", "k").agg(F.collect_list("v").alias("u")), "blocks")  # about `block` units
    rows = pairs.select("a", "b")
    for c in "ab":
        rows = rows.join(held.select(F.col("entity").alias(c), F.col("k").alias(f"k{c}"), F.col("u").alias(f"u{c}")), c)
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in "ab"}

    def matrix(x: pa.ListScalar) -> np.ndarray:
        v = np.asarray(x.values.flatten(), np.float64).reshape(len(x.values), -1)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 0)

    def each(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                b = batch.slice(at, 1)
                c = matrix(b.column(4)[0]) @ matrix(b.column(5)[0]).T
                for side, k, best in ((0, 2, c.max(axis=1)), (1, 3, c.max(axis=0))):
                    same = pa.array(np.zeros(len(best), np.int64))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(same), b.column(1).take(same), pa.array(np.full(len(best), side, np.int32)), b.column(k).take(same), pa.array(np.arange(len(best), dtype=np.int32)), pa.array(best)], names=["a", "b", "side", "k", "i", "best"])

    found = rows.select("a", "b", "ka", "kb", "ua", "ub").mapInArrow(each, f"a {kinds['a']}, b {kinds['b']}, side int, k int, i int, best double")
    best = found.groupBy("a", "b", "side", "k", "i").agg(F.max("best").alias("best"))
    return best.groupBy("a", "b").agg(*[F.avg(F.when(F.col("side") == k, F.col("best"))).alias(n) for k, n in enumerate(("a_in_b", "b_in_a"))])


def windows(sequence: DataFrame, by: str, text: str, length: int, step: int) -> DataFrame:
    """(by, at, part): overlapping windows over a string, from every step-th place."""
    return sequence.where(F.length(text) > 0).select(by, text, F.explode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).alias("at")).select(by, "at", F.expr(f"substring({text}, at + 1, {length})").alias("part"))


def lexical_hits(names: DataFrame, texts: DataFrame) -> DataFrame:
    """names(term, name), texts(id, text): (id, term, hits) where every word of the name is in the text; words of four letters
    or more join, so no text meets every name."""
    word = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    n = names.select("term", word("name").alias("w")).where("size(w) > 0")
    asked = n.select("term", F.size("w").alias("need"), F.explode("w").alias("word"))
    have = texts.select("id", F.explode(word("text")).alias("word"))
    return asked.join(have, "word").groupBy("id", "term", "need").agg(F.count("*").alias("hits")).where("hits = need").select("id", "term", "hits")
