"""Similarity of entities through the terms that they share: whose ancestor it rests on, within one aspect, and nulls of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ontology
from .retrieval import resnik_lin


def informative_ancestors(pairs: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """pairs(a, b) of entities with closed terms: (a, b, mica, resnik), the most informative term that both hold, ties by the
    greater term; null where they share none. An entity's terms are one array, most informative first (as long as the
    ontology at most), so a pair is one row: the first of the one that the other holds, too."""
    weighted = closed.select("entity", "term").distinct().join(ic.select("term", "ic"), "term")
    held = weighted.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("ic", "term")), asc=False), lambda x: x["term"]).alias("t"))
    rows = pairs
    for c in "ab":
        rows = rows.join(held.select(F.col("entity").alias(c), F.col("t").alias(f"t{c}")), c, "left")
    first = rows.select("a", "b", F.get(F.array_intersect("ta", "tb"), F.lit(0)).alias("mica"))
    return first.join(ic.select(F.col("term").alias("mica"), F.col("ic").alias("resnik")), "mica", "left").select("a", "b", "mica", "resnik")


def mica_aspects(pairs: DataFrame, closed: DataFrame, ic: DataFrame, aspects: DataFrame) -> DataFrame:
    """(aspect, pairs): how many pairs rest on an ancestor of each aspect(term, aspect); 'none' without one. It tells, before
    anything is fitted to such similarities, which aspect they speak about."""
    return aspects_of(informative_ancestors(pairs, closed, ic), aspects)


def aspects_of(found: DataFrame, aspects: DataFrame) -> DataFrame:
    """mica_aspects() of found(mica)."""
    found = found.join(aspects.select(F.col("term").alias("mica"), "aspect"), "mica", "left")
    return found.groupBy(F.coalesce("aspect", F.lit("none")).alias("aspect")).agg(F.count("*").alias("pairs"))


def aspect_similarity(pairs: DataFrame, closed: DataFrame, aspects: DataFrame, aspect: str) -> DataFrame:
    """(a, b, resnik, lin) within one aspect: terms outside it are dropped first, and information content is counted anew on
    what is left, so that no other aspect's annotations weigh in."""
    own = closed.join(aspects.where(F.col("aspect") == aspect).select("term"), "term", "left_semi").select("entity", "term")
    return resnik_lin(pairs, own, ontology.information_content(own))


def pool_mean_null(pairs: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """(a, b, lin, marginal): Lin's similarity, and the null that keeps both entities' own best content but puts the pool's mean
    in place of what they share: 2 * mean / (best_a + best_b), 0 where that is 0. Every trace of which pair is which is gone."""
    best = closed.join(ic.select("term", "ic"), "term").groupBy("entity").agg(F.max("ic").alias("top"))
    rows = resnik_lin(pairs, closed, ic)
    for c in "ab":
        rows = rows.join(best.select(F.col("entity").alias(c), F.col("top").alias(f"top_{c}")), c, "left")
    return mean_null(rows)


def mean_null(rows: DataFrame) -> DataFrame:
    """pool_mean_null() of rows(a, b, lin, top_a, top_b)."""
    total = F.coalesce("top_a", F.lit(0.0)) + F.coalesce("top_b", F.lit(0.0))
    # what is shared, from Lin's value over its own denominator; where that is 0 the value is 0 and so is the part
    mean = rows.agg(F.avg(F.col("lin") * total / 2).alias("mean_"))
    return rows.crossJoin(F.broadcast(mean)).select("a", "b", "lin", F.when(total > 0, 2 * F.col("mean_") / total).otherwise(0.0).alias("marginal"))  # mean is one row


def null_target(pairs: DataFrame, closed: DataFrame, ic: DataFrame, target: str, seed: str = "0") -> DataFrame:
    """(a, b, target) for target 'lin', 'marginal' or 'shuffled' (Lin's values dealt to other pairs by hash rank)."""
    if target not in ("lin", "marginal", "shuffled"):
        raise ValueError(f"no target {target!r}: lin, marginal or shuffled")
    rows = pool_mean_null(pairs, closed, ic)
    if target == "shuffled":
        from .codes import pair_targets

        return pair_targets(rows.select("a", "b", "lin"), "lin", seed).select("a", "b", F.col("shuffled").alias("target"))
    return rows.select("a", "b", F.col(target).alias("target"))
