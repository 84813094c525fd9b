"""Set algebra of proposals, global cuts and ranks, pools against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.steps import before, materialise

PAIR = ["entity", "term"]


def union(*proposals: DataFrame) -> DataFrame:
    out = proposals[0].select(*PAIR)
    for p in proposals[1:]:
        out = out.unionByName(p.select(*PAIR))
    return out.distinct()


def difference(proposals: DataFrame, *others: DataFrame) -> DataFrame:
    """Proposals in none of the others; one anti join against their union."""
    return proposals.select(*PAIR).distinct().join(union(*others), PAIR, "left_anti")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(entity, jaccard) of two streams' term sets, by counts of one union."""
    both = a.select(*PAIR).distinct().withColumn("f", F.lit(1)).unionByName(b.select(*PAIR).distinct().withColumn("f", F.lit(2)))
    per = both.groupBy(*PAIR).agg(F.sum("f").alias("f"))
    return per.groupBy("entity").agg((F.sum((F.col("f") == 3).cast("int")) / F.count("*")).alias("jaccard"))


def containment(part: DataFrame, whole: DataFrame) -> DataFrame:
    """(entity, coverage): the share of whole's terms that part has."""
    hit = whole.select(*PAIR).distinct().join(part.select(*PAIR).distinct().withColumn("y", F.lit(1)), PAIR, "left")
    return hit.groupBy("entity").agg(F.avg(F.coalesce("y", F.lit(0))).alias("coverage"))


def top_fraction(rows: DataFrame, q: float, tie: list[str]) -> DataFrame:
    """The q * n best rows of all. Counts by score tell the score of the last one; only rows of that score are sorted."""
    most = int(rows.count() * q)
    steps = rows.groupBy("score").agg(F.count("*").alias("n_")).withColumn("fall_", -F.col("score"))
    cut = before(steps, "fall_", "n_", "above_").where((F.col("above_") < most) & (F.col("above_") + F.col("n_") >= most)).first()
    if cut is None:
        return rows.limit(0)
    ties = rows.where(F.col("score") == cut.score).orderBy(*tie).limit(most - cut.above_)
    return rows.where(F.col("score") > cut.score).unionByName(ties)


def mean_rank(rows: DataFrame, column: str) -> DataFrame:
    """rows with rank_<column>, ties averaged, over all rows: from counts by distinct value, never a rank of all rows."""
    steps = rows.groupBy(column).agg(F.count("*").alias("n_"))
    ranks = before(steps, column, "n_", "below_").select(column, (F.col("below_") + (F.col("n_") + 1) / 2).alias(f"rank_{column}"))
    return rows.join(ranks, column)


def average_rank_blend(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds blended: the mean of both scores' mean ranks, over the number of rows."""
    n = rows.agg(F.count("*").alias("all_"))
    ranked = mean_rank(mean_rank(rows, a), b)
    return ranked.crossJoin(F.broadcast(n)).withColumn("blended", (F.col(f"rank_{a}") + F.col(f"rank_{b}")) / (2 * F.col("all_"))).drop("all_", f"rank_{a}", f"rank_{b}")  # n is one row


def orthogonal_recovery(rows: DataFrame, a: str, b: str, low: float = 0.5, high: float = 0.75) -> DataFrame:
    """(hits, recovered): true rows, and those that a ranks in its lower part and b in its upper one."""
    n = rows.agg(F.count("*").alias("all_"))
    ranked = mean_rank(mean_rank(rows, a), b).crossJoin(F.broadcast(n))  # n is one row
    found = (F.col("label") == 1) & (F.col(f"rank_{a}") <= low * F.col("all_")) & (F.col(f"rank_{b}") >= high * F.col("all_"))
    return ranked.agg(F.sum("label").alias("hits"), F.sum(found.cast("int")).alias("recovered"))


def pool_ceiling(pool: DataFrame, truth: DataFrame, weights: DataFrame, closure: DataFrame) -> DataFrame:
    """(captured, missed): weight of the true closed terms inside and outside the pool's closure."""
    reach = pool.select(*PAIR).join(closure, "term").select("entity", F.col("ancestor").alias("term")).distinct().withColumn("y", F.lit(1))
    rows = truth.select(*PAIR).distinct().join(reach, PAIR, "left").join(weights, "term", "left")
    w = F.coalesce("ia", F.lit(0.0))
    return rows.agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("captured"), F.sum(F.when(F.col("y").isNull(), w).otherwise(0.0)).alias("missed"))


def generation_gain(proposals: DataFrame, pool: DataFrame, truth: DataFrame, weights: DataFrame, closure: DataFrame, ks: list[int]) -> DataFrame:
    """proposals(entity, term, rank) -> (k, true_mass, false_mass): weight of ancestors newly covered by the k best."""
    reach = lambda d: d.join(closure, "term")
    have = reach(pool.select(*PAIR)).select("entity", F.col("ancestor").alias("term")).distinct()
    first = reach(proposals).groupBy("entity", F.col("ancestor").alias("term")).agg(F.min("rank").alias("rank")).join(have, PAIR, "left_anti")
    rows = first.join(truth.select(*PAIR).distinct().withColumn("y", F.lit(1)), PAIR, "left").join(weights, "term", "left")
    w = F.coalesce("ia", F.lit(0.0))
    by = rows.select(w.alias("w"), "y", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))).alias("k"))
    return by.groupBy("k").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("true_mass"), F.sum(F.when(F.col("y").isNull(), F.col("w")).otherwise(0.0)).alias("false_mass"))


def matched_budget(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Two generators cut at each entity's smaller pool: (only_a, only_b, both) true pairs."""
    size = lambda d: d.groupBy("entity").agg(F.count("*").alias("n"))
    room = size(a).withColumnRenamed("n", "na").join(size(b).withColumnRenamed("n", "nb"), "entity").select("entity", F.least("na", "nb").alias("room"))
    best = Window.partitionBy("entity").orderBy(F.desc("score"), "term")
    cut = lambda d, f: d.withColumn("k_", F.row_number().over(best)).join(room, "entity").where("k_ <= room").select(*PAIR, F.lit(f).alias("f"))
    met = cut(a, 1).unionByName(cut(b, 2)).groupBy(*PAIR).agg(F.sum("f").alias("f")).join(truth.select(*PAIR).distinct(), PAIR, "left_semi")
    n = lambda k: F.sum((F.col("f") == k).cast("int"))
    return met.agg(n(1).alias("only_a"), n(2).alias("only_b"), n(3).alias("both"))


def vocabulary_coverage(pairs: DataFrame, vocabulary: DataFrame, weights: DataFrame) -> DataFrame:
    """(pairs, covered, share, weighted share) of pairs whose term a vocabulary(term) has."""
    rows = pairs.select(*PAIR).distinct().join(vocabulary.select("term").distinct().withColumn("y", F.lit(1)), "term", "left").join(weights, "term", "left")
    w, y = F.coalesce("ia", F.lit(0.0)), F.coalesce("y", F.lit(0))
    return rows.agg(F.count("*").alias("pairs"), F.sum(y).alias("covered"), F.avg(y).alias("share"), (F.sum(w * y) / F.sum(w)).alias("weighted"))


def exemplars(neighbours: DataFrame, annotations: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """rows(entity, term) with the mean similarity of the k nearest neighbours that carry the term, and of those that don't."""
    n = neighbours.select(F.col("query").alias("entity"), "reference", "cosine")
    met = rows.select(*PAIR).distinct().join(n, "entity").join(annotations.select(F.col("entity").alias("reference"), "term").distinct().withColumn("y", F.lit(1)), ["reference", "term"], "left")
    ranked = met.withColumn("y", F.coalesce("y", F.lit(0))).withColumn("k_", F.row_number().over(Window.partitionBy("entity", "term", "y").orderBy(F.desc("cosine"), "reference"))).where(F.col("k_") <= k)
    return ranked.groupBy(*PAIR).agg(F.avg(F.when(F.col("y") == 1, F.col("cosine"))).alias("with_term"), F.avg(F.when(F.col("y") == 0, F.col("cosine"))).alias("without_term"))


def graded_support(signatures: DataFrame, implies: DataFrame, closure: DataFrame, most: int = 4_000_000, rows_a_task: int = 4_000_000) -> DataFrame:
    """signatures(entity, signature), implies(signature, term): the share of an entity's signatures that imply a closed term.

    Terms are closed once a signature, before entities multiply them. Where that makes at most `most` rows, the signatures are
    broadcast with their terms as arrays and the entities, dealt once, are counted in place; else both sides meet by signature."""
    own = materialise(signatures.select("entity", "signature").distinct(), "own")
    said = materialise(implies.join(closure, "term").select("signature", F.col("ancestor").alias("term")).distinct(), "said")
    n = own.groupBy("entity").agg(F.count("*").alias("n"))
    terms = materialise(said.groupBy("signature").agg(F.count("*").alias("terms")), "terms")
    if terms.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0] > most:
        return own.join(said, "signature").groupBy(*PAIR).agg(F.count("*").alias("c")).join(n, "entity").select(*PAIR, (F.col("c") / F.col("n")).alias("support"))
    rows = own.join(terms, "signature").agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_task))
    lists = said.groupBy("signature").agg(F.collect_list("term").alias("terms"))
    dealt = own.join(n, "entity").repartition(parts, "entity").join(F.broadcast(lists), "signature")
    return dealt.select("entity", "n", F.explode("terms").alias("term")).groupBy("entity", "n", "term").agg(F.count("*").alias("c")).select(*PAIR, (F.col("c") / F.col("n")).alias("support"))


def network_features(edges: DataFrame, weight: str, high: float, annotated: DataFrame) -> DataFrame:
    """Per node: degree, edges of at least `high`, and partners that are annotated(entity)."""
    both = edges.select("a", "b", weight).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), weight)).where("a <> b").groupBy("a", "b").agg(F.max(weight).alias("w"))
    marked = both.join(annotated.select(F.col("entity").alias("b")).distinct().withColumn("y", F.lit(1)), "b", "left")
    return marked.groupBy(F.col("a").alias("entity")).agg(F.count("*").alias("degree"), F.sum((F.col("w") >= high).cast("int")).alias("strong"), F.sum(F.coalesce("y", F.lit(0))).alias("annotated"))


def two_hop(known: DataFrame, links: DataFrame) -> DataFrame:
    """links(a, b, weight), one way each: a step from the known terms, then a row-normalised step; (entity, term, score)."""
    both = links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).where("weight > 0")
    total = both.groupBy("a").agg(F.sum("weight").alias("all_"))
    step = both.join(total, "a").select("a", "b", (F.col("weight") / F.col("all_")).alias("p"))
    one = known.select("entity", F.col("term").alias("a")).join(both, "a").groupBy("entity", F.col("b").alias("a")).agg(F.sum("weight").alias("s"))
    return one.join(step, "a").groupBy("entity", F.col("b").alias("term")).agg(F.sum(F.col("s") * F.col("p")).alias("score"))


def align(predictions: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the prediction of the same pair; raises where predictions name a pair twice."""
    twice = predictions.groupBy(*PAIR).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("predictions name some pair twice")
    return rows.join(predictions.select(*PAIR, F.col("score").alias("predicted")), PAIR, "left")
