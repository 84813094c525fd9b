"""Operators on an ontology graph given as edges (child, parent), and on scores (entity, term, score) over it.

Fixpoints iterate over all entities together, on DataFrames, and stop when a round changes nothing; only that figure
reaches the driver. Closures of one ontology are small against the candidates; joins leave the choice of a broadcast to
Spark, by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.steps import materialise


def ancestors(edges: DataFrame, reflexive: bool = True, nodes: DataFrame | None = None, max_depth: int = 200) -> DataFrame:
    """(term, ancestor): the transitive closure by doubling path lengths, so rounds grow with the log of the depth. A round
    joins and writes only what the last one found: a pair's shortest path of up to twice the length begins with one of it."""
    new = materialise(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct(), "reach")
    reach, rounds = new, 0
    while not new.isEmpty():
        rounds += 1
        if 2**rounds > 2 * max_depth:
            raise ValueError("the graph is deeper than max_depth, or has a cycle")
        further = new.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.term")).select(F.col("a.term").alias("term"), F.col("b.ancestor").alias("ancestor")).distinct()
        new = materialise(further.join(reach, ["term", "ancestor"], "left_anti"), "reach")
        reach = reach.unionByName(new)
    if reach.where("term = ancestor").limit(1).count():
        raise ValueError("the graph has a cycle")
    if not reflexive:
        return reach
    own = edges.select(F.col("child").alias("term")).unionByName(edges.select(F.col("parent").alias("term")))
    own = own if nodes is None else own.unionByName(nodes.select("term"))
    return reach.unionByName(own.distinct().select("term", F.col("term").alias("ancestor")))


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Terms without a parent."""
    return nodes.select("term").distinct().join(edges.select(F.col("child").alias("term")), "term", "left_anti")


def depths(edges: DataFrame, nodes: DataFrame, longest: bool = False, max_depth: int = 200) -> DataFrame:
    """(term, depth) from the roots, by the shortest or the longest path; level by level."""
    level = materialise(roots(edges, nodes).select("term", F.lit(0).alias("depth")), "level")
    out = level
    for d in range(1, max_depth + 1):
        level = materialise(level.select("term").join(edges, F.col("term") == F.col("parent")).select(F.col("child").alias("term"), F.lit(d).alias("depth")).distinct(), "level")
        if not longest:
            level = materialise(level.join(out.select("term").distinct(), "term", "left_anti"), "level")
        if not level.take(1):
            return out.groupBy("term").agg((F.max if longest else F.min)("depth").alias("depth"))
        out = out.unionByName(level)
    raise ValueError("the graph is deeper than max_depth, or has a cycle")


def entity_closure(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """annotations(entity, term) with every ancestor of every term."""
    return annotations.select("entity", "term").join(closure, "term").select("entity", F.col("ancestor").alias("term")).distinct()


def fill_propagation(scores: DataFrame, closure: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """Every ancestor gets the largest score below it, absent ancestors included; terms in drop (roots) go."""
    filled = scores.select("entity", "term", "score").join(closure, "term").groupBy("entity", F.col("ancestor").alias("term")).agg(F.max("score").alias("score"))
    return filled if drop is None else filled.join(drop.select("term"), "term", "left_anti")


def label_propagation(rows: DataFrame, closure: DataFrame) -> DataFrame:
    """rows(entity, term, label, ...): a row is positive too if a descendant of its term is positive for its entity; adds
    promoted (0/1). No row is created."""
    up = rows.where("label = 1").select("entity", "term").distinct().join(closure, "term").select("entity", F.col("ancestor").alias("term")).distinct().withColumn("below", F.lit(1))
    joined = rows.join(up, ["entity", "term"], "left")
    return joined.withColumn("promoted", F.when((F.col("label") == 0) & F.col("below").isNotNull(), 1).otherwise(0)).withColumn("label", F.greatest("label", F.coalesce("below", F.lit(0)))).drop("below")


def consistency(scores: DataFrame, edges: DataFrame, max_passes: int = 200) -> tuple[DataFrame, int]:
    """A parent's score is raised to its largest child's, along edges whose both ends an entity has, until nothing changes.
    Returns the scores and the number of rounds that raised something; more than max_passes of them are an error.

    A round looks only at what the last one raised, and writes only what it raises itself; the scores as given are written
    once, beside the edges that an entity has, and meet the raised ones at the end."""
    given = materialise(scores.select("entity", "term", "score"), "scores")
    child, parent = given.toDF("entity", "child", "low"), given.toDF("entity", "parent", "high")
    pairs = materialise(child.join(edges, "child").join(parent, ["entity", "parent"]).select("entity", "child", "parent", "low", "high"), "induced")
    last = materialise(pairs.where("low > high").groupBy("entity", F.col("parent").alias("term")).agg(F.max("low").alias("score")), "raised")
    raised, rounds = last, 0
    while not last.isEmpty():
        rounds += 1
        if rounds > max_passes:
            raise ArithmeticError(f"scores still rise after {max_passes} rounds; the graph is deeper than that, or has a cycle")
        up = last.join(pairs.withColumnRenamed("child", "term"), ["entity", "term"]).where(F.col("score") > F.col("high")).groupBy("entity", F.col("parent").alias("term")).agg(F.max("score").alias("score"))
        held = raised.toDF("entity", "term", "held")
        last = materialise(up.join(held, ["entity", "term"], "left").where("held is null or score > held").select("entity", "term", "score"), "raised")
        raised = materialise(raised.unionByName(last).groupBy("entity", "term").agg(F.max("score").alias("score")), "raised")
    best = raised.toDF("entity", "term", "up_")
    return given.join(best, ["entity", "term"], "left").select("entity", "term", F.greatest("score", F.coalesce("up_", "score")).alias("score")), rounds


def violations(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(checked, violated): present edges, and those whose child scores above its parent."""
    child = scores.select("entity", F.col("term").alias("child"), F.col("score").alias("below"))
    parent = scores.select("entity", F.col("term").alias("parent"), F.col("score").alias("above"))
    met = child.join(edges, "child").join(parent, ["entity", "parent"])
    return met.agg(F.count("*").alias("checked"), F.coalesce(F.sum((F.col("below") > F.col("above")).cast("long")), F.lit(0)).alias("violated"))


def soft_propagation(scores: DataFrame, edges: DataFrame, weight: float = 0.7) -> DataFrame:
    """weight * (largest score at or below) + (1 - weight) * (least score at or above), over present terms, made consistent."""
    up, _ = consistency(scores, edges)
    mirrored = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    down, _ = consistency(scores.withColumn("score", -F.col("score")), mirrored)
    mixed = up.join(down.withColumnRenamed("score", "low"), ["entity", "term"]).select("entity", "term", (weight * F.col("score") - (1 - weight) * F.col("low")).alias("score"))
    return consistency(mixed, edges)[0]


def recursive_soft_propagation(scores: DataFrame, edges: DataFrame, nodes: DataFrame, closure: DataFrame, weight: float = 0.7) -> DataFrame:
    """Both directions of weight * neighbours + (1 - weight) * own over an entity's terms and all their ancestors (0 where not
    scored), averaged: from the roots down the least of the parents' results, from the leaves up the largest of the
    children's. Level by level of the longest path from a root, all entities together."""
    own = scores.select("entity", "term", "score")
    every = own.join(closure, "term").select("entity", F.col("ancestor").alias("term")).distinct().join(own, ["entity", "term"], "left").join(depths(edges, nodes, longest=True), "term")
    every = materialise(every.select("entity", "term", F.coalesce("score", F.lit(0.0)).alias("score"), "depth"), "levels")
    last = every.agg(F.max("depth")).first()[0] or 0
    steps = {"low": (range(last + 1), "child", "parent", F.min), "high": (range(last, -1, -1), "parent", "child", F.max)}
    out = every.select("entity", "term")
    for name, (levels, here, there, best) in steps.items():
        done = None
        for d in levels:
            level = every.where(F.col("depth") == d).select("entity", "term", "score")
            if done is not None:
                near = level.select("entity", "term").join(edges, F.col("term") == F.col(here)).join(done.select("entity", F.col("term").alias(there), F.col("s").alias("p")), ["entity", there])
                level = level.join(near.groupBy("entity", "term").agg(best("p").alias("p")), ["entity", "term"], "left")
                level = level.withColumn("score", F.when(F.col("p").isNull(), F.col("score")).otherwise(weight * F.col("p") + (1 - weight) * F.col("score"))).drop("p")
            level = materialise(level.withColumnRenamed("score", "s"), name)
            done = level if done is None else done.unionByName(level)
        if done is None:
            return own
        out = out.join(done.withColumnRenamed("s", name), ["entity", "term"])
    return out.join(own.select("entity", "term"), ["entity", "term"], "left_semi").select("entity", "term", ((F.col("low") + F.col("high")) / 2).alias("score"))


def training_mask(rows: DataFrame, edges: DataFrame, signal: str = "label", threshold: float = 0.0) -> DataFrame:
    """Adds trainable: the term has no present parent, or some present parent's signal is above the threshold."""
    above = rows.select("entity", F.col("term").alias("parent"), F.col(signal).alias("s")).groupBy("entity", "parent").agg(F.max("s").alias("s"))
    best = rows.select("entity", "term").distinct().join(edges, F.col("term") == F.col("child")).join(above, ["entity", "parent"]).groupBy("entity", "term").agg(F.max("s").alias("s"))
    return rows.join(best, ["entity", "term"], "left").withColumn("trainable", F.col("s").isNull() | (F.col("s") > threshold)).drop("s")


def marginals(conditionals: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """P(t) = P(t | parents) * (1 - product over present parents of (1 - P(parent))), from the roots down."""
    depth = depths(edges, nodes, longest=True)
    rows = materialise(conditionals.select("entity", "term", "score").join(depth, "term"), "levels")
    last = rows.agg(F.max("depth")).first()[0] or 0
    done = materialise(rows.where("depth = 0").select("entity", "term", "score"), "done")
    for d in range(1, last + 1):
        level = rows.where(F.col("depth") == d)
        parents = level.select("entity", "term").join(edges, F.col("term") == F.col("child")).join(done.select("entity", F.col("term").alias("parent"), F.col("score").alias("p")), ["entity", "parent"])
        any_ = parents.groupBy("entity", "term").agg((1 - F.product(1 - F.col("p"))).alias("any"))
        done = materialise(done.unionByName(level.join(any_, ["entity", "term"], "left").select("entity", "term", (F.col("score") * F.coalesce("any", F.lit(1.0))).alias("score"))), "done")
    return done


def descendant_prior(rows: DataFrame, known: DataFrame, closure: DataFrame) -> DataFrame:
    """Adds below_known: the candidate is a strict descendant of a known term; candidates that are known go."""
    fresh = rows.join(known.select("entity", "term"), ["entity", "term"], "left_anti")
    up = fresh.select("entity", "term").distinct().join(closure.where("term <> ancestor"), "term")
    hit = up.join(known.select("entity", F.col("term").alias("ancestor")), ["entity", "ancestor"], "left_semi").select("entity", "term").distinct().withColumn("below_known", F.lit(1))
    return fresh.join(hit, ["entity", "term"], "left").withColumn("below_known", F.coalesce("below_known", F.lit(0)))


def dag_proximity(rows: DataFrame, known: DataFrame, closure: DataFrame) -> DataFrame:
    """Adds proximity: Jaccard of the candidate's ancestors with the union of the ancestors of the entity's known terms."""
    union = entity_closure(known, closure)
    sizes = union.groupBy("entity").agg(F.count("*").alias("n_known"))
    own = closure.groupBy("term").agg(F.count("*").alias("n_own"))
    pairs = rows.select("entity", "term").distinct()
    both = pairs.join(closure, "term").join(union.select("entity", F.col("term").alias("ancestor")), ["entity", "ancestor"]).groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    scored = pairs.join(own, "term", "left").join(sizes, "entity", "left").join(both, ["entity", "term"], "left").fillna(0, ["n_own", "n_known", "n_both"])
    joined = F.col("n_own") + F.col("n_known") - F.col("n_both")
    return rows.join(scored.select("entity", "term", F.when(joined > 0, F.col("n_both") / joined).otherwise(0.0).alias("proximity")), ["entity", "term"], "left")


def descend(scores: DataFrame, edges: DataFrame, threshold: float, levels: int) -> DataFrame:
    """(entity, term, score, k): terms up to `levels` below those that pass, with the passing term's score, not in the pool."""
    front = scores.where(F.col("score") >= threshold).select("entity", "term", "score")
    out = None
    for k in range(1, levels + 1):
        front = front.join(edges, F.col("term") == F.col("parent")).groupBy("entity", F.col("child").alias("term")).agg(F.max("score").alias("score"))
        part = front.withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("entity", "term").agg(F.max("score").alias("score"), F.min("k").alias("k"))
    return best.join(scores.select("entity", "term"), ["entity", "term"], "left_anti")


def induced_edges(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Edges whose both ends are in vocabulary(term)."""
    terms = vocabulary.select("term").distinct()
    return edges.join(terms, edges.child == terms.term, "left_semi").join(terms, edges.parent == terms.term, "left_semi")


def _present_above(scores: DataFrame, relation: DataFrame, low: str, high: str) -> DataFrame:
    return scores.select("entity", "term").join(relation, F.col("term") == F.col(low)).join(scores.select("entity", F.col("term").alias(high), F.col("score").alias("above")), ["entity", high])


def smooth(scores: DataFrame, closure: DataFrame, alpha: float = 0.7) -> DataFrame:
    """alpha * score + (1 - alpha) * mean of the present strict ancestors' scores; alone, a score stays."""
    strict = closure.where("term <> ancestor").withColumnRenamed("term", "low")
    mean = _present_above(scores, strict, "low", "ancestor").groupBy("entity", "term").agg(F.avg("above").alias("m"))
    return scores.join(mean, ["entity", "term"], "left").withColumn("score", F.when(F.col("m").isNull(), F.col("score")).otherwise(alpha * F.col("score") + (1 - alpha) * F.col("m"))).drop("m")


def cap_downward(scores: DataFrame, closure: DataFrame) -> DataFrame:
    """A score is at most the least score among the present strict ancestors; one pass over the original scores."""
    strict = closure.where("term <> ancestor").withColumnRenamed("term", "low")
    least = _present_above(scores, strict, "low", "ancestor").groupBy("entity", "term").agg(F.min("above").alias("m"))
    return scores.join(least, ["entity", "term"], "left").withColumn("score", F.least("score", F.coalesce("m", "score"))).drop("m")


def parent_factor(scores: DataFrame, edges: DataFrame, beta: float = 0.5) -> DataFrame:
    """score * (mean of the present parents' scores) ** beta; without a present parent a score stays."""
    mean = _present_above(scores, edges, "child", "parent").groupBy("entity", "term").agg(F.avg("above").alias("m"))
    return scores.join(mean, ["entity", "term"], "left").withColumn("score", F.when(F.col("m").isNull(), F.col("score")).otherwise(F.col("score") * F.pow("m", F.lit(beta)))).drop("m")


def information_content(closed: DataFrame, aspects: DataFrame | None = None) -> DataFrame:
    """closed(entity, term), closed upward -> (term, n, ic): -ln of the term's share of its root's entities. An aspect's root is
    its most frequent term; aspects(term, aspect) tells them apart, without it all terms are one aspect."""
    return content(closed.groupBy("term").agg(F.countDistinct("entity").alias("n")), aspects)


def content(n: DataFrame, aspects: DataFrame | None = None) -> DataFrame:
    """information_content() of terms that are counted already, n(term, n)."""
    n = n.withColumn("aspect_", F.lit("")) if aspects is None else n.join(aspects.select("term", F.col("aspect").alias("aspect_")), "term")
    top = n.groupBy("aspect_").agg(F.max("n").alias("top"))
    return n.join(top, "aspect_").select("term", "n", F.when(F.col("n") >= F.col("top"), 0.0).otherwise(-F.log(F.col("n") / F.col("top"))).alias("ic"))


def candidate_recall(rows: DataFrame, closure: DataFrame, cell: str) -> DataFrame:
    """rows(cell, entity, term, label), one for each pair: (cell, rows, entities, positives, propagated, recall,
    recall_propagated): positives as given, and with labels carried up to every ancestor that is a candidate of the same
    entity and cell, each against all such positives, those among the candidates or not."""
    up = rows.where("label > 0").join(closure, "term").select(cell, "entity", F.col("ancestor").alias("term")).distinct()
    every = up.groupBy(cell).agg(F.count("*").alias("n_"))
    held = rows.join(up.withColumn("up_", F.lit(1)), [cell, "entity", "term"], "left")
    n = held.groupBy(cell).agg(F.count("*").alias("rows"), F.countDistinct("entity").alias("entities"), F.sum((F.col("label") > 0).cast("long")).alias("positives"), F.count("up_").alias("propagated"))
    n = n.join(every, cell, "left")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return n.select(cell, "rows", "entities", "positives", "propagated", share(F.col("positives"), F.col("positives")).alias("recall"), F.coalesce(share(F.col("propagated"), F.col("n_")), F.lit(0.0)).alias("recall_propagated"))


def information_accretion(closed: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, ia): -log2 of the entities with the term over those with all its parents; roots 0."""
    have = closed.select("entity", "term").distinct()
    n = have.groupBy("term").agg(F.count("*").alias("n"))
    parents = edges.groupBy("child").agg(F.count("*").alias("k"))
    all_ = have.join(edges, F.col("term") == F.col("parent")).groupBy("entity", "child").agg(F.count("*").alias("held")).join(parents, "child").where("held = k").groupBy(F.col("child").alias("term")).agg(F.count("*").alias("m"))
    return n.join(all_, "term", "left").select("term", F.when(F.col("m").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), -F.log2(F.col("n") / F.col("m")))).alias("ia"))
