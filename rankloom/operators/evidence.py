"""Slices, label arms and reports by kind of evidence over candidate tables (entity, term, score, label)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fusion import PAIR, noisy_or, union_streams
from .metrics import bin_of
from .staging import top_n


def gating_union(a: DataFrame, b: DataFrame, text: DataFrame, entities: DataFrame, truth: DataFrame) -> DataFrame:
    """The union of two streams with text(entity, term, text) scores (0 where absent), whether the entity has any text,
    the entity's own features, and a label from truth(entity, term)."""
    rows = union_streams({"a": a, "b": b}).select(*PAIR, "a", "b").join(text, PAIR, "left").withColumn("text", F.coalesce("text", F.lit(0.0)))
    rows = rows.withColumn("has_text", F.max((F.col("text") > 0).cast("int")).over(Window.partitionBy("entity")))
    return rows.join(entities, "entity", "left").join(truth.select(*PAIR).distinct().withColumn("y_", F.lit(1)), PAIR, "left").withColumn("label", F.coalesce("y_", F.lit(0))).drop("y_")


def check_bands(artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """artifacts(band, version, ...) with allowed: whether registry(band, versions) lists the version; a band that is not
    registered allows nothing."""
    return artifacts.join(registry.select("band", "versions"), "band", "left").withColumn("allowed", F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False))).drop("versions")


def require_bands(artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """artifacts, or an error that counts those of a foreign version."""
    foreign = check_bands(artifacts, registry).where(~F.col("allowed")).count()
    if foreign:
        raise ValueError(f"{foreign} artifacts have versions that their bands do not allow")
    return artifacts


def delta_slice(rows: DataFrame, delta: DataFrame, cell: str) -> DataFrame:
    """The candidates of entities that delta(entity, term) adds to, with truth: the label, or, in a cell without any
    positive, whether delta holds the pair."""
    mine = rows.join(delta.select("entity").distinct(), "entity", "left_semi")
    flag = mine.groupBy(cell).agg(F.max("label").alias("any_"))
    new = delta.select(*PAIR).distinct().withColumn("new_", F.lit(1))
    out = mine.join(flag, cell).join(new, PAIR, "left")
    return out.withColumn("truth", F.when(F.col("any_") == 1, F.col("label")).otherwise(F.coalesce("new_", F.lit(0)))).drop("any_", "new_")


def boosted_by_top(a: DataFrame, b: DataFrame, k: int, weight: float) -> DataFrame:
    """Noisy-or of a with each entity's k best terms of b only."""
    return noisy_or(a, top_n(b, k).select(*PAIR, "score"), weight)


def half_rows(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pairs(a_<c>, b_<c>): for each column how often the halves differ, are null and are zero, in percent."""
    kinds = ", ".join(f"'{c}', double(a_{c}), double(b_{c})" for c in columns)
    long = pairs.select(F.expr(f"stack({len(columns)}, {kinds}) as (feature, a, b)"))
    share = lambda x: F.avg(x.cast("double")) * 100
    return long.groupBy("feature").agg(
        share(~F.col("a").eqNullSafe(F.col("b"))).alias("differs"), share(F.col("a").isNull()).alias("a_null"), share(F.col("b").isNull()).alias("b_null"),
        share(F.coalesce(F.col("a") == 0, F.lit(False))).alias("a_zero"), share(F.coalesce(F.col("b") == 0, F.lit(False))).alias("b_zero"),
    ).where("differs > 0")


def tier_support(direct: DataFrame, closure: DataFrame) -> DataFrame:
    """direct(entity, term, bits) -> (entity, term, bits): tiers of evidence that support a term or anything below it."""
    return direct.join(closure, "term").groupBy("entity", F.col("ancestor").alias("term")).agg(F.bit_or("bits").alias("bits"))


def label_arms(positives: DataFrame, support: DataFrame, masks: Mapping[str, int]) -> DataFrame:
    """positives(entity, term) with one 0/1 column an arm: whether the support has a tier of the arm's mask."""
    rows = positives.select(*PAIR).distinct().join(support, PAIR, "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    return rows.select(*PAIR, *[(F.col("bits").bitwiseAND(F.lit(m)) != 0).cast("int").alias(n) for n, m in masks.items()])


def missed_mass(truth: DataFrame, pool: DataFrame, weights: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, n, missed, total): the weight of each tag's true pairs that the pool lacks; tags(term, tag)."""
    have = pool.select(*PAIR).distinct().withColumn("have_", F.lit(1))
    rows = truth.select(*PAIR).distinct().join(have, PAIR, "left").join(weights, "term", "left").join(tags, "term", "left")
    w = F.coalesce("ia", F.lit(0.0))
    return rows.groupBy(F.coalesce("tag", F.lit("none")).alias("tag")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("have_").isNull(), w).otherwise(0.0)).alias("missed"), F.sum(w).alias("total"))


def enriched(rows: DataFrame, terms: DataFrame, entities: DataFrame, entity: str = "entity") -> DataFrame:
    """rows with the columns of terms(term, ...), where they have such a term, and of entities(entity, ...) where these are known."""
    return rows.join(terms, "term").join(entities, entity, "left")


def term_evidence(annotations: DataFrame, strong: str, weak: str, share: float = 0.5) -> DataFrame:
    """annotations(entity, term, tier) -> (term, class, strong_share): which evidence carries a term: 'strong' or 'weak' from
    that share of its annotations on, strong first, else 'mixed'."""
    n = annotations.groupBy("term").agg(F.avg((F.col("tier") == strong).cast("double")).alias("strong_share"), F.avg((F.col("tier") == weak).cast("double")).alias("weak_share"))
    return n.select("term", F.when(F.col("strong_share") >= share, "strong").when(F.col("weak_share") >= share, "weak").otherwise("mixed").alias("class"), "strong_share")


def donor_evidence(targets: DataFrame, neighbours: DataFrame, annotations: DataFrame) -> DataFrame:
    """targets(entity, term), neighbours(query, reference, cosine), annotations(entity, term, tier): targets with donors, how
    many neighbours carry the term, and the best one's id and tier: the nearest, ties by the smaller id; null where no
    neighbour brings the term. A neighbour with several tiers for a term gives its first by name."""
    carried = annotations.groupBy(F.col("entity").alias("reference"), "term").agg(F.min("tier").alias("tier"))
    asked = targets.select(*PAIR).distinct()
    met = asked.join(neighbours.select(F.col("query").alias("entity"), "reference", "cosine"), "entity").join(carried, ["reference", "term"])
    best = met.groupBy(*PAIR).agg(F.count("*").alias("donors"), F.max_by(F.struct("reference", "tier"), F.struct("cosine", -F.col("reference"))).alias("d_"))
    return asked.join(best, PAIR, "left").select(*PAIR, F.coalesce("donors", F.lit(0)).cast("long").alias("donors"), F.col("d_.reference").alias("donor"), F.col("d_.tier").alias("tier"))


def mass_by_evidence(truth: DataFrame, delivered: DataFrame, pool: DataFrame, weights: DataFrame, classes: DataFrame) -> DataFrame:
    """(tag, class, n, mass, share): the weight of true pairs by what became of them (all 'true'; 'delivered' or 'missing'; in
    the pool, 'reachable', or not) and by the evidence of their terms, classes(term, class); share is of the tag's weight."""
    flag = lambda d, name: d.select(*PAIR).distinct().withColumn(name, F.lit(True))
    rows = truth.select(*PAIR).distinct().join(flag(delivered, "d_"), PAIR, "left").join(flag(pool, "p_"), PAIR, "left").join(weights.select("term", "ia"), "term", "left").join(classes.select("term", "class"), "term", "left")
    tags = F.array(F.lit("true"), F.when(F.col("d_"), "delivered").otherwise("missing"), F.when(F.col("p_"), "reachable").otherwise("unreachable"))
    per = rows.select(F.explode(tags).alias("tag"), F.coalesce("class", F.lit("absent")).alias("class"), F.coalesce("ia", F.lit(0.0)).alias("w")).groupBy("tag", "class").agg(F.count("*").alias("n"), F.sum("w").alias("mass"))
    whole = F.sum("mass").over(Window.partitionBy("tag"))  # a row a class
    return per.withColumn("share", F.when(whole > 0, F.col("mass") / whole).otherwise(0.0))


def donor_mass(found: DataFrame, weights: DataFrame) -> DataFrame:
    """donor_evidence() -> (tier, n, mass, share): the weight that each tier of best donors brought; 'none' where nobody did."""
    per = found.join(weights.select("term", "ia"), "term", "left").groupBy(F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"), F.sum(F.coalesce("ia", F.lit(0.0))).alias("mass"))
    whole = F.sum("mass").over(Window.partitionBy(F.lit(0)))  # a row a tier
    return per.withColumn("share", F.when(whole > 0, F.col("mass") / whole).otherwise(0.0))


def entity_evidence(truth: DataFrame, pool: DataFrame, annotations: DataFrame, strong: str) -> DataFrame:
    """(reach, entities, annotated, strong_share): entities with and without a true term that the pool lacks, how many have
    annotations, and the mean share of strong ones among theirs."""
    own = annotations.groupBy("entity").agg(F.avg((F.col("tier") == strong).cast("double")).alias("s_"))
    lacking = truth.select(*PAIR).distinct().join(pool.select(*PAIR).distinct().withColumn("p_", F.lit(1)), PAIR, "left").groupBy("entity").agg(F.max(F.col("p_").isNull()).alias("lacks"))
    return lacking.join(own, "entity", "left").groupBy(F.when(F.col("lacks"), "lacking").otherwise("full").alias("reach")).agg(F.count("*").alias("entities"), F.count("s_").alias("annotated"), F.avg("s_").alias("strong_share"))


def cell_fmax(rows: DataFrame, cell: str, score: str, thresholds: int = 50) -> DataFrame:
    """(cell, f): the best binary F of each cell over thresholds k / n."""
    bins = rows.groupBy(cell, bin_of(F.col(score), thresholds).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    w = Window.partitionBy(cell).orderBy(F.desc("bin"))  # one row for each threshold
    swept = bins.select(cell, F.sum("n").over(w).alias("n"), F.sum("y").over(w).alias("tp"), F.sum("y").over(Window.partitionBy(cell)).alias("all"))
    return swept.groupBy(cell).agg(F.max(F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n") + F.col("all"))).otherwise(0.0)).alias("f"))


def holdout_report(rows: DataFrame, cell: str, model: str, baseline: str, thresholds: int = 50) -> DataFrame:
    """(cell, rows, positives, model, baseline, delta) for each cell, and their means as cell 'mean'."""
    sizes = rows.groupBy(cell).agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("positives"))
    scored = sizes.join(cell_fmax(rows, cell, model, thresholds).withColumnRenamed("f", "model"), cell).join(cell_fmax(rows, cell, baseline, thresholds).withColumnRenamed("f", "baseline"), cell)
    scored = scored.select(F.col(cell).cast("string").alias("cell"), "rows", "positives", "model", "baseline", (F.col("model") - F.col("baseline")).alias("delta"))
    mean = scored.agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), *[F.avg(c).alias(c) for c in ("model", "baseline", "delta")])
    return scored.unionByName(mean.withColumn("cell", F.lit("mean")))


def band_report(rows: DataFrame, band: Column, value: str) -> DataFrame:
    """(band, entities, mean, low): per-entity means of a value, then their mean and least by the entity's band."""
    per = rows.groupBy("entity", band.alias("band")).agg(F.avg(value).alias("v"))
    return per.groupBy("band").agg(F.count("*").alias("entities"), F.avg("v").alias("mean"), F.min("v").alias("low"))


def partition_extras(pool: DataFrame, extras: DataFrame, closure: DataFrame, truth: DataFrame) -> DataFrame:
    """(arm, n, right): pairs of extras that the pool lacks, inside and outside the entity's pool closure, and how many are true."""
    reach = pool.select(*PAIR).join(closure, "term").select("entity", F.col("ancestor").alias("term")).distinct().withColumn("in_", F.lit(1))
    rows = extras.select(*PAIR).distinct().join(pool.select(*PAIR), PAIR, "left_anti").join(reach, PAIR, "left").join(truth.select(*PAIR).distinct().withColumn("y_", F.lit(1)), PAIR, "left")
    return rows.groupBy(F.when(F.col("in_") == 1, "inside").otherwise("outside").alias("arm")).agg(F.count("*").alias("n"), F.count("y_").alias("right"))


def text_coverage(rows: DataFrame, category: str, has_text: Column, date: str, cut: str) -> DataFrame:
    """(category, n, covered, before, latest): rows, those with text, those of them before the cut, and the last of them."""
    return rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.sum(has_text.cast("int")).cast("long").alias("covered"), F.sum((has_text & (F.col(date) < F.lit(cut).cast("timestamp"))).cast("int")).cast("long").alias("before"), F.max(F.when(has_text, F.col(date))).alias("latest"))


def date_tally(rows: DataFrame, category: str, has_text: Column, date: str, cuts: Mapping[str, str]) -> DataFrame:
    """(category, bucket, n): rows with text by the period of their date: before each cut in turn (its name), 'later', or
    'undated'. Cuts are in ascending order."""
    bucket = F.when(F.col(date).isNull(), "undated")
    for name, cut in cuts.items():
        bucket = bucket.when(F.col(date) < F.lit(cut).cast("timestamp_ntz"), name)
    return rows.where(has_text).groupBy(F.col(category).alias("category"), bucket.otherwise("later").alias("bucket")).agg(F.count("*").alias("n"))


def text_ranks(rows: DataFrame, score: str, text: str, tie: str = "term") -> DataFrame:
    """Adds has_text, percentile ranks of both scores within the entity (average ties), their gap, and whether the text
    score is among the entity's 1, 3 or 5 best; an entity without text gets zeros."""
    w = Window.partitionBy("entity")
    n = F.count("*").over(w)
    percentile = lambda c: (F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("entity", c)) - 1) / 2) / n
    out = rows.withColumns({"has_text": F.max((F.col(text) > 0).cast("int")).over(w), "tp_": percentile(text), "score_pct": percentile(score), "k_": F.row_number().over(w.orderBy(F.desc(text), tie))})
    has = F.col("has_text") == 1
    out = out.withColumns({"text_pct": F.when(has, F.col("tp_")).otherwise(0.0), "rank_gap": F.when(has, F.col("tp_") - F.col("score_pct")).otherwise(0.0)})
    return out.withColumns({f"top{k}": (has & (F.col("k_") <= k)).cast("int") for k in (1, 3, 5)}).drop("tp_", "k_")


def option_scores(predictions: DataFrame, truth: DataFrame, weights: DataFrame, groups: DataFrame, terms: DataFrame | None = None, known: DataFrame | None = None, thresholds: int = 50) -> DataFrame:
    """(grp, f): the best pooled weighted F of each group(term, grp), over terms of interest only and without pairs that
    are known, at a fixed step; a row 'mean' averages the groups."""
    for part in (terms,) if terms is not None else ():
        predictions, truth = predictions.join(part.select("term"), "term", "left_semi"), truth.join(part.select("term"), "term", "left_semi")
    for part in (known,) if known is not None else ():
        predictions, truth = predictions.join(part.select(*PAIR), PAIR, "left_anti"), truth.join(part.select(*PAIR), PAIR, "left_anti")
    true = truth.select(*PAIR).distinct().withColumn("y_", F.lit(1))
    own = weights.join(groups, "term").select("term", "grp", "ia")
    rows = predictions.select(*PAIR, "score").join(true, PAIR, "left").join(own, "term")
    bins = rows.groupBy("grp", bin_of(F.col("score"), thresholds).alias("bin")).agg(F.sum("ia").alias("n"), F.sum(F.when(F.col("y_") == 1, F.col("ia")).otherwise(0.0)).alias("tp"))
    return best_options(bins, true.join(own, "term").groupBy("grp").agg(F.sum("ia").alias("wanted")))


def best_options(bins: DataFrame, wanted: DataFrame) -> DataFrame:
    """option_scores() of bins(grp, bin, n, tp) and wanted(grp, wanted)."""
    w = Window.partitionBy("grp").orderBy(F.desc("bin"))  # one row for each threshold
    swept = bins.withColumns({"n": F.sum("n").over(w), "tp": F.sum("tp").over(w)}).join(wanted, "grp")
    best = swept.groupBy("grp").agg(F.max(F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n") + F.col("wanted"))).otherwise(0.0)).alias("f"))
    return best.unionByName(best.agg(F.avg("f").alias("f")).withColumn("grp", F.lit("mean")))
