"""Mixing sources to target weights by a low-discrepancy schedule.

Sources, in order of code points with null last, take the weights of a cycle in turn and share `share` times all words in
proportion; a source's target stops at `most` times its own words, and what it can't take is shared by the others in the
same proportion until no target is above its bound.

The mix is a sequence of slots of `block` words. Slot k's point is k times the golden ratio, modulo 1 (32 bits, integers
alone); the targets laid end to end are cut by it, so any stretch of slots holds every source in nearly its share. A source's
slots are ranked in their order. Its documents, in the order of a hash of their ids, lie end to end as one sequence of words,
`most` times over, cut into equal blocks; the slot of rank r takes block r. A reader that needs words in the mix's order sorts
the pieces by slot and place.

Block size: where not given, the largest power of two, 2,048 at most, that makes 65,536 slots or more (one word in the least
case), so that a source's words meet its target to within some blocks: a few ten-thousandths of it.

Scale: places and ranks are running sums dealt by range, over (source, hash) and (source, slot), so a source of a third of
all rows is many ranges. Points meet targets in 65,536 cells of the unit interval, which points fill evenly. Blocks meet slots
on (source, rank), all distinct. The targets' level takes a few sums over the table of sources (one row each in the driver).

Defined cases: null and blank texts have no words and are taken 0 times; null sources are one source, the last; repeated rows
are mixed each for itself; rows that agree in source and id lie side by side, in order of text hash; an empty table, or one
without a word, gives targets of 0; extra columns are ignored. Everything depends on ids and texts alone, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.steps import before

from .common import materialise

WEIGHTS, SHARE, MOST, SLOTS, LARGEST = (3, 1, 2), 1.5, 2, 65_536, 2_048
_GOLDEN = 2_654_435_769  # 2 ** 32 over the golden ratio
_SCALE = 31  # bits of a share


def word_counts(docs: DataFrame, id_: str, text: str, source: str) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col(id_).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(text).alias("text_hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, number, source_size, weight, target): number counts sources in their order from 0."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = before(sources.withColumns({"order": F.struct(F.col("source").isNull(), "source"), "one": F.lit(1)}), "order", "one", "number")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialise(sources.select("source", F.col("number").cast("long"), "source_size", F.get(cycle, (F.col("number") % len(weights)).cast("int")).alias("weight")), "sources")
    bound = F.col("source_size") * float(most)
    level, full = 0.0, -1
    while True:
        stopped = bound <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum("source_size").alias("words"), F.sum(F.when(~stopped, F.col("weight"))).alias("w"), F.sum(F.when(stopped, bound)).alias("taken"), F.count_if(stopped).alias("full")).first()
        if not row.words or row.w is None or row.full == full:
            break
        level, full = (share * row.words - (row.taken or 0.0)) / row.w, row.full
    return sources.withColumn("target", F.least(bound, F.lit(level) * F.col("weight")))


def golden(k: Column) -> Column:
    """k times the golden ratio modulo 1, in 32 bits; no product leaves a long."""
    low, high = k.bitwiseAND(0xFFFF), F.shiftright(k, 16).bitwiseAND(0xFFFF)
    return (low * F.lit(_GOLDEN) + (high * F.lit(_GOLDEN)).bitwiseAND(0xFFFF) * 65_536).bitwiseAND(0xFFFFFFFF)


def block_size(words: int, slots: int = SLOTS, largest: int = LARGEST) -> int:
    """The largest power of two up to `largest` that makes `slots` slots of so many words, or 1."""
    size = 1
    while size * 2 <= largest and words >= size * 2 * slots:
        size *= 2
    return size


def schedule(sources: DataFrame, words: int, block: int) -> tuple[DataFrame, DataFrame]:
    """((slot, number, rank), (number, n_slots)): the source of each slot, and its place among that source's slots."""
    spark = sources.sparkSession
    shares = sources.where("target > 0").select("number", F.round(F.col("target") / F.lit(float(words)) * float(1 << _SCALE)).cast("long").alias("part")).where("part > 0")
    cut = materialise(before(shares, "number", "part", "lo").withColumn("hi", F.col("lo") + F.col("part")), "cut")
    whole = cut.agg(F.max("hi")).first()[0] or 0
    cells = cut.select("number", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 15), F.shiftright(F.col("hi") - 1, 15))).alias("cell"))
    points = spark.range(-(-words // block) if whole else 0).select(F.col("id").alias("slot"), F.shiftright(F.shiftright(golden(F.col("id")), 1) * F.lit(whole), _SCALE).alias("y"))
    dealt = points.withColumn("cell", F.shiftright("y", 15)).join(cells, "cell").where("lo <= y and y < hi")
    dealt = dealt.select(F.struct("number", "slot").alias("order"), F.lit(1).cast("long").alias("one"))
    ranked = before(dealt, "order", "one", "ahead").select("order.number", "order.slot", "ahead")
    ranked = materialise(ranked, "ranked")
    counts = materialise(ranked.groupBy("number").agg(F.count("*").alias("n_slots"), F.min("ahead").alias("first")), "counts")
    return ranked.join(counts, "number").select("slot", "number", (F.col("ahead") - F.col("first")).alias("rank")), counts.select("number", "n_slots")


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their source's number and target, and `start`, where they begin in its sequence of words."""
    known = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "source_size", "target", "number", F.struct("number", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffled"), "doc_id", "text_hash", "size").alias("order"))
    begins = before(sources.select("number", "source_size"), "number", "source_size", "begin").select("number", "begin")
    rows = before(known, "order", "size", "ahead").join(begins, "number")
    return materialise(rows.select("doc_id", "size", "source_size", "target", "number", (F.col("ahead") - F.col("begin")).alias("start")), "placed")


def mixture(rows: DataFrame, slots: DataFrame, counts: DataFrame, block: int, most: int = MOST) -> DataFrame:
    """(slot, number, start, doc_id, first_word, n_words): the pieces of documents that each slot is made of, from placed()
    and schedule(); sorted by slot, copy and start they are the mix."""
    at = F.col("start") + F.col("copy") * F.col("source_size")
    copies = rows.where("size > 0").join(counts, "number").select("*", F.explode(F.array(*[F.lit(i).cast("long") for i in range(most)])).alias("copy")).withColumn("at", at)
    last = F.least(F.floor((F.col("at") + F.col("size") - 1) / block).cast("long"), F.col("n_slots") - 1)
    pieces = copies.withColumn("from", F.floor(F.col("at") / block).cast("long")).where(F.col("from") <= last).withColumn("rank", F.explode(F.sequence(F.col("from"), last)))
    begin, end = F.greatest(F.col("rank") * block, F.col("at")), F.least((F.col("rank") + 1) * block, F.col("at") + F.col("size"))
    pieces = pieces.select("number", "rank", "copy", "start", "doc_id", (begin - F.col("at")).alias("first_word"), (end - begin).alias("n_words"))
    return pieces.join(slots, ["number", "rank"])


def mix(docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with sizes, targets and places; pieces of the mix)."""
    sizes = materialise(word_counts(docs, id_, text, source), "sizes")
    sources = materialise(targets(sizes, weights, share, most), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    words = int(share * total)
    block = block or block_size(words)
    slots, counts = schedule(sources, words, block)
    rows = placed(sizes, sources)
    return rows, mixture(rows, slots, counts, block, most)


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs: the words of it that the mix holds."""
    rows, pieces = mix(docs, **options)
    held = pieces.groupBy("number", "start").agg(F.sum("n_words").alias("taken")).toDF("number2", "start2", "taken")
    joined = rows.join(held, (F.col("size") > 0) & (F.col("number") == F.col("number2")) & (F.col("start") == F.col("start2")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
