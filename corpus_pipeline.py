"""The corpus pipeline: documents pass a quality classifier, line deduplication, near-duplicate removal and benchmark
decontamination, and are then encoded and decoded by byte-level BPE. Each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from rankloom.llm import bpe, decontaminate, linededup, nearcopies, quality
from rankloom.llm.common import materialise, read, temp_name

#: Ids below this leave room for numbers above them.
ROOM = 1 << 61


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: later repeated runs of lines go from the texts; n_chars follows."""
    clean = linededup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def _numbered(docs: DataFrame, own: str) -> DataFrame:
    """docs with an id in the column own for each row with a doc_id. The doc_id itself where no other row has it, so that
    only rows of repeated ids are written anew, with numbers above all ids; all rows where ids leave no room for that."""
    if isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        with_id = docs.where("doc_id is not null")
        most = with_id.agg(F.max("doc_id")).first()[0]
        again = materialise(with_id.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
        if again.isEmpty():
            return with_id.withColumn(own, F.col("doc_id").cast("long"))
        if most < ROOM:
            several = materialise(with_id.join(again, "doc_id", "left_semi").select(*docs.columns).withColumn(own, F.monotonically_increasing_id() + F.lit(most + 1)), "rows")
            return with_id.join(again, "doc_id", "left_anti").select(*docs.columns).withColumn(own, F.col("doc_id").cast("long")).unionByName(several)
    return materialise(docs.where("doc_id is not null").withColumn(own, F.monotonically_increasing_id()), "rows")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1's job at the stage's own settings, five-word shingles and a similarity of 0.8: SimHash's links, checked on the
    texts, and the pairs beyond its 3 bits by prefixes. Of each group of near duplicates the row with the least id stays, one row also where ids repeat; so do documents without an id. Texts that
    line deduplication left empty count as copies of one another."""
    own = temp_name(docs, "row")
    with_id = _numbered(docs, own)
    kept = nearcopies.least_of_groups(with_id.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("rank"), F.col("text").cast("binary").alias("t")))
    return with_id.join(kept.withColumnRenamed("row", own), own, "left_semi").unionByName(docs.where("doc_id is null").withColumn(own, F.lit(None).cast("long"))).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document with its token ids and the text that they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: The classifier, the hashes and the merges are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
