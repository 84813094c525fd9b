"""The given tables in the roles of the engine: candidates, attributes, ontology, vectors; as Spark frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import lifting, ontology


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: entity, term, stream, score, label, category, snapshot."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("term"), F.col("l_linenumber").alias("stream"), (F.col("l_quantity") / 50).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_linestatus").alias("category"), F.year("l_shipdate").alias("snapshot"), F.col("l_suppkey").alias("source"), (1 - F.col("l_discount") * 5).alias("score2"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acyclic graph with several parents a term: k has parents k div 2 and k div 3, down to the root 1."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"))
    return parts.where("child > 1").select("child", F.explode(F.array_distinct(F.expr("filter(array(child div 2, child div 3), x -> x >= 1)"))).alias("parent"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("term"))


def graph(spark: SparkSession, sf_dir: str) -> lifting.Graph | None:
    """The ontology for the tasks; None where it is too large for that."""
    return lifting.graph(edges(spark, sf_dir), nodes(spark, sf_dir))


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of positive pairs; a pair may stand more than once."""
    return candidates(spark, sf_dir).where("label = 1").select("entity", "term")


def accretion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, ia) over the positives."""
    g = graph(spark, sf_dir)
    if g is None:
        return ontology.information_accretion(ontology.entity_closure(positives(spark, sf_dir), closure(spark, sf_dir)), edges(spark, sf_dir))
    return lifting.information_accretion(positives(spark, sf_dir), g)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, n): entities with the term among their closed positives."""
    g = graph(spark, sf_dir)
    if g is None:
        return ontology.entity_closure(positives(spark, sf_dir), closure(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n"))
    return lifting.counts(positives(spark, sf_dir), g)


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e = graph(spark, sf_dir), edges(spark, sf_dir)
    if g is not None:
        return lifting.ancestors(g, nodes(spark, sf_dir).unionByName(e.select(F.col("child").alias("term"))).unionByName(e.select(F.col("parent").alias("term"))).distinct())
    return ontology.ancestors(edges(spark, sf_dir), reflexive=True, nodes=read(spark, sf_dir, "part").select(F.col("p_partkey").alias("term")))


CAND = """cand AS (SELECT l_orderkey AS entity, l_partkey AS term, l_linenumber AS stream, l_quantity / 50 AS score,
    CAST(l_returnflag = 'R' AS INTEGER) AS label, l_linestatus AS category, CAST(year(l_shipdate) AS INTEGER) AS snapshot, l_suppkey AS source, 1 - l_discount * 5 AS score2 FROM lineitem)"""
EDGES = """edges AS (SELECT DISTINCT p_partkey AS child, p_partkey // d AS parent FROM part, (VALUES (2), (3)) v(d) WHERE p_partkey > 1 AND p_partkey // d >= 1)"""
CLOSURE = f"""{EDGES}, closure AS (SELECT p_partkey AS term, p_partkey AS ancestor FROM part UNION SELECT c.term, e.parent FROM closure c JOIN edges e ON e.child = c.ancestor)"""
#: Collapsed candidates: the best score and any label of a pair.
PAIRS = f"""{CAND}, pairs AS (SELECT entity, term, max(score) AS score, max(label) AS label FROM cand GROUP BY ALL)"""


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("entity", "term").agg(F.max("score").alias("score"), F.max("label").alias("label"))
