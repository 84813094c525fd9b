"""Sources: manifests, pools of datasets, prediction and truth files, ontology and sequence files, JSON features, vectors.

All are Spark reads: paths may be globs and any store that Spark reads. Malformed lines are dropped or raise, as stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = """schema_version int, name string, k int, embedding_config_id string, ontology_snapshot_id string, annotation_source string, train_snapshot_pairs array<string>,
eval_snapshot_pair string, schema_sha string, n_train_rows bigint, n_eval_rows bigint, format string, producer_version string, producer_git_sha string"""
REQUIRED = ("schema_version", "name", "k", "train_snapshot_pairs", "eval_snapshot_pair", "schema_sha", "n_train_rows", "n_eval_rows", "format")


def manifests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row for each manifest.json, with the file's path and the names of keys that the schema doesn't know."""
    raw = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    known = F.array(*[F.lit(f.strip().split(" ")[0]) for f in MANIFEST.replace("\n", " ").split(",")])
    return raw.select("path", F.from_json("value", MANIFEST).alias("m"), F.array_except(F.json_object_keys("value"), known).alias("unknown_keys")).select("path", "m.*", "unknown_keys")


def manifest_errors(rows: DataFrame) -> DataFrame:
    """Adds errors: an ordered list of what is wrong with each manifest; empty if nothing."""
    pair = r"^v\d+-v\d+$"
    says: list[Column] = [F.when(F.col(c).isNull(), F.lit(f"missing: {c}")) for c in REQUIRED]
    says += [
        F.when(F.size("unknown_keys") > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort("unknown_keys"), ","))),
        F.when(F.col("k") < 1, F.lit("k below 1")), F.when((F.col("n_train_rows") < 0) | (F.col("n_eval_rows") < 0), F.lit("negative rows")),
        F.when(~F.col("schema_sha").rlike("^[0-9a-f]{12}([0-9a-f]{52})?$"), F.lit("schema_sha is no digest")),
        F.when(~F.col("eval_snapshot_pair").rlike(pair), F.lit("eval_snapshot_pair is no vA-vB")),
        F.when(F.exists("train_snapshot_pairs", lambda p: ~p.rlike(pair)), F.lit("a train_snapshot_pair is no vA-vB")),
        F.when(F.col("name").rlike("(?i)todo|placeholder|changeme"), F.lit("name is a placeholder")),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*says)))


def pool(sources: Mapping[tuple[str, int], DataFrame]) -> DataFrame:
    """Datasets under (plm_id, k_context) in one frame; columns that one lacks are null."""
    parts = [d.withColumns({"plm_id": F.lit(p), "k_context": F.lit(k)}) for (p, k), d in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def discover(spark: SparkSession, glob: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """(path, names...) of the files of a glob whose path matches the pattern's groups."""
    files = spark.read.format("binaryFile").load(glob).select("path")  # content is not read
    return files.where(F.col("path").rlike(pattern)).select("path", *[F.regexp_extract("path", pattern, k + 1).alias(n) for k, n in enumerate(names)])


def missing_sources(found: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(found, expected.columns, "left_anti")


def predictions(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(entity, term, score) of TSV files: lines without a finite score are dropped, the best of a pair is kept."""
    raw = spark.read.option("sep", "\t").option("header", header).option("mode", "PERMISSIVE").schema("entity string, term string, score string").csv(path)
    rows = raw.select(F.trim("entity").alias("entity"), F.trim("term").alias("term"), F.expr("try_cast(trim(score) as double)").alias("score"))
    return rows.where("entity <> '' and term <> '' and score is not null and not isnan(score)").groupBy("entity", "term").agg(F.max("score").alias("score"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (entity, term, aspect) of TSV files with two or three fields."""
    raw = spark.read.option("sep", "\t").schema("entity string, term string, aspect string").csv(path)
    return raw.where("entity is not null and term is not null").distinct()


def ontology_stanzas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes(term, name, aspect), edges(child, parent), aliases(alt, term)) of a stanza file: is_a and part_of edges, obsolete
    terms dropped. Stanzas are records of the read, so a large file is read in parallel where Spark can cut it."""
    text = spark.read.option("lineSep", "\n[").text(path).where("value like 'Term]%'")
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name}: ([^\n]*)$", 1)
    every = lambda p: F.expr(f"regexp_extract_all(value, r'{p}', 1)")
    live = text.where("not value rlike r'(?m)^is_obsolete: true'").select(field("id").alias("term"), field("name").alias("name"), field("namespace").alias("aspect"), F.concat(every(r"(?m)^is_a: (\S+)"), every(r"(?m)^relationship: part_of (\S+)")).alias("parents"), every(r"(?m)^alt_id: (\S+)").alias("alts"))
    live = live.where("term <> ''")
    edges = live.select(F.col("term").alias("child"), F.explode(F.array_distinct("parents")).alias("parent"))
    return live.select("term", "name", "aspect"), edges.join(live.select(F.col("term").alias("parent")), "parent", "left_semi").select("child", "parent"), live.select(F.explode("alts").alias("alt"), "term")


def parent_map(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a JSON object child -> list of parents."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("child", "parents")).select("child", F.explode("parents").alias("parent"))


def term_weights(spark: SparkSession, path: str) -> DataFrame:
    """(term, ia) of two-column TSV: negative and non-finite weights are 0, lines without a number are dropped."""
    raw = spark.read.option("sep", "\t").schema("term string, ia string").csv(path).select("term", F.expr("try_cast(trim(ia) as double)").alias("ia"))
    return raw.where("term is not null and ia is not null").select("term", F.when(F.isnan("ia") | (F.col("ia") < 0) | (F.col("ia") == float("inf")), 0.0).otherwise(F.col("ia")).alias("ia"))


def run_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Run records below a folder: malformed files raise, or are dropped."""
    schema = "run_id string, axis struct<plm:string,k:string,reranker:string,features:string,eval_set:string>, cell string, fmax_samples array<double>, fmax_point double, baseline_fmax_samples array<double>, baseline_fmax_point double, _bad string"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("run_id is not null").drop("_bad")


def annotation_corpus(annotations: DataFrame, terms: DataFrame, entities: DataFrame, evidence: Sequence[str]) -> DataFrame:
    """Distinct (entity, term, aspect) with accepted evidence, not negated, of live terms and known entities."""
    kept = annotations.where(F.col("evidence").isin(list(evidence)) & ~F.coalesce(F.col("qualifier"), F.lit("")).ilike("NOT%"))
    return kept.join(terms.where("not obsolete").select("term", "aspect"), "term").join(entities.select("entity"), "entity", "left_semi").select("entity", "term", "aspect").distinct()


def parse_vectors(rows: DataFrame, text: str) -> DataFrame:
    """A text literal such as [1, 2.5] as array<float>; anything else is null."""
    return rows.withColumn("vector", F.from_json(text, "array<float>"))


def mean_of_chunks(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    long = rows.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias(vector))  # as many as there are dimensions


def frozen_pool(rows: DataFrame, manifest: DataFrame, required: Sequence[str]) -> DataFrame:
    """rows(accession, role, embedding, leaves) if sound; raises on a missing provenance key, ragged vectors or references
    without leaves."""
    lacking = [k for k in required if k not in manifest.columns]
    if lacking:
        raise ValueError(f"the manifest lacks {', '.join(lacking)}")
    found = rows.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.sum(((F.col("role") == "reference") & (F.coalesce(F.size("leaves"), F.lit(0)) <= 0)).cast("int")).alias("bare")).first()
    if found.low != found.high:
        raise ValueError(f"vectors have between {found.low} and {found.high} components")
    if found.bare:
        raise ValueError(f"{found.bare} references have no leaves")
    return rows


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, sequence): the accession stands between bars, or is the first word of the header."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head, body = F.split("value", "\n", 2)[0], F.split("value", "\n", 2)[1]
    word = F.split(head, r"\s+")[0]
    return raw.select(F.when(word.contains("|"), F.split(word, r"\|")[1]).otherwise(word).alias("accession"), F.regexp_replace(body, r"\s+", "").alias("sequence"))


def promote_json(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """JSON keys as columns of doubles; rows that carry none of them are left out."""
    made = rows.withColumns({k: F.get_json_object(column, f"$.{k}").cast("double") for k in keys})
    return made.where(F.coalesce(*[F.col(k) for k in keys]).isNotNull())


def cross_references(spark: SparkSession, path: str, pattern: str = r"^([^:]+:\S+) .* ; (\S+)$") -> DataFrame:
    """(source, term) of a mapping file; comment lines have no match and are dropped."""
    raw = spark.read.text(path).where(F.col("value").rlike(pattern))
    return raw.select(F.regexp_extract("value", pattern, 1).alias("source"), F.regexp_extract("value", pattern, 2).alias("term"))


def edge_list(spark: SparkSession, path: str, targets: DataFrame, schema: str) -> DataFrame:
    """Edges (first two columns) of blank-separated, possibly gzipped files that touch a target(id)."""
    raw = spark.read.option("sep", " ").option("header", True).schema(schema).csv(path)
    a, b = raw.columns[:2]
    ids = targets.select(F.col("id").alias("id_")).distinct()
    hit = lambda c: raw.join(ids, raw[c] == ids.id_, "left_semi")
    return hit(a).unionByName(hit(b)).distinct()


def presence_profile(gene_entity: DataFrame, gene_group: DataFrame, group_taxon: DataFrame) -> DataFrame:
    """(entity, group, taxon), distinct, along gene -> entity, gene -> group, group -> taxon."""
    return gene_entity.join(gene_group, "gene").join(group_taxon, "group").select("entity", "group", "taxon").distinct()


def ranked(rows: DataFrame, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Each entity's best n rows by score, then term, then the columns `ties`."""
    return rows.withColumn("k_", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "term", *ties))).where(F.col("k_") <= n).drop("k_")
