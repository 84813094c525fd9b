"""Queries of sources and sinks: over the given tables, or over files that are first written from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankloom.functions.steps import shared_dir
from rankloom.sources import readers as A
from rankloom.sources import writers as W

from .registry import query
from .tables import CAND, EDGES, PAIRS, all_pairs, candidates, edges, read


@query(f"""WITH {CAND} SELECT entity, term, score, NULL::DOUBLE AS score2, 'a' AS plm_id, 3 AS k_context FROM cand WHERE stream <= 3 UNION ALL SELECT entity, term, NULL, score2, 'b', 5 FROM cand WHERE stream <= 5""")
def a05_pooled_scan(spark, sf):
    c = candidates(spark, sf)
    return A.pool({("a", 3): c.where("stream <= 3").select("entity", "term", "score"), ("b", 5): c.where("stream <= 5").select("entity", "term", "score2")})


@query("""SELECT DISTINCT l_suppkey AS entity, l_partkey AS term, p_brand AS aspect FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE l_returnflag IN ('R', 'A') AND NOT (l_linestatus ILIKE 'O%') AND NOT (p_size > 45) AND s_acctbal > 0""")
def a16_annotation_corpus(spark, sf):
    ann = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("term"), F.col("l_returnflag").alias("evidence"), F.when(F.col("l_linestatus") == "O", "NOT").alias("qualifier"))
    terms = read(spark, sf, "part").select(F.col("p_partkey").alias("term"), F.col("p_brand").alias("aspect"), (F.col("p_size") > 45).alias("obsolete"))
    entities = read(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"))
    return A.annotation_corpus(ann, terms, entities, ["R", "A"])


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM x GROUP BY ALL) SELECT label, round(max(m) FILTER (d = 1), 6) AS first, round(max(m) FILTER (d = 64), 6) AS last FROM m GROUP BY label""")
def a17_vectors_from_text(spark, sf):
    text = read(spark, sf, "embeddings").select("label", F.to_json("embedding").alias("text"))
    m = A.mean_of_chunks(A.parse_vectors(text, "text"), "label")
    return m.select("label", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(json_extract_string(props, '$.other') AS DOUBLE) AS other FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL OR json_extract_string(props, '$.other') IS NOT NULL")
def a20_promoted_keys(spark, sf):
    return A.promote_json(read(spark, sf, "events"), "props", ["k", "other"]).select("event_id", "k", "other")


@query("SELECT DISTINCT s_suppkey AS entity, c_nationkey AS \"group\", r_regionkey AS taxon FROM supplier JOIN customer ON s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def a23_presence_profile(spark, sf):
    genes = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("gene"))
    groups = read(spark, sf, "customer").select(F.col("c_nationkey").alias("gene"), F.col("c_nationkey").alias("group")).distinct()
    taxa = read(spark, sf, "nation").select(F.col("n_nationkey").alias("group"), F.col("n_regionkey").alias("taxon"))
    return A.presence_profile(genes, groups, taxa)


def _folder(spark) -> str:
    """A new folder beside the steps, for files that a query writes from its tables and reads again."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _manifests(spark, sf):
    """One manifest file for each year of the lines, some of them wrong."""
    n = candidates(spark, sf).groupBy("snapshot").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    year, odd = F.col("snapshot"), F.col("snapshot") % 3
    rows = n.select(
        year.alias("file"), F.lit(1).alias("schema_version"), F.concat(F.when(odd == 0, "todo-").otherwise("bench-"), year.cast("string")).alias("name"), F.when(odd == 1, 0).otherwise(5).alias("k"), F.array(F.format_string("v%d-v%d", year - 1, year)).alias("train_snapshot_pairs"),
        F.when(odd < 2, F.format_string("v%d-v%d", year, year + 1)).otherwise("next").alias("eval_snapshot_pair"), F.substring(F.sha2(year.cast("string"), 256), 1, 12).alias("schema_sha"), F.col("n").alias("n_train_rows"), F.col("y").alias("n_eval_rows"), F.when(odd > 0, "parquet").alias("format"), F.when(odd == 2, "?").alias("surprise"),
    )
    path = _folder(spark)
    rows.repartition("file").write.partitionBy("file").json(path)
    return A.manifests(spark, f"{path}/*/*.json")


_YEARS = f"""{CAND}, years AS (SELECT snapshot, snapshot % 3 AS odd, count(*) AS n, sum(label)::BIGINT AS y FROM cand GROUP BY ALL)"""


@query(f"WITH {_YEARS} SELECT CASE WHEN odd = 0 THEN 'todo-' ELSE 'bench-' END || snapshot AS name, CASE WHEN odd = 1 THEN 0 ELSE 5 END AS k, n AS n_train_rows, y AS n_eval_rows, 'v' || (snapshot - 1) || '-v' || snapshot AS train, CASE WHEN odd = 2 THEN 'surprise' ELSE '' END AS unknown FROM years")
def a04_manifests(spark, sf):
    return _manifests(spark, sf).select("name", "k", "n_train_rows", "n_eval_rows", F.array_join("train_snapshot_pairs", ",").alias("train"), F.array_join("unknown_keys", ",").alias("unknown"))


@query(f"WITH {_YEARS} SELECT CASE WHEN odd = 0 THEN 'todo-' ELSE 'bench-' END || snapshot AS name, CASE odd WHEN 0 THEN 'missing: format; name is a placeholder' WHEN 1 THEN 'k below 1' ELSE 'unknown: surprise; eval_snapshot_pair is no vA-vB' END AS errors FROM years")
def b14_manifest_errors(spark, sf):
    return A.manifest_errors(_manifests(spark, sf)).select("name", F.array_join("errors", "; ").alias("errors"))


@query(f"""WITH {CAND}, have AS (SELECT DISTINCT category AS plm, stream AS k FROM cand WHERE stream <= 4), want AS (SELECT p AS plm, k::INTEGER AS k FROM (VALUES ('F'), ('O'), ('X')) a(p), (SELECT unnest(range(1, 7)) AS k))
SELECT plm, k, true AS found FROM have UNION ALL SELECT plm, k, false FROM want ANTI JOIN have USING (plm, k)""")
def a06_discovered_sources(spark, sf):
    path = _folder(spark)
    candidates(spark, sf).where("stream <= 4").select(F.col("category").alias("plm"), F.col("stream").alias("k"), "entity", "term").repartition("plm", "k").write.partitionBy("plm", "k").parquet(path)
    found = A.discover(spark, f"{path}/*/*/*.parquet", r"plm=(\w+)/k=(\d+)/", ["plm", "k"]).select("plm", F.col("k").cast("int").alias("k")).distinct()
    want = spark.range(1, 7).select(F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("X"))).alias("plm"), F.col("id").cast("int").alias("k"))
    return found.withColumn("found", F.lit(True)).unionByName(A.missing_sources(found, want).withColumn("found", F.lit(False)))


@query(f"WITH {PAIRS} SELECT entity::VARCHAR AS entity, term::VARCHAR AS term, round(score, 6) AS score FROM pairs QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) <= 3")
def a07_prediction_file(spark, sf):
    path = _folder(spark)
    W.predictions_tsv(all_pairs(spark, sf), path, 3)
    return A.predictions(spark, path)


@query(f"WITH {CAND}, p AS (SELECT category, entity, term, max(score) AS score FROM cand GROUP BY ALL) SELECT category, entity, term, printf('%.6f', score) AS score FROM p QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) <= 2")
def a08_prediction_cells(spark, sf):
    path, pairs = _folder(spark), candidates(spark, sf).groupBy("category", "entity", "term").agg(F.max("score").alias("score"))
    W.predictions_tsv(pairs, path, 2, "category")
    back = spark.read.option("sep", "\t").schema("entity long, term long, score string, category string").csv(path)
    return back.select("category", "entity", "term", "score")


@query(f"WITH {CAND} SELECT DISTINCT entity::VARCHAR AS entity, term::VARCHAR AS term, category AS aspect FROM cand WHERE label = 1")
def a07_truth_file(spark, sf):
    path = _folder(spark)
    candidates(spark, sf).where("label = 1").select("entity", "term", "category").write.option("sep", "\t").csv(path)
    return A.truth(spark, path)


@query(f"WITH {CAND} SELECT entity, term, label, (SELECT count(*) FROM cand) AS n_train_rows FROM cand WHERE snapshot IN (1996, 1998)")
def a09_derived_dataset(spark, sf):
    path, rows = _folder(spark), candidates(spark, sf).withColumn("snapshot_pair", F.format_string("v%d-v%d", "snapshot", F.col("snapshot") + 1))
    W.dataset(rows, path, ["entity", "term", "label"], ["v1996-v1997", "v1998-v1999"], files=4, manifest={"name": "derived", "n_train_rows": rows.count()})
    told = spark.read.json(f"{path}/manifest.json").select("n_train_rows")  # one row
    return spark.read.parquet(f"{path}/train.parquet").crossJoin(F.broadcast(told))


@query(f"WITH {CAND} SELECT entity, label, score FROM cand")
def a11_predictions_parquet(spark, sf):
    path = _folder(spark)
    W.predictions_parquet(candidates(spark, sf), path)
    return spark.read.parquet(path)


def _stanzas(spark, sf):
    """The parts' graph as a stanza file: the even parent by is_a, the other by part_of; every seventeenth part is obsolete, and
    every fifth has another id."""
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")
    two, three = F.expr("k div 2"), F.expr("k div 3")
    line = lambda when, *text: F.when(when, F.concat(*text, F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit("\n[Term]\n"), F.concat(F.lit("id: T:"), F.col("k"), F.lit("\nname: "), "p_brand", F.lit("\nnamespace: n"), F.col("p_size") % 3, F.lit("\n")), line(F.col("k") % 5 == 0, F.lit("alt_id: A:"), F.col("k")), line(F.col("k") % 17 == 0, F.lit("is_obsolete: true")),
        line(two >= 1, F.lit("is_a: T:"), two, F.lit(" ! half")), line((three >= 1) & (three != two), F.lit("relationship: part_of T:"), three, F.lit(" ! third")),
    )
    path = _folder(spark)
    part.select(text.alias("value")).write.text(path)
    return A.ontology_stanzas(spark, path)


@query(f"WITH {EDGES} SELECT 'T:' || child AS child, 'T:' || parent AS parent FROM edges WHERE child % 17 <> 0 AND parent % 17 <> 0 AND parent IN (SELECT p_partkey FROM part)")
def a12_ontology_edges(spark, sf):
    return _stanzas(spark, sf)[1]


@query("SELECT 'T:' || p_partkey AS term, p_brand AS name, 'n' || (p_size % 3) AS aspect, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'A:' || p_partkey END, '') AS alt FROM part WHERE p_partkey % 17 <> 0")
def a12_ontology_terms(spark, sf):
    nodes, _, aliases = _stanzas(spark, sf)
    return nodes.join(aliases, "term", "left").select("term", "name", "aspect", F.coalesce("alt", F.lit("")).alias("alt"))


@query(f"WITH {EDGES} SELECT child::VARCHAR AS child, parent::VARCHAR AS parent FROM edges")
def a13_parent_map(spark, sf):
    path, e = _folder(spark), edges(spark, sf)
    lists = e.groupBy("child").agg(F.transform(F.array_sort(F.collect_list("parent")), lambda x: x.cast("string")).alias("parents"))
    maps = lists.groupBy((F.col("child") % 32).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("child").cast("string"), "parents")))).alias("value"))  # one map a file
    maps.repartition("part").write.partitionBy("part").text(path)
    return A.parent_map(spark, f"{path}/*/*.txt")


@query("SELECT 'T:' || p_partkey AS term, CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE p_size / 8 END::DOUBLE AS ia FROM part WHERE p_partkey % 5 <> 4")
def a14_term_weights(spark, sf):
    path = _folder(spark)
    odd = F.get(F.array(F.lit("-2.5"), F.lit("NaN"), F.lit("Infinity"), (F.col("p_size") / 8).cast("string"), F.lit("n/a")), (F.col("p_partkey") % 5).cast("int"))
    read(spark, sf, "part").select(F.concat(F.lit("T:"), "p_partkey"), odd).write.option("sep", "\t").csv(path)
    return A.term_weights(spark, path)


@query("SELECT o_orderpriority || '/' || year(o_orderdate) AS run_id, o_orderpriority AS cell, year(o_orderdate)::VARCHAR AS plm, round(avg(o_totalprice), 4) AS fmax_point, count(*) AS samples FROM orders GROUP BY ALL")
def a15_run_records(spark, sf):
    path, cell = _folder(spark), F.col("o_orderpriority").alias("cell")
    runs = read(spark, sf, "orders").groupBy(cell, F.year("o_orderdate").alias("plm")).agg(F.avg("o_totalprice").alias("fmax_point"), F.count("*").alias("n"))
    made = runs.select(F.concat_ws("/", "cell", "plm").alias("run_id"), F.struct(F.col("plm").cast("string").alias("plm")).alias("axis"), "cell", "fmax_point", F.array(F.col("n").cast("double")).alias("fmax_samples"), F.md5(F.concat_ws("/", "cell", "plm")).alias("file"))
    made.repartition("file").write.partitionBy("file").json(path)
    made.limit(1).select(F.lit("{not a record").alias("value")).coalesce(1).write.mode("append").text(f"{path}/broken")
    found = A.run_records(spark, path)
    return found.select("run_id", "cell", F.col("axis.plm").alias("plm"), F.round("fmax_point", 4).alias("fmax_point"), F.get("fmax_samples", F.lit(0)).cast("long").alias("samples"))


@query("SELECT CASE WHEN vec_id % 4 = 0 THEN 'query' ELSE 'reference' END AS role, count(*) AS n, 64 AS components, sum(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 2 END)::BIGINT AS leaves FROM embeddings GROUP BY ALL")
def a18_frozen_pool(spark, sf):
    query_ = F.col("vec_id") % 4 == 0
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("accession"), F.when(query_, "query").otherwise("reference").alias("role"), "embedding", F.when(~query_, F.array(F.col("label"), F.col("label") + 1)).alias("leaves"))
    pool = A.frozen_pool(rows, rows.limit(1).select(F.lit("x").alias("model"), F.lit("y").alias("snapshot")), ["model", "snapshot"])
    return pool.groupBy("role").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("components"), F.sum(F.coalesce(F.size("leaves"), F.lit(0)).cast("long")).alias("leaves"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'P' || p_partkey ELSE 'plain' || p_partkey END AS accession, upper(md5(p_partkey::VARCHAR)) || p_brand AS sequence FROM part")
def a19_fasta(spark, sf):
    path, k = _folder(spark), F.col("p_partkey")
    head = F.when(k % 2 == 0, F.concat(F.lit("sp|P"), k, F.lit("|NAME"), k, F.lit(" of a part"))).otherwise(F.concat(F.lit("plain"), k, F.lit(" other words")))
    half = F.upper(F.md5(k.cast("string")))
    read(spark, sf, "part").select(F.concat(F.lit(">"), head, F.lit("\n"), F.substring(half, 1, 20), F.lit("\n"), F.substring(half, 21, 12), "p_brand").alias("value")).write.text(path)
    return A.fasta(spark, path)


@query("SELECT 'SUPP:' || s_suppkey AS source, 'T:' || s_nationkey AS term FROM supplier")
def a21_cross_references(spark, sf):
    path = _folder(spark)
    lines = read(spark, sf, "supplier").select(F.explode(F.array(F.lit("! a comment"), F.concat(F.lit("SUPP:"), "s_suppkey", F.lit(" > some name ; T:"), "s_nationkey"))).alias("value"))
    lines.write.text(path)
    return A.cross_references(spark, path)


@query("SELECT DISTINCT l_suppkey AS a, l_partkey AS b, l_quantity::BIGINT AS w FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) OR l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def a22_edge_list(spark, sf):
    path = _folder(spark)
    read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").cast("long").alias("w")).write.option("sep", " ").option("header", True).option("compression", "gzip").csv(path)
    targets = read(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"))
    return A.edge_list(spark, path, targets, "a long, b long, w long")
