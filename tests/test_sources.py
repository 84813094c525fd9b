"""Sources and sinks on files written here."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from rankloom.sources import readers, writers

OBO = """format-version: 1.2

[Term]
id: T:1
name: root
namespace: p

[Term]
id: T:2
name: childA
namespace: p
alt_id: T:20
is_a: T:1 ! root

[Term]
id: T:3
name: childB
namespace: p
relationship: part_of T:1 ! root

[Term]
id: T:4
name: grandchild
namespace: p
is_a: T:2
is_a: T:9

[Term]
id: T:9
name: gone
is_obsolete: true

[Typedef]
id: part_of
"""


def test_ontology_stanzas(spark, tmp_path):
    (tmp_path / "o.obo").write_text(OBO)
    nodes, edges, aliases = readers.ontology_stanzas(spark, str(tmp_path / "o.obo"))
    assert sorted(r.term for r in nodes.collect()) == ["T:1", "T:2", "T:3", "T:4"]
    assert sorted(map(tuple, edges.collect())) == [("T:2", "T:1"), ("T:3", "T:1"), ("T:4", "T:2")]
    assert list(map(tuple, aliases.collect())) == [("T:20", "T:2")]


def test_weights_predictions_and_round_trip(spark, tmp_path):
    (tmp_path / "ia.tsv").write_text("a\t0.0\nb\t0.0704\nc\t5.9929\nd\t-3.0\ne\tx\nf\n")
    assert {r.term: r.ia for r in readers.term_weights(spark, str(tmp_path / "ia.tsv")).collect()} == {"a": 0.0, "b": 0.0704, "c": 5.9929, "d": 0.0}
    (tmp_path / "p.tsv").write_text("e\tx\t0.5\ne\tx\t0.7\ne\ty\tbad\nf\tz\t0.25\n")
    p = readers.predictions(spark, str(tmp_path / "p.tsv"))
    assert sorted(map(tuple, p.collect())) == [("e", "x", 0.7), ("f", "z", 0.25)]
    writers.predictions_tsv(p.withColumn("cell", F.lit("c")), str(tmp_path / "out"), 5, "cell")
    assert sorted(map(tuple, readers.predictions(spark, str(tmp_path / "out" / "cell=c")).collect())) == [("e", "x", 0.7), ("f", "z", 0.25)]


def test_predictions_tied_between_cells_rank_by_cell(spark, tmp_path):
    rows = [(e, t, 0.5, c) for e in range(40) for t, c in ((1, "O"), (2, "O"), (2, "F"))]
    for turn in (rows, rows[::-1]):
        path = str(tmp_path / f"out{turn[0][0]}")
        writers.predictions_tsv(spark.createDataFrame(turn, "entity long, term long, score double, cell string").repartition(5), path, 2, "cell")
        back = spark.read.option("sep", "\t").schema("entity long, term long, score string, cell string").csv(path)
        assert sorted(map(tuple, back.collect())) == sorted(x for e in range(40) for x in ((e, 1, "0.500000", "O"), (e, 2, "0.500000", "F")))


def test_manifests(spark, tmp_path):
    good = {"schema_version": 1, "name": "d", "k": 5, "train_snapshot_pairs": ["v1-v2"], "eval_snapshot_pair": "v2-v3", "schema_sha": "0123456789ab", "n_train_rows": 1, "n_eval_rows": 1, "format": "parquet"}
    for name, m in (("a", good), ("b", good | {"k": 0, "extra": 1, "eval_snapshot_pair": "2-3"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(m))
    rows = {r.path.split("/")[-2]: r.errors for r in readers.manifest_errors(readers.manifests(spark, f"{tmp_path}/*/manifest.json")).collect()}
    assert rows == {"a": [], "b": ["unknown: extra", "k below 1", "eval_snapshot_pair is no vA-vB"]}
    found = readers.discover(spark, f"{tmp_path}/*/manifest.json", r"/(\w+)/manifest\.json$", ["name"])
    gap = readers.missing_sources(found.select("name"), spark.createDataFrame([("a",), ("c",)], "name string"))
    assert [r.name for r in gap.collect()] == ["c"]


def test_sequences_edges_and_parent_map(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">sp|A1|x\nACG\nT\n>B2 y\nGG\n")
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "s.fa")).collect())) == [("A1", "ACGT"), ("B2", "GG")]
    (tmp_path / "m.json").write_text('{"b": ["a"], "c": ["a", "b"]}')
    assert sorted(map(tuple, readers.parent_map(spark, str(tmp_path / "m.json")).collect())) == [("b", "a"), ("c", "a"), ("c", "b")]
    with gzip.open(tmp_path / "e.txt.gz", "wt") as f:
        f.write("a b w\n1 2 900\n3 4 500\n")
    got = readers.edge_list(spark, str(tmp_path / "e.txt.gz"), spark.createDataFrame([("2",)], "id string"), "a string, b string, w int")
    assert list(map(tuple, got.collect())) == [("1", "2", 900)]


def test_frozen_pool_refuses(spark):
    manifest = spark.createDataFrame([("x",)], "source string")
    sound = spark.createDataFrame([("a", "reference", [1.0, 2.0], ["t"]), ("q", "query", [0.0, 1.0], [])], "accession string, role string, embedding array<double>, leaves array<string>")
    assert readers.frozen_pool(sound, manifest, ["source"]).count() == 2
    for bad, keys in ((sound, ["source", "digest"]), (sound.withColumn("embedding", F.expr("if(role = 'query', array(1D), embedding)")), ["source"]), (sound.withColumn("leaves", F.expr("cast(array() as array<string>)")), ["source"])):
        with pytest.raises(ValueError):
            readers.frozen_pool(bad, manifest, keys)


def test_dataset_keeps_an_entity_in_one_file(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 9).cast("string").alias("entity"), F.col("id").alias("term"), F.lit("v1-v2").alias("snapshot_pair"))
    writers.dataset(rows, str(tmp_path / "d"), ["entity", "term"], ["v1-v2"], files=4, manifest={"name": "d"})
    back = spark.read.parquet(f"{tmp_path}/d/train.parquet").select("entity", F.col("_metadata.file_path").alias("f"))
    assert back.count() == 100 and back.distinct().groupBy("entity").count().where("count > 1").count() == 0
