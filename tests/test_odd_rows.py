"""Queries on rows that the given tables don't have, against their SQL; and plans whose tasks stay small."""

import contextlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.operators import resampling, retrieval
from rankloom.plans import registry

registry.load()


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """Order lines some of which stand twice, some without a quantity."""
    path = f"{tmp_path_factory.mktemp('odd')}"
    lines = spark.read.parquet(f"{small}/lineitem.parquet").withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 > 0, F.col("l_quantity")))
    lines.unionByName(lines.where("l_orderkey % 10 < 3")).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_stored_calibrators_of_repeated_rows_and_null_scores(spark, odd):
    got = registry.QUERIES["k08_stored_calibrators"](spark, odd).toPandas()
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{odd}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["k08_stored_calibrators"]).df()
    shown = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    assert shown(got) == shown(want)


def test_signed_rank_needs_no_window_over_a_group(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("g"), F.expr("(id * 7 % 11 - 5) / 4").alias("d")).unionByName(spark.sql("select null g, 0.5D d"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found = resampling.wilcoxon(rows, "g")
        found.explain()
    assert "windowspecdefinition(g" not in out.getvalue()
    plain = {}
    for r in rows.where("d <> 0").collect():
        plain.setdefault(r.g, []).append(r.d)
    mean = lambda d, x: sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2
    assert {r.g: (r.n, r.w) for r in found.collect()} == {g: (len(d), sum(mean(d, x) for x in d if x > 0)) for g, d in plain.items()}


def test_max_sim_over_blocks_is_that_of_one_block(spark):
    units = spark.range(90).select((F.col("id") % 2).alias("entity"), F.col("id").alias("pos"), F.expr("array(sin(id), cos(id * 3), id % 5 - 2D)").alias("v"))
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    one, many = (retrieval.max_sim(pairs, units, block=k).first() for k in (1_000, 7))
    assert tuple(many) == pytest.approx(tuple(one))


def test_profiles_ship_no_vector_components(spark, small):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        registry.QUERIES["h30_term_features"](spark, small).explain()
    assert "posexplode" not in out.getvalue()
