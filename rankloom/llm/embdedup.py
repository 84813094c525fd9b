"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, cosine on the original vectors.

Vectors are compared only within one label and length. Rotations of the principal axes are learned (on at most `sample`
vectors, the least by hash) so that the signs of the rotated coordinates make balanced 64-bit codes; vectors of fewer
dimensions get several rotations, so that every bit says something. A code is cut into `tables` substrings; a vector is
stored under each and asks for each with all substrings at one bit's distance or none, so every pair whose codes differ in
at most 2 * tables - 1 bits meets, and others by chance.

What a vector meets is a class, not its members. The centres of table buckets claim the vectors around them: members
within half the linking angle of a centre (the core) all link with one another, so they are counted, not paired. Others
within the whole angle (the rim) are members without that promise, and what no centre claims is a class of its own. A
vector and a class are compared by the angle to the centre: all of a core links, or none, or it is decided by comparing
with its members as original vectors, in blocks of bounded size that return counts and components, never pairs. Single
vectors that meet must be within `bits` bits.

Scale: copies of a vector are one row with a count before anything is joined. The tables join on (label, table,
substring): 16-bit substrings spread each label over 65,536 buckets; raise `tables`' substring length with the data. Rows
stay in proportion to vectors and the classes these meet, also where a third of the table is one tight group.

Defined cases: vectors that are null, zero or hold null or non-finite components, and null labels, link with nothing and
are returned with n_links 0 and their own id; vectors of different lengths link with nothing but their like; repeated
ids are kept, each row by its vector; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import connected_components

SAMPLE, TABLES, BITS, LEAST, BLOCK = 20_000, 4, 14, 0.98, 2_000
_EDGE = 1e-7  # radians that bounds on angles keep off, so that rounding decides nothing


def fit_rotation(x: np.ndarray, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, d x 64 projection) by iterative quantisation: alternately the best binary codes and the best rotation, as
    many rotations from different starts as 64 bits take."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[:64].T
    v, random, out = centred @ axes, np.random.default_rng(seed), []
    k = axes.shape[1]
    while k * len(out) < 64:
        r, _ = np.linalg.qr(random.normal(size=(k, k)))
        for _ in range(rounds):
            codes = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(codes.T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)[:, :64]


def codes_of(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(((x - mean) @ rotation >= 0).astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of at most d components as unit rows; shorter ones, which meet only their like, end in zeros."""
    out = np.zeros((len(column), d))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    out[np.arange(d) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((a * b).sum(axis=1), -1, 1))


def with_codes(distinct: DataFrame, d: int, sample: int) -> DataFrame:
    """distinct(uid, grp, n, v, ...) with the code of v."""
    taken = distinct.select("h", "v").orderBy("h").limit(sample).select("v").toArrow().column(0)
    mean, rotation = fit_rotation(_vectors(taken, d))

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes_of(_vectors(b.column(3), d), mean, rotation))], names=["uid", "grp", "n", "v", "code"])

    return distinct.select("uid", "grp", "n", "v").mapInArrow(each, "uid long, grp string, n long, v array<double>, code long")


def _substrings(tables: int) -> list:
    width = 64 // tables
    return [F.shiftrightunsigned("code", i * width).bitwiseAND((1 << width) - 1) for i in range(tables)]


def _sums(d: int):
    def each(batches):
        for b in batches:
            x, keys = _vectors(b.column(2), d), {}
            number = np.array([keys.setdefault(k, len(keys)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
            total = np.zeros((len(keys), d))
            np.add.at(total, number, x)
            n = np.bincount(number, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(n, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["grp", "s", "n", "c"])

    return each


def _added(table: pa.Table) -> pa.Table:
    """One bucket: the sums of tasks added up, at most a row for each of their batches."""
    c = np.array(table.column("c").to_pylist()).sum(axis=0)
    return pa.table({"grp": table.column("grp")[:1], "s": table.column("s")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "c": pa.array([c], pa.list_(pa.float64()))})


def classes_of(coded: DataFrame, d: int, tables: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(members(uid, grp, n, v, code, cid, phi, core), classes(cid, grp, c, radius, n_core, rim)): table by table, the
    centres of buckets claim the vectors around them that no earlier one did."""
    theta, rest, found = float(np.arccos(least)), coded, None

    def near(batches):
        for b in batches:
            phi = _angles(_vectors(b.column(3), d), _vectors(b.column(6), d))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(phi), pa.array(phi <= theta / 2 - _EDGE)], names=["uid", "grp", "n", "v", "code", "cid", "phi", "core"]).filter(pa.array(phi <= theta - _EDGE))

    kinds = "uid long, grp string, n long, v array<double>, code long, cid long, phi double, core boolean"
    for t, part in enumerate(_substrings(tables)):
        dealt = materialise(rest.withColumn("s", part), "dealt")
        busy = dealt.groupBy("grp", "s").agg(F.count("*").alias("m")).where("m > 2").select("grp", "s")  # most buckets hold one vector
        dealt = materialise(dealt.join(busy, ["grp", "s"]), "busy")
        centres = dealt.select("grp", "s", "v").mapInArrow(_sums(d), "grp string, s long, n long, c array<double>").groupBy("grp", "s").applyInArrow(_added, "grp string, s long, n long, c array<double>")
        centres = materialise(centres.select("grp", "s", "c", (-1 - tables * F.monotonically_increasing_id() - t).alias("cid")), "centres")
        claimed = materialise(dealt.join(centres, ["grp", "s"]).select("uid", "grp", "n", "v", "code", "cid", "c").mapInArrow(near, kinds), "claimed")
        # a centre that holds no two of its bucket together claims nothing
        firm = claimed.where("core").groupBy("cid").agg(F.count("*").alias("m")).where("m > 1").select("cid")
        claimed = materialise(claimed.join(firm, "cid").join(centres.select("cid", "c"), "cid").select("uid", "grp", "n", "v", "code", "cid", "phi", "core", "c"), "claimed")
        rest = materialise(rest.join(claimed.select("uid"), "uid", "left_anti"), "rest")
        found = claimed if found is None else found.unionByName(claimed)
    classes = found.groupBy("cid").agg(F.first("grp").alias("grp"), F.first("c").alias("c"), F.coalesce(F.max(F.when(F.col("core"), F.col("phi"))), F.lit(0.0)).alias("radius"), F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("n_core"), F.max((~F.col("core")).cast("int")).alias("rim"))
    alone = rest.select("uid", "grp", "n", "v", "code", F.col("uid").alias("cid"), F.lit(0.0).alias("phi"), F.lit(True).alias("core"))
    classes = classes.unionByName(alone.select("cid", "grp", F.col("v").alias("c"), F.lit(0.0).alias("radius"), F.col("n").alias("n_core"), F.lit(0).alias("rim")))
    return materialise(found.drop("c").unionByName(alone), "members"), materialise(classes, "classes")


def candidates(members: DataFrame, tables: int, bits: int) -> DataFrame:
    """(uid, cid): a vector and a class that share a table's substring up to one bit. Single vectors must be within `bits`
    bits; each vector also meets its own class."""
    width, single = 64 // tables, F.col("cid") >= 0
    dealt = members.select("uid", "cid", "grp", "code", F.posexplode(F.array(*_substrings(tables))).alias("t", "s"))
    stored = dealt.select("grp", "t", "s", F.col("cid").alias("other"), F.when(single, F.col("code")).alias("code2")).distinct()
    asked = dealt.select("grp", "t", "uid", "cid", "code", F.explode(F.array(F.col("s"), *[F.col("s").bitwiseXOR(F.lit(1 << k)) for k in range(width)])).alias("s"))
    met = asked.join(stored, ["grp", "t", "s"]).where((F.col("other") != F.col("cid")) & (F.col("code2").isNull() | (F.bit_count(F.col("code").bitwiseXOR(F.col("code2"))) <= bits)))
    return met.select("uid", F.col("other").alias("cid")).distinct().unionByName(members.where("cid < 0").select("uid", "cid"))


def _compared(d: int, least: float):
    """A block: (a, b, n) with a vector's links in it as n, and edges a - b that connect what links."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("uid").to_numpy(), right.column("uid").to_numpy()
        out = [np.zeros((0, 3), np.int64)]
        if len(a) and len(b):
            link = (_vectors(left.column("v"), d) @ _vectors(right.column("v"), d).T >= least) & (a[:, None] != b[None, :])
            n = link @ right.column("n").to_numpy()
            some = np.nonzero(n)[0]
            out.append(np.stack([a[some], np.full(len(some), -1), n[some]], axis=1))
            top = np.iinfo(np.int64).max
            root_a, root_b = a.copy(), b.copy()
            while True:  # the least uid spreads along links
                new_a = np.minimum(root_a, np.where(link, root_b[None, :], top).min(axis=1))
                new_b = np.minimum(root_b, np.where(link, new_a[:, None], top).min(axis=0))
                if (new_a == root_a).all() and (new_b == root_b).all():
                    break
                root_a, root_b = new_a, new_b
            for own, root in ((a, root_a), (b, root_b)):
                moved = np.nonzero(own != root)[0]
                out.append(np.stack([own[moved], root[moved], np.zeros(len(moved), np.int64)], axis=1))
        rows = np.concatenate(out)
        return pa.table({"a": rows[:, 0], "b": rows[:, 1], "n": rows[:, 2]})

    return each


def links_of(members: DataFrame, classes: DataFrame, met: DataFrame, d: int, least: float, block: int) -> DataFrame:
    """(a, b, n): where n > 0, vector a has n links there; b, where it isn't -1 with n > 0, is a node that a is connected with."""
    theta = float(np.arccos(least))

    def judge(batches):
        for b in batches:
            phi = _angles(_vectors(b.column(3), d), _vectors(b.column(7), d))
            own_core, radius, rim, single = (np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in (5, 8, 10, 11))
            mine = np.asarray(b.column(4).to_numpy()) == np.asarray(b.column(1).to_numpy())
            exact = (_vectors(b.column(3), d) * _vectors(b.column(7), d)).sum(axis=1) >= least
            sure = np.where(single, exact, (mine & own_core) | (phi + radius <= theta - _EDGE))
            maybe = ~single & ~sure & (phi - radius <= theta + _EDGE)
            ring = (rim > 0) & (phi <= 2 * theta)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sure), pa.array(maybe), pa.array(ring), pa.array(mine & own_core)], names=["uid", "cid", "sure", "maybe", "ring", "inside"])

    x = members.select("uid", "n", "v", F.col("cid").alias("own"), "core")
    pairs = met.join(x, "uid").join(classes, "cid").select("uid", "cid", "n", "v", "own", "core", "grp", "c", "radius", "n_core", "rim", (F.col("cid") >= 0).alias("single"))
    judged = materialise(pairs.mapInArrow(judge, "uid long, cid long, sure boolean, maybe boolean, ring boolean, inside boolean"), "judged")
    whole = judged.where("sure").join(classes.select("cid", "n_core"), "cid").join(members.select("uid", "n"), "uid")
    whole = whole.select(F.col("uid").alias("a"), F.col("cid").alias("b"), (F.col("n_core") - F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n"))
    asks = judged.where("maybe").select("uid", "cid", F.lit(True).alias("core")).unionByName(judged.where("ring").select("uid", "cid", F.lit(False).alias("core")))
    asks = materialise(asks, "asks")
    ways = lambda name: F.ceil(F.count("*") / block).cast("bigint").alias(name)
    sizes = asks.groupBy("cid", "core").agg(ways("by_x")).join(members.where("cid < 0").groupBy("cid", "core").agg(ways("by_y")), ["cid", "core"])
    sizes = materialise(sizes, "sizes")
    left = asks.join(sizes, ["cid", "core"]).join(members.select("uid", "v"), "uid").select("cid", "core", "uid", "v", F.pmod(F.xxhash64("uid"), "by_x").alias("x"), F.explode(F.expr("sequence(0L, by_y - 1)")).alias("y"))
    right = members.where("cid < 0").join(sizes, ["cid", "core"]).select("cid", "core", "uid", "v", "n", F.pmod(F.xxhash64("uid"), "by_y").alias("y"), F.explode(F.expr("sequence(0L, by_x - 1)")).alias("x"))
    left, right, key = left.toDF(*left.columns), right.toDF(*right.columns), ["cid", "core", "x", "y"]  # both come from members
    compared = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compared(d, least), "a long, b long, n long")
    return materialise(whole.unionByName(compared), "links")


def embedding_dedup(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, tables: int = TABLES, bits: int = BITS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    finite = F.expr("exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    sound = F.coalesce(F.col("v").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.select("vec_id", F.when(sound, F.concat_ws(":", F.size("v"), "label")).alias("grp"), F.when(sound, F.col("v")).alias("v"))
    rows = materialise(rows.withColumn("h", F.xxhash64("grp", "v")), "vectors")
    good, bad = rows.where("grp is not null"), rows.where("grp is null")
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    distinct = good.groupBy("h", "grp", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    distinct = materialise(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    d = distinct.agg(F.max(F.size("v"))).first()[0]
    if d:
        coded = materialise(with_codes(distinct, d, sample), "codes")
        members, classes = classes_of(coded, d, tables, least)
        links = links_of(members, classes, candidates(members, tables, bits), d, least, block)
        degree = links.where("n > 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("others"))
        edges = links.where("not (b = -1 and n > 0)").select("a", "b").unionByName(members.where("cid < 0 and core").select(F.col("uid").alias("a"), F.col("cid").alias("b")))
        roots = connected_components(materialise(edges.where("a <> b"), "edges"))
        placed = materialise(distinct.join(roots, F.col("uid") == F.col("node"), "left").join(degree, "uid", "left").select("uid", "first", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root")), "placed")
        named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        per = materialise(placed.join(named, "root").select("uid", "n_links", "component_id"), "per")
        linked = good.join(distinct.select("h", "grp", "v", "uid"), ["h", "grp", "v"]).select("vec_id", "uid").join(per, "uid").select("vec_id", "n_links", "component_id")
        alone = linked.unionByName(alone)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
