"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined on pigeonhole blocks, verified by Hamming distance.

A text is lower-cased (A-Z only), split at ASCII white space and cut into shingles of consecutive words. Bit b of the
fingerprint is 1 if b is set in over half of the shingles' XXH64 (seed 42).

Linking works on distinct fingerprints, so any number of copies is one row. Bits are dealt into `blocks` blocks; two
fingerprints that differ in at most `distance` bits agree on all bits of at least blocks - distance blocks, hence on
some choice of that many: each choice is one join key. Keys shared by over `bucket` fingerprints are split again by the
same rule over the bits that the key leaves open (pigeonhole within pigeonhole); fingerprints are distinct, so after
the last level a bucket holds few by construction, and no case is dropped. Within a bucket numpy verifies distances;
what leaves it is a spanning set of links, not all pairs.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows are kept, each with
its component; a row with a null id gets its fingerprint's component but names none; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import connected_components

BLOCKS, DISTANCE, BUCKET = 5, 3, 512
#: Of the further levels for crowded buckets: the blocks that the open bits are dealt into.
REFINE = (6, 6)


def fingerprint(data: bytes, words: int = 3) -> int:
    """The SimHash of one text (UTF-8)."""
    found = data.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    ones, at, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    n = len(found) - words + 1
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[words - 1 :] - 1).tolist()
    while at < n:  # in slices: a long text needs no more memory than a short one
        upto = min(n, at + 8192)
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at:upto], stops[at:upto], strict=True)), np.uint64, upto - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at = upto
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", id_: str = "doc_id", words: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def each(batches):
        for b in batches:
            fps = np.array([fingerprint(x or b"", words) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(each, "id long, fp long")


def _levels(blocks: int, distance: int, refine: tuple[int, ...]) -> list[list[tuple[int, list[tuple[int, int]]]]]:
    """For each level its keys: (number, bits that the key covers). Level k + 1 splits what key k leaves open."""

    def choose(open_bits: list[int], into: int) -> list[list[int]]:
        parts = [list(map(int, p)) for p in np.array_split(open_bits, into)]
        return [sorted(b for p in c for b in p) for c in combinations(parts, into - distance)]

    out = [choose(list(range(64)), blocks)]
    for into in refine:
        out.append([sorted(set(c) | set(k)) for k in out[-1] for c in choose([b for b in range(64) if b not in set(k)], into)])
    return out


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _verified(distance: int):
    """Rows (key_no, masked, fp), sorted by key: links of a spanning set within each bucket, found by shifted comparison."""

    def links(k, v, f):
        made, n = [], len(f)
        same = np.ones(n, bool)
        root = np.arange(n)
        for d in range(1, n):
            same = (k[d:] == k[:-d]) & (v[d:] == v[:-d])
            if not same.any():
                break
            i = np.nonzero(same)[0]
            near = i[np.bitwise_count(f[i] ^ f[i + d]) <= distance]
            for a in near.tolist():
                b = a + d
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                while root[b] != b:
                    root[b] = root[root[b]]
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
        for x in np.nonzero(root != np.arange(n))[0].tolist():
            a = x
            while root[a] != a:
                a = root[a]
            made.append((f[x], f[a]))
        return made

    def each(batches):
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            k, v, f = (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held))
            if not len(k):
                continue
            tail = np.nonzero((k != k[-1]) | (v != v[-1]))[0]
            last = int(tail[-1]) + 1 if len(tail) else 0
            held = [k[last:], v[last:], f[last:]]
            yield from emit(links(k[:last], v[:last], f[:last].view(np.uint64)))
        yield from emit(links(held[0], held[1], held[2].view(np.uint64)))

    def emit(made):
        if made:
            x = np.array(made, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["a", "b"])

    return each


def links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, bucket: int = BUCKET, refine: tuple[int, ...] = REFINE) -> DataFrame:
    """distinct(fp) -> (a, b): links among fingerprints at `distance` bits or fewer that connect what all such links connect."""
    spark, levels = distinct.sparkSession, _levels(blocks, distance, refine)
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(m))).alias("v")) for i, m in enumerate(levels[0])])).alias("x")).select("x.k", "x.v", "fp")
    found = None
    for depth in range(len(levels)):
        last = depth == len(levels) - 1
        if not last:
            rows = materialise(rows, "keys")
            sizes = materialise(rows.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
            shared = rows.join(sizes.where(f"n <= {bucket}").select("k", "v"), ["k", "v"])
        else:
            shared = rows
        here = shared.repartition("k", "v").sortWithinPartitions("k", "v", "fp").select("k", "v", "fp").mapInArrow(_verified(distance), "a long, b long")
        found = here if found is None else found.unionByName(here)
        if last or not (top := sizes.where(f"n > {bucket}")).take(1):
            break
        crowded = rows.join(top.select("k", "v"), ["k", "v"])
        per = len(levels[depth + 1]) // len(levels[depth])
        masks = spark.createDataFrame([(i // per, i, _mask(m)) for i, m in enumerate(levels[depth + 1])], "k int, k2 int, m long")
        rows = crowded.join(F.broadcast(masks), "k").select(F.col("k2").alias("k"), F.col("fp").bitwiseAND(F.col("m")).alias("v"), "fp")  # at most 4,000 masks, fixed by the parameters
    return found


def simhash_components(docs: DataFrame, text: str = "text", id_: str = "doc_id", words: int = 3, **how) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs: the fingerprint as 16 hex digits and the smallest id
    reachable over links of `distance` bits or fewer, the row's own included."""
    prints = materialise(fingerprints(docs, text, id_, words), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = materialise(connected_components(links(distinct.select("fp"), **how)), "roots")
    placed = materialise(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    named = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    label = materialise(placed.select("fp", "root").join(named, "root").select("fp", "component_id"), "label")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(label, "fp").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")
