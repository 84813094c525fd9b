"""Byte-level BPE: encoding and decoding by DuckDB recursive queries inside each partition.

A text is cut by the tokenizer's pattern; every distinct piece of a batch that is no token by itself goes, as rows
(piece, tokens, what adjacent ones make), into a recursive query that contracts each piece's leftmost pair of least rank
and joins the two new pairs with the merge table, until no pair makes a token. Decoding selects each token's bytes and
concatenates them in order, again in DuckDB. Pieces repeat heavily, so only pieces a worker has not met reach the query; what it remembers is
bounded in bytes, and DuckDB is closed with each partition. A piece of over `long_piece` bytes (rare: a run without any break) would need as many rounds of the query as it
has merges; the same contraction runs on it with a heap instead.

Each text is encoded by itself in the task that reads it: no shuffle, whole texts, any length.

Defined cases: null counts as empty, an empty text has no tokens; repeated rows and null ids are kept; an empty table
gives an empty result; extra columns are ignored by digests() and carried by encode(). Characters no UTF-8 text can
hold do not occur in Spark strings.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import lean, temp_name

#: Bytes of the longest piece that DuckDB contracts, bytes of pieces a query takes, bytes of pieces a worker remembers.
LONG_PIECE, QUERY_BYTES, REMEMBER = 400, 250_000, 60_000_000

#: step holds a piece in one row: its tokens, the tokens that its adjacent pairs make (NONE: no token) and the least of
#: those, whose first place is contracted; only the two pairs beside it are looked up anew.
NONE = (1 << 31) - 1
_ENCODE = f"""
with recursive step(w, ids, made, best) as (
    select w, ids, made, coalesce(list_min(made), {NONE}) from pieces
    union all
    select w, ids, made, coalesce(list_min(made), {NONE})
    from (
        select w, list_concat(ids[:k - 1], [best], ids[k + 2:]) as ids, list_concat(
            made[:greatest(k - 2, 0)], if(k > 1, [coalesce(l.id, {NONE})], []), if(k < len(made), [coalesce(r.id, {NONE})], []), made[k + 2:]) as made
        from (select w, ids, made, best, list_position(made, best) as k from step where best < {NONE})
        left join merges l on l.pair = ids[k - 1]::bigint * 4294967296 + best
        left join merges r on r.pair = best::bigint * 4294967296 + ids[k + 2]
    )
)
select w, ids from step where best = {NONE} order by w
"""
_DECODE = "select array_to_string(list_select(every, places), '') as text from encoded, named order by w"


class Vocabulary:
    """The tokenizer's file as a dict of ranks and as Arrow tables of merges and tokens, a few megabytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values()) >= 1 << 31:
            raise ValueError("token ids must be below 2 ** 31")
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pair, made = pa.array([a << 32 | b for a, b, _ in pairs], pa.int64()), pa.array([i for _, _, i in pairs], pa.int32())
        self.ids = np.array(sorted(self.ranks.values()))
        every = pa.array([[t.decode("latin-1") for t in sorted(self.ranks, key=self.ranks.get)]], pa.list_(pa.string()))  # a character for each byte
        self.tables = {"merges": pa.table({"pair": pair, "id": made}), "named": pa.table({"every": every})}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.two = np.array([[self.ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], np.int32)


def _dealt(pieces: list, size) -> Iterator[list]:
    """Lists of pieces of at most QUERY_BYTES, or of one."""
    part, held = [], 0
    for x in pieces:
        if part and held + size(x) > QUERY_BYTES:
            yield part
            part, held = [], 0
        part.append(x)
        held += size(x)
    if part:
        yield part


class Codec:
    """One worker's tokenizer: the pieces it has met, and the vocabulary in DuckDB while a partition is open."""

    def __init__(self, path: str, pattern: str, long_piece: int = LONG_PIECE, remember: int = REMEMBER):
        self.vocabulary = Vocabulary(path)
        self.ranks, self.byte, self.two = self.vocabulary.ranks, self.vocabulary.byte, self.vocabulary.two
        self.split, self.long_piece, self.remember = regex.compile(pattern).findall, long_piece, remember
        self.db = None
        self._forget()

    def _forget(self) -> None:
        """Pieces by number, with their ids as bytes and their decoded bytes; `held` estimates what all that takes."""
        self.number: dict[str, int] = {}
        self.ids_of: list[bytes | None] = []
        self.text_of: list[bytes | None] = []
        self.held = 0

    def __enter__(self) -> Codec:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": "", "preserve_insertion_order": False})  # queries are bounded: nothing spills to a folder
        self.db.execute("set enable_progress_bar = false")
        for name, table in self.vocabulary.tables.items():
            self.db.register("given", table)
            self.db.execute(f"create table {name} as from given")
            self.db.unregister("given")
        return self

    def __exit__(self, *_) -> None:
        self.db.close()
        self.db = None

    def _query(self, pieces: list[bytes]) -> tuple[list[list[int]], list[bytes]]:
        """Ids and decoded bytes of pieces of two bytes or more."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
        inside = np.ones(len(raw), bool)
        inside[ends[1:] - 1] = False  # a piece's last byte has no pair
        made = self.two[raw[:-1], raw[1:]][inside[:-1]]
        given = [pa.ListArray.from_arrays(ends, self.byte[raw]), pa.ListArray.from_arrays(ends - np.arange(len(ends), dtype=np.int32), made)]
        self.db.register("pieces", pa.table({"w": np.arange(len(pieces), dtype=np.int32), "ids": given[0], "made": given[1]}))
        encoded = self.db.sql(_ENCODE).to_arrow_table()
        self.db.unregister("pieces")
        ids = encoded.column("ids").combine_chunks()
        flat, at = ids.values.to_numpy().tolist(), ids.offsets.to_numpy().tolist()
        return [flat[a:b] for a, b in itertools.pairwise(at)], self._decode(ids)

    def _decode(self, ids: pa.ListArray) -> list[bytes]:
        places = np.searchsorted(self.vocabulary.ids, ids.values.to_numpy()) + 1
        self.db.register("encoded", pa.table({"w": np.arange(len(ids)), "places": pa.ListArray.from_arrays(ids.offsets, places)}))
        text = self.db.sql(_DECODE).to_arrow_table().column("text").to_pylist()
        self.db.unregister("encoded")
        return [x.encode("latin-1") for x in text]

    def _heap(self, piece: bytes) -> list[int]:
        """The contraction of _ENCODE for one long piece."""
        n, ranks = len(piece), self.ranks
        ends, after, before, live = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            j = after[i] if live[i] else n
            if j >= n or ends[j] != end:
                continue
            live[j], ends[i], after[i] = False, end, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : ends[after[i]]])) is not None:
                    heapq.heappush(queue, (r, i, ends[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(queue, (r, h, end))
        return [ranks[piece[i : ends[i]]] for i in range(n) if live[i]]

    def _keep(self, place: int, ids: list[int], text: bytes) -> None:
        self.ids_of[place], self.text_of[place] = struct.pack(f"<{len(ids)}I", *ids), text
        self.held += 260 + 4 * len(ids) + 2 * len(text)

    def learn(self, fresh: list[str]) -> None:
        """Encodes and decodes the pieces that were numbered last."""
        first = len(self.ids_of)
        self.ids_of += [None] * len(fresh)
        self.text_of += [None] * len(fresh)
        coded = [(first + k, x.encode()) for k, x in enumerate(fresh)]
        direct = [(k, [self.ranks[p]] if p in self.ranks else self._heap(p)) for k, p in coded if p in self.ranks or len(p) > self.long_piece]
        for part in _dealt(direct, lambda x: 4 * len(x[1])):
            decoded = self._decode(pa.array([i for _, i in part], pa.list_(pa.int32())))
            for (k, i), d in zip(part, decoded, strict=True):
                self._keep(k, i, d)
        rest = [(k, p) for k, p in coded if self.ids_of[k] is None]
        for part in _dealt(rest, lambda x: len(x[1])):
            for (k, _), i, d in zip(part, *self._query([p for _, p in part]), strict=True):
                self._keep(k, i, d)

    def batch(self, texts: list[str | None]):
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of each text, in turn."""
        at = 0
        while at < len(texts):  # as many texts at a time as hold some millions of characters: each query reads the merge table anew
            upto, size, cut, fresh, number = at, 0, [], [], self.number
            while upto < len(texts) and (upto == at or size < 4_000_000):
                t = texts[upto] or ""
                pieces = self.split(t)
                new = [p for p in dict.fromkeys(pieces) if p not in number]
                number.update(zip(new, range(len(number), len(number) + len(new))))
                fresh += new
                cut.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))
                size += len(t)
                upto += 1
            self.learn(fresh)
            ids, text = self.ids_of.__getitem__, self.text_of.__getitem__
            for c in cut:
                places = c.tolist()
                yield b"".join(map(ids, places)), b"".join(map(text, places))
            at = upto
            if self.held > self.remember:
                self._forget()


@functools.lru_cache(1)
def codec(path: str, pattern: str, long_piece: int = LONG_PIECE, remember: int = REMEMBER) -> Codec:
    """The worker's codec: a few megabytes of vocabulary and at most `remember` bytes of pieces stay while the worker lives;
    DuckDB is closed with each partition."""
    return Codec(path, pattern, long_piece, remember)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", id_: str = "doc_id", long_piece: int = LONG_PIECE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs."""

    @lean
    def each(batches):
        with codec(path, pattern, long_piece) as own:
            for b in batches:
                for at in range(0, b.num_rows, 6000):
                    part = b.slice(at, 6000)
                    made = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in own.batch(part.column(1).to_pylist())]
                    columns = list(zip(*made, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_].dataType.simpleString()
    return docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("t")).mapInArrow(each, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", long_piece: int = LONG_PIECE) -> DataFrame:
    """docs with the columns token_ids (array of int) and decoded (the text that the ids give back) in addition; where docs
    has a column of such a name, the new one's is preceded by `_`."""
    at, added = docs.columns.index(text), [temp_name(docs, "token_ids"), temp_name(docs, "decoded")]
    kinds = StructType([*docs.schema.fields, StructField(added[0], ArrayType(IntegerType())), StructField(added[1], StringType())])

    @lean
    def each(batches):
        with codec(path, pattern, long_piece) as own:
            for b in batches:
                for k in range(0, b.num_rows, 1000):
                    part = b.slice(k, 1000)
                    made = list(own.batch(part.column(at).to_pylist()))
                    ids = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in made], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([d.decode() for _, d in made], pa.string())], names=[*part.schema.names, *added])

    return docs.mapInArrow(each, kinds)
