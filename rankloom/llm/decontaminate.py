"""Benchmark decontamination with suffix arrays over the training text.

Texts are lower-cased (A-Z only) and cut into words of digits, letters and non-ASCII bytes. A batch of documents of bounded
bytes is a shard: its words become numbers of the test vocabulary (0 for any other word, and between documents, which no
match crosses), and the suffixes whose first words open some test window are sorted into a suffix array, a sparse one, as
no other suffix can match. Test suffixes of the same first `window` words are one class, which is binary-searched once in
every shard: its range gives the places of those words. Places that follow one another are walked class by class: an
item's place goes on if the next class has its next place, so longest verbatim matches come out whole.

Items that share a passage cost its classes' places once for each passage that differs, not for each document: a worker
remembers, in bounded bytes, what it found for a sequence of classes. The test set is compared in slices of about
`slice_words` words, each broadcast for a pass over the documents. No documents are grouped by what they hold.

Defined cases: null or empty texts have no words and are never hit; an item of fewer words than the window is one window,
one of none is ignored; items with a null id count for hits, not for the list of items; items repeated under one id
count once; empty tables give no hits; repeated documents are kept; extra columns are ignored by hits() and carried by
decontaminate().
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise

#: Words of a window and of a slice of the test set; bytes of text in a shard, and of what a worker remembers of passages.
WINDOW, SLICE_WORDS, SHARD_BYTES, REMEMBER = 10, 500_000, 4_000_000, 20_000_000
_MATCH = pa.struct([("words", pa.int64()), ("doc_at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])
_BEST = "struct<words:bigint,doc_at:bigint,item:string,item_at:bigint>"
#: Word bytes map to themselves (A-Z to a-z), all others to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(WORDS).split()


class TestSuffixes:
    """The windows of a slice of test items. Windows of the same words are one class, whatever number of items hold it: a class
    has a row of `window` word numbers (0 past the end of a shorter item) and the places where it stands in the items."""

    __test__ = False  # not a pytest class

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, remember: int = REMEMBER):
        self.window, self.vocabulary, self.remember = window, {}, remember
        number = self.vocabulary.setdefault
        parts = [np.fromiter((number(w, len(self.vocabulary) + 1) for w in words_of(t)), np.int32) for _, t in items]
        length = np.array([len(x) for x in parts], np.int64)
        begin = np.cumsum(length + window) - length - window
        text = np.zeros(int((length + window).sum()), np.int32)
        for x, at in zip(parts, begin, strict=True):
            text[at : at + len(x)] = x
        self.ids = sorted({i for (i, _), n in zip(items, length, strict=True) if i is not None and n})
        place = {x: n for n, x in enumerate(self.ids)}
        self.begin, self.item = begin, np.array([place.get(i, -1) for i, _ in items], np.int32)
        at = np.nonzero((np.concatenate([np.arange(n + window) for n in length]) if len(length) else np.zeros(0, int)) + window <= np.repeat(length, length + window))[0]
        short = begin[(length > 0) & (length < window)]
        # full windows and short items apart: what goes on word by word is a matter of full windows alone
        keys, inverse = np.unique(_key(text[at[:, None] + np.arange(window)]), return_inverse=True)
        few, lesser = np.unique(_key(text[short[:, None] + np.arange(window)]), return_inverse=True)
        self.full, self.keys = len(keys), np.concatenate([keys, few])
        self.rows = np.concatenate([keys, few]).view(">u4").reshape(-1, window).astype(np.int64) if len(keys) + len(few) else np.zeros((0, window), np.int64)
        self.length = np.concatenate([np.full(len(keys), window), (self.rows[len(keys) :] > 0).sum(axis=1)]).astype(np.int64)
        self.places = np.concatenate([at[np.argsort(inverse, kind="stable")], short[np.argsort(lesser, kind="stable")]]).astype(np.int64)
        self.cut = np.concatenate([[0], np.cumsum(np.concatenate([np.bincount(inverse, minlength=len(keys)), np.bincount(lesser, minlength=len(few))]))]).astype(np.int64)
        pairs = self.rows[:, 0] * (len(self.vocabulary) + 1) + (self.rows[:, 1] if window > 1 else 0)
        single = self.length == 1  # an item of one word: any next word may follow
        self.opening, self.alone = np.unique(pairs[~single]), np.unique(self.rows[single, 0])
        self.met: dict[bytes, tuple] = {}
        self.held = 0

    def owners(self, places: np.ndarray) -> np.ndarray:
        """Which of the given items a place lies in."""
        return np.searchsorted(self.begin, places, "right") - 1

    def of_class(self, c: int) -> np.ndarray:
        return self.places[self.cut[c] : self.cut[c + 1]]

    def runs(self, classes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each of the classes that follow one another word by word: (its offset, places in the items, offsets at which the
        matches that stand there began). Only the places of two classes are held at a time."""
        places = starts = np.zeros(0, np.int64)
        for offset, c in enumerate(classes.tolist()):
            here = self.of_class(c)
            began = np.full(len(here), offset)
            if len(places):
                near = np.minimum(np.searchsorted(places, here - 1), len(places) - 1)
                goes_on = places[near] == here - 1
                began[goes_on] = starts[near[goes_on]]
            places, starts = here, began
            yield offset, places, starts

    def story(self, classes: np.ndarray) -> tuple[tuple[int, int, int, int] | None, np.ndarray]:
        """((words, offset, item's number, place in it) of the longest match with an item that has an id, numbers of all such
        items). A passage that many documents hold is walked once."""
        key = classes.tobytes()
        if key in self.met:
            return self.met[key]
        best = None
        for offset, places, starts in self.runs(classes):
            item = self.item[self.owners(places)]
            named = item >= 0
            if named.any():
                began = int(starts[named].min())
                words = offset - began + self.window
                if best is None or words > best[0]:
                    on = named & (starts == began)
                    first = places[on] - (offset - began)
                    choice = min(zip(item[on].tolist(), (first - self.begin[self.owners(first)]).tolist(), strict=True))
                    best = (words, began, *choice)
        items = np.unique(np.concatenate([np.unique(self.item[self.owners(self.of_class(c))]) for c in np.unique(classes).tolist()]))
        found = best, items[items >= 0]
        self.held += len(key) + 4 * len(items) + 200
        if self.held > self.remember:
            self.met, self.held = {}, 0
        self.met[key] = found
        return found


def _key(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Shard:
    """The sparse suffix array of some documents, and where the test set's classes occur in it."""

    def __init__(self, texts: list[bytes | None], test: TestSuffixes):
        get, parts, self.counts, window = test.vocabulary.get, [], [], test.window
        gap = np.zeros(window, np.int32)
        for t in texts:
            w = words_of(t)
            self.counts.append(len(w))
            parts += [np.fromiter((get(x, 0) for x in w), np.int32, len(w)), gap]
        self.text = np.concatenate([*parts, gap]) if parts else gap
        self.offset = np.concatenate([[0], np.cumsum([c + window for c in self.counts])])
        at = np.nonzero(self.text[:-1])[0]
        opens = np.zeros(len(at), bool)
        for known, of in ((test.opening, self.text[at].astype(np.int64) * (len(test.vocabulary) + 1) + self.text[at + 1]), (test.alone, self.text[at])):
            if len(known):
                opens |= known[np.minimum(np.searchsorted(known, of), len(known) - 1)] == of
        at = at[opens]
        at = at[at + window <= len(self.text)]
        keys = _key(self.text[at[:, None] + np.arange(window)]) if len(at) else np.zeros(0, f"S{4 * window}")
        order = np.argsort(keys, kind="stable")
        self.array, self.keys = at[order], keys[order]
        self._search(test)

    def _search(self, test: TestSuffixes) -> None:
        """Binary search of every class: the full window that stands at each place, if any, and places of short items."""
        low = np.searchsorted(self.keys, test.keys, "left")
        upper = np.where(np.arange(test.window) < test.length[:, None], test.rows, 0xFFFFFFFF)
        high = np.searchsorted(self.keys, _key(upper), "right") if len(test.keys) else low
        n = high - low
        which = np.repeat(np.arange(test.full), n[: test.full])
        index = np.arange(len(which)) - np.repeat(np.cumsum(n[: test.full]) - n[: test.full], n[: test.full]) + low[which]
        place = self.array[index]
        order = np.argsort(place)
        self.place, self.class_at = place[order], which[order]
        self.short = [(c, np.sort(self.array[low[c] : high[c]])) for c in range(test.full, len(test.keys)) if n[c]]
        edge = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + test.window, -1)
        for c, where in self.short:
            np.add.at(edge, where, 1)
            np.add.at(edge, where + test.length[c], -1)
        self.covered = np.cumsum(edge)[:-1] > 0

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offset, at, "right") - 1

    def islands(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, place in it, classes) of every stretch of full windows that begin word after word."""
        cuts = np.nonzero(np.diff(self.place) != 1)[0] + 1
        first = self.place[np.concatenate([[0], cuts])] if len(self.place) else self.place
        for at, doc, classes in zip(first.tolist(), self.document(first).tolist(), np.split(self.class_at, cuts), strict=False):
            yield doc, at - int(self.offset[doc]), classes


def test_slices(items: DataFrame, text: str, id_: str, slice_words: int, window: int) -> Iterator[TestSuffixes]:
    """The test set in slices of about slice_words words at most, dealt by a hash of the text; each is small by construction."""
    items = items.select(F.col(id_).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null and length(t) > 0")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // (6 * slice_words)))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield TestSuffixes([(r.i, bytes(r.t)) for r in part.toLocalIterator()], window)


def hits(docs: DataFrame, items: DataFrame, text: str = "text", id_: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_words, longest_item, longest_item_at,
    longest_doc_at) for each row of docs. The longest verbatim match is with an item that has an id, the first in the
    document of those of its length (then by item, then by place in it); 0 and nulls where there is none.

    With several slices the texts are written once with a row number, every slice reads them and returns rows for hit
    documents alone, and these meet by row number."""
    share = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.col(id_).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    found = f"hit array<int>, items array<string>, best {_BEST}"
    slices = test_slices(items, item_text, item_id, slice_words, window)
    first, second = next(slices), next(slices, None)
    if second is None:
        kind = docs.schema[id_].dataType.simpleString()
        out = rows.mapInArrow(_marker(share(first), every=True), f"doc_id {kind}, n_words long, {found}")
    else:
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        base = materialise(rows.select("row", "t").mapInArrow(_marker(share(first), every=True), f"row long, n_words long, {found}"), "slice")
        parts = base.where("size(hit) > 0").select("row", "hit", "items", "best")
        for test in itertools.chain([second], slices):
            parts = parts.unionByName(materialise(rows.select("row", "t").mapInArrow(_marker(share(test), every=False), f"row long, n_words long, {found}"), "slice").select("row", "hit", "items", "best"))
        joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  a list a slice
        best = F.min_by("best", F.when(F.col("best").isNotNull(), F.struct(-F.col("best.words"), "best.doc_at", "best.item", "best.item_at"))).alias("best")
        met = parts.groupBy("row").agg(joined("hit"), joined("items"), best)
        none = F.lit(None).cast("array<string>")
        out = rows.select("row", "doc_id").join(base.select("row", "n_words"), "row").join(met, "row", "left")
        out = out.withColumns({"hit": F.coalesce("hit", none.cast("array<int>"), F.expr("cast(array() as array<int>)")), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    return out.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
        F.coalesce("best.words", F.lit(0)).cast("long").alias("longest_words"), F.col("best.item").alias("longest_item"), F.col("best.item_at").alias("longest_item_at"), F.col("best.doc_at").alias("longest_doc_at"),
    )


def _pieces(batches, column: int, most: int = SHARD_BYTES):
    """Shards of at most so many bytes of text, or of one text."""
    for b in batches:
        sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in b.column(column).cast(pa.binary())])
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def _marker(shared: Broadcast, every: bool):
    """(key, n_words, hit places, items, longest match) of rows (key, text); all of them, or those hit."""

    @lean
    def each(batches):
        test = shared.value
        for b in _pieces(batches, 1):
            shard = Shard(b.column(1).to_pylist(), test)
            hit, items, best = ([None] * b.num_rows for _ in range(3))

            def add(d: int, match: tuple[int, int, int, int] | None, numbers: np.ndarray, items=items, best=best) -> None:
                items[d] = numbers if items[d] is None else np.union1d(items[d], numbers)
                if match:
                    words, doc_at, item, item_at = match
                    new = (-words, doc_at, item, item_at)  # numbers are in the ids' order
                    best[d] = new if best[d] is None else min(best[d], new)

            for d, at, classes in shard.islands():
                match, numbers = test.story(classes)
                add(d, match and (match[0], at + match[1], *match[2:]), numbers)
            for c, places in shard.short:
                numbers = np.unique(test.item[test.owners(test.of_class(c))])
                numbers = numbers[numbers >= 0]
                docs, first = np.unique(shard.document(places), return_index=True)
                for d, at in zip(docs.tolist(), places[first].tolist(), strict=True):
                    add(d, (int(test.length[c]), at - int(shard.offset[d]), int(numbers[0]), 0) if len(numbers) else None, numbers)
            for d in np.unique(shard.document(np.nonzero(shard.covered)[0])).tolist():
                a = shard.offset[d]
                hit[d] = np.nonzero(shard.covered[a : a + shard.counts[d]])[0].astype(np.int32)
            named = [[] if n is None else [test.ids[i] for i in n.tolist()] for n in items]
            told = [m and {"words": -m[0], "doc_at": m[1], "item": test.ids[m[2]], "item_at": m[3]} for m in best]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(shard.counts, pa.int64()), pa.array([[] if h is None else h for h in hit], pa.list_(pa.int32())), pa.array(named, pa.list_(pa.string())), pa.array(told, _MATCH)], names=[b.schema.names[0], "n_words", "hit", "items", "best"])
            yield out if every else out.filter(pa.array([h is not None for h in hit]))

    return each


def longest_matches(docs: DataFrame, items: DataFrame, text: str = "text", id_: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(item_id, item_at, doc_id, doc_at, n_words): every verbatim match of at least `window` words (or of a whole shorter
    item) that goes on neither before nor after, with its places (words from 0)."""
    dtype = docs.schema[id_].dataType.simpleString()
    slim = docs.select(F.col(id_).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    out = None
    for test in test_slices(items, item_text, item_id, slice_words, window):
        part = slim.mapInArrow(_longest(docs.sparkSession.sparkContext.broadcast(test)), f"item_id string, item_at long, doc_id {dtype}, doc_at long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def _ended(test: TestSuffixes, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first places in the items, first offsets, words) of matches, class by class as they end."""
    before = None
    for offset, places, starts in test.runs(classes):
        if before is not None:
            gone = ~np.isin(before[0] + 1, places[starts < offset])
            if gone.any():
                yield before[0][gone] - (offset - 1 - before[1][gone]), before[1][gone], offset - 1 - before[1][gone] + test.window
        before, last = (places, starts), offset
    yield before[0] - (last - before[1]), before[1], last - before[1] + test.window


def _longest(shared: Broadcast):
    @lean
    def each(batches):
        test = shared.value
        for b in _pieces(batches, 1):
            shard = Shard(b.column(1).to_pylist(), test)

            def rows(doc: int, doc_at: np.ndarray, first: np.ndarray, words: np.ndarray, b=b) -> pa.RecordBatch:
                owner = test.owners(first)
                names = [test.ids[i] if i >= 0 else None for i in test.item[owner].tolist()]
                return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(first - test.begin[owner], pa.int64()), b.column(0).take(pa.array(np.full(len(first), doc))), pa.array(doc_at, pa.int64()), pa.array(words, pa.int64())], names=["item_id", "item_at", "doc_id", "doc_at", "n_words"])

            for d, at, classes in shard.islands():
                for first, offsets, words in _ended(test, classes):
                    yield rows(d, at + offsets, first, words)
            for c, places in shard.short:
                for d, at in zip(shard.document(places).tolist(), places.tolist(), strict=True):
                    own = test.of_class(c)
                    yield rows(d, np.full(len(own), at - shard.offset[d]), own, np.full(len(own), test.length[c]))

    return each


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS, **names) -> DataFrame:
    """docs without the rows that hold a window of some test item."""
    kept, columns = docs, docs.columns
    for test in test_slices(items, names.get("item_text", "text"), names.get("item_id", "item_id"), slice_words, window):
        kept = kept.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(test), columns.index(text)), docs.schema)
    return kept


def _filter(shared: Broadcast, column: int):
    @lean
    def each(batches):
        test = shared.value
        for b in _pieces(batches, column):
            shard = Shard(b.column(column).cast(pa.binary()).to_pylist(), test)
            upto = np.concatenate([[0], np.cumsum(shard.covered)])
            yield b.filter(pa.array(upto[shard.offset[1:] - test.window] == upto[shard.offset[:-1]]))

    return each
