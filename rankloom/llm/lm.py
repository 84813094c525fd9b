"""Language-model scores from sharded Elias-Fano n-gram tries.

Tokens are the white-space words of the A-Z-lower-cased text and one end; a text begins with a start. Every n-gram of the
training documents up to `order` words is counted, none is pruned. P1(w) = (c(w) + 1) / (N + V + 1); above,
P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), where h' drops the oldest word and m is the level's prior; a context that
training never met hands down P(w | h').

A task codes its texts once, in batches of bounded size whose words are numbered. Level by level the batches ask for what
they don't know: a request is (context node, word node, count in this batch's training texts), each different n-gram once a
batch. Requests are dealt by a hash of the context; a context that holds too much of the corpus for one shard is dealt
further by its words. Within a request contexts and their words ascend, and the nodes of an answer ascend with them: gaps
travel instead of numbers. A shard adds the counts up and builds its trie level: the contexts in order, monotone pointers to
their successors, the successors themselves (both Elias-Fano sequences), and for each the smoothed relative frequency
c(hw) / (c(h) + m) as a byte into a logarithmic code book. The level is laid out in one buffer, mapped from an unlinked
scratch file and queried by a successor search within the context. A shard answers with that byte, and with count and node
number, which is the context of the next level. Where only one batch holds a context, its own counts are the corpus's,
and it needn't ask. What travels grows with the corpus; the driver holds five numbers.

Defined cases: null counts as empty: one token, the end; an empty training set has N = V = 0; documents with a null id
count as id '' for the fold; repeated rows are kept and count as often; an empty table gives an empty result; extra
columns are ignored. Words are told apart by 63 bits of XXH64.
"""

from __future__ import annotations

import itertools
import mmap
import tempfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucketed, crc_mod

ORDER, PRIORS, FOLDS, HELD = 3, (16.0, 4.0), 7, 2
#: Tokens of the corpus for each shard, tokens and different words of a batch.
SHARD_TOKENS, BATCH_TOKENS, BATCH_WORDS = 1_500_000, 1_000_000, 250_000
END, START = b"", (1 << 62) + 1  # no word is empty; no node has the start's number
_STEP = 9.0 / 254
#: What a byte stands for: 0 is an n-gram not met, 255 is certainty.
BOOK = np.concatenate([[0.0], 10.0 ** ((np.arange(1, 256) - 255) * _STEP)])
#: Place of the k-th set bit of each byte, eight for each byte.
_SELECT = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint64).ravel()
#: Text of the documents that are split at once.
_GROUP_BYTES = 1 << 20
_PACK, _UNPACK = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def quantised(share: np.ndarray) -> np.ndarray:
    """Relative frequencies as bytes into the code book."""
    with np.errstate(divide="ignore"):
        code = np.rint(255 + np.log10(share) / _STEP)
    return np.where(share > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


def _window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64 bits from each place on."""
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    return words[word] >> shift | words[word + 1] << np.uint64(1) << (np.uint64(63) - shift)


class EliasFano:
    """A non-decreasing sequence below `universe`: low bits packed, high bits unary with counts by word."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.ones = n, low, lows, highs, ones
        self.zeros = np.arange(len(highs), dtype=np.int64) * 64 - ones  # zeros before each word

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low = max(0, int(universe // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        lows = np.zeros((n * low + 63) // 64 + 2, np.uint64)
        if low and n:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            x, word, shift = v & np.uint64((1 << low) - 1), (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(lows, word, x << shift)
            over = shift + np.uint64(low) > 64
            np.bitwise_or.at(lows, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros((n + (universe >> low)) // 64 + 2, np.uint64)
        np.bitwise_or.at(highs, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(highs), dtype=np.int64)])[:-1]
        return EliasFano(n, low, lows, highs, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        return (_window(self.lows, i * self.low) & np.uint64((1 << self.low) - 1)).view(np.int64)

    @staticmethod
    def _in_word(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) set bit of each word: its byte by all bytes' running counts at once, then a table."""
        u, k = np.uint64, k.astype(np.uint64)
        sums = bits - (bits >> u(1) & u(0x5555555555555555))
        sums = (sums & u(0x3333333333333333)) + (sums >> u(2) & u(0x3333333333333333))
        sums = (sums + (sums >> u(4)) & u(0x0F0F0F0F0F0F0F0F)) * u(0x0101010101010101)
        past = (k * u(0x0101010101010101) | u(0x8080808080808080)) - sums & u(0x8080808080808080)
        place = np.bitwise_count(past).astype(np.uint64) << u(3)
        k -= sums << u(8) >> place & u(255)
        return (place + _SELECT[((bits >> place & u(255)) << u(3) | k).astype(np.int64)]).astype(np.int64)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below `high`: the ones before the zero number high - 1."""
        k = high - 1
        out = np.zeros(len(high), np.int64)
        some = np.nonzero(k >= 0)[0]
        word = np.searchsorted(self.zeros, k[some], "right") - 1
        place = self._in_word(~self.highs[word], k[some] - self.zeros[word])
        out[some] = word * 64 + place - k[some]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + self._in_word(self.highs[word], i - self.ones[word])
        return ((place - i) << self.low) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each x, or -1: a successor search among the values that share its high bits, within the places
        from `first` to `end` where these are given."""
        high, want = x >> self.low, x & ((1 << self.low) - 1)
        new = np.ones(len(x), bool)
        np.not_equal(high[1:], high[:-1], out=new[1:])
        run = np.cumsum(new) - 1  # neighbours often share their high bits
        high = high[new]
        a = self._below(high)
        ones = _window(self.highs, a + high)
        upto = a + np.bitwise_count(ones & ~ones - np.uint64(1))  # as many as there are ones before the next zero
        full = np.nonzero(upto - a == 64)[0]
        upto[full] = self._below(high[full] + 1)
        a, b = a[run], upto[run]
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, end)
        open_ = np.nonzero(b - a > 1)[0]
        low, high, aim = a[open_], b[open_], want[open_]
        while open_.size:  # until one value is left
            mid = (low + high - 1) >> 1
            less = self._low(mid) < aim
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid + 1)
            more = high - low > 1
            a[open_[~more]] = low[~more]
            open_, low, high, aim = open_[more], low[more], high[more], aim[more]
        hit = np.nonzero(a < b)[0]
        hit = hit[self._low(a[hit]) == want[hit]]
        out = np.full(len(x), -1, np.int64)
        out[hit] = a[hit]
        return out


class Level:
    """One level of a shard's trie over one buffer: contexts, pointers, successors, bytes."""

    def __init__(self, buffer):
        (self.words,), at, parts = np.frombuffer(buffer, np.int64, 1).tolist(), 8, []
        for _ in range(4):  # contexts, vocabulary, pointers, successors
            n, low, lows, highs = (int(x) for x in np.frombuffer(buffer, np.int64, 4, at))
            at += 32
            arrays = []
            for kind, size in ((np.uint64, lows), (np.uint64, highs), (np.int64, highs)):
                arrays.append(np.frombuffer(buffer, kind, size, at))
                at += 8 * size
            parts.append(EliasFano(n, low, *arrays))
        self.contexts, self.vocabulary, self.pointers, self.successors = parts
        self.code = np.frombuffer(buffer, np.uint8, self.successors.n, at)

    @staticmethod
    def pack(contexts: np.ndarray, context: np.ndarray, words: np.ndarray, word: np.ndarray, count: np.ndarray, whole: np.ndarray, prior: float) -> bytes:
        """Successors by context and word, both as places in sorted tables of which some may have none; the successors'
        counts and those of their contexts."""
        has, rank = _numbered(context, len(contexts))
        used, number = _numbered(word, len(words))
        pointers = np.searchsorted(rank, np.arange(len(has) + 1))
        out = [np.array([len(used)], np.int64).tobytes()]
        for values, universe in ((contexts[has], 1 << 63), (words[used], 1 << 63), (pointers, len(rank) + 1), (rank * len(used) + number, max(1, len(has) * len(used)))):
            e = EliasFano.build(values, universe)
            out += [np.array([e.n, e.low, len(e.lows), len(e.highs)], np.int64).tobytes(), e.lows.tobytes(), e.highs.tobytes(), e.ones.tobytes()]
        return b"".join([*out, quantised(count / (whole + prior)).tobytes(), bytes(8)])

    def find(self, contexts: np.ndarray, context: np.ndarray, words: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The byte of each (contexts[context], words[word]): 0 where the word is no successor of the context."""
        out = np.zeros(len(word), np.uint8)
        if not self.successors.n or not len(word):
            return out
        rank, place = self.contexts.find(contexts), self.vocabulary.find(words)
        known = np.maximum(rank, 0)
        start, end = self.pointers.get(known), self.pointers.get(known + 1)
        ask = np.nonzero((rank[context] >= 0) & (place[word] >= 0))[0]
        c = context[ask]
        found = self.successors.find(rank[c] * self.words + place[word[ask]], start[c], end[c])
        hit = found >= 0
        out[ask[hit]] = self.code[found[hit]]
        return out


def _numbered(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which places of a table occur, ascending; each one's number among these)."""
    there = np.zeros(size, bool)
    there[places] = True
    return np.nonzero(there)[0], (np.cumsum(there) - 1)[places]


def mapped(data: bytes) -> mmap.mmap:
    """The buffer, mapped from an unlinked scratch file: a shard's level needn't stay in memory while it is asked."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different numbers from 0, ascending; each one's place among them): one plain sort where number and position fit
    into a word together."""
    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits > 63:
        return np.unique(x, return_inverse=True)
    both = x.astype(np.int64)
    both <<= bits
    both |= np.arange(len(x))
    both.sort()
    value = both >> bits
    new = np.ones(len(x), bool)
    np.not_equal(value[1:], value[:-1], out=new[1:])
    which = np.empty(len(x), np.int32)
    both &= (1 << bits) - 1
    which[both] = np.cumsum(new, dtype=np.int32) - 1
    return value[new], which


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 as compressed bytes of the least width, all low bytes first."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + _PACK.compress(np.ascontiguousarray(planes))


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACK.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, data[0]):
        out |= planes[k].astype(np.int64) << 8 * k
    return out


def _gaps(x: np.ndarray, heads: np.ndarray | None = None) -> bytes:
    """Ascending numbers as packed gaps; where they begin again at each of `heads`, the numbers there come first."""
    if heads is None:
        return _packed(np.diff(x, prepend=0))
    inner = np.ones(len(x), bool)
    inner[heads] = False
    return _packed(np.concatenate([x[heads], np.diff(x, prepend=0)[inner]]))


def _from_gaps(data: bytes, heads: np.ndarray | None = None) -> np.ndarray:
    gaps = _unpacked(data)
    if heads is None:
        return np.cumsum(gaps)
    out, inner = np.empty(len(gaps), np.int64), np.ones(len(gaps), bool)
    inner[heads] = False
    out[heads], out[inner] = gaps[: len(heads)], gaps[len(heads) :]
    sums = np.cumsum(out)
    return sums - np.repeat(sums[heads] - out[heads], np.diff(np.append(heads, len(out))))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """63 bits that depend on both numbers."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(32)) >> np.uint64(1)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of words of each text, each word's place in a list of different words, that list): A-Z lower-cased, cut at
    white space. The list may hold an empty word too, which no place refers to. Arrow's ASCII functions need no valid UTF-8."""
    large = pa.types.is_large_binary(texts.type)
    texts = pc.fill_null(texts, b"").view(pa.large_string() if large else pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    place, words = coded.indices.to_numpy(), coded.dictionary.view(pa.large_binary() if large else pa.binary()).to_numpy(zero_copy_only=False).tolist()
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in words:  # before leading and after trailing white space
        some = place != words.index(b"")
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[some], minlength=len(lens))
        place = place[some]
    return lens, place, words


def _coder(batch_tokens: int, batch_words: int):
    """Texts as batches: documents, the hashes of their words in order, and each token's place among these."""

    def each(batches):
        number = itertools.count(TaskContext.get().partitionId() << 32)
        ids, held, lens, tokens, size, words = [], [], [], [], 0, None

        def batch():
            hashes, seq = np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(42)), np.uint64, len(words)), np.concatenate(tokens)
            order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")  # small numbers for common words
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            hashes, seq = (hashes >> np.uint64(1)).astype(np.int64)[order], rank[seq]
            return pa.RecordBatch.from_arrays(
                [pa.array([next(number)]), pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([np.concatenate(lens)], pa.list_(pa.int32())), pa.array([_packed(hashes)], pa.binary()), pa.array([_packed(seq)], pa.binary())],
                names=["uid", "ids", "held", "lens", "hashes", "seq"],
            )

        for b in batches:
            kind = b.column(0).type
            texts = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.nonzero(np.diff(texts // min(_GROUP_BYTES, batch_tokens, 4 * batch_words)))[0] + 1
            for i, j in itertools.pairwise([0, *cuts.tolist(), b.num_rows]):
                if words is None:
                    words = defaultdict(itertools.count().__next__)
                group = b.slice(i, j - i)
                n, place, different = _split(group.column(2))
                ends = np.cumsum(n + 1) - 1
                seq = np.full(len(place) + len(n), words[END], np.int32)
                word = np.ones(len(seq), bool)
                word[ends] = False
                seq[word] = np.fromiter(map(words.__getitem__, different), np.int32, len(different))[place]
                tokens.append(seq)
                ids += group.column(0).to_pylist()
                held += group.column(1).to_pylist()
                lens.append(n + 1)
                size += len(seq)
                if size >= batch_tokens or len(words) >= batch_words:
                    yield batch()
                    ids, held, lens, tokens, size, words = [], [], [], [], 0, None
        if ids:
            yield batch()

    return each


class Batch:
    """A coded batch: for each level the different n-grams, by context and word, and which one ends at each token.

    Places are those of start and tokens in turn. Level 1 holds the words; the start is one more, with the last number."""

    def __init__(self, lens, held, hashes: bytes, seq: bytes):
        self.hashes = _unpacked(hashes)
        lens = np.asarray(lens)
        self.docs, self.width = len(lens), len(self.hashes) + 1
        self.starts = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        self.token = np.ones(int(lens.sum()) + len(lens), bool)
        self.token[self.starts] = False
        first = np.full(len(self.token), self.width - 1, np.int32)
        first[self.token] = _unpacked(seq)
        self.doc = np.repeat(np.arange(self.docs, dtype=np.int32), lens + 1)
        self.learns = ~np.repeat(np.asarray(held, bool), lens + 1)
        self.word = first
        self.grams = [first]  # by level: the n-gram that ends at each place, or -1
        self.context, self.last = [None], [np.arange(self.width)]
        self.own = [np.bincount(first[self.learns], minlength=self.width)]

    def level(self) -> None:
        """Adds the next level."""
        before = self.grams[-1]
        at = np.nonzero(self.token[1:] & (before[:-1] >= 0))[0] + 1
        bits = self.width.bit_length()
        key, which = _different(before[at - 1].astype(np.int64) << bits | self.word[at])
        gram = np.full(len(self.word), -1, np.int32)
        gram[at] = which
        self.grams.append(gram)
        self.context.append((key >> bits).astype(np.int32))
        self.last.append((key & ((1 << bits) - 1)).astype(np.int32))
        self.own.append(np.bincount(which[self.learns[at]], minlength=len(key)))

    def renumber(self, order: np.ndarray) -> None:
        """Numbers the n-grams of the last level anew, in the given order."""
        rank = np.empty(len(order) + 1, np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        rank[-1] = -1  # no n-gram
        self.grams[-1], self.own[-1] = rank[self.grams[-1]], self.own[-1][order]
        if len(self.grams) == 1:
            self.word, self.hashes = self.grams[0], self.hashes[order[:-1]]
        else:
            self.context[-1], self.last[-1] = self.context[-1][order], self.last[-1][order]


class Known:
    """What a batch has been told, by level: node, count and byte of each n-gram. A node is odd where another batch holds
    the n-gram too; else all its occurrences, and those of what goes on from it, are here. A level that has been told is
    numbered by node, so that the next level's n-grams ascend by their nodes as they are found."""

    def __init__(self, batch: Batch, answers: list, priors, totals: dict):
        self.batch, self.priors, self.totals = batch, priors, totals
        self.node, self.count, self.code = [], [], []
        for told in answers:
            self._learn(told)

    def asked(self, level: int) -> np.ndarray:
        """Which n-grams of a level the corpus must be asked for: those whose contexts occur elsewhere too."""
        b = self.batch
        if level == 1:
            return np.arange(b.width - 1)
        c = b.context[level - 1]
        return np.nonzero((self.node[level - 2][c] & 1 > 0) & (self.count[level - 2][c] > 0))[0]

    def shards(self, level: int, asked: np.ndarray, shards: int) -> np.ndarray:
        b = self.batch
        if level == 1:
            return (_mixed(b.hashes, np.zeros(1, np.int64)) % np.uint64(shards)).astype(np.int64)
        c = b.context[level - 1][asked]
        heads = np.nonzero(np.diff(c, prepend=-1))[0]
        node, count = self.node[level - 2][c[heads]], self.count[level - 2][c[heads]]
        fan = np.diff(np.append(heads, len(c)))
        out = np.repeat((_mixed(node, np.zeros(1, np.int64)) % np.uint64(shards)).astype(np.int64), fan)
        ways = np.maximum(1, count * 4 * shards // max(1, self.totals["tokens"])).astype(np.uint64)
        if (ways > 1).any():
            ways, node = np.repeat(ways, fan), np.repeat(node, fan)
            wide = np.nonzero(ways > 1)[0]
            word = _mixed(self.node[0][b.last[level - 1][asked[wide]]], np.full(1, 7))
            out[wide] = (_mixed(node[wide], word % ways[wide]) % np.uint64(shards)).astype(np.int64)
        return out

    def dealt(self, level: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(the n-grams to be asked for, by shard, then context and word as the shards number them; where each shard's begin)."""
        asked = self.asked(level)
        shard = self.shards(level, asked, shards)
        if level == 1:
            order = np.argsort(self.batch.hashes)
            asked, shard = asked[order], shard[order]
        few = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)  # numpy sorts 16 bits in one pass
        return asked[np.argsort(few, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])

    def _learn(self, told) -> None:
        """Answers of the shards to this batch, for the next level: rows of (shard, nodes, counts, codes)."""
        b, level = self.batch, len(self.node) + 1
        if level > 1:
            b.level()
        n = len(b.own[level - 1])
        count, node, code = b.own[level - 1].copy(), np.zeros(n, np.int64), np.zeros(n, np.uint8)
        if level > 1:
            whole = self.count[level - 2][b.context[level - 1]]
            code = quantised(count / (whole + self.priors[level - 2]))
        asked, bounds = self.dealt(level, self.totals["shards"])
        for s, nodes, counts, codes in told or ():
            at = asked[bounds[s] : bounds[s + 1]]
            if counts:
                numbers = _unpacked(nodes)
                node[at] = numbers if level == 1 else np.where(numbers > 0, (np.cumsum(numbers) * self.totals["shards"] + s) * 2 + 1, 0)
                count[at] = _unpacked(counts)
            if codes:
                code[at] = _unpacked(codes)
        if level == 1:
            node[-1], count[-1] = START, self.totals.get("texts", 0)
        if level <= len(self.priors):  # the last level is no context
            has = np.nonzero(node)[0]
            order = np.concatenate([np.nonzero(node == 0)[0], has[np.argsort(node[has])]])
            b.renumber(order)
            node, count, code = node[order], count[order], code[order]
        self.node.append(node)
        self.count.append(count)
        self.code.append(code)

    def requests(self, uid: int, shards: int):
        """Rows of (shard, uid, contexts, their counts, their numbers of words, words, counts of this batch)."""
        b, level = self.batch, len(self.node) + 1
        if level > 1:
            b.level()
        asked, bounds = self.dealt(level, shards)
        for s in np.nonzero(np.diff(bounds))[0].tolist():
            at = asked[bounds[s] : bounds[s + 1]]
            own = b.own[level - 1][at]
            if level == 1:
                yield s, uid, _packed(np.zeros(1, np.int64)), _packed(np.zeros(1, np.int64)), _packed(np.array([len(at)])), _gaps(b.hashes[at]), _packed(own)
                continue
            c = b.context[level - 1][at]
            heads = np.concatenate([[0], np.nonzero(np.diff(c))[0] + 1])
            fan = np.diff(np.append(heads, len(c)))
            yield s, uid, _gaps(self.node[level - 2][c[heads]]), _packed(self.count[level - 2][c[heads]]), _packed(fan), _gaps(self.node[0][b.last[level - 1][at]], heads), _packed(own)

    def scores(self):
        """For each document (tokens, known tokens, base score, score)."""
        b, t = self.batch, self.totals
        log = np.log10((self.count[0][:-1] + 1.0) / (t["tokens"] + t["types"] + 1.0))
        at = np.nonzero(b.token)[0]
        base = log[b.word[at]]
        p = np.append(10.0**log, 0.0)[b.word]
        for k in range(1, len(self.node)):
            has = np.nonzero(b.grams[k] >= 0)[0]
            gram = b.grams[k][has]
            whole = self.count[k - 1][b.context[k]]
            m = self.priors[k - 1]
            p[has] = BOOK[self.code[k]][gram] + np.where(whole > 0, m / (whole + m), 1.0)[gram] * p[has]
        total = lambda w: np.bincount(b.doc[at], w, b.docs)
        known = (self.count[0][b.word[at]] > 0).astype(float)
        return total(np.ones(len(at))).astype(np.int64), total(known).astype(np.int64), total(base), total(np.log10(np.minimum(p[at], 1.0)))


_REQUEST = "shard int, uid long, contexts binary, wholes binary, fans binary, words binary, own binary"
_ANSWER = "uid long, shard int, nodes binary, counts binary, codes binary, tokens long, types long"


def _answering(level: int, prior: float, shards: int, last: bool):
    """A shard: adds up the counts of all batches, builds its trie level and answers each batch."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        part = lambda name: [_unpacked(r[name]) for r in rows]
        fans, own, contexts = part("fans"), part("own"), [_from_gaps(r["contexts"]) for r in rows]
        words = [_from_gaps(r["words"], np.cumsum(f) - f) for r, f in zip(rows, fans, strict=True)]
        bounds = np.cumsum([0, *map(len, words)])
        different, of = _different(np.concatenate(contexts))
        whole = np.zeros(len(different), np.int64)
        whole[of] = np.concatenate(part("wholes"))
        vocabulary, number = _different(np.concatenate(words))
        bits = len(vocabulary).bit_length()
        key, which = _different(np.repeat(of, np.concatenate(fans)).astype(np.int64) << bits | number)
        count = np.bincount(which, np.concatenate(own), len(key)).astype(np.int64)
        context, word = (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)
        del number, key
        codes, seen = None, count > 0
        if level > 1:
            trie = Level(mapped(Level.pack(different, context[seen], vocabulary, word[seen], count[seen], whole[context[seen]], prior)))
            codes = trie.find(different, context, vocabulary, word)
        nodes = np.zeros(len(count), np.int64)
        if not last:
            shared = np.bincount(which, minlength=len(count)) > 1
            if level == 1:  # the commonest words have the least numbers: these compress best
                nodes[np.argsort(-count, kind="stable")] = np.arange(len(count)) * shards + rows[0]["shard"]
                nodes = nodes * 2 + shared
            else:  # numbered in the order of the requests
                nodes = np.cumsum(shared) * shared
        out = []

        def numbers(x: np.ndarray) -> bytes:
            """Above the words, gaps of those that other batches hold too, 0 for the rest."""
            if level > 1:
                held = x > 0
                x = x.copy()
                x[held] = np.diff(x[held], prepend=0)
            return _packed(x)

        for k, r in enumerate(rows):
            at = which[bounds[k] : bounds[k + 1]]
            out.append((r["uid"], r["shard"], None if last else numbers(nodes[at]), None if last else _packed(count[at]), None if codes is None else _packed(codes[at]), int(count.sum()) if not k else 0, int(seen.sum()) if not k else 0))
        names = ["uid", "shard", "nodes", "counts", "codes", "tokens", "types"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return answer


def _known(row: dict, levels: int, priors, totals: dict) -> Known:
    told = [[(a["shard"], a["nodes"], a["counts"], a["codes"]) for a in row[f"told{k}"] or ()] for k in range(1, levels + 1)]
    return Known(Batch(row["lens"], row["held"], row["hashes"], row["seq"]), told, priors, totals)


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def scores(docs: DataFrame, text: str = "text", id_: str = "doc_id", folds: int = FOLDS, held: int = HELD, order: int = ORDER, priors=PRIORS, shard_tokens: int = SHARD_TOKENS, batch_tokens: int = BATCH_TOKENS, batch_words: int = BATCH_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    kind = docs.schema[id_].dataType.simpleString()
    slim = docs.select(F.col(id_).alias("doc_id"), (crc_mod(F.col(id_), folds) == held).alias("held_out"), F.col(text).cast("binary").alias("t"))
    coded = bucketed(slim.mapInArrow(_coder(batch_tokens, batch_words), f"uid long, ids array<{kind}>, held array<boolean>, lens array<int>, hashes binary, seq binary"), "uid", "coded")
    size = coded.select(F.expr("aggregate(lens, 0L, (a, x) -> a + x)").alias("n"), F.expr("size(filter(held, x -> not x))").cast("long").alias("texts")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")).first()
    totals = {"shards": max(1, -(-size.n // shard_tokens)), "texts": size.texts, "tokens": 0, "types": 0}
    known = coded
    for level in range(1, order + 1):

        def ask(batches, level=level, totals=dict(totals)):
            for row in _rows(batches):
                rows = list(_known(row, level - 1, priors, totals).requests(row["uid"], totals["shards"]))
                if rows:
                    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "uid", "contexts", "wholes", "fans", "words", "own"])

        prior = priors[level - 2] if level > 1 else 1.0
        answers = known.mapInArrow(ask, _REQUEST).groupBy("shard").applyInArrow(_answering(level, prior, totals["shards"], level == order and level > 1), _ANSWER)
        told = answers.groupBy("uid").agg(F.collect_list(F.struct("shard", "nodes", "counts", "codes")).alias(f"told{level}"), F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
        told = bucketed(told, "uid", f"level{level}")
        if level == 1:
            found = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
            totals |= {"tokens": found.tokens, "types": found.types}
        known = known.join(told.drop("tokens", "types"), "uid", "left")

    id_kind = to_arrow_type(docs.schema[id_].dataType)

    def each(batches):
        for row in _rows(batches):
            columns = _known(row, order, priors, totals).scores()
            n = len(row["ids"])
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], id_kind), pa.array(row["held"]), pa.array(columns[0]), pa.array(columns[1]), pa.array(np.full(n, totals["tokens"])), pa.array(columns[2]), pa.array(columns[3])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.mapInArrow(each, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
