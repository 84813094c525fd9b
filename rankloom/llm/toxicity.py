"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

Strings of letters are compared by the three-letter subsequences they share, each weighted by decay ** (its span), so a
word still resembles an insult with letters inserted, repeated or left out. A sentence's units are its words, words spelled
letter by letter, and pairs of neighbouring words that may make an insult together: the parts of a known insult, or of a
known insult of two words that are harmless apart.

Training takes at most about `positives` toxic and `negatives` other labelled documents by a hash of the id, cut into
sentences. Seeds are words, and in documents that these leave unexplained word pairs, that mark toxic documents (a greedy
cover: what seeds already explain does not count again). A sentence of a toxic document that holds a seed, or a word close
to one, is a positive sentence with that unit as its witness; its other sentences are not used, as their label is unknown.
Every sentence of another document is negative with all its units: at most `ordinary` of these at random, and in each
round the `hard` sentences whose most suspicious unit the machine finds worst. Seeds, units like them and ordinary words
are the landmarks; the machine is trained on the landmark features by squared hinge loss. A document scores as its most
suspicious sentence, through a logistic curve fitted on the training documents.

The subsequence kernel has an explicit feature for each three letters, so the trained machine is one table of weights
over them; scoring needs neither landmarks nor any other document. Texts are scored whole, in the task that reads them.

Defined cases: null and empty texts score as texts without a word; without labels of both kinds every score is 0; repeated
rows and null ids are kept (null ids count as an empty id text for the fold); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations, groupby, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

POSITIVES, NEGATIVES, LANDMARKS, ORDINARY, HARD, ATTEMPTS, DECAY, FOLDS = 1_500, 3_000, 80, 8_000, 3_000, 4, 0.6, 5
LETTERS, WIDTH, REMEMBER = 64, 20, 400_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»…–—“”‘’"
#: Characters' codes: 0 pads, 1 any mark inside a word, 2-11 digits, 12-37 a-z, the rest other letters by their code.
_CODE = np.ones(0x10000, np.uint8)
for _c in range(0x10000):
    _x = chr(_c)
    _CODE[_c] = 12 + _c - 97 if "a" <= _x <= "z" else 2 + _c - 48 if "0" <= _x <= "9" else 38 + _c % 26 if _c > 127 and _x.isalpha() else 1
_SHAPES = {n: np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3) for n in range(WIDTH + 1)}


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased, without marks at their ends; runs of three or more single letters count as one
    word in addition."""
    out, run = [], []
    for w in text.lower().split():
        w = w.strip(_EDGES)
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
        if w:
            out.append(w)
    if len(run) > 2:
        out.append("".join(run))
    return out


def pieces(word: str) -> list[str]:
    """A word as windows of at most WIDTH characters that overlap by half."""
    if len(word) <= WIDTH:
        return [word]
    return [word[k : k + WIDTH] for k in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def features(words: list[str], decay: float = DECAY):
    """For words of at most WIDTH characters, in groups of one length: (their numbers, feature ids, feature weights, norms)."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, at in by.items():
        shape = _SHAPES[n]
        if not len(shape):
            continue
        step = max(1, 1_000_000 // len(shape))
        for k in range(0, len(at), step):
            part = np.array(at[k : k + step])
            points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "replace"), np.uint32).reshape(len(part), n)
            c = _CODE[np.minimum(points, 0xFFFF)].astype(np.int64)
            ids = (c[:, shape[:, 0]] * LETTERS + c[:, shape[:, 1]]) * LETTERS + c[:, shape[:, 2]]
            yield part, ids, decay ** (shape[:, 2] - shape[:, 0] + 1), _norms(c, decay)


def _norms(c: np.ndarray, decay: float) -> np.ndarray:
    """sqrt(k(w, w)) of words of one length, by the kernel's recursion over both copies."""
    n = c.shape[1]
    same = (c[:, :, None] == c[:, None, :]).astype(np.float64)
    reach = decay ** (np.arange(n)[None, :] - np.arange(n)[:, None] - 1.0) * (np.arange(n)[None, :] > np.arange(n)[:, None])
    m = same * decay**2  # subsequences of one letter that end at (i, j)
    for _ in range(2):
        m = same * decay**2 * np.einsum("ia,wij,jb->wab", reach, m, reach, optimize=True)
    return np.sqrt(np.maximum(m.sum(axis=(1, 2)), 1e-12))


def bare(word: str) -> str:
    """A word's letters and digits, doubled ones once."""
    return "".join(c for c, _ in groupby(filter(str.isalnum, word)))


class Machine:
    """Weights over three-letter subsequences, the pairs of words it joins, and the curve that makes a document's score of
    its margin."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, centre: float, decay: float, joined: frozenset[tuple[str, str]] = frozenset()):
        self.weights, self.bias, self.slope, self.centre, self.decay = weights.astype(np.float32), bias, slope, centre, decay
        self.joined, self.first = joined, {a for a, _ in joined}
        self.met: dict[str, float] = {}
        self.bare: dict[str, str] = {}

    def units(self, text: str) -> set[str]:
        """A text's words, and the pairs of neighbours that the machine joins."""
        words = words_of(text)
        out, first = set(words), self.first
        if first:
            known = self.bare
            if len(known) > REMEMBER:
                known.clear()
            known.update((w, bare(w)) for w in out if w not in known)
            for a, b in pairwise(words):
                if known[a] in first and (known[a], known[b]) in self.joined and len(a) + len(b) <= 2 * WIDTH:
                    out.add("".join(filter(str.isalnum, a + b)))
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for at, ids, weight, norm in features(words, self.decay):
            out[at] += (self.weights[ids] @ weight.astype(np.float32)) / norm
        return out

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """The largest margin in each text."""
        met, cut = self.met, [self.units(t or "") for t in texts]
        if len(met) > REMEMBER:
            met.clear()
        fresh = list({w for c in cut for w in c if w not in met})
        small = [(w, p) for w in fresh for p in pieces(w)]
        for (w, _), m in zip(small, self.margins([p for _, p in small]).tolist(), strict=True):
            met[w] = max(m, met.get(w, -1e9))
        return np.array([max((met[w] for w in c), default=self.bias) for c in cut])

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.centre), -60, 60)))


def kernel(a: list[str], b: list[str], decay: float = DECAY) -> np.ndarray:
    """Normalised kernel values of short words a against b."""
    out = np.zeros((len(a), len(b)))
    for k, ids, weight, norm in features(b, decay):
        for row, i, m in zip(k, ids, norm, strict=True):
            table = np.zeros(LETTERS**3, np.float32)
            np.add.at(table, i, weight.astype(np.float32) / m)
            for at, own, w, n in features(a, decay):
                out[at, row] = (table[own] @ w.astype(np.float32)) / n
    return out


def seeds_of(toxic: list[set[str]], clean: Counter, n_clean: int, least: int = 2, lift: float = 12.0, explained: float | None = None) -> list[str]:
    """Greedy cover of the toxic documents by words that are rare in others; then other such words that many unlike
    documents hold. Documents with the same least word by hash count once: near copies share all their words."""
    held: dict[str, set[int]] = {}
    unlike: dict[str, set[int]] = {}
    for k, words in enumerate(toxic):
        mark = min((crc32(w.encode()) for w in words), default=0)
        for w in words:
            held.setdefault(w, set()).add(k)
            unlike.setdefault(w, set()).add(mark)
    rate = lambda w, n: (n / max(1, len(toxic))) / ((clean[w] + 0.5) / max(1, n_clean))
    held = {w: d for w, d in held.items() if len(d) >= least and len(w) > 2 and rate(w, len(d)) >= lift and len(unlike[w]) >= max(least, 0.3 * len(d))}
    left, out = set(range(len(toxic))), []
    common = [w for w, d in held.items() if len(unlike[w]) >= max(6, least, 0.01 * len(toxic)) and not clean[w]]
    while held and left:
        best = max(held, key=lambda w: (len(held[w] & left) * min(1.0, rate(w, len(held[w])) / 60), len(held[w]), w))
        gain = held.pop(best) & left
        if len(gain) < max(least, 0.003 * len(toxic) if explained is None else explained):
            break
        out.append(best)
        left -= gain
    return list(dict.fromkeys(out + sorted(common, key=lambda w: (-len(unlike[w]), w))))


def _loosened(word: str, random: np.random.Generator) -> list[str]:
    """The word with a mark or letter inserted, a letter doubled, and marks between all letters."""
    k = int(random.integers(1, max(2, len(word))))
    return [word[:k] + random.choice(list(".-_*")) + word[k:], word[:k] + word[k - 1] + word[k:], (".-_*"[k % 4]).join(word)]


def split_pairs(words: list[str]) -> set[tuple[str, str]]:
    """The two parts, of two letters or more each, that a break may leave of a word of five or more."""
    return {(w[:k], w[k:]) for x in words for w in [bare(x)] if len(w) > 4 for k in range(2, len(w) - 1)}


def fit(toxic: list[list[str]], clean: list[list[str]], landmarks: int = LANDMARKS, decay: float = DECAY, ordinary: int = ORDINARY, hard: int = HARD, seed: int = 11) -> Machine | None:
    """Trains on documents labelled toxic and others, each a list of sentences."""
    random = np.random.default_rng(seed)
    met: dict[str, str] = {}
    once = lambda d: [[met.setdefault(w, w) for w in words_of(s)] for s in d]  # noqa: E731  words repeat: each is held once
    positive, cut = list(map(once, toxic)), list(map(once, clean))
    bags, held = [{w for s in d for w in s} for d in positive], len(cut)
    counts, negative = Counter(w for d in cut for w in {w for s in d for w in s}), [s for d in cut for s in d]
    seeds = [w for w in seeds_of(bags, counts, held) if len(w) <= WIDTH]
    if not counts:
        return None
    # documents without a seed word may hold a pair of words that are harmless apart
    left = [k for k, b in enumerate(bags) if not b.intersection(seeds)]
    pairs = [{f"{a} {b}" for s in positive[k] for a, b in pairwise(s) if len(a) + len(b) <= WIDTH} for k in left]
    rare = Counter(x for p in pairs for x in p)
    apart = Counter(x for s in negative for x in {f"{a} {b}" for a, b in pairwise(s)} if x in rare)
    enough = max(5, len(toxic) // 100)  # a pair of words is much likelier than a word to be an accident
    phrases = seeds_of(pairs, apart, held, least=enough, explained=enough) if len(pairs) >= enough else []
    if not seeds and not phrases:
        return None
    # witnesses: seeds, and words of toxic documents alone that are close to one
    own = Counter(w for b in bags for w in b)
    near = [w for w, n in sorted(own.items()) if n >= 2 and not counts[w] and 3 <= len(w) <= WIDTH]
    close = kernel(near, seeds, decay) if near and seeds else np.zeros((len(near), 1))
    words = list(dict.fromkeys(seeds + [w for w, c in zip(near, close, strict=True) if c.max() >= 0.62]))
    joined = frozenset(split_pairs(words) | {tuple(bare(w) for w in x.split(" ")) for x in phrases})
    witness = list(dict.fromkeys(words + [x.replace(" ", "") for x in phrases]))
    # positive sentences by their witnesses: a unit counts with the sentences that hold it
    holds = Counter(w for d in positive for s in d for w in {*s, *(a + b for a, b in pairwise(s))})
    plain = sorted({w for s in negative for w in s if 3 <= len(w) <= WIDTH})
    random.shuffle(plain)
    best, texts = None, tuple([" \n ".join(d) for d in part] for part in (toxic, clean))
    for _ in range(ATTEMPTS):
        machine = _trained(witness, np.array([max(1, holds[w]) for w in witness], float), plain, negative, landmarks, decay, ordinary, hard, random, joined)
        m1, m0 = map(machine.documents, texts)
        # the cut with the fewest errors, in the middle of its gap; ties leave clean documents alone
        every = np.unique(np.r_[m1, m0])
        errors = np.array([(m1 < t).sum() / len(m1) + 4 * (m0 >= t).sum() / len(m0) for t in every])
        t = int(np.argmin(errors))
        if best is None or errors[t] < best[0]:
            below = every[every < every[t]]
            centre = (every[t] + below[-1]) / 2 if len(below) else every[t]
            slope = 4.0 / max(0.05, float(np.median(m1[m1 >= centre]) - centre)) if (m1 >= centre).any() else 4.0
            best = errors[t], Machine(machine.weights, machine.bias, slope, float(centre), decay, joined)
        if not errors[t]:
            break
        # a rare witness that clean documents' most suspicious units resemble is an accident of copies
        suspects = [max(machine.units(texts[1][k]), key=machine.met.__getitem__) for k in np.nonzero(m0 >= np.quantile(m1, 0.02))[0]]
        suspects = [w for w in dict.fromkeys(suspects) if 3 <= len(w) <= WIDTH][:HARD]
        blamed = {witness[k] for k in kernel(suspects, witness, decay).argmax(axis=1)} if suspects else set()
        kept = [w for w in witness if w not in blamed or own[w] > 0.01 * len(toxic)]
        if len(kept) in (0, len(witness)):
            break
        witness = kept
    return best[1]


def _trained(witness: list[str], weight: np.ndarray, plain: list[str], negative: list[list[str]], landmarks: int, decay: float, ordinary: int, hard: int, random: np.random.Generator, joined: frozenset) -> Machine:
    """The machine on witnesses and their loosened forms against the units of negative sentences."""
    loose = [x for w in witness for x in _loosened(w, random) if len(x) <= WIDTH]
    chosen = plain[:ordinary]
    order = np.argsort(-weight, kind="stable")
    marks = [witness[k] for k in order[: landmarks // 2]]
    marks += chosen[: landmarks - len(marks)]
    k = kernel(marks, marks, decay)
    values, vectors = np.linalg.eigh(k + 1e-6 * np.eye(len(k)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # features = k(x, marks) @ root
    mark_table = np.zeros((LETTERS**3, len(marks)), np.float32)
    for at, ids, w, norm in features(marks, decay):
        for row, i, m in zip(at, ids, norm, strict=True):
            np.add.at(mark_table[:, row], i, (w / m).astype(np.float32))

    def mapped(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(marks)))
        for at, ids, w, norm in features(words, decay):
            for s in range(0, len(at), 200):
                out[at[s : s + 200]] = np.einsum("wfm,f->wm", mark_table[ids[s : s + 200]], w.astype(np.float32)) / norm[s : s + 200, None]
        return out @ root

    bad = mapped(witness + loose)
    strength = np.concatenate([np.sqrt(weight), np.full(len(loose), 0.5)])
    for _ in range(3):
        z = np.concatenate([bad, mapped(chosen)])
        y = np.r_[np.ones(len(bad)), -np.ones(len(chosen))]
        c = np.r_[strength / strength.sum(), np.full(len(chosen), 3.0 / len(chosen))]
        v, b = _squared_hinge(z, y, c)
        machine = Machine(mark_table @ (root @ v).astype(np.float32), b, 1.0, 0.0, decay, joined)
        margin = dict(zip(plain, machine.margins(plain).tolist(), strict=True))
        worst = [max((w for w in s if w in margin), key=margin.__getitem__, default=None) for s in negative]
        worst = sorted({w for w in worst if w is not None}, key=lambda w: (-margin[w], w))
        chosen = list(dict.fromkeys(chosen[:ordinary] + worst[:hard]))
    return machine


def _squared_hinge(z: np.ndarray, y: np.ndarray, c: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """A linear machine by Newton steps on the weighted squared hinge loss."""
    x = np.c_[z, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 60)):
        gap = 1 - y * (x @ w)
        use = gap > 0
        g = penalty * np.r_[w[:-1], 0.0] - 2 * x[use].T @ (c[use] * y[use] * gap[use])
        h = penalty * np.eye(len(w)) + 2 * (x[use].T * c[use]) @ x[use]
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", positives: int = POSITIVES, negatives: int = NEGATIVES, folds: int = FOLDS, **how) -> Machine | None:
    """Trains on labelled rows outside the held-out fold; the driver holds at most about positives + negatives texts."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod(F.col("doc_id"), folds) != 0)
    sizes = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = F.when(F.col("toxic") > 0, int(1e6 * min(1.0, positives / sizes[1]))).otherwise(int(1e6 * min(1.0, negatives / sizes[0])))
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    # taken is about positives + negatives ids at most: broadcast, it spares the texts a shuffle
    rows = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(taken), "doc_id").select((F.col("toxic") > 0).alias("y"), F.split(F.coalesce("t", F.lit("")), r"(?<=[.!?])\s+|\n+").alias("t"))
    texts: tuple[list[list[str]], list[list[str]]] = ([], [])
    for r in rows.toLocalIterator():
        texts[r.y].append(r.t)
    return fit(texts[1], texts[0], **how)


def scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", folds: int = FOLDS, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    machine = train(docs, labels, text, id_, folds=folds, **how)

    def each(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                s = machine.score(machine.documents(part.column(2).to_pylist())) if machine else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(id_).alias("doc_id"), (crc_mod(F.col(id_), folds) == 0).alias("held_out"), F.col(text).alias("t"))
    return slim.mapInArrow(each, f"doc_id {docs.schema[id_].dataType.simpleString()}, held_out boolean, score double, predicted int")
