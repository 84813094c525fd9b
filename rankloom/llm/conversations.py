"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)?, by integer weights.

An edit sequence weighs one integer: high digits hold its cost, low digits its audit letters from the left, one octal digit
each (D < I < K < R as in ASCII), in a field of fixed width whose unused end is zero. An edit adds its cost and its letter's
digit at the next place, so "cheaper, then ASCII-least" is the order of integers, a prefix comes before what it begins, and the
DP over (row, role state) takes ordinary integer minima. A least prefix stays least under any continuation: two audits of
equal cost for the same rows can't be one the beginning of the other, as the rest would be insertions, which cost.

Rows are damaged, then equal rows are one row with a count. Faults are expressions of Spark; what is seen earlier is a least
turn for each (conversation, role, text) met by a join. Rows are dealt and sorted by range of (conversation, turn, role, text)
and cut into pieces of at most `segment` rows; a piece returns, for each of the four role states before and after it, the
least weight: 16 audits of bounded length. Pieces of a conversation then fold from its end, as weights of a common width. At
last its rows pass in order, and the audit says what each becomes; the digest takes them one by one.

Scale: a conversation of any length is many pieces in many tasks, and its texts are never held together. Its fold, and the
digest (a chain by definition), are one task that holds the audit, which is a value of the result, and one batch of rows.

Defined cases: null roles and texts are one space, null ids and turns one space where the damage is drawn; the null id is a
conversation; rows of one turn stand in the order of role and of the text's MD5, copies side by side; roles whose first
character is not s, u or a can't be kept; a conversation whose rows all fall away has zeros, an empty audit and the empty
string's digest; a very long text is one row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SEGMENT = 256
DELETE, INSERT, KEEP, REROLE = "1234"  # the letters' digits
LETTERS = str.maketrans("1234", "DIKR")
#: Role states: nothing yet, after s, after u, after a. What a role's initial leads to; the role that comes next.
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
BLANK, TRUNCATED = 1, 2
_SPACE = r" \t\n\u000b\f\r"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): each row as the damage leaves it, n times (0: dropped)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn))) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.translate(filled(text), ".!?", "")).otherwise(filled(text))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(filled(role)).alias("role"), new_text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, turn, role, h, text, n, kind), the same without text, with `fresh`: no equal row stands earlier)."""
    solid = F.expr(f"rtrim('{_SPACE}', text)")
    kind = F.when(solid == "", BLANK).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    whole = materialise(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).select("conv_id", "turn", "role", F.md5("text").alias("h"), "text", "n", kind.alias("kind")), "turns")
    light = whole.drop("text")
    seen = light.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    met = light.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    return whole, materialise(met.select("conv_id", "turn", "role", "h", "n", "kind", F.col("turn").eqNullSafe(F.col("first.turn")).alias("fresh")), "faults")


def _least(old: dict, new: dict) -> dict:
    for state, found in new.items():
        if state not in old or found[0] < old[state][0]:
            old[state] = found
    return old


def weights(rows: list[tuple[str, str]], start: int) -> dict[int, tuple[int, str]]:
    """{state after: (cost, audit digits)} of the cheapest edits of rows (role initial, fault) from a state before."""
    width = 3 * len(rows) + 2  # no cheapest edits insert more than twice between rows
    unit = 1 << 3 * width

    def edit(found: tuple[int, int], letter: str, more: int = 0) -> tuple[int, int]:
        weight, place = found
        return weight + (_COST[letter] + more) * unit + (int(letter) << 3 * (width - 1 - place)), place + 1

    def inserted(nodes: dict) -> dict:
        layer, nodes = nodes, dict(nodes)
        for _ in range(2):
            further: dict = {}
            for state, found in layer.items():
                _least(further, {_NEXT[state][1]: edit(found, INSERT)})
            layer = further
            _least(nodes, layer)
        return nodes

    nodes = inserted({start: (0, 0)})
    for initial, fault in rows:
        after: dict = {}
        for state, found in nodes.items():
            _least(after, {state: edit(found, DELETE)})
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, initial) in _KEPT:
                    _least(after, {_KEPT[state, initial]: edit(found, KEEP, more)})
                _least(after, {_NEXT[state][1]: edit(found, REROLE, more)})
        nodes = inserted(after)
    return {state: (weight >> 3 * width, f"{weight & (unit - 1):0{width}o}"[:place]) for state, (weight, place) in nodes.items()}


def _weight(cost: int, digits: str, width: int) -> int:
    return (cost << 3 * width) | int(digits.ljust(width, "0") or "0", 8)


_PIECE = "conv_id {id}, part int, seq long, rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long, costs array<long>, audits array<string>"


class _Piece:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv):
        self.conv, self.rows, self.faults, self.illegal, self.turns = conv, [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0, []

    def add(self, turn, initial: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        if self.rows:
            self.illegal += self.rows[-1][0] + initial not in ("su", "ua", "au")
        if turn is not None and turn not in self.turns[-1:]:
            self.turns.append(turn)
        self.rows.append((initial, fault))

    def out(self, part: int, seq: int) -> tuple:
        costs, audits = [None] * 16, [None] * 16
        for start in range(4):
            for end, (cost, digits) in weights(self.rows, start).items():
                costs[4 * start + end], audits[4 * start + end] = cost, digits
        ends = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        turns = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return self.conv, part, seq, len(self.rows), *self.faults.values(), self.illegal, *ends, *turns, len(self.turns), costs, audits


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _emitted(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == 500:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def pieces(faults: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The pieces of all conversations, with their least weights between role states."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = _PIECE.format(id=faults.schema["conv_id"].dataType.simpleString())
    schema = to_arrow_schema(faults.sparkSession.createDataFrame([], kinds).schema)

    def cut(batches) -> Iterator[tuple]:
        part, seq, piece = TaskContext.get().partitionId(), 0, None
        for conv, turn, initial, n, kind, fresh in _rows(batches):
            if piece is None or piece.conv != conv:
                if piece:
                    yield piece.out(part, seq)
                piece, seq = _Piece(conv), seq + 1
            for copy in range(n):
                if len(piece.rows) == segment:
                    yield piece.out(part, seq)
                    piece, seq = _Piece(conv), seq + 1
                piece.add(turn, initial, "blank" if kind == BLANK else "duplicate" if copy or not fresh else "truncated" if kind == TRUNCATED else "")
        if piece:
            yield piece.out(part, seq)

    order = ["conv_id", "turn", "role", "h"]
    dealt = faults.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "kind", "fresh")
    return materialise(dealt.mapInArrow(lambda batches: _emitted(cut(batches), schema), kinds), "pieces")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _folded(group: list[tuple]) -> tuple:
    """A conversation's pieces, from the last to the first: its counts, cost and audit digits."""
    v, counts, illegal, turns, nearest = {0: (0, ""), 3: (0, "")}, [0, 0, 0], 0, 0, None
    low = high = after = None
    for _, _, _, rows, blank, duplicate, truncated, inside, head, tail, first, last, n_turns, costs, audits in group:
        counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated), strict=True)]
        if rows:
            illegal += inside + (after is not None and tail + after not in ("su", "ua", "au"))
            after = head
        if first is not None:
            turns += n_turns - (last == nearest)
            nearest, low, high = first, first, last if high is None else high
        new = {}
        for start in range(4):
            ways = [(costs[4 * start + end] + cost, audits[4 * start + end] + digits) for end, (cost, digits) in v.items() if costs[4 * start + end] is not None]
            if ways:
                width = max(len(d) for _, d in ways)
                new[start] = min(ways, key=lambda w: _weight(*w, width))
        v = new
    cost, digits = v[0]
    return group[0][0], 0 if low is None else high - low + 1 - turns, *counts, illegal, cost, digits


def audits(cut: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) from pieces()."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
    schema = to_arrow_schema(cut.sparkSession.createDataFrame([], kinds).schema)

    def fold(batches) -> Iterator[tuple]:
        group: list[tuple] = []
        for row in _rows(batches):
            if group and group[-1][0] != row[0]:
                yield _folded(group)
                group = []
            group.append(row)
        if group:
            yield _folded(group)

    dealt = cut.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    return dealt.mapInArrow(lambda batches: _emitted(fold(batches), schema), kinds)


class _Text:
    """A repaired conversation, line by line as its rows pass."""

    def __init__(self, counts: tuple):
        self.counts, self.audit, self.at, self.state, self.lines = counts, counts[-1], 0, 0, 0

    def insertions(self) -> Iterator[tuple[int, str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            role, self.state = _NEXT[self.state]
            self.at += 1
            yield self.line(role, "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == KEEP:
            self.state = _KEPT[self.state, role[:1]]
            yield self.line(role, text)
        elif letter == REROLE:
            role, self.state = _NEXT[self.state]
            yield self.line(role, text)

    def line(self, role: str, text: str) -> tuple[int, str, str]:
        self.lines += 1
        return self.lines - 1, role, text


def _lines(batches) -> Iterator[tuple[_Text, tuple[int, str, str] | None]]:
    """Each conversation's lines, and None after its last."""
    held = None
    for place, conv, role, text, n, counts in _rows(batches):
        if place == 0:
            if held:
                yield from ((held, line) for line in held.insertions())
                yield held, None
            held = _Text((conv, *counts, text))
        else:
            for _ in range(n):
                yield from ((held, line) for line in held.row(role, text))
    if held:
        yield from ((held, line) for line in held.insertions())
        yield held, None


def _digests(batches) -> Iterator[tuple]:
    digest = hashlib.sha256()
    for held, line in _lines(batches):
        if line:
            digest.update(("\n" * (line[0] > 0) + f"{line[1]}:{line[2]}").encode())
        else:
            yield (*held.counts[:-1], held.audit.translate(LETTERS), digest.hexdigest())
            digest = hashlib.sha256()


def _repaired(batches) -> Iterator[tuple]:
    return ((held.counts[0], *line) for held, line in _lines(batches) if line)


def _walked(rows: DataFrame, segment: int, each, more: str, counts: bool) -> DataFrame:
    """Rows beside their conversation's audit, in order, through `each`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    whole, faults = judged(rows)
    found = audits(pieces(faults, segment))
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in found.schema if counts or f.name == "conv_id"] + [more])
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], kinds).schema)
    none = {c: F.lit(None).cast(t) for c, t in whole.dtypes}
    texts = whole.where("n > 0").select(F.lit(1).alias("place"), "conv_id", "turn", "role", "h", "text", "n", F.lit(None).cast("array<long>").alias("counts"))
    heads = found.select(F.lit(0).alias("place"), "conv_id", *(none[c].alias(c) for c in ("turn", "role", "h")), F.col("audit").alias("text"), none["n"].alias("n"), F.array(*_COUNTS).alias("counts"))
    dealt = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "place", "turn", "role", "h")
    return dealt.select("place", "conv_id", "role", "text", "n", "counts").mapInArrow(lambda batches: _emitted(each(batches), schema), kinds)


def once(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): undamaged rows, as repair() and repaired_rows() take them."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), F.lit(1).cast("long").alias("n"))


def repaired_rows(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, of rows as once() or damage() returns them."""
    return _walked(rows, segment, _repaired, "place long, role string, text string", counts=False)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): each conversation's faults, the
    edits that repair it, and the digest of what repaired_rows() gives."""
    return _walked(rows, segment, _digests, "repaired_sha256 string", counts=True)
