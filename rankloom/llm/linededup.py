"""Line deduplication by winnowing over line hashes; DataFrame and SQL functions only.

A line ends at a line break or at a full stop, question or exclamation mark before a blank (full-width marks end it
anywhere), so that a passage pasted into a paragraph is seen too; what ends it doesn't count. Lines of white space alone are skipped. A
line's length is counted in words, or in 8 bytes beyond one a character where that is more, as scripts without blanks have.
A gram is a line of `long_words` by itself, else the fewest lines, two or more, that hold `min_words`. Of every `window`
consecutive grams the one with the least hash is a fingerprint, and so is every long line: a run shared by two texts that
holds `window` grams holds a fingerprint of both. A fingerprint's first position (by doc_id, then text hash, then line)
stays; at every other one its lines are deleted. A run reaches beyond its outer fingerprints by at most window - 1 lines
before and, as less than a gram is left, min_words + 1 lines after. Such lines are deleted too, one by one until they
differ, where some earlier position of the fingerprint, not only its first, has the same lines beside it.

Scale: lines travel as 64-bit hashes; counts and first positions are aggregated before the shuffle; a position meets one
row of what it asks for, so a passage in a third of all documents makes one row a document, never pairs, and run-time skew
splitting can deal them out. Only fingerprints at open ends of runs look at their neighbours. Only texts that lose lines
are split a second time.

Defined cases: null text stays null and loses nothing; empty text stays empty; a text of under `min_words` loses nothing;
copies of a text lose what the first (least doc_id, nulls first) keeps; a row repeated with the same id and text counts
once and both rows are returned alike; an empty table gives an empty result; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, temp_name

GRAM, WINDOW, LONG_WORDS, MIN_WORDS = 2, 2, 25, 8
#: What ends a line, and the places between lines, which cut a text into as many pieces without losing a character.
ENDS, PLACES = r"'[.!?]+[ \\n]|[\\n。！？]'", r"'(?<=[.!?][ \\n])|(?<=[\\n。！？])'"
#: A character at which texts are cut where they don't hold it themselves.
CUT = "char(1)"


def _rare(text: str) -> str:
    """SQL: whether a text must be cut by the expressions above; plain replacements, which are faster, cut the others alike."""
    return " or ".join(f"contains({text}, {x})" for x in (CUT, "'。'", "'！'", "'？'"))


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        text = f"replace({text}, {a}, {b})"
    return text


def _cut(text: str) -> str:
    """SQL: what lies between the lines' ends."""
    marked = _replaced(f"concat({text}, ' ')", [(f"'{x} '", r"'\n'") for x in ".!?"])
    bare = "if(endswith(s, '.') or endswith(s, '!') or endswith(s, '?'), rtrim('.!?', s), s)"
    return rf"if({_rare(text)}, split(concat({text}, ' '), {ENDS}), transform(split({marked}, '\n'), s -> {bare}))"


def _pieces(text: str) -> str:
    """SQL: the text cut at the places between lines, nothing lost."""
    marked = _replaced(text, [(x, f"concat({x}, {CUT})") for x in ("'. '", "'! '", "'? '", r"'\n'")])
    return f"if({_rare(text)}, split({text}, {PLACES}), split({marked}, {CUT}))"


def _lines(text: str) -> str:
    """SQL: the non-blank lines of a text as structs (hash, length, number of the piece)."""
    size = "greatest(octet_length(s) - octet_length(replace(s, ' ', '')) + 1, (octet_length(s) - length(s)) div 8)"
    blank = r"ltrim(' \t\n\u000b\f\r', s) = ''"
    every = f"transform({_cut(text)}, (s, i) -> struct(xxhash64(s) as h, if({blank}, 0, int({size})) as w, i as i))"
    return f"filter({every}, x -> x.w > 0)"


def fingerprints(keyed: DataFrame, text: str, gram: int = GRAM, window: int = WINDOW, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """keyed(id, k, text) -> (id, k, hs, at, marks): the line hashes, their piece numbers, and the fingerprints (j, g, n).

    A gram folds the lines after its first one in until it is full; a long line and two lines that fill one need no fold. A
    gram is chosen if it is the least of one of the windows that hold it."""
    out = keyed.where(F.col(text).isNotNull()).select("id", "k", F.expr(_lines(f"`{text}`")).alias("lines"))
    full = f"a.w >= {min_words} and a.n >= {gram}"
    more = f"aggregate(slice(lines, i + 2, {max(gram, min_words) - 1}), struct(x.h as h, x.w as w, 1 as n), (a, y) -> if({full}, a, struct(xxhash64(a.h, y.h) as h, a.w + y.w as w, a.n + 1 as n)), a -> if({full}, struct(a.h as g, a.n as n), null))"
    two = f"when x.w + get(lines, i + 1).w >= {min_words} then struct(xxhash64(x.h, get(lines, i + 1).h) as g, 2 as n)" if gram <= 2 else ""
    out = out.withColumn("grams", F.expr(f"transform(lines, (x, i) -> case when x.w >= {long_words} then struct(xxhash64(x.h) as g, 1 as n) {two} else {more} end)"))
    least = [", ".join(f"get(grams, j + {t - k}).g" for t in range(window) if t != k) for k in range(window)]  # of the window that begins k before
    chosen = " or ".join(f"(j >= {k} and x.g = least(x.g, {others or 'x.g'}))" for k, others in enumerate(least))
    marks = f"filter(transform(grams, (x, j) -> if(x.g is not null and (x.n = 1 or {chosen}), struct(j as j, x.g as g, x.n as n), null)), x -> x is not null)"
    return out.select("id", "k", F.expr("lines.h").alias("hs"), F.expr("lines.i").alias("at"), F.expr(marks).alias("marks"))


def _beside(ahead: str, back: str) -> str:
    """SQL over hs and a mark m (j, n, g): keys of the mark with t of the lines after it (t > 0) or before it (t < 0)."""
    after = f"transform(sequence(1, {ahead}), t -> struct(t as t, xxhash64(m.g, t, slice(hs, m.j + m.n + 1, t)) as key))"
    before = f"transform(sequence(1, {back}), t -> struct(-t as t, xxhash64(m.g, -t, slice(hs, m.j - t + 1, t)) as key))"
    none = "cast(array() as array<struct<t:int,key:bigint>>)"
    return f"concat(if({ahead} > 0, {after}, {none}), if({back} > 0, {before}, {none}))"


def _merged(ranges: str) -> str:
    """SQL: sorted ranges (a, b), those that meet or touch as one."""
    none = "cast(array() as array<struct<a:int,b:int>>)"
    grow = "struct(x.done as done, x.a as a, greatest(x.b, r.b) as b)"
    start = "struct(if(x.b < 0, x.done, concat(x.done, array(struct(x.a as a, x.b as b)))) as done, r.a as a, r.b as b)"
    return f"aggregate({ranges}, struct({none} as done, -1 as a, -9 as b), (x, r) -> if(r.a <= x.b + 1, {grow}, {start}), x -> concat(x.done, array(struct(x.a as a, x.b as b))))"


def _outside(pieces: str, runs: str) -> str:
    """SQL: the pieces outside of runs, which are sorted and apart; one pass over both."""
    gap = f"slice(s, if(j = 0, 0, get({runs}, j - 1).b + 1) + 1, if(j = size({runs}), size(s), get({runs}, j).a) - if(j = 0, 0, get({runs}, j - 1).b + 1))"
    return f"element_at(transform(array({pieces}), s -> flatten(transform(sequence(0, size({runs})), j -> {gap}))), 1)"


def repeated_runs(marked: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """fingerprints() -> (k, runs), written: for each text the piece ranges (a, b) that repeat an earlier run, sorted and apart."""
    rows = marked.select("id", "k", F.explode("marks").alias("m")).select("id", "k", "m.j", "m.g", "m.n")
    first = rows.groupBy("g").agg(F.min(F.struct("id", "k", "j")).alias("f"), F.count("*").alias("c")).where("c > 1").selectExpr("g", "f.k as fk", "f.j as fj")
    first = materialise(first, "first")
    hits = materialise(rows.join(first, "g").selectExpr("id", "k", "j", "g", "n", "not (k = fk and j = fj) as later"), "hits")
    later = hits.where("later").groupBy("k").agg(F.array_sort(F.collect_set(F.struct("j", "n", "g"))).alias("later"))
    held = materialise(later.join(marked.select("id", "k", "hs", "at"), "k").dropDuplicates(["k"]), "later")
    # open ends: marks whose neighbours no other later mark covers
    reach = min_words + 1
    gap = "greatest(coalesce(get(later, i + 1).j, size(hs)) - (m.j + m.n), 0)"
    space = "greatest(m.j - if(i = 0, 0, get(later, i - 1).j + get(later, i - 1).n), 0)"
    ends = f"flatten(transform(later, (m, i) -> transform({_beside(f'least({gap}, {reach})', f'least({space}, {window - 1})')}, x -> struct(m.j as j, m.n as n, m.g as g, x.t as t, x.key as key))))"
    asked = materialise(held.select("id", "k", F.explode(F.expr(ends)).alias("a")).select("id", "k", "a.*"), "asked")
    sources = hits.join(asked.select("g").distinct(), "g", "left_semi").join(marked.select("k", "hs"), "k").withColumn("m", F.struct("j", "n", "g"))
    keys = _beside(f"least(size(hs) - (m.j + m.n), {reach})", f"least(m.j, {window - 1})")
    known = sources.select("id", "k", "j", F.explode(F.expr(keys)).alias("x")).groupBy("x.key").agg(F.min(F.struct("id", "k", "j")).alias("f"))
    same = asked.join(known, "key").where("not (k = f.k and j = f.j)")
    more = same.groupBy("k").agg(F.collect_set(F.expr("if(t > 0, struct(j + n as a, j + n + t - 1 as b), struct(j + t as a, j - 1 as b))")).alias("more"))
    every = "concat(transform(later, m -> struct(m.j as a, m.j + m.n - 1 as b)), coalesce(more, array()))"
    ranges = f"array_sort(transform({every}, r -> struct(get(at, r.a) as a, get(at, r.b) as b)))"
    runs = materialise(held.join(more, "k", "left").select("k", F.expr(_merged(ranges)).alias("runs")), "runs")
    for done in (first, hits, held, asked):
        discard(done)
    return runs


def dedup_lines(docs: DataFrame, text: str = "text", id_: str = "doc_id", gram: int = GRAM, window: int = WINDOW, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs of lines deleted from `text`; adds n_deleted (lines, blank ones between deleted ones included)."""
    key, runs = temp_name(docs, "row_key"), temp_name(docs, "row_runs")
    hashed = F.xxhash64(F.col(id_), F.xxhash64(F.col(text)))
    keyed = docs.select(F.col(id_).alias("id"), hashed.alias("k"), F.col(text).alias("t"))
    marked = materialise(fingerprints(keyed, "t", gram, window, long_words, min_words), "lines")
    found = repeated_runs(marked, window, min_words).select(F.col("k").alias(key), F.col("runs").alias(runs))
    discard(marked)
    keep = _outside(_pieces(f"`{text}`"), f"`{runs}`")
    kept = temp_name(docs, "row_kept")
    # texts meet their runs in a shuffle at any size: the runs of a compressed file can be many times its size, and grow with the table
    joined = docs.withColumn(key, hashed).join(found.hint("merge"), key, "left").withColumn(kept, F.when(F.col(runs).isNotNull(), F.expr(keep)))
    gone = F.expr(f"aggregate(`{runs}`, 0L, (n, r) -> n + r.b - r.a + 1)")
    return (
        joined.withColumn("n_deleted", F.when(F.col(kept).isNull(), F.lit(0).cast("long")).otherwise(gone))
        .withColumn(text, F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(kept, "")))
        .drop(key, runs, kept)
    )
