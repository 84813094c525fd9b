"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them; DataFrame and SQL
functions only.

Base spans (email, ip, card, phone) are found by pattern in whole texts, leftmost and non-overlapping for each kind. A
text that holds one is cut into words; a protected value e (its kind and text, lower-cased) occurs with the words of its
own block of `reach` words and of the two blocks beside it, across lines. Over the whole corpus c(e, t) counts a term with
the value, c(e) all words with it, c(t) the term anywhere, T all words. A term discloses e if its smoothed pointwise mutual
information log2(c(e, t) T / (c(e) (c(t) + rare))) is at least `share` of the information of e, log2(T / c(e)). Such a
term near e is a span of kind term; sanitise() generalises it to its class, or removes it where the share is at least
`remove`. A value that occurs once is protected like any other: words found hardly anywhere else disclose it.

Scale: a text's matches are placed by running sums over rows, its words likewise, and a value meets 3 * reach words at
most, so the work is linear in a text's length and in its number of values. Counts are aggregated before each shuffle;
words of the corpus are counted, never paired. A value that a third of the rows hold is one key of sums and of a join that
Spark can split. Patterns are written without nested repetition that backtracks, so a long run of digits or letters costs
one pass.

Defined cases: null counts as empty and has no spans; places are code points, end exclusive; a row repeated with the same
id and text counts once in the statistics and gets the same spans; null ids are kept; an empty table gives an empty
result; extra columns are ignored by spans() and carried by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, temp_name

REACH, SHARE, RARE, REMOVE = 16, 0.9, 0.5, 0.98
KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the fixed patterns: what they give up on backtracking cannot match. A start within a run of
#: the first class is tried only at the run's head or where the last match ended, as any other would end alike.
PATTERNS = {
    "email": r"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> case when c = '' then 0 when i % 2 = 0 then int(c)
    when int(c) > 4 then int(c) * 2 - 9 else int(c) * 2 end), 0, (a, y) -> a + y) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), y -> length(ltrim('0', y)) <= 3 and int(if(ltrim('0', y) = '', '0', right(ltrim('0', y), 3))) <= 255)",
    "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def matches(text: str) -> Column:
    """array<struct<kind, i, gap, v>> of a text column: each pattern's matches in turn, and how many code points lie
    between one and the last before it."""
    parts = []
    for n, kind in enumerate(KINDS):
        found = f"regexp_extract_all({text}, '{PATTERNS[kind]}', 0)"
        gaps = f"transform(split({text}, '{PATTERNS[kind]}', -1), y -> length(y))"
        rows = f"zip_with({found}, {gaps}, (v, g) -> struct({n} as kind, g as gap, v as v))"
        placed = f"filter(transform({rows}, (x, i) -> struct(x.kind as kind, i as i, x.gap as gap, x.v as v)), x -> x.v is not null)"
        none = "cast(array() as array<struct<kind:int,i:int,gap:int,v:string>>)"
        parts.append(f"if({text} rlike '{PATTERNS[kind]}', {placed}, {none})" if not NEEDS[kind] else f"if(instr({text}, '{NEEDS[kind]}') > 0, {placed}, {none})")
    return F.expr(f"concat({', '.join(parts)})")


def base_spans(bearing: DataFrame) -> DataFrame:
    """bearing(uid, found as matches() gives it) -> (uid, kind, s, e, v): the spans; places are sums of what lies before."""
    each = bearing.select("uid", F.explode("found").alias("x")).select("uid", "x.*").withColumn("n", F.length("v"))
    placed = each.withColumn("e", F.expr("sum(gap + n) over (partition by uid, kind order by i)"))
    valid = F.expr("case kind " + " ".join(f"when {n} then {VALID[kind].replace('x.v', 'v')}" for n, kind in enumerate(KINDS)) + " end")
    return placed.where(valid).select("uid", "kind", (F.col("e") - F.col("n")).cast("int").alias("s"), F.col("e").cast("int").alias("e"), "v")


def _words(text: str) -> str:
    return f"split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+')"


def disclosing_terms(bearing: DataFrame, base: DataFrame, docs_text: DataFrame, reach: int, share: float, rare: float) -> DataFrame:
    """bearing(uid, text), base(uid, kind, s, e, v) and the corpus (text, times) -> (uid, s, e, share): the terms near
    protected values that disclose them. times is how often the row's id and text occur."""
    cut = r"split(text, '(?<=[^\\p{L}\\p{N}])|(?=[^\\p{L}\\p{N}])')"
    tokens = bearing.select("uid", F.posexplode(F.expr(cut)).alias("i", "w"))
    word = F.expr(r"w rlike '^[\\p{L}\\p{N}]{2,}$'")
    placed = tokens.withColumn("e", F.expr("cast(sum(length(w)) over (partition by uid order by i) as int)")).withColumn("at", F.sum(word.cast("int")).over(Window.partitionBy("uid").orderBy("i")))
    words = materialise(placed.where(word).select("uid", (F.col("e") - F.length("w")).alias("s"), "e", F.lower("w").alias("term"), "at"), "tokens")
    # spans and words in one order of places: a span stands where the last word before it does, and no word within a span counts
    marks = base.select("uid", "s", "e", F.lit(None).cast("string").alias("term"), F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.lower("v")).alias("value"))
    both = words.select("uid", "s", "e", "term", F.lit(None).cast("string").alias("value"), "at").unionByName(marks.withColumn("at", F.lit(None).cast("bigint")))
    order = Window.partitionBy("uid").orderBy("s", F.col("term").isNotNull().cast("int"))
    seen = both.withColumn("within", F.max(F.when(F.col("term").isNull(), F.col("e"))).over(order)).withColumn("at", F.coalesce(F.last("at", ignorenulls=True).over(order), F.lit(0)))
    seen = materialise(seen.where("term is null or within is null or within <= s").select("uid", "s", "e", "term", "value", "at"), "seen")
    block = F.floor(F.col("at") / reach).alias("block")
    values = seen.where("value is not null").select("uid", "value", block).distinct()
    # a value meets the words of its own block of `reach` words and of the blocks beside it, so at most 3 * reach
    asked = values.select("uid", "value", F.explode(F.array(*[F.col("block") + k for k in (-1, 0, 1)])).alias("block")).distinct()
    pairs = materialise(seen.where("term is not null").select("uid", "s", "e", "term", block).join(asked, ["uid", "block"]).select("uid", "s", "e", "term", "value"), "pairs")
    together = materialise(pairs.groupBy("value", "term").agg(F.count("*").alias("cet")), "together")
    around = together.groupBy("value").agg(F.sum("cet").alias("ce"))
    wanted = together.select("term").distinct().withColumn("wanted", F.lit(True))
    corpus = docs_text.select("times", F.explode(F.expr(_words("text"))).alias("term")).where("term <> ''").groupBy("term").agg(F.sum(1 / F.col("times")).alias("ct"))
    counts = materialise(corpus.join(wanted, "term", "left").groupBy(F.when(F.col("wanted"), F.col("term")).alias("term")).agg(F.sum("ct").alias("ct")), "counts")
    total = counts.agg(F.coalesce(F.sum("ct"), F.lit(1.0)).alias("n")).first()[0]
    scored = together.join(around, "value").join(counts.where("term is not null"), "term")
    t = F.lit(float(total))
    part = F.log2(F.col("cet") * t / (F.col("ce") * (F.round("ct") + rare))) / F.log2(t / F.col("ce"))
    known = materialise(scored.where(t > F.col("ce")).select("value", "term", part.alias("share")).where(F.col("share") >= share), "known")
    return pairs.join(known, ["value", "term"]).groupBy("uid", "s", "e").agg(F.max("share").alias("share"))


def spans(docs: DataFrame, text: str = "text", id_: str = "doc_id", reach: int = REACH, share: float = SHARE, rare: float = RARE) -> DataFrame:
    """(doc_id, k, base, terms) for each row: base spans, and terms (s, e, share) by place."""
    named = docs.select(F.col(id_).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = named.withColumn("k", F.xxhash64("doc_id", "text"))
    found = named.select("doc_id", "k", matches("text").alias("found"), "text").withColumn("uid", F.monotonically_increasing_id())
    found = materialise(found.withColumn("text", F.when(F.size("found") > 0, F.col("text"))), "found")
    base = materialise(base_spans(found.where("size(found) > 0").select("uid", "found")), "base")
    # of rows with the same id and text one stands for all in the statistics
    alike = materialise(named.groupBy("k").agg(F.count("*").alias("times")).where("times > 1"), "alike")
    every = named.join(alike, "k", "left").select("text", F.coalesce("times", F.lit(1)).alias("times"))
    one = base.select("uid").distinct().join(found.select("uid", "k"), "uid").groupBy("k").agg(F.min("uid").alias("uid"))
    one = materialise(one, "one")
    terms = disclosing_terms(found.select("uid", "text").join(one.select("uid"), "uid"), base.join(one.select("uid"), "uid"), every, reach, share, rare)
    terms = terms.join(one, "uid").groupBy("k").agg(F.array_sort(F.collect_set(F.struct("s", "e", "share"))).alias("terms"))
    placed = base.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e", "v"))).alias("base"))
    named_base = f"transform(base, x -> struct(element_at(array({', '.join(map(repr, KINDS))}), x.kind + 1) as kind, x.s as s, x.e as e, x.v as v))"
    empty = "cast(array() as array<struct<kind:string,s:int,e:int,v:string>>)", "cast(array() as array<struct<s:int,e:int,share:double>>)"
    held = found.where("size(found) > 0").select("doc_id", "k", "uid").join(placed, "uid", "left").join(terms, "k", "left")
    held = held.select("doc_id", "k", F.coalesce(F.expr(named_base), F.expr(empty[0])).alias("base"), F.coalesce("terms", F.expr(empty[1])).alias("terms"))
    return held.unionByName(found.where("size(found) = 0").select("doc_id", "k", F.expr(empty[0]).alias("base"), F.expr(empty[1]).alias("terms")))


def digest(found: DataFrame) -> DataFrame:
    """spans() as (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    line = "concat_ws(',', transform(base, x -> concat_ws(':', x.kind, x.s, x.e)))"
    more = "concat_ws(',', transform(terms, x -> concat_ws(':', 'term', x.s, x.e)))"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS],
        F.expr(f"sha2({line}, 256)").alias("base_sha256"),
        F.expr(f"concat({line}, if(size(base) > 0 and size(terms) > 0, ',', ''), {more})").alias("spans"),
    )


def sanitise(docs: DataFrame, text: str = "text", id_: str = "doc_id", remove: float = REMOVE, **how) -> DataFrame:
    """docs with spans replaced in `text`: base spans by their kind, terms by their class ([number] or [word]), or
    removed at a share of `remove` or more. Where spans overlap, the one that begins first (then the longer) counts."""
    key, marks = temp_name(docs, "row_key"), temp_name(docs, "row_marks")
    found = spans(docs, text, id_, **how).dropDuplicates(["k"])
    every = f"""array_sort(concat(transform(base, x -> struct(cast(x.s as bigint) as s, -cast(x.e as bigint) as e, concat('[', x.kind, ']') as r)),
        transform(terms, x -> struct(x.s as s, -x.e as e, if(x.share >= {remove}, '', cast(null as string)) as r))))"""
    marked = found.where("size(base) > 0").select(F.col("k").alias(key), F.expr(every).alias(marks))
    joined = docs.withColumn(key, F.xxhash64(F.col(id_), F.coalesce(F.col(text), F.lit("")))).join(marked, key, "left")
    clean = f"""aggregate(`{marks}`, struct(0L as at, '' as out), (a, m) -> if(m.s < a.at, a, struct(-m.e as at, concat(a.out,
        substring(`{text}`, int(a.at + 1), int(m.s - a.at)), coalesce(m.r, if(substring(`{text}`, int(m.s + 1), int(-m.e - m.s)) rlike '^[0-9]+$', '[number]', '[word]'))) as out)),
        a -> concat(a.out, substring(`{text}`, int(a.at + 1))))"""
    return joined.withColumn(text, F.when(F.col(marks).isNull(), F.col(text)).otherwise(F.expr(clean))).drop(key, marks)
