"""Column operators: predicates, feature choice, encoding, coercion, bands, rescaling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import steps


def cell(rows: DataFrame, category: str | None = None, aspect: str | None = None, snapshots: Sequence | None = None) -> DataFrame:
    """Rows of one cell: equality on category and aspect (lower-cased), membership on snapshot; pushed down to the scan."""
    for name, value in (("category", category), ("aspect", aspect)):
        if value is not None:
            rows = rows.where(F.lower(name) == value.lower())
    return rows if snapshots is None else rows.where(F.col("snapshot").isin(list(snapshots)))


def present_columns(rows: DataFrame, want: Mapping[str, str]) -> DataFrame:
    """The wanted columns by type: those missing are null, others cast."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in want.items()])


def features_of(families: Mapping[str, Sequence[str]], present: Iterable[str], use: Iterable[str] | None = None, drop: Iterable[str] = (), dropped_prefix: str = "lineage_") -> list[str]:
    """Feature names in the families' order: those present, of the families in use, not dropped and not by a dropped prefix."""
    have, gone, chosen = set(present), set(drop), families if use is None else use
    return [c for f, names in families.items() if f in chosen for c in names if c in have and c not in gone and not c.startswith(dropped_prefix)]


def selected_features(families: Mapping[str, Sequence[str]], present: Iterable[str], categorical: Iterable[str] = (), use: Iterable[str] | None = None, drop: Iterable[str] = (), override: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features: those of the families in use, or an explicit list in its order, without dropped ones."""
    gone, kinds, have = set(drop), set(categorical), set(present)
    chosen = features_of(families, have, use, gone) if override is None else [c for c in dict.fromkeys(override) if c in have and c not in gone]
    return [c for c in chosen if c not in kinds], [c for c in chosen if c in kinds]


def score_vector(rows: DataFrame, scorers: Mapping[str, Sequence[str]], known_only: Iterable[str], category: str, without_known: Iterable[str] = ("nk",)) -> DataFrame:
    """The scorers' columns as doubles, null for scorers that build on known terms where the category has none."""
    gone, bare = set(known_only), F.lower(F.col(category)).isin([c.lower() for c in without_known])
    value = lambda c, scorer: F.when(bare, F.lit(None)).otherwise(F.col(c)) if scorer in gone else F.col(c)
    return rows.withColumns({c: value(c, scorer).cast("double") for scorer, names in scorers.items() for c in names})


def filled(rows: DataFrame, numeric: Iterable[str], codes: Iterable[str]) -> DataFrame:
    """Every wanted column as a float: missing numbers NaN, missing category codes -1."""
    part = lambda c, empty: F.coalesce((F.col(c) if c in rows.columns else F.lit(None)).cast("float"), F.lit(empty).cast("float"))
    return rows.withColumns({c: part(c, float("nan")) for c in numeric} | {c: part(c, -1.0) for c in codes})


def members(rows: DataFrame, entities: DataFrame, column: str = "entity") -> DataFrame:
    """Rows of the listed entities, each once however often it is listed."""
    return rows.join(entities.select(column).distinct(), column, "left_semi")


#: The letters that older files use for the three aspects.
ASPECT_LETTERS = {"F": "mfo", "P": "bpo", "C": "cco"}


def aspect_name(aspect: Column) -> Column:
    """An aspect's name, in lower case, of its name or letter."""
    out = F.when(F.length(aspect) > 1, F.lower(aspect))
    for letter, name in ASPECT_LETTERS.items():
        out = out.when(F.upper(aspect) == letter, name)
    return out


def neighbour_score(distance: Column) -> Column:
    """1 - distance, the score of a neighbour alone."""
    return 1 - distance.cast("double")


def numeric_features(rows: DataFrame, drop: Iterable[str] = ()) -> list[str]:
    return [c for c, t in rows.dtypes if t in ("float", "double", "int", "bigint", "smallint", "tinyint") and c not in set(drop)]


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): codes 0.. in the values' order, learned on the non-null values of rows."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return steps.before(values.withColumn("one_", F.lit(1)), "value", "one_", "code").select("value", F.col("code").cast("int").alias("code"))


def encode(rows: DataFrame, column: str, words: DataFrame, out: str) -> DataFrame:
    """Adds the code of a category; null and unseen values are -1."""
    return rows.join(words.select(F.col("value").alias(column), F.col("code").alias(out)), column, "left").fillna(-1, [out])


def tolerant(column: str, kind: str = "double") -> Column:
    """A number out of text: anything else is null."""
    return F.expr(f"try_cast(nullif(trim(`{column}`), '') as {kind})")


def remap(rows: DataFrame, aliases: DataFrame, column: str = "term") -> DataFrame:
    """aliases(alt, term): alternative ids become the primary one."""
    return rows.join(aliases.select(F.col("alt").alias(column), F.col("term").alias("primary_")), column, "left").withColumn(column, F.coalesce("primary_", column)).drop("primary_")


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the half-open band that holds value: below edges[0], then [edges[i], edges[i + 1])."""
    out = F.when(value < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:], strict=False):
        out = out.when(value < e, label)
    return out.when(value.isNotNull(), labels[len(edges)])


def before(year: Column, month: Column, at: tuple[int, int]) -> Column:
    """Strictly before (year, month); undated rows stay, and within the year itself undated months do."""
    return year.isNull() | (year < at[0]) | ((year == at[0]) & (month.isNull() | (month < at[1])))


def sentences(rows: DataFrame, key: str, text: str, most: int = 64) -> DataFrame:
    """(key, pos, sentence): split after . ! ? and at line breaks, the first of those equal but for case, `most` at most."""
    cut = rows.select(key, F.posexplode(F.split(text, r"(?<=[.!?])\s+|\n")).alias("pos", "sentence")).where("trim(sentence) <> ''")
    first = cut.groupBy(key, F.lower(F.trim("sentence")).alias("low")).agg(F.min(F.struct("pos", F.trim("sentence").alias("sentence"))).alias("s"))
    order = Window.partitionBy(key).orderBy("s.pos")
    return first.select(key, "s", F.row_number().over(order).alias("k")).where(F.col("k") <= most).select(key, (F.col("k") - 1).alias("pos"), F.col("s.sentence").alias("sentence"))


def digest(columns: Iterable[str]) -> Column:
    """12 hex digits that name a set of columns, whatever their order."""
    return F.substring(F.sha2(F.lit(",".join(sorted(columns))), 256), 1, 12)


def withhold(rows: DataFrame, score: str, q: float) -> DataFrame:
    """Rows strictly above the q-quantile of the score."""
    cut = rows.agg(F.expr(f"percentile({score}, {q})").alias("cut_"))
    return rows.crossJoin(F.broadcast(cut)).where(F.col(score) > F.col("cut_")).drop("cut_")  # cut is one row


def lying_zeros(rows: DataFrame, columns: Sequence[str], ran: str, skipped_share: float = 0.99, ran_share: float = 0.9) -> list[str]:
    """Columns that are zero on more than skipped_share of the rows whose producer did not run, and on less than ran_share of
    the others."""
    shares = rows.agg(*[F.avg(F.when(F.col(ran) == k, (F.col(c) == 0).cast("double"))).alias(f"{c}_{k}") for c in columns for k in (0, 1)]).first()
    return [c for c in columns if (shares[f"{c}_0"] or 0) > skipped_share and (shares[f"{c}_1"] if shares[f"{c}_1"] is not None else 1) < ran_share]


def null_where_skipped(rows: DataFrame, columns: Sequence[str], ran: str) -> DataFrame:
    return rows.withColumns({c: F.when(F.col(ran) == 1, F.col(c)) for c in columns})


def min_max(score: Column, by: Sequence[str] | None, flat: float) -> Column:
    """Score within its group's range; `flat` where the range is nothing. Without a group, rather use min_max_all."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(flat))


def min_max_all(rows: DataFrame, score: str, flat: float = 0.0) -> DataFrame:
    ends = rows.agg(F.min(score).alias("low_"), F.max(score).alias("high_"))
    scaled = F.when(F.col("high_") > F.col("low_"), (F.col(score) - F.col("low_")) / (F.col("high_") - F.col("low_"))).otherwise(F.lit(flat))
    return rows.crossJoin(F.broadcast(ends)).withColumn(score, scaled).drop("low_", "high_")  # ends is one row


def rank_unit(by: Sequence[str], score: str, tie: str) -> Column:
    """Rank in (0, 1], the best score at 1."""
    w = Window.partitionBy(*by)
    return F.row_number().over(w.orderBy(score, F.desc(tie))) / F.count("*").over(w)


def power(score: Column, temperature: float, least: float = 1e-6) -> Column:
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(least), score)), F.lit(1 / temperature))
