"""Operations on whole tables: dropping, deduplication and voting across rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as v
from .profile import data_columns, looks_like_date, with_row_id

MIN_GROUP, MIN_SHARE, MOST_MINORITY = 3, 0.6, 0.25


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*(c for c in columns if c in df.columns and c != "_rid"))


def all_missing(df: DataFrame) -> Column:
    return v.all_of([v.is_missing(F.col(f"`{c}`")) for c in data_columns(df)])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(~all_missing(df))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Keeps the first of rows that are equal as written. One aggregate, combined before the shuffle,
    in place of a window, so that a row with very many copies makes no large group."""
    names = data_columns(df)
    rows = with_row_id(df).groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.min("_rid").alias("_rid"))
    return rows.select(*(F.col(f"`{c}`") for c in (*names, "_rid")))


@dataclass
class Vote:
    """What voting did: cells changed, groups in which a minority was overruled, their mean share."""

    cells: int
    groups: int
    mean_minority: float

    @property
    def declined(self) -> bool:
        return self.groups > 0 and self.mean_minority >= MOST_MINORITY


def _winners(df: DataFrame, key: str, columns: list[str], min_group: int, min_share: float) -> DataFrame:
    """(k, column, winner, minority) of each group and column with a majority and a minority."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("cell")) for c in columns))
    held = df.where(~v.is_missing(F.col(f"`{key}`"))).select(F.col(f"`{key}`").cast("string").alias("k"), F.lit(1).alias("one"), F.inline(cells))
    votes = held.groupBy("k", "column", F.when(~v.is_missing(F.col("cell")), v.strip(F.col("cell"))).alias("vote")).agg(F.count(F.lit(1)).alias("n"))
    groups = votes.groupBy("k", "column").agg(
        F.sum("n").alias("size"),
        F.coalesce(F.sum(F.when(F.col("vote").isNotNull(), F.col("n"))), F.lit(0)).alias("held"),
        F.max(F.when(F.col("vote").isNotNull(), F.struct("n", "vote"))).alias("top"),
    )
    sure = groups.where((F.col("size") >= min_group) & (F.col("held") >= min_group) & (F.col("top.n") / F.col("held") >= min_share) & (F.col("top.n") < F.col("held")))
    return sure.select("k", "column", F.col("top.vote").alias("winner"), (1 - F.col("top.n") / F.col("held")).alias("minority"), (F.col("held") - F.col("top.n")).alias("cells"))


def vote_summary(winners: DataFrame) -> DataFrame:
    return winners.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.count(F.lit(1)).alias("groups"), F.coalesce(F.avg("minority"), F.lit(0.0)).alias("mean_minority"))


def resolve_by_majority(df: DataFrame, key: str, columns: list[str], min_group: int = MIN_GROUP, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(rows, summary): minority cells of text columns take their group's majority, unless the mean
    minority over all groups and columns is a quarter or more, when nothing changes.

    Missing cells neither vote nor get filled; groups are by the key as written and missing keys
    make none. Limits given under 3 rows or 0.6 are raised to these. The rows stay lazy: the guard
    is a one-row aggregate that is joined in.
    """
    votable = [c for c in columns if c in df.columns and c != key and dict(df.dtypes)[c] == "string"]
    if key not in df.columns or not votable:
        return df, vote_summary(df.sparkSession.createDataFrame([], "k string, column string, winner string, minority double, cells long"))
    winners = _winners(df, key, votable, max(MIN_GROUP, int(min_group)), max(MIN_SHARE, float(min_share)))
    summary = vote_summary(winners)
    allowed = winners.crossJoin(F.broadcast(summary.select((F.col("mean_minority") < MOST_MINORITY).alias("allowed")))).where("allowed")  # one row
    wide = allowed.groupBy("k").agg(*(F.max(F.when(F.col("column") == c, F.col("winner"))).alias(f"__w{i}") for i, c in enumerate(votable)))
    wide = wide.withColumnRenamed("k", "__k")
    joined = df.join(wide, F.col(f"`{key}`").cast("string") == F.col("__k"), "left")
    out = []
    for c in df.columns:
        cell = F.col(f"`{c}`")
        if c in votable:
            won = F.col(f"__w{votable.index(c)}")
            cell = F.when(won.isNotNull() & ~v.is_missing(cell) & (v.strip(cell) != won), won).otherwise(cell).alias(c)
        out.append(cell)
    return joined.select(*out), summary


def entity_groups(df: DataFrame, min_group: int = MIN_GROUP, min_groups: int = 20, min_disagree: float = 0.02, looked: int = 200, counts: DataFrame | None = None, n: int | None = None) -> tuple[str, list[str]] | None:
    """(key, columns to vote on) where rows repeat for the same entity, or None.

    Keys first go through one aggregate over their frequencies; only those left are looked at in
    pairs with other columns, over the first 200 groups that are large enough. counts and n, where
    they are at hand, are the table's value_counts and rows.
    """
    from .profile import frequencies, value_counts

    names = data_columns(df)
    df = with_row_id(df)
    n = df.count() if n is None else n
    if n < 30:
        return None
    counts = counts if counts is not None else value_counts(frequencies(df))
    seen = Window.partitionBy("column").orderBy("first", "value")
    shape = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.percentile("n", F.lit(0.5)).alias("median"))
    shape = shape.where((F.col("distinct") >= min_groups) & (F.col("distinct") <= 0.5 * n) & F.col("median").between(min_group, 30))
    first = counts.join(F.broadcast(shape.select("column")), "column").withColumn("k", F.row_number().over(seen)).where(F.col("k") <= looked)
    tokens = first.groupBy("column").agg(F.avg(F.col("value").rlike(r"(?U)^[\w\-./]+$").cast("int")).alias("tokens"), F.avg(looks_like_date(F.col("value")).cast("int")).alias("dates"))
    keys = [r["column"] for r in tokens.where((F.col("tokens") >= 0.8) & (F.col("dates") <= 0.3)).collect()]
    text = [c for c, t in df.dtypes if t == "string" and c in names]
    best = None
    for key in (c for c in names if c in keys):
        others = [c for c in text if c != key]
        if not others:
            continue
        groups = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__k")).agg(F.count(F.lit(1)).alias("size"), F.min("_rid").alias("first"))
        groups = groups.where(F.col("size") >= min_group).orderBy("first").limit(looked).select("__k")
        rows = df.join(F.broadcast(groups), F.col(f"`{key}`") == F.col("__k"), "left_semi")
        checked = groups.count()
        won = _winners(rows, key, others, min_group, MIN_SHARE).groupBy("column").agg((F.count(F.lit(1)) / F.lit(max(1, checked))).alias("share"), F.count_distinct("winner").alias("winners"))
        votable = {r["column"] for r in won.where((F.col("share") >= min_disagree) & (F.col("winners") >= 2)).collect()}
        if len(votable) >= 2 and (best is None or len(votable) > len(best[1])):
            best = key, [c for c in names if c in votable]
    return best
