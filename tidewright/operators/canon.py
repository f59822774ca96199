"""Canonical forms of a column's values: by frequency, by key, by similarity, and how sure they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.python_only import fingerprint_udf, ratio, ratio_udf
from .reference import Reference, best, reference_types

FREQUENT, RARE, SUSPECTS, PAIRS, CANDIDATES, LEAST_SIM = 60, 4000, 25, 40, 3, 0.6


def typo_merges(keys: DataFrame) -> DataFrame:
    """(column, key, into) from (column, key, n, first): a key of five or more characters goes into
    the most frequent key one edit away that has two cells and twice as many at least."""
    a = keys.select("column", F.col("key").alias("a"), F.col("n").alias("na"))
    b = keys.where("n >= 2").select("column", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("first").alias("fb"))
    near = near_keys(a, "a", True).join(near_keys(b, "b").withColumnsRenamed({"column": "column_b", "near": "near_b"}), (F.col("column") == F.col("column_b")) & (F.col("near") == F.col("near_b")))
    near = near.where((F.length("a") >= 5) & (F.col("a") != F.col("b")) & (F.col("nb") >= 2 * F.col("na")) & (F.levenshtein("a", "b", 1) == 1))
    return near.groupBy("column", F.col("a").alias("key")).agg(F.max(F.struct("nb", -F.col("fb"), "b")).alias("m")).select("column", "key", F.col("m.b").alias("into"))


def near_keys(df: DataFrame, name: str, asks: bool = False) -> DataFrame:
    """df with a row for each key `near` of a text column; texts one edit apart share a key, if one
    side asks.

    A text is cut into 8 to 16 blocks, and a key is all of it but one block. The edit is in some
    block, whose loss makes both texts equal, if one loses a character more or less where their
    lengths differ: those who ask lose each. Keys hold nearly the whole text, so many values
    with a common beginning or end don't meet.
    """
    text, n = F.col(name), F.length(name)
    width = lambda k: F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(k, F.lit(8)) / 8.0))).cast("int")
    widths = F.array_distinct(F.array(*(width(n + d) for d in ((-1, 0, 1) if asks else (0,)))))
    losses = (-1, 0, 1) if asks else (0,)

    def of_block(w: Column, i: Column) -> Column:
        return F.array(*(F.xxhash64(w, i, F.substring(text, F.lit(1), w * i), F.substring(text, w * (i + 1) + 1 + d, n)) for d in losses))

    def of_width(w: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / w).cast("int")), lambda i: of_block(w, i)))

    return df.withColumn("near", F.explode(F.array_distinct(F.flatten(F.transform(widths, of_width)))))


def frequency_mapping(counts: DataFrame) -> DataFrame:
    """(column, raw, canonical) of values that differ from their group's most frequent surface:
    groups are country names or lower case, then typo merges, one step."""
    names = [n for n in dict.fromkeys(v.COUNTRIES.values())]
    keyed = counts.withColumn("key", v.country_key(F.col("value")))
    groups = keyed.groupBy("column", "key").agg(F.max(F.struct("n", -F.col("first"), "value")).alias("m"), F.sum("n").alias("n"), F.min("first").alias("first"))
    groups = groups.select("column", "key", "n", "first", F.when(F.col("key").isin(*names), F.col("key")).otherwise(F.col("m.value")).alias("canonical"))
    merged = groups.select("column", "key").join(typo_merges(groups), ["column", "key"], "left").select("column", "key", F.coalesce("into", "key").alias("target"))
    target = groups.select("column", F.col("key").alias("target"), "canonical")
    out = keyed.join(merged, ["column", "key"]).join(target, ["column", "target"])
    return out.where(F.col("value") != F.col("canonical")).select("column", F.col("value").alias("raw"), "canonical")


def fingerprint_mapping(counts: DataFrame) -> DataFrame:
    """(column, raw, canonical) of values that share a fingerprint with a more frequent one."""
    keyed = counts.withColumn("key", fingerprint_udf("value"))
    top = keyed.groupBy("column", "key").agg(F.max(F.struct("n", -F.col("first"), "value")).alias("m"))
    return keyed.join(top.select("column", "key", F.col("m.value").alias("canonical")), ["column", "key"]).where(F.col("value") != F.col("canonical")).select("column", F.col("value").alias("raw"), "canonical")


def nearest_mapping(counts: DataFrame, threshold: float = 0.82, most: int = 400) -> DataFrame:
    """(column, raw, canonical): each of a column's `most` most frequent values joins the first earlier
    one that it is similar to. The order matters, so it is a group of at most `most` rows at a time."""

    def attach(rows: pd.DataFrame) -> pd.DataFrame:
        kept: dict[str, list[tuple[str, str]]] = {}
        out = []
        for value in rows.sort_values("place")["value"]:
            norm = "".join(c.lower() for c in value if c.isalnum())
            if not norm:
                continue
            near = (c for c, other in kept.get(norm[0], []) if abs(len(other) - len(norm)) <= 1 + len(norm) // 3 and ratio(norm, other) >= threshold)
            if (match := next(near, None)) is not None:
                out.append((rows["column"].iloc[0], value, match))
            else:
                kept.setdefault(norm[0], []).append((value, norm))
        return pd.DataFrame(out, columns=["column", "raw", "canonical"])

    order = Window.partitionBy("column").orderBy(F.desc("n"), "first")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return top.groupBy("column").applyInPandas(attach, "column string, raw string, canonical string")


def confidence(raw: Column, canonical: Column, n_raw: Column, n_canonical: Column) -> Column:
    """How sure a repair is: nothing for frequent values, for targets that don't dominate and for
    codes whose digits or letters differ; else the similarity."""
    a, b = v.surface(raw), v.surface(canonical)
    letters = lambda c: F.lower(F.regexp_replace(c, r"\P{L}", ""))
    count, held = F.length(v.digits(raw)), F.greatest(n_raw, F.lit(1))
    code = (count > 0) & (count >= 0.15 * F.length(raw))
    off = code & ((letters(raw) == "") | (letters(canonical) == "") | (ratio_udf(letters(raw), letters(canonical)) < 0.85) | (v.digits(raw) != v.digits(canonical)))
    support = F.least(F.lit(1.0), n_canonical / (2.0 * held))
    value = F.round(F.when(a == b, F.lit(1.0)).otherwise(ratio_udf(a, b)) * (0.5 + 0.5 * support), 4)
    return F.when((a == "") | (b == "") | (n_raw >= 3) | (n_canonical < F.greatest(F.lit(2), 2 * held)) | off, F.lit(0.0)).otherwise(value)


def scored_entries(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """Entries (column, raw, canonical) with their confidence, from the column's own counts."""
    a = counts.select("column", F.col("value").alias("raw"), F.col("n").alias("n_raw"))
    b = counts.select("column", F.col("value").alias("canonical"), F.col("n").alias("n_canonical"))
    got = entries.join(a, ["column", "raw"], "left").join(b, ["column", "canonical"], "left").fillna(0, ["n_raw", "n_canonical"])
    return got.withColumn("confidence", confidence(F.col("raw"), F.col("canonical"), F.col("n_raw"), F.col("n_canonical")))


def candidate_pairs(counts: DataFrame, ref: Reference | None = None, types: DataFrame | None = None) -> DataFrame:
    """(column, raw, n, first, canonical, sim, source): rare values and the frequent values, or names
    of the column's vocabulary, that they may stand for."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "first")
    top = counts.withColumn("k", F.row_number().over(order)).where((F.col("k") <= FREQUENT) & (F.col("n") >= 2))
    top = top.select("column", F.col("value").alias("canonical"), v.surface(F.col("value")).alias("nc"), F.col("n").alias("n_canonical"))
    seen = Window.partitionBy("column").orderBy("first", "value")
    rare = counts.where("n < 3").withColumn("nr", v.surface(F.col("value"))).where("nr != ''").withColumn("k", F.row_number().over(seen)).where(F.col("k") <= RARE)
    rare = rare.select("column", F.col("value").alias("raw"), "nr", "n", "first")
    a, b = F.length("nr"), F.length("nc")
    both = rare.join(top, "column").where((F.col("raw") != F.col("canonical")) & (F.col("n_canonical") >= F.greatest(F.lit(2), 2 * F.col("n"))) & (F.substring("nr", 1, 1) == F.substring("nc", 1, 1)) & (F.abs(a - b) <= F.greatest(F.lit(2), F.floor(b / 4))) & (2 * F.least(a, b) / (a + b) >= LEAST_SIM))
    out = both.withColumn("sim", ratio_udf("nr", "nc")).where(F.col("sim") >= LEAST_SIM).select("column", "raw", "n", "first", "canonical", F.round("sim", 3).alias("sim"), F.lit("frequency").alias("source"))
    if ref is not None and types is not None:
        typed = rare.join(F.broadcast(types), "column")
        named = typed.join(best(typed.select(F.col("raw").alias("value")), ref, 0.6).withColumnRenamed("value", "raw"), ["raw", "ctype"])
        named = named.where((F.col("score") >= 0.7) & (v.surface(F.col("canonical")) != F.col("nr")))
        out = out.unionByName(named.select("column", "raw", "n", "first", "canonical", F.col("score").alias("sim"), F.concat(F.lit("reference:"), "ctype").alias("source")))
    return out


def ranked_pairs(pairs: DataFrame, most: int = PAIRS) -> DataFrame:
    """(column, raw, n, place, candidates): up to three candidates a value, nearest first, and up to
    `most` values a column in the order of their nearest."""
    rank = Window.partitionBy("column", "raw").orderBy(F.desc("sim"), F.col("source") != "frequency", "canonical")
    top = pairs.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= CANDIDATES)
    rows = top.groupBy("column", "raw", "n").agg(F.max("sim").alias("sim"), F.sort_array(F.collect_list(F.struct("k", "canonical", F.col("sim").alias("s"), "source"))).alias("c"))
    order = Window.partitionBy("column").orderBy(F.desc("sim"), "raw")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("column", "raw", "n", "place", F.transform("c", lambda x: F.struct(x["canonical"].alias("canon"), x["s"].alias("sim"), x["source"].alias("source"))).alias("candidates"))


def suspects(counts: DataFrame, ref: Reference | None = None) -> dict[str, list[dict]]:
    """By column, up to 25 rare values: those with candidates, then those with typographic marks."""
    types = reference_types(counts, ref) if ref is not None else None
    out: dict[str, list[dict]] = {}
    for r in ranked_pairs(candidate_pairs(counts, ref, types), SUSPECTS).orderBy("column", "place").collect():
        out.setdefault(r["column"], []).append({"raw": r["raw"], "count": r["n"], "candidates": [c["canon"] for c in r["candidates"]]})
    order = Window.partitionBy("column").orderBy("first", "value")
    marked = counts.where((F.col("n") < 3) & F.col("value").rlike("[" + "".join(v.PLAIN) + v.GONE + v.ELLIPSIS + "]"))
    for r in marked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * SUSPECTS).orderBy("column", "k").collect():
        have = out.setdefault(r["column"], [])
        if len(have) < SUSPECTS and r["value"] not in {x["raw"] for x in have}:
            have.append({"raw": r["value"], "count": r["n"], "candidates": []})
    return out
