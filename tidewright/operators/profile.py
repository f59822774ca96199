"""Profiles: everything that planning reads, from one frequency table.

A table is unpivoted once into (column, raw value) and counted, which Spark combines before the
shuffle. Every figure of a column is then an aggregate over its distinct values, weighted by
their counts, so rows are read once however many figures there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pii, values as v

SHOWN, SHOWN_OF_MANY = 80, 8
TYPES = ("empty", "email", "percent", "boolean", "text", "phone", "number", "date", "currency", "country", "categorical")

# fixed values: shapes that types are told by, and parts of names
EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"(?U)^[+(]?[\d][\d\s().\-]{6,}$"
MONEY = r"(?U)^\s*[($]?\s*-?[\d][\d.,]*\s*\)?\s*$"
PERCENT = r"(?U)^\s*-?[\d][\d.,]*\s*%\s*$"
ISO_DATE = r"(?U)^\d{4}-\d{1,2}-\d{1,2}$"
SLASH_DATE = r"(?U)^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}$"
TEXT_DATE = r"(?U)^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}$|^[A-Za-z]{3,9}[\s\-]\d{2,4}$"
SERIAL = r"(?U)^\d{4,5}$"
DATE_NAMES = "date|time|day|created|updated|modified|dob"
MONEY_NAMES = "amount|price|revenue|cost"


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Ids in the order in which rows are read; only their order means anything."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "_rid"]


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ord, column, raw, n, first): each raw value of each column, how often, and its first row."""
    columns = columns or data_columns(df)
    cells = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("raw")) for i, c in enumerate(columns)))
    long = with_row_id(df).select("_rid", F.inline(cells))
    return long.groupBy("ord", "column", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("_rid").alias("first"))


def value_counts(freq: DataFrame) -> DataFrame:
    """(ord, column, value, n, first) of stripped values that aren't missing."""
    held = freq.where(~v.is_missing(F.col("raw")))
    return held.groupBy("ord", "column", v.strip(F.col("raw")).alias("value")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def top_values(counts: DataFrame, k: int = SHOWN) -> DataFrame:
    """The k most frequent values of each column, first seen first on ties; place from 1."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def first_values(counts: DataFrame, k: int = SHOWN) -> DataFrame:
    """The k values of each column that were seen first."""
    order = Window.partitionBy("column").orderBy("first", "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def has(s: Column, *marks: str) -> Column:
    return v.any_of([F.contains(s, F.lit(m)) for m in marks])


def like(s: Column, shape: str) -> Column:
    """s.rlike(shape), for the shapes above. What every text of a shape has is looked for first, in its
    bytes, as most values of a column are of other shapes and expressions cost more."""
    first = {
        EMAIL: has(s, "@"),
        PERCENT: has(s, "%"),
        PHONE: F.length(s) >= 7,
        ISO_DATE: has(s, "-"),
        SLASH_DATE: has(s, "/", "-"),
        TEXT_DATE: (F.length(s) >= 6) & (F.lower(s) != F.upper(s)),
        SERIAL: F.length(s).between(4, 5),
    }
    return first[shape] & s.rlike(shape)


def looks_like_date(s: Column) -> Column:
    day = F.when(like(s, SERIAL), s).try_cast("int")  # of nothing else, as a failed cast makes an exception with its stack
    return like(s, ISO_DATE) | like(s, SLASH_DATE) | like(s, TEXT_DATE) | F.coalesce(day.between(36000, 50000), F.lit(False))


def column_stats(freq: DataFrame) -> DataFrame:
    """A row of counts, shares and signs for each column.

    One chain of aggregates: over raw values by surface, surfaces by token, tokens by shape, shapes by
    column. Each counts the rows of the one before, so no count of distinct values has to repeat rows.
    """
    raw, s, t, n, held = (F.col(k) for k in ("raw", "s", "t", "n", "held"))
    some = lambda p: F.bool_or(F.coalesce(p, F.lit(False)))
    many = lambda p, k="n": F.coalesce(F.sum(F.when(F.coalesce(p, F.lit(False)), F.col(k))), F.lit(0))
    signs = ("spaced", "marked", "garbled", "given")
    surfaces = freq.groupBy("ord", "column", v.strip(raw).alias("s")).agg(
        F.sum("n").alias("n"),
        some((raw != v.strip(raw)) | F.contains(raw, F.lit("  "))).alias("spaced"),
        some((F.octet_length(raw) > F.length(raw)) & raw.rlike("[" + "".join(v.PLAIN) + v.GONE + v.ELLIPSIS + "]")).alias("marked"),
        some(v.any_of([F.contains(raw, F.lit(m)) for m in v.MOJIBAKE])).alias("garbled"),
        some(raw.isNotNull() & (v.strip(raw) != "")).alias("given"),
    )
    flags = {
        "email": like(s, EMAIL),
        "percent": like(s, PERCENT),
        "phone": like(s, PHONE) & (F.length(v.digits(s)) >= 7),
        "phone_marks": has(s, "(", ")", "+", "-"),
        "date": looks_like_date(s),
        "serial": like(s, SERIAL),
        "money": s.rlike(MONEY),
        "money_marks": has(s, "$", "("),
        "percent_sign": s.endswith("%"),
    }
    # smallest and greatest hash of the forms: of the texts themselves they would need a sort, not a hash aggregate
    form = F.xxhash64(F.regexp_replace(s, r"(?U)\d", "D"))
    tokens = surfaces.groupBy("ord", "column", F.lower(s).alias("t")).agg(F.sum("n").alias("n"), F.count(s).alias("k"), *(F.bool_or(c).alias(c) for c in signs), *(many(p).alias(c) for c, p in flags.items()), F.min(form).alias("least"), F.max(form).alias("most"))
    tokens = tokens.withColumn("held", F.coalesce(~t.isin(*v.NULLS), F.lit(False)))
    names = list(dict.fromkeys(v.COUNTRIES.values()))
    words = {"country": t.isin(*v.COUNTRIES), "boolean": t.isin(*v.TRUE_WORDS, *v.FALSE_WORDS)}
    shapes = tokens.groupBy("ord", "column", F.when(held, v.date_shape(t)).alias("shape")).agg(
        F.sum("n").alias("n_total"),
        many(held).alias("n_held"),
        many(held, "k").alias("n_unique"),
        F.count_if(held).alias("n_tokens"),
        F.count_if(held & ~t.isin(*v.COUNTRIES)).alias("n_other"),
        *(some(held & (v.country_of(t) == c)).alias(f"is_{i}") for i, c in enumerate(names)),
        some(held & (F.col("k") > 1)).alias("cased"),
        *(some(held & F.col(c)).alias(c) for c in signs[:3]),
        some(~held & F.col("given")).alias("given"),
        *(F.sum(F.when(held, F.col(c)).otherwise(0)).alias(c) for c in flags),
        *(many(held & p).alias(c) for c, p in words.items()),
        F.min(F.when(held, F.col("least"))).alias("least"),
        F.max(F.when(held, F.col("most"))).alias("most"),
    )
    share = lambda k: F.try_divide(F.sum(k), F.sum("n_held"))
    stats = shapes.groupBy("ord", "column").agg(
        F.sum("n_total").alias("n_total"),
        (F.sum("n_total") - F.sum("n_held")).alias("n_missing"),
        F.sum("n_unique").alias("n_unique"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_other") + sum(F.bool_or(f"is_{i}").cast("int") for i in range(len(names)))).alias("n_canonical"),
        *(share(k).alias(f"share_{k}") for k in (*flags, *words)),
        (F.min("least") != F.max("most")).alias("mixed_phone_shapes"),
        F.bool_or("spaced").alias("has_whitespace"),
        F.bool_or("marked").alias("has_punctuation"),
        F.bool_or("garbled").alias("has_mojibake"),
        F.bool_or("given").alias("has_disguised"),
        F.bool_or("cased").alias("has_casing"),
        F.try_divide(F.max(F.when(F.col("shape").isNotNull(), F.col("n_held"))), F.sum("n_held")).alias("share_date_shape"),
        F.count("shape").alias("date_shapes"),
    )
    return stats.withColumn("type", semantic_type()).withColumn("issues", issues())


def semantic_type() -> Column:
    """Of column_stats: the first rule that holds."""
    name, share = F.lower("column"), lambda k: F.col(f"share_{k}")
    n = F.col("n_total") - F.col("n_missing")
    few = (F.col("n_tokens") <= F.greatest(F.lit(10), F.floor(0.3 * n))) & (F.col("n_tokens") < n)
    return (
        F.when(n == 0, "empty")
        .when(share("email") > 0.7, "email")
        .when(share("percent") > 0.6, "percent")
        .when(share("boolean") == 1, "boolean")
        .when(name.rlike("zip|postal|zcta"), "text")
        .when((share("phone") > 0.6) & (name.rlike("phone|tel") | (share("phone_marks") > 0.3)), "phone")
        .when(share("date") > 0.6, F.when((share("serial") > 0.9) & ~name.rlike(DATE_NAMES), "number").otherwise("date"))
        .when(share("money") > 0.6, F.when((share("money_marks") > 0.1) | name.rlike(MONEY_NAMES), "currency").otherwise("number"))
        .when((name.contains("country") | (share("country") == 1)) & (share("country") > 0.5), "country")
        .when(few, "categorical")
        .otherwise("text")
    )


def issues() -> Column:
    """Of column_stats with type: names of what is wrong, in a fixed order. All cells are text."""
    kind = F.col("type")
    found = {
        "whitespace": F.col("has_whitespace"),
        "unicode_punctuation": F.col("has_punctuation"),
        "mojibake": F.col("has_mojibake"),
        "casing": F.coalesce("has_casing", F.lit(False)),
        "disguised_nulls": F.col("has_disguised"),
        "numeric_stored_as_text": kind.isin("currency", "number", "percent"),
        "mixed_date_formats": (kind == "date") & (F.col("share_date_shape") < 0.9),
        "uniform_percent_convention": (kind == "percent") & (F.col("share_percent_sign") >= 0.9),
        "inconsistent_formats": (kind == "phone") & F.coalesce("mixed_phone_shapes", F.lit(False)),
        "inconsistent_categories": kind.isin("categorical", "country") & (F.col("n_tokens") > F.col("n_canonical")),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found.items())))


def pii_types(counts: DataFrame, threshold: float = 0.6, most: int = SHOWN) -> DataFrame:
    """(column, pii_type, hit_rate, checksum): the validator that most of a column's first distinct
    values pass, the earlier one on ties; columns with fewer than three values have none."""
    checks = pii.validators(F.col("value"))
    rates = first_values(counts, most).groupBy("column").agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in checks.items()))
    ranked = F.array(*(F.struct(F.col(k).alias("rate"), F.lit(-i).alias("rank"), F.lit(k).alias("pii_type")) for i, k in enumerate(checks)))
    best = F.array_max(ranked)
    return rates.where(F.col("n") >= 3).select("column", best.alias("b")).where(F.col("b.rate") >= threshold).select("column", F.col("b.pii_type").alias("pii_type"), F.round("b.rate", 3).alias("hit_rate"), F.col("b.pii_type").isin(*pii.CHECKSUMMED).alias("checksum"))


def table_counts(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_empty_rows, n_exact_duplicate_rows."""
    names = data_columns(df)
    empty = v.all_of([v.is_missing(F.col(f"`{c}`")) for c in names]).cast("int")
    same = df.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count(F.lit(1)).alias("__n"), F.max(empty).alias("__empty"))
    zero = F.lit(0).cast("long")
    return same.agg(
        F.coalesce(F.sum("__n"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.col("__n") * F.col("__empty")), zero).alias("n_empty_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), zero).alias("n_exact_duplicate_rows"),
    )


@dataclass
class ColumnProfile:
    name: str
    type: str
    n_total: int
    n_missing: int
    n_unique: int
    values: list[tuple[str, int]]
    issues: list[str]
    pii: dict | None = None
    suspects: list[dict] = field(default_factory=list)
    date_shapes: int = 0

    @property
    def truncated(self) -> int:
        return max(0, self.n_unique - SHOWN)

    def as_dict(self) -> dict:
        return {
            "name": self.name,
            "detected_semantic_type": self.type,
            "n_total": self.n_total,
            "n_missing": self.n_missing,
            "n_unique": self.n_unique,
            "value_counts": [list(x) for x in self.values],
            "truncated_values": self.truncated,
            "suspect_values": self.suspects,
            "issues": self.issues,
            "pii": self.pii,
        }


@dataclass
class Profile:
    n_rows: int
    n_cols: int
    n_exact_duplicate_rows: int
    n_empty_rows: int
    columns: list[ColumnProfile]

    @property
    def empty_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.n_missing == c.n_total]

    def as_dict(self) -> dict:
        return {
            "n_rows": self.n_rows,
            "n_cols": self.n_cols,
            "n_exact_duplicate_rows": self.n_exact_duplicate_rows,
            "n_empty_rows": self.n_empty_rows,
            "empty_columns": self.empty_columns,
            "columns": [c.as_dict() for c in self.columns],
        }


def profile(df: DataFrame, freq: DataFrame | None = None, reference=None, counts: DataFrame | None = None) -> Profile:
    """Profile of a table: what is collected is 80 values a column at most. freq and counts, where
    they are at hand, are the table's frequencies and value_counts."""
    from .canon import suspects

    freq = freq if freq is not None else frequencies(df)
    counts = counts if counts is not None else value_counts(freq)
    total = table_counts(df).first()
    stats = {r["column"]: r for r in column_stats(freq).collect()}
    shown: dict[str, list] = {}
    for r in top_values(counts).orderBy("ord", "place").collect():
        shown.setdefault(r["column"], []).append((r["value"], r["n"]))
    personal = {r["column"]: {"pii_type": r["pii_type"], "confidence": r["hit_rate"], "tier": 1, "hit_rate": r["hit_rate"], "checksum": r["checksum"]} for r in pii_types(counts).collect()}
    out = []
    for c in data_columns(df):
        s = stats.get(c)
        if s is None:  # a table without rows
            out.append(ColumnProfile(c, "empty", 0, 0, 0, [], []))
            continue
        n = s["n_total"] - s["n_missing"]
        many = n >= 12 and s["n_unique"] > 0.8 * n
        out.append(ColumnProfile(c, s["type"], s["n_total"], s["n_missing"], s["n_unique"], shown.get(c, [])[: SHOWN_OF_MANY if many else SHOWN], list(s["issues"]), personal.get(c), date_shapes=s["date_shapes"] or 0))
    looked = [c.name for c in out if c.pii is None and c.type in ("text", "categorical", "country")]
    if looked:
        found = suspects(counts.where(F.col("column").isin(looked)), reference)
        for c in out:
            c.suspects = found.get(c.name, [])
    return Profile(total["n_rows"], len(out), total["n_exact_duplicate_rows"], total["n_empty_rows"], out)
