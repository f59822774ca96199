"""Reference vocabularies, and reconciling values against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.python_only import ratio_udf

ORDER = ("country", "state", "city", "entity")
THRESHOLD, MARGIN, REVIEW = 0.84, 0.03, 0.70
# fixed values: subdivisions of the United States and their postal codes
STATES = (
    "Alabama AL, Alaska AK, Arizona AZ, Arkansas AR, California CA, Colorado CO, Connecticut CT, Delaware DE, District of Columbia DC, Florida FL, "
    "Georgia GA, Hawaii HI, Idaho ID, Illinois IL, Indiana IN, Iowa IA, Kansas KS, Kentucky KY, Louisiana LA, Maine ME, Maryland MD, Massachusetts MA, "
    "Michigan MI, Minnesota MN, Mississippi MS, Missouri MO, Montana MT, Nebraska NE, Nevada NV, New Hampshire NH, New Jersey NJ, New Mexico NM, "
    "New York NY, North Carolina NC, North Dakota ND, Ohio OH, Oklahoma OK, Oregon OR, Pennsylvania PA, Rhode Island RI, South Carolina SC, "
    "South Dakota SD, Tennessee TN, Texas TX, Utah UT, Vermont VT, Virginia VA, Washington WA, West Virginia WV, Wisconsin WI, Wyoming WY, "
    "American Samoa AS, Guam GU, Northern Mariana Islands MP, Puerto Rico PR, Virgin Islands VI"
)


def countries(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """(name, codes and other names) of each country that the Java runtime knows."""
    locale = spark.sparkContext._jvm.java.util.Locale
    english, out = locale.ENGLISH, []
    spoken: dict[str, list[str]] = {}
    for other, name in v.COUNTRIES.items():
        spoken.setdefault(name, []).append(other)
    for code in locale.getISOCountries():
        here = locale("", code)
        name = here.getDisplayCountry(english)
        out.append((name, [code, here.getISO3Country(), *spoken.get(name, [])]))
    return out


def vocabulary(spark: SparkSession, entries: dict[str, list[tuple[str, list[str]]]]) -> Reference:
    rows, at = [], 0
    for ctype, names in entries.items():
        for name, aliases in names:
            rows.append((ctype, name, True, name, at))
            rows += [(ctype, name, False, a, at) for a in aliases]
            at += 1
    return Reference(spark.createDataFrame(rows, "ctype string, canonical string, own boolean, surface string, ord int"))


class Reference:
    """exact: (ctype, norm, canonical), one row a norm, a canonical's own name before aliases and
    the later canonical before the earlier; fuzzy: (ctype, head, norm, canonical, ord) of own names."""

    def __init__(self, rows: DataFrame):
        rows = rows.withColumn("norm", v.surface(F.col("surface"))).where("norm != ''")
        first = F.struct(F.when(F.col("own"), F.col("ord")).otherwise(-1 - F.col("ord")), "canonical")
        own = rows.groupBy("ctype", "norm").agg(F.max(F.struct(F.col("own").cast("int"), first)).alias("m"))
        self.exact = own.select("ctype", "norm", F.col("m.col2.canonical").alias("canonical"))
        names = rows.where("own").groupBy("ctype", "norm").agg(F.min(F.struct("ord", "canonical")).alias("m"))
        self.fuzzy = names.select("ctype", F.substring("norm", 1, 1).alias("head"), "norm", F.col("m.canonical").alias("canonical"), F.col("m.ord").alias("ord"))
        self.types = [r[0] for r in rows.select("ctype").distinct().collect()]

    def plus(self, other: Reference) -> Reference:
        out = object.__new__(Reference)
        out.exact, out.fuzzy = self.exact.unionByName(other.exact), self.fuzzy.unionByName(other.fuzzy)
        out.types = sorted({*self.types, *other.types})
        return out


def from_lines(spark: SparkSession, path: str, ctype: str) -> Reference:
    """A vocabulary file with a name on each line."""
    lines = spark.read.text(path).select(v.strip(F.col("value")).alias("canonical")).where("canonical != ''")
    return Reference(lines.select(F.lit(ctype).alias("ctype"), "canonical", F.lit(True).alias("own"), F.col("canonical").alias("surface"), F.lit(0).alias("ord")))


def from_json_lines(spark: SparkSession, path: str, ctype: str, most: int | None = None) -> Reference:
    """Lines {canonical, aliases}; at most `most` of them."""
    got = spark.read.schema("canonical string, aliases array<string>").json(path)
    got = got.limit(most) if most else got
    own = got.select(F.lit(ctype).alias("ctype"), "canonical", F.lit(True).alias("own"), F.col("canonical").alias("surface"), F.lit(0).alias("ord"))
    other = got.select(F.lit(ctype).alias("ctype"), "canonical", F.lit(False).alias("own"), F.explode("aliases").alias("surface"), F.lit(0).alias("ord"))
    return Reference(own.union(other).where("canonical is not null"))


_default: dict[str, Reference] = {}


def default_reference(spark: SparkSession) -> Reference:
    key = spark.sparkContext.applicationId
    if key not in _default:
        _default.clear()
        _default[key] = vocabulary(spark, {"country": countries(spark), "state": [(s.rsplit(" ", 1)[0], [s.rsplit(" ", 1)[1]]) for s in STATES.split(", ")]})
    return _default[key]


def pairs(values: DataFrame, ref: Reference, floor: float = 0.0) -> DataFrame:
    """(value, ctype, canonical, ord, sim) of every name near each distinct value: same first
    character, and a length that differs by at most 1 + a third. floor drops, before the costly
    ratio, pairs whose lengths alone keep them under it."""
    own = values.select("value", v.surface(F.col("value")).alias("nv")).where("nv != ''").distinct()
    a, b = F.length("nv"), F.length("norm")
    reach = (1 + F.floor(a / 3)).cast("int")
    own = own.withColumn("size", F.explode(F.sequence(F.greatest(a - reach, F.lit(1)), a + reach)))  # each length that may match
    near = own.join(ref.fuzzy, (F.substring("nv", 1, 1) == F.col("head")) & (F.col("size") == b))
    if floor:
        near = near.where(2 * F.least(a, b) / (a + b) >= floor)
    return near.select("value", "ctype", "canonical", "ord", ratio_udf("nv", "norm").alias("sim"))


def best(values: DataFrame, ref: Reference, floor: float = 0.0) -> DataFrame:
    """(value, ctype, canonical, score, margin): exact and alias hits score 1 with margin 1; others
    the nearest name, with how far the second nearest is behind."""
    own = values.select("value").distinct()
    hit = own.withColumn("norm", v.surface(F.col("value"))).join(ref.exact, "norm").select("value", "ctype", "canonical", F.lit(1.0).alias("score"), F.lit(1.0).alias("margin"))
    rank = Window.partitionBy("value", "ctype").orderBy(F.desc("sim"), "ord", "canonical")
    near = pairs(own, ref, floor).where("sim > 0").withColumn("k", F.row_number().over(rank)).where("k <= 2")
    near = near.groupBy("value", "ctype").agg(F.max(F.when(F.col("k") == 1, F.struct("sim", "canonical"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("sim"))).alias("b"))
    near = near.select("value", "ctype", F.col("a.canonical").alias("canonical"), F.round("a.sim", 3).alias("score"), F.round(F.col("a.sim") - F.coalesce("b", F.lit(0.0)), 3).alias("margin"))
    return hit.unionByName(near.join(hit.select("value", "ctype"), ["value", "ctype"], "left_anti"))


def candidates(values: DataFrame, ref: Reference, ctype: str, k: int = 2) -> DataFrame:
    """(value, place, canonical, score): up to k names of similarity 0.6 or more, to explain."""
    hit = values.select("value").distinct().withColumn("norm", v.surface(F.col("value"))).join(ref.exact.where(F.col("ctype") == ctype), "norm")
    hit = hit.select("value", F.lit(1).alias("place"), "canonical", F.lit(1.0).alias("score"))
    rank = Window.partitionBy("value").orderBy(F.desc("score"), "ord", "canonical")
    near = pairs(values.join(hit.select("value"), "value", "left_anti"), ref, 0.6).where((F.col("ctype") == ctype) & (F.col("sim") >= 0.6))
    near = near.withColumn("score", F.round("sim", 3)).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
    return hit.unionByName(near.select("value", "place", "canonical", "score"))


def reference_types(counts: DataFrame, ref: Reference, coverage: float = 0.55, exact_floor: float = 0.2) -> DataFrame:
    """(column, ctype): the vocabulary that most of a column's first 80 values reconcile to with a
    score of 0.8; columns with fewer than four values have none."""
    from .profile import first_values

    looked = first_values(counts)
    size = looked.groupBy("column").agg(F.count(F.lit(1)).alias("size")).where("size >= 4")
    found = looked.select("column", "value").join(best(looked, ref, 0.6), "value")
    share = found.groupBy("column", "ctype").agg(F.count_if(F.col("score") >= 0.8).alias("hits"), F.count_if((F.col("score") == 1) & (F.col("margin") == 1)).alias("exact"))
    rank = F.array_position(F.array(*(F.lit(x) for x in ORDER)), F.col("ctype"))
    share = share.join(size, "column").where((F.col("ctype") != "entity") | (F.col("exact") / F.col("size") >= exact_floor))
    top = share.groupBy("column").agg(F.max(F.struct((F.col("hits") / F.col("size")).alias("share"), (-rank).alias("rank"), "ctype")).alias("m"))
    return top.where(F.col("m.share") >= coverage).select("column", F.col("m.ctype").alias("ctype"))


def case_style(value: Column) -> Column:
    letters = F.regexp_replace(value, r"\P{L}", "")
    titled = F.forall(F.regexp_extract_all(value, F.lit(r"(\p{L}+)")), lambda w: (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, F.lit(2), F.length(w))) == F.substring(w, F.lit(2), F.length(w))))
    return F.when(value.rlike(r"^\p{L}"), F.when(F.lower(letters) == letters, "lower").when(F.upper(letters) == letters, "upper").when(titled, "title").otherwise("other"))


def column_case(counts: DataFrame) -> DataFrame:
    """(column, style): the style of most cells; other styles than upper and lower count as title."""
    style = counts.withColumn("style", case_style(F.col("value"))).where("style is not null")
    top = style.groupBy("column", "style").agg(F.sum("n").alias("n"), F.min("first").alias("first")).groupBy("column").agg(F.max(F.struct("n", -F.col("first"), "style")).alias("m"))
    return top.select("column", F.when(F.col("m.style") == "other", "title").otherwise(F.col("m.style")).alias("style"))


def grounded(counts: DataFrame, ref: Reference, types: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, review: float = REVIEW, match_case: bool = True, exact_margin: bool = False) -> DataFrame:
    """(column, value, first, canonical, score, margin, decision) of rare values of columns typed by
    `types` (column, ctype): decision is map, or abstain for what is near but not sure."""
    rare = counts.where("n < 3").join(F.broadcast(types), "column")
    got = rare.join(best(rare, ref, 0.0 if exact_margin else 0.6), ["value", "ctype"]).join(column_case(counts), "column", "left")
    cased = F.when(F.col("style") == "lower", F.lower("canonical")).when(F.col("style") == "upper", F.upper("canonical")).otherwise(F.col("canonical"))
    got = got.withColumn("canonical", cased if match_case else F.col("canonical"))
    sure = (F.col("score") >= threshold) & (F.col("margin") >= margin)
    decision = F.when(sure, F.when(F.col("canonical") != F.col("value"), "map")).when(F.col("score") >= review, "abstain")
    return got.withColumn("decision", decision).where("decision is not null").select("column", "value", "first", "ctype", "canonical", "score", "margin", "decision")
