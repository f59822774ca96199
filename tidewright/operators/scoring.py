"""Scores of repairs, plans and confidences, and ways to make dirty tables to score on."""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.python_only import WRONG_DECODING, ratio_udf
from .profile import data_columns, frequencies, with_row_id

#: Systems whose ranks are compared in pairs at most; rows of a slot in which random edits draw.
SYSTEMS, SLOT_ROWS = 5000, 50_000


def cell_equal(a: Column, b: Column) -> Column:
    """Both missing, numbers within a millionth, or the same text. `Nan` is text."""
    x, y = v.to_double(v.strip(v.text(a))), v.to_double(v.strip(v.text(b)))
    near = F.abs(x - y) <= F.greatest(1e-6 * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-6))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(near, v.text(a) == v.text(b)))


def sem_equal(a: Column, b: Column) -> Column:
    """cell_equal, or the same but for case and space at the ends."""
    return cell_equal(a, b) | F.coalesce(v.token(a) == v.token(b), F.lit(False))


def cells(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(_rid, column, name): a row for each cell, as text."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias(name)) for c in columns))
    return df.select("_rid", F.inline(pairs))


def _zipped(dirty: DataFrame, clean: DataFrame, out: DataFrame) -> DataFrame:
    """(column, d, g, o, present) of rows that all three tables have, by _rid. The tables are joined
    whole and unpivoted after, so that a row is shuffled once and not once for each cell."""
    names = data_columns(dirty)
    packed = lambda df, k: df.select("_rid", F.struct(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast("string").alias(f"x{i}") for i, c in enumerate(names))).alias(k))
    rows = packed(dirty, "d").join(packed(clean, "g"), "_rid").join(packed(out, "o"), "_rid")
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"d.x{i}").alias("d"), F.col(f"g.x{i}").alias("g"), (F.col(f"o.x{i}") if c in out.columns else F.col(f"d.x{i}")).alias("o"), F.lit(c in out.columns).alias("present")) for i, c in enumerate(names)))
    return rows.select(F.inline(each))


def _many(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def _share(a: str, b: str, none: float = 0.0) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(none))


def score(dirty: DataFrame, clean: DataFrame, out: DataFrame) -> DataFrame:
    """One row: f1, recall, precision, damage and the counts behind them.

    A change that only rewrites the surface of its input and doesn't restore the gold cell counts as
    none; an error counts as fixed if its gold cell is back, or its meaning is and it was changed.
    """
    d, g, o = F.col("d"), F.col("g"), F.col("o")
    z = _zipped(dirty, clean, out).select(
        (~cell_equal(d, g)).alias("err"),
        (F.col("present") & ~cell_equal(o, d)).alias("moved"),
        (F.col("present") & cell_equal(o, g)).alias("back"),
        sem_equal(o, g).alias("sem"),
        sem_equal(o, d).alias("same"),
    )
    z = z.withColumn("chg", F.col("moved") & ~(F.col("same") & ~F.col("back")))
    err, chg, back, sem = (F.col(k) for k in ("err", "chg", "back", "sem"))
    got = z.agg(
        _many(err).alias("errors"),
        _many(err & (back | (sem & chg))).alias("fixed"),
        _many(chg).alias("changed"),
        _many(chg & sem).alias("good_changes"),
        _many(~err).alias("clean_cells"),
        _many(~err & chg & ~sem).alias("damaged"),
        _many(err & ~chg & ~back).alias("abstained"),
    )
    got = got.withColumns({"recall": _share("fixed", "errors"), "precision": _share("good_changes", "changed", 1.0), "damage": _share("damaged", "clean_cells")})
    return got.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0))


def raw_score(dirty: DataFrame, clean: DataFrame, out: DataFrame) -> DataFrame:
    """One row: precision, recall and f1 by equality of text, after space at the ends is taken off."""
    d, g, o = (F.coalesce(v.strip(F.col(k)), F.lit("")) for k in "dgo")
    got = _zipped(dirty, clean, out).agg(_many(d != g).alias("errors"), _many(o != d).alias("changed"), _many((o != d) & (d != g) & (o == g)).alias("tp"))
    got = got.withColumns({"precision": _share("tp", "changed"), "recall": _share("tp", "errors")})
    return got.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0))


def recovery(clean: DataFrame, out: DataFrame) -> DataFrame:
    """One row: cells, recovered and their share, of the clean table's cells."""
    z = _zipped(clean, clean, out)
    got = z.agg(F.count(F.lit(1)).alias("both"), _many(F.col("present") & cell_equal(F.col("g"), F.col("o"))).alias("recovered"))
    total = clean.agg((F.count(F.lit(1)) * len(data_columns(clean))).alias("cells"))
    return total.crossJoin(got.drop("both")).withColumn("recovery", _share("recovered", "cells"))  # two one-row tables


def repair_counts(dirty: DataFrame, clean: DataFrame, out: DataFrame) -> DataFrame:
    """One row: errors, repaired, changed and broken cells, with repair_recall and repair_precision."""
    d, g, o = F.col("d"), F.col("g"), F.col("o")
    was, now = cell_equal(d, g), cell_equal(o, g)
    moved = ~cell_equal(o, d)
    got = _zipped(dirty, clean, out).agg(_many(~was).alias("errors"), _many(~was & now).alias("repaired"), _many(moved).alias("changed"), _many(was & ~now).alias("broken"))
    return got.withColumns({"repair_recall": _share("repaired", "errors"), "repair_precision": _share("repaired", "changed")})


def edits(dirty: DataFrame, out: DataFrame) -> DataFrame:
    """(_rid, column, before, after) of every changed cell."""
    names = [c for c in data_columns(dirty) if c in out.columns]
    both = cells(dirty, names, "before").join(cells(out, names, "after"), ["_rid", "column"])
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def error_class(d: Column, g: Column) -> Column:
    """What kind of error a dirty cell is, given its gold: surface first, edit distance last."""
    d, g = F.coalesce(v.text(d), F.lit("")), F.coalesce(v.text(g), F.lit(""))
    tight = lambda c: F.regexp_replace(c, rf"(?U){v.SPACE}+", "")
    marks = lambda c: v.any_of([F.contains(c, F.lit(m)) for m in WRONG_DECODING])
    number = lambda c: v.to_double(F.regexp_replace(v.strip(c), r"[$,%]", ""))
    words = lambda c: F.array_sort(F.split(v.strip(F.lower(c)), rf"(?U){v.SPACE}+"))
    return (
        F.when((v.strip(d) == "") | (v.strip(g) == ""), "missing")
        .when(tight(d) == tight(g), "whitespace")
        .when(F.lower(tight(d)) == F.lower(tight(g)), "case")
        .when(marks(d) != marks(g), "encoding")
        .when(number(d).isNotNull() & number(g).isNotNull(), "numeric")
        .when(F.coalesce(v.parse_date(d) == v.parse_date(g), F.lit(False)), "date-format")
        .when((words(d) == words(g)) & (F.array_size(words(d)) > 1), "token-swap")
        .when(F.levenshtein(v.strip(d), v.strip(g), 2) >= 0, "typo")
        .otherwise("other")
    )


def error_classes(dirty: DataFrame, clean: DataFrame) -> DataFrame:
    """(class, n) of cells that differ from their gold."""
    z = _zipped(dirty, clean, dirty).where(~cell_equal(F.col("d"), F.col("g")))
    return z.groupBy(error_class(F.col("d"), F.col("g")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def is_variant(a: Column, b: Column) -> Column:
    """Whether one surface is another spelling of the other."""
    x, y = v.surface(a), v.surface(b)
    return (x != "") & (y != "") & ((x == y) | (ratio_udf(x, y) >= 0.72))


def variant_breakdown(dirty: DataFrame, clean: DataFrame, out: DataFrame) -> DataFrame:
    """One row: errors that are spellings of their gold, how many of these were fixed, and others."""
    z = _zipped(dirty, clean, out).where(~cell_equal(F.col("d"), F.col("g")))
    z = z.withColumn("variant", F.coalesce(is_variant(F.col("d"), F.col("g")), F.lit(False))).withColumn("fixed", sem_equal(F.col("o"), F.col("g")) & ~cell_equal(F.col("o"), F.col("d")))
    return z.agg(_many(F.col("variant")).alias("variants"), _many(F.col("variant") & F.col("fixed")).alias("variants_fixed"), _many(~F.col("variant")).alias("others"), _many(~F.col("variant") & F.col("fixed")).alias("others_fixed")).withColumn("variant_recall", _share("variants_fixed", "variants"))


def derived_entries(dirty: DataFrame, clean: DataFrame) -> DataFrame:
    """(column, raw, canonical, n, ambiguous) that an aligned pair of tables shows: spellings that are
    never right, and whether one goes to several golds."""
    z = _zipped(dirty, clean, dirty)
    right = z.where(cell_equal(F.col("d"), F.col("g"))).select("column", v.strip(F.col("d")).alias("raw")).distinct()
    wrong = z.where(~cell_equal(F.col("d"), F.col("g")) & ~v.is_missing(F.col("d")) & ~v.is_missing(F.col("g")))
    found = wrong.groupBy("column", v.strip(F.col("d")).alias("raw"), v.strip(F.col("g")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))
    found = found.join(right, ["column", "raw"], "left_anti").where(is_variant(F.col("raw"), F.col("canonical")))
    several = found.groupBy("column", "raw").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return found.join(several, ["column", "raw"])


# Confidences: tables (conf, ok).


def risk_coverage(scored: DataFrame, key: str = "id") -> DataFrame:
    """(k, coverage, risk, conf) as decisions are taken from the surest on; ties go by key.

    A running sum over all rows: sums of ranges of confidence come first, so that each range is
    summed on its own and no task has to hold all.
    """
    ranged = scored.withColumn("slot", F.floor(F.col("conf") * 1000))
    slots = ranged.groupBy("slot").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("ok").cast("long")).alias("oks"))  # 1001 rows at most
    above = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    before = slots.select("slot", F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("oks").over(above), F.lit(0)).alias("oks_before"))
    total = slots.agg(F.sum("rows").alias("n"))
    within = Window.partitionBy("slot").orderBy(F.desc("conf"), key)
    out = ranged.withColumn("i", F.row_number().over(within)).withColumn("c", F.sum(F.col("ok").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(before), "slot").crossJoin(F.broadcast(total))  # one row
    k = F.col("rows_before") + F.col("i")
    return out.select(k.alias("k"), (k / F.col("n")).alias("coverage"), (1 - (F.col("oks_before") + F.col("c")) / k).alias("risk"), "conf")


def aurc(curve: DataFrame) -> DataFrame:
    return curve.agg(F.avg("risk").alias("aurc"))


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over bins of equal width, the last one closed."""
    by = scored.groupBy(F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg(F.col("ok").cast("double")).alias("a"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def operating_point(scored: DataFrame, threshold: float) -> DataFrame:
    acted = F.col("conf") >= threshold
    return scored.agg(F.avg(acted.cast("double")).alias("coverage"), F.coalesce(F.avg(F.when(acted, F.col("ok").cast("double"))), F.lit(1.0)).alias("precision"))


def precision_curve(scored: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, kept, right, precision) of one table of scored entries (confidence, right)."""
    points = F.array(*(F.lit(float(t)) for t in taus))
    return scored.select(F.explode(points).alias("tau"), "confidence", "right").groupBy("tau").agg(_many(F.col("confidence") >= F.col("tau")).alias("kept"), _many((F.col("confidence") >= F.col("tau")) & F.col("right")).alias("hits")).withColumn("precision", _share("hits", "kept", 1.0))


# Distributions and rankings.


def jensen_shannon(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """One row: divergence in bits of two tables of counts (key, n)."""
    share = lambda df, name: df.crossJoin(F.broadcast(df.agg(F.sum("n").alias("t")))).select(key, (F.col("n") / F.col("t")).alias(name))  # noqa: E731  one row
    both = share(p, "a").join(share(q, "b"), key, "full").fillna(0.0, ["a", "b"])
    m = (F.col("a") + F.col("b")) / 2
    part = lambda x: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    return both.agg(F.coalesce(F.sum(part(F.col("a")) + part(F.col("b"))), F.lit(0.0)).alias("jsd"))


def kendall_tau(scores: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: tau-b of two scores of up to SYSTEMS systems, paired with each other; an error for more."""
    if scores.limit(SYSTEMS + 1).count() > SYSTEMS:
        raise ValueError(f"ranks of more than {SYSTEMS} systems are not compared in pairs")
    a, b = scores.select(F.col(key).alias("i"), F.col(x).alias("xa"), F.col(y).alias("ya")), scores.select(F.col(key).alias("j"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    dx, dy = F.signum(F.col("xa") - F.col("xb")), F.signum(F.col("ya") - F.col("yb"))
    got = a.join(b, F.col("i") < F.col("j")).agg(F.count(F.lit(1)).alias("n"), _many(dx == 0).alias("tx"), _many(dy == 0).alias("ty"), F.coalesce(F.sum(dx * dy), F.lit(0.0)).alias("s"))
    free = F.sqrt((F.col("n") - F.col("tx")).cast("double") * (F.col("n") - F.col("ty")))
    return got.select(F.when(free > 0, F.col("s") / free).otherwise(0.0).alias("tau"))


def set_scores(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision, recall and f1 of one set of rows against another."""
    names = gold.columns
    both = found.select(*names).distinct().withColumn("f", F.lit(1)).join(gold.distinct().withColumn("g", F.lit(1)), names, "full")
    f, g = F.col("f").isNotNull(), F.col("g").isNotNull()
    got = both.agg(_many(f & g).alias("tp"), _many(f & ~g).alias("fp"), _many(~f & g).alias("fn"))
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return got.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def double_macro(rows: DataFrame, dataset: str, kind: str, value: str) -> DataFrame:
    """One row: the mean over datasets, then over kinds of data."""
    return rows.groupBy(kind, dataset).agg(F.avg(value).alias("m")).groupBy(kind).agg(F.avg("m").alias("m")).agg(F.avg("m").alias(value))


def cost_scores(policies: DataFrame, costs: list[float]) -> DataFrame:
    """(policy, c, raw, per_error) of (policy, errors, fixed, damaged): fixes less c times damage."""
    out = policies.groupBy("policy").agg(F.sum("errors").alias("e"), F.sum("fixed").alias("f"), F.sum("damaged").alias("d"))
    return out.select("policy", "e", "f", "d", F.explode(F.array(*(F.lit(float(c)) for c in costs))).alias("c")).select("policy", "c", (F.col("f") - F.col("c") * F.col("d")).alias("raw"), F.round((F.col("f") - F.col("c") * F.col("d")) / F.col("e"), 4).alias("per_error"))


# Dirty tables.

# fixed values: letters and digits that scanners take for each other
OCR = {"0": "O", "O": "0", "1": "l", "l": "1", "I": "1", "5": "S", "S": "5", "8": "B", "B": "8", "Z": "2", "z": "2", "g": "9", "G": "6", "b": "6"}


def recurring_text(freq: DataFrame, most: int = 12) -> list[str]:
    """Columns of words that recur: those in which errors are put."""
    s = v.strip(F.col("raw"))
    held = freq.where(F.col("raw").isNotNull() & (s != ""))
    number = v.to_double(F.replace(s, F.lit(","), F.lit(""))).isNotNull()
    got = held.groupBy("ord", "column").agg(F.sum("n").alias("n"), (F.sum(F.when(s.rlike(r"\p{L}"), F.col("n")).otherwise(0)) / F.sum("n")).alias("letters"), (F.sum(F.when(number, 0).otherwise(F.col("n"))) / F.sum("n")).alias("words"), (F.count_distinct(s) / F.sum("n")).alias("distinct"))
    return [r["column"] for r in got.where("n >= 20 and letters >= 0.7 and words >= 0.7 and distinct <= 0.5").orderBy("ord").limit(most).collect()]


def injected(c: Column, kind: str, seed: Column) -> Column:
    """A cell with one error, drawn from a hash: typo, ocr, case or whitespace."""
    s, n = c, F.length(c)
    at = F.pmod(F.xxhash64(seed, F.lit("at")), F.greatest(n - 2, F.lit(1))).cast("int") + 2  # from the second character to the last but one
    draw = F.pmod(F.xxhash64(seed, F.lit("draw")), F.lit(100))
    head, here, tail = F.substring(s, F.lit(1), at - 1), F.substring(s, at, F.lit(1)), F.substring(s, at + 1, n)
    letter = F.char(F.lit(97) + F.pmod(F.ascii(F.lower(here)) - 97 + 1 + F.pmod(F.xxhash64(seed, F.lit("letter")), F.lit(25)), F.lit(26)))
    cased = F.when(here == F.upper(here), F.upper(letter)).otherwise(letter)
    swapped = F.concat(head, F.substring(tail, 1, 1), here, F.substring(tail, F.lit(2), n))
    typo = F.when((n < 4) | ~here.rlike("[A-Za-z]"), s).when(draw < 55, F.concat(head, cased, tail)).when(draw < 78, F.concat(head, tail)).otherwise(swapped)
    if kind == "typo":
        return typo
    if kind == "case":
        return F.when(draw < 34, F.upper(s)).when(draw < 67, F.lower(s)).otherwise(v.standardize_case(s, "title"))
    if kind == "whitespace":
        return F.when(draw < 34, F.concat(F.lit("  "), s)).when(draw < 67, F.concat(s, F.lit(" "))).when(F.contains(s, F.lit(" ")), F.regexp_replace(s, "^([^ ]*) ", "$1  ")).otherwise(F.concat(F.lit(" "), s))
    if kind == "ocr":
        marks = F.regexp_count(s, F.lit("[" + "".join(OCR) + "]"))
        place = F.pmod(F.xxhash64(seed, F.lit("ocr")), F.greatest(marks, F.lit(1))).cast("int")
        chars = F.filter(F.split(s, ""), lambda x: x != "")
        spots = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(chars, i.cast("int")).isin(*OCR))
        spot = F.get(spots, place)
        new = F.translate(F.substring(s, spot, F.lit(1)), "".join(OCR), "".join(OCR.values()))
        return F.when(marks > 0, F.concat(F.substring(s, F.lit(1), spot - 1), new, F.substring(s, spot + 1, n))).otherwise(typo)
    raise ValueError(kind)


def inject(clean: DataFrame, kind: str, seed: int, rate: float = 0.07, columns: list[str] | None = None) -> DataFrame:
    """The table with errors of one kind in a share of the cells of its columns of recurring words.
    What each cell gets depends on seed, row and column alone, so a lost task makes the same again."""
    df = with_row_id(clean)
    columns = columns if columns is not None else recurring_text(frequencies(df))
    out = []
    for c in df.columns:
        cell = F.col(f"`{c}`")
        if c in columns:
            mark = F.xxhash64(F.lit(seed), F.col("_rid"), F.lit(c))
            cell = F.when((F.pmod(mark, F.lit(1_000_000)) < int(rate * 1_000_000)) & (v.strip(cell) != ""), injected(cell, kind, mark)).otherwise(cell).alias(c)
        out.append(cell)
    return df.select(*out)


def random_edits(df: DataFrame, share: float, seed: int) -> DataFrame:
    """A policy to be beaten: a share of all cells takes another row's value of its column, that of a
    row drawn by hash. Cells meet by a shuffled position, not in pairs."""
    df = with_row_id(df)
    names, slots = data_columns(df), F.lit(max(256, df.count() // SLOT_ROWS))
    other = df.select("_rid", *(F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(names)))
    ordered = lambda d, salt: d.withColumn("__k", F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "_rid"), F.lit(1 << 40)))
    slot = Window.partitionBy(F.pmod("__k", slots)).orderBy("__k", "_rid")
    size = Window.partitionBy(F.pmod("__k", slots))
    a = ordered(df, "a").withColumn("__s", F.pmod("__k", slots)).withColumn("__i", F.row_number().over(slot))
    b = ordered(other, "a").withColumn("__s", F.pmod("__k", slots)).withColumn("__n", F.count(F.lit(1)).over(size)).withColumn("__i", F.row_number().over(slot))
    b = b.withColumn("__i", F.pmod(F.col("__i"), F.col("__n")) + 1).drop("_rid", "__k", "__n")
    both = a.join(b, ["__s", "__i"], "left")
    out = [F.when(F.pmod(F.xxhash64(F.lit(seed), "_rid", F.lit(c)), F.lit(1_000_000)) < int(share * 1_000_000), F.coalesce(F.col(f"__o{i}"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(names)]
    return both.select("_rid", *out)


def modal_surfaces(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, canonical, aliases): the most frequent surface of each entity, and its other spellings."""
    n = rows.where(~v.is_missing(F.col(value))).groupBy(key, v.strip(F.col(value)).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(key).agg(F.max(F.struct("n", "s")).alias("m")).select(key, F.col("m.s").alias("canonical"))
    other = n.join(top, key).where((F.col("s") != F.col("canonical")) & is_variant(F.col("s"), F.col("canonical"))).groupBy(key).agg(F.sort_array(F.collect_set("s")).alias("aliases"))
    return top.join(other, key, "left").select(key, "canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def leak_rate(out: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(column, cells, leaks): cells of masked columns that still pass their type's validator."""
    from ..functions import pii

    rows = [F.struct(F.lit(c).alias("column"), F.coalesce(pii.validators(v.strip(F.col(f"`{c}`").cast("string")))[kind], F.lit(False)).cast("int").alias("leak")) for c, kind in columns.items()]
    return out.select(F.inline(F.array(*rows))).groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.sum("leak").alias("leaks"))


def equivalence(differences: list[float], margin: float, draws: int = 10_000, seed: int = 0) -> dict[str, float]:
    """Whether the mean of a few paired differences lies within a margin of zero: two one-sided t tests,
    of which the greater p counts, and a bootstrap interval of 90 %. For tables of scores, one row
    a system; None for p where there are fewer than two or all are equal."""
    d = np.asarray(differences, float)
    n, mean = len(d), float(d.mean())
    sd = float(d.std(ddof=1)) if n > 1 else 0.0
    above, below = (_upper_tail((x * sd**-1) * n**0.5, n - 1) if sd else None for x in (mean + margin, margin - mean))
    means = d[np.random.default_rng(seed).integers(0, n, (draws, n))].mean(1)
    low, high = np.percentile(means, [5, 95])
    return {"n": n, "mean": mean, "sd": sd, "p_above": above, "p_below": below, "p": None if above is None else max(above, below), "low": float(low), "high": float(high), "within": bool(-margin < low and high < margin)}


def _upper_tail(t: float, freedom: int, steps: int = 20_000) -> float:
    """Share of Student's distribution over t: by Simpson's rule over the angle whose tangent is t / sqrt(freedom)."""
    angle = np.linspace(0.0, np.arctan(abs(t) / freedom**0.5), steps + 1)
    y = np.cos(angle) ** (freedom - 1)
    area = (angle[-1] / steps / 3) * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    whole = np.exp(lgamma(freedom / 2) - lgamma((freedom + 1) / 2)) * np.pi**0.5  # from minus to plus a right angle
    return 0.5 - float(np.sign(t) * area / whole)
