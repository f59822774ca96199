"""Planners: from a table and its profile to a plan and flags for what is left to people."""

from __future__ import annotations

import copy
import secrets
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import values as v
from ..operators import canon, reference, table_ops
from ..operators.profile import ColumnProfile, Profile, column_stats, data_columns, frequencies, profile, value_counts
from . import ir

Planner = Callable[[DataFrame], dict]
SHOWN = 20


@dataclass
class Config:
    """Knobs of planning. reference: vocabularies, None for the built-in ones."""

    use_reference: bool = True
    threshold: float = reference.THRESHOLD
    min_margin: float = reference.MARGIN
    case_match: bool = True
    pii_action: str = "mask"
    pii_salt: str | None = None
    hc_tau: float = 0.8
    reference: reference.Reference | None = None


def _flag(column: str, issue: str, values: list[str], why: str, **more) -> dict:
    return {"column": column, "issue": issue, "values": values[:SHOWN], "action": "left_for_review", "rationale": why, **more}


def heuristic(df: DataFrame, prof: Profile | None = None, config: Config | None = None, freq: DataFrame | None = None) -> dict:
    """The deterministic planner. All it reads is one frequency table, the one given or one that it
    keeps in memory or on disk while it plans, as it does its counts of stripped values, and joins
    over distinct values."""
    config = config or Config()
    own = freq is None
    freq = frequencies(df).persist() if own else freq
    counts = value_counts(freq).persist()
    try:
        return _planned(df, freq, counts, prof, config)
    finally:
        counts.unpersist()
        if own:
            freq.unpersist()


def _planned(df: DataFrame, freq: DataFrame, counts: DataFrame, prof: Profile | None, config: Config) -> dict:
    ref = (config.reference or reference.default_reference(df.sparkSession)) if config.use_reference else None
    prof = prof or profile(df, freq, ref, counts)
    tables = []
    if prof.n_empty_rows:
        tables.append({"op": "drop_empty_rows", "rationale": f"{prof.n_empty_rows} row(s) hold nothing."})
    if prof.empty_columns:
        tables.append({"op": "drop_empty_columns", "columns": prof.empty_columns, "rationale": "Columns that hold nothing."})
    if prof.n_exact_duplicate_rows:
        tables.append({"op": "drop_exact_duplicates", "rationale": f"{prof.n_exact_duplicate_rows} row(s) repeat another."})
    groups = table_ops.entity_groups(df, counts=counts, n=prof.n_rows)
    if groups:
        tables.append({"op": "resolve_by_majority", "key_column": groups[0], "columns": groups[1], "min_group": 3, "min_share": 0.6, "rationale": f"Rows that share '{groups[0]}' disagree in {len(groups[1])} column(s)."})
    left = [c for c in prof.columns if c.name not in prof.empty_columns]
    flags: list[dict] = []
    ops = {c.name: _format_ops(c, config, flags) for c in left}
    _canonical(freq, counts, left, ops, flags, config, ref)
    _dates(freq, left, ops, flags)
    columns = [{"name": c.name, "detected_semantic_type": c.type, "issues": c.issues, "operations": ops[c.name][0]} for c in left if ops[c.name][0]]
    return {
        "dataset_summary": f"{prof.n_rows} rows × {prof.n_cols} columns; {len(columns)} column(s) to clean and {len(tables)} operation(s) on the table.",
        "table_operations": tables,
        "columns": columns,
        "flags": flags,
        "_generated_by": "heuristic",
    }


def _format_ops(c: ColumnProfile, config: Config, flags: list[dict]) -> tuple[list[dict], bool]:
    """(operations, whether the column may still be canonicalized)."""
    ops: list[dict] = []
    if c.pii:
        kind, rate = c.pii["pii_type"], c.pii["confidence"]
        ops.append({"op": "flag_pii", "pii_type": kind, "rationale": f"{rate:.0%} of distinct values are of type {kind}" + ", with a right checksum" * c.pii["checksum"] + "."})
        sure = rate >= 0.84 or c.pii["checksum"] and rate >= 0.6
        if kind in pii.AUTO_MASK and sure and config.pii_action in ("mask", "hash", "pseudonymize"):
            op = {"op": f"{config.pii_action}_pii", "pii_type": kind, "rationale": f"Protects values of type {kind}."}
            if config.pii_action != "mask":
                op["salt"] = config.pii_salt or secrets.token_hex(8)
            return [*ops, op], False
        if not sure:
            flags.append(_flag(c.name, "possible_pii", [], f"May hold values of type {kind} ({rate:.0%})."))
        if kind in pii.IDENTIFIERS:
            return ops, False
    by_issue = {  # the order is that in which they have to run
        "mojibake": ("fix_encoding", "Text that was read in a wrong encoding."),
        "whitespace": ("strip_whitespace", "Space at the ends, or more than one between words."),
        "unicode_punctuation": ("normalize_punctuation", "Typographic marks and spaces."),
        "disguised_nulls": ("normalize_disguised_nulls", "Words that mean missing."),
    }
    ops += [{"op": op, "rationale": why} for issue, (op, why) in by_issue.items() if issue in c.issues]
    by_type = {
        "currency": ("parse_currency", "Money as numbers."),
        "number": ("parse_number", "Numbers as numbers."),
        "boolean": ("standardize_boolean", "Yes and no as true and false."),
        "email": ("normalize_email", "Addresses in lower case."),
    }
    if "uniform_percent_convention" not in c.issues:
        by_type["percent"] = ("parse_percent", "Percentages as fractions.")
    if "mixed_date_formats" in c.issues:
        by_type["date"] = ("parse_date", "Dates in different forms, as ISO dates.")
    if "inconsistent_formats" in c.issues:
        by_type["phone"] = ("standardize_phone", "Phone numbers in different forms.")
    if c.type in by_type:
        op, why = by_type[c.type]
        ops.append({"op": op, "rationale": why})
    return ops, c.type in ("country", "categorical", "text")


def _dates(freq: DataFrame, left: list[ColumnProfile], ops: dict, flags: list[dict]) -> None:
    """Flags values off the form that most dates of a column have, where the form is kept."""
    kept = [c.name for c in left if c.type == "date" and c.date_shapes > 1 and "mixed_date_formats" not in c.issues and not any(o["op"].endswith("_pii") for o in ops[c.name][0])]
    if not kept:
        return
    held = freq.where(F.col("column").isin(kept) & ~v.is_missing(F.col("raw"))).select("column", v.strip(F.col("raw")).alias("value"), v.date_shape(F.col("raw")).alias("shape"), "n", "first")
    top = held.groupBy("column", "shape").agg(F.sum("n").alias("n"), F.min("first").alias("first")).groupBy("column").agg(F.max(F.struct("n", -F.col("first"), "shape")).alias("m"))
    off = held.join(F.broadcast(top.select("column", F.col("m.shape").alias("most"))), "column").where("shape != most").groupBy("column").agg(F.count_distinct("value").alias("n"), F.slice(F.sort_array(F.collect_set("value")), 1, SHOWN).alias("values"))
    for r in off.collect():
        flags.append(_flag(r["column"], "off_convention_dates", r["values"], f"{r['n']} value(s) are off the form that most dates have."))


def _canonical(freq: DataFrame, counts: DataFrame, left: list[ColumnProfile], ops: dict, flags: list[dict], config: Config, ref: reference.Reference | None) -> None:
    """Mappings of the columns that may be canonicalized: grounded in a vocabulary where one fits,
    by frequency for categories, by suspects for other text."""
    looked = [c for c in left if ops[c.name][1]]
    if not looked:
        return
    mine = counts.where(F.col("column").isin([c.name for c in looked]))
    types = {c.name: c.type for c in looked if c.type == "country" and ref is not None}
    open_ = [c.name for c in looked if c.name not in types]
    if ref is not None and open_:
        found = reference.reference_types(mine.where(F.col("column").isin(open_)), ref)
        types |= {r["column"]: r["ctype"] for r in found.collect()}
    spark = counts.sparkSession
    if types:
        typed = spark.createDataFrame(list(types.items()), "column string, ctype string")
        got = reference.grounded(mine, ref, typed, config.threshold, config.min_margin, match_case=config.case_match).orderBy("column", "first").collect()
        for name, ctype in types.items():
            rows = [r for r in got if r["column"] == name]
            mapping = {r["value"]: r["canonical"] for r in rows if r["decision"] == "map"}
            if mapping:
                ops[name][0].append({"op": "canonicalize_categories", "mapping": mapping, "grounded": True, "rationale": f"{len(mapping)} value(s) reconciled to the {ctype} {ir.GROUNDED}."})
            unsure = [r["value"] for r in rows if r["decision"] == "abstain"]
            if unsure:
                shown = spark.createDataFrame([(x,) for x in unsure[:SHOWN]], "value string")
                near: dict[str, list] = {x: [] for x in unsure[:SHOWN]}
                for r in reference.candidates(shown, ref, ctype).orderBy("value", "place").collect():
                    near[r["value"]].append({"canon": r["canonical"], "score": r["score"]})
                kind = f"{ctype} " if ctype == next(c.type for c in looked if c.name == name) else ""
                flags.append(_flag(name, "uncertain_canonicalization", unsure, f"{len(unsure)} {kind}value(s) are near a name of the vocabulary, but not surely it.", candidates=near))
    rest = [c.name for c in looked if c.type != "text" and c.name not in types]
    if rest:
        mapping: dict[str, dict[str, str]] = {}
        for r in canon.frequency_mapping(mine.where(F.col("column").isin(rest))).collect():
            mapping.setdefault(r["column"], {})[r["raw"]] = r["canonical"]
        for name, m in mapping.items():
            ops[name][0].append({"op": "canonicalize_categories", "mapping": m, "rationale": f"{len(m)} spelling(s) of the same label."})
    texts = [c for c in looked if c.type == "text" and c.name not in types and c.suspects]
    entries = [(c.name, s["raw"], k) for c in texts for s in c.suspects for k in s["candidates"]]
    scores: dict[tuple[str, str], tuple[float, str]] = {}
    if entries:
        table = spark.createDataFrame(entries, "column string, raw string, canonical string")
        order = {e: i for i, e in enumerate(entries)}
        got = canon.scored_entries(table, mine).collect()
        for r in sorted(got, key=lambda r: order[(r["column"], r["raw"], r["canonical"])]):
            key = r["column"], r["raw"]
            if r["confidence"] > scores.get(key, (0.0, ""))[0]:
                scores[key] = r["confidence"], r["canonical"]
    for c in texts:
        sure = {s["raw"]: scores[c.name, s["raw"]][1] for s in c.suspects if scores.get((c.name, s["raw"]), (0.0,))[0] >= config.hc_tau}
        if sure:
            ops[c.name][0].append({"op": "canonicalize_categories", "mapping": sure, "rationale": f"{len(sure)} rare value(s) repaired to a frequent one (confidence {config.hc_tau} or more)."})
        unsure = [s["raw"] for s in c.suspects if s["raw"] not in sure]
        if unsure:
            flags.append(_flag(c.name, "suspect_values", unsure, f"{len(unsure)} rare value(s) without a sure repair."))


def verify(df: DataFrame, plan: dict, tau: float = 0.6) -> dict:
    """plan without entries under the confidence tau and without operations that would change a form
    that a column keeps to; what is dropped becomes flags. Grounded entries stay."""
    out = copy.deepcopy(plan)
    flags = out.setdefault("flags", [])
    names = {c.get("name") for c in out.get("columns", [])} & set(data_columns(df))
    if not names:
        return out
    freq = frequencies(df, [c for c in data_columns(df) if c in names])
    needs = {(c["name"], o["op"]) for c in out["columns"] if c["name"] in names for o in c.get("operations", []) if o["op"] in ("parse_date", "parse_percent")}
    stats = {r["column"]: r for r in column_stats(freq).collect()} if needs else {}
    entries = [(c["name"], str(r), str(k)) for c in out["columns"] if c["name"] in names for o in c["operations"] if o["op"] == "canonicalize_categories" and not ir.is_grounded(o) for r, k in o.get("mapping", {}).items()]
    sure: dict[tuple[str, str, str], float] = {}
    if entries:
        table = df.sparkSession.createDataFrame(sorted(set(entries)), "column string, raw string, canonical string")
        sure = {(r["column"], r["raw"], r["canonical"]): r["confidence"] for r in canon.scored_entries(table, value_counts(freq)).collect()}
    for c in out["columns"]:
        name = c["name"]
        if name not in names:
            continue
        s, kept = stats.get(name), []
        for o in c.get("operations", []):
            if o["op"] == "parse_date" and s and (s["share_date_shape"] is None or s["share_date_shape"] >= 0.9):
                flags.append(_flag(name, "convention_preserved", [], "The dates keep to one form already."))
            elif o["op"] == "parse_percent" and s and (s["share_percent_sign"] or 0) >= 0.9:
                flags.append(_flag(name, "convention_preserved", [], "The percentages keep to one form already."))
            else:
                kept.append(o)
        for o in kept:
            if o["op"] == "canonicalize_categories" and not ir.is_grounded(o):
                mapping = {str(r): str(k) for r, k in o.get("mapping", {}).items()}
                o["mapping"] = {r: k for r, k in mapping.items() if sure.get((name, r, k), 0.0) >= tau}
                dropped = [r for r in mapping if r not in o["mapping"]]
                o["_verified"] = {"tau": tau, "kept": len(o["mapping"]), "dropped": len(dropped)}
                if dropped:
                    flags.append(_flag(name, "low_confidence_canonicalization", dropped, f"{len(dropped)} merge(s) under the confidence {tau}."))
        c["operations"] = kept
    out["columns"] = [c for c in out["columns"] if any(o["op"] != "canonicalize_categories" or o.get("mapping") for o in c["operations"])]
    return out


def verified(base: Planner, tau: float = 0.6) -> Planner:
    return lambda df: verify(df, base(df), tau)


def grounded(base: Planner, config: Config | None = None) -> Planner:
    """base, with mappings of columns that a vocabulary fits made from it, and not freely."""
    config = config or Config()

    def plan(df: DataFrame) -> dict:
        out = copy.deepcopy(base(df))
        ref = config.reference or reference.default_reference(df.sparkSession)
        names = [c["name"] for c in out.get("columns", []) if any(o["op"] == "canonicalize_categories" for o in c.get("operations", [])) and c["name"] in df.columns]
        if not names:
            return out
        counts = value_counts(frequencies(df, names))
        types = reference.reference_types(counts, ref)
        kinds = {r["column"]: r["ctype"] for r in types.collect()}
        if not kinds:
            return out
        typed = df.sparkSession.createDataFrame(list(kinds.items()), "column string, ctype string")
        got = reference.grounded(counts, ref, typed, config.threshold, config.min_margin, match_case=config.case_match).orderBy("column", "first").collect()
        for c in out["columns"]:
            if c["name"] in kinds:
                rows = [r for r in got if r["column"] == c["name"]]
                mapping = {r["value"]: r["canonical"] for r in rows if r["decision"] == "map"}
                c["operations"] = [o for o in c["operations"] if o["op"] != "canonicalize_categories"]
                if mapping:
                    c["operations"].append({"op": "canonicalize_categories", "mapping": mapping, "grounded": True, "rationale": f"{len(mapping)} value(s) reconciled to the {kinds[c['name']]} {ir.GROUNDED}."})
                unsure = [r["value"] for r in rows if r["decision"] == "abstain"]
                if unsure:
                    out.setdefault("flags", []).append(_flag(c["name"], "uncertain_canonicalization", unsure, f"{len(unsure)} value(s) are near a name of the vocabulary, but not surely it."))
        out["columns"] = [c for c in out["columns"] if c["operations"]]
        return out

    return plan


def batched(base: Planner, size: int = 4) -> Planner:
    """base on `size` columns at a time; operations on the table come from the whole of it."""

    def plan(df: DataFrame) -> dict:
        whole = heuristic(df)
        names = data_columns(df)
        parts = [base(df.select(*(F.col(f"`{c}`") for c in names[i : i + size]))) for i in range(0, len(names), size)]
        return {
            "dataset_summary": whole["dataset_summary"],
            "table_operations": whole["table_operations"],
            "columns": [c for p in parts for c in p.get("columns", [])],
            "flags": [f for p in parts for f in p.get("flags", [])],
            "_generated_by": "batched:" + "+".join(sorted({p.get("_generated_by", "unknown") for p in parts})),
        }

    return plan


def composed(model: Planner | None = None, tau: float = 0.5, batch: int = 4) -> Planner:
    """model, checked, with what the heuristic planner adds; the heuristic one alone without a model
    and for batches in which the model fails, which the plan says."""
    if model is None:
        return heuristic

    def tried(df: DataFrame) -> dict:
        try:
            plan = model(df)
            if not ir.is_valid(plan):
                raise ValueError("no plan")
            return {**plan, "_generated_by": plan.get("_generated_by", "model")}
        except Exception as why:  # a model may fail in any way; the result says so
            return {**heuristic(df), "_generated_by": f"heuristic after {type(why).__name__}"}

    checked = verified(grounded(batched(tried, batch)), tau)

    def plan(df: DataFrame) -> dict:
        own = checked(df)
        return {**ir.union(own, heuristic(df)), "_generated_by": f"{own.get('_generated_by', 'model')}, verified, with heuristic"}

    return plan


def clustered(kind: str = "fingerprint") -> Planner:
    """Baselines that merge by fingerprint or by nearest neighbour alone. They count disguised nulls
    as values."""

    def plan(df: DataFrame) -> dict:
        freq = frequencies(df)
        counts = freq.where("raw is not null").groupBy("ord", "column", v.strip(F.col("raw")).alias("value")).agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("value != ''")
        found = canon.fingerprint_mapping(counts) if kind == "fingerprint" else canon.nearest_mapping(counts)
        by: dict[str, dict[str, str]] = {}
        for r in found.collect():
            by.setdefault(r["column"], {})[r["raw"]] = r["canonical"]
        columns = [{"name": c, "detected_semantic_type": "categorical", "issues": [], "operations": [{"op": "canonicalize_categories", "mapping": by[c], "rationale": f"Clusters by {kind}."}]} for c in data_columns(df) if c in by]
        return {"dataset_summary": f"Clusters by {kind}.", "table_operations": [], "columns": columns, "flags": [], "_generated_by": kind}

    return plan
