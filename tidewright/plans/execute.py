"""Plans as lazy projections, with a log of what each operation changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import values as v
from ..functions.python_only import repaired_udf
from ..operators import table_ops
from ..operators.profile import data_columns, with_row_id

#: Mappings of more entries are joined, not written into the plan as a literal.
LITERAL = 500


def cell_expression(op: dict, c: Column) -> Column:
    """What an operation makes of a cell; unknown operations leave it."""
    name = op["op"]
    simple = {
        "strip_whitespace": v.strip_whitespace,
        "normalize_punctuation": v.normalize_punctuation,
        "normalize_disguised_nulls": v.normalize_disguised_nulls,
        "parse_currency": v.parse_currency,
        "parse_number": v.parse_currency,
        "parse_date": v.parse_date,
        "standardize_boolean": v.standardize_boolean,
        "standardize_phone": v.standardize_phone,
        "normalize_email": v.normalize_email,
    }
    if name in simple:
        return simple[name](c)
    if name == "parse_percent":
        return v.parse_percent(c) if op.get("mode") == "double" else v.parse_percent_mixed(c)
    if name == "standardize_case":
        return v.standardize_case(c, op.get("case"))
    if name == "canonicalize_categories":
        return v.canonicalize(c, op.get("mapping", {}))
    if name == "collapse_internal_whitespace" and op.get("enabled"):
        return v.unless_missing(c, F.regexp_replace(c, rf"(?U){v.SPACE}+", " "))
    if name == "mask_pii":
        return pii.mask(c, op.get("pii_type", ""))
    if name == "hash_pii":
        return pii.hashed(c, op.get("salt", ""), op.get("digest_chars", 16))
    if name == "pseudonymize_pii":
        return pii.pseudonym(c, op.get("salt", ""), op.get("pii_type", "pii"), op.get("digest_chars", 6))
    return c


def rendered(c: Column, kind: str) -> Column:
    """A cell as text, as Python writes numbers and truth values."""
    if kind == "double":
        return v.python_double(c)
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


@dataclass
class Applied:
    """rows: the clean table, with _rid; log(): what changed, from one job over all operations."""

    rows: DataFrame
    _steps: DataFrame
    _entries: list[dict] = field(default_factory=list)
    _counts: dict[int, Column] = field(default_factory=dict)
    _tables: dict[int, tuple] = field(default_factory=dict)

    def log(self) -> list[dict]:
        out = [dict(e) for e in self._entries]
        if self._counts:
            got = self._steps.agg(*(F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(f"c{i}") for i, c in self._counts.items())).first()
            for i in self._counts:
                out[i]["cells_changed"] = got[f"c{i}"]
        for i, (kind, *what) in self._tables.items():
            if kind == "rows":
                out[i]["detail"] = f"removed {what[0].count() - what[1].count()} rows"
            else:
                s = what[0].first()
                vote = table_ops.Vote(s["cells"], s["groups"], s["mean_minority"])
                out[i]["cells_changed"] = 0 if vote.declined else vote.cells
                out[i]["detail"] = f"declined: minorities within '{what[1]}' groups look like updates (mean {vote.mean_minority:.0%})" if vote.declined else f"majority-resolved {vote.cells} cell(s) within '{what[1]}' groups"
        return out


def apply(df: DataFrame, plan: dict) -> Applied:
    """Table operations in the plan's order, then each column's in theirs. Columns that the table
    doesn't have are skipped, and unknown operations change nothing, so a plan can be replayed on
    next month's table. Rows keep their _rid."""
    df, entries, counts, tables = with_row_id(df), [], {}, {}
    for op in plan.get("table_operations", []):
        name, before = op["op"], df
        entry = {"scope": "table", "op": name, "rationale": op.get("rationale", "")}
        if name == "drop_empty_columns":
            gone = [c for c in op.get("columns", []) if c in df.columns]
            df = table_ops.drop_columns(df, gone)
            entry["detail"] = f"dropped columns {gone}"
        elif name == "drop_empty_rows":
            df = table_ops.drop_empty_rows(df)
            tables[len(entries)] = ("rows", before, df)
        elif name == "drop_exact_duplicates":
            df = table_ops.drop_exact_duplicates(df)
            tables[len(entries)] = ("rows", before, df)
        elif name == "resolve_by_majority":
            df, summary = table_ops.resolve_by_majority(df, op.get("key_column"), op.get("columns", []), op.get("min_group", 3), op.get("min_share", 0.6))
            tables[len(entries)] = ("vote", summary, op.get("key_column"))
        else:
            continue
        entries.append(entry)
    steps, last = df, {c: c for c in df.columns}
    for column in plan.get("columns", []):
        name = column["name"]
        if name not in last or name == "_rid":
            continue
        for op in column.get("operations", []):
            i, old = len(entries), last[name]
            new, cell = f"__s{i}", F.col(f"`{old}`")
            steps = _step(steps, op, old, new)
            kinds = dict(steps.dtypes)
            counts[i] = ~rendered(cell, kinds[old]).eqNullSafe(rendered(F.col(new), kinds[new]))
            entries.append({"scope": "column", "column": name, "op": op["op"], "rationale": op.get("rationale", "")})
            last[name] = new
    rows = steps.select(*(F.col(f"`{last[c]}`").alias(c) for c in df.columns))
    return Applied(rows, steps, entries, counts, tables)


def _step(df: DataFrame, op: dict, old: str, new: str) -> DataFrame:
    cell = F.col(f"`{old}`")
    if op["op"] == "fix_encoding":
        return _joined(df, old, new, _repairs(df, cell))
    mapping = op.get("mapping") or {}
    if op["op"] == "canonicalize_categories" and len(mapping) > LITERAL:
        table = df.sparkSession.createDataFrame(list(mapping.items()), "__raw string, __new string")
        out = df.withColumn("__key", F.when(~v.is_missing(cell), v.strip(cell))).join(table, F.col("__key") == F.col("__raw"), "left")
        return out.withColumn(new, F.coalesce("__new", cell)).drop("__key", "__raw", "__new")
    return df.withColumn(new, cell_expression(op, cell))


def _repairs(df: DataFrame, cell: Column) -> DataFrame:
    """(raw, new) of the distinct cells that hold marks of wrong decoding and can be repaired."""
    from ..functions.python_only import WRONG_DECODING

    marked = v.any_of([F.contains(cell, F.lit(m)) for m in WRONG_DECODING])
    return df.where(marked & ~v.is_missing(cell)).select(cell.alias("__raw")).distinct().select("__raw", repaired_udf("__raw").alias("__new")).where("__new != __raw")


def _joined(df: DataFrame, old: str, new: str, table: DataFrame) -> DataFrame:
    return df.join(table, F.col(f"`{old}`") == F.col("__raw"), "left").withColumn(new, F.coalesce("__new", F.col(f"`{old}`"))).drop("__raw", "__new")


def in_order(df: DataFrame) -> DataFrame:
    """Rows as they were read, without their ids."""
    return df.orderBy("_rid").drop("_rid") if "_rid" in df.columns else df


def silent_edits(before: DataFrame, applied: Applied, plan: dict) -> list[str]:
    """Columns with changed cells that no operation of the plan accounts for."""
    named = {c["name"] for c in plan.get("columns", [])} | {c for o in plan.get("table_operations", []) for c in o.get("columns", [])}
    others = [c for c in data_columns(applied.rows) if c in before.columns and c not in named]
    if not others or "_rid" not in before.columns:
        return []
    text = lambda df, name: df.select("_rid", *(rendered(F.col(f"`{c}`"), dict(df.dtypes)[c]).alias(f"{name}{i}") for i, c in enumerate(others)))
    both = text(applied.rows, "now").join(text(before, "was"), "_rid")
    got = both.agg(*(F.coalesce(F.bool_or(~F.col(f"now{i}").eqNullSafe(F.col(f"was{i}"))), F.lit(False)).alias(f"x{i}") for i in range(len(others)))).first()
    return [c for i, c in enumerate(others) if got[f"x{i}"]]
