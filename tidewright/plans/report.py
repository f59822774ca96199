"""Reports, traces and previews of a run."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import Profile


def markdown(plan: dict, log: list[dict], before: Profile, after: Profile | None = None) -> str:
    lines = ["# Cleaning report", "", plan.get("dataset_summary", ""), "", "| | before | after |", "|-|-|-|"]
    for name, key in (("rows", "n_rows"), ("columns", "n_cols"), ("repeated rows", "n_exact_duplicate_rows"), ("empty rows", "n_empty_rows")):
        lines.append(f"| {name} | {getattr(before, key)} | {getattr(after, key) if after else ''} |")
    lines += ["", "## Table", ""] + ([f"- `{e['op']}`: {e.get('detail', '')}" for e in log if e["scope"] == "table"] or ["- nothing"])
    lines += ["", "## Columns", ""] + ([f"- **{e['column']}** `{e['op']}`: {e.get('cells_changed', 0)} cell(s). {e.get('rationale', '')}" for e in log if e["scope"] == "column"] or ["- nothing"])
    if plan.get("flags"):
        lines += ["", "## For review", ""]
        for f in plan["flags"]:
            shown = ", ".join(f"`{x}`" for x in f.get("values", []))
            lines.append(f"- **{f['column']}** {f['issue']}: {f.get('rationale', '')}" + f" {shown}" * bool(shown))
    return "\n".join(lines) + "\n"


def trace(plan: dict, log: list[dict], n_rows: int, began: float, model: str | None = None) -> dict:
    return {
        "ts": datetime.now(UTC).isoformat(),
        "model": model or plan.get("_generated_by", "unknown"),
        "n_rows": n_rows,
        "plan": plan,
        "change_log": log,
        "table_operations": len(plan.get("table_operations", [])),
        "column_operations": sum(len(c["operations"]) for c in plan.get("columns", [])),
        "cells_changed": sum(e.get("cells_changed", 0) for e in log),
        "duration_ms": round(1000 * (time.time() - began)),
    }


def append_trace(spark, path: str, record: dict) -> None:
    spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "value string").write.mode("append").text(path)


def preview(df: DataFrame, most: int = 50) -> list[dict]:
    """The first rows, as JSON holds them."""
    rows = (df.orderBy("_rid").drop("_rid") if "_rid" in df.columns else df).limit(most)
    return [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def aligned(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both tables side by side by _rid: status is kept, changed, or removed."""
    a = before.select("_rid", F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).alias("before"))
    b = after.select("_rid", F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns if c in after.columns)).alias("after"))
    status = F.when(F.col("after").isNull(), "removed").when(F.to_json("before") == F.to_json("after"), "kept").otherwise("changed")
    return a.join(b, "_rid", "left").withColumn("status", status)
