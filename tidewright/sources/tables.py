"""Reading tables as text, and writing them."""

from __future__ import annotations

import csv
import io
import itertools
import os
import re
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import python_double
from ..operators.profile import data_columns, with_row_id


def sanitized(names: list[object]) -> list[str]:
    """Names as text, column_N for blank and unnamed ones, .k after names that are taken."""
    given = [str(n).strip() if n is not None else "" for n in names]
    given = [f"column_{i + 1}" if n == "" or n.lower() == "nan" or n.startswith("Unnamed") else n for i, n in enumerate(given)]
    out: list[str] = []
    for n in given:
        new, k = n, 0
        while new in out or (k and new in given):
            k += 1
            new = f"{n}.{k}"
        out.append(new)
    return out


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True, names: list[str] | None = None, encoding: str | None = None, keep_blank: bool = True, tolerant: bool = False, most: int | None = None, multiline: bool | None = None) -> DataFrame:
    """All cells as text, blanks as "", with _rid. tolerant drops lines of a wrong width; most keeps
    that many rows. Compressed files are read by their ending.

    Files are split over tasks at their lines. Only where a line has an odd number of quotes, so that
    a cell may hold a line feed, is each file one task; multiline says so without looking. Without
    an encoding given, a file is UTF-8 if all of its lines are, else latin-1.
    """
    latin, broken = ([], False) if encoding and multiline is not None else _line_facts(spark, path)
    multiline = broken if multiline is None else multiline
    every = [] if encoding or not latin else sorted({f for f in spark.read.text(path).inputFiles()})
    if every and len(latin) < len(every):  # files of both encodings
        parts = [read_csv(spark, files, sep, header, names, code, keep_blank, tolerant, None, multiline) for files, code in ((sorted(set(every) - set(latin)), "UTF-8"), (latin, "ISO-8859-1"))]
        out = parts[0].drop("_rid").unionByName(parts[1].drop("_rid"), allowMissingColumns=True)
        out = with_row_id(out)
        return out.orderBy("_rid").limit(most) if most else out
    options = {"sep": sep, "header": False, "inferSchema": False, "multiLine": multiline, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": encoding or ("ISO-8859-1" if latin else "UTF-8"), "mode": "DROPMALFORMED" if tolerant else "PERMISSIVE"}
    found = spark.read.options(**options).options(header=header, enforceSchema=True).csv(path) if not header else spark.read.options(**{**options, "header": True}).csv(path)
    if not found.columns:
        raise ValueError("the file has no columns")
    wanted = names or _header(spark, path, options, found.columns) if header or names else [f"column_{i + 1}" for i in range(len(found.columns))]
    out = found.toDF(*sanitized(list(wanted)))
    if keep_blank:
        out = out.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns))
    out = with_row_id(out)
    return out.orderBy("_rid").limit(most) if most else out


def _header(spark: SparkSession, path: str | list[str], options: dict, found: list[str]) -> list[str]:
    """The names as the file has them: the reader renames repeated ones."""
    first = spark.read.options(**{**options, "multiLine": False}).csv(path).first()
    given = list(first) if first is not None else found
    return given if len(given) == len(found) else found


def _line_facts(spark: SparkSession, path: str | list[str]) -> tuple[list[str], bool]:
    """(files that aren't UTF-8, whether some line has an odd number of quotes), from all lines."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    facts = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.bool_or(~F.is_valid_utf8(line)).alias("latin"), F.bool_or(quotes % 2 == 1).alias("broken"))
    got = facts.where("latin or broken").collect()  # files that are out of the ordinary
    return sorted(r["file"] for r in got if r["latin"]), any(r["broken"] for r in got)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size) of the files in zip archives."""

    def listed(batches):
        for b in batches:
            rows = [(p, i.filename, i.file_size) for p, c in zip(b["path"], b["content"], strict=True) for i in zipfile.ZipFile(io.BytesIO(c)).infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "member", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(listed, "archive string, member string, size long")


def read_zipped(spark: SparkSession, path: str, member: str, sep: str = ",") -> DataFrame:
    """A delimited member of zip archives, as read_csv reads files: text, blanks as "", with _rid. An
    archive is one task, as its format asks for, and its rows leave it a thousand at a time."""

    def text(content: bytes):
        raw = zipfile.ZipFile(io.BytesIO(content)).open(member)
        try:
            for _ in io.TextIOWrapper(raw, "utf-8"):
                pass
            code = "utf-8"
        except UnicodeDecodeError:
            code = "latin-1"
        return csv.reader(io.TextIOWrapper(zipfile.ZipFile(io.BytesIO(content)).open(member), code, newline=""), delimiter=sep)

    def lists(found: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["cells"])

    def held(batches):
        contents = (c for b in batches for c in b.column(0).to_pylist())
        return (c for c in contents if member in zipfile.ZipFile(io.BytesIO(c)).namelist())

    def rows(batches):
        for content in held(batches):
            lines = text(content)
            next(lines, None)
            while part := list(itertools.islice(lines, 1000)):
                yield lists([x for x in part if x])

    def first(batches):
        for content in held(batches):
            yield lists([h for h in [next(text(content), [])] if h])

    archives = spark.read.format("binaryFile").load(path).select("content")
    head = archives.mapInArrow(first, "cells array<string>").first()
    if head is None:
        raise ValueError(f"no archive has a member {member} with columns")
    cells = archives.mapInArrow(rows, "cells array<string>")
    return with_row_id(cells.select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(sanitized(list(head["cells"]))))))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's first sheet as text; such files are small by their format."""
    table = pd.read_excel(path, dtype=str, keep_default_na=False)
    table.columns = sanitized(list(table.columns))
    return with_row_id(spark.createDataFrame(table))


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """By ending: Parquet, ORC and JSON lines with all cells as text, workbooks, else delimited text."""
    end = os.path.splitext(re.sub(r"\.(gz|bz2|zst)$", "", path))[1].lower()
    if end in (".parquet", ".orc", ".jsonl", ".json"):
        got = {".parquet": spark.read.parquet, ".orc": spark.read.orc}.get(end, spark.read.json)(path)
        return with_row_id(got.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in got.columns)))
    if end in (".xlsx", ".xls"):
        return read_excel(spark, path)
    return read_csv(spark, path, **({"sep": "\t"} if end == ".tsv" else {}) | options)


def as_text(df: DataFrame) -> DataFrame:
    """Cells as they are written: numbers and truth values as Python writes them."""
    kinds = dict(df.dtypes)
    write = {"double": python_double, "boolean": lambda c: F.when(c, "True").when(~c, "False")}
    return df.select(*(write.get(kinds[c], lambda x: x.cast("string"))(F.col(f"`{c}`")).alias(c) for c in data_columns(df)), *(["_rid"] if "_rid" in df.columns else []))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    out = as_text(df)
    out = out.orderBy("_rid").drop("_rid") if "_rid" in out.columns else out
    out.write.mode(mode).option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
