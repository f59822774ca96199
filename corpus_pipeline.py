"""Pipeline over documents: language ID, SimHash near-dedup, substring dedup, secret scans, packing.

Each stage takes the rows that the one before it returned, as written and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import language, packing, secrets, simhash, spans
from tidewright.llm.common import read_table, remove, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)).select(*before.columns) if "n_chars" in before.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in no learned language go: null texts, texts without a letter, and those of whose n-grams the
    landmarks know too few. Without labels to learn from, or a column lang, texts with a letter stay."""
    return language.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays, one with its smallest doc_id."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand before go from text; rows of which nothing is left go."""
    out = spans.deduplicate(docs)
    gone = out.columns[-1]
    out = out.where(~((F.size(f"`{gone}`") > 0) & (F.trim("text") == ""))).drop(gone)
    return _counted(out, docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in text give way to a mark; all rows stay."""
    return _counted(secrets.redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the tokenizer, the classifier and the forest; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and reread. A stage's
    rows are deleted when the next one's are written: the last stage writes its pieces before it returns."""
    docs, base = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, base)
    return out
