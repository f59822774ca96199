import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def plain(rows):
    def cell(x):
        if x is None or x != x:
            return None
        return round(x, 6) if isinstance(x, float) else str(x)

    return sorted((tuple(map(cell, r)) for r in rows), key=str)


def test_entry_has_rows(spark, entry):
    assert entry.entry(spark).limit(1).count() == 1


#: Rules on shares of rows, which need more of them.
LARGER = {"semantic_types", "pii_column_types", "typo_merge", "reference_typing", "heuristic_plan", "unpaired_plan", "verify_and_union", "suspect_pairs", "entry_confidence"}


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_queries_give_what_sql_gives(spark, entry, name):
    sf = f"/root/testdata/{name}"
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, wrong, empty = entry.queries(), [], []
    assert set(entry.oracle_sql()) <= set(queries) and LARGER <= set(entry.oracle_sql())
    for query, sql in entry.oracle_sql().items():
        if (query in LARGER) != (name == "sf0.01"):
            continue
        got = queries[query](spark, sf)
        names = sorted(got.columns)
        rows = plain(tuple(r[c] for c in names) for r in got.collect())
        want = db.sql(sql)
        if names != sorted(want.columns) or rows != plain(db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({sql})").fetchall()):
            wrong.append(query)
        if not rows:
            empty.append(query)
    assert not wrong
    assert not set(empty) - {"embedded_cards", "embedded_alerts", "embedded_pii_alerts", "calibration_error"}


def test_imports_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_llm():
    for top, _, files in os.walk(os.path.join(ROOT, "tidewright")):
        if "llm" not in os.path.relpath(top, ROOT).split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(top, f), encoding="utf-8") as x:
                        assert "llm" not in x.read(), f
