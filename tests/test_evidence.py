import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators import profile, scoring
from tidewright.plans import evidence, execute, ir


@pytest.mark.parametrize("seed", range(3))
def test_made_examples_are_recovered(spark, seed):
    clean, dirty, plan = evidence.made_example(seed)
    a, b = spark.createDataFrame(clean), spark.createDataFrame(dirty)
    assert ir.is_valid(plan) and evidence.verified_example(a, b, plan)
    broken = {**plan, "columns": plan["columns"][:-1]}
    assert not evidence.verified_example(a, b, broken)
    once = execute.apply(b, plan).rows
    assert scoring.score(b, a, once).first()["recall"] == 1.0


def column(spark, values):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], "_rid long, c string")


def test_paired_plan(spark):
    clean = column(spark, ["Manchester"] * 4 + ["Oslo", "Osla", "9:55"])
    dirty = column(spark, ["Manchester", "manchestxr", "Manchester", "Manchester", "Oslx", "Oslx", "9:45"])
    plan = evidence.paired_plan(dirty, clean)
    assert ir.canon_pairs(plan) == {("c", "manchestxr", "Manchester")} and plan["flags"][0]["values"] == ["Oslx"]
    labels = evidence.sampled_labels(dirty, clean, 2, 1).collect()
    assert len(labels) == 2 and all(r["raw"] != r["gold"] for r in labels)


def test_unpaired_plan(spark):
    values = ["Sales"] * 10 + ["sales", "SALES!", "Finance", "Finance", "Finance", "Financ", "Support", "Support", "Research", "Salez"]
    assert ir.canon_pairs(evidence.unpaired(column(spark, values))) == {("c", "sales", "Sales"), ("c", "SALES!", "Sales"), ("c", "Financ", "Finance"), ("c", "Salez", "Sales")}
    assert evidence.unpaired(column(spark, values[:5]))["columns"] == []


def test_matched_pairs(spark):
    a = spark.createDataFrame([(1, "Bob Dylan", "folk"), (2, "Neil Young", "rock")], "id int, name string, genre string")
    b = spark.createDataFrame([(7, "bob dylon", "pop"), (8, "Neil Young", "rock"), (9, "x", "y")], "id int, name string, genre string")
    m = spark.createDataFrame([(1, 7), (1, 9), (2, 8), (5, 9)], "a_id int, b_id int")
    messy, gold = evidence.matched_pairs(a, b, m, "id")
    assert sorted(map(tuple, messy.collect())) == [(1, "bob dylon", "pop"), (2, "Neil Young", "rock")]
    assert sorted(map(tuple, gold.collect())) == [(1, "Bob Dylan", "pop"), (2, "Neil Young", "rock")]


def test_alerts_and_second_tier(spark):
    df = spark.createDataFrame([(i, f"note {i} pays 4111-1111-1111-1111 soon", "4111111111111111", "Ann Lee") for i in range(5)], "_rid long, note string, card string, who string")
    got = evidence.embedded_alerts(df, {"columns": [{"name": "card", "operations": [{"op": "flag_pii"}]}]}).collect()
    assert [(r["column"], r["pii_type"], r["count"], r["example"].strip()) for r in got] == [("note", "credit_card", 5, "****-****-****-1111")]
    names = spark.createDataFrame([(i, x, str(i)) for i, x in enumerate(["Ann Lee", "Bob Ray", "Cy Fox"])], "_rid long, who string, n string")
    counts = profile.value_counts(profile.frequencies(names))
    tagger = lambda: lambda value: ["first_name"] if value[:1].isalpha() else []
    assert [tuple(r) for r in evidence.types_by_model(counts, tagger, {"first_name": "person_name"}).collect()] == [("who", "person_name", 1.0)]


def test_prompts(spark):
    prof = profile.profile(column(spark, ["a", "b", "a"]))
    text = evidence.prompt(prof, [{"c": "a"}], {"c": [{"raw": "b", "candidates": ["a"]}]})
    body = json.loads(text[text.index("{") : text.rindex("}") + 1])
    assert body["profile"]["columns"][0]["value_counts"] == [["a", 2], ["b", 1]] and "candidate" in text
    assert [m["role"] for m in evidence.chat_example(prof, [], {"table_operations": [], "columns": []})["messages"]] == ["system", "user", "assistant"]


def test_every_kth(spark):
    rows = spark.range(10_000).select(F.col("id").alias("_rid"), (F.col("id") % 97 == 0).alias("bad"))
    got = {r["_rid"] for r in evidence.every_kth(rows, F.col("bad"), 10).collect()}
    fine = [i for i in range(10_000) if i % 97]
    assert got == {i for i in range(10_000) if i % 97 == 0} | set(fine[::10])


def test_answers_of_models():
    fine = '{"table_operations": [], "columns": []}'
    cases = {"": "empty", " \n": "empty", "no plan": "no_json", '{"a": [1, 2': "no_close_brace", '{"a": ,}': "malformed_json", '{"columns": []}': "schema_invalid", f"Here: {fine} done": "valid"}
    assert {x: ir.diagnosis(x)[0] for x in cases} == cases
    assert ir.diagnosis('{"a": [1, 2', True)[0] == "truncated" and ir.diagnosis('{"columns": []}')[1] == "table_operations is not there"


def test_gate_points(spark):
    clean = column(spark, ["acme holdings"] * 8 + ["Oslo office"] * 8)
    dirty = column(spark, ["acme holdings"] * 7 + ["acme holdngs"] + ["Oslo office"] * 8)
    plan = {"table_operations": [], "columns": [{"name": "c", "operations": [{"op": "canonicalize_categories", "mapping": {"acme holdngs": "acme holdings", "Oslo office": "acme holdings"}}]}]}
    assert tuple(evidence.gate_point(dirty, clean, plan, 0.5, False).first()) == (0.5, 1.0, 1.0, 1, 1)
    assert tuple(evidence.gate_point(dirty, clean, plan, 0.0, False).first())[3:] == (9, 1)


def test_made_personal_data_passes_its_validators(spark):
    rows = spark.createDataFrame(evidence.made_personal_data(3))
    kinds = {"card": "credit_card", "iban": "iban", "ssn": "ssn", "email": "email"}
    assert {r["column"]: r["leaks"] for r in scoring.leak_rate(rows, kinds).collect()} == dict.fromkeys(kinds, 120)
