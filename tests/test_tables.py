import json
import zipfile

import pytest
from pyspark.sql import functions as F

import tidewright
from tidewright.operators import canon, profile, reference, table_ops
from tidewright.plans import execute, ir, planner, report
from tidewright.sources import tables
from tidewright.streaming import replay

#: Sixteen rows with the usual dirt: an empty row, two repeated rows, an empty column.
CONTACTS = """name,email,company,country,signup_date,amount,phone,status,is_active,age,notes
Mia Berg ,MIA@MAIL.ORG,Nordwind AG,USA,2023-01-05,"$1,200.50",(555) 201-3001,Won,Yes,31,
Leo  Marsh,leo@mail.org,nordwind ag ,U.S.A.,01/06/2023,810,555.201.3002,won,Y,44,
Ida Falk,ida@mail.org,Lumen,united states,14/02/2023,"1.350,75",+1 555 201 3003,WON,TRUE,28,
Tom Rey,tom@mail.org,lumen,US,5 Jan 2023,(500),5552013004,Lost,1,51,
Eva Lund,eva@mail.org,Kestrel,Canada,44931,"2,450",555-201-3005,lost,No,999,
Max Ode,MAX@MAIL.ORG ,kestrel,canada,2023-02-14,,(555)201-3006,In Progress,N,,
Zoe Hall,zoe@mail.org,Arbor,UK,15/02/2023,"$3,100",+44 20 7000 0007,in-progress,FALSE,37,
Jan Pohl,jan@mail.org,arbor co,U.K.,2023-03-01,"1,725.00",020 7000 0008,Won,0,N/A,
Amy Tran,AMY@MAIL.ORG,\u201cVega\u201d,Germany,03/02/2023,"4.400,00",555 201 3009,WON,yes,46,
Kai Wolf,kai@mail.org,Vega Ltd,germany,2 Mar 2023,2300,(555) 201-3010,Lost,no,32,
Mia Berg ,MIA@MAIL.ORG,Nordwind AG,USA,2023-01-05,"$1,200.50",(555) 201-3001,Won,Yes,31,
Mia Berg ,MIA@MAIL.ORG,Nordwind AG,USA,2023-01-05,"$1,200.50",(555) 201-3001,Won,Yes,31,
,,,,,,,,,,
Ben Stone,ben@mail.org,Quarry,United States,2023-04-10,"$5,300.00",+1 (555) 201-3013,Won,TRUE,48,
Liv Dahl,liv@mail.org,quarry inc,USA ,10/04/2023,-,555.201.3014,in progress,T,30,
Nia Cole,nia@mail.org,Summit,U.S.A,2023-05-22,"6,100",5552013015,Won,F,40,
"""


def frame(spark, rows, schema, parts=2):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_rid long, " + schema)
    return df.repartition(parts)


def profiled(spark, rows, schema):
    return {c.name: c for c in profile.profile(frame(spark, rows, schema)).columns}


def test_profile(spark):
    rows = [("a", " Won", ""), ("a", "won", "N/A"), ("b", "WON ", None), (None, "Lost", ""), ("a", " Won", "")]
    df = frame(spark, rows, "k string, status string, gone string")
    p = profile.profile(df)
    assert (p.n_rows, p.n_cols, p.n_exact_duplicate_rows, p.n_empty_rows, p.empty_columns) == (5, 3, 1, 0, ["gone"])
    by = {c.name: c for c in p.columns}
    assert by["k"].values == [("a", 3), ("b", 1)] and by["k"].n_missing == 1
    assert by["status"].values[0] == ("Won", 2) and by["status"].issues[:2] == ["whitespace", "casing"]
    assert by["gone"].type == "empty" and by["gone"].issues == ["disguised_nulls"]
    empty = profile.profile(frame(spark, [], "a string, b string"))
    assert empty.n_rows == 0 and [c.type for c in empty.columns] == ["empty", "empty"]


def test_types(spark):
    rows = [(f"u{i}@x.org", f"{i}%", "yes" if i % 2 else "no", f"9021{i % 10}", f"(555) 123-45{i:02}", f"{i + 1}/14/2023", str(44900 + i), f"${i}.50", ["USA", "UK"][i % 2], ["red", "blue"][i % 2], f"words number {i} of many") for i in range(12)]
    got = profiled(spark, rows, "email string, pct string, flag string, zip_code string, phone string, day string, serials string, amount string, country string, colour string, note string")
    assert [c.type for c in got.values()] == ["email", "percent", "boolean", "text", "phone", "date", "number", "currency", "country", "categorical", "text"]
    assert "uniform_percent_convention" in got["pct"].issues and got["email"].pii["pii_type"] == "email"


def test_partition_count_does_not_matter(spark):
    rows = [(x, y) for x, y in zip("abcabcabcd" * 5, "zzyyxxwwvv" * 5, strict=True)]
    one, eight = (profile.profile(frame(spark, rows, "a string, b string", n)).as_dict() for n in (1, 8))
    assert one == eight


def test_clean_table_stays(spark):
    df = frame(spark, [("Ann Lee", "ann@x.org", "1/5/2023"), ("Bob Ray", "bob@x.org", "1/6/2023"), ("Cy Fox", "cy@x.org", "2/7/2023")], "name string, email string, signup_date string")
    got = tidewright.clean(df)
    assert sorted(got.applied.rows.collect()) == sorted(df.select(*got.applied.rows.columns).collect())
    assert all(e.get("cells_changed", 0) == 0 for e in got.applied.log())


def test_contacts_end_to_end(spark, tmp_path):
    (tmp_path / "contacts.csv").write_text(CONTACTS, encoding="utf-8")
    df = tables.read_table(spark, str(tmp_path / "contacts.csv"))
    got = tidewright.clean(df)
    rows = got.applied.rows.orderBy("_rid").collect()
    assert got.before.n_rows == 16 and len(rows) == 13 and "notes" not in got.applied.rows.columns and ir.is_valid(got.plan)
    assert rows[0]["amount"] == 1200.5 and rows[3]["amount"] == -500.0 and rows[4]["signup_date"] == "2023-01-05"
    assert {r["status"] for r in rows} <= {"Won", "Lost", "In Progress", "in-progress", "in progress"} and rows[1]["is_active"] is True
    log = got.applied.log()
    text = report.markdown(got.plan, log, got.before)
    assert "removed 2 rows" in text and "parse_currency" in text
    tables.write_csv(got.applied.rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 13 and "1200.5" in {r["amount"] for r in back.collect()}
    again = execute.apply(df, ir.read(ir.serialize(got.plan))).rows.orderBy("_rid").collect()
    assert again == rows
    assert execute.silent_edits(df, got.applied, got.plan) == []
    report.append_trace(spark, str(tmp_path / "trace"), report.trace(got.plan, log, 16, 0.0))
    assert json.loads(spark.read.text(str(tmp_path / "trace")).first()[0])["n_rows"] == 16
    hidden = execute.silent_edits(df, got.applied, got.plan)
    told = ir.span({"plan": got.plan, "change_log": log, "unaccounted": hidden})["attributes"]
    assert told["tidewright.columns_changed_silently"] == [] and told["tidewright.logged"] and told["tidewright.cells_changed"] == sum(e.get("cells_changed", 0) for e in log) > 0
    assert "tidewright.logged" not in ir.span({"plan": got.plan})["attributes"] and not ir.monitor(got.plan, log[:-1])["logged"]
    assert len(report.preview(got.applied.rows, 5)) == 5
    status = {r["status"]: r["n"] for r in report.aligned(df, got.applied.rows, ["name", "amount"]).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert status["removed"] == 3


def test_drops(spark):
    df = frame(spark, [("1", ""), ("N/A", ""), ("1", ""), ("2", "")], "a string, junk string")
    out = table_ops.drop_exact_duplicates(table_ops.drop_empty_rows(table_ops.drop_columns(df, ["junk", "no"])))
    assert sorted((r["a"], r["_rid"]) for r in out.collect()) == [("1", 0), ("2", 3)]


def votes(spark, groups, **more):
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    out, summary = table_ops.resolve_by_majority(frame(spark, rows, "k string, v string"), "k", ["v"], **more)
    return [r["v"] for r in out.orderBy("_rid").collect()], summary.first()


def test_votes(spark):
    got, s = votes(spark, {"a": ["x"] * 5 + ["y"], "b": ["z"] * 4, "N/A": ["p", "p", "p", "p", "q"], "c": ["m", "m"], "d": [" w "] * 4 + [None, "-"]})
    assert got == ["x"] * 6 + ["z"] * 4 + ["p"] * 4 + ["q"] + ["m"] * 2 + [" w "] * 4 + [None, "-"] and (s["cells"], s["groups"]) == (1, 1)
    fat, s = votes(spark, {"a": ["x", "x", "y"], "b": ["u", "u", "w"]})
    assert fat == ["x", "x", "y", "u", "u", "w"] and s["mean_minority"] > 0.25
    clamped, _ = votes(spark, {"a": ["x", "y", "y", "x", "z"]}, min_group=1, min_share=0.0)
    assert clamped == ["x", "y", "y", "x", "z"]
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, n int")
    assert table_ops.resolve_by_majority(df, "k", ["n"])[0].collect() == df.collect()


def test_entity_groups(spark):
    rows = [(f"AA-{1000 + i}", f"g{(i + (j == 0 and i % 3 == 0)) % 50}", f"t{i % 7 + (j == 1 and i % 4 == 0) * 10}", "same") for i in range(25) for j in range(5)]
    df = frame(spark, rows, "flight string, gate string, dep string, src string")
    assert table_ops.entity_groups(df) == ("flight", ["gate", "dep"])
    assert table_ops.entity_groups(frame(spark, rows[:20], "flight string, gate string, dep string, src string")) is None


def counted(spark, values):
    return profile.value_counts(profile.frequencies(frame(spark, [(x,) for x in values], "c string")))


def mapping(df):
    return {r["raw"]: r["canonical"] for r in df.collect()}


def test_frequency_mapping(spark):
    got = mapping(canon.frequency_mapping(counted(spark, ["manchester"] * 4 + ["manchestxr", "Manchester", "USA", "us", "other", "abcd", "abce", "abce"])))
    assert got == {"manchestxr": "manchester", "Manchester": "manchester", "USA": "United States", "us": "United States"}


def edit(a, b):
    return abs(len(a) - len(b)) < 2 and a != b and (sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any((a if len(a) > len(b) else b)[:i] + (a if len(a) > len(b) else b)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))


def test_typo_merge_finds_every_edit(spark):
    import random

    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randint(4, 9))) for _ in range(250)]
    counts = {w: words.count(w) * (1 + 9 * (i % 3 == 0)) for i, w in enumerate(dict.fromkeys(words))}
    keys = spark.createDataFrame([("c", w, n, i) for i, (w, n) in enumerate(counts.items())], "column string, key string, n long, first long")
    got = {r["key"]: r["into"] for r in canon.typo_merges(keys).collect()}
    want = {}
    for a, na in counts.items():
        near = [(counts[b], -i, b) for i, b in enumerate(counts) if len(a) >= 5 and counts[b] >= 2 and counts[b] >= 2 * na and edit(a, b)]
        if near:
            want[a] = max(near)[2]
    assert got == want and len(want) > 20


def test_clusters(spark):
    counts = counted(spark, ["Acme Inc", "Acme Inc", "inc. acme", "Globex", "Globx", "Globex", "Zeta"])
    assert mapping(canon.fingerprint_mapping(counts)) == {"inc. acme": "Acme Inc"}
    assert mapping(canon.nearest_mapping(counts)) == {"Globx": "Globex"}


@pytest.fixture(scope="module")
def ref(spark):
    return reference.vocabulary(spark, {"city": [("Manchester", []), ("Georgetown", []), ("Box", []), ("Bonn", []), ("Norvakia", ["NK"]), ("Norvenia", ["NI"])]})


def test_reconcile(spark, ref):
    values = spark.createDataFrame([(x,) for x in ("manchestxr", "lxuisvillx", "NK", "Norvia", "", "  ", "q" * 1000, "Boxy")], "value string")
    got = {r["value"]: (r["canonical"], r["score"], r["margin"]) for r in reference.best(values, ref).collect()}
    assert got["manchestxr"] == ("Manchester", 0.9, 0.9) and got["NK"] == ("Norvakia", 1.0, 1.0)
    assert got["Norvia"][1] == 0.857 and got["Norvia"][2] == 0.0 and "lxuisvillx" not in got and "" not in got and "q" * 1000 not in got
    near = [(r["canonical"], r["score"]) for r in reference.candidates(values.where("value = 'Norvia'"), ref, "city").orderBy("place").collect()]
    assert near == [("Norvakia", 0.857), ("Norvenia", 0.857)]


def test_grounding(spark, ref):
    counts = counted(spark, ["Manchester"] * 3 + ["Manchestxr", "Norvia", "Leeds", "Georgetwn"])
    types = spark.createDataFrame([("c", "city")], "column string, ctype string")
    got = {r["value"]: (r["decision"], r["canonical"]) for r in reference.grounded(counts, ref, types).collect()}
    assert got["Manchestxr"] == ("map", "Manchester") and got["Georgetwn"] == ("map", "Georgetown") and got["Norvia"][0] == "abstain" and "Leeds" not in got and "Manchester" not in got


def test_countries(spark):
    values = counted(spark, ["Germny", "FRANCE", "usa", "Brazil", "Japan"])
    index = reference.default_reference(spark)
    assert [r["ctype"] for r in reference.reference_types(values, index).collect()] == ["country"]
    got = {r["value"]: r["canonical"] for r in reference.best(values, index).where("ctype = 'country'").collect()}
    assert got == {"Germny": "Germany", "FRANCE": "France", "usa": "United States", "Brazil": "Brazil", "Japan": "Japan"}


def test_suspects_and_confidence(spark):
    values = ["acme holdings"] * 6 + [f"firm number {i} of town" for i in range(30)] + ["acme holdngs", "zzz qqq"]
    counts = counted(spark, values)
    found = canon.suspects(counts)["c"]
    assert found[0] == {"raw": "acme holdngs", "count": 1, "candidates": ["acme holdings"]} and len(found) <= 25
    table = spark.createDataFrame([("c", "acme holdngs", "acme holdings"), ("c", "acme holdings", "zzz qqq"), ("c", "zzz qqq", "firm number 1 of town")], "column string, raw string, canonical string")
    got = {r["raw"]: r["confidence"] for r in canon.scored_entries(table, counts).collect()}
    assert got["acme holdngs"] > 0.9 and got["acme holdings"] == 0 and got["zzz qqq"] == 0


def test_codes_keep_their_digits(spark):
    counts = counted(spark, ["amix-2", *["ami-2"] * 5, "ami-3", "ak_hf-12", *["al_hf-12"] * 5])
    table = spark.createDataFrame([("c", "amix-2", "ami-2"), ("c", "ami-3", "ami-2"), ("c", "ak_hf-12", "al_hf-12")], "column string, raw string, canonical string")
    got = {r["raw"]: r["confidence"] for r in canon.scored_entries(table, counts).collect()}
    assert got["ami-3"] == 0 and got["ak_hf-12"] == 0 and got["amix-2"] > 0.8


def test_verify(spark):
    rows = [("1/2/2023", "5%", x) for x in ["de kalb"] * 8 + ["de klab", "yex"]]
    df = frame(spark, rows, "d string, p string, c string")
    op = lambda o, **k: {"op": o, **k}
    plan = {
        "table_operations": [],
        "columns": [
            {"name": "d", "operations": [op("parse_date")]},
            {"name": "p", "operations": [op("parse_percent"), op("strip_whitespace")]},
            {"name": "c", "operations": [op("canonicalize_categories", mapping={"de klab": "de kalb", "yex": "yexu", "de kalb": "yex"})]},
        ],
    }
    out = planner.verify(df, plan, 0.5)
    assert {c["name"]: [o["op"] for o in c["operations"]] for c in out["columns"]} == {"p": ["strip_whitespace"], "c": ["canonicalize_categories"]}
    assert out["columns"][1]["operations"][0]["mapping"] == {"de klab": "de kalb"} and [f["issue"] for f in out["flags"]].count("convention_preserved") == 2
    assert plan["columns"][0]["operations"] and "flags" not in plan


def test_planner_gates(spark):
    uniform = [(f"{i % 12 + 1}/{i % 27 + 1}/2023", f"(555) 123-45{i:02}", f"{i}%") for i in range(20)]
    plan = planner.heuristic(frame(spark, uniform, "issue_date string, phone string, rate string"))
    assert not {o["op"] for c in plan["columns"] for o in c["operations"]} & {"parse_date", "standardize_phone", "parse_percent"}
    off = [*[(f"{i % 12 + 1}/{i % 27 + 1}/2023",) for i in range(19)], ("5 Jan 2023",)]
    plan = planner.heuristic(frame(spark, off, "issue_date string"))
    assert [f["values"] for f in plan["flags"] if f["issue"] == "off_convention_dates"] == [["5 Jan 2023"]]
    mixed = [(f"2023-01-{i + 1:02}" if i % 2 else f"{i + 1} Jan 2023",) for i in range(20)]
    assert "parse_date" in {o["op"] for c in planner.heuristic(frame(spark, mixed, "start string"))["columns"] for o in c["operations"]}


def card(i):
    body = f"411111111{i:06}"
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def test_personal_data(spark):
    rows = [(card(i), f"u{i}@x.org", "Oslo") for i in range(5)]
    df = frame(spark, rows, "card string, email string, city string")
    plan = planner.heuristic(df)
    ops = {c["name"]: [o["op"] for o in c["operations"]] for c in plan["columns"]}
    assert ops["card"] == ["flag_pii", "mask_pii"] and ops["email"][0] == "flag_pii" and "mask_pii" not in ops["email"]
    out = execute.apply(df, plan).rows.collect()
    assert all(r["card"].startswith("************") for r in out)
    hashed = planner.heuristic(df, config=planner.Config(pii_action="hash", pii_salt="fixed"))
    assert [o["salt"] for c in hashed["columns"] for o in c["operations"] if o["op"] == "hash_pii"] == ["fixed"]


def test_large_mappings_and_mojibake(spark):
    wrong = "cafÃ©"
    df = frame(spark, [(f"v{i}", wrong if i % 2 else "plain") for i in range(700)], "a string, b string")
    plan = {"table_operations": [], "columns": [{"name": "a", "operations": [{"op": "canonicalize_categories", "mapping": {f"v{i}": f"w{i}" for i in range(600)}}]}, {"name": "b", "operations": [{"op": "fix_encoding"}, {"op": "standardize_case", "case": "upper"}]}]}
    got = execute.apply(df, plan)
    rows = {r["_rid"]: r for r in got.rows.collect()}
    assert rows[5]["a"] == "w5" and rows[650]["a"] == "v650" and rows[1]["b"] == "CAFÉ" and rows[2]["b"] == "PLAIN"
    assert [e["cells_changed"] for e in got.log()] == [600, 350, 700]


def test_plan_algebra():
    op = lambda o, **k: {"op": o, **k}
    a = {"table_operations": [], "columns": [{"name": "c", "operations": [op("canonicalize_categories", mapping={"x": "X"})]}]}
    b = {"table_operations": [op("resolve_by_majority", key_column="k", columns=["c"]), op("drop_empty_rows")], "columns": [{"name": "c", "operations": [op("fix_encoding"), op("strip_whitespace"), op("parse_date"), op("canonicalize_categories", mapping={"x": "no", "y": "Y"})]}, {"name": "d", "operations": [op("flag_pii")]}], "flags": [{}]}
    out = ir.union(a, b)
    assert [o["op"] for o in out["columns"][0]["operations"]] == ["fix_encoding", "strip_whitespace", "canonicalize_categories"] and len(out["columns"]) == 1
    assert out["columns"][0]["operations"][2]["mapping"] == {"x": "X", "y": "Y"} and [o["op"] for o in out["table_operations"]] == ["resolve_by_majority"]
    assert a["columns"][0]["operations"][0]["mapping"] == {"x": "X"}
    voted, seen = ir.vote([a, a, b], 2)
    assert ir.canon_pairs(voted) == {("c", "x", "X")} and seen["proposed"] == 3 and seen["shares"] == {("c", "x", "X"): 0.667} and seen["by_votes"] == {2: 1, 1: 2}
    every = ir.vote([a, b, b], 1)[0]
    assert ir.canon_pairs(every) == {("c", "x", "no"), ("c", "y", "Y")} and [o["op"] for o in every["columns"][0]["operations"]] == ["fix_encoding", "strip_whitespace", "parse_date", "canonicalize_categories"]
    fixed = ir.calibrate(a, [(0, "c", "x", "Z"), (1, "c", "q", "Q"), (2, "c", "r", "1"), (3, "c", "r", "2"), (4, "e", "m", "M")])
    assert ir.canon_pairs(fixed) == {("c", "x", "Z"), ("c", "q", "Q"), ("e", "m", "M")}
    assert ir.canon_pairs(ir.constrain(b, {"c": {"y": {"Y"}}})) == {("c", "y", "Y")}
    assert ir.op_pairs(ir.cell_only(b)) >= {("*", "resolve_by_majority"), ("d", "flag_pii")} and ("*", "drop_empty_rows") not in ir.op_pairs(ir.cell_only(b))
    assert ir.op_pairs(ir.repairs_only(b)) == {("c", "canonicalize_categories")}
    seen = ir.monitor({**b, "flags": [{"issue": "uncertain_canonicalization", "values": ["p", "q"]}, {"issue": "other", "values": ["r"]}]})
    assert seen["mapped_values"] == 2 and seen["pii_columns"] == 1 and seen["unsure_share"] == 0.5 and seen["values_for_review"] == 3 and seen["columns_changed_silently"] is None


def test_plan_text():
    plan = {"table_operations": [{"op": "drop_empty_rows"}], "columns": [{"name": "a", "operations": [{"op": "parse_date", "_x": 1}]}], "_by": "me"}
    text = ir.serialize(plan)
    assert "_x" not in text and "_by" not in text and ir.read(f"Here it is: {text} done") == {"table_operations": plan["table_operations"], "columns": [{"name": "a", "operations": [{"op": "parse_date"}]}]}
    cut = '{"table_operations": [], "columns": [{"name": "a", "operations": [{"op": "canonicalize_categories", "mapping": {"x": "y", "z": "w", "q'
    assert ir.salvage(cut)["columns"][0]["operations"][0]["mapping"] == {"x": "y", "z": "w"}
    assert ir.salvage("no") is None and not ir.is_valid({"columns": []}) and not ir.is_valid({"table_operations": [{"op": "rm"}], "columns": []}) and not ir.is_valid([])
    with pytest.raises(ValueError):
        ir.read("[1, 2]")


def test_composed_planner_falls_back(spark):
    df = frame(spark, [(" a", "x"), ("b", "y"), ("c", "z"), ("b", "x")], "a string, b string")

    def broken(_):
        raise RuntimeError("no model")

    plan = planner.composed(broken, batch=1)(df)
    assert ir.is_valid(plan) and "heuristic after RuntimeError" in plan["_generated_by"]
    assert planner.composed()(df)["_generated_by"] == "heuristic"
    assert planner.clustered("nearest")(df)["columns"] == []


def test_names_and_files(spark, tmp_path):
    assert tables.sanitized(["a", "a.1", " a"]) == ["a", "a.1", "a.2"]
    assert tables.sanitized(["", None, "Unnamed: 3", "nan", "x"]) == ["column_1", "column_2", "column_3", "column_4", "x"]
    plain = tmp_path / "a.csv"
    plain.write_text('x,x, y \n1,"two\nlines", z \n"q ""w""",,007\n', encoding="utf-8")
    df = tables.read_table(spark, str(plain))
    assert df.columns == ["x", "x.1", "y", "_rid"]
    assert [tuple(r)[:3] for r in df.orderBy("_rid").collect()] == [("1", "two\nlines", " z "), ('q "w"', "", "007")]
    latin = tmp_path / "b.csv"
    latin.write_bytes("n;v\nJosé;1\n".encode("latin-1"))
    assert tables.read_csv(spark, str(latin), sep=";").first()["n"] == "José"
    late = tmp_path / "late.csv"  # what isn't UTF-8 comes after two million bytes, and the file is split
    late.write_bytes(b"n;v\n" + b"plain;1\n" * 300_000 + "José;2\n".encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    got = tables.read_csv(spark, str(late), sep=";")
    assert got.where("v = 2").first()["n"] == "José" and got.rdd.getNumPartitions() > 3 and got.count() == 300_001
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    both = tmp_path / "both"
    both.mkdir()
    (both / "p.csv").write_bytes("n;v\nJosé;1\n".encode("latin-1"))
    (both / "q.csv").write_text("n;v\nZoë;2\n", encoding="utf-8")
    assert {r["n"] for r in tables.read_csv(spark, str(both), sep=";").collect()} == {"José", "Zoë"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/t.csv", 'x,x, y \n1,"two\nlines",z\n\n2,"q ""w"""\n')
        z.writestr("u.csv", "a\nJosé\n".encode("latin-1"))
    path = str(tmp_path / "a.zip")
    assert {r["member"] for r in tables.zip_members(spark, path).collect()} == {"in/t.csv", "u.csv"}
    zipped = tables.read_zipped(spark, path, "in/t.csv").orderBy("_rid")
    assert zipped.columns == ["x", "x.1", "y", "_rid"] and [tuple(r)[:3] for r in zipped.collect()] == [("1", "two\nlines", "z"), ("2", 'q "w"', "")]
    assert tables.read_zipped(spark, path, "u.csv").first()["a"] == "José"
    with pytest.raises(ValueError):
        tables.read_zipped(spark, path, "none.csv")
    bare = tmp_path / "c.tsv"
    bare.write_text("1\t2\n3\t4\n")
    assert tables.read_csv(spark, str(bare), sep="\t", header=False, names=["p", "q"]).count() == 2
    empty = tmp_path / "d.csv"
    empty.write_text("")
    with pytest.raises(Exception, match="no columns|empty"):
        tables.read_table(spark, str(empty))
    head = tmp_path / "e.csv"
    head.write_text("a,b\n")
    assert tables.read_table(spark, str(head)).count() == 0
    lines = tmp_path / "v.jsonl"
    lines.write_text('{"canonical": "Robert", "aliases": ["Bob", "Rob"]}\n')
    index = reference.from_json_lines(spark, str(lines), "entity")
    assert {r["canonical"] for r in reference.best(spark.createDataFrame([("bob",)], "value string"), index).collect()} == {"Robert"}
    names = tmp_path / "cities.txt"
    names.write_text("Oslo\nBergen\n\n")
    assert reference.from_lines(spark, str(names), "city").types == ["city"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(" a ", "N/A"), ("b", "$1,200.50")], "x string, y string").write.parquet(str(tmp_path / "in"))
    plan = {"table_operations": [{"op": "drop_empty_rows"}], "columns": [{"name": "x", "operations": [{"op": "strip_whitespace"}]}, {"name": "y", "operations": [{"op": "parse_currency"}]}]}
    stream = spark.readStream.schema("x string, y string").parquet(str(tmp_path / "in"))
    q = replay.replay(stream, plan).writeStream.format("memory").queryName("replayed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("replayed").collect()), key=str) == [("a", None), ("b", 1200.5)]
    for op in ({"op": "resolve_by_majority", "key_column": "x", "columns": ["y"]}, {"op": "drop_exact_duplicates"}):
        with pytest.raises(replay.NeedsBatch):
            replay.replay(stream, {"table_operations": [op], "columns": []})


def test_prefixed_values_make_few_pairs(spark):
    """A hundred thousand values with a common beginning: pairs grow with the values, not their square."""
    from tidewright.operators import canon

    keys = spark.range(100_000).select(F.lit("c").alias("column"), F.format_string("customer#%09d", F.col("id") * 7919 % 999_983).alias("key"), (F.col("id") % 3 + 1).alias("n"), F.col("id").alias("first"))
    a, b = canon.near_keys(keys.select("key"), "key", True), canon.near_keys(keys.select(F.col("key").alias("other")), "other")
    assert a.join(b, "near").count() < 100 * 100_000


@pytest.mark.parametrize("size", [5, 8, 9, 15, 16, 17, 31, 32, 63, 64, 200])
def test_texts_one_edit_apart_share_a_key(spark, size):
    from tidewright.operators import canon

    text = "".join(chr(97 + (i * i + 3 * i) % 23) for i in range(size))
    edits = [text[:i] + c + text[j:] for i in range(size + 1) for c, j in (("#", i), ("#", i + 1), ("", i + 1)) if j <= size]
    a = canon.near_keys(spark.createDataFrame([(x,) for x in edits], "a string"), "a", True)
    b = canon.near_keys(spark.createDataFrame([(text,)], "b string"), "b")
    assert {r["a"] for r in a.join(b, "near").select("a").distinct().collect()} == set(edits)


def test_column_stats_sort_nothing(spark):
    plan = profile.column_stats(profile.frequencies(frame(spark, [("12,345.67", "a")], "x string, y string")))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan


def test_marks_before_shapes_change_nothing(spark):
    texts = ["a@b.c", "@", "5 %", "5٪", "%", "+1 (555) 123", "555-123", "٠٥٥١٢٣٤", "1 1 1 1", "2020-1-5", "1/2/20", "٢٠٢٠-1-5", "5 Jan 20", "Jan 05", "Jan-2005", "ſan 05", "40000", "4000", "٤٠٠٠٠", "35999", "50001", "400000", "", " ", "𝟜𝟘𝟘𝟘𝟘", None]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    s, shapes = F.col("s"), [profile.EMAIL, profile.PERCENT, profile.PHONE, profile.ISO_DATE, profile.SLASH_DATE, profile.TEXT_DATE, profile.SERIAL]
    true = lambda c: F.coalesce(c, F.lit(False))
    for r in df.select("s", F.array(*(true(profile.like(s, p)) for p in shapes)).alias("got"), F.array(*(true(s.rlike(p)) for p in shapes)).alias("want")).collect():
        assert r["got"] == r["want"], r["s"]
    assert [r[0] for r in df.where(profile.looks_like_date(s)).collect()] == [r[0] for r in df.where(s.rlike(profile.ISO_DATE) | s.rlike(profile.SLASH_DATE) | s.rlike(profile.TEXT_DATE) | (s.rlike(profile.SERIAL) & s.try_cast("int").between(36000, 50000))).collect()]
