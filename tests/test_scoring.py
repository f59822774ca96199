import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import scoring


def column(spark, values):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], "_rid long, c string")


def scored(spark, dirty, clean, out):
    return scoring.score(*(column(spark, x) for x in (dirty, clean, out))).first().asDict()


def test_equality(spark):
    pairs = [("1.0", "1", True), ("1000000", "1000000.5", True), ("Nan", "Nan", True), ("a", "A", False), (None, None, True), (None, "x", False), ("1_0", "10", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in df.select(scoring.cell_equal(F.col("a"), F.col("b"))).collect()] == [x for *_, x in pairs]


def test_scores(spark):
    clean = ["Won", "Won", "Lost", "x"]
    dirty = ["won", "Wonn", "Lost", "x"]
    noop, oracle = scored(spark, dirty, clean, dirty), scored(spark, dirty, clean, clean)
    assert noop["f1"] == 0 and noop["precision"] == 1 and noop["abstained"] == 2 and oracle["f1"] == 1 and oracle["damage"] == 0
    churn = scored(spark, dirty, clean, ["WON", "Wonn", "LOST", "X"])
    assert churn["changed"] == 0 and churn["fixed"] == 0 and churn["damaged"] == 0
    vandal = scored(spark, dirty, clean, ["won", "Wonn", "bad", "x"])
    assert vandal["damage"] == 0.5 and vandal["precision"] == 0
    semantic = scored(spark, dirty, clean, ["won", "WON", "Lost", "x"])
    assert semantic["fixed"] == 1 and semantic["precision"] == 1


def test_missing_columns_and_short_tables(spark):
    two = spark.createDataFrame([(0, "a", "b"), (1, "c", "d")], "_rid long, p string, q string")
    got = scoring.score(two, two, two.drop("q")).first()
    assert (got["errors"], got["changed"], got["clean_cells"]) == (0, 0, 4)
    assert scoring.recovery(two, two.drop("q")).first()["recovery"] == 0.5
    assert scoring.recovery(two, two.limit(1)).first()["recovery"] == 0.5


def test_error_classes(spark):
    pairs = {"missing": ("", "x"), "whitespace": (" a b", "ab "), "case": ("AB", "ab"), "encoding": ("cafÃ©", "café"), "numeric": ("$5", "7"), "date-format": ("1/5/2023", "2023-01-05"), "token-swap": ("b a", "a b"), "typo": ("manchestxr", "manchester"), "other": ("alpha", "omega")}
    df = spark.createDataFrame(list(pairs.values()), "d string, g string")
    assert [r[0] for r in df.select(scoring.error_class(F.col("d"), F.col("g"))).collect()] == list(pairs)


def test_curves(spark):
    rows = [(i, c, o) for i, (c, o) in enumerate([(1.0, True), (0.95, True), (0.5, False), (0.5, True), (0.2, False), (0.0, False)])]
    df = spark.createDataFrame(rows, "id int, conf double, ok boolean")
    got = [(r["k"], r["coverage"], r["risk"]) for r in scoring.risk_coverage(df).orderBy("k").collect()]
    cum, want = 0, []
    for k, (_, _, ok) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        cum += ok
        want.append((k, k / 6, 1 - cum / k))
    assert [x for r in got for x in r] == pytest.approx([x for r in want for x in r])
    assert scoring.aurc(scoring.risk_coverage(df)).first()[0] == pytest.approx(sum(r for *_, r in want) / 6)
    ece = (2 * abs(0.975 - 1) + 2 * abs(0.5 - 0.5) + abs(0.2) + 0) / 6
    assert scoring.ece(df).first()[0] == pytest.approx(ece)
    assert tuple(scoring.operating_point(df, 0.9).first()) == pytest.approx((1 / 3, 1.0))


def test_divergence_and_ranks(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "k string, n long")
    b = spark.createDataFrame([("z", 3)], "k string, n long")
    assert scoring.jensen_shannon(a, b, "k").first()[0] == pytest.approx(1.0) and scoring.jensen_shannon(a, a, "k").first()[0] == 0
    s = spark.createDataFrame([(1, 1, 1), (2, 2, 3), (3, 3, 2), (4, 4, 4)], "i int, x int, y int")
    assert scoring.kendall_tau(s, "i", "x", "y").first()[0] == pytest.approx(4 / 6)
    got = scoring.set_scores(a.select("k"), spark.createDataFrame([("y",), ("q",)], "k string")).first()
    assert (got["tp"], got["fp"], got["fn"], got["f1"]) == (1, 1, 1, 0.5)


@pytest.mark.parametrize("kind", ["typo", "ocr", "case", "whitespace"])
def test_injection(spark, kind):
    clean = column(spark, [["Manchester B8", "Oslo town", "Lima one"][i % 3] for i in range(300)])
    a, b = (scoring.inject(clean.repartition(n), kind, 7, 0.2) for n in (1, 6))
    assert sorted(a.collect()) == sorted(b.collect())
    changed = scoring.edits(clean, a).collect()
    assert 20 < len(changed) < 100
    for r in changed:
        x, y = r["before"], r["after"]
        if kind == "case":
            assert x.lower() == y.lower()
        elif kind == "whitespace":
            assert "".join(x.split()) == "".join(y.split())
        else:
            assert abs(len(x) - len(y)) <= 1


def test_policies(spark):
    clean = column(spark, [["red", "blue"][i % 2] for i in range(200)])
    dirty = scoring.inject(clean, "typo", 3, 0.2, ["c"])
    out = scoring.random_edits(dirty, 0.1, 5)
    assert out.count() == 200 and 0 < scoring.edits(dirty, out).count() < 40
    rows = spark.createDataFrame([("a", 10, 4, 1)], "policy string, errors int, fixed int, damaged int")
    assert [(r["c"], r["raw"], r["per_error"]) for r in scoring.cost_scores(rows, [1, 5]).collect()] == [(1.0, 3.0, 0.3), (5.0, -1.0, -0.1)]


def test_pairs_and_vocabularies(spark):
    clean = column(spark, ["Manchester"] * 3 + ["9:55", "Oslo"])
    dirty = column(spark, ["Manchester", "Manchestxr", "manchester", "9:45", "Oslo"])
    got = {(r["raw"], r["canonical"]) for r in scoring.derived_entries(dirty, clean).collect()}
    assert ("Manchestxr", "Manchester") in got and ("manchester", "Manchester") in got and ("Oslo", "Oslo") not in got
    rows = spark.createDataFrame([(1, "Bob Dylan"), (1, "Bob Dylan"), (1, "Bob Dylon"), (1, "Zimmerman"), (2, "X")], "q int, s string")
    assert {r["q"]: (r["canonical"], r["aliases"]) for r in scoring.modal_surfaces(rows, "q", "s").collect()} == {1: ("Bob Dylan", ["Bob Dylon"]), 2: ("X", [])}
    assert math.isclose(scoring.double_macro(spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("b", 2, 5.0)], "d string, k int, v double"), "d", "k", "v").first()[0], 3.5)


def test_equivalence_of_few_scores():
    # quantiles of Student's distribution, from tables
    for t, freedom, tail in ((2.228, 10, 0.025), (1.812, 10, 0.05), (1.0, 1, 0.25), (-2.132, 4, 0.95), (6.965, 2, 0.01)):
        assert scoring._upper_tail(t, freedom) == pytest.approx(tail, abs=1e-4)
    near = scoring.equivalence([0.01, -0.02, 0.0, 0.015, -0.005], 0.05)
    assert near["p"] < 0.01 and near["within"] and near["low"] < 0 < near["high"]
    far = scoring.equivalence([0.1, 0.12, 0.09], 0.05)
    assert far["p"] > 0.9 and not far["within"] and scoring.equivalence([0.1], 0.05)["p"] is None
