import datetime
import difflib

import pytest
from pyspark.sql import functions as F

from tidewright.functions import pii
from tidewright.functions import values as v
from tidewright.functions.python_only import fingerprint, ratio, repaired, repaired_udf, title_udf


def cells(spark, f, given):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_missing(spark):
    given = [None, "", "  ", "N/A", " n.a. ", "-", "—", "NaN", "#N/A", "TBD", "?", "(Empty)", " ", "0", "no", "nap"]
    assert cells(spark, v.is_missing, given) == [True] * 13 + [False] * 3


def test_whitespace_and_punctuation(spark):
    assert cells(spark, v.strip_whitespace, ["  a \t b  c ", " N/A ", None, "x"]) == ["a b c", " N/A ", None, "x"]
    given = ["“Hi” – it’s…", "a​b", "x  y", "plain"]
    assert cells(spark, v.normalize_punctuation, given) == ["\"Hi\" - it's...", "ab", "x y", "plain"]


def test_currency(spark):
    given = ["$1,200.50", "1.200,50", "(500)", "950", "1,20", "1,200", "1.200", "-", "1,200 USD", "$99k", "€ 3", "-7", "5d", "1e3", "nan", "(1,2.5)"]
    assert cells(spark, v.parse_currency, given) == [1200.5, 1200.5, -500.0, 950.0, 1.2, 1200.0, 1.2, None, None, None, 3.0, -7.0, None, 1000.0, None, -12.5]


def test_percent(spark):
    assert cells(spark, v.parse_percent, ["12.5%", "7 %", "1,5%", "0.6", "x%", "1,200%"]) == pytest.approx([0.125, 0.07, 0.015, None, None, 0.012])
    assert cells(spark, v.parse_percent_mixed, ["12.5%", "0.6", "x%", "N/A"]) == ["0.125", "0.6", None, None]


def test_dates(spark):
    given = ["2023-01-05", "01/06/2023", "14/02/2023", "5 Jan 2023", "44931", "2 March 2023", "1/2/23", "3-4-1999", "nonsense", "7:58 p.m.", "31/31/2023", "Jan 5, 2023", "N/A", "2/30/2023"]
    want = ["2023-01-05", "2023-01-06", "2023-02-14", "2023-01-05", "2023-01-05", "2023-03-02", "2023-01-02", "1999-03-04", None, None, None, "2023-01-05", None, None]
    assert cells(spark, v.parse_date, given) == want
    day = datetime.date(1899, 12, 30) + datetime.timedelta(days=44931)
    assert want[4] == day.isoformat()


def test_booleans_phones_emails(spark):
    assert cells(spark, v.standardize_boolean, ["Yes", " y", "TRUE", "1", "No", "F", "0", "maybe", None]) == [True] * 4 + [False] * 3 + [None] * 2
    given = ["(555) 123-4567", "555.234.5678", "+1 555 345 6789", "555-1234", "12", "N/A"]
    assert cells(spark, v.standardize_phone, given) == ["(555) 123-4567", "(555) 234-5678", "+15553456789", "555-1234", "12", None]
    assert cells(spark, v.normalize_email, [" ALICE@EXAMPLE.COM ", "-"]) == ["alice@example.com", None]


def test_case(spark):
    given = ["hello WORLD's o'neil-x", " two  words", "N/A", "éa ßb"]
    assert cells(spark, lambda c: v.standardize_case(c, "title"), given)[:3] == [given[0].title(), given[1].strip().title(), "N/A"]
    assert cells(spark, title_udf, given[:2]) == [x.title() for x in given[:2]]
    assert cells(spark, lambda c: v.standardize_case(c, "sentence"), ["hELLO World"]) == ["Hello world"]


def test_mapping(spark):
    got = cells(spark, lambda c: v.canonicalize(c, {"usa": "United States"}), [" usa ", "usa", " uk ", None, "N/A"])
    assert got == ["United States", "United States", " uk ", None, "N/A"]


def test_doubles_as_python_writes_them(spark):
    xs = [1e7, 0.1, 123456789.25, 950.0, 1e-3, 0.00025, -2e9, 1e16, 0.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
    got = [r[0] for r in df.select(v.python_double(F.col("x"))).collect()]
    assert [float(x) for x in got] == xs and got[:5] == [repr(x) for x in xs[:5]]


def test_wrong_decoding(spark):
    wrong = "é naïve – ‘x’".encode().decode("cp1252")
    assert cells(spark, repaired_udf, [wrong, "clean é", "Ã broken", None]) == ["é naïve – ‘x’", "clean é", "Ã broken", None]
    assert repaired("") == "" and fingerprint("  Émile, Zola! zola ") == "emile zola"
    assert ratio("manchestxr", "manchester") == difflib.SequenceMatcher(None, "manchestxr", "manchester").ratio()


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_validators(spark):
    given = ["4111 1111 1111 1111", "4111111111111112", "DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "123-45-6789", "a@b.co", "a@b.c", "10.0.0.255", "256.1.1.123", "00:1A:2b:3c:4D:5e", "+1 (555) 123-4567", "x"]
    want = [["credit_card"], [], ["iban"], [], ["ssn"], ["email"], [], ["ip_address", "phone"], ["phone"], ["mac_address"], ["phone"], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").orderBy("i")
    rows = df.select(*(c.alias(k) for k, c in pii.validators(F.col("x")).items())).collect()
    got = [[k for k in pii.TYPES if r[k]] for r in rows]
    for x, a, b in zip(given, got, want, strict=True):
        assert [k for k in a if k != "phone" or "phone" in b] == b, (x, a)


def test_masks(spark):
    given = ["alice@example.com", "4111 1111 1111 1234", "123-45-6789", "Bob", "@x", "x@", "+1 555 123 4567 ext", "N/A", "B"]
    assert cells(spark, lambda c: pii.mask(c), given) == ["a***@example.com", "**** **** **** 1234", "***-**-6789", "B**", "***@x", "***", "+* *** *** 4567 ***", "N/A", "B**"]
    assert cells(spark, lambda c: pii.hashed(c, "s"), [" a ", "a", "N/A"])[:2] == cells(spark, lambda c: pii.hashed(c, "s"), ["a", "a"])
    assert cells(spark, lambda c: pii.pseudonym(c, "s", "email"), ["a"])[0].startswith("EMAIL_")


def test_embedded(spark):
    text = "card 4111-1111-1111-1111, not 4111-1111-1111-1112; ssn 123-45-6789 but not 1123-45-6789"
    got = cells(spark, pii.embedded, [text, "N/A", "nothing"])
    assert [(x["pii_type"], x["span"].strip()) for x in got[0]] == [("credit_card", "4111-1111-1111-1111"), ("ssn", "123-45-6789")]
    assert got[1] is None and got[2] == []
