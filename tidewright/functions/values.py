"""Cell functions as Column expressions: nulls, text, numbers, dates, booleans, phones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens that mean "missing", boolean words, country names
NULLS = ("", "n/a", "na", "n.a.", "-", "--", "—", "null", "none", "nan", "#n/a", "tbd", "?", "unknown", "missing", "empty", "(empty)")
TRUE_WORDS = ("yes", "y", "true", "t", "1", "✓")
FALSE_WORDS = ("no", "n", "false", "f", "0")
COUNTRIES = {
    "usa": "United States",
    "u.s.a.": "United States",
    "u.s.a": "United States",
    "us": "United States",
    "u.s.": "United States",
    "united states": "United States",
    "united states of america": "United States",
    "america": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "u.k": "United Kingdom",
    "united kingdom": "United Kingdom",
    "great britain": "United Kingdom",
    "canada": "Canada",
    "germany": "Germany",
}
# fixed values: typographic characters and their plain forms, those that go, and marks of wrong decoding
PLAIN = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u2032": "'", "\u00b4": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2033": '"',
    "\u2013": "-", "\u2014": "-", "\u2012": "-", "\u2015": "-", "\u2212": "-",
    "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
GONE = "\u200b\u200c\u200d\ufeff"
ELLIPSIS = "\u2026"
MOJIBAKE = ("\u00c3", "\u00e2\u20ac", "\ufffd", "\u00ef\u00bb\u00bf")
SPACE = r"[\s\x1c-\x1f]"
#: The same, written out.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMM-yyyy", "MMMM yyyy", "MMM yyyy", "yyyy-M-d H:m:s", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd", "yyyy-M")


def text(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.btrim(c, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token(c: Column) -> Column:
    return F.lower(strip(text(c)))


def is_missing(c: Column) -> Column:
    """Null, NaN, blank, or a word that means missing."""
    return c.isNull() | F.coalesce(token(c).isin(*NULLS), F.lit(False))


def unless_missing(c: Column, out: Column) -> Column:
    """`out` for cells that hold something; others as they were."""
    return F.when(is_missing(c), c).otherwise(out)


def or_null(c: Column, out: Column) -> Column:
    """`out` for cells that hold something; null for others."""
    return F.when(~is_missing(c), out)


def strip_whitespace(c: Column) -> Column:
    return unless_missing(c, strip(F.regexp_replace(c, rf"(?U){SPACE}+", " ")))


def normalize_punctuation(c: Column) -> Column:
    plain = F.translate(c, "".join(PLAIN) + GONE, "".join(PLAIN.values()))
    return unless_missing(c, F.regexp_replace(F.replace(plain, F.lit(ELLIPSIS), F.lit("...")), " {2,}", " "))


def normalize_disguised_nulls(c: Column) -> Column:
    return or_null(c, c)


def to_double(s: Column) -> Column:
    """What a plain decimal or exponent form says; null for all else, words and suffixes included."""
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_currency(c: Column) -> Column:
    """Number of a money text: brackets are negative, of two separators the later is the decimal
    one, and a lone comma is decimal only before two last digits."""

    def number(raw: Column) -> Column:
        return let(strip(F.translate(F.btrim(raw, F.lit("()")), "$£€", "")), lambda s: let(_plain(s), to_double))

    return or_null(c, let(strip(c), lambda raw: F.when(raw.startswith("(") & raw.endswith(")"), -number(raw)).otherwise(number(raw))))


def _plain(s: Column) -> Column:
    """A number's text with a dot as its only separator."""
    last = lambda x: F.locate(x, F.reverse(s))  # noqa: E731  1 is the last character
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    european = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    grouped = F.replace(s, F.lit(","), F.lit(""))
    return strip(
        F.when(comma & dot, F.when(last(",") < last("."), european).otherwise(grouped))
        .when(comma, F.when(s.rlike(r"^\d{1,3},\d{2}$"), F.replace(s, F.lit(","), F.lit("."))).otherwise(grouped))
        .otherwise(s)
    )


def parse_percent(c: Column) -> Column:
    """Fraction of a text that ends in %, as a double; null for bare values."""
    s = strip(c)
    body = F.replace(strip(F.regexp_replace(s, "%+$", "")), F.lit(","), F.lit("."))
    return or_null(c, F.when(s.endswith("%"), to_double(body) / 100.0))


def python_double(d: Column) -> Column:
    """A double as Python writes it: no exponent from 1e-4 up to 1e16."""
    s = text(d)
    plain = F.when((F.abs(d) >= 1e7) & (F.abs(d) < 1e16), F.concat(F.regexp_replace(F.format_string("%.10f", d), "0+$", ""), F.lit("")))
    small = F.when((F.abs(d) < 1e-3) & (F.abs(d) >= 1e-4), F.regexp_replace(F.format_string("%.17f", d), "0+$", ""))
    out = F.coalesce(plain, small, s)
    return F.when(out.endswith("."), F.concat(out, F.lit("0"))).otherwise(out)


def parse_percent_mixed(c: Column) -> Column:
    """As parse_percent, as text in which bare values stay as they are."""
    return or_null(c, F.when(strip(c).endswith("%"), python_double(parse_percent(c))).otherwise(c))


def date_fields(s: Column) -> Column:
    """The three numbers of a stripped date with slashes or dashes that has the year last."""
    return F.when(s.rlike(r"^\d{1,2}[/\-]\d{1,2}[/\-](?:\d{2}|\d{4})$"), F.transform(F.split(F.translate(s, "-", "/"), "/"), lambda x: x.try_cast("int")))


def parse_date(c: Column) -> Column:
    """ISO date text: four or five digits are a spreadsheet's day number; a first field over 12 is a
    day, else a month, with the other order if that gives no date; then the formats above."""
    return or_null(c, let(strip(c), lambda s: let(date_fields(s), lambda f: _iso(s, f))))


def _iso(s: Column, f: Column) -> Column:
    a, b, y = F.get(f, 0), F.get(f, 1), F.get(f, 2)
    year = F.when(y < 69, y + 2000).when(y < 100, y + 1900).otherwise(y)
    made = lambda m, d: F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(text(year), 4, "0"), text(m), text(d)), F.lit("yyyy-M-d")))
    swap = a > 12
    slashed = F.when(f.isNotNull(), F.coalesce(made(F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)), made(F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a))))
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.when(s.rlike(r"^\d{4,5}$"), s.try_cast("int")))
    named = [F.to_date(F.try_to_timestamp(s, F.lit(k))) for k in DATE_FORMATS]
    words = F.when(s.rlike(r"\d{4}"), F.coalesce(*named))
    return F.date_format(F.coalesce(serial, slashed, words), "yyyy-MM-dd")


def standardize_boolean(c: Column) -> Column:
    t = token(c)
    return or_null(c, F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def standardize_phone(c: Column) -> Column:
    d = digits(c)
    cut = lambda a, n: F.substring(d, a, n)
    ten = F.concat(F.lit("("), cut(1, 3), F.lit(") "), cut(4, 3), F.lit("-"), cut(7, 4))
    seven = F.concat(cut(1, 3), F.lit("-"), cut(4, 4))
    out = F.when(strip(c).startswith("+"), F.concat(F.lit("+"), d)).when(F.length(d) == 10, ten).when(F.length(d) == 7, seven).otherwise(d)
    return or_null(c, out)


def normalize_email(c: Column) -> Column:
    return or_null(c, token(c))


def standardize_case(c: Column, case: str | None = "title") -> Column:
    """upper, lower, sentence, or title, where each letter after a non-letter is a capital."""
    s = strip(c)
    if case == "upper":
        out = F.upper(s)
    elif case == "lower":
        out = F.lower(s)
    elif case == "sentence":
        out = F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))
    else:
        words = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|\P{L}+)"))
        out = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
    return unless_missing(c, out)


def canonicalize(c: Column, mapping: dict[str, str]) -> Column:
    """Small mappings, as a literal map looked up by the stripped cell."""
    if not mapping:
        return c
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return unless_missing(c, F.coalesce(F.try_element_at(pairs, strip(c)), c))


def surface(c: Column) -> Column:
    """Letters and digits only, in lower case: the form in which surfaces are compared."""
    return F.lower(F.regexp_replace(text(c), r"[^\p{L}\p{N}]", ""))


def date_shape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\d+", "D"), "[A-Za-z]+", "A")


def phone_shape(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\d", "D")


def country_of(t: Column) -> Column:
    """The country that a stripped text in lower case names, or the text."""
    pairs = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, t), t)


def country_key(c: Column) -> Column:
    return country_of(token(c))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
