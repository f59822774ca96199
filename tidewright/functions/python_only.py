"""The few cell functions that the JVM has no equal for, as Arrow UDFs.

They are meant for distinct values, joined back on, never for every row of a table.
"""

from __future__ import annotations

import string
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..session import ship

# fixed values: what UTF-8 read as another encoding leaves behind
WRONG_DECODING = ("\u00c3", "\u00c2", "\u00e2\u20ac", "\u00e2\x80", "\u00ef\u00bb\u00bf", "\u00d0", "\u00d1\x82", "\ufffd")


def ratio(a: str | None, b: str | None) -> float | None:
    """Matching-blocks similarity; the order of arguments matters."""
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


def wrong_marks(s: str) -> int:
    return sum(s.count(m) for m in WRONG_DECODING)


def repaired(s: str | None) -> str | None:
    """The text as it was before UTF-8 was read as cp1252 or latin-1, where that can be undone
    without loss and leaves fewer marks."""
    if not s or not (marks := wrong_marks(s)):
        return s
    for codec in ("cp1252", "latin-1"):
        try:
            out = s.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
        if "\ufffd" not in out and wrong_marks(out) < marks:
            return out
    return s


_dropped = str.maketrans("", "", string.punctuation)


def fingerprint(s: str | None) -> str | None:
    """Sorted distinct words in plain letters without punctuation."""
    if s is None:
        return None
    plain = unicodedata.normalize("NFKD", s.strip().lower()).encode("ascii", "ignore").decode()
    return " ".join(sorted(set(plain.translate(_dropped).split())))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _repaired(s: pd.Series) -> pd.Series:
    return s.map(repaired, na_action="ignore")


def _title(s: pd.Series) -> pd.Series:
    return s.map(str.title, na_action="ignore")


def _fingerprint(s: pd.Series) -> pd.Series:
    return s.map(fingerprint, na_action="ignore")


def _made(f, kind):
    def column(*cells):
        ship(SparkSession.active())
        return F.pandas_udf(f, kind)(*cells)

    return column


ratio_udf, repaired_udf = _made(_ratios, DoubleType()), _made(_repaired, StringType())
title_udf, fingerprint_udf = _made(_title, StringType()), _made(_fingerprint, StringType())
