import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, piece string, first int, unit string, label int, `odd name` string, __score string, __hits int, __removed string, __doc int, __lang_pred int, __parts int, __found int, __lang int, __size int, n int, h int, rank int, salt int"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = "the wide sea holds many quiet ships and old songs. " * 3000
    rows = [
        (1, "One small text about ships and songs.", "en"),
        (1, "One small text about ships and songs.", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, "   \n\t ", "de"),
        (5, long, "en"),
        (6, long + "Ende.", "en"),
        (None, "no id here, only words", "fr"),
        (7, "12345 ½ ² !!! ???", "fr"),
        (8, "x" * 50_000, None),
        (9, "日本語のテキスト 😀 é", "ja"),
        (10, "a▁b  c\u0000d", None),
    ]
    return spark.createDataFrame([(i, t, g, None, None if t is None else len(t), 1, "f", "p", 1, "u", None, "o", "s", 1, "r", 1, 1, 1, 1, 1, 1, 1, 1, 1, 1) for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
