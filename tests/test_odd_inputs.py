"""Queries against their SQL on tables that the test data doesn't hold."""

import duckdb
import pytest
from test_entry import entry, plain  # noqa: F401


def same_as_sql(spark, entry, sf, query):  # noqa: F811
    """The query's rows, which have to be those of its SQL over the parquet files in sf."""
    db = duckdb.connect()
    for f in sf.glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = entry.queries()[query](spark, str(sf))
    names = sorted(got.columns)
    rows = plain(tuple(r[c] for c in names) for r in got.collect())
    assert rows == plain(db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({entry.oracle_sql()[query]})").fetchall())
    return rows


#: Numbers of over 19 digits whose first 19 pass a card's checksum, SSNs that go on, and long numbers.
NUMBERS = ["call 555-1019 4111111111131105 now", "12345678901234567857 5", "5 123-45-6789", "123-45-6789 7 and 078-05-1120", "pay 4111 1111 1111 1111.", "1" * 30000, "1 2-" * 9999, None]


@pytest.mark.parametrize("query", ["embedded_alerts", "embedded_cards", "embedded_pii_alerts"])
def test_numbers_in_texts(spark, entry, tmp_path, query):  # noqa: F811
    texts = " UNION ALL ".join(f"SELECT {i} AS doc_id, {'NULL' if x is None else repr(x)} AS text, 'en' AS lang, 'web' AS source" for i, x in enumerate(NUMBERS))
    duckdb.sql(f"COPY ({texts}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    assert same_as_sql(spark, entry, tmp_path, query)


def test_orders_with_equal_cells_stay(spark, entry, tmp_path):  # noqa: F811
    orders = "SELECT (o_orderkey + k * 150000)::BIGINT AS o_orderkey, o.* EXCLUDE (o_orderkey) FROM '/root/testdata/sf0.001/orders.parquet' o, range(3) r(k)"
    duckdb.sql(f"COPY ({orders}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    assert len(same_as_sql(spark, entry, tmp_path, "cleaned_table")) == 4500
