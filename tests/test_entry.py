"""The entry module works with and without the corpus subpackage."""

import os

import pytest

import __spark_entry__ as entry

TINY = "/root/testdata/sf0.001"


def test_queries_need_no_session_and_match_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(TINY), reason="needs the test tables")
@pytest.mark.parametrize("name", ["to_csv", "cells", "x_clusters", "detect_columns", "classify_spans", "elements_to_markdown", "page_text_lines", "decode_bytes", "ascii_hex_decode"])
def test_query_equals_sql(spark, name):
    import duckdb

    for t in ("lineitem", "orders", "customer", "part", "documents"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    got = entry.queries()[name](spark, TINY).toPandas()
    want = duckdb.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)
