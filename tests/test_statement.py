"""Statements of a customer with more orders than a page holds."""

from collections import Counter

import pytest

from pagesift.plans import catalogue

NAMES = ["cluster_lines", "classify_line", "classify_spans", "elements_to_txt", "elements_to_markdown", "keyword_rows", "row_slice"]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("hot")
    customers = [(1, "Customer#1", "BUILDING", 5.0), (2, "Customer#2", "MACHINERY", 7.0)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double").write.parquet(f"{path}/customer.parquet")
    orders = [(1000 + i, 1, "O", 10.0 + i, "1-URGENT") for i in range(60)] + [(5000, 2, "F", 3.0, "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_orders_past_a_page_are_on_further_pages(spark, hot, name):
    got = catalogue.queries()[name](spark, hot).where("doc_id = '1'").collect()
    assert {r["page_no"] for r in got} == {0, 1, 2}
    text = " ".join(str(r) for r in got)
    if name not in ("row_slice", "classify_spans"):  # some rows of a page; elements without a table's text
        assert all(str(1000 + i) in text for i in range(60))


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees_on_further_pages(spark, hot, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hot}/{t}.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = catalogue.queries()[name](spark, hot).select(*names).collect()
    assert Counter(map(tuple, rows)) == Counter(want.fetchall())
