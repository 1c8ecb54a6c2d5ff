"""Queries over tables with larger keys and more files than the driver's small ones, against their SQL."""

import duckdb
from compare import problem

from quire.plans import catalog

LINEITEM = "SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'"


def test_painted_characters_of_large_keys(spark, tmp_path):
    """Keys of characters beyond 100,000,000, which in the SQL's key reach into the order of paint."""
    duckdb.sql(f"COPY (SELECT * REPLACE (l_orderkey % 40 * 498500 + 3 AS l_orderkey) FROM ({LINEITEM}) WHERE l_orderkey < 200) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert problem(catalog.QUERIES["painted_characters"](spark, str(tmp_path)), catalog.ORACLES["painted_characters"], str(tmp_path)) == ""


def test_section_openers_of_several_files(spark, tmp_path):
    """Of lines with one number the first in the table opens, though Spark reads the larger file first."""
    at = tmp_path / "lineitem.parquet"
    at.mkdir()
    for name, rows in (("a", "file_row_number % 5 = 0"), ("b", "file_row_number % 5 > 0")):
        duckdb.sql(f"COPY (SELECT * EXCLUDE (file_row_number) FROM read_parquet('/root/testdata/sf0.001/lineitem.parquet', file_row_number = true) WHERE {rows} ORDER BY file_row_number) TO '{at}/{name}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet(['{at}/a.parquet', '{at}/b.parquet'])")
    want = sorted(con.sql(catalog.ORACLES["section_openers"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["section_openers"](spark, str(tmp_path)).collect()) == want


def test_section_openers_of_odd_keys(spark, tmp_path):
    """Lines without a number, and part keys that are missing or below 0, which are references by the SQL's last branch."""
    odd = "CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN -l_partkey ELSE l_partkey END AS l_partkey, CASE WHEN l_partkey % 5 > 0 THEN l_linenumber END AS l_linenumber, CASE WHEN l_partkey % 11 > 0 THEN l_orderkey END AS l_orderkey"
    duckdb.sql(f"COPY (SELECT * REPLACE ({odd}) FROM ({LINEITEM})) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert problem(catalog.QUERIES["section_openers"](spark, str(tmp_path)), catalog.ORACLES["section_openers"], str(tmp_path)) == ""
