"""Queries on files that are written from rows, against their SQL on odd rows."""

import duckdb
import pytest

from loudframe.contracts import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["listed_files", "streamed_files"])
def test_files_of_odd_documents(spark, tmp_path, name):
    odd = [(0, "", "en"), (1, None, "en"), (3, "é" * 9, None), (5, None, None), (6, "", None), (10, "a", ""), (11, "ab", "a/b"), (13, "abc", ".."),
           (15, "x", ".x"), (16, "x", "_x"), (18, "x", "a b%2F+é?#"), (-5, "x", "en"), (-4, "x", "en"), (-1, "x", "en"), (None, "x", "en"),
           (20, "one", "de"), (20, "two!", "de"), (20, "one", "de"), (9 * 10**15 + 1, "x", "fr"), (2, "x", "en"), (4, "x", "en")]
    rows = odd + [(i, "w" * (i % 7), ("en", "de", "fr")[i % 3]) for i in range(100, 1600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLES[name]).fetchall()
    got = [(r.path, r.length) for r in QUERIES[name](spark, str(tmp_path)).select("path", "length").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
