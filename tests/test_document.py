"""One JSON document in many parts."""

import json

from pyspark.sql import functions as F

from loudframe.sources import sinks as SK


def written(spark, folder):
    return json.loads("".join((folder / n).read_text() for n in SK.document_parts(spark, str(folder))))


def test_fifty_thousand_rows_are_one_ordered_document(spark, tmp_path):
    rows = spark.range(50_000).select(F.format_string("%05d \"é\n", F.col("id")).alias("file"), F.when(F.col("id") % 3 == 0, "x").alias("error"),
                                      F.when(F.col("id") % 7 == 0, float("inf")).otherwise(1.5).alias("headroom_db")).repartition(7)
    summary = spark.createDataFrame([(50_000,)], "total_files long")
    albums = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "album string, gain double")
    listed = SK.write_json_document(rows, summary, str(tmp_path / "d"), album=albums, rows_per_part=4000).collect()
    got = written(spark, tmp_path / "d")
    assert [r["file"] for r in got["files"]] == ['%05d "é\n' % i for i in range(50_000)]
    assert got["files"][0] == {"file": '00000 "é\n', "error": "x"} and got["files"][1] == {"file": '00001 "é\n', "headroom_db": 1.5}
    assert got["albums"] == [{"album": "a", "gain": 1.0}, {"album": "b", "gain": 2.0}] and got["summary"] == {"total_files": 50_000}
    assert len(listed) > 8 and sum(r.rows for r in listed) == 50_000 and max(r.rows for r in listed) < 8000


def test_no_rows_and_no_albums(spark, tmp_path):
    rows = spark.createDataFrame([], "file string, status string")
    SK.write_json_document(rows, spark.createDataFrame([(0,)], "total_files long"), str(tmp_path / "d"))
    assert written(spark, tmp_path / "d") == {"files": [], "summary": {"total_files": 0}}
    SK.write_json_document(rows, spark.createDataFrame([(0,)], "total_files long"), str(tmp_path / "e"), album=spark.createDataFrame([], "album string"))
    assert written(spark, tmp_path / "e") == {"files": [], "albums": [], "summary": {"total_files": 0}}
