import os
import time

from pyspark.sql import functions as F

from loudframe.functions import paths as P
from loudframe.sources import catalog as CA


def tree(root):
    for name in ("b.MP3", "a.m4a", "x.txt", "sub/c.aac", "sub/deep/d.mp4", "noext"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_catalog_of_a_directory(spark, tmp_path):
    tree(tmp_path)
    found = CA.audio_catalog(spark, str(tmp_path))
    assert names(found) == ["a.m4a", "b.MP3", "c.aac", "d.mp4"]
    assert names(CA.audio_catalog(spark, str(tmp_path), recursive=False)) == ["a.m4a", "b.MP3"]
    assert names(CA.catalog_filter(found)) == ["a.m4a", "b.MP3", "c.aac"]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan
    assert [os.path.basename(r.path) for r in CA.sort_catalog(found).collect()] == ["a.m4a", "b.MP3", "c.aac", "d.mp4"]
    large = CA.oversize_files(found, max_length=4)
    assert large.count() == 4 and large.first().error == "File too large: 5 bytes"
    assert CA.read_files(spark, str(tmp_path), max_length=4).count() == 0


def test_path_functions(spark):
    cases = {"/x/a.mp3": ("a.mp3", True), "/x/._a.mp3": ("._a.mp3", False), "/x/": ("x", False), "/": ("unknown", False),
             "a/..": ("unknown", False), "a/.": ("a", False), "a.b/c..mp3": ("c..mp3", True), "": ("unknown", False), "/x/.mp3": (".mp3", False),
             "/x/a.mp4": ("a.mp4", False), "/x.mp3/a": ("a", False)}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = df.select("p", P.file_name(F.col("p")).alias("n"), P.is_desktop_audio(F.col("p")).alias("k")).collect()
    assert {r.p: (r.n, r.k) for r in got} == cases


def test_new_files(spark):
    found = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "path string")
    known = spark.createDataFrame([("a",)], "path string")
    assert sorted(r.path for r in CA.new_files_only(found, known).collect()) == ["b", "c"]
    summary = CA.new_files_summary(found, known).first()
    assert (summary.added, summary.skipped) == (2, 2)


def test_incremental_catalog_sees_each_file_once(spark, tmp_path):
    source, log, mark = (tmp_path / n for n in ("in", "log", "mark"))
    tree(source)

    def run():
        stream = CA.incremental_catalog(spark, str(source)).select("path", "length", "modificationTime")
        CA.append_new_files(stream, str(log), str(mark)).awaitTermination()
        return names(spark.read.json(str(log)))

    assert run() == ["a.m4a", "b.MP3", "c.aac", "d.mp4"]
    time.sleep(1.1)
    (source / "later.mp3").write_bytes(b"1")
    assert run() == ["a.m4a", "b.MP3", "c.aac", "d.mp4", "later.mp3"]
    assert run() == ["a.m4a", "b.MP3", "c.aac", "d.mp4", "later.mp3"]


def test_many_files_take_few_tasks(spark, tmp_path):
    for i in range(700):
        (tmp_path / "in" / f"d{i % 40}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{i % 40}" / f"{i}.mp3").write_bytes(b"1" * (i % 3 + 1))
    most = CA.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    listed = CA.audio_catalog(spark, str(tmp_path / "in"))
    assert listed.rdd.getNumPartitions() <= most and listed.count() == 700
    stream = CA.incremental_catalog(spark, str(tmp_path / "in")).select("path", "length")
    CA.append_new_files(stream, str(tmp_path / "log"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 700
    assert len(list((tmp_path / "log").glob("part-*"))) <= most


def test_a_stream_keeps_no_file_names_on_the_driver(spark, tmp_path):
    source, log, mark = (tmp_path / n for n in ("in", "log", "mark"))
    tree(source)
    (source / "sub" / "empty.mp3").write_bytes(b"")
    stream = CA.incremental_catalog(spark, str(source)).select("path", "length")
    CA.append_new_files(stream, str(log), str(mark)).awaitTermination()
    assert sorted((os.path.basename(r.path), r.length) for r in spark.read.json(str(log)).collect()) == [
        ("a.m4a", 5), ("b.MP3", 5), ("c.aac", 5), ("d.mp4", 5), ("empty.mp3", 0)]
    told = [p.read_text(errors="replace") for part in ("sources", "offsets", "commits") for p in (mark / part).rglob("*") if p.is_file()]
    assert told and not any("c.aac" in t for t in told)


def test_a_catalog_is_listed_by_tasks(spark, tmp_path):
    # Deep folders, names that a URI would need to escape, names that are passed over; times and paths as Spark has them.
    for name in ("a.mp3", "1/2/3/4/5/6/deep.mp3", "x y%20z/é#?.m4a", "1/_no/b.mp3", "1/.no/b.mp3", "1/_k=v/yes.mp3", "1/2/_no.mp3", "1/2/no.txt"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    spark_has = CA.catalog_filter(CA.read_files(spark, str(tmp_path / "in")), extensions=("mp3", "m4a"), skip_forks=False)
    want = sorted(tuple(r) for r in spark_has.select("path", "length", "modificationTime").collect())
    (tmp_path / "in/1/2/empty.mp3").write_bytes(b"")
    found = CA.audio_catalog(spark, str(tmp_path / "in"))
    got = sorted(tuple(r) for r in found.collect())
    empty = [r for r in got if r[1] == 0]
    assert len(want) == 4 and [r for r in got if r[1]] == want and [os.path.basename(r[0]) for r in empty] == ["empty.mp3"]
    assert found.inputFiles() == []
    assert names(CA.audio_catalog(spark, [str(tmp_path / "in/a.mp3"), str(tmp_path / "in/1/2/3")])) == ["a.mp3", "deep.mp3"]
    assert names(CA.audio_catalog(spark, str(tmp_path / "in/x*"))) == ["é#?.m4a"]
