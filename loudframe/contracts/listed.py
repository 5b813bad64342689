"""Rows written as files, then listed, streamed and read in ranges as a directory of real files would be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.contracts.roles import ORACLES, contract, directory, table
from loudframe.contracts.tags import _boxed_documents, _tagged_documents
from loudframe.session import fresh_path
from loudframe.sources import catalog as CA
from loudframe.sources import files as FS
from loudframe.sources import ranged as RA

_ENDINGS = "['.mp3', '.M4A', '.txt', '.aac', ''][doc_id % 5 + 1]"


def _put(rows: DataFrame, folder: str) -> None:
    RA.write_files(rows, folder).agg(F.sum("length")).collect()


#: Whether a file's row has a lang and a text, its lang, its name; the number before the name keeps files of equal ids apart.
_NAME = r"([ln])([tn])-([^/]*)/\d+-([^/]+)$"


def _named(spark, sf_dir) -> DataFrame:
    """A file for each document, whatever its id and lang: the lang stands encoded in a directory's name, with what a file can't tell."""
    number, ending = F.monotonically_increasing_id(), F.get(F.array(*[F.lit(e) for e in (".mp3", ".M4A", ".txt", ".aac", "")]), (F.col("doc_id") % 5).cast("int"))
    has = lambda name, sign: F.when(F.col(name).isNull(), "n").otherwise(sign)
    folder = F.concat(has("lang", "l"), has("text", "t"), F.lit("-"), F.url_encode(F.coalesce("lang", F.lit(""))))
    file = F.concat((number % 1000).cast("string"), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(ending, F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", directory(number), folder, file).alias("path"), F.col("text").alias("content"))


def _documents_of(files: DataFrame) -> DataFrame:
    """(path, length) of the documents whose files these are."""
    part = lambda i: F.regexp_extract("path", _NAME, i)
    return files.select(F.when(part(1) == "l", F.concat(F.url_decode(part(3)), F.lit("/"), part(4))).alias("path"), F.when(part(2) == "t", F.col("length")).alias("length"))


_LISTED = f"""
SELECT lang || '/' || doc_id || {_ENDINGS} AS path, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE doc_id % 5 IN (0, 1, 3)"""


@contract(_LISTED)
def listed_files(spark, sf_dir):
    """The audio files of a tree of directories."""
    folder = fresh_path(spark, "listed")
    _put(_named(spark, sf_dir), folder)
    return _documents_of(CA.audio_catalog(spark, folder))


@contract(_LISTED)
def streamed_files(spark, sf_dir):
    """Half of the files, then the others, then none: each is logged once."""
    folder, rows = fresh_path(spark, "streamed"), _named(spark, sf_dir)
    for part in (rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 <> 0"), None):
        if part is not None:
            _put(part, f"{folder}/files")
        found = CA.incremental_catalog(spark, f"{folder}/files").select("path", "length")
        CA.append_new_files(found, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return _documents_of(spark.read.schema("path string, length bigint").json(f"{folder}/log"))


def _ranged(spark, rows: DataFrame, kind: str, ending: str) -> DataFrame:
    folder = fresh_path(spark, f"ranged-{kind}")
    _put(rows.withColumn("path", F.concat(directory(F.col("path").cast("bigint")), F.lit("/"), "path", F.lit(f".{ending}"))), folder)
    found = RA.read_regions(spark, folder, kind, (ending,))
    return found.withColumn("path", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1))


@contract(ORACLES["mp4_tags_job"])
def ranged_mp4_tags(spark, sf_dir):
    """S6 from files, of which only box headers and the item list are read."""
    return FS.mp4_tag_rows(_ranged(spark, _boxed_documents(spark, sf_dir), "mp4", "m4a"))


@contract(ORACLES["ape_tags_job"])
def ranged_ape_tags(spark, sf_dir):
    """S5 from files, of which only the trailing tag is read."""
    return FS.ape_tag_rows(_ranged(spark, _tagged_documents(spark, sf_dir), "ape", "mp3"))
