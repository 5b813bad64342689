"""Report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import levels as L
from loudframe.functions import paths as P
from loudframe.functions.report import finite_or_null, row_json
from loudframe.session import durable
from loudframe.streaming.store import Files

TSV_COLUMNS = ("File", "MP3 gain", "dB gain", "Max Amplitude", "Max global_gain", "Min global_gain")
MAX_DOCUMENT_ROWS = 10_000


def level_rows(measures: DataFrame, modifier_db: float = 0.0, file: str = "file") -> DataFrame:
    """The six columns of the level database, as text with six decimals for levels.

    ``measures`` has ``gain_db``, ``peak``, ``max_gain`` and ``min_gain`` per file.
    """
    gain = L.retarget_db(F.col("gain_db"), modifier_db)
    values = (
        P.file_name(F.col(file)),
        L.db_to_steps(gain).cast("string"),
        L.fixed_text(gain, 6),
        L.fixed_text(F.col("peak") * F.lit(C.PCM_SCALE), 6),
        F.col("max_gain").cast("string"),
        F.col("min_gain").cast("string"),
    )
    return measures.select(*[v.alias(n) for v, n in zip(values, TSV_COLUMNS)])


def write_tsv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write tab-separated text with a header line per part file, missing values as '-'."""
    rows.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", "-").csv(path)


def json_rows(report: DataFrame) -> DataFrame:
    """Each result row as JSON text; NULL fields are left out, infinite numbers count as NULL."""
    return report.select(_json_of(report).alias("value"))


def write_json(report: DataFrame, path: str, album: DataFrame | None = None, summary: DataFrame | None = None,
               mode: str = "errorifexists") -> None:
    """Write file rows, album rows and the summary as JSON lines below one folder."""
    for name, part in (("files", report), ("album", album), ("summary", summary)):
        if part is not None:
            json_rows(part).write.mode(mode).text(f"{path}/{name}")


def json_document(report: DataFrame, summary: DataFrame, album: DataFrame | None = None,
                  order: Sequence[str] = ("file",)) -> DataFrame:
    """One JSON document for a small batch as one value; refuses a batch above ``MAX_DOCUMENT_ROWS``.

    The size is checked first because it is one value in one task. ``write_json_document`` has no limit.
    """
    if report.select(F.lit(1)).limit(MAX_DOCUMENT_ROWS + 1).count() > MAX_DOCUMENT_ROWS:
        raise ValueError(f"more than {MAX_DOCUMENT_ROWS} rows: use write_json")
    fields = [
        (finite_or_null(F.col(f.name)) if f.dataType.typeName() in ("double", "float") else F.col(f.name)).alias(f.name)
        for f in report.schema.fields
    ]
    keyed = report.select(F.struct(F.struct(*order).alias("k"), F.struct(*fields).alias("v")).alias("r"))
    files = keyed.agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["v"]).alias("files"))
    # One album is an object, several are a list: none is left out.
    several = album is not None and len(album.select(F.lit(1)).head(2)) > 1
    columns = ["files", "summary"] if album is None else ["files", "albums" if several else "album", "summary"]
    parts = files.unionByName(summary.select(F.struct("*").alias("summary")), allowMissingColumns=True)
    if album is not None:
        rows = album.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("albums")) if several else album.select(F.struct("*").alias("album"))
        parts = parts.unionByName(rows, allowMissingColumns=True)
    parts = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
    return parts.select(F.to_json(F.struct(*columns)).alias("value"))


def write_json_document(report: DataFrame, summary: DataFrame, path: str, album: DataFrame | None = None,
                        order: Sequence[str] = ("file",), rows_per_part: int = 1_000_000) -> DataFrame:
    """One JSON document of any size, as parts that follow each other; returns (part, rows, first, last).

    Rows are range-sorted, so every part file is a run of the ordered document. The first part opens the list of
    files, each row but the first brings its own comma, and the last parts close the list and hold albums
    and summary. The parts' bytes in the order of their names are one valid document (``Files.names`` lists
    them, ``document_parts`` reads them); albums are always a list. The number of parts follows from the rows.
    """
    spark = report.sparkSession
    parts = max(1, -(-report.count() // rows_per_part))
    keyed = report.select(F.struct(*order).alias("k"), _json_of(report).alias("v"))
    placed = durable(keyed.repartitionByRange(parts, "k").sortWithinPartitions("k", "v")
                     .withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    first = placed.agg(F.min("__at")).first()[0]
    lines = placed.select(F.concat(F.when(F.col("__at") != F.lit(first), ",").otherwise(""), "v").alias("value"))

    def line(text: str) -> DataFrame:
        return spark.range(0, 1, 1, 1).select(F.lit(text).alias("value"))

    whole = line('{"files":[').union(lines)
    if album is None:
        whole = whole.union(line("],"))
    else:
        rows = durable(album.select(_json_of(album).alias("v")).repartitionByRange(max(1, -(-album.count() // rows_per_part)), "v")
                       .sortWithinPartitions("v").withColumn("__at", F.monotonically_increasing_id()))
        least = rows.agg(F.min("__at")).first()[0]
        whole = whole.union(line('],"albums":[')).union(
            rows.select(F.concat(F.when(F.col("__at") != F.lit(least), ",").otherwise(""), "v"))).union(line("],"))
    whole.union(summary.coalesce(1).select(F.concat(F.lit('"summary":'), _json_of(summary), F.lit("}")))).write.text(path)
    return placed.groupBy(F.col("__part").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("first"), F.max("k").alias("last"))


def document_parts(spark: SparkSession, path: str) -> list[str]:
    """The names of a document's parts, in order."""
    return sorted(n for n in Files(spark, path).names(path) if n.startswith("part-"))


def _json_of(report: DataFrame) -> Column:
    return row_json(*[
        (finite_or_null(F.col(f.name)) if f.dataType.typeName() in ("double", "float") else F.col(f.name)).alias(f.name) for f in report.schema.fields])
