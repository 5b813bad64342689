"""Tag tables in long form: (path, namespace, pos, key, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions.report import dash
from loudframe.session import durable


def lookup_tag(tags: DataFrame, key: str) -> DataFrame:
    """value of the first item with the key per file."""
    return tags.where(F.upper("key") == key.upper()).groupBy("path").agg(F.min_by("value", "pos").alias("value"))


def tag_columns(tags: DataFrame, keys: Sequence[str] = C.REPORT_KEYS) -> DataFrame:
    """the known keys as columns (first match each), NULL where missing."""
    name = F.upper("key")
    return tags.groupBy("path").agg(
        *[
            F.min_by("value", F.when(name == k.upper(), F.col("pos"))).alias(k.lower())
            for k in keys
        ]
    )


def dashed(columns: DataFrame, keys: Sequence[str] = C.REPORT_KEYS) -> DataFrame:
    """Missing values as '-' for text output."""
    return columns.withColumns({k.lower(): dash(F.col(k.lower())) for k in keys})


def join_tags(files: DataFrame, columns: DataFrame) -> DataFrame:
    """Every file with its tag columns; ``has_tag`` tells files without any tag."""
    return files.join(columns.withColumn("has_tag", F.lit(True)), "path", "left").withColumn(
        "has_tag", F.coalesce("has_tag", F.lit(False))
    )


def merge_tag_rows(tags: DataFrame, updates: DataFrame, reserved: Sequence[str] = C.LEVEL_KEYS,
                   keep_missing: bool = False) -> DataFrame:
    """Other tags stay; the reserved tags of updated files are replaced by the new rows.

    Only tags in the namespace of a file's new rows are replaced. A reserved key without a new row
    disappears, unless ``keep_missing`` keeps its old value. Rows with a NULL path or key stay.
    """
    new = updates.select(F.col("path").alias("__path"), F.col("namespace").alias("__ns"), F.upper("key").alias("__k"))
    new = new.distinct() if keep_missing else new.select("__path", "__ns").distinct()
    key = F.upper(tags["key"])
    same = (tags["path"] == new["__path"]) & tags["namespace"].eqNullSafe(new["__ns"]) & key.isin([k.upper() for k in reserved])
    if keep_missing:
        same = same & (key == new["__k"])
    return tags.join(new, same, "left_anti").unionByName(updates.select(*tags.columns))


def level_tag_rows(levels: DataFrame, namespace: str = C.MP4_NAMESPACE) -> DataFrame:
    """Tag rows for levels (path, items): the list form in long form."""
    return levels.select("path", F.posexplode("items").alias("pos", "item")).select(
        "path", F.lit(namespace).alias("namespace"), "pos", F.col("item.key").alias("key"), F.col("item.value").alias("value")
    )


def upsert_level_tags(tags: DataFrame, levels: DataFrame, namespace: str = C.MP4_NAMESPACE,
                      keep_missing: bool = False) -> DataFrame:
    """Write formatted level tags (``items`` list per path) into the tag table.

    The levels, one small row per file, are stored first: the merge reads them twice.
    """
    return merge_tag_rows(tags, level_tag_rows(durable(levels), namespace), keep_missing=keep_missing)


def delete_tags(tags: DataFrame, files: DataFrame, namespace: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """The tag table without the tags of the given files; with ``namespace`` or ``keys`` only those of that namespace or those keys go."""
    gone = files.select(F.col("path").alias("__path"))
    same = tags["path"] == gone["__path"]
    if namespace is not None:
        same = same & (tags["namespace"] == namespace)
    if keys is not None:
        same = same & F.upper(tags["key"]).isin([k.upper() for k in keys])
    return tags.join(gone, same, "left_anti")


def delete_report(files: DataFrame, tags: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row per file: how many tag rows go, and the status."""
    counts = tags.groupBy("path").agg(F.count(F.lit(1)).alias("removed"))
    joined = files.join(counts, "path", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    return joined.withColumn("status", F.lit("dry_run" if dry_run else "success"))
