"""Paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loudframe import constants as C


def file_name(path: Column) -> Column:
    """Last named part of a path, 'unknown' when there is none; trailing slashes do not count."""
    name = F.regexp_extract(path, r"([^/]+)(?:/|/\.)*$", 1)
    return F.when(name.isin("", ".", ".."), "unknown").otherwise(F.coalesce(name, F.lit("unknown")))


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path part, '' when there is none.

    A leading dot alone does not start an extension.
    """
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_audio(path: Column, extensions: tuple[str, ...] = C.AUDIO_EXTENSIONS) -> Column:
    return extension(path).isin(list(extensions))


def is_desktop_audio(path: Column, extensions: tuple[str, ...] = C.DESKTOP_EXTENSIONS) -> Column:
    """The stricter filter: a shorter list, and no resource-fork names ('._name')."""
    return is_audio(path, extensions) & ~F.startswith(file_name(path), F.lit("._"))
