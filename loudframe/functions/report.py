"""Result rows: status, text fields, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status_of(*, error: Column, steps: Column | None = None, frames: Column | None = None, tag: Column | None = None,
              info: Column | None = None, dry_run: bool = False) -> Column:
    """Status word of a result row.

    error > no_tag (tag column given and NULL) > skipped (zero steps or zero frames)
    > dry_run > info > success.
    """
    chain = F.when(error.isNotNull(), "error")
    if tag is not None:
        chain = chain.when(tag.isNull(), "no_tag")
    if steps is not None:
        chain = chain.when(steps == 0, "skipped")
    if frames is not None:
        chain = chain.when(frames == 0, "skipped")
    if dry_run:
        return chain.otherwise("dry_run")
    if info is not None:
        chain = chain.when(info, "info")
    return chain.otherwise("success")


def dash(value: Column) -> Column:
    """Text form of a field in tab-separated reports: '-' for a missing value."""
    return F.coalesce(value.cast("string"), F.lit("-"))


def finite_or_null(value: Column) -> Column:
    """JSON has no infinity or NaN; both become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def row_json(*columns: Column | str) -> Column:
    """A row as a JSON object without its NULL fields."""
    return F.to_json(F.struct(*columns))
