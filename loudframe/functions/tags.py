"""Metadata tag values and ordered tag lists.

A tag list is an ``array<struct<key:string,value:string>>``; keys compare without case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import levels as L


def _same(item: Column, key: str) -> Column:
    return F.upper(item["key"]) == key.upper()


def tag_get(items: Column, key: str) -> Column:
    """Value of the first item with the key, or NULL."""
    return F.get(F.filter(items, lambda t: _same(t, key)), F.lit(0))["value"]


def tag_set(items: Column, key: str, value: Column) -> Column:
    """Replace the first match in place (its key keeps its case) or append an upper-cased key."""
    first = F.array_position(F.transform(items, lambda t: F.upper(t["key"])), F.lit(key.upper()))
    fresh = F.struct(F.lit(key.upper()).alias("key"), value.alias("value"))
    replaced = F.transform(
        items,
        lambda t, i: F.when(
            i == first - 1, F.struct(t["key"].alias("key"), value.alias("value"))
        ).otherwise(F.struct(t["key"].alias("key"), t["value"].alias("value"))),
    )
    return F.when(first > 0, replaced).otherwise(F.concat(items, F.array(fresh)))


def tag_remove(items: Column, *keys: str) -> Column:
    wanted = [k.upper() for k in keys]
    return F.filter(items, lambda t: ~F.upper(t["key"]).isin(wanted))


def tag_is_empty(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) <= 0


def _whole_number(text: Column) -> Column:
    """Strict 32-bit integer: an optional sign and digits, nothing else."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike("^[+-]?[0-9]+$"), trimmed.try_cast("int"))


def parse_undo(text: Column) -> Column:
    """Struct (left, right) from 'L,R,flag'; left defaults to 0 and right to left."""
    parts = F.split(text, ",")
    left = F.coalesce(_whole_number(F.get(parts, F.lit(0))), F.lit(0))
    right = F.coalesce(_whole_number(F.get(parts, F.lit(1))), left)
    return F.struct(left.alias("left"), right.alias("right"))


def undo_steps(text: Column) -> Column:
    """Left value of an undo tag, or NULL when it cannot be read."""
    return _whole_number(F.get(F.split(text, ","), F.lit(0)))


def format_undo(left: Column, right: Column, wrap: Column) -> Column:
    return F.format_string("%+04d,%+04d,%s", left, right, F.when(wrap, "W").otherwise("N"))


def format_minmax(min_gain: Column, max_gain: Column) -> Column:
    return F.concat_ws(",", min_gain.cast("string"), max_gain.cast("string"))


def format_gain_tag(gain_db: Column) -> Column:
    return F.concat(L.fixed_text(gain_db, 2, sign=True), F.lit(" dB"))


def format_peak_tag(peak: Column) -> Column:
    return L.fixed_text(peak, 6)


def parse_gain_tag(text: Column) -> Column:
    """Number at the front of a gain or peak tag, or NULL."""
    return F.regexp_extract(text, r"([+-]?[0-9.]+)", 1).try_cast("double")


def level_tags(track_gain: Column, track_peak: Column, album_gain: Column | None = None,
               album_peak: Column | None = None) -> Column:
    """Tag list with the formatted track and (optional) album levels."""
    pairs = [(C.TRACK_GAIN_KEY, format_gain_tag(track_gain)), (C.TRACK_PEAK_KEY, format_peak_tag(track_peak))]
    if album_gain is not None:
        pairs += [(C.ALBUM_GAIN_KEY, format_gain_tag(album_gain)), (C.ALBUM_PEAK_KEY, format_peak_tag(album_peak))]
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
