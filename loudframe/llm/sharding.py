"""Reproducible shuffle of rows into shards by a Feistel permutation of global row numbers.

Row numbers 0..N-1 follow from the rows' own values, so the same rows get the same numbers however
their files are cut. A keyed permutation maps a number to its place in the shuffled corpus; shard
and slot are the remainder and quotient of the place. All of it is column arithmetic: the place of
any number can be computed, and ``row_at`` gives back the number behind a shard and slot.

Only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loudframe.llm.common import stored

ROUNDS = 6
#: Rows are numbered in this many buckets of equal expected size. Part of the numbering: another
#: value gives another, equally valid shuffle.
BUCKETS = 4096
#: Rows that repeat are written out in runs of this length.
RUN = 65536


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _sides(n: int) -> tuple[int, int]:
    """A rectangle that holds 0..n-1 and has fewer than sqrt(n)+1 further cells."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _pass(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass of the Feistel network over the rectangle: each round shifts one coordinate by a hash of the other."""
    a, b = map(_long, _sides(n))
    right = x % b
    left = ((x - right) / b).cast("long")
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if r % 2 == 0:
            step = F.pmod(F.xxhash64(_long(seed), _long(r), right), a)
            left = F.pmod(left - step if back else left + step, a)
        else:
            step = F.pmod(F.xxhash64(_long(seed), _long(r), left), b)
            right = F.pmod(right - step if back else right + step, b)
    return left * b + right


def _walk(x: Column, n: int, seed: int, back: bool) -> Column:
    """Pass again while the place lies outside 0..n-1. There are ``spare`` such cells, and a walk meets each once at most."""
    a, b = _sides(n)
    spare, first = a * b - n, _pass(x, n, seed, back)
    if spare == 0:
        return first
    on = F.aggregate(F.sequence(_long(1), _long(spare)), first,
                     lambda at, _: F.when(at < n, at).otherwise(_pass(at, n, seed, back)))
    return F.when(first < n, first).otherwise(on)


def place_of(row_number: Column, n: int, seed: int = 0) -> Column:
    """Place in the shuffled order of 0..n-1, as a permutation of the row numbers 0..n-1."""
    return _walk(row_number, n, seed, back=False)


def row_at(shard: Column, slot: Column, n: int, n_shards: int, seed: int = 0) -> Column:
    """The row number that lies at a slot of a shard."""
    return _walk(slot * _long(n_shards) + shard, n, seed, back=True)


def number_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``row_number`` 0..N-1, and N. Numbers follow the rows' values; rows of equal values are interchangeable.

    Equal rows are counted before they move, buckets are chosen by a hash of the whole row, and
    only one total per bucket meets in one place, so no value can make a task large.
    """
    columns = rows.columns
    counted = stored(rows.groupBy(*columns).agg(F.count("*").alias("__copies"))
                     .withColumn("__hash", F.xxhash64(*columns))
                     .withColumn("__bucket", F.pmod("__hash", _long(BUCKETS)).cast("int")), "numbered")
    totals = counted.groupBy("__bucket").agg(F.sum("__copies").alias("__n"))
    ahead = totals.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__ahead"))
    n = counted.agg(F.sum("__copies")).first()[0] or 0
    within = Window.partitionBy("__bucket").orderBy("__hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    started = (counted.withColumn("__before", F.coalesce(F.sum("__copies").over(within), _long(0)))
               .join(F.broadcast(ahead), "__bucket")  # BUCKETS rows at most
               .withColumn("__start", F.col("__ahead") + F.col("__before")))
    runs = started.select(*columns, "__start", "__copies", F.explode(F.sequence(
        _long(0), F.col("__copies") - 1, _long(RUN))).alias("__run"))
    numbered = runs.select(*columns, F.explode(F.sequence(
        F.col("__start") + F.col("__run"),
        F.col("__start") + F.least(F.col("__run") + RUN, F.col("__copies")) - 1)).alias("row_number"))
    return numbered, n


def shard_assignment(docs: DataFrame, n_shards: int = 8, seed: int = 0, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    ``size`` is the UTF-8 length plus one, a null text counts as the empty one. The law is ``rows``:
    shard sizes differ by one row at most, slots are gapless from 0. Equal texts are spread over
    the shards like any others. Null and repeated ids are rows like others; rows equal in id, size
    and checksum are interchangeable; an empty table gives no rows; further columns are ignored.
    """
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).cast("long").alias("text_crc32"))
    numbered, n = number_rows(rows)
    placed = numbered.withColumn("place", place_of(F.col("row_number"), n, seed) if n else _long(0))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % n_shards) / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number")


def shard_rows(docs: DataFrame, n_shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents themselves with shard and slot, ready for ``write.partitionBy("shard")``.

    Documents meet their places by id, size and checksum. Rows equal in all three are told apart by
    an ordinal that is counted on both sides.
    """
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    keyed = docs.withColumns({"__size": (F.octet_length(raw) + 1).cast("long"), "__crc": F.crc32(raw).cast("long")})
    right = shard_assignment(docs, n_shards, seed, id_col, text_col).select(
        F.col("doc_id").alias("__id"), F.col("size").alias("__s"), F.col("text_crc32").alias("__c"),
        F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), "row_number")
    left = keyed.withColumn("__k", F.row_number().over(Window.partitionBy(id_col, "__size", "__crc").orderBy(F.lit(0))))
    right = right.withColumn("__j", F.row_number().over(Window.partitionBy("__id", "__s", "__c").orderBy("row_number")))
    met = left.join(right, left[id_col].eqNullSafe(right["__id"]) & (left["__size"] == right["__s"])
                    & (left["__crc"] == right["__c"]) & (left["__k"] == right["__j"]))
    return met.select(*(docs[c] for c in docs.columns), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
