"""Running totals and positions inside very long ordered groups.

A window over a whole key puts that key into one task, which fails when one track or file
holds a large part of all rows. Here long keys are cut into blocks that follow the order:
totals per block are pre-aggregated, their running sum is taken over the (few) blocks, and
the window over rows only ever sees one block. The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loudframe.functions.levels import int_div
from loudframe.session import durable

_BLOCK = "__block"


def time_blocks(ts: str, seconds: int = 3600) -> Column:
    """Block number of a timestamp; suits signals and logs whose rate per time is bounded.

    Timestamps without a zone are read in the session zone, which should be UTC.
    """
    return int_div(F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000)


def number_blocks(position: str, size: int = 65536) -> Column:
    """Block number of a dense counter."""
    return int_div(F.col(position), size)


def with_range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None,
                      name: str = "range_block") -> DataFrame:
    """Add a block column for data that has no natural block.

    Rows are range-partitioned by key and order, so every partition is of similar size
    whatever the skew. The partition number becomes data, hence the durable cut: a second
    evaluation could choose other range bounds.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return durable(ranged.withColumn(name, F.spark_partition_id()))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                   block: Column, firsts: dict[str, Column] | None = None,
                   lasts: dict[str, Column] | None = None) -> DataFrame:
    """Add inclusive running values per key: sums, first and last non-NULL values so far.

    ``block`` must not decrease along ``order`` inside a key. Every key is cut along its blocks, so
    the largest window is the largest block. NULL keys are keys of their own.

    The input is read twice, for the rows and, with few columns, for the block totals. Store it
    first if it is costly to compute.
    """
    keys, order, firsts, lasts = list(keys), list(order), firsts or {}, lasts or {}
    rows = df.withColumn(_BLOCK, block)
    spot = F.struct(*order)
    totals = rows.groupBy(*keys, _BLOCK).agg(
        *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()],
        *[F.min_by(c, F.when(c.isNotNull(), spot)).alias(f"__t_{n}") for n, c in firsts.items()],
        *[F.max_by(c, F.when(c.isNotNull(), spot)).alias(f"__t_{n}") for n, c in lasts.items()],
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, _BLOCK])],
        *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums],
        *[F.first(f"__t_{n}", ignorenulls=True).over(before).alias(f"__o_{n}") for n in firsts],
        *[F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__o_{n}") for n in lasts],
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "*",
        *[F.sum(c).over(inside).alias(f"__w_{n}") for n, c in sums.items()],
        *[F.first(c, ignorenulls=True).over(inside).alias(f"__w_{n}") for n, c in firsts.items()],
        *[F.last(c, ignorenulls=True).over(inside).alias(f"__w_{n}") for n, c in lasts.items()],
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, _BLOCK])]
    joined = local.join(offsets, same, "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col(f"__o_{n}").isNull(), F.col(f"__w_{n}"))
            .when(F.col(f"__w_{n}").isNull(), F.col(f"__o_{n}"))
            .otherwise(F.col(f"__o_{n}") + F.col(f"__w_{n}"))
            .alias(n)
            for n in sums
        ],
        *[F.coalesce(f"__o_{n}", f"__w_{n}").alias(n) for n in firsts],
        *[F.coalesce(f"__w_{n}", f"__o_{n}").alias(n) for n in lasts],
    )


def sample_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None = None,
                 name: str = "n") -> DataFrame:
    """Add the zero-based position of each row in its key.

    With ``block``, keys are cut along it; without, all rows are range-partitioned, which needs no
    property of the order but a durable copy.
    """
    one = {name: F.lit(1).cast("bigint")}
    if block is None:
        ranged = with_range_blocks(df, keys, order)
        out = running_totals(ranged, keys, order, one, F.col("range_block")).drop("range_block")
    else:
        out = running_totals(df, keys, order, one, block)
    return out.withColumn(name, F.col(name) - 1)


def packet_offsets(packets: DataFrame, keys: Sequence[str] = ("album", "track"), order: str = "packet_no",
                   samples: str = "left", block_size: int = 4096, name: str = "first_sample") -> DataFrame:
    """Add the index of each packet's first sample in its track.

    Missing packets close up, as they do for a decoder that skips what it cannot decode.
    """
    size = F.size(samples).cast("bigint")
    out = running_totals(packets, keys, [order], {name: size}, number_blocks(order, block_size))
    return out.withColumn(name, F.col(name) - size)


def packet_gaps(packets: DataFrame, keys: Sequence[str] = ("album", "track"), order: str = "packet_no") -> DataFrame:
    """Per key: packets present and packet numbers missing between the first and last one."""
    return packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        (F.max(order) - F.min(order) + 1 - F.count(F.lit(1))).alias("missing"),
    )


def lagged_taps(samples: DataFrame, keys: Sequence[str], position: str, value: str, taps: int,
                block_size: int = 65536) -> DataFrame:
    """Add ``x0..x<taps>``: the value and its history (W6); history before the start is 0.

    ``position`` counts samples from 0 without gaps. Each block also receives the last
    ``taps`` rows of the block before it, so no window spans a whole key.
    """
    own = number_blocks(position, block_size)
    rows = samples.withColumn("__own", own)
    borrowed = rows.select(
        "*",
        F.explode(
            F.when(
                F.col(position) >= (F.col("__own") + 1) * block_size - taps,
                F.array(F.col("__own"), F.col("__own") + 1),
            ).otherwise(F.array(F.col("__own")))
        ).alias(_BLOCK),
    )
    w = Window.partitionBy(*keys, _BLOCK).orderBy(position)
    out = borrowed.select(
        *samples.columns,
        "__own",
        _BLOCK,
        *[
            (F.col(value) if k == 0 else F.coalesce(F.lag(value, k).over(w), F.lit(0).cast("double"))).alias(f"x{k}")
            for k in range(taps + 1)
        ],
    )
    return out.where(F.col("__own") == F.col(_BLOCK)).drop("__own", _BLOCK)


def fir(samples: DataFrame, keys: Sequence[str], position: str, value: str, weights: Sequence[float],
        name: str = "y", block_size: int = 65536) -> DataFrame:
    """Feed-forward filter: weighted sum of a sample and its history."""
    taps = lagged_taps(samples, keys, position, value, len(weights) - 1, block_size)
    total = sum((F.col(f"x{k}") * F.lit(float(w)) for k, w in enumerate(weights)), F.lit(0.0))
    return taps.withColumn(name, total).drop(*[f"x{k}" for k in range(len(weights))])
