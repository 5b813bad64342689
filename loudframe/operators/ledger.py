"""The ledger of applied gains: an append-only table and views of its running state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loudframe.functions import tags as T
from loudframe.operators.loudness import join_null_safe
from loudframe.operators.ordered import running_totals, time_blocks
from loudframe.session import durable

_ORDER = ("ts", "id")
DAY = 86400
#: The event of an entry that takes all former ones of its file back; any other event, or none, adds steps.
UNDO = "undo"


def gain_ledger(ledger: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = _ORDER,
                steps: str = "steps", block: Column | None = None) -> DataFrame:
    """The undo value after each entry."""
    block = time_blocks(order[0], DAY) if block is None else block
    return running_totals(ledger, keys, order, {"undo": F.col(steps).cast("bigint")}, block)


def channel_ledger(ledger: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = _ORDER,
                   block: Column | None = None, compat: bool = False) -> DataFrame:
    """Left and right undo values after each entry; a NULL channel means both.

    ``compat`` follows tools that store only the left value when both channels change: the
    right value is then overwritten by the left one.
    """
    block = time_blocks(order[0], DAY) if block is None else block
    steps, channel = F.col("steps").cast("bigint"), F.col("channel")
    none = F.lit(0).cast("bigint")
    left = F.when(channel.isNull() | (channel == 0), steps).otherwise(none)
    if not compat:
        right = F.when(channel.isNull() | (channel == 1), steps).otherwise(none)
        return running_totals(ledger, keys, order, {"left_undo": left, "right_undo": right}, block)
    only_right = F.when(channel == 1, steps).otherwise(none)
    first = running_totals(ledger, keys, order, {"left_undo": left, "__right": only_right}, block)
    shift = F.when(channel.isNull(), F.col("left_undo") - F.col("__right"))
    second = running_totals(first, keys, order, {}, block, lasts={"__shift": shift})
    right = F.col("__right") + F.coalesce("__shift", none)
    return second.withColumn("right_undo", right).drop("__right", "__shift")


def first_minmax(ledger: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = _ORDER,
                 block: Column | None = None) -> DataFrame:
    """The original gain range, stored once and carried along."""
    block = time_blocks(order[0], DAY) if block is None else block
    pair = F.when(F.col("min_gain").isNotNull(), T.format_minmax(F.col("min_gain"), F.col("max_gain")))
    return running_totals(ledger, keys, order, {}, block, firsts={"minmax": pair})


def _undone() -> Column:
    return F.coalesce(F.col("event") == UNDO, F.lit(False))


def epoch_ledger(ledger: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = _ORDER,
                 block: Column | None = None) -> DataFrame:
    """W3, W5 with undo: entries with ``epoch``, and ``left_undo``, ``right_undo``, ``minmax`` since the epoch began.

    Entries whose ``event`` is 'undo' open an epoch: they restore a file and clear its undo value and gain
    range, so both start anew with the next entry. Epochs are counted along the blocks of a file, as are the
    values inside an epoch; no file is a single window. An undo entry itself adds no steps.
    """
    keys, block = list(keys), time_blocks(order[0], DAY) if block is None else block
    one = F.when(_undone(), 1).otherwise(0).cast("bigint")
    counted = durable(running_totals(ledger, keys, order, {"epoch": one}, block))
    steps, channel, none = F.col("steps").cast("bigint"), F.col("channel"), F.lit(0).cast("bigint")
    pair = F.when(F.col("min_gain").isNotNull() & ~_undone(), T.format_minmax(F.col("min_gain"), F.col("max_gain")))
    sums = {f"{side}_undo": F.when(~_undone() & (channel.isNull() | (channel == i)), steps).otherwise(none) for i, side in enumerate(("left", "right"))}
    return running_totals(counted, [*keys, "epoch"], order, sums, block, firsts={"minmax": pair})


def current_entries(ledger: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = _ORDER) -> DataFrame:
    """The entries since each file's last undo; ``ledger_state`` of these is what its tags say now.

    Only one row per undone file meets the ledger, and adaptive execution splits a file with a large part of it.
    """
    spot = F.struct(*order)
    last = ledger.where(_undone()).groupBy(*keys).agg(F.max(spot).alias("__last"))
    return join_null_safe(ledger, last, list(keys)).where(F.col("__last").isNull() | (spot > F.col("__last"))).drop("__last")


def ledger_state(ledger: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = _ORDER) -> DataFrame:
    """Current state per file: undo values, last mode, original range and the undo tag text."""
    spot = F.struct(*order)
    steps, channel = F.col("steps").cast("bigint"), F.col("channel")
    pair = F.when(F.col("min_gain").isNotNull(), T.format_minmax(F.col("min_gain"), F.col("max_gain")))
    state = ledger.groupBy(*keys).agg(
        F.sum(F.when(channel.isNull() | (channel == 0), steps).otherwise(0)).alias("left_undo"),
        F.sum(F.when(channel.isNull() | (channel == 1), steps).otherwise(0)).alias("right_undo"),
        F.max_by(F.coalesce("wrap", F.lit(False)), spot).alias("wrap"),
        F.min_by(pair, F.when(pair.isNotNull(), spot)).alias("minmax"),
        F.count(F.lit(1)).alias("entries"),
    )
    return state.withColumn("undo_tag", T.format_undo(F.col("left_undo"), F.col("right_undo"), F.col("wrap")))
