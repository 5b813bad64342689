"""ST3: the running undo value per file, kept by the state store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe.functions import tags as T
from loudframe.streaming.store import MergedTable


def stream_ledger(stream: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Undo value, number of entries and original gain range per file."""
    spot = F.struct(*order)
    pair = F.when(F.col("min_gain").isNotNull(), T.format_minmax(F.col("min_gain"), F.col("max_gain")))
    return stream.groupBy(*keys).agg(
        F.sum(F.col("steps").cast("bigint")).alias("undo"),
        F.count(F.lit(1)).alias("entries"),
        F.min_by(pair, F.when(pair.isNotNull(), spot)).alias("minmax"),
    )


def state_table(spark: SparkSession, keys: Sequence[str], target: str, every: int = 8) -> MergedTable:
    """The stored state: of each file the row of its latest batch."""
    def latest(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*keys, "batch")]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"), F.max("batch").alias("batch"))
        return newest.select(*keys, "v.*", "batch")

    return MergedTable(spark, target, latest, every)


def write_state(state: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("path",), every: int = 8):
    """Store the files that changed in each batch; a repeated batch does not count twice."""
    table = state_table(state.sparkSession, keys, target, every)

    def put(batch: DataFrame, batch_id: int) -> None:
        table.add(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id, writer=checkpoint)

    return (
        state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(put).trigger(availableNow=True).start()
    )


def read_state(spark: SparkSession, keys: Sequence[str], target: str) -> DataFrame:
    """The latest row per file."""
    return state_table(spark, keys, target).read().drop("batch")
