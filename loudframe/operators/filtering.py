"""Equal-loudness filtering of packet tables.

The filter is recursive, so sample ``n`` needs the state left by sample ``n - 1``. Two facts
make it a parallel job all the same:

* The state fades out: after ``warmup_samples(rate)`` samples the influence of an unknown
  start state is far below double rounding. A track is therefore cut into chunks, each chunk
  borrows that many samples from its predecessor, and no task ever holds a whole track.
* The recursion is linear, so inside a chunk the output of a short run of samples is a fixed
  matrix times its input plus a fixed matrix times its start state. Only the hand-over of
  the twelve state values from run to run is sequential.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe import schemas
from loudframe.functions import levels as L
from loudframe.operators.ordered import packet_offsets
from loudframe.operators.windows import merge_window_sums
from loudframe.session import durable

RUN = 128
STATE = 12
DEFAULT_CHUNK = 1 << 20
PACKET_SAMPLES = 1152  # usual samples per packet, sets packets per block
LEND_PACKETS = 16
_DOUBLES = pa.list_(pa.float64())


def supported_rates() -> list[int]:
    return list(C.SHAPING_FILTERS)


def coefficients(spark: SparkSession) -> DataFrame:
    """The filter weights as a dimension table with one row per sample rate (11 rows)."""
    rows = []
    for rate, (feedback, forward) in C.SHAPING_FILTERS.items():
        hp_feedback, hp_forward = C.high_pass_weights(rate)
        rows.append((rate, [1.0, *feedback], list(forward), [1.0, *hp_feedback], list(hp_forward)))
    return spark.createDataFrame(rows, schemas.COEFFS)


def join_coefficients(df: DataFrame) -> DataFrame:
    """Add the weights for each row's sample rate; unknown rates get an error text.

    The weight table has a fixed size of 11 rows, so it is always broadcast.
    """
    joined = df.join(F.broadcast(coefficients(df.sparkSession)), "sample_rate", "left")
    text = F.format_string("Unsupported sample rate: %d Hz", F.col("sample_rate"))
    return joined.withColumn("error", F.when(F.col("ya").isNull(), text))


def rate_error(sample_rate) -> Column:
    return F.when(
        ~sample_rate.isin(supported_rates()) | sample_rate.isNull(),
        F.concat(F.lit("Unsupported sample rate: "), F.coalesce(sample_rate.cast("string"), F.lit("unknown")), F.lit(" Hz")),
    )


def warmup_samples(rate: int) -> int:
    """Samples after which any start state has faded by more than 1e-20."""
    feedback = C.SHAPING_FILTERS[rate][0]
    radius = max(np.abs(np.roots([1.0, *weights])).max() for weights in (feedback, C.high_pass_weights(rate)[0]))
    return math.ceil(math.log(1e-20) / math.log(radius)) + 64


def max_warmup() -> int:
    return max(warmup_samples(r) for r in C.SHAPING_FILTERS)


class RunFilter:
    """The two filters of one sample rate as matrices over a run of samples."""

    def __init__(self, rate: int):
        feedback, forward = C.SHAPING_FILTERS[rate]
        self.a, self.b = np.array(feedback), np.array(forward)
        hp_feedback, hp_forward = C.high_pass_weights(rate)
        self.d, self.c = np.array(hp_feedback), np.array(hp_forward)
        zero = np.zeros((STATE, 1))
        # Answers to a unit sample, to each unit state and to the constant bias alone.
        unit, after_unit = self._drive(zero, 1.0, 0.0)
        self.from_state, self.carry = self._drive(np.eye(STATE), 0.0, 0.0)
        bias, after_bias = self._drive(zero, 0.0, C.FILTER_BIAS)
        lag = np.subtract.outer(np.arange(RUN), np.arange(RUN))
        self.from_input = np.where(lag >= 0, unit[:, 0][np.abs(lag)], 0.0)
        self.bias, self.bias_state = bias[:, 0], after_bias[-1][:, 0]
        self.input_state = np.stack([after_unit[RUN - 1 - j][:, 0] for j in range(RUN)], axis=1)
        self.carry = self.carry[-1]

    def step(self, s: np.ndarray, x, bias: float):
        """One sample for a batch of states (columns); returns the output and the next state."""
        y = self.b[0] * x + s[0] + bias
        nxt = np.empty_like(s)
        nxt[:10] = np.multiply.outer(self.b[1:], x + np.zeros_like(y)) - np.multiply.outer(self.a, y)
        nxt[:9] += s[1:10]
        z = self.c[0] * y + s[10] + bias
        nxt[10] = self.c[1] * y - self.d[0] * z + s[11]
        nxt[11] = self.c[2] * y - self.d[1] * z
        return z, nxt

    def _drive(self, s: np.ndarray, first: float, bias: float):
        outs, states = [], []
        for i in range(RUN):
            z, s = self.step(s, first if i == 0 else 0.0, bias)
            outs.append(z)
            states.append(s)
        return np.array(outs), states

    def apply(self, x: np.ndarray, state: np.ndarray | None = None):
        """Filter samples in order from a start state; returns (output, end state)."""
        state = np.zeros(STATE) if state is None else np.asarray(state, dtype=float)
        runs = len(x) // RUN
        parts = []
        if runs:
            block = x[: runs * RUN].reshape(runs, RUN)
            gained = block @ self.input_state.T + self.bias_state
            starts = np.empty((runs, STATE))
            for i in range(runs):
                starts[i] = state
                state = self.carry @ state + gained[i]
            parts.append((block @ self.from_input.T + self.bias + starts @ self.from_state.T).ravel())
        rest = x[runs * RUN:]
        if len(rest):
            out = np.empty(len(rest))
            column = state[:, None]
            for i, value in enumerate(rest):
                z, column = self.step(column, value, C.FILTER_BIAS)
                out[i] = z[0]
            parts.append(out)
            state = column[:, 0]
        return (np.concatenate(parts) if parts else np.empty(0)), state


class _Kernels(dict):
    """Kernels made so far in this process. Travels to workers empty: what a function ships doesn't depend on what ran before."""

    def __reduce__(self):
        return _Kernels, ()


_KERNELS = _Kernels()


def run_filter(rate: int) -> RunFilter:
    if rate not in _KERNELS:
        _KERNELS[rate] = RunFilter(rate)
    return _KERNELS[rate]


def _chunked(packets: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """Assign packets (with ``first_sample``) to chunks, lending the warm-up to the next chunk."""
    if chunk <= max_warmup():
        raise ValueError("a chunk must be longer than the filter's warm-up")
    own = L.int_div(F.col("first_sample"), chunk)
    end = F.col("first_sample") + F.size("left")
    lends = end > (own + 1) * chunk - F.lit(max_warmup())
    return _lend(packets.where(F.size("left") > 0), [*keys, "packet_no", "first_sample"], own, lends)


def _lend(packets: DataFrame, columns: Sequence[str], own: Column, lends: Column) -> DataFrame:
    """Each packet once for its own chunk and, where it lends, once more for the next one."""
    targets = F.when(lends, F.array(own, own + 1)).otherwise(F.array(own))
    return packets.select(
        *columns, "sample_rate", L.sample_scale(F.col("format")).alias("scale"), "left", "right",
        own.alias("__own"), F.explode(targets).alias("__chunk"),
    )


def packet_size(packets: DataFrame) -> Column:
    """Samples in a packet: a stored ``samples`` column spares reading the sample arrays."""
    return F.col("samples").cast("bigint") if "samples" in packets.columns else F.size("left").cast("bigint")


def _block_table(packets: DataFrame, keys: Sequence[str], per_block: int, lends: Sequence[int]) -> DataFrame:
    """Per block of packet numbers: its first sample, and for each of some numbers of lent
    packets whether the block before lends enough with it. One small row per block.
    """
    block, size = L.int_div(F.col("packet_no"), per_block), packet_size(packets)
    rates = F.coalesce(*[F.when(F.col("sample_rate") == r, F.lit(warmup_samples(r))) for r in supported_rates()])
    tail = lambda n: F.sum(F.when(F.col("packet_no") >= (block + 1) * per_block - n, size).otherwise(0))
    sums = packets.groupBy(*keys, block.alias("__chunk")).agg(
        F.sum(size).alias("samples"), F.max(rates).alias("warmup"), *[tail(n).alias(f"tail{n}") for n in lends]
    )
    order = Window.partitionBy(*keys).orderBy("__chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    follows = F.lag("__chunk").over(order) == F.col("__chunk") - 1
    placed = sums.select(
        *keys, "__chunk", "warmup", F.coalesce(F.sum("samples").over(before), F.lit(0).cast("bigint")).alias("block_start"),
        *[F.when(follows, F.lag(f"tail{n}").over(order)).otherwise(0).alias(f"lent{n}") for n in lends],
    )
    return durable(placed.select(
        *keys, "__chunk", "block_start", *[(F.col(f"lent{n}") >= F.least("warmup", "block_start")).alias(f"enough{n}") for n in lends]
    ))


def _blocked(packets: DataFrame, keys: Sequence[str], per_block: int) -> DataFrame | None:
    """Assign packets to blocks of packet numbers, so that the samples move only once.

    Block and lending follow from the packet number alone; the position of a block comes from
    the small block table, which also tells how many packets have to be lent. None says that
    an eighth of a block is not enough somewhere, as with packet numbers full of gaps.
    """
    usable = packets.where(F.size("left") > 0)
    lends = sorted({min(LEND_PACKETS, per_block), max(per_block // 8, 1)})
    blocks = _block_table(usable, keys, per_block, lends)
    enough = blocks.agg(*[F.bool_and(f"enough{n}").alias(f"n{n}") for n in lends]).first()
    lend = next((n for n in lends if enough[f"n{n}"] is not False), None)
    if lend is None:
        return None
    own = L.int_div(F.col("packet_no"), per_block)
    rows = _lend(usable, [*keys, "packet_no"], own, F.col("packet_no") >= (own + 1) * per_block - lend)
    names = [*keys, "__chunk"]
    placed = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)], "block_start")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)]
    return rows.join(placed, same, "left").drop(*[f"__k{i}" for i in range(len(names))])


def _placed(packets: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """Packets in chunks: by stored sample positions, by packet number, or by computed positions."""
    usable = packets.where(rate_error(F.col("sample_rate")).isNull())
    if "first_sample" in packets.columns:
        return _chunked(usable, keys, chunk)
    blocked = _blocked(usable, keys, max(chunk // PACKET_SAMPLES, 1))
    return _chunked(packet_offsets(usable, keys), keys, chunk) if blocked is None else blocked


def _channel(column: pa.ChunkedArray, scale: np.ndarray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False) * scale


def _right(table: pa.Table, left: np.ndarray, sizes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Right channel; a packet without one counts as the same signal on both channels."""
    if table["right"].null_count == 0:
        return _channel(table["right"], scale)
    right = left.copy()
    given = np.repeat(np.asarray(table["right"].is_valid()), sizes)
    right[given] = _channel(table["right"], scale[given])
    return right


def _filtered_chunk(table: pa.Table):
    """Sort one chunk, filter its channels; None when it only holds borrowed packets."""
    table = table.take(pa.compute.sort_indices(table, sort_keys=[("packet_no", "ascending")]))
    own = np.asarray(table["__own"]) == np.asarray(table["__chunk"])
    if not own.any():
        return None
    sizes = pa.compute.list_value_length(table["left"]).to_numpy(zero_copy_only=False).astype(np.int64)
    if "first_sample" not in table.column_names:
        ends = np.cumsum(sizes)
        starts = table["block_start"][int(np.argmax(own))].as_py() - sizes[~own].sum() + ends - sizes
        table = table.append_column("first_sample", pa.array(starts, pa.int64()))
    scale = np.repeat(np.asarray(table["scale"], dtype=float), sizes)
    kernel = run_filter(table["sample_rate"][0].as_py())
    left_raw = _channel(table["left"], scale)
    left = kernel.apply(left_raw)[0]
    stereo = table["right"].null_count < table.num_rows
    right_raw = _right(table, left_raw, sizes, scale) if stereo else left_raw
    right = kernel.apply(right_raw)[0] if stereo else left
    keep = np.repeat(own, sizes)
    loud = np.maximum(np.abs(left_raw), np.abs(right_raw))[keep] / C.PCM_SCALE
    return table, own, sizes, keep, left, right, stereo, loud


def filter_window_sums(packets: DataFrame, keys: Sequence[str] = ("album", "track"),
                       chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Filter packets and return window sums (sum_squares, samples, peak) per track and window.

    With a stored ``first_sample`` (see ``packet_offsets``) or without: then chunks follow the
    packet numbers and the samples are shuffled once. Rows with an unsupported sample rate are
    left out here; ``rate_error`` names them for error reports.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", window_no bigint, sum_squares double, samples bigint, peak double"

    def sums(table: pa.Table) -> pa.Table:
        done = _filtered_chunk(table)
        if done is None:
            return pa.table({**{k: table[k].slice(0, 0) for k in keys}, "window_no": pa.array([], pa.int64()),
                             "sum_squares": pa.array([], pa.float64()), "samples": pa.array([], pa.int64()),
                             "peak": pa.array([], pa.float64())})
        table, _, sizes, keep, left, right, _, loud = done
        per_window = table["sample_rate"][0].as_py() * C.WINDOW_MS // 1000
        starts = np.asarray(table["first_sample"])
        position = (np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(left)))[keep]
        window = position // per_window
        base = window[0]
        energy = np.bincount(window - base, weights=(left * left + right * right)[keep])
        count = np.bincount(window - base)
        used = np.nonzero(count)[0]
        peak = np.maximum.reduceat(loud, np.searchsorted(window - base, used))  # positions only grow
        return pa.table({
            **{k: pa.concat_arrays([table[k].slice(0, 1).combine_chunks()]).take(pa.array(np.zeros(len(used), np.int64))) for k in keys},
            "window_no": pa.array(used + base, pa.int64()),
            "sum_squares": pa.array(energy[used], pa.float64()),
            "samples": pa.array(count[used], pa.int64()),
            "peak": pa.array(peak, pa.float64()),
        })

    parts = _placed(packets, keys, chunk).groupBy(*keys, "__chunk").applyInArrow(sums, schema)
    return merge_window_sums(parts, keys)


def equal_loudness_filter(packets: DataFrame, keys: Sequence[str] = ("album", "track"),
                          chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Packets with filtered channels in the 16-bit range, and their ``first_sample``."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    schema += ", packet_no bigint, sample_rate int, first_sample bigint, left array<double>, right array<double>"

    def filtered(table: pa.Table) -> pa.Table:
        done = _filtered_chunk(table)
        names = [*keys, "packet_no", "sample_rate", "first_sample"]
        if done is None:
            empty = table.select(names[:-1]).slice(0, 0).append_column("first_sample", pa.array([], pa.int64()))
            return empty.append_column("left", pa.array([], _DOUBLES)).append_column("right", pa.array([], _DOUBLES))
        table, own, sizes, keep, left, right, stereo, _ = done
        kept = table.filter(pa.array(own)).select(names)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[own])]), pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values[keep], pa.float64()))
        kept = kept.append_column("left", lists(left))
        return kept.append_column("right", lists(right) if stereo else pa.nulls(kept.num_rows, _DOUBLES))

    return _placed(packets, keys, chunk).groupBy(*keys, "__chunk").applyInArrow(filtered, schema)
