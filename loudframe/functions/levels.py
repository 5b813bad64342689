"""Level arithmetic: decibels, steps, bins, peaks, clipping."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loudframe import constants as C

INT_MAX = 2147483647
INT_MIN = -2147483648


def int_div(dividend: Column, divisor: Column | int) -> Column:
    """Exact integer division (positions and counters are never negative)."""
    return F.call_function("div", dividend.cast("bigint"), _as_col(divisor).cast("bigint"))


def saturating_int(value: Column) -> Column:
    """Truncate a double toward zero; out-of-range values saturate, NaN becomes 0 and NULL stays."""
    bounded = F.greatest(F.least(F.nanvl(value, F.lit(0.0)), F.lit(float(INT_MAX))), F.lit(float(INT_MIN)))
    return F.when(value.isNotNull(), bounded.cast("int"))


@F.arrow_udf(T.DoubleType())
def log10(value: pa.Array) -> pa.Array:
    """The C library's logarithm, as the method and SQL have it: minus infinity of zero, NaN of negative values, and its last digit.

    Spark's own is NULL for both, and its last digit may differ.
    """
    return pc.log10(value)


@F.arrow_udf(T.DoubleType())
def pow10(value: pa.Array) -> pa.Array:
    """A power of ten by the C library; Spark's own may differ in the last digit, which shows in a rounded value of ten digits or more."""
    return pc.power(pa.scalar(10.0), value)


def to_places(value: Column, digits: int) -> Column:
    """Round to decimal places as C and SQL do: the scaled value half away from zero, scaled back.

    Spark's own rounds the shortest decimal text, which differs where the scaled value has no binary digits left to round.
    """
    scaled = value * F.lit(float(10**digits))
    size = F.abs(scaled)
    whole = F.floor(size).cast("double")
    nearest = whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)
    rounded = F.when(size < 2.0**52, F.when(scaled < 0, -nearest).otherwise(nearest)).otherwise(scaled) / F.lit(float(10**digits))
    return F.when(F.abs(rounded) < float("inf"), rounded).otherwise(value)


def _split(value: Column) -> tuple[Column, Column]:
    """A double as the sum of two halves whose products are exact."""
    shifted = value * F.lit(134217729.0)
    high = shifted - (shifted - value)
    return high, value - high


def to_decimals(value: Column, digits: int) -> Column:
    """Round to a number of decimals by the exact binary value, ties to even.

    Spark's own formatting rounds the shortest decimal text of a double half up, so 6.625
    would become 6.63. Other tools print 6.62, and tags have to agree with them. The rounding
    error of ``value * 10^digits`` tells on which side of a tie the value really lies.
    """
    scale = float(10**digits)
    size = F.abs(value)
    product = size * F.lit(scale)
    (a, b), (c, d) = _split(size), _split(F.lit(scale))
    error = ((a * c - product) + a * d + b * c) + b * d
    whole = F.floor(product).cast("double")
    excess = product - whole - F.lit(0.5)
    up = (excess > 0) | ((excess == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    return F.when(size < F.lit(2.0**52 / scale), F.when(value < 0, -rounded).otherwise(rounded)).otherwise(value)


def fixed_text(value: Column, digits: int, sign: bool = False) -> Column:
    """Text with a fixed number of decimals, optionally with a leading plus sign.

    The one-element array evaluates ``value`` once; written out it would be repeated dozens
    of times in the expression. Text is only made for report rows, never per sample.
    """
    rounded = F.get(F.transform(F.array(value), lambda v: to_decimals(v, digits)), F.lit(0))
    return F.format_string(f"%{'+' if sign else ''}.{digits}f", rounded)


def db_to_steps(db: Column) -> Column:
    """Nearest whole step (half away from zero)."""
    return saturating_int(F.round(db / F.lit(C.STEP_DB)))


def steps_to_db(steps: Column) -> Column:
    return steps * F.lit(C.STEP_DB)


def suggest_gain(loudness_db: Column, level: float = C.PINK_LEVEL_DB) -> Column:
    return F.lit(level) - loudness_db


def retarget_db(gain_db: Column, modifier_db: Column | float = 0.0) -> Column:
    """Shift a gain by a number of decibels before it is rounded to steps."""
    return gain_db + _as_col(modifier_db)


def retarget_steps(gain_db: Column, modifier_steps: Column | int = 0) -> Column:
    """Round a gain to steps, then shift it by whole steps."""
    return db_to_steps(gain_db) + _as_col(modifier_steps)


def target_gain(gain_db: Column, target_db: Column | float) -> Column:
    """Gain that reaches a chosen volume instead of the 89 dB reference."""
    return _as_col(target_db) - F.lit(C.REFERENCE_DB) + gain_db


def display_volume(gain_db: Column) -> Column:
    return F.lit(C.REFERENCE_DB) - gain_db


def gain_factor(gain_db: Column) -> Column:
    return F.pow(F.lit(10.0), gain_db / F.lit(20.0))


def would_clip(peak: Column, gain_db: Column) -> Column:
    return peak * gain_factor(gain_db) > F.lit(1.0)


def is_clipping(peak: Column) -> Column:
    return peak >= F.lit(1.0)


def peak_headroom_db(peak: Column) -> Column:
    """Distance to full scale; positive infinity for digital silence."""
    return F.when(peak > 0, F.lit(-20.0) * F.log10(peak)).otherwise(F.lit(float("inf")))


def may_be_clipped(kind: Column, peak: Column) -> Column:
    """A decoded mp3 peak this close to full scale may have been cut by the decoder."""
    return (F.lower(kind) == "mp3") & (peak >= F.lit(C.CLIP_WARNING_PEAK))


def field_headroom_steps(max_gain: Column) -> Column:
    return (F.lit(C.GAIN_MAX) - max_gain).cast("int")


def field_headroom_db(max_gain: Column) -> Column:
    return steps_to_db(field_headroom_steps(max_gain))


def estimated_peak(max_gain: Column) -> Column:
    """Peak estimate for files without decoded samples, from the gain field alone."""
    return F.pow(F.lit(10.0), -field_headroom_db(max_gain) / F.lit(20.0))


def window_samples(sample_rate: Column) -> Column:
    """Whole samples in one 50 ms window."""
    return int_div(sample_rate * F.lit(C.WINDOW_MS), 1000)


def level_bin(mean_square: Column) -> Column:
    """Histogram bin of 0.01 dB, or NULL when the level lies outside the histogram."""
    steps = F.lit(float(C.BINS_PER_DB * 10)) * F.log10(mean_square + F.lit(C.LOG_FLOOR))
    # Saturation below the int range keeps the sum from overflowing.
    index = saturating_int(steps).cast("bigint") + F.lit(C.HISTOGRAM_OFFSET)
    return F.when((index >= 0) & (index < C.HISTOGRAM_BINS), index.cast("int"))


def bin_db(bin_index: Column) -> Column:
    return (bin_index - F.lit(C.HISTOGRAM_OFFSET)) / F.lit(float(C.BINS_PER_DB))


def sample_scale(sample_format: Column) -> Column:
    """Factor that brings samples of a storage format to the 16-bit range."""
    return (
        F.when(sample_format == "F32", F.lit(C.PCM_SCALE))
        .when(sample_format == "S16", F.lit(1.0))
        .when(sample_format == "S32", F.lit(C.PCM_SCALE / C.PCM32_SCALE))
    )


def scale_samples(samples: Column, sample_format: Column) -> Column:
    """An array of stored samples in the 16-bit range, as doubles."""
    scale = sample_scale(sample_format)
    return F.transform(samples, lambda x: x.cast("double") * scale)


def array_peak(samples: Column) -> Column:
    """Largest magnitude of an array (NULL for NULL or empty input)."""
    return F.greatest(F.array_max(samples), -F.array_min(samples))


def _as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
