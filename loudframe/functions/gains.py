"""Gain adjustment and clip limiting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import levels as L


def adjust_saturating(gain: Column, steps: Column) -> Column:
    return F.greatest(F.lit(C.GAIN_MIN), F.least(F.lit(C.GAIN_MAX), gain + steps)).cast("int")


def adjust_wrapping(gain: Column, steps: Column) -> Column:
    return F.pmod(gain + steps, F.lit(256)).cast("int")


def adjust(gain: Column, steps: Column, wrap: bool = False) -> Column:
    return adjust_wrapping(gain, steps) if wrap else adjust_saturating(gain, steps)


def adjust_channel(gains: Column, channels: Column, channel: int, steps: Column, wrap: bool = False) -> Column:
    """Adjust one channel of a granule-major gain array, leave the others as they are."""
    return F.transform(
        gains, lambda g, i: F.when(i % channels == channel, adjust(g, steps, wrap)).otherwise(g.cast("int"))
    )


def limit_by_headroom(steps: Column, headroom: Column, *, prevent: bool = False, ignore: bool = False,
                      wrap: bool = False) -> Column:
    """Struct (steps, warning): hold a request to the field headroom, or only warn.

    ``prevent`` lowers the request, ``ignore`` silences the warning; wrapping requests
    and requests of zero or less are never limited.
    """
    over = F.lit(not wrap) & (steps > 0) & (steps > headroom)
    if prevent:
        final = F.when(over, headroom).otherwise(steps)
        text = F.format_string("gain reduced from %d to %d steps to prevent clipping", steps, headroom)
    else:
        final = steps
        text = F.format_string("clipping warning: requested %d steps but only %d headroom", steps, headroom)
    warn = F.lit(None).cast("string") if ignore and not prevent else F.when(over, text)
    return F.struct(final.cast("int").alias("steps"), warn.alias("warning"))


def limit_by_peak(steps: Column, gain_db: Column, peak: Column, *, prevent: bool = False, ignore: bool = False,
                  wrap: bool = False, compat: bool = False) -> Column:
    """Struct (steps, warning): hold a request so that the decoded peak stays below full scale.

    By default the check uses the gain really applied (``steps``) and the safe step count is
    rounded down, so that the limited request never exceeds the request and never clips.
    ``compat`` checks the track's own gain instead and rounds to nearest, as older tools do.
    """
    applied_db = gain_db if compat else L.steps_to_db(steps)
    new_peak = peak * L.gain_factor(applied_db)
    over = F.lit(not wrap) & (steps > 0) & (new_peak > 1.0)
    safe_db = F.lit(-20.0) * F.log10(peak)
    if compat:
        safe = F.greatest(L.db_to_steps(safe_db), F.lit(0))
    else:
        safe = F.least(steps, F.greatest(L.saturating_int(F.floor(safe_db / F.lit(C.STEP_DB)).cast("double")), F.lit(0)))
    if prevent:
        final = F.when(over, safe).otherwise(steps)
        text = F.format_string(
            "gain reduced from %d to %d steps to prevent clipping (peak: %s)", steps, safe, L.fixed_text(peak, 4)
        )
    else:
        final = steps
        text = F.format_string("clipping warning: peak would be %s (>1.00)", L.fixed_text(new_peak, 2))
    warn = F.lit(None).cast("string") if ignore and not prevent else F.when(over, text)
    return F.struct(final.cast("int").alias("steps"), warn.alias("warning"))
