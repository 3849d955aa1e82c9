"""Progress in percent, rounded half to even, as Column expressions on whole frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _percent(share: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 100).cast("int")


def interval_progress(frame: Column, start: Column, end: Column) -> Column:
    """How far frame is through [start, end); 0 for an empty interval."""
    return _percent(F.when(end > start, (frame - start) / (end - start).cast("double")).otherwise(0.0))


def last_frame_progress(frame: Column, start: Column, end: Column) -> Column:
    """As interval_progress, with 100 at the last frame of the interval."""
    return _percent((frame - start) / F.greatest(end - start - 1, F.lit(1)).cast("double"))


def task_progress(frame: Column, frames: Column) -> Column:
    return _percent(frame / F.greatest(frames - 1, F.lit(1)).cast("double"))
