"""Clock arithmetic in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(numerator: Column, denominator: Column) -> Column:
    """A rational number of seconds, not negative, in microseconds; halves go to the even number. Both are whole."""
    scaled, d = numerator.cast("decimal(38,0)") * 1_000_000, denominator.cast("decimal(19,0)")
    rest = scaled % d
    whole = ((scaled - rest) / d).cast("long")
    up = (rest * 2 > d) | ((rest * 2 == d) & (whole % 2 == 1))
    return whole + up.cast("long")


def source_time(pts_us: Column, cycle: Column, duration_us: Column) -> Column:
    """Where a frame of a source that is played again and again lies on one clock."""
    return cycle * duration_us + pts_us


def replay_position(now_us: Column, started_us: Column, speed: float) -> Column:
    """How far a replay has come; null where the clock would have gone back."""
    return F.when(now_us >= started_us, F.floor((now_us - started_us) * speed).cast("long"))


def state_word(value: Column) -> Column:
    """open, closed or unknown for true, false and null."""
    return F.when(value, "open").when(~value, "closed").otherwise("unknown")


def state_value(word: Column) -> Column:
    """true, false or null for open, closed and anything else."""
    return F.when(word == "open", True).when(word == "closed", False)
