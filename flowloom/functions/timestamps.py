"""Timestamps in several text formats, and whole seconds of zoneless ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order; the first that fits counts.
FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm")


def parse(text: Column) -> Column:
    """A zoneless timestamp, or null where no format fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down; independent of the session's zone."""
    return F.unix_timestamp(ts)
