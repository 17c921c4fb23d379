"""The foreign-exchange week: decision boundaries every five minutes from Sunday 17:05 to before Friday 16:00, New York time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import BAR

ZONE = "America/New_York"


def expected_boundaries(spark: SparkSession, start: int, end: int) -> DataFrame:
    """(boundary) within the half-open interval, generated on the executors."""
    if start % BAR or end % BAR or start >= end:
        raise ValueError("the interval must be ascending and on the five-minute grid")
    steps = spark.range(start // BAR, end // BAR).select((F.col("id") * BAR).alias("boundary"))
    local = F.from_utc_timestamp(F.timestamp_micros("boundary"), ZONE)
    day, minute = F.weekday(local), F.hour(local) * 60 + F.minute(local)
    return steps.where((day <= 3) | ((day == 4) & (minute < 16 * 60)) | ((day == 6) & (minute >= 17 * 60 + 5)))
