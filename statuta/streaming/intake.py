"""Intake of board exports and windowed counts, as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import boards
from . import keyed


def intake(spark: SparkSession, exports: str, target: str, checkpoint: str, seen: DataFrame | None = None) -> StreamingQuery:
    """Reads board exports as they land and keeps, for each law they touch, its canonical card among all that were seen; `keyed.current` picks
    the last of each law."""
    landed = spark.readStream.schema(boards.BOARD).option("multiLine", True).json(exports)
    return keyed.competing_cards(boards.counted_cards(landed), target, checkpoint, seen)


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and key, with a bound on lateness; for streams and for tables."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", key, "n")
