"""Structured Streaming forms of the accumulating operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mesh import deposit


def deposit_stream(points: DataFrame, n: int, box: float, kind: str = "tsc") -> DataFrame:
    """A running deposit of a stream of points; state is at most n**3 cells.  Use output mode complete or update."""
    return deposit(points, n, box, kind)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window and type, closed when the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
