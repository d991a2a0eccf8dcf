"""Daily monitoring windows over a stream of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_windows(
    stream: DataFrame,
    timestamp: str = "inference_timestamp",
    prediction: str = "prediction",
    model: str = "model_version",
    delay: str = "1 hour",
) -> DataFrame:
    """``(day, model, rows, mean, min, max)``, emitted once a day is past the watermark.

    Rows later than ``delay`` are dropped. The same function serves a batch frame.
    """
    value = F.col(prediction).cast("double")
    return (
        stream.withWatermark(timestamp, delay)
        .groupBy(F.window(timestamp, "1 day").alias("w"), model)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(value).alias("mean"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
        .select(F.col("w.start").alias("day"), model, "rows", "mean", "min", "max")
    )
