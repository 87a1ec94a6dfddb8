"""Streaming forms: bars over an unbounded tick stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, period: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream with columns contract, ts (timestamp), seq, px_ticks, vol, side:
    the same aggregates as the batch bars, closed once the watermark has passed."""
    return ticks.withWatermark("ts", late).groupBy("contract", F.window("ts", period).alias("w")).agg(
        F.min_by("px_ticks", "seq").alias("o"), F.max("px_ticks").alias("h"), F.min("px_ticks").alias("l"), F.max_by("px_ticks", "seq").alias("c"),
        F.sum("vol").alias("v"), F.sum(F.col("side") * F.col("vol")).alias("delta"), F.count(F.lit(1)).alias("n")).select("contract", F.col("w.start").alias("start_at"), "o", "h", "l", "c", "v", "delta", "n")


def stream_activity(ticks: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of activity of each contract: prints no further apart than ``gap``."""
    return ticks.withWatermark("ts", late).groupBy("contract", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("vol").alias("v")).select("contract", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n", "v")
