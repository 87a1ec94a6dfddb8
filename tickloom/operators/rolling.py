"""Rolling totals over trailing periods (problem 5).

Records are summed to one row per entity and date on the map side. Each entity's
calendar is then range-joined to its daily totals: both sides carry a coarse
date bucket as wide as the longest period, so a date meets only the totals of
its own and the previous bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import merged_trades


def trailing_totals(daily: DataFrame, entity: str, day: str, value: str, periods: tuple[int, ...] = (7, 30), tail: int | None = None) -> DataFrame:
    """Totals and averages over trailing calendar periods, active or not.

    ``daily``: any number of rows per (entity, day) with an integral value; they
    are added up first. The calendar of an entity runs from its first date to
    ``tail`` dates after its last (default: longest period - 1, after which all
    totals are zero). Returns entity, day, and for each period n: total_n (0 if
    nothing happened) and avg_n = total_n / n.

    Rows with null entity, day or value are left out; ties and repeats add up;
    an empty input gives no rows; other columns are ignored.
    """
    longest = max(periods)
    tail = longest - 1 if tail is None else tail
    rows = daily.select(F.col(entity).alias("e"), F.col(day).cast("date").alias("d"), F.col(value).cast("long").alias("v"))
    rows = rows.where("e is not null and d is not null and v is not null")
    totals = rows.groupBy("e", "d").agg(F.sum("v").alias("v")).withColumn("n", F.unix_date("d")).select("e", "n", "v")
    bounds = totals.groupBy("e").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    calendar = bounds.select("e", F.explode(F.sequence(F.col("lo"), F.col("hi") + F.lit(tail))).alias("day_no"))
    bucket = F.floor(F.col("day_no") / longest).cast("long")
    probes = calendar.withColumn("b", F.explode(F.array(bucket, bucket - 1)))
    held = totals.select(F.col("e").alias("te"), F.floor(F.col("n") / longest).cast("long").alias("tb"), "n", "v")
    near = (F.col("e") == F.col("te")) & (F.col("b") == F.col("tb")) & (F.col("n") <= F.col("day_no")) & (F.col("n") > F.col("day_no") - longest)
    joined = probes.join(held, near, "left")
    sums = [F.coalesce(F.sum(F.when(F.col("n") > F.col("day_no") - p, F.col("v"))), F.lit(0)).alias(f"total_{p}") for p in periods]
    out = joined.groupBy("e", "day_no").agg(*sums)
    return out.select(
        F.col("e").alias(entity), F.date_from_unix_date(F.col("day_no")).alias(day),
        *[c for p in periods for c in (F.col(f"total_{p}"), (F.col(f"total_{p}") / p).alias(f"avg_{p}"))],
    )


def account_pnl_days(trades: DataFrame) -> DataFrame:
    """Pnl in whole cents of each trade that has an exit and a pnl, on its exit date."""
    merged = merged_trades(trades, "account", "exit_time", "pnl")
    return merged.where("exit_time is not null and pnl is not null").select(
        "account", F.to_date("exit_time").alias("trade_day"), F.round(F.col("pnl") * 100).cast("long").alias("cents")
    )


def account_rolling(trades: DataFrame) -> DataFrame:
    """7- and 30-date totals and averages of each account in cents."""
    return trailing_totals(account_pnl_days(trades), "account", "trade_day", "cents")
