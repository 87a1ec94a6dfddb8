"""Rolling and recursive functions over numbered bars of each contract."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.fold import ordered_fold


def series(*more: str) -> WindowSpec:
    return Window.partitionBy("contract", *more).orderBy("bar_no")


def trailing(fn: Column, n: int) -> Column:
    """``fn`` over the last n bars; null for the first n - 1 of the contract."""
    return F.when(F.col("bar_no") >= n - 1, fn.over(series().rowsBetween(-(n - 1), 0)))


def sma(col: str, n: int) -> Column:
    return trailing(F.sum(col), n) / F.lit(n)


def true_range() -> Column:
    """Range with the prior close; high less low on the first bar of a day."""
    prior = F.lag("c").over(series("cal_day"))
    return F.when(prior.isNull(), F.col("h") - F.col("l")).otherwise(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prior), F.abs(F.col("l") - prior)))


def atr(bars: DataFrame, n: int) -> DataFrame:
    """Adds tr and atr, the mean true range of the last n bars."""
    return bars.withColumn("tr", true_range()).withColumn("atr", trailing(F.sum("tr"), n) / F.lit(n))


def atr_wilder(bars: DataFrame, n: int) -> DataFrame:
    """(contract, bar_no, atr): mean of all ranges up to n bars, then smoothed by 1/n."""

    def start() -> list[float]:
        return [0.0, 0.0]

    def step(state: list[float], row: object) -> Iterator[tuple]:
        state[0] += 1
        state[1] += (row.tr - state[1]) / min(state[0], n)
        yield row.contract, row.bar_no, state[1]

    first = F.lag("c").over(series())
    tr = F.when(first.isNull(), F.col("h") - F.col("l")).otherwise(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - first), F.abs(F.col("l") - first)))
    rows = bars.select("contract", "bar_no", tr.cast("double").alias("tr"))
    return ordered_fold(rows, ["contract"], ["bar_no"], start, step, "contract string, bar_no long, atr double")


def session_vwap(bars: DataFrame) -> DataFrame:
    """Adds bar_of_day and vwap (in ticks), running from the first bar of each day."""
    w = series("cal_day").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("bar_of_day", (F.row_number().over(series("cal_day")) - 1).cast("long")).withColumn("vwap", F.sum("pv").over(w) / F.greatest(F.sum("v").over(w), F.lit(1)))


def last_bar_of_day(bars: DataFrame) -> DataFrame:
    return bars.withColumn("last_bar", F.max("bar_no").over(Window.partitionBy("contract", "cal_day")))
