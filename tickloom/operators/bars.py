"""Time bars, tick features and tick-quality statistics.

All of it is aggregation or windows keyed by contract and day, so no task holds
more than one contract-day; series of bars are windows over bars, of which a
contract has at most one per slot of its calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.mappings import div

#: Regular trading hours in seconds of the day, end exclusive.
RTH = (34_200, 57_600)


def parse_period(text: str | int) -> int:
    """Seconds of a bar: '30s', '5m', '1h' or minutes as a number; 1 to 86,400."""
    s = str(text).strip().lower()
    unit = {"s": 1, "m": 60, "h": 3600}.get(s[-1:], None)
    seconds = int(s[:-1]) * unit if unit else int(s) * 60
    if not 1 <= seconds <= 86_400:
        raise ValueError(f"no bar size: {text}")
    return seconds


def slice_range(ticks: DataFrame, first: str | None = None, last: str | None = None, rth: bool = True) -> DataFrame:
    """Ticks of the dates from first to last (both inclusive), in regular hours if ``rth``."""
    out = ticks
    if first:
        out = out.where(F.col("cal_day") >= F.lit(first).cast("date"))
    if last:
        out = out.where(F.col("cal_day") <= F.lit(last).cast("date"))
    return out.where(f"sod >= {RTH[0]} and sod < {RTH[1]}") if rth else out


def aggressor(ask_off: Column, bid_off: Column) -> Column:
    """1 if traded at the ask, else -1 if at the bid, else 0."""
    return F.when(ask_off == 0, 1).when(bid_off == 0, -1).otherwise(0)


def available_range(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("contract").agg(F.min("cal_day").alias("first_day"), F.max("cal_day").alias("last_day"), F.count_distinct("cal_day").alias("sessions"), F.count(F.lit(1)).alias("n_ticks"))


def build_bars(ticks: DataFrame, period: int) -> DataFrame:
    """One row per non-empty slot: o, h, l, c, v, delta, n and [start_seq, end_seq)."""
    return ticks.groupBy("contract", "cal_day", div("sod", period).alias("slot")).agg(
        F.min_by("px_ticks", "seq").alias("o"), F.max("px_ticks").alias("h"), F.min("px_ticks").alias("l"), F.max_by("px_ticks", "seq").alias("c"),
        F.sum("vol").alias("v"), F.sum(F.col("side") * F.col("vol")).alias("delta"), F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("start_seq"), (F.max("seq") + 1).alias("end_seq"), F.sum(F.col("px_ticks") * F.col("vol")).alias("pv"))


def numbered(bars: DataFrame) -> DataFrame:
    """Adds bar_no, 0-based in each contract."""
    w = Window.partitionBy("contract").orderBy("cal_day", "slot")
    return bars.withColumn("bar_no", (F.row_number().over(w) - 1).cast("long"))


def minute_features(ticks: DataFrame, big: int = 10) -> DataFrame:
    """Minute rows: prices, volume by aggressor, large volume by aggressor, spread."""
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("vol"))), F.lit(0))
    buy, sell, large = F.col("side") == 1, F.col("side") == -1, F.col("vol") >= big
    return ticks.groupBy("contract", "cal_day", div("sod", 60).alias("minute")).agg(
        F.min_by("px_ticks", "seq").alias("o"), F.max("px_ticks").alias("h"), F.min("px_ticks").alias("l"), F.max_by("px_ticks", "seq").alias("c"),
        F.sum("vol").alias("volume"), part(buy).alias("buy"), part(sell).alias("sell"), part(buy & large).alias("big_buy"), part(sell & large).alias("big_sell"),
        F.count(F.lit(1)).alias("n_trades"), F.sum(F.pmod("k", F.lit(7))).alias("spread_sum"), F.round(F.avg(F.pmod("k", F.lit(7))), 6).alias("avg_spread"))


def sweep_clusters(ticks: DataFrame, gap_us: int) -> DataFrame:
    """Runs of prints of one known aggressor side with no gap beyond ``gap_us``."""
    w = Window.partitionBy("contract", "cal_day").orderBy("seq")
    known = ticks.where("side != 0").withColumn("new", ((F.lag("side").over(w) != F.col("side")) | (F.col("us") - F.lag("us").over(w) > gap_us) | F.lag("seq").over(w).isNull()).cast("int"))
    known = known.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return known.groupBy("contract", "cal_day", "cluster").agg(F.max_by("side", "seq").alias("side"), F.sum("vol").alias("volume"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))


def daily_volume(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("contract", "cal_day").agg(F.sum("vol").alias("volume"))


def tick_gaps(ticks: DataFrame) -> DataFrame:
    """Each tick with the time and price step from the one before it on its day."""
    w = Window.partitionBy("contract", "cal_day").orderBy("seq")
    return ticks.select("contract", "cal_day", "seq", (F.col("us") - F.lag("us").over(w)).alias("gap_us"), (F.col("px_ticks") - F.lag("px_ticks").over(w)).alias("step"))


def tape_holes(ticks: DataFrame, limit_us: int) -> DataFrame:
    """Holes per day: gaps longer than ``limit_us``, and the longest."""
    return tick_gaps(ticks).where(F.col("gap_us") > limit_us).groupBy("contract", "cal_day").agg(F.count(F.lit(1)).alias("holes"), F.max("gap_us").alias("longest_us"))


def coverage_holes(ticks: DataFrame, limit_days: int = 3) -> DataFrame:
    """Consecutive sessions more than ``limit_days`` apart."""
    days = ticks.select("contract", "cal_day").distinct()
    w = Window.partitionBy("contract").orderBy("cal_day")
    return days.withColumn("next_day", F.lead("cal_day").over(w)).withColumn("apart", F.datediff("next_day", "cal_day")).where(F.col("apart") > limit_days)


def spread_gap(ticks: DataFrame, least: int = 100, floor: int = 2) -> DataFrame:
    """Spread and price-gap distribution per contract over days with enough regular prints."""
    day = ticks.where(f"sod >= {RTH[0]} and sod < {RTH[1]}")
    w = Window.partitionBy("contract", "cal_day").orderBy("seq")
    day = day.withColumn("step", F.abs(F.col("px_ticks") - F.lag("px_ticks").over(w))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("contract", "cal_day"))).where(F.col("n") >= least)
    spread = F.pmod("k", F.lit(7)).cast("double")
    gap = F.when(F.col("step") > 0, F.col("step").cast("double"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    out = day.groupBy("contract").agg(
        p(spread, 0.5).alias("spread_p50"), p(spread, 0.9).alias("spread_p90"), F.round(F.avg(spread), 6).alias("spread_mean"), F.round(F.avg((spread > 1).cast("int")), 6).alias("spread_wide"),
        F.round(p(gap, 0.9), 6).alias("gap_p90"), F.round(F.avg(gap), 6).alias("gap_mean"))
    return out.withColumn("floor", F.bround(F.col("spread_p50") / floor, 2)).withColumn("stress", F.bround(F.greatest(F.col("spread_p90") / floor, F.col("gap_p90")), 2))


def opening_range(ticks: DataFrame, minutes: int, start: int = RTH[0]) -> DataFrame:
    """High and low of the first ``minutes`` from ``start``."""
    return ticks.where((F.col("sod") >= start) & (F.col("sod") < start + minutes * 60)).groupBy("contract", "cal_day").agg(F.max("px_ticks").alias("hi"), F.min("px_ticks").alias("lo"))
