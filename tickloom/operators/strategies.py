"""Signal generators: candidate entries as DataFrames.

Prices are whole ticks. Every function returns contract, cal_day, entry_seq, dir,
stop, target and, where the setup has them, limit_px and be_px. First hits are an
equi-join on (contract, cal_day, bar) with a minimum, so a tick meets only the
candidates that may still enter on it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fold import ordered_fold
from ..sources.mappings import div
from .bars import opening_range, sweep_clusters
from .indicators import atr, last_bar_of_day, series, session_vwap, trailing

COLUMNS = ("contract", "cal_day", "entry_seq", "dir", "stop", "target")


def bracket(df: DataFrame, ref: Column, stop: int, rr: float) -> DataFrame:
    return df.withColumn("stop", ref - F.col("dir") * stop).withColumn("target", (ref + F.col("dir") * F.lit(stop * rr)).cast("double"))


def next_bar(bars: DataFrame) -> DataFrame:
    """Adds the next bar's first tick and open, null where the day ends."""
    same = F.lead("cal_day").over(series()) == F.col("cal_day")
    return bars.withColumn("next_seq", F.when(same, F.lead("start_seq").over(series()))).withColumn("next_o", F.when(same, F.lead("o").over(series())))


def ma_cross(bars: DataFrame, fast: int = 20, slow: int = 60, stop_ticks: int = 40, rr: float = 2.0) -> DataFrame:
    """Crossing of two moving averages; market entry on the next bar of the day."""
    up = trailing(F.sum("c"), fast) * slow > trailing(F.sum("c"), slow) * fast
    rows = next_bar(bars.withColumn("up", up)).withColumn("was", F.lag("up").over(series()))
    rows = rows.where(f"bar_no >= {slow} and up != was and next_seq is not null")
    rows = rows.withColumn("entry_seq", F.col("next_seq")).withColumn("dir", F.when(F.col("up"), 1).otherwise(-1))
    return bracket(rows, F.col("next_o"), stop_ticks, rr).select(*COLUMNS)


def ma_cross_grid(bars: DataFrame, combos: DataFrame) -> DataFrame:
    """``ma_cross`` for every combination at once: candidates with combo_no.

    combos: combo_no, fast, slow, stop_ticks, rr; a small table. The averages of each
    different length are made once, out of running sums joined ``length`` bars apart;
    combinations then are a column of the bars, not plans of their own.
    """
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    run = bars.select("contract", "bar_no", F.sum("c").over(w).alias("s"))
    lengths = combos.select(F.explode(F.array(F.col("fast").cast("long"), F.col("slow").cast("long"))).alias("n")).distinct()
    early = run.select("contract", F.col("bar_no").alias("b"), F.col("s").alias("p"))
    sums = run.join(lengths, F.col("bar_no") >= F.col("n") - 1).withColumn("b", F.col("bar_no") - F.col("n")).join(early, ["contract", "b"], "left")
    sums = sums.select("contract", "bar_no", "n", (F.col("s") - F.coalesce("p", F.lit(0))).alias("t"))
    fast = combos.join(sums, F.col("fast") == F.col("n")).select("combo_no", "fast", "slow", "stop_ticks", "rr", "contract", "bar_no", F.col("t").alias("tf"))
    slow = sums.select(F.col("contract"), F.col("bar_no"), F.col("n").cast("double").alias("slow"), F.col("t").alias("ts"))
    both = fast.join(slow, ["contract", "bar_no", "slow"]).withColumn("up", F.col("tf") * F.col("slow") > F.col("ts") * F.col("fast"))
    both = both.withColumn("was", F.lag("up").over(Window.partitionBy("combo_no", "contract").orderBy("bar_no")))
    turned = both.where("bar_no >= slow and up != was")
    rows = turned.join(next_bar(bars).where("next_seq is not null").select("contract", "cal_day", "bar_no", "next_seq", "next_o"), ["contract", "bar_no"])
    d = F.when(F.col("up"), 1).otherwise(-1)
    return rows.select("combo_no", "contract", "cal_day", F.col("next_seq").alias("entry_seq"), d.alias("dir"), (F.col("next_o") - d * F.col("stop_ticks")).alias("stop"), (F.col("next_o") + d * F.col("stop_ticks") * F.col("rr")).cast("double").alias("target"))


def orb(ticks: DataFrame, range_min: int = 15, stop_ticks: int = 40, rr: float = 2.0, one_per_day: bool = True) -> DataFrame:
    """Break of the opening range by the tape's clock; independent of any bar size."""
    after = ticks.where(F.col("sod") >= 34_200 + range_min * 60)
    rows = after.join(opening_range(ticks, range_min), ["contract", "cal_day"])
    rows = rows.withColumn("state", F.when(F.col("px_ticks") > F.col("hi"), 1).when(F.col("px_ticks") < F.col("lo"), -1).otherwise(0))
    w = Window.partitionBy("contract", "cal_day").orderBy("seq")
    rows = rows.withColumn("was", F.lag("state").over(w)).where("state != 0 and (was is null or was = 0)")
    if one_per_day:
        rows = rows.withColumn("no", F.row_number().over(w)).where("no = 1")
    rows = rows.withColumn("entry_seq", F.col("seq")).withColumn("dir", F.col("state"))
    return bracket(rows, F.when(F.col("dir") > 0, F.col("hi")).otherwise(F.col("lo")), stop_ticks, rr).select(*COLUMNS)


def sweep_follow(ticks: DataFrame, min_volume: int = 150, cluster_us: int = 150_000, stop_ticks: int = 40, rr: float = 2.0) -> DataFrame:
    """Last print of a large one-sided cluster, in its direction."""
    rows = sweep_clusters(ticks, cluster_us).where(F.col("volume") >= min_volume)
    at = ticks.select("contract", "cal_day", F.col("seq").alias("last_seq"), "px_ticks")
    rows = rows.join(at, ["contract", "cal_day", "last_seq"]).withColumn("entry_seq", F.col("last_seq")).withColumn("dir", F.col("side"))
    return bracket(rows, F.col("px_ticks"), stop_ticks, rr).select(*COLUMNS)


def tick_bars(ticks: DataFrame, bars: DataFrame, period: int) -> DataFrame:
    """Ticks with the number of the bar that holds them."""
    return ticks.withColumn("slot", div("sod", period)).join(bars.select("contract", "cal_day", "slot", "bar_no"), ["contract", "cal_day", "slot"])


def fvg(ticks: DataFrame, bars: DataFrame, period: int, min_ticks: int = 8, expiry: int = 12, stop_ticks: int = 40, rr: float = 2.0, one_per_day: bool = False) -> DataFrame:
    """Limit entry at the near edge of a three-bar gap, until it expires or the day ends;
    ``one_per_day`` keeps each day's first gap that is entered."""
    rows = last_bar_of_day(bars).withColumn("h2", F.lag("h", 2).over(series())).withColumn("l2", F.lag("l", 2).over(series()))
    bull, bear = F.col("l") - F.col("h2") >= min_ticks, F.col("l2") - F.col("h") >= min_ticks
    rows = rows.where(bull | bear).select("contract", "cal_day", F.col("bar_no").alias("gap_bar"), F.when(bull, 1).otherwise(-1).alias("dir"), F.when(bull, F.col("l")).otherwise(F.col("h")).alias("limit_px"), F.least(F.col("bar_no") + expiry, F.col("last_bar")).alias("until"))
    # Each gap is offered to the bars in which it lives: an equi-join, not a range join.
    rows = rows.where("gap_bar < until").withColumn("bar_no", F.explode(F.sequence(F.col("gap_bar") + 1, F.col("until"))))
    hits = tick_bars(ticks, bars, period).join(rows, ["contract", "cal_day", "bar_no"]).where("dir * (px_ticks - limit_px) <= 0")
    out = hits.groupBy("contract", "cal_day", "gap_bar", "dir", "limit_px").agg(F.min("seq").alias("entry_seq"))
    if one_per_day:
        out = out.groupBy("contract", "cal_day").agg(F.min(F.struct("gap_bar", "dir", "limit_px", "entry_seq")).alias("x")).select("contract", "cal_day", "x.*")
    return bracket(out, F.col("limit_px"), stop_ticks, rr).select(*COLUMNS, "limit_px", "gap_bar")


def vwap_revert(bars: DataFrame, stretch_ticks: int = 60, min_bar: int = 6, stop_ticks: int = 40, rr: float = 1.0) -> DataFrame:
    """Fades a close far from the session's volume-weighted price."""
    far = F.col("c") - F.col("vwap")
    rows = next_bar(session_vwap(bars)).where((F.abs(far) >= stretch_ticks) & (F.col("bar_of_day") >= min_bar) & F.col("next_seq").isNotNull())
    rows = rows.withColumn("entry_seq", F.col("next_seq")).withColumn("dir", F.when(far > 0, -1).otherwise(1))
    return bracket(rows, F.col("next_o"), stop_ticks, rr).select(*COLUMNS)


def range_break(ticks: DataFrame, bars: DataFrame, period: int, lookback: int = 10, min_range: int = 30, max_range: int = 140, atr_period: int = 14, atr_stop: float = 1.0, atr_target: float = 2.0, max_stop: float = 160.0, be_pct: float = 50.0, session_start: int = 570, last_entry: int = 900, one_per_day: bool = False) -> DataFrame:
    """Break out of a narrow range inside one session; the bar after the range only.

    Candidates and their first hits are joins; which of them fire is a fold over
    the few armed bars, since a breakout bar is skipped as a range of its own.
    """
    w = series()
    rows = atr(bars, atr_period).withColumn("top", trailing(F.max("h"), lookback)).withColumn("bot", trailing(F.min("l"), lookback))
    rows = rows.withColumn("first_day", F.lag("cal_day", lookback - 1).over(w)).withColumn("next_day", F.lead("cal_day").over(w))
    armed = rows.where("first_day = cal_day and next_day = cal_day and atr is not null").where((F.col("top") - F.col("bot")).between(min_range, max_range))
    armed = armed.where(F.col("atr") * atr_stop <= max_stop).select("contract", "cal_day", F.col("bar_no").alias("arm_bar"), (F.col("bar_no") + 1).alias("bar_no"), "top", "bot", "atr")
    hits = tick_bars(ticks, bars, period).join(armed, ["contract", "cal_day", "bar_no"]).where("px_ticks > top or px_ticks < bot")
    first = hits.groupBy("contract", "cal_day", "arm_bar", "top", "atr").agg(F.min(F.struct("seq", "px_ticks", "sod")).alias("x"))
    first = first.select("contract", "cal_day", "arm_bar", "atr", F.col("x.seq").alias("seq"), F.col("x.px_ticks").alias("px"), F.when(F.col("x.px_ticks") > F.col("top"), 1).otherwise(-1).alias("dir"), F.col("x.sod").alias("sod"))
    first = first.where((F.col("sod") >= session_start * 60) & (F.col("sod") < last_entry * 60))

    def step(state: dict, row: object) -> Iterator[tuple]:
        if row.arm_bar < state["free"] or (one_per_day and row.cal_day == state["day"]):
            return
        state["free"], state["day"] = row.arm_bar + 2, row.cal_day
        reward = atr_target * row.atr
        yield row.contract, row.cal_day, row.seq, row.dir, row.px - row.dir * atr_stop * row.atr, row.px + row.dir * reward, row.px + row.dir * be_pct / 100 * reward

    return ordered_fold(first, ["contract"], ["arm_bar"], lambda: {"free": -1, "day": None}, step, "contract string, cal_day date, entry_seq long, dir int, stop double, target double, be_px double")
