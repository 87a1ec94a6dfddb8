"""Breaks out of a short opening candle in fixed session windows.

Each window of a session (18:00 to 18:00) has a candle; behind it a state machine
walks the ticks: a print outside after one inside opens an episode, which is
confirmed once it has held for a time and reached an extension, and ends where
the price comes back first. Candles, running bar extremes and smoothed ranges are
relational; only the machine is a fold, one window at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fold import ordered_fold
from ..sources.mappings import div
from .indicators import atr_wilder, series

DAY = 86_400
#: Start of a session in seconds of the day, and of its windows behind it.
SESSION_START = 64_800
WINDOWS = (0, 7_200, 55_800)


@dataclass(frozen=True)
class BreakRules:
    """Seconds, ticks and factors of the setup; see window_break."""

    enabled: tuple[bool, bool, bool] = (True, True, True)
    window_s: int = 3_600
    candle_s: int = 30
    hold_s: int = 30
    extension: float = 0.25
    min_range: int = 4
    atr_period: int = 14
    stop_mult: float = 2.0
    target_mult: float = 2.0
    max_stop: float = 1_200.0
    per_window: int = 1
    use_filter: bool = True
    be_share: float = 0.0


def deadlines(r: BreakRules) -> list[int]:
    """End of each window's hunt in seconds behind its start, cut at the next enabled window."""
    want = max(r.window_s, r.candle_s + 60)
    return [min([want, *[WINDOWS[j] - WINDOWS[i] for j in range(i + 1, 3) if r.enabled[j]][:1]]) for i in range(3)]


def windowed(ticks: DataFrame, r: BreakRules) -> DataFrame:
    """Ticks of the enabled windows with session, win and since (microseconds from the window's start)."""
    day_us = DAY * 1_000_000
    into = F.pmod(F.col("us") - SESSION_START * 1_000_000, F.lit(day_us))
    session = F.floor((F.col("us") - SESSION_START * 1_000_000) / day_us).cast("long")
    win = F.lit(None).cast("int")
    for i, (start, length) in enumerate(zip(WINDOWS, deadlines(r))):
        if r.enabled[i]:
            win = F.when(into.between(start * 1_000_000, (start + length) * 1_000_000), i).otherwise(win)
    starts = F.element_at(F.array(*[F.lit(s * 1_000_000) for s in WINDOWS]), F.col("win") + 1)
    return ticks.withColumn("session", session).withColumn("win", win).where("win is not null").withColumn("since", into - starts)


class Machine:
    """One window: feed ticks in order, get (seq, side) of confirmed breaks."""

    def __init__(self, r: BreakRules) -> None:
        self.r, self.taken, self.side, self.inside_seen = r, 0, 0, True
        self.since = 0
        self.reached = False

    def open(self, side: int, since: int) -> None:
        self.side, self.since, self.reached = side, since, False

    def tick(self, since: int, px: int, hi: int, lo: int, need: int) -> int:
        """Side of a break confirmed at this tick, else 0."""
        where = 1 if px > hi else -1 if px < lo else 0
        if self.side:
            back = px < hi if self.side > 0 else px > lo
            if back:
                if where == -self.side:
                    self.open(where, since)
                else:
                    self.side, self.inside_seen = 0, True
                    return 0
        elif not self.inside_seen:
            self.inside_seen = where == 0
            return 0
        elif where:
            self.open(where, since)
        else:
            return 0
        level = hi if self.side > 0 else lo
        self.reached = self.reached or need <= 0 or self.side * (px - level) >= need
        if not self.r.use_filter or (self.reached and since - self.since >= self.r.hold_s * 1_000_000):
            side, self.side, self.inside_seen = self.side, 0, False
            return side
        return 0


def forming_range(prev_close: Column, hi: Column, lo: Column) -> Column:
    """True range of a bar still forming, from its ticks so far."""
    return F.greatest(hi - lo, F.abs(hi - prev_close), F.abs(lo - prev_close))


def window_break(ticks: DataFrame, bars: DataFrame, period: int, r: BreakRules = BreakRules()) -> DataFrame:
    """Candidates: contract, cal_day, entry_seq, dir, stop, target, be_px (whole ticks,
    levels rounded half to even), session, win.

    The range that prices an entry is the smoothed range of the last closed bar with
    the forming bar folded in, built from ticks up to the entry only.
    """
    w = Window.partitionBy("contract", "cal_day", "slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    smooth = bars.join(atr_wilder(bars, r.atr_period).withColumnRenamed("bar_no", "_n").withColumnRenamed("contract", "_c"), (F.col("contract") == F.col("_c")) & (F.col("bar_no") == F.col("_n")))
    prior = smooth.withColumn("prev_atr", F.when(F.lag("bar_no").over(series()) >= r.atr_period - 1, F.lag("atr").over(series()))).withColumn("prev_c", F.lag("c").over(series())).select("contract", "cal_day", "slot", "prev_atr", "prev_c")
    rows = ticks.withColumn("slot", div("sod", period)).withColumn("run_hi", F.max("px_ticks").over(w)).withColumn("run_lo", F.min("px_ticks").over(w)).join(prior, ["contract", "cal_day", "slot"])
    rows = windowed(rows, r)
    key = ["contract", "session", "win"]
    candle = rows.where(F.col("since") < r.candle_s * 1_000_000).groupBy(*key).agg(F.max("px_ticks").alias("hi"), F.min("px_ticks").alias("lo")).where(F.col("hi") - F.col("lo") >= r.min_range)
    hunt = rows.where(F.col("since") >= r.candle_s * 1_000_000).join(candle, key)
    atr = F.col("prev_atr") + (forming_range(F.col("prev_c"), F.col("run_hi"), F.col("run_lo")) - F.col("prev_atr")) / r.atr_period
    hunt = hunt.withColumn("need", F.ceil((F.col("hi") - F.col("lo")) * r.extension)).withColumn("atr", F.when(F.col("prev_atr") > 0, atr))

    def step(m: Machine, row: object) -> Iterator[tuple]:
        if m.taken >= r.per_window:
            return
        side = m.tick(row.since, row.px_ticks, row.hi, row.lo, row.need)
        if side and row.atr is not None and row.atr > 1 and r.stop_mult * row.atr <= r.max_stop:
            m.taken += 1
            reward = r.target_mult * row.atr
            yield row.contract, row.cal_day, row.seq, side, float(round(row.px_ticks - side * r.stop_mult * row.atr)), float(round(row.px_ticks + side * reward)), float(row.px_ticks + side * r.be_share * reward), row.session, row.win

    cols = hunt.select(*key, "cal_day", "seq", "since", "px_ticks", "hi", "lo", "need", "atr")
    return ordered_fold(cols, key, ["seq"], lambda: Machine(r), step, "contract string, cal_day date, entry_seq long, dir int, stop double, target double, be_px double, session long, win int")
