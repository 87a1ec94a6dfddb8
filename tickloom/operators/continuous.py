"""Continuous series out of overlapping contracts.

Daily volumes choose the front contract, the median difference over common seconds
measures each roll, and earlier prices are shifted by the sum of all later rolls.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fold import ordered_fold
from ..sources.mappings import div


def month_key(contract: Column | str) -> Column:
    """Year and month of a contract such as ``NVX 12-25`` as 2512, so that contracts of
    different years sort by expiry; null for a name without a month."""
    c = F.col(contract) if isinstance(contract, str) else contract
    return F.nullif(F.regexp_extract(c, r"\s(\d\d)-(\d\d)$", 2), F.lit("")).cast("int") * 100 + F.regexp_extract(c, r"\s(\d\d)-(\d\d)$", 1).cast("int")


def front_contracts(volumes: DataFrame) -> DataFrame:
    """(cal_day, contract): each day the contract of most volume among those that expire no
    sooner than the current one, so a roll is not taken back; a day on which only sooner
    ones trade has the most traded of them. Equal volumes go to the sooner expiry.
    Contracts without a month in their name expire before all others, in order of name.
    The fold runs over days, of which there are as many as the calendar has."""
    item = F.struct(F.coalesce(month_key("contract"), F.lit(-1)).alias("month"), "contract", "volume")
    days = volumes.groupBy("cal_day").agg(F.sort_array(F.collect_list(item)).alias("held")).withColumn("all", F.lit(1))

    def step(state: dict, row: object) -> Iterator[tuple]:
        held = [x if isinstance(x, dict) else x.asDict() for x in row.held]
        expiry = lambda x: (x["month"], x["contract"] if x["month"] < 0 else "")
        ahead = [x for x in held if state["now"] is None or expiry(x) >= state["now"]]
        best = max(ahead or held, key=lambda x: x["volume"])  # the first of equals
        state["now"] = expiry(best)
        yield row.cal_day, best["contract"]

    return ordered_fold(days, ["all"], ["cal_day"], lambda: {"now": None}, step, "cal_day date, contract string")


def rolls(front: DataFrame) -> DataFrame:
    """(cal_day, from_contract, to_contract) of each change of the front contract."""
    w = Window.orderBy("cal_day")  # one row per day
    return front.withColumn("p", F.lag("contract").over(w)).where("p != contract").select("cal_day", F.col("p").alias("from_contract"), F.col("contract").alias("to_contract"))


def roll_spread(ticks: DataFrame, front: DataFrame, cell_us: int, least: int) -> DataFrame:
    """(cal_day, from_contract, to_contract, n, spread) of each roll: the median difference
    of the new to the old contract's last price over the cells of the roll day that both
    have, null below ``least`` of them. Only the two contracts of a roll, on its day, are
    looked at: the rolls, one row each, are joined to the ticks before anything is grouped."""
    r = rolls(front)
    sides = r.select("cal_day", F.explode(F.array(F.struct(F.col("from_contract").alias("contract"), F.lit(False).alias("new")), F.struct(F.col("to_contract").alias("contract"), F.lit(True).alias("new")))).alias("x")).select("cal_day", "x.contract", "x.new")
    cells = ticks.join(sides, ["cal_day", "contract"]).groupBy("cal_day", div("us", cell_us).alias("cell")).agg(F.max_by("px_ticks", F.when(F.col("new"), F.col("seq"))).alias("b"), F.max_by("px_ticks", F.when(~F.col("new"), F.col("seq"))).alias("a"))
    both = cells.where("a is not null and b is not null").groupBy("cal_day").agg(F.count(F.lit(1)).alias("n"), F.percentile((F.col("b") - F.col("a")).cast("double"), F.lit(0.5)).alias("s"))
    out = r.join(both, "cal_day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("cal_day", "from_contract", "to_contract", "n", F.when(F.col("n") >= least, F.col("s")).alias("spread"))


def back_adjusted(ticks: DataFrame, front: DataFrame, spreads: DataFrame) -> DataFrame:
    """Front contract's ticks with prices shifted by all later rolls: px_adj, offset.

    front has one row per day and spreads one per roll; the offsets of the days are
    joined by the day, so the ticks are not shuffled by a range join. A roll that was not
    measured shifts nothing (``violations`` names it).
    """
    r = spreads.select(F.col("cal_day").alias("roll_day"), F.coalesce("spread", F.lit(0.0)).alias("spread"))
    later = front.join(r, F.col("roll_day") > F.col("cal_day"), "left").groupBy("cal_day", "contract").agg(F.coalesce(F.sum("spread"), F.lit(0.0)).alias("offset"))
    return ticks.join(later, ["cal_day", "contract"]).withColumn("px_adj", F.col("px_ticks") + F.col("offset"))


def continuous(ticks: DataFrame, volumes: DataFrame, cell_us: int = 1_000_000, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, front, spreads): the stitched series out of daily volumes and ticks."""
    front = front_contracts(volumes)
    spreads = roll_spread(ticks, front, cell_us, least)
    return back_adjusted(ticks, front, spreads), front, spreads


def fills_to_raw(fills: DataFrame, front: DataFrame, spreads: DataFrame, day: str, *prices: str) -> DataFrame:
    """Fills on the stitched series with their prices as they were traded: the offset of the
    fill's day is taken off each of ``prices``, and the contract of the day is named."""
    r = spreads.select(F.col("cal_day").alias("roll_day"), F.coalesce("spread", F.lit(0.0)).alias("spread"))
    shift = front.join(r, F.col("roll_day") > F.col("cal_day"), "left").groupBy(F.col("cal_day").alias("_d"), F.col("contract").alias("raw_contract")).agg(F.coalesce(F.sum("spread"), F.lit(0.0)).alias("_o"))
    return fills.join(shift, F.col(day) == F.col("_d")).withColumns({p: F.col(p) - F.col("_o") for p in prices}).drop("_d", "_o")


def to_raw(prices: DataFrame, offsets: DataFrame) -> DataFrame:
    """Raw price of adjusted ones by the offset of their day."""
    return prices.join(offsets.select("cal_day", "offset").distinct(), "cal_day").withColumn("px_raw", F.col("px_adj") - F.col("offset"))


def audit(series: DataFrame, step_ticks: float) -> DataFrame:
    """Violations of a stitched series per day: unsorted times and intraday steps that
    are too wide."""
    w = Window.partitionBy("cal_day").orderBy("seq")
    rows = series.withColumn("late", (F.col("us") < F.lag("us").over(w)).cast("int")).withColumn("wide", (F.abs(F.col("px_adj") - F.lag("px_adj").over(w)) >= step_ticks).cast("int"))
    return rows.groupBy("cal_day").agg(F.coalesce(F.sum("late"), F.lit(0)).alias("unsorted"), F.coalesce(F.sum("wide"), F.lit(0)).alias("wide_steps"), F.count(F.lit(1)).alias("n"))


def session_gaps(series: DataFrame) -> DataFrame:
    """(cal_day, gap): step from the last price of a weekday to the first of the next one,
    where the two are adjacent dates. One row per day; weekends and holidays give none."""
    days = series.groupBy("cal_day").agg(F.min_by("px_adj", "seq").alias("first_px"), F.max_by("px_adj", "seq").alias("last_px"))
    before = days.select(F.date_add("cal_day", 1).alias("cal_day"), F.col("last_px").alias("p"))
    # weekday: 0 is Monday. Into Tuesday to Friday, so that both days are weekdays.
    return days.join(before, "cal_day").where(F.weekday("cal_day").between(1, 4)).select("cal_day", F.abs(F.col("first_px") - F.col("p")).alias("gap"))


def violations(series: DataFrame, spreads: DataFrame, step_ticks: float, gap_ticks: float, band: tuple[float, float]) -> DataFrame:
    """(cal_day, problem, n, size): all that breaks a stitched series; none if it is sound.

    unsorted: times that go back; wide step: intraday steps of step_ticks or more;
    session gap: more than gap_ticks between consecutive weekdays, as a session on
    the wrong contract shows; no spread, spread: a roll that was not measured, or
    outside the band in either end. n counts them, size is the gap or the spread.
    """
    none = F.lit(None).cast("double")
    daily = audit(series, step_ticks)
    out = daily.where("unsorted > 0").select("cal_day", F.lit("unsorted").alias("problem"), F.col("unsorted").cast("long").alias("n"), none.alias("size"))
    out = out.unionByName(daily.where("wide_steps > 0").select("cal_day", F.lit("wide step").alias("problem"), F.col("wide_steps").cast("long").alias("n"), none.alias("size")))
    one = F.lit(1).cast("long").alias("n")
    out = out.unionByName(session_gaps(series).where(F.col("gap") > gap_ticks).select("cal_day", F.lit("session gap").alias("problem"), one, F.col("gap").cast("double").alias("size")))
    r = spreads.withColumn("problem", F.when(F.col("spread").isNull(), "no spread").when(~F.col("spread").between(*band), "spread")).where("problem is not null")
    return out.unionByName(r.select("cal_day", "problem", one, F.col("spread").cast("double").alias("size")))


def changed_inputs(old: DataFrame, new: DataFrame, key: list[str], print_: str) -> DataFrame:
    """(key, status): inputs that are new, changed or gone against the last build, by
    comparing one fingerprint per key."""
    a = old.select(*key, F.col(print_).alias("_a"))
    b = new.select(*key, F.col(print_).alias("_b"))
    both = a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*key, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").otherwise("changed").alias("status"))
