"""Summaries of trade lists: performance columns, daily rows, streaks, pools.

Trades carry account, d (date), trade_no (order within the account), direction,
pnl_c (net), comm_c, mae_c, mfe_c and fall_c (null: path unknown) in whole cents.
Sums stay integral; ratios are rounded once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import bucketed_rank, running_sum


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def fall_bound() -> Column:
    """Deepest fall inside a trade: as measured, else its bound mfe - mae."""
    return F.coalesce("fall_c", F.col("mfe_c") - F.col("mae_c"))


def clustered_t(daily: DataFrame, least_days: int = 20) -> DataFrame:
    """t of the mean daily result per account: null below ``least_days`` or without spread."""
    out = daily.groupBy("account").agg(F.count(F.lit(1)).alias("n_days"), F.avg("pnl_c").alias("m"), F.stddev_samp("pnl_c").alias("s"))
    t = F.when((F.col("n_days") >= least_days) & (F.col("s") > 0), F.col("m") / (F.col("s") / F.sqrt("n_days")))
    return out.select("account", "n_days", _r(t).alias("t_daily"))


def daily_pnl(trades: DataFrame) -> DataFrame:
    return trades.groupBy("account", "d").agg(F.sum("pnl_c").alias("pnl_c"), F.count(F.lit(1)).alias("n"))


def run_summary(trades: DataFrame) -> DataFrame:
    """Total, win rate, mean, trades a day and daily clustered t of each account."""
    base = trades.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl_c").alias("pnl_c"), _r(F.avg((F.col("pnl_c") > 0).cast("int"))).alias("win_rate"), _r(F.avg("pnl_c")).alias("mean_c"), F.count_distinct("d").alias("days"))
    base = base.withColumn("per_day", _r(F.col("n") / F.col("days")))
    return base.join(clustered_t(daily_pnl(trades)).select("account", "t_daily"), "account")


def drawdown(trades: DataFrame, key: tuple[str, ...] = ("account",)) -> DataFrame:
    """Deepest fall of the running total of each key's trades below its peak (or zero)."""
    run = running_sum(trades, [*key], "d", "trade_no", "pnl_c")
    return run.groupBy(*key).agg(F.min(F.least(F.lit(0), F.col("run") - F.col("peak"))).alias("max_drawdown_c"))


def streaks(trades: DataFrame, key: tuple[str, ...] = ("account",)) -> DataFrame:
    """Longest runs of winning and of losing trades of each key; an even trade ends both."""
    rows = trades.select(*key, "trade_no", F.signum(F.col("pnl_c").cast("double")).cast("int").alias("k"))
    rows = bucketed_rank(rows, [*key], "trade_no", 65_536, "of_all")
    rows = bucketed_rank(rows, [*key, "k"], "trade_no", 65_536, "of_kind").withColumn("island", F.col("of_all") - F.col("of_kind"))
    runs = rows.groupBy(*key, "k", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("k") > 0, F.col("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(F.col("k") < 0, F.col("n"))), F.lit(0)).alias("max_losses"))


def _figures() -> list[Column]:
    """Aggregates of trades from which ``_merged`` and ``_ratios`` make the figures of a side."""
    g, p = F.col("pnl_c") + F.col("comm_c"), F.col("pnl_c")
    when = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    return [
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("net_c"), when(g > 0, g).alias("gross_profit_c"), when(g < 0, g).alias("gross_loss_c"), F.sum("comm_c").alias("commission_c"),
        F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.count_if(p == 0).alias("evens"), when(p > 0, p).alias("_won"), when(p < 0, p).alias("_lost"),
        F.max(p).alias("largest_win_c"), F.min(p).alias("largest_loss_c"), F.sum("mae_c").alias("_mae"), F.sum("mfe_c").alias("_mfe"), F.sum(fall_bound()).alias("_fall"), F.max(fall_bound()).alias("max_fall_c")]


#: Figures of which parts are added, or the least or the most of them is taken.
ADDED = ("n", "net_c", "gross_profit_c", "gross_loss_c", "commission_c", "wins", "losses", "evens", "_won", "_lost", "_mae", "_mfe", "_fall")
LEAST, MOST = ("largest_loss_c",), ("largest_win_c", "max_fall_c")


def _merged() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ADDED], *[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST]]


def _ratios(out: DataFrame) -> DataFrame:
    ratio = lambda a, b: _r(F.try_divide(F.col(a), F.col(b)))
    return out.withColumns({"avg_win_c": ratio("_won", "wins"), "avg_loss_c": ratio("_lost", "losses"), "avg_mae_c": ratio("_mae", "n"), "avg_mfe_c": ratio("_mfe", "n"), "avg_fall_c": ratio("_fall", "n"), "win_rate": ratio("wins", "n"),
                            "profit_factor": F.when(F.col("gross_loss_c") < 0, _r(F.col("gross_profit_c") / -F.col("gross_loss_c")))})


def _by_direction(trades: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Figures of each key's long, short and (direction 0) all trades: the trades are
    aggregated once, by direction, and the whole is made of the two rows."""
    part = trades.groupBy(*key, "direction").agg(*_figures())
    whole = part.withColumn("direction", F.explode(F.array(F.lit(0), F.col("direction").cast("int"))))
    return _ratios(whole.groupBy(*key, "direction").agg(*_merged()))


def performance(trades: DataFrame) -> DataFrame:
    """Performance by direction and in all (direction 0).

    Gross figures are split by the sign of the gross result, net ones by that of
    the net result. profit_factor is null without losses.
    """
    return _by_direction(trades, ()).drop("_won", "_lost", "_mae", "_mfe", "_fall")


def performance_columns(trades: DataFrame, order: tuple[str, ...] = ("trade_no",), width: int = 256) -> DataFrame:
    """The whole performance column of each account's long, short and (direction 0) all
    trades: with the deepest drawdown and the longest runs of the equity of those trades
    alone, trades a day (of the account's days), the ratio of average win to average loss
    (null without either), and no_losses where the profit factor is infinite. largest_win
    is null without a win, largest_loss without a loss.

    ``order`` orders an account's trades; d never falls along it. The trades are shuffled
    once, by account and ``width`` days; of each such part come its figures, its running
    total's course and its runs, and windows over the parts put them together.
    """
    side, pnl = ["account", "direction"], F.col("pnl_c")
    parts = trades.where("account is not null").withColumn("_part", F.floor(F.unix_date("d") / F.lit(width)).cast("long"))
    parts = parts.select("account", "_part", "d", *[c for c in order if c != "d"], F.col("direction").cast("int").alias("direction"), "pnl_c", "comm_c", "mae_c", "mfe_c", "fall_c").repartition("account", "_part")
    rows = parts.withColumn("direction", F.explode(F.array(F.lit(0), "direction"))).where("direction is not null")
    by = Window.partitionBy(*side, "_part").orderBy(*order)
    inner = by.rowsBetween(Window.unboundedPreceding, 0)
    won, lost = F.coalesce(pnl > 0, F.lit(False)), F.coalesce(pnl < 0, F.lit(False))
    rows = rows.withColumns({"_run": F.coalesce(F.sum("pnl_c").over(inner), F.lit(0)), "_w": F.count_if(won).over(inner), "_l": F.count_if(lost).over(inner), "_new": F.col("d").isNotNull() & ~F.col("d").eqNullSafe(F.lag("d").over(by))})
    # Of a run of wins, ``_w`` counts the wins so far and ``_w0`` those before the run; likewise of losses.
    rows = rows.withColumns({"_peak": F.max("_run").over(inner), "_w0": F.max(F.when(~won, F.col("_w"))).over(inner), "_l0": F.max(F.when(~lost, F.col("_l"))).over(inner)})
    course = [F.max("_run").alias("_top"), F.min("_run").alias("_bottom"), F.min(F.col("_run") - F.col("_peak")).alias("_dip"), F.count_if("_new").alias("_days")]
    for c, ends in (("_w", ~won), ("_l", ~lost)):
        at = F.when(ends, F.col(c))
        course += [F.min(at).alias(f"{c}_first"), F.max(at).alias(f"{c}_last"), F.max(F.col(c) - F.col(f"{c}0")).alias(f"{c}_in")]
    part = rows.groupBy(*side, "_part").agg(*_figures(), *course)

    before = Window.partitionBy(*side).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    part = part.withColumns({"_base": so_far("net_c"), "_w_base": so_far("wins"), "_l_base": so_far("losses")})
    part = part.withColumns({"_high": F.greatest(F.lit(0), F.max(F.col("_base") + F.col("_top")).over(before)), **{f"{c}_end": F.coalesce(F.max(F.col(f"{c}_base") + F.col(f"{c}_last")).over(before), F.lit(0)) for c in ("_w", "_l")}})
    longest = lambda c, n: F.max(F.greatest(F.lit(0), F.col(f"{c}_in"), F.col(f"{c}_base") + F.coalesce(F.col(f"{c}_first"), F.col(n)) - F.col(f"{c}_end")))
    out = part.groupBy(*side).agg(*_merged(), F.min(F.least(F.lit(0), F.col("_dip"), F.col("_base") + F.col("_bottom") - F.col("_high"))).alias("max_drawdown_c"), longest("_w", "wins").alias("max_wins"), longest("_l", "losses").alias("max_losses"), F.sum("_days").alias("_days"))
    out = _ratios(out).withColumn("_days", F.max(F.when(F.col("direction") == 0, F.col("_days"))).over(Window.partitionBy("account")))
    mean_won, mean_lost = F.col("_won") / F.col("wins"), F.col("_lost") / F.col("losses")
    out = out.withColumns({
        "per_day": _r(F.try_divide("n", "_days")), "win_loss_ratio": F.when((F.col("wins") > 0) & (F.col("losses") > 0), _r(F.abs(mean_won / mean_lost))), "no_losses": F.col("gross_loss_c") == 0,
        "avg_trade_c": _r(F.col("net_c") / F.col("n")), "largest_win_c": F.when(F.col("wins") > 0, F.col("largest_win_c")), "largest_loss_c": F.when(F.col("losses") > 0, F.col("largest_loss_c"))})
    return out.drop("_won", "_lost", "_mae", "_mfe", "_fall", "_days")


def daily_rows(trades: DataFrame) -> DataFrame:
    """Daily analysis of each account: totals, running total and drawdown walked by trade."""
    run = running_sum(trades, ["account"], "d", "trade_no", "pnl_c")
    return run.groupBy("account", "d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl_c").alias("net_c"), F.max_by("run", "trade_no").alias("cum_c"), F.min(F.least(F.lit(0), F.col("run") - F.col("peak"))).alias("day_drawdown_c"),
        _r(F.avg(F.col("mfe_c") - F.col("pnl_c"))).alias("avg_etd_c"), F.max(fall_bound()).alias("max_fall_c"))


def subperiods(trades: DataFrame, key: str = "account", day: str = "d", value: str = "pnl_c", parts: int = 3) -> DataFrame:
    """(key, part_1.., positive): result of contiguous blocks of each key's trading dates,
    edges rounded half to even, and how many are above zero. With fewer dates than parts
    all is in the first one. The window holds a row per date of a key."""
    days = trades.groupBy(key, day).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(key)
    days = days.withColumn("i", F.row_number().over(w.orderBy(day)) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    edge = lambda k: F.when(F.col("m") < parts, F.lit(0.0 if k == 0 else 1e18)).otherwise(F.bround(F.lit(float(k)) * F.col("m") / parts) if k < parts else F.lit(1e18))
    zero = F.lit(0).cast(dict(days.dtypes)["_v"])
    cols = [F.coalesce(F.sum(F.when((F.col("i") >= edge(k)) & (F.col("i") < edge(k + 1)), F.col("_v"))), zero).alias(f"part_{k + 1}_c") for k in range(parts)]
    out = days.groupBy(key).agg(*cols)
    return out.withColumn("positive", sum((F.col(f"part_{k + 1}_c") > 0).cast("int") for k in range(parts)))


def day_pool(trades: DataFrame) -> DataFrame:
    """Packed pool: one row per account and date with its trades in order."""
    item = F.struct(F.col("trade_no").alias("no"), "pnl_c", "mae_c", "mfe_c", fall_bound().alias("fall_c"))
    return trades.groupBy("account", "d").agg(F.sort_array(F.collect_list(item)).alias("trades"))


def histogram(values: DataFrame, column: str, bins: int = 28) -> DataFrame:
    """Equal-width bins, the last one closed."""
    lim = values.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("z"))
    b = F.least(F.floor((F.col(column) - F.col("a")) / ((F.col("z") - F.col("a")) / bins)), F.lit(bins - 1)).cast("long")
    return values.join(F.broadcast(lim)).withColumn("bin", F.when(F.col("z") > F.col("a"), b).otherwise(0)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def account_summary(trades: DataFrame, instrument: str | None = None) -> DataFrame:
    """Totals of each account, and its different instruments in order of name where named."""
    more = [F.sort_array(F.collect_set(instrument)).alias("instruments")] if instrument else []
    return trades.groupBy("account").agg(
        *more,
        F.count(F.lit(1)).alias("n"), F.count_distinct("d").alias("days"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.sum("pnl_c").alias("pnl_c"),
        _r(F.avg((F.col("pnl_c") > 0).cast("int"))).alias("win_rate"), F.sum((F.col("direction") > 0).cast("long")).alias("longs"), F.sum((F.col("direction") < 0).cast("long")).alias("shorts"), F.sum("comm_c").alias("commission_c"))
