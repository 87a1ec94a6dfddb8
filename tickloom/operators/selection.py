"""Filters, dimension joins and gates on trades, executions and instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import account_key, contract_key


def futures(instruments: DataFrame) -> DataFrame:
    """Futures of the instrument master whose point value and tick size are known."""
    return instruments.where("instrument_type = 0 and point_value <> 0 and tick_size <> 0").select("root", "full_name", "point_value", "tick_size")


def with_instrument(rows: DataFrame, instruments: DataFrame, contract: str) -> DataFrame:
    """Rows with the futures columns of their contract's root, by its first word; null where
    the master has none. A root listed twice counts once, with its smallest values."""
    dim = futures(instruments).groupBy(F.upper(F.trim("root")).alias("_root")).agg(F.min("full_name").alias("full_name"), F.min("point_value").alias("point_value"), F.min("tick_size").alias("tick_size"))
    return rows.join(dim, F.split(contract_key(contract), " ")[0] == F.col("_root"), "left").drop("_root")


def of_account(trades: DataFrame, part: str | None = None, direction: int | None = None) -> DataFrame:
    """Trades whose account's name holds ``part`` and of one direction, where given."""
    out = trades if part is None else trades.where(F.col("account").cast("string").contains(part))
    return out if direction is None else out.where(F.col("direction") == direction)


def strategy_groups(trades: DataFrame, excluded: tuple[str, ...] = ("AtmStrategy",)) -> DataFrame:
    """(strategy_id, strategy, account, is_replay, n) of the trades that a strategy made;
    those of order templates and of no strategy are left out."""
    rows = trades.where(F.col("strategy_id").isNotNull() & (F.col("strategy_id") != "") & F.col("strategy").isNotNull() & ~F.col("strategy").isin(*excluded))
    return rows.groupBy("strategy_id", "strategy", account_key("account").alias("account"), "is_replay").agg(F.count(F.lit(1)).alias("n"))


def sample_gate(daily: DataFrame, least: int = 10, enough: int = 60) -> DataFrame:
    """(account, sample, withheld, meaningful): the size of an account's pool of days is the
    smaller of its days and of its different daily results (account, d, pnl_c)."""
    days = daily.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pnl_c").alias("k"))
    size = F.least("n", "k")
    return days.select("account", size.alias("sample"), (size < least).alias("withheld"), (size >= enough).alias("meaningful"))


def with_orders(executions: DataFrame, orders: DataFrame, key: str = "order_id") -> DataFrame:
    """Executions with the columns of their order; those of no order are left out."""
    return executions.join(orders, key)


def contracts(rows: DataFrame, contract: str = "contract") -> DataFrame:
    """The different contracts, each in its canonical spelling."""
    return rows.select(contract_key(contract).alias("contract")).where("contract is not null").distinct()


def catalog(rows: DataFrame, contract: str = "contract", stitched: str = "ALL") -> DataFrame:
    """(place, contract): what can be analysed, the stitched series first where there is
    one, then by name. One row per contract."""
    from pyspark.sql import Window
    w = Window.orderBy((F.col("contract") != stitched), "contract")
    return contracts(rows, contract).select(F.row_number().over(w).cast("long").alias("place"), "contract")


def first_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order: the feature of a report, by a top-n per task."""
    return rows.orderBy(*order).limit(n)
