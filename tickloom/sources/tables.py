"""Parquet tables and the canonical spellings of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: .NET ticks (100 ns since 0001-01-01) of the Unix epoch, and ticks in a second.
NET_EPOCH = 621_355_968_000_000_000
NET_SECOND = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract_key(col: str | Column) -> Column:
    """Contract as in ``NVX 03-26``: upper case, one blank, trimmed; ``_`` is a
    blank. Null stays null, a blank name becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.upper(F.trim(F.regexp_replace(c, r"[_\s]+", " "))), F.lit(""))


def account_key(col: str | Column) -> Column:
    """Account in upper case, trimmed; blank becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def micros(col: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp (session in UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def net_ticks(col: str | Column) -> Column:
    """.NET ticks of a wall-clock timestamp."""
    return micros(col) * F.lit(10) + F.lit(NET_EPOCH)


def iso_micros(us: Column) -> Column:
    """``2026-03-02T09:35:00.000000`` from microseconds since 1970."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def merged_trades(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per ``trade_id`` from the recorded states of each trade.

    Every column takes the value of the smallest ``row_id`` that has one, so a
    null in one state is filled from another (also NaN in a double). Accounts
    and instruments are brought to their canonical spelling first. Rows without
    a trade_id belong to no trade and are left out.
    A plain aggregation: partial on the map side, so a trade that repeats in a
    third of all rows costs one buffer per task.
    """
    rows = rows.where(F.col("trade_id").isNotNull())
    kinds = dict(rows.dtypes)
    aggs = []
    for name in columns:
        value = {"account": account_key("account"), "instrument": contract_key("instrument")}.get(name, F.col(name))
        if kinds[name] in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        first = F.when(value.isNotNull(), F.struct(F.col("row_id").alias("o"), value.alias("v")))
        aggs.append(F.min(first)["v"].alias(name))
    return rows.groupBy("trade_id").agg(*aggs)
