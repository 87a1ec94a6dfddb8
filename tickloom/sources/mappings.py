"""The engine's inputs (ticks, trades, executions, rules) as views of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import bucketed_rank
from .tables import micros


def div(a: Column | str, b: int) -> Column:
    """Integral floor division of a non-negative bigint."""
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / F.lit(b)).cast("long")


def ticks(events: DataFrame) -> DataFrame:
    """contract, seq, us, cal_day, sod, px_ticks (0.25 points each), vol, side of ``events``."""
    day = F.to_date("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    step = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(41)) - 20
    walk = F.sum(step).over(Window.partitionBy(day).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    side = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type").isin("error", "click"), -1).otherwise(0)
    contract = F.when(F.pmod("user_id", F.lit(2)) == 0, "F1").otherwise("F2")
    return events.select(
        contract.alias("contract"), F.col("event_id").alias("seq"), micros("ts").alias("us"), day.alias("cal_day"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("sod"),
        (F.lit(80_000) + walk).cast("long").alias("px_ticks"), (1 + F.pmod(k, F.lit(20))).cast("long").alias("vol"), side.alias("side"), k.cast("long").alias("k"))


TICKS = """ticks AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'F1' ELSE 'F2' END AS contract, event_id AS seq, epoch_us(ts) AS us, CAST(ts AS DATE) AS cal_day,
    CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sod,
    CAST(80000 + SUM(CAST(round(value * 100) AS BIGINT) % 41 - 20) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS BIGINT) AS px_ticks,
    CAST(1 + CAST(regexp_extract(props, '[0-9]+') AS INT) % 20 AS BIGINT) AS vol,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type IN ('error', 'click') THEN -1 ELSE 0 END AS side,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events)"""


#: Order of the trades of an account in ``listed_trades``.
ORDER = ("d", "o_order", "o_part", "o_line")


def listed_trades(lineitem: DataFrame) -> DataFrame:
    """account, d, direction and money in whole cents of ``lineitem``, in ORDER instead of
    by a trade_no, for operators that sort the trades themselves.

    ``fall_c`` is the deepest fall inside the trade where the path is known, else null.
    """
    x = (F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(60_001)) - 30_000)
    t = lineitem.select(
        F.col("l_suppkey").alias("account"), F.to_date("l_shipdate").alias("d"),
        F.col("l_orderkey").alias("o_order"), F.col("l_partkey").alias("o_part"), F.col("l_linenumber").alias("o_line"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).when(F.pmod("l_linenumber", F.lit(2)) == 1, 1).otherwise(-1).alias("direction"),
        x.alias("pnl_c"), F.lit(500).cast("long").alias("comm_c"),
        (F.least(x, F.lit(0)) - F.pmod(F.col("l_partkey") * 37, F.lit(20_000))).alias("mae_c"),
        (F.greatest(x, F.lit(0)) + F.pmod(F.col("l_suppkey") * 53 + F.col("l_linenumber") * 997, F.lit(20_000))).alias("mfe_c"),
        (F.col("l_linestatus") == "O").alias("path_known"))
    fall = F.greatest(-F.col("mae_c"), div((F.col("mfe_c") - F.col("mae_c")) * (1 + F.pmod("o_line", F.lit(3))), 3))
    return t.withColumn("fall_c", F.when(F.col("path_known"), fall))


def trades(lineitem: DataFrame) -> DataFrame:
    """``listed_trades`` with the trade_no that orders the trades of an account."""
    t = listed_trades(lineitem).withColumn("day_no", F.unix_date("d"))
    return bucketed_rank(t, ["account"], "day_no", 7, "trade_no", ties=ORDER[1:]).drop(*ORDER[1:], "day_no")


TRADES = """trades_c AS (
  SELECT *, CASE WHEN path_known THEN greatest(-mae_c, ((mfe_c - mae_c) * (1 + ln % 3)) // 3) END AS fall_c,
    row_number() OVER (PARTITION BY account ORDER BY d, ok, pk, ln) AS trade_no
  FROM (SELECT l_suppkey AS account, CAST(l_shipdate AS DATE) AS d, l_orderkey AS ok, l_partkey AS pk, l_linenumber AS ln,
      CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS direction,
      x AS pnl_c, CAST(500 AS BIGINT) AS comm_c, least(x, 0) - (l_partkey * 37) % 20000 AS mae_c,
      greatest(x, 0) + (l_suppkey * 53 + l_linenumber * 997) % 20000 AS mfe_c, l_linestatus = 'O' AS path_known
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) % 60001 - 30000 AS x FROM lineitem)))"""


def executions(events: DataFrame) -> DataFrame:
    """account, instrument, seq, us, is_entry, is_exit, action (0 buy, 2 sell) of ``events``."""
    entry, exit_ = F.col("event_type").isin("signup", "purchase"), F.col("event_type").isin("view", "click")
    action = F.when(entry, F.pmod("event_id", F.lit(2)) * 2).otherwise(F.pmod("event_id", F.lit(4))).cast("long")
    return events.select(F.col("user_id").alias("account"), F.pmod(F.floor(F.col("event_id") / 7), F.lit(3)).alias("instrument"), F.col("event_id").alias("seq"), micros("ts").alias("us"), entry.alias("is_entry"), exit_.alias("is_exit"), action.alias("action"))


EXECUTIONS = """executions AS (
  SELECT user_id AS account, (event_id // 7) % 3 AS instrument, event_id AS seq, epoch_us(ts) AS us, event_type IN ('signup', 'purchase') AS is_entry, event_type IN ('view', 'click') AS is_exit,
    CASE WHEN event_type IN ('signup', 'purchase') THEN event_id % 2 * 2 ELSE event_id % 4 END AS action FROM events)"""
