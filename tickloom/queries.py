"""Queries of the core operators for problems 2 to 7."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import drift, grid, intervals, nearest, rolling, spikes
from .sources.tables import contract_key, merged_trades, net_ticks, table

#: Two seconds in 100 ns, the tolerance of problem 7.
TOLERANCE = 20_000_000


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.market_periods(table(spark, d, "trades"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_prints(table(spark, d, "tape"), table(spark, d, "instruments")).select("tick_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "backtests"), table(spark, d, "trade_fields"))


def p4_trades(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_records(table(spark, d, "backtests"), table(spark, d, "trade_fields"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = rolling.account_rolling(table(spark, d, "trades")).where("total_7 < 0 and total_30 > 0")
    return out.select("account", F.date_format("trade_day", "yyyy-MM-dd").alias("trade_day"))


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = rolling.account_rolling(table(spark, d, "trades"))
    return out.select("account", F.date_format("trade_day", "yyyy-MM-dd").alias("trade_day"), "total_7", "total_30", F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.tape_grid(table(spark, d, "tape")).where("not covered").select("contract", "slot_start")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.tape_grid(table(spark, d, "tape")).select("contract", "slot_start", "px", "vol", "readings", "covered")


def p6_counter(spark: SparkSession, d: str) -> DataFrame:
    return grid.counter_tape_grid(table(spark, d, "tape")).withColumn("total", F.round("total", 3))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    trades = merged_trades(table(spark, d, "trades"), "instrument", "entry_time")
    anchors = trades.select("trade_id", F.col("instrument").alias("contract"), net_ticks("entry_time").alias("at"))
    prints = table(spark, d, "tape").select("tick_id", contract_key("contract").alias("contract"), "ts")
    return nearest.nearest_in_time(anchors, prints, "contract", "trade_id", "at", "tick_id", "ts", TOLERANCE).select("trade_id", "tick_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p3_found, p4_found, p4_trades, p5_found, p5_rolling, p6_found, p6_grid, p6_counter, p7_found)}


#: Trades with their states merged, as the operators see them.
MERGED = """merged AS (
  SELECT trade_id, arg_min(upper(trim(account)), row_id) AS account,
         arg_min(CASE WHEN instrument IS NOT NULL THEN upper(trim(regexp_replace(instrument, '[_\\s]+', ' ', 'g'))) END, row_id) AS contract,
         min(entry_time) AS entry_time, min(exit_time) AS exit_time, arg_min(pnl, row_id) AS pnl
  FROM trades WHERE trade_id IS NOT NULL GROUP BY trade_id)"""

#: Islands by running maximum: another way than the operator's ranks.
P2 = f"""WITH {MERGED}, s AS (
  SELECT account, entry_time AS a, exit_time AS z FROM merged
  WHERE entry_time IS NOT NULL AND exit_time >= entry_time),
m AS (SELECT *, max(z) OVER (PARTITION BY account ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT account, island, min(a) AS a, max(z) AS z FROM g GROUP BY account, island),
n AS (SELECT *, lead(a) OVER (PARTITION BY account ORDER BY island) AS following FROM p)
SELECT account, 'period' AS kind, strftime(a, '%Y-%m-%dT%H:%M:%S.%f') AS start_at, strftime(z, '%Y-%m-%dT%H:%M:%S.%f') AS end_at FROM p
UNION ALL
SELECT account, 'gap', strftime(z, '%Y-%m-%dT%H:%M:%S.%f'), strftime(following, '%Y-%m-%dT%H:%M:%S.%f') FROM n
WHERE CAST(z AS DATE) = CAST(following AS DATE)"""

_P5 = f"""WITH {MERGED}, daily AS (
  SELECT account, CAST(exit_time AS DATE) AS d, CAST(sum(CAST(round(pnl * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM merged WHERE exit_time IS NOT NULL AND pnl IS NOT NULL AND account IS NOT NULL GROUP BY ALL),
cal AS (SELECT account, CAST(unnest(generate_series(min(d), max(d) + INTERVAL 29 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY account),
r AS (SELECT c.account, c.d, CAST(coalesce(sum(CASE WHEN x.d > c.d - INTERVAL 7 DAY THEN x.cents END), 0) AS BIGINT) AS total_7, CAST(coalesce(sum(x.cents), 0) AS BIGINT) AS total_30
  FROM cal c LEFT JOIN daily x ON x.account = c.account AND x.d <= c.d AND x.d > c.d - INTERVAL 30 DAY GROUP BY ALL)
"""

P6 = """WITH g AS (
  SELECT upper(trim(regexp_replace(contract, '[_\\s]+', ' ', 'g'))) AS contract, (ts - 621355968000000000) // 3000000000 AS slot, px, vol, ts, tick_id
  FROM tape WHERE ts IS NOT NULL AND contract IS NOT NULL),
s AS (SELECT contract, slot, CAST(sum(vol) AS BIGINT) AS vol, count(CASE WHEN px > 0 AND NOT isnan(px) THEN 1 END) AS n,
        arg_max(CASE WHEN px > 0 AND NOT isnan(px) THEN CAST(px AS DOUBLE) END, (ts, tick_id)) FILTER (px > 0 AND NOT isnan(px)) AS px FROM g GROUP BY ALL),
b AS (SELECT contract, slot // 288 AS day, min(slot) AS a, max(slot) AS z FROM s WHERE n > 0 GROUP BY ALL),
c AS (SELECT contract, unnest(generate_series(a, z)) AS slot FROM b)
SELECT c.contract, strftime(make_timestamp(c.slot * 300000000), '%Y-%m-%dT%H:%M:%S') AS slot_start, s.px, coalesce(s.vol, 0) AS vol, coalesce(s.n, 0) AS readings, coalesce(s.n, 0) > 0 AS covered
FROM c LEFT JOIN s ON s.contract = c.contract AND s.slot = c.slot"""

#: Running volume of a contract's date, differenced and spread over the slots between two readings.
P6_COUNTER = """WITH g AS (SELECT upper(trim(regexp_replace(contract, '[_\\s]+', ' ', 'g'))) AS contract, ts AS t, sum(vol) AS v FROM tape WHERE ts IS NOT NULL AND vol IS NOT NULL AND contract IS NOT NULL GROUP BY ALL),
r AS (SELECT contract, t, sum(v) OVER (PARTITION BY contract, t // 864000000000 ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM g),
m AS (SELECT contract, lag(t) OVER w AS t0, t AS t1, CASE WHEN c >= lag(c) OVER w THEN c - lag(c) OVER w ELSE c END AS inc FROM r WINDOW w AS (PARTITION BY contract ORDER BY t)),
x AS (SELECT *, unnest(generate_series(t0 // 3000000000, t1 // 3000000000)) AS slot FROM m WHERE t0 IS NOT NULL),
s AS (SELECT contract, slot, sum(CAST(inc AS DOUBLE) * (CAST(least(t1, (slot + 1) * 3000000000) - greatest(t0, slot * 3000000000) AS DOUBLE) / CAST(t1 - t0 AS DOUBLE))) AS total FROM x GROUP BY ALL),
k AS (SELECT contract, t // 3000000000 AS slot, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT contract, slot // 288 AS day, min(slot) AS a, max(slot) AS z FROM k GROUP BY ALL),
c AS (SELECT contract, unnest(generate_series(a, z)) AS slot FROM b)
SELECT c.contract, strftime(make_timestamp(c.slot * 300000000 - 62135596800000000), '%Y-%m-%dT%H:%M:%S') AS slot_start, round(coalesce(s.total, 0), 3) AS total, coalesce(k.n, 0) AS readings, coalesce(k.n, 0) > 0 AS covered
FROM c LEFT JOIN s ON s.contract = c.contract AND s.slot = c.slot LEFT JOIN k ON k.contract = c.contract AND k.slot = c.slot"""

P7 = f"""WITH {MERGED}, a AS (
  SELECT trade_id, contract, epoch_us(entry_time) * 10 + 621355968000000000 AS moment FROM merged WHERE entry_time IS NOT NULL),
t AS (SELECT tick_id, upper(trim(regexp_replace(contract, '[_\\s]+', ' ', 'g'))) AS contract, ts FROM tape WHERE ts IS NOT NULL)
SELECT trade_id, arg_min(tick_id, (abs(ts - moment), tick_id)) AS tick_id FROM a JOIN t ON t.contract = a.contract AND t.ts BETWEEN a.moment - 20000000 AND a.moment + 20000000 GROUP BY trade_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2,
        "p5_found": _P5 + "SELECT account, strftime(d, '%Y-%m-%d') AS trade_day FROM r WHERE total_7 < 0 AND total_30 > 0",
        "p5_rolling": _P5 + "SELECT account, strftime(d, '%Y-%m-%d') AS trade_day, total_7, total_30, round(total_7 / 7, 6) AS avg_7, round(total_30 / 30, 6) AS avg_30 FROM r",
        "p6_found": f"SELECT contract, slot_start FROM ({P6}) WHERE NOT covered",
        "p6_grid": P6,
        "p6_counter": P6_COUNTER,
        "p7_found": P7,
    }
