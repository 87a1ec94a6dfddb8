"""Queries of the tick, trade and statistics operators, each with its SQL.

Keys begin with the operator's number in the survey. Days are given as text and
ratios rounded to six decimals, so that both engines' results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import bars as B
from .operators import continuous as C
from .operators import fills as X
from .operators import indicators as I
from .operators import matching as M
from .operators import paths as P
from .operators import selection as L
from .operators import strategies as S
from .operators import summary as T
from .operators.drift import unified_records
from .sources import mappings
from .sources.mappings import EXECUTIONS, TICKS, TRADES
from .sources.tables import contract_key, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Bars of an hour and rules that suit the sparse test ticks.
HOUR = 3600
RULES = X.FillRules(slip=2.0, timeout_min=240, cooldown_min=5, max_gap_s=3600)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn
    return add


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return mappings.ticks(table(spark, d, "events"))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return mappings.trades(table(spark, d, "lineitem"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return mappings.listed_trades(table(spark, d, "lineitem"))


def _bars(spark: SparkSession, d: str, period: int = HOUR) -> DataFrame:
    return B.numbered(B.build_bars(_ticks(spark, d), period))


def _text(df: DataFrame, *days: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in days})


def _r(c: str) -> Column:
    return F.round(F.col(c).cast("double"), 6).alias(c)


def bars_sql(period: int) -> str:
    return f"""{TICKS}, bars AS (SELECT contract, cal_day, sod // {period} AS slot, arg_min(px_ticks, seq) AS o, max(px_ticks) AS h, min(px_ticks) AS l, arg_max(px_ticks, seq) AS c,
  CAST(sum(vol) AS BIGINT) AS v, CAST(sum(side * vol) AS BIGINT) AS delta, count(*) AS n, min(seq) AS start_seq, max(seq) + 1 AS end_seq, CAST(sum(px_ticks * vol) AS BIGINT) AS pv
  FROM ticks GROUP BY ALL),
nb AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY cal_day, slot) - 1 AS bar_no FROM bars)"""


DAY = "CAST(cal_day AS VARCHAR) AS cal_day"

# ---- scans, filters, projections ---------------------------------------------------------


@query("o06_available_range", f"WITH {TICKS} SELECT contract, CAST(min(cal_day) AS VARCHAR) AS first_day, CAST(max(cal_day) AS VARCHAR) AS last_day, count(DISTINCT cal_day) AS sessions, count(*) AS n_ticks FROM ticks GROUP BY contract")
def o06(spark, d):
    return _text(B.available_range(_ticks(spark, d)), "first_day", "last_day")


@query("o08_instrument_dim", "SELECT root, full_name, point_value, tick_size FROM instruments WHERE instrument_type = 0 AND point_value <> 0 AND tick_size <> 0 AND point_value IS NOT NULL AND tick_size IS NOT NULL")
def o08(spark, d):
    return L.futures(table(spark, d, "instruments"))


@query("o14_file_day", "SELECT tick_id, strftime(try_strptime(left(file_hour, 10), '%Y%m%d%H') - INTERVAL 1 HOUR, '%Y%m%d') AS day FROM tape")
def o14(spark, d):
    from .sources.files import file_day
    return table(spark, d, "tape").select("tick_id", file_day("file_hour").alias("day"))


@query("o26_slice_rth", f"WITH {TICKS} SELECT seq, px_ticks, vol, side FROM ticks WHERE sod >= 34200 AND sod < 57600 AND cal_day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def o26(spark, d):
    return B.slice_range(_ticks(spark, d), "2024-01-05", "2024-01-20").select("seq", "px_ticks", "vol", "side")


@query("o28_side", f"WITH {TICKS} SELECT seq, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 2 = 0 THEN -1 ELSE 0 END AS side FROM ticks")
def o28(spark, d):
    return _ticks(spark, d).select("seq", B.aggressor(F.pmod("k", F.lit(3)), F.pmod("k", F.lit(2))).alias("side"))


@query("o33_filters", f"WITH {TRADES} SELECT account, count(*) AS n FROM trades_c WHERE contains(CAST(account AS VARCHAR), '7') AND direction = 1 GROUP BY account")
def o33(spark, d):
    return L.of_account(_trades(spark, d), "7", 1).groupBy("account").agg(F.count(F.lit(1)).alias("n"))


# ---- bars and tick aggregates ------------------------------------------------------------


def _bar_columns(df: DataFrame) -> DataFrame:
    return _text(df, "cal_day").select("contract", "cal_day", "slot", "o", "h", "l", "c", "v", "delta", "n", "start_seq", "end_seq")


def _bar_sql(period: int) -> str:
    return f"WITH {bars_sql(period)} SELECT contract, {DAY}, slot, o, h, l, c, v, delta, n, start_seq, end_seq FROM bars"


@query("o50_bars_15m", _bar_sql(900))
def o50_15(spark, d):
    return _bar_columns(B.build_bars(_ticks(spark, d), B.parse_period("15m")))


@query("o50_bars_1h", _bar_sql(3600))
def o50_1h(spark, d):
    return _bar_columns(B.build_bars(_ticks(spark, d), B.parse_period("1h")))


@query("o51_minute_features", f"""WITH {TICKS} SELECT contract, {DAY}, sod // 60 AS minute, arg_min(px_ticks, seq) AS o, max(px_ticks) AS h, min(px_ticks) AS l, arg_max(px_ticks, seq) AS c, CAST(sum(vol) AS BIGINT) AS volume,
  CAST(coalesce(sum(vol) FILTER (side = 1), 0) AS BIGINT) AS buy, CAST(coalesce(sum(vol) FILTER (side = -1), 0) AS BIGINT) AS sell, CAST(coalesce(sum(vol) FILTER (side = 1 AND vol >= 10), 0) AS BIGINT) AS big_buy,
  CAST(coalesce(sum(vol) FILTER (side = -1 AND vol >= 10), 0) AS BIGINT) AS big_sell, count(*) AS n_trades, CAST(sum(k % 7) AS BIGINT) AS spread_sum, round(avg(k % 7), 6) AS avg_spread FROM ticks GROUP BY ALL""")
def o51(spark, d):
    return _text(B.minute_features(_ticks(spark, d)), "cal_day")


@query("o54_sweep_clusters", f"""WITH {TICKS}, s AS (SELECT *, lag(side) OVER w AS ps, lag(us) OVER w AS pu FROM ticks WHERE side <> 0 WINDOW w AS (PARTITION BY contract, cal_day ORDER BY seq)),
g AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> side OR us - pu > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY contract, cal_day ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cluster FROM s)
SELECT contract, {DAY}, CAST(cluster AS BIGINT) AS cluster, arg_max(side, seq) AS side, CAST(sum(vol) AS BIGINT) AS volume, max(seq) AS last_seq, count(*) AS n FROM g GROUP BY contract, g.cal_day, g.cluster""")
def o54(spark, d):
    return _text(B.sweep_clusters(_ticks(spark, d), 600_000_000), "cal_day")


@query("o55_daily_volume", f"WITH {TICKS} SELECT contract, {DAY}, CAST(sum(vol) AS BIGINT) AS volume FROM ticks GROUP BY contract, ticks.cal_day")
def o55(spark, d):
    return _text(B.daily_volume(_ticks(spark, d)), "cal_day")


@query("o58_coverage_holes", """WITH x AS (SELECT DISTINCT upper(trim(account)) AS contract, CAST(exit_time AS DATE) AS cal_day FROM trades WHERE exit_time IS NOT NULL),
n AS (SELECT *, lead(cal_day) OVER (PARTITION BY contract ORDER BY cal_day) AS next_day FROM x)
SELECT contract, CAST(cal_day AS VARCHAR) AS cal_day, CAST(next_day AS VARCHAR) AS next_day, CAST(next_day - cal_day AS INT) AS apart FROM n WHERE next_day - cal_day > 3""")
def o58(spark, d):
    rows = table(spark, d, "trades").where("exit_time is not null").select(F.upper(F.trim("account")).alias("contract"), F.to_date("exit_time").alias("cal_day"))
    return _text(B.coverage_holes(rows), "cal_day", "next_day")


@query("o59_tape_holes", f"""WITH {TICKS}, g AS (SELECT contract, cal_day, us - lag(us) OVER (PARTITION BY contract, cal_day ORDER BY seq) AS gap FROM ticks)
SELECT contract, CAST(cal_day AS VARCHAR) AS cal_day, count(*) AS holes, max(gap) AS longest_us FROM g WHERE gap > 1800000000 GROUP BY contract, g.cal_day""")
def o59(spark, d):
    return _text(B.tape_holes(_ticks(spark, d), 1_800_000_000), "cal_day")


@query("o60_spread_gap", f"""WITH {TICKS}, r AS (SELECT contract, cal_day, k % 7 AS spread, abs(px_ticks - lag(px_ticks) OVER (PARTITION BY contract, cal_day ORDER BY seq)) AS step, count(*) OVER (PARTITION BY contract, cal_day) AS n FROM ticks WHERE sod >= 34200 AND sod < 57600),
a AS (SELECT contract, CAST(quantile_cont(spread, 0.5) AS DOUBLE) AS spread_p50, CAST(quantile_cont(spread, 0.9) AS DOUBLE) AS spread_p90, round(avg(spread), 6) AS spread_mean, round(avg(CASE WHEN spread > 1 THEN 1 ELSE 0 END), 6) AS spread_wide,
  round(quantile_cont(step, 0.9) FILTER (step > 0), 6) AS gap_p90, round(avg(step) FILTER (step > 0), 6) AS gap_mean FROM r WHERE n >= 20 GROUP BY contract)
SELECT *, round_even(spread_p50 / 2, 2) AS floor, round_even(greatest(spread_p90 / 2, gap_p90), 2) AS stress FROM a""")
def o60(spark, d):
    return B.spread_gap(_ticks(spark, d), least=20)


@query("o89_gaps", f"WITH {TICKS} SELECT contract, seq, us - lag(us) OVER w AS gap_us, px_ticks - lag(px_ticks) OVER w AS step FROM ticks WINDOW w AS (PARTITION BY contract, cal_day ORDER BY seq)")
def o89(spark, d):
    return B.tick_gaps(_ticks(spark, d)).select("contract", "seq", "gap_us", "step")


# ---- indicators --------------------------------------------------------------------------


@query("o77_sma", f"WITH {bars_sql(HOUR)} SELECT contract, bar_no, CASE WHEN bar_no >= 7 THEN round(CAST(sum(c) OVER (PARTITION BY contract ORDER BY bar_no ROWS 7 PRECEDING) AS DOUBLE) / 8, 6) END AS sma FROM nb")
def o77(spark, d):
    return _bars(spark, d).select("contract", "bar_no", F.round(I.sma("c", 8), 6).alias("sma"))


@query("o78_rolling", f"""WITH {bars_sql(HOUR)} SELECT contract, bar_no, CASE WHEN bar_no >= 9 THEN max(h) OVER w END AS top, CASE WHEN bar_no >= 9 THEN min(l) OVER w END AS bottom, CASE WHEN bar_no >= 9 THEN round(CAST(sum(c) OVER w AS DOUBLE) / 10, 6) END AS mean
FROM nb WINDOW w AS (PARTITION BY contract ORDER BY bar_no ROWS 9 PRECEDING)""")
def o78(spark, d):
    return _bars(spark, d).select("contract", "bar_no", I.trailing(F.max("h"), 10).alias("top"), I.trailing(F.min("l"), 10).alias("bottom"), F.round(I.sma("c", 10), 6).alias("mean"))


ATR = f"""{bars_sql(HOUR)}, t AS (SELECT *, lag(c) OVER (PARTITION BY contract, cal_day ORDER BY bar_no) AS pc FROM nb),
r AS (SELECT *, CASE WHEN pc IS NULL THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr FROM t),
a AS (SELECT *, CASE WHEN bar_no >= 13 THEN CAST(sum(tr) OVER (PARTITION BY contract ORDER BY bar_no ROWS 13 PRECEDING) AS DOUBLE) / 14 END AS atr FROM r)"""


@query("o79_atr", f"WITH {ATR} SELECT contract, bar_no, tr, round(atr, 6) AS atr FROM a")
def o79(spark, d):
    return I.atr(_bars(spark, d), 14).select("contract", "bar_no", "tr", _r("atr"))


@query("o80_atr_wilder", f"""WITH RECURSIVE {bars_sql(HOUR)}, t AS (SELECT *, lag(c) OVER (PARTITION BY contract ORDER BY bar_no) AS pc FROM nb),
r AS (SELECT contract, bar_no, CAST(CASE WHEN pc IS NULL THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END AS DOUBLE) AS tr FROM t),
w AS (SELECT contract, bar_no, tr AS atr FROM r WHERE bar_no = 0 UNION ALL SELECT r.contract, r.bar_no, w.atr + (r.tr - w.atr) / least(r.bar_no + 1, 14) FROM w JOIN r ON r.contract = w.contract AND r.bar_no = w.bar_no + 1)
SELECT contract, bar_no, round(atr, 6) AS atr FROM w""")
def o80(spark, d):
    return I.atr_wilder(_bars(spark, d), 14).select("contract", "bar_no", _r("atr"))


VWAP = f"""{bars_sql(HOUR)}, vw AS (SELECT *, row_number() OVER w - 1 AS bar_of_day, CAST(sum(pv) OVER w AS DOUBLE) / greatest(sum(v) OVER w, 1) AS vwap FROM nb WINDOW w AS (PARTITION BY contract, cal_day ORDER BY bar_no ROWS UNBOUNDED PRECEDING))"""


@query("o83_session_vwap", f"WITH {VWAP} SELECT contract, bar_no, bar_of_day, round(vwap, 6) AS vwap FROM vw")
def o83(spark, d):
    return I.session_vwap(_bars(spark, d)).select("contract", "bar_no", "bar_of_day", _r("vwap"))


@query("o85_last_bar", f"WITH {bars_sql(HOUR)} SELECT contract, bar_no, max(bar_no) OVER (PARTITION BY contract, cal_day) AS last_bar FROM nb")
def o85(spark, d):
    return I.last_bar_of_day(_bars(spark, d)).select("contract", "bar_no", "last_bar")


# ---- strategies --------------------------------------------------------------------------

CROSS = f"""{bars_sql(HOUR)}, m AS (SELECT *, CASE WHEN bar_no >= 7 THEN sum(c) OVER (PARTITION BY contract ORDER BY bar_no ROWS 2 PRECEDING) * 8 > sum(c) OVER (PARTITION BY contract ORDER BY bar_no ROWS 7 PRECEDING) * 3 END AS up FROM nb),
xb AS (SELECT *, lag(up) OVER w AS was, lead(start_seq) OVER w AS ns, lead(o) OVER w AS no_, lead(cal_day) OVER w AS nd FROM m WINDOW w AS (PARTITION BY contract ORDER BY bar_no)),
cand AS (SELECT contract, cal_day, ns AS entry_seq, CASE WHEN up THEN 1 ELSE -1 END AS dir, no_ - CASE WHEN up THEN 40 ELSE -40 END AS stop, CAST(no_ + CASE WHEN up THEN 80 ELSE -80 END AS DOUBLE) AS target
  FROM xb WHERE bar_no >= 8 AND up <> was AND nd = cal_day)"""
CAND = "SELECT contract, CAST(cal_day AS VARCHAR) AS cal_day, entry_seq, dir, stop, target FROM cand"


def _cross(spark, d):
    return S.ma_cross(_bars(spark, d), 3, 8, 40, 2.0)


@query("o101_ma_cross", f"WITH {CROSS} {CAND}")
def o101(spark, d):
    return _text(_cross(spark, d), "cal_day")


ORB = f"""{TICKS}, rg AS (SELECT contract, cal_day, max(px_ticks) AS hi, min(px_ticks) AS lo FROM ticks WHERE sod >= 34200 AND sod < 34200 + 3600 GROUP BY ALL),
st AS (SELECT t.contract, t.cal_day, t.seq, hi, lo, CASE WHEN px_ticks > hi THEN 1 WHEN px_ticks < lo THEN -1 ELSE 0 END AS state FROM ticks t JOIN rg ON rg.contract = t.contract AND rg.cal_day = t.cal_day WHERE sod >= 34200 + 3600 AND sod < 57600),
mk AS (SELECT *, lag(state) OVER (PARTITION BY contract, cal_day ORDER BY seq) AS was FROM st),
fi AS (SELECT *, row_number() OVER (PARTITION BY contract, cal_day ORDER BY seq) AS no FROM mk WHERE state <> 0 AND (was IS NULL OR was = 0)),
cand AS (SELECT contract, cal_day, seq AS entry_seq, state AS dir, CASE WHEN state > 0 THEN hi ELSE lo END - state * 40 AS stop, CAST(CASE WHEN state > 0 THEN hi ELSE lo END + state * 80 AS DOUBLE) AS target FROM fi WHERE no = 1)"""


def _orb(spark, d):
    return S.orb(B.slice_range(_ticks(spark, d)), 60, 40, 2.0)


@query("o102_orb", f"WITH {ORB} {CAND}")
def o102(spark, d):
    return _text(_orb(spark, d), "cal_day")


@query("o103_range_break", f"""WITH RECURSIVE {ATR}, w AS (SELECT *, CASE WHEN bar_no >= 2 THEN max(h) OVER (PARTITION BY contract ORDER BY bar_no ROWS 2 PRECEDING) END AS top, CASE WHEN bar_no >= 2 THEN min(l) OVER (PARTITION BY contract ORDER BY bar_no ROWS 2 PRECEDING) END AS bot,
    lag(cal_day, 2) OVER (PARTITION BY contract ORDER BY bar_no) AS fd, lead(cal_day) OVER (PARTITION BY contract ORDER BY bar_no) AS nd FROM a),
ar AS (SELECT contract, cal_day, bar_no AS arm_bar, top, bot, atr FROM w WHERE fd = cal_day AND nd = cal_day AND atr IS NOT NULL AND top - bot BETWEEN 5 AND 400 AND atr <= 160),
tb AS (SELECT t.*, b.bar_no FROM ticks t JOIN nb b ON b.contract = t.contract AND b.cal_day = t.cal_day AND b.slot = t.sod // 3600),
ht AS (SELECT ar.contract, ar.cal_day, arm_bar, top, atr, min(seq) AS seq FROM tb JOIN ar ON ar.contract = tb.contract AND tb.bar_no = ar.arm_bar + 1 WHERE px_ticks > top OR px_ticks < bot GROUP BY ALL),
fi AS (SELECT ht.contract, ht.cal_day, arm_bar, atr, ht.seq, t.px_ticks AS px, CASE WHEN t.px_ticks > top THEN 1 ELSE -1 END AS dir FROM ht JOIN ticks t ON t.seq = ht.seq AND t.contract = ht.contract WHERE sod >= 34200 AND sod < 54000),
nx AS (SELECT a.contract, a.arm_bar, min(b.arm_bar) AS nxt FROM fi a JOIN fi b ON b.contract = a.contract AND b.arm_bar >= a.arm_bar + 2 GROUP BY ALL),
g AS (SELECT contract, min(arm_bar) AS arm_bar FROM fi GROUP BY contract UNION ALL SELECT g.contract, nx.nxt FROM g JOIN nx ON nx.contract = g.contract AND nx.arm_bar = g.arm_bar)
SELECT fi.contract, CAST(fi.cal_day AS VARCHAR) AS cal_day, seq AS entry_seq, dir, round(px - dir * atr, 6) AS stop, round(px + dir * 2 * atr, 6) AS target, round(px + dir * atr, 6) AS be_px FROM g JOIN fi ON fi.contract = g.contract AND fi.arm_bar = g.arm_bar""")
def o103(spark, d):
    out = S.range_break(_ticks(spark, d), _bars(spark, d), HOUR, lookback=3, min_range=5, max_range=400)
    return _text(out, "cal_day").select("contract", "cal_day", "entry_seq", "dir", _r("stop"), _r("target"), _r("be_px"))


@query("o104_sweep_follow", f"""WITH {TICKS}, s AS (SELECT *, lag(side) OVER w AS ps, lag(us) OVER w AS pu FROM ticks WHERE side <> 0 WINDOW w AS (PARTITION BY contract, cal_day ORDER BY seq)),
g AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> side OR us - pu > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY contract, cal_day ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cluster FROM s),
c AS (SELECT contract, cal_day, arg_max(side, seq) AS side, arg_max(px_ticks, seq) AS px, max(seq) AS seq FROM g GROUP BY contract, cal_day, cluster HAVING sum(vol) >= 20)
SELECT contract, {DAY}, seq AS entry_seq, side AS dir, px - side * 40 AS stop, CAST(px + side * 80 AS DOUBLE) AS target FROM c""")
def o104(spark, d):
    return _text(S.sweep_follow(_ticks(spark, d), 20, 600_000_000, 40, 2.0), "cal_day")


FVG = f"""{bars_sql(HOUR)}, q AS (SELECT *, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2, max(bar_no) OVER (PARTITION BY contract, cal_day) AS lb FROM nb WINDOW w AS (PARTITION BY contract ORDER BY bar_no)),
gp AS (SELECT contract, cal_day, bar_no AS gap_bar, CASE WHEN l - h2 >= 8 THEN 1 ELSE -1 END AS dir, CASE WHEN l - h2 >= 8 THEN l ELSE h END AS limit_px, least(bar_no + 12, lb) AS until FROM q WHERE l - h2 >= 8 OR l2 - h >= 8),
tb AS (SELECT t.*, b.bar_no FROM ticks t JOIN nb b ON b.contract = t.contract AND b.cal_day = t.cal_day AND b.slot = t.sod // 3600),
cand AS (SELECT gp.contract, gp.cal_day, min(seq) AS entry_seq, dir, limit_px, gap_bar, limit_px - dir * 40 AS stop, CAST(limit_px + dir * 80 AS DOUBLE) AS target
  FROM gp JOIN tb ON tb.contract = gp.contract AND tb.cal_day = gp.cal_day AND tb.bar_no > gap_bar AND tb.bar_no <= until AND dir * (px_ticks - limit_px) <= 0 GROUP BY ALL)"""


def _fvg(spark, d):
    return S.fvg(_ticks(spark, d), _bars(spark, d), HOUR, 8, 12, 40, 2.0)


@query("o105_fvg", f"WITH {FVG} SELECT contract, CAST(cal_day AS VARCHAR) AS cal_day, entry_seq, dir, stop, target, limit_px, gap_bar FROM cand")
def o105(spark, d):
    return _text(_fvg(spark, d), "cal_day")


@query("o106_vwap_revert", f"""WITH {VWAP}, x AS (SELECT *, lead(start_seq) OVER w AS ns, lead(o) OVER w AS no_, lead(cal_day) OVER w AS nd FROM vw WINDOW w AS (PARTITION BY contract ORDER BY bar_no)),
cand AS (SELECT contract, cal_day, ns AS entry_seq, CASE WHEN c > vwap THEN -1 ELSE 1 END AS dir, no_ + CASE WHEN c > vwap THEN 40 ELSE -40 END AS stop, CAST(no_ - CASE WHEN c > vwap THEN 40 ELSE -40 END AS DOUBLE) AS target FROM x WHERE abs(c - vwap) >= 60 AND bar_of_day >= 6 AND nd = cal_day) {CAND}""")
def o106(spark, d):
    return _text(S.vwap_revert(_bars(spark, d), 60, 6, 40, 1.0), "cal_day")


# ---- fill resolution ---------------------------------------------------------------------


def resolve_sql(source: str, fill: str, restrict: str = "") -> str:
    """Exits by first hits and the trades among them by following pointers."""
    return f"""WITH RECURSIVE {source}, ta AS (SELECT * FROM ticks {restrict}),
tk AS (SELECT *, us - lag(us) OVER w AS gap, lag(seq) OVER w AS prev, max(seq) OVER (PARTITION BY contract, cal_day) AS day_last FROM ta WINDOW w AS (PARTITION BY contract, cal_day ORDER BY seq)),
cn AS (SELECT cand.*, row_number() OVER (PARTITION BY cand.contract, cand.entry_seq ORDER BY stop, target) AS no, tk.us AS us0, {fill} AS fill, tk.day_last FROM cand JOIN tk ON tk.contract = cand.contract AND tk.seq = cand.entry_seq),
c AS (SELECT * FROM cn WHERE dir * (fill - stop) > 0 AND dir * (fill - target) < 0),
hh AS (SELECT c.contract, c.entry_seq, c.no, c.dir, c.stop, c.target, c.fill, c.us0, c.day_last, min(seq) FILTER (gap > 3600000000) AS s_gap, min(seq) FILTER (c.dir * (px_ticks - stop) <= 0) AS s_stop, min(seq) FILTER (c.dir * (px_ticks - target) >= 0) AS s_tgt, max(seq) AS s_last
  FROM c LEFT JOIN tk ON tk.contract = c.contract AND tk.cal_day = c.cal_day AND tk.seq > c.entry_seq AND tk.us <= c.us0 + 14400000000 GROUP BY ALL),
e AS (SELECT *, least(s_gap, s_stop, s_tgt) AS hit FROM hh),
f AS (SELECT e.*, CASE WHEN hit IS NULL THEN coalesce(s_last, entry_seq) WHEN hit = s_gap THEN t.prev ELSE hit END AS exit_seq,
  CASE WHEN hit IS NULL THEN CASE WHEN coalesce(s_last, entry_seq) = e.day_last THEN 'close' ELSE 'timeout' END WHEN hit = s_gap THEN 'gap' WHEN hit = s_stop THEN 'stop' ELSE 'target' END AS reason FROM e LEFT JOIN tk t ON t.contract = e.contract AND t.seq = e.hit),
x AS (SELECT f.*, t.us AS exit_us, CASE reason WHEN 'stop' THEN CASE WHEN dir > 0 THEN least(stop, px_ticks) ELSE greatest(stop, px_ticks) END WHEN 'target' THEN target ELSE px_ticks END - dir * 2.0 AS exit_px,
  row_number() OVER (PARTITION BY f.contract ORDER BY entry_seq, no) AS rn FROM f JOIN tk t ON t.contract = f.contract AND t.seq = f.exit_seq),
nx AS (SELECT a.contract, a.rn, min(b.rn) AS nxt FROM x a JOIN x b ON b.contract = a.contract AND b.rn > a.rn AND b.us0 >= a.exit_us + 300000000 GROUP BY ALL),
g AS (SELECT contract, CAST(1 AS BIGINT) AS rn FROM x WHERE rn = 1 UNION ALL SELECT g.contract, nx.nxt FROM g JOIN nx ON nx.contract = g.contract AND nx.rn = g.rn),
tr AS (SELECT x.* FROM g JOIN x ON x.contract = g.contract AND x.rn = g.rn),
pa AS (SELECT tr.contract, tr.rn, tk.seq, tr.dir * (tk.px_ticks - tr.fill) AS v FROM tr JOIN tk ON tk.contract = tr.contract AND tk.seq > tr.entry_seq AND tk.seq <= tr.exit_seq UNION ALL SELECT contract, rn, entry_seq, 0 FROM tr),
pm AS (SELECT contract, rn, v, max(v) OVER (PARTITION BY contract, rn ORDER BY seq ROWS UNBOUNDED PRECEDING) - v AS f FROM pa),
lh AS (SELECT contract, rn, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high, CAST(max(f) AS DOUBLE) AS fall FROM pm GROUP BY ALL)
SELECT tr.contract, entry_seq, dir, CAST(fill AS DOUBLE) AS fill, exit_seq, CAST(exit_px AS DOUBLE) AS exit_px, reason, low, high, fall, CAST(dir * (exit_px - fill) AS DOUBLE) AS pnl FROM tr JOIN lh ON lh.contract = tr.contract AND lh.rn = tr.rn"""


TRADE = ("contract", "entry_seq", "dir", "fill", "exit_seq", "exit_px", "reason", "low", "high", "fall", "pnl")


@query("o108_resolve_ma_cross", resolve_sql(CROSS, "tk.px_ticks + dir * 2.0"))
def o108_cross(spark, d):
    return X.resolve(_ticks(spark, d), _cross(spark, d), RULES).select(*TRADE)


@query("o108_resolve_orb", resolve_sql(ORB, "tk.px_ticks + dir * 2.0", "WHERE sod >= 34200 AND sod < 57600"))
def o108_orb(spark, d):
    return X.resolve(B.slice_range(_ticks(spark, d)), _orb(spark, d), RULES).select(*TRADE)


@query("o108_resolve_fvg_limit", resolve_sql(FVG, "limit_px"))
def o108_fvg(spark, d):
    return X.resolve(_ticks(spark, d), _fvg(spark, d).drop("gap_bar"), RULES).select(*TRADE)


@query("o108_resolve_governed")
def o108_governed(spark, d):
    rules = X.FillRules(slip=2.0, cooldown_min=5, max_gap_s=3600, day_target=100.0, day_loss=60.0)
    return X.resolve(_ticks(spark, d), _cross(spark, d), rules).select(*TRADE)


# ---- trade summaries ---------------------------------------------------------------------


@query("o61_run_summary", f"""WITH {TRADES}, dy AS (SELECT account, d, CAST(sum(pnl_c) AS BIGINT) AS p FROM trades_c GROUP BY ALL),
t AS (SELECT account, CASE WHEN count(*) >= 20 AND stddev_samp(p) > 0 THEN round(avg(p) / (stddev_samp(p) / sqrt(count(*))), 6) END AS t_daily FROM dy GROUP BY account)
SELECT account, count(*) AS n, CAST(sum(pnl_c) AS BIGINT) AS pnl_c, round(avg(CASE WHEN pnl_c > 0 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(pnl_c), 6) AS mean_c, count(DISTINCT d) AS days, round(count(*) / count(DISTINCT d), 6) AS per_day, any_value(t_daily) AS t_daily FROM trades_c JOIN t USING (account) GROUP BY account""")
def o61(spark, d):
    return T.run_summary(_trades(spark, d))


@query("o62_account_summary", f"""WITH {TRADES} SELECT account, count(*) AS n, count(DISTINCT d) AS days, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, CAST(sum(pnl_c) AS BIGINT) AS pnl_c, round(avg(CASE WHEN pnl_c > 0 THEN 1 ELSE 0 END), 6) AS win_rate,
  count(*) FILTER (direction > 0) AS longs, count(*) FILTER (direction < 0) AS shorts, CAST(sum(comm_c) AS BIGINT) AS commission_c FROM trades_c GROUP BY account""")
def o62(spark, d):
    return _text(T.account_summary(_trades(spark, d)), "first_day", "last_day")


@query("o63_strategy_groups", """SELECT strategy_id, strategy, upper(trim(account)) AS account, is_replay, count(*) AS n FROM trades WHERE strategy_id <> '' AND strategy <> 'AtmStrategy' GROUP BY ALL""")
def o63(spark, d):
    return L.strategy_groups(table(spark, d, "trades"))


@query("o34_atm_exclusion", """SELECT strategy_id, strategy, upper(trim(account)) AS account, is_replay, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN trade_id % 4 = 0 THEN 'AtmStrategy' ELSE strategy END AS strategy) FROM trades) WHERE strategy_id <> '' AND strategy <> 'AtmStrategy' GROUP BY ALL""")
def o34(spark, d):
    rows = table(spark, d, "trades")
    return L.strategy_groups(rows.withColumn("strategy", F.when(F.pmod("trade_id", F.lit(4)) == 0, "AtmStrategy").otherwise(F.col("strategy"))))


@query("o64_grid_all_long_short", f"""WITH {TRADES}, x AS (SELECT *, pnl_c + comm_c AS g, coalesce(fall_c, mfe_c - mae_c) AS fb FROM trades_c),
y AS (SELECT 0 AS side, x.* FROM x UNION ALL SELECT direction, x.* FROM x),
a AS (SELECT side AS direction, count(*) AS n, CAST(sum(pnl_c) AS BIGINT) AS net_c, CAST(coalesce(sum(g) FILTER (g > 0), 0) AS BIGINT) AS gross_profit_c, CAST(coalesce(sum(g) FILTER (g < 0), 0) AS BIGINT) AS gross_loss_c, CAST(sum(comm_c) AS BIGINT) AS commission_c,
  count(*) FILTER (pnl_c > 0) AS wins, count(*) FILTER (pnl_c < 0) AS losses, count(*) FILTER (pnl_c = 0) AS evens, round(avg(pnl_c) FILTER (pnl_c > 0), 6) AS avg_win_c, round(avg(pnl_c) FILTER (pnl_c < 0), 6) AS avg_loss_c, max(pnl_c) AS largest_win_c, min(pnl_c) AS largest_loss_c,
  round(avg(mae_c), 6) AS avg_mae_c, round(avg(mfe_c), 6) AS avg_mfe_c, round(avg(fb), 6) AS avg_fall_c, max(fb) AS max_fall_c FROM y GROUP BY side)
SELECT *, CASE WHEN gross_loss_c < 0 THEN round(gross_profit_c / -gross_loss_c, 6) END AS profit_factor, round(wins / n, 6) AS win_rate FROM a""")
def o64(spark, d):
    return T.performance(_trades(spark, d))


@query("o64_performance_columns", f"""WITH {TRADES}, x AS (SELECT *, pnl_c + comm_c AS g, coalesce(fall_c, mfe_c - mae_c) AS fb, sign(pnl_c) AS k FROM trades_c),
y AS (SELECT * REPLACE (CAST(0 AS INT) AS direction) FROM x UNION ALL SELECT * FROM x),
r AS (SELECT *, sum(pnl_c) OVER (PARTITION BY account, direction ORDER BY trade_no ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY account, direction ORDER BY trade_no) - row_number() OVER (PARTITION BY account, direction, k ORDER BY trade_no) AS island FROM y),
q AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY account, direction ORDER BY trade_no ROWS UNBOUNDED PRECEDING)) AS peak FROM r),
st AS (SELECT account, direction, max(n) FILTER (k > 0) AS mw, max(n) FILTER (k < 0) AS ml FROM (SELECT account, direction, k, island, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL),
dy AS (SELECT account, count(DISTINCT d) AS days FROM trades_c GROUP BY account),
a AS (SELECT account, direction, count(*) AS n, CAST(sum(pnl_c) AS BIGINT) AS net_c, CAST(coalesce(sum(g) FILTER (g > 0), 0) AS BIGINT) AS gross_profit_c, CAST(coalesce(sum(g) FILTER (g < 0), 0) AS BIGINT) AS gross_loss_c, CAST(sum(comm_c) AS BIGINT) AS commission_c,
  count(*) FILTER (pnl_c > 0) AS wins, count(*) FILTER (pnl_c < 0) AS losses, count(*) FILTER (pnl_c = 0) AS evens, round(avg(pnl_c) FILTER (pnl_c > 0), 6) AS avg_win_c, round(avg(pnl_c) FILTER (pnl_c < 0), 6) AS avg_loss_c, round(avg(pnl_c), 6) AS avg_trade_c,
  max(pnl_c) FILTER (pnl_c > 0) AS largest_win_c, min(pnl_c) FILTER (pnl_c < 0) AS largest_loss_c, round(avg(mae_c), 6) AS avg_mae_c, round(avg(mfe_c), 6) AS avg_mfe_c, round(avg(fb), 6) AS avg_fall_c, max(fb) AS max_fall_c,
  round(abs(avg(pnl_c) FILTER (pnl_c > 0) / avg(pnl_c) FILTER (pnl_c < 0)), 6) AS win_loss_ratio, CAST(min(least(0, run - peak)) AS BIGINT) AS max_drawdown_c FROM q GROUP BY ALL)
SELECT a.*, CASE WHEN gross_loss_c < 0 THEN round(gross_profit_c / -gross_loss_c, 6) END AS profit_factor, gross_loss_c = 0 AS no_losses, round(wins / n, 6) AS win_rate, round(n / days, 6) AS per_day, coalesce(mw, 0) AS max_wins, coalesce(ml, 0) AS max_losses
FROM a JOIN st ON st.account = a.account AND st.direction = a.direction JOIN dy ON dy.account = a.account""")
def o64_columns(spark, d):
    return T.performance_columns(_listed(spark, d), mappings.ORDER)


RUN = f"""{TRADES}, ru AS (SELECT *, CAST(sum(pnl_c) OVER (PARTITION BY account ORDER BY trade_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM trades_c),
pk AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY account ORDER BY trade_no ROWS UNBOUNDED PRECEDING)) AS peak FROM ru)"""


@query("o66_daily", f"WITH {RUN} SELECT account, CAST(d AS VARCHAR) AS d, count(*) AS n, CAST(sum(pnl_c) AS BIGINT) AS net_c, arg_max(run, trade_no) AS cum_c, min(least(0, run - peak)) AS day_drawdown_c, round(avg(mfe_c - pnl_c), 6) AS avg_etd_c, max(coalesce(fall_c, mfe_c - mae_c)) AS max_fall_c FROM pk GROUP BY account, pk.d")
def o66(spark, d):
    return _text(T.daily_rows(_trades(spark, d)), "d")


#: Thirds of the trading dates; below three dates all is in the first.
PARTS = """e AS (SELECT *, CASE WHEN m < 3 THEN 9 ELSE round_even(m / 3, 0) END AS e1, CASE WHEN m < 3 THEN 9 ELSE round_even(2 * m / 3, 0) END AS e2 FROM n),
s3 AS (SELECT account, CAST(coalesce(sum(p) FILTER (i < e1), 0) AS BIGINT) AS part_1_c, CAST(coalesce(sum(p) FILTER (i >= e1 AND i < e2), 0) AS BIGINT) AS part_2_c, CAST(coalesce(sum(p) FILTER (i >= e2), 0) AS BIGINT) AS part_3_c FROM e GROUP BY account),
sp3 AS (SELECT *, CAST(part_1_c > 0 AS INT) + CAST(part_2_c > 0 AS INT) + CAST(part_3_c > 0 AS INT) AS positive FROM s3)"""


@query("o67_subperiods", f"""WITH {TRADES}, dy AS (SELECT account, d, sum(pnl_c) AS p FROM trades_c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY account) AS m FROM dy),
{PARTS}
SELECT account, part_1_c, part_2_c, part_3_c, positive FROM sp3""")
def o67(spark, d):
    return T.subperiods(_trades(spark, d))


@query("o68_pool", f"WITH {TRADES} SELECT account, CAST(d AS VARCHAR) AS d, count(*) AS width, CAST(sum(pnl_c) AS BIGINT) AS pnl_c, arg_min(pnl_c, trade_no) AS first_c FROM trades_c GROUP BY account, trades_c.d")
def o68(spark, d):
    p = T.day_pool(_trades(spark, d))
    return _text(p, "d").select("account", "d", F.size("trades").cast("long").alias("width"), F.aggregate("trades", F.lit(0).cast("long"), lambda a, t: a + t["pnl_c"]).alias("pnl_c"), F.element_at("trades", 1)["pnl_c"].alias("first_c"))


@query("o69_distinct_days", f"WITH {TRADES}, dy AS (SELECT account, d, sum(pnl_c) AS p FROM trades_c GROUP BY ALL) SELECT account, count(*) AS n_days, count(DISTINCT p) AS distinct_days FROM dy GROUP BY account")
def o69(spark, d):
    return T.daily_pnl(_trades(spark, d)).groupBy("account").agg(F.count(F.lit(1)).alias("n_days"), F.count_distinct("pnl_c").alias("distinct_days"))


@query("o71_histogram", f"""WITH {TRADES}, dy AS (SELECT account, d, CAST(sum(pnl_c) AS BIGINT) AS p FROM trades_c GROUP BY ALL), l AS (SELECT CAST(min(p) AS DOUBLE) AS a, CAST(max(p) AS DOUBLE) AS z FROM dy)
SELECT CAST(least(floor((p - a) / ((z - a) / 28)), 27) AS BIGINT) AS bin, count(*) AS n FROM dy, l GROUP BY 1""")
def o71(spark, d):
    return T.histogram(T.daily_pnl(_trades(spark, d)), "pnl_c")


@query("o81_drawdown", f"WITH {RUN} SELECT account, min(least(0, run - peak)) AS max_drawdown_c FROM pk GROUP BY account")
def o81(spark, d):
    return T.drawdown(_trades(spark, d))


@query("o82_streaks", f"""WITH {TRADES}, k AS (SELECT account, trade_no, sign(pnl_c) AS k FROM trades_c), i AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY trade_no) - row_number() OVER (PARTITION BY account, k ORDER BY trade_no) AS island FROM k),
r AS (SELECT account, k, island, count(*) AS n FROM i GROUP BY ALL) SELECT account, coalesce(max(n) FILTER (k > 0), 0) AS max_wins, coalesce(max(n) FILTER (k < 0), 0) AS max_losses FROM r GROUP BY account""")
def o82(spark, d):
    return T.streaks(_trades(spark, d))


# ---- path folds --------------------------------------------------------------------------

#: Synthetic rule sets in cents.
BASE = {"start": 5_000_000, "target": 300_000, "max_dd": 200_000, "hwm": "none", "breach": "intraday", "lock": None, "day_loss": None, "soft": False, "min_days": 0, "consistency": None}
RULE_SETS = {
    "static": BASE, "eod": BASE | {"hwm": "eod", "lock": 10_000, "min_days": 2}, "close": BASE | {"hwm": "eod", "breach": "realized"}, "intra": BASE | {"hwm": "intraday"},
    "dll_hard": BASE | {"day_loss": 100_000}, "dll_soft": BASE | {"day_loss": 100_000, "soft": True}, "consistency": BASE | {"hwm": "eod", "consistency": 0.5},
}


def _replay(name: str) -> Query:
    return lambda spark, d: P.replay(_trades(spark, d), RULE_SETS[name])


def replay_sql(r: dict) -> str:
    """The walk of one rule set as a recursion over each account's trades."""
    null = lambda v: "NULL" if v is None else str(v)
    intra, strict, eod = r["hwm"] == "intraday", r["breach"] == "intraday", r["hwm"] == "eod"
    cap = "NULL" if r["lock"] is None else str(r["start"] + r["lock"])
    broken = f"greatest(hwm - bal - lo, fall) >= {r['max_dd']} AND ({cap} IS NULL OR bal + lo <= {cap})" if intra else f"bal + lo <= least(hwm - {r['max_dd']}, {cap})"
    need = str(r["target"]) if r["consistency"] is None else f"greatest({r['target']}, best / {r['consistency']})"

    def closed(source: str, closing: str, rest: str) -> str:
        inner = f"SELECT *, {closing} AS cl FROM {source}"
        mid = f"SELECT * REPLACE (days + CASE WHEN cl THEN 1 ELSE 0 END AS days, CASE WHEN cl AND {eod} THEN greatest(hwm, bal) ELSE hwm END AS hwm, CASE WHEN cl THEN greatest(best, bal - opn) ELSE best END AS best) FROM ({inner})"
        return f"SELECT * REPLACE (CASE WHEN cl AND bal - {r['start']} >= {need} AND days >= {r['min_days']} THEN 'passed' ELSE outcome END AS outcome, CASE WHEN cl AND bal - {r['start']} >= {need} AND days >= {r['min_days']} THEN 'target' ELSE reason END AS reason{rest}) FROM ({mid})"

    joined = "(SELECT w.*, t.d AS td, t.pnl_c AS pnl, least(t.mae_c, t.pnl_c) AS lo, greatest(t.mfe_c, t.pnl_c) AS hi, greatest(coalesce(t.fall_c, t.mfe_c - t.mae_c), -least(t.mae_c, t.pnl_c)) AS fall, (w.d IS NULL OR w.d <> t.d) AS fresh FROM w JOIN trades_c t ON t.account = w.account AND t.trade_no = w.k + 1)"
    s1 = closed(joined, "fresh AND d IS NOT NULL AND outcome = 'open'", ", CASE WHEN fresh THEN bal ELSE opn END AS opn, CASE WHEN fresh THEN FALSE ELSE paused END AS paused")
    s2 = f"SELECT *, outcome = 'open' AND NOT paused AS act FROM ({s1})"
    s3 = f"SELECT *, act AND {strict} AND ({broken}) AS br FROM ({s2})"
    s4 = f"SELECT * REPLACE (CASE WHEN act AND NOT br AND {intra} THEN greatest(hwm, bal + hi) ELSE hwm END AS hwm, CASE WHEN act THEN least(low, bal + lo) ELSE low END AS low, CASE WHEN act AND NOT br THEN bal + pnl ELSE bal END AS bal) FROM ({s3})"
    s5 = f"SELECT *, act AND NOT br AND NOT {strict} AND bal <= least(hwm - {r['max_dd']}, {cap}) AS cb FROM ({s4})"
    s6 = f"SELECT *, act AND NOT br AND NOT cb AND {null(r['day_loss'])} IS NOT NULL AND bal - opn <= -coalesce({null(r['day_loss'])}, 0) AS dl FROM ({s5})"
    out = f"CASE WHEN br OR cb OR (dl AND NOT {r['soft']}) THEN 'busted' ELSE outcome END, CASE WHEN br THEN 'inside the trade' WHEN cb THEN 'at the close' WHEN dl AND NOT {r['soft']} THEN 'day loss' ELSE reason END, paused OR (dl AND {r['soft']}), n + CASE WHEN act THEN 1 ELSE 0 END"
    z = f"CAST({r['start']} AS BIGINT)"
    last = closed("(SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM trades_c t WHERE t.account = w.account AND t.trade_no = w.k + 1))", "d IS NOT NULL AND outcome = 'open'", "")
    return f"""WITH RECURSIVE {TRADES}, w AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS d, {z} AS bal, {z} AS hwm, {z} AS low, CAST(0 AS BIGINT) AS best, CAST(0 AS BIGINT) AS days, {z} AS opn, 'open' AS outcome, '' AS reason, FALSE AS paused, CAST(0 AS BIGINT) AS n FROM trades_c
UNION ALL SELECT account, k + 1, td, bal, hwm, low, best, days, opn, {out} FROM ({s6}))
SELECT account, outcome, reason, days, n AS n_trades, bal AS balance_c, low AS low_water_c, best AS best_day_c FROM ({last})"""


for _name in RULE_SETS:
    query(f"o114_replay_{_name}", replay_sql(RULE_SETS[_name]))(_replay(_name))


@query("o115_bootstrap")
def o115(spark, d):
    return P.bootstrap_rollup(_listed(spark, d), RULE_SETS["eod"], paths=20_000, days=90, order=mappings.ORDER)


@query("o119_day_draw", """SELECT p AS path, y AS day, CAST(('0x' || substr(md5(concat_ws(':', '7', p, y)), 1, 8)) AS BIGINT) % 540 AS i FROM (SELECT unnest(range(200)) AS p) a, (SELECT unnest(range(90)) AS y) b""")
def o119(spark, d):
    grid = spark.range(200).select(F.col("id").alias("path")).withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long")))).withColumn("n", F.lit(540).cast("long"))
    return grid.select("path", "day", P.day_draw("path", "day", "n", 7).alias("i"))


@query("o46_changed_inputs", f"""WITH {TICKS}, a AS (SELECT contract, cal_day, sum(vol) AS v FROM ticks WHERE cal_day < DATE '2024-01-20' AND NOT (cal_day = DATE '2024-01-10' AND side = 1) GROUP BY ALL),
b AS (SELECT contract, cal_day, sum(vol) AS v FROM ticks WHERE cal_day > DATE '2024-01-03' GROUP BY ALL)
SELECT contract, CAST(cal_day AS VARCHAR) AS cal_day, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'gone' ELSE 'changed' END AS status FROM a FULL JOIN b USING (contract, cal_day) WHERE a.v IS DISTINCT FROM b.v""")
def o46(spark, d):
    t = _ticks(spark, d)
    old = B.daily_volume(t.where("cal_day < date'2024-01-20' and not (cal_day = date'2024-01-10' and side = 1)"))
    new = B.daily_volume(t.where("cal_day > date'2024-01-03'"))
    return _text(C.changed_inputs(old, new, ["contract", "cal_day"], "volume"), "cal_day")


@query("o118_bernoulli", """WITH g AS (SELECT p AS path, s AS slot, CAST(('0x' || substr(md5(concat_ws(':', '7', p, s)), 1, 8)) AS BIGINT) < 1932735283 AS won FROM (SELECT unnest(range(300)) AS p) a, (SELECT unnest(range(20)) AS s) b)
SELECT path, slot, CAST(CASE WHEN won THEN 40000 ELSE -20000 END - 500 AS BIGINT) AS pnl_c, CAST(CASE WHEN won THEN -10000 ELSE -20000 END AS BIGINT) AS mae_c, CAST(CASE WHEN won THEN 40000 ELSE 20000 END AS BIGINT) AS mfe_c FROM g""")
def o118(spark, d):
    grid = spark.range(300).select(F.col("id").alias("path")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    return P.parametric_trades(grid, 0.45, 2.0, 20_000, 500)


@query("o36_thin_sample", f"WITH {TRADES}, dy AS (SELECT account, d, sum(pnl_c) AS p FROM trades_c GROUP BY ALL), s AS (SELECT account, least(count(*), count(DISTINCT p)) AS sample FROM dy GROUP BY account) SELECT account, sample, sample < 10 AS withheld, sample >= 60 AS meaningful FROM s")
def o36(spark, d):
    return L.sample_gate(T.daily_pnl(_trades(spark, d)))


# ---- joins on executions and runs --------------------------------------------------------

PAIRS = f"""{EXECUTIONS}, ex AS (SELECT *, lag(seq) OVER w AS ps, lag(us) OVER w AS pu, lag(action) OVER w AS pa, lag(is_entry) OVER w AS pe FROM executions WHERE is_entry OR is_exit WINDOW w AS (PARTITION BY account, instrument ORDER BY us, seq)),
pairs AS (SELECT account, instrument, ps AS entry_seq, seq AS exit_seq, pa AS entry_action, action AS exit_action, us - pu AS held_us FROM ex WHERE NOT is_entry AND pe)"""


def _pairs(spark, d):
    return M.pair_executions(mappings.executions(table(spark, d, "events")))


@query("o40_pair_executions", f"WITH {PAIRS} SELECT * FROM pairs")
def o40(spark, d):
    return _pairs(spark, d)


@query("o40_side_check", f"WITH {PAIRS} SELECT entry_action = exit_action AS same_side, count(*) AS n FROM pairs GROUP BY 1")
def o40_side(spark, d):
    return M.side_check(_pairs(spark, d))


@query("o37_executions_orders", "SELECT e.event_id, o.o_orderkey, o.o_orderstatus FROM events e JOIN orders o ON concat('O', o.o_orderkey) = concat('O', e.event_id % 5000)")
def o37(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("O"), F.pmod("event_id", F.lit(5000))).alias("order_id"))
    o = table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("order_id"), "o_orderkey", "o_orderstatus")
    return L.with_orders(e, o).select("event_id", "o_orderkey", "o_orderstatus")


@query("o38_strategy_attribution", f"""WITH {PAIRS}, br AS (SELECT event_id AS execution, concat('S', user_id % 9) AS strategy FROM events WHERE event_id % 3 = 0)
SELECT account, instrument, entry_seq, exit_seq, coalesce(a.strategy, b.strategy, '?') AS strategy FROM pairs LEFT JOIN br a ON a.execution = entry_seq LEFT JOIN br b ON b.execution = exit_seq""")
def o38(spark, d):
    bridge = table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("execution"), F.concat(F.lit("S"), F.pmod("user_id", F.lit(9))).alias("strategy"))
    return M.attributed(_pairs(spark, d), bridge)


#: Synthetic prefixes of account names.
PREFIXES = [("SIM", "sim", 1), ("SIMHUB", "hub", 2), ("NLX", "north", 3), ("NLXEV", "north evaluation", 4), ("VEL-", "velo", 5), ("ORN", "orn", 6)]


@query("o47_prefix_match", "WITH p(prefix, label, prefix_no) AS (VALUES ('SIM','sim',1),('SIMHUB','hub',2),('NLX','north',3),('NLXEV','north evaluation',4),('VEL-','velo',5),('ORN','orn',6)) SELECT account, coalesce((SELECT arg_max(label, length(prefix)) FROM p WHERE starts_with(upper(account), prefix)), '?') AS label FROM accounts")
def o47(spark, d):
    p = spark.createDataFrame(PREFIXES, "prefix string, label string, prefix_no int")
    return M.longest_prefix(table(spark, d, "accounts").select("account"), p, "account")


#: Synthetic variants of accounts: families with a phase word, plain ones, retired ones.
CONTRACTS = """ct AS (SELECT DISTINCT CAST(provider AS VARCHAR) AS firm, phase, account_size AS size, account_size // 20 + account_no % 2 AS max_dd,
  ['core', 'flex-path', 'pro', 'one', 'swift_plan'][1 + account_no % 5] || CASE WHEN phase = 'evaluation' THEN ['', '_eval', '-evaluation'][1 + account_no % 3] ELSE ['', '_funded', '_sim_account', '_legacy'][1 + account_no % 4] END AS variant
  FROM accounts WHERE phase IS NOT NULL AND account_size IS NOT NULL AND provider IS NOT NULL)"""


@query("o48_phase_chain", f"""WITH {CONTRACTS}, ev AS (SELECT firm, variant, size, min(max_dd) AS max_dd FROM ct WHERE phase = 'evaluation' GROUP BY ALL), fu AS (SELECT firm, variant, size, min(max_dd) AS dd FROM ct WHERE phase = 'funded_sim' GROUP BY ALL),
sz AS (SELECT firm, variant, count(*) AS n FROM fu GROUP BY ALL),
st AS (SELECT variant, list_filter(string_split(replace(lower(variant), '-', '_'), '_'), lambda w: w <> '' AND w NOT IN ('eval', 'evaluation', 'funded', 'sim', 's2f', 'account', 'path', 'default', 'plan', 'current')) AS w FROM (SELECT DISTINCT variant FROM ct)),
pr AS (SELECT ev.firm, ev.variant, ev.size, fu.variant AS v, fu.variant = ev.variant AS same, regexp_matches(lower(fu.variant), 'retired|legacy|sunset') AS old, len(list_intersect(a.w, b.w)) AS shared, fu.dd <> ev.max_dd AS off, sz.n
  FROM ev JOIN fu ON fu.firm = ev.firm AND fu.size = ev.size JOIN sz ON sz.firm = fu.firm AND sz.variant = fu.variant JOIN st a ON a.variant = ev.variant JOIN st b ON b.variant = fu.variant),
lv AS (SELECT *, bool_or(NOT old) OVER (PARTITION BY firm, variant, size) AS any_live, bool_or(same) OVER (PARTITION BY firm, variant, size) AS any_same FROM pr),
ch AS (SELECT *, row_number() OVER (PARTITION BY firm, variant, size ORDER BY shared DESC, off, n DESC, v) AS rn FROM lv WHERE CASE WHEN any_same THEN same ELSE NOT any_live OR NOT old END)
SELECT ev.firm, ev.variant, ev.size, ch.v AS next_variant, CASE WHEN ch.v IS NULL THEN 'none' WHEN ch.same THEN 'exact' WHEN ch.shared > 0 THEN 'family' ELSE 'inferred' END AS quality
FROM ev LEFT JOIN ch ON ch.firm = ev.firm AND ch.variant = ev.variant AND ch.size = ev.size AND ch.rn = 1""")
def o48(spark, d):
    rows = table(spark, d, "accounts").where("phase is not null and account_size is not null and provider is not null")
    part = lambda n, *x: F.get(F.array(*map(F.lit, x)), F.pmod("account_no", F.lit(n)).cast("int"))
    ending = F.when(F.col("phase") == "evaluation", part(3, "", "_eval", "-evaluation")).otherwise(part(4, "", "_funded", "_sim_account", "_legacy"))
    contracts = rows.select(F.col("provider").cast("string").alias("firm"), "phase", F.col("account_size").alias("size"), (F.floor(F.col("account_size") / 20) + F.pmod("account_no", F.lit(2))).alias("max_dd"), F.concat(part(5, "core", "flex-path", "pro", "one", "swift_plan"), ending).alias("variant"))
    least = contracts.groupBy("firm", "variant", "phase", "size").agg(F.min("max_dd").alias("max_dd"))
    return M.phase_chain(least)


def _json_time(e: str) -> str:
    """ISO time to the second of a JSON value: an object of day and time, a text, seconds or milliseconds since 1970."""
    text = f"replace(trim({e}->>'$'), ' ', 'T')"
    number = f"CAST({e} AS DOUBLE)"
    return f"""CASE json_type({e}) WHEN 'OBJECT' THEN concat({e}->>'$.day', 'T', {e}->>'$.time') WHEN 'VARCHAR' THEN CASE WHEN length({text}) = 16 THEN {text} || ':00' ELSE left({text}, 19) END
  ELSE strftime(make_timestamp(CAST({number} * CASE WHEN abs({number}) > 1e11 THEN 1e3 ELSE 1e6 END AS BIGINT)), '%Y-%m-%dT%H:%M:%S') END"""


def _any_of(*names: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract(t, '$.{n}')" for n in names) + ")"


@query("o73_import_dedup", f"""WITH r AS (SELECT run_id, unnest(json_extract(trades, '$[*]')) AS t FROM backtests), x AS (SELECT run_id, {_any_of("entry", "Entry", "EntryTime", "entry_time", "opened")} AS e, {_any_of("exit", "Exit", "ExitTime", "exit_time", "closed")} AS z FROM r),
f1 AS (SELECT run_id, min({_json_time("e")}) AS fe FROM x WHERE json_type(e) <> 'NULL' AND json_type(z) <> 'NULL' GROUP BY run_id),
k AS (SELECT run_id, upper(trim(instrument)) AS ins, n_trades, perf_cum_profit AS p, fe, NOT (source IS NOT DISTINCT FROM 'nt8-performance-metric' OR fill_resolution IS NULL) AS known FROM backtests LEFT JOIN f1 USING (run_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY ins, n_trades, p, fe ORDER BY known DESC, run_id DESC) AS rn FROM k WHERE ins IS NOT NULL AND n_trades IS NOT NULL AND p IS NOT NULL AND fe IS NOT NULL)
SELECT run_id FROM f WHERE rn = 1 UNION ALL SELECT run_id FROM k WHERE ins IS NULL OR n_trades IS NULL OR p IS NULL OR fe IS NULL""")
def o73(spark, d):
    """One run of equal instrument, count, result and first entry, whose fills' configuration is recorded if any's is. The SQL knows the names of the test tables."""
    runs = table(spark, d, "backtests")
    first = M.first_entries(unified_records(runs, table(spark, d, "trade_fields")))
    keyed = runs.select("run_id", F.upper(F.trim("instrument")).alias("ins"), "n_trades", F.col("perf_cum_profit").alias("p"), M.capture_level().alias("level")).join(first, "run_id", "left")
    return M.dedup_runs(keyed, ["ins", "n_trades", "p", "first_entry"], "level", "run_id").select("run_id")


#: Runs and, with other values of the same columns, runs that the tables lack: High resolution of wide or non-tick bars, bars of several ticks, no value.
LEVEL = """CASE WHEN source = 'nt8-performance-metric' OR fill_resolution IS NULL THEN 'unknown' WHEN fill_resolution = 'High' AND fill_resolution_type = 'Tick' AND coalesce(fill_resolution_value, 0) <= 1 THEN 'exact'
  WHEN bar_type = 'Tick' AND coalesce(bar_value, 0) <= 1 THEN 'exact' ELSE 'fills-guessed' END"""


@query("o135_fidelity", f"""SELECT run_id, {LEVEL} AS level FROM backtests UNION ALL SELECT run_id || '/2', {LEVEL} FROM (SELECT run_id, source, CASE WHEN n_trades % 3 = 0 THEN 'High' WHEN n_trades % 3 = 1 THEN fill_resolution END AS fill_resolution,
  CASE WHEN n_trades % 2 = 0 THEN 'Tick' ELSE 'Minute' END AS fill_resolution_type, CASE WHEN n_trades % 5 > 0 THEN CAST(n_trades % 5 AS DOUBLE) END AS fill_resolution_value, CASE WHEN n_trades % 7 < 3 THEN 'Tick' ELSE bar_type END AS bar_type, bar_value * (n_trades % 4) AS bar_value FROM backtests)""")
def o135(spark, d):
    runs = table(spark, d, "backtests")
    mod = lambda k: F.pmod("n_trades", F.lit(k))
    other = runs.select(F.concat("run_id", F.lit("/2")).alias("run_id"), "source", F.when(mod(3) == 0, "High").when(mod(3) == 1, F.col("fill_resolution")).alias("fill_resolution"), F.when(mod(2) == 0, "Tick").otherwise("Minute").alias("fill_resolution_type"),
                        F.when(mod(5) > 0, mod(5).cast("double")).alias("fill_resolution_value"), F.when(mod(7) < 3, "Tick").otherwise(F.col("bar_type")).alias("bar_type"), (F.col("bar_value") * mod(4)).alias("bar_value"), "n_trades")
    return runs.select("run_id", M.fidelity().alias("level")).unionByName(other.select("run_id", M.fidelity().alias("level")))


@query("o136_cost_basis", f"""WITH {TRADES}, s AS (SELECT account, CAST(sum(pnl_c) AS DOUBLE) AS profit, CAST(sum(comm_c) AS DOUBLE) AS costs FROM trades_c GROUP BY account),
r AS (SELECT *, CASE WHEN account % 5 IN (0, 3) THEN profit WHEN account % 5 = 1 THEN profit + 2 * abs(profit) + 9 END AS cum, CASE WHEN account % 5 IN (1, 2, 3) THEN profit * 2 - CASE WHEN account % 10 = 2 THEN abs(profit) ELSE 0 END END AS gp, CASE WHEN account % 5 IN (1, 2, 3) THEN -profit END AS gl FROM s),
t AS (SELECT *, greatest(1.0, 0.005 * abs(profit)) AS tol FROM r),
b AS (SELECT account, CASE WHEN abs(profit - cum) <= tol AND costs > tol THEN 'net' WHEN abs(profit - (gp + gl)) <= tol THEN 'gross' WHEN cum IS NULL AND gp IS NULL AND gl IS NULL THEN 'no totals' ELSE 'unreconciled' END AS basis FROM t)
SELECT account AS run_id, basis, basis <> 'net' AS subtract_costs FROM b""")
def o136(spark, d):
    """An account's trades as one run, with totals that are net, gross, neither or missing."""
    rows = _trades(spark, d).select(F.col("account").alias("run_id"), F.col("pnl_c").cast("double").alias("profit"), F.col("comm_c").cast("double").alias("commission"), F.lit(None).cast("double").alias("fee"))
    s = rows.groupBy("run_id").agg(F.sum("profit").alias("p"))
    k, p = F.pmod("run_id", F.lit(5)), F.col("p")
    runs = s.select("run_id", F.when(k.isin(0, 3), p).when(k == 1, p + 2 * F.abs(p) + 9).alias("perf_cum_profit"), F.when(k.isin(1, 2, 3), p * 2 - F.when(F.pmod("run_id", F.lit(10)) == 2, F.abs(p)).otherwise(0)).alias("perf_gross_profit"), F.when(k.isin(1, 2, 3), -p).alias("perf_gross_loss"))
    return M.cost_basis(runs, rows)


@query("o136_cost_basis_runs")
def o136_runs(spark, d):
    """The captured runs, with the profits of their listed trades under whatever names."""
    runs = table(spark, d, "backtests")
    return M.cost_basis(runs.dropDuplicates(["run_id"]), unified_records(runs.dropDuplicates(["run_id"]), table(spark, d, "trade_fields")))


# ---- continuous series -------------------------------------------------------------------


def _two(spark, d):
    """Two contracts, of which the later one's name sorts first, 960 ticks apart; volume
    leadership passes in mid-month, and on some days behind that only the sooner one trades."""
    t = _ticks(spark, d)
    day = F.dayofmonth("cal_day")
    second = F.col("contract") == "F2"
    t = t.where(~(second & day.isin(24, 27)))
    named = F.when(second, "EV 03-24").otherwise("EV 12-23")
    return t.withColumn("px_ticks", F.col("px_ticks") + F.when(second, 960).otherwise(0)).withColumn("vol", F.col("vol") * F.when(second, day).otherwise(31 - day)).withColumn("contract", named)


TWO = f"""{TICKS}, two AS (SELECT CASE WHEN contract = 'F2' THEN 'EV 03-24' ELSE 'EV 12-23' END AS contract, seq, us, cal_day, px_ticks + CASE WHEN contract = 'F2' THEN 960 ELSE 0 END AS px_ticks, vol * CASE WHEN contract = 'F2' THEN day(cal_day) ELSE 31 - day(cal_day) END AS vol
  FROM ticks WHERE NOT (contract = 'F2' AND day(cal_day) IN (24, 27))),
dv AS (SELECT cal_day, contract, CAST(right(contract, 2) AS INT) * 100 + CAST(left(right(contract, 5), 2) AS INT) AS mk, sum(vol) AS v FROM two GROUP BY ALL),
dl AS (SELECT cal_day, row_number() OVER (ORDER BY cal_day) AS i, list(struct_pack(mk := mk, c := contract) ORDER BY v DESC, mk) AS l FROM dv GROUP BY cal_day),
fs AS (SELECT CAST(0 AS BIGINT) AS i, struct_pack(mk := 0, c := '') AS x UNION ALL SELECT dl.i, coalesce(list_filter(dl.l, lambda y: y.mk >= fs.x.mk)[1], dl.l[1]) FROM fs JOIN dl ON dl.i = fs.i + 1),
fr AS (SELECT dl.cal_day, fs.x.c AS contract FROM fs JOIN dl ON dl.i = fs.i)"""
SPREAD = """rl AS (SELECT * FROM (SELECT cal_day, lag(contract) OVER (ORDER BY cal_day) AS from_contract, contract AS to_contract FROM fr) WHERE from_contract <> to_contract),
hr AS (SELECT cal_day, contract, us // 1800000000 AS cell, arg_max(px_ticks, seq) AS px FROM two GROUP BY ALL),
df AS (SELECT rl.cal_day, b.px - a.px AS d FROM rl JOIN hr a ON a.cal_day = rl.cal_day AND a.contract = rl.from_contract JOIN hr b ON b.cal_day = rl.cal_day AND b.contract = rl.to_contract AND b.cell = a.cell),
sp AS (SELECT rl.cal_day, rl.from_contract, rl.to_contract, count(d) AS n, CASE WHEN count(d) >= 5 THEN CAST(quantile_cont(d, 0.5) AS DOUBLE) END AS spread FROM rl LEFT JOIN df USING (cal_day) GROUP BY ALL)"""


@query("o56_front_months", f"WITH RECURSIVE {TWO} SELECT CAST(cal_day AS VARCHAR) AS cal_day, contract FROM fr")
def o56(spark, d):
    return _text(C.front_contracts(B.daily_volume(_two(spark, d))), "cal_day")


@query("o57_roll_spread", f"WITH RECURSIVE {TWO}, {SPREAD} SELECT CAST(cal_day AS VARCHAR) AS cal_day, from_contract, to_contract, n, spread FROM sp")
def o57(spark, d):
    t = _two(spark, d)
    return _text(C.roll_spread(t, C.front_contracts(B.daily_volume(t)), 1_800_000_000, 5), "cal_day")


ADJ = f"""{TWO}, {SPREAD},
aj AS (SELECT t.seq, t.us, t.cal_day, t.px_ticks, coalesce((SELECT sum(spread) FROM sp WHERE sp.cal_day > t.cal_day), 0) AS offset_ FROM two t JOIN fr ON fr.cal_day = t.cal_day AND fr.contract = t.contract)"""


def _stitched(spark, d):
    t = _two(spark, d)
    return C.continuous(t, B.daily_volume(t), 1_800_000_000, 5)


def _adjusted(spark, d):
    return _stitched(spark, d)[0]


@query("o100_back_adjust", f"WITH RECURSIVE {ADJ} SELECT seq, CAST(px_ticks + offset_ AS DOUBLE) AS px_adj, CAST(offset_ AS DOUBLE) AS shift FROM aj")
def o100(spark, d):
    return _adjusted(spark, d).select("seq", "px_adj", F.col("offset").alias("shift"))


@query("o43_to_raw", f"WITH RECURSIVE {ADJ} SELECT seq, CAST(px_ticks AS DOUBLE) AS px_raw FROM aj")
def o43(spark, d):
    a = _adjusted(spark, d)
    return C.to_raw(a.drop("offset"), a).select("seq", "px_raw")


@query("o137_audit", f"""WITH RECURSIVE {ADJ}, l AS (SELECT cal_day, us < lag(us) OVER w AS late, abs((px_ticks + offset_) - lag(px_ticks + offset_) OVER w) >= 40 AS wide FROM aj WINDOW w AS (PARTITION BY cal_day ORDER BY seq))
SELECT CAST(cal_day AS VARCHAR) AS cal_day, count(*) FILTER (late) AS unsorted, count(*) FILTER (wide) AS wide_steps, count(*) AS n FROM l GROUP BY l.cal_day""")
def o137(spark, d):
    return _text(C.audit(_adjusted(spark, d), 40), "cal_day")


#: Least intraday step, largest gap between weekdays and roll spreads in ticks of 0.25 points: the reference's 150, 175 and 150 to 350 points.
STEP, GAP, BAND = 600.0, 700.0, (600.0, 1400.0)


@query("o137_violations", f"""WITH RECURSIVE {ADJ}, ad AS (SELECT seq, us, cal_day, px_ticks + offset_ AS px FROM aj),
l AS (SELECT cal_day, us < lag(us) OVER w AS late, abs(px - lag(px) OVER w) >= {STEP} AS wide FROM ad WINDOW w AS (PARTITION BY cal_day ORDER BY seq)),
dy AS (SELECT cal_day, arg_min(px, seq) AS first_px, arg_max(px, seq) AS last_px FROM ad GROUP BY cal_day),
gp AS (SELECT b.cal_day, abs(b.first_px - a.last_px) AS gap FROM dy b JOIN dy a ON a.cal_day + 1 = b.cal_day WHERE isodow(b.cal_day) <= 5 AND isodow(a.cal_day) <= 5),
rs AS (SELECT cal_day, spread FROM sp),
v AS (SELECT cal_day, 'unsorted' AS problem, count(*) AS n, CAST(NULL AS DOUBLE) AS size FROM l WHERE late GROUP BY l.cal_day
UNION ALL SELECT cal_day, 'wide step', count(*), NULL FROM l WHERE wide GROUP BY l.cal_day
UNION ALL SELECT cal_day, 'session gap', 1, gap FROM gp WHERE gap > {GAP}
UNION ALL SELECT cal_day, CASE WHEN spread IS NULL THEN 'no spread' ELSE 'spread' END, 1, spread FROM rs WHERE spread IS NULL OR spread < {BAND[0]} OR spread > {BAND[1]})
SELECT CAST(cal_day AS VARCHAR) AS cal_day, problem, n, size FROM v""")
def o137_violations(spark, d):
    """All four checks of the reference; o137_audit keeps the counts of two of them per day."""
    series, _, spreads = _stitched(spark, d)
    return _text(C.violations(series, spreads, STEP, GAP, BAND), "cal_day")


@query("o107_window_break")
def o107(spark, d):
    from .operators.window_break import BreakRules, window_break
    rules = BreakRules(window_s=14_400, candle_s=3_600, hold_s=600, extension=0.1, min_range=2, stop_mult=1.0, per_window=2)
    return _text(window_break(_ticks(spark, d), _bars(spark, d), HOUR, rules), "cal_day")


@query("o138_continuous", f"""WITH RECURSIVE {ADJ} SELECT CAST(cal_day AS VARCHAR) AS cal_day, count(*) AS n, CAST(arg_min(px_ticks + offset_, seq) AS DOUBLE) AS o, CAST(max(px_ticks + offset_) AS DOUBLE) AS h, CAST(min(px_ticks + offset_) AS DOUBLE) AS l, CAST(arg_max(px_ticks + offset_, seq) AS DOUBLE) AS c FROM aj GROUP BY aj.cal_day""")
def o138(spark, d):
    """The stitched series by day: front contract, measured roll, adjusted prices."""
    return _text(_adjusted(spark, d).groupBy("cal_day").agg(F.count(F.lit(1)).alias("n"), F.min_by("px_adj", "seq").alias("o"), F.max("px_adj").alias("h"), F.min("px_adj").alias("l"), F.max_by("px_adj", "seq").alias("c")), "cal_day")


# ---- sweeps, statistics, ledger ----------------------------------------------------------

#: Sweep of the crossing averages: fast and slow lengths.
SWEEP = {"fast": [2.0, 3.0], "slow": [6.0, 8.0]}


@query("o49_grid", "SELECT CAST(row_number() OVER (ORDER BY f, s) - 1 AS BIGINT) AS combo_no, CAST(f AS DOUBLE) AS fast, CAST(s AS DOUBLE) AS slow FROM (VALUES (2), (3)) a(f), (VALUES (6), (8)) b(s)")
def o49(spark, d):
    return stats.grid(spark, SWEEP)


def _combo_sql(no: int, fast: int, slow: int) -> str:
    cross = CROSS.replace("ROWS 2 PRECEDING) * 8", f"ROWS {fast - 1} PRECEDING) * {slow}").replace("ROWS 7 PRECEDING) * 3", f"ROWS {slow - 1} PRECEDING) * {fast}").replace("CASE WHEN bar_no >= 7 THEN sum", f"CASE WHEN bar_no >= {slow - 1} THEN sum").replace("WHERE bar_no >= 8 AND", f"WHERE bar_no >= {slow} AND")
    return f"SELECT CAST({no} AS BIGINT) AS combo_no, count(*) AS n, round(sum(pnl), 6) AS pnl, round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END), 6) AS win_rate FROM ({resolve_sql(cross, 'tk.px_ticks + dir * 2.0')})"


@query("o133_sweep", " UNION ALL ".join(f"({_combo_sql(i * 2 + j, f, s)})" for i, f in enumerate((2, 3)) for j, s in enumerate((6, 8))))
def o133(spark, d):
    """All combinations in one plan: the combination is a column of the candidates."""
    cands = S.ma_cross_grid(_bars(spark, d), stats.grid(spark, SWEEP).withColumns({"stop_ticks": F.lit(40.0), "rr": F.lit(2.0)}))
    done = X.resolve(_ticks(spark, d), cands, RULES)
    return done.groupBy("combo_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 6).alias("pnl"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 6).alias("win_rate"))


@query("o133_sweep_ranked")
def o133_ranked(spark, d):
    """200 combinations of the crossing averages, judged and ranked."""
    from . import api
    ranges = {"fast": [float(x) for x in range(2, 12)], "slow": [float(x) for x in range(12, 52, 2)]}
    out = api.sweep(_ticks(spark, d), "ma_cross", ranges, "1h", RULES)
    return out.select("combo_no", "fast", "slow", "n", F.round("pnl", 6).alias("pnl"), "days", _r("t_daily"), "positive", "verdict", "place")


T_SQL = f"""{TRADES}, dy AS (SELECT account, d, CAST(sum(pnl_c) AS BIGINT) AS p FROM trades_c GROUP BY ALL), cn AS (SELECT account, count(*) AS trades FROM trades_c GROUP BY account),
n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY account) AS m FROM dy), {PARTS},
t AS (SELECT account, CASE WHEN count(*) >= 20 AND stddev_samp(p) > 0 THEN round(avg(p) / (stddev_samp(p) / sqrt(count(*))), 6) END AS t FROM dy GROUP BY account)"""


def _judged(spark, d):
    """account, t_daily, n (trades), positive (sub-periods above zero)."""
    rows = _trades(spark, d)
    return T.clustered_t(T.daily_pnl(rows)).join(rows.groupBy("account").agg(F.count(F.lit(1)).alias("n")), "account").join(T.subperiods(rows).select("account", "positive"), "account")


@query("o130_verdicts", f"""WITH {T_SQL} SELECT account, CASE WHEN t IS NULL THEN 'no signal' WHEN trades < 80 OR positive < 2 OR t < 1.5 THEN 'below the bar' WHEN t <= 1.9 THEN 'indistinguishable from noise' ELSE 'earns a forward test' END AS verdict FROM t JOIN cn USING (account) JOIN sp3 USING (account)""")
def o130(spark, d):
    return _judged(spark, d).select("account", stats.verdict(F.col("t_daily"), F.col("n"), F.col("positive"), 1.9).alias("verdict"))


@query("o90_rank", f"""WITH {T_SQL} SELECT account, row_number() OVER (ORDER BY (t IS NOT NULL AND trades >= 80 AND positive >= 2) DESC, coalesce(t, -99) DESC, account) AS place FROM t JOIN cn USING (account) JOIN sp3 USING (account)""")
def o90(spark, d):
    return stats.ranked(_judged(spark, d), "account").select("account", "place")


def _ledger(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "backtest").when(F.col("o_orderstatus") == "O", "sweep").otherwise("score")
    return o.select(F.col("o_orderkey").alias("seq"), kind.alias("kind"), F.col("o_custkey").alias("fp"), F.pmod("o_orderkey", F.lit(5)).alias("n_trials"), (F.round(F.col("o_totalprice")) / 100_000).alias("t_daily"), F.pmod("o_orderkey", F.lit(40)).alias("sessions"))


LEDGER = """lg AS (SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'backtest' WHEN 'O' THEN 'sweep' ELSE 'score' END AS kind, o_custkey AS fp, o_orderkey % 5 AS n_trials, round(o_totalprice) / 100000 AS t_daily, o_orderkey % 40 AS sessions FROM orders)"""


@query("o74_ledger_stats", f"WITH {LEDGER}, f AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY seq) AS rn FROM lg) SELECT kind, count(*) AS n, CAST(sum(coalesce(n_trials, 1)) AS BIGINT) AS trials, round(max(t_daily) FILTER (sessions >= 20), 6) AS max_t FROM f WHERE rn = 1 GROUP BY kind")
def o74(spark, d):
    return stats.ledger_stats(_ledger(spark, d)).withColumn("max_t", F.round("max_t", 6))


@query("o76_weekdays", "SELECT o_orderkey, CAST(len(list_filter(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 AS INT), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS BIGINT) AS n FROM orders")
def o76(spark, d):
    first = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", stats.weekdays(first, F.date_add(first, F.pmod("o_custkey", F.lit(60)).cast("int"))).alias("n"))


@query("o127_fingerprint", """SELECT o_orderkey, substr(sha256('{"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}'), 1, 12) AS fp FROM orders""")
def o127(spark, d):
    body = F.concat(F.lit('{"customer":'), F.col("o_custkey").cast("string"), F.lit(',"status":"'), "o_orderstatus", F.lit('"}'))
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(body, 256), 1, 12).alias("fp"))


@query("o128_chain_verify", """WITH RECURSIVE o AS (SELECT o_custkey AS ledger, o_orderkey AS seq, o_orderkey || '|' || o_orderstatus AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
c AS (SELECT ledger, seq, body, rn, '' AS prev, substr(sha256(body), 1, 16) AS own FROM o WHERE rn = 1 UNION ALL SELECT o.ledger, o.seq, o.body, o.rn, c.own, substr(sha256(c.own || o.body), 1, 16) FROM c JOIN o ON o.ledger = c.ledger AND o.rn = c.rn + 1),
e AS (SELECT ledger, seq, prev, own, CASE WHEN seq % 100 = 7 THEN body || '!' ELSE body END AS body FROM c WHERE seq % 100 <> 34),
v AS (SELECT *, lag(own) OVER (PARTITION BY ledger ORDER BY seq) AS p FROM e)
SELECT ledger, seq, CASE WHEN substr(sha256(prev || body), 1, 16) <> own THEN 'edited' ELSE 'broken link' END AS reason FROM v WHERE substr(sha256(prev || body), 1, 16) <> own OR coalesce(p, '') <> prev""")
def o128(spark, d):
    """A ledger for each customer; some records were edited and some taken out afterwards."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ledger"), F.col("o_orderkey").alias("seq"), F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("body"))
    kept = stats.chain(o, "ledger", "seq", "body").where("seq % 100 <> 34")
    edited = kept.withColumn("body", F.when(F.pmod("seq", F.lit(100)) == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return stats.chain_breaks(edited, "ledger", "seq", "body").withColumn("ledger", F.col("ledger").cast("long"))


#: Parameters with which the strategies enter on the sparse test ticks.
PROBED = {"ma_cross": {"fast": 3, "slow": 8}, "orb": {"range_min": 60}, "range_break": {"lookback": 3, "min_range_ticks": 5, "max_range_ticks": 400}, "sweep_follow": {"min_volume": 20, "cluster_ms": 600_000}}


@query("o139_lookahead_probe")
def o139(spark, d):
    """All registered strategies, with cuts one tick behind sampled entries from which
    prices are shifted and sides turned: for each cut the entries up to it that were
    compared, and how many of them changed."""
    from . import api
    ticks, out = _ticks(spark, d), None
    for name, s in api.STRATEGIES.items():
        p = {k: v[0] for k, v in s.params.items()} | PROBED.get(name, {})

        def build(t: DataFrame, s=s, p=p) -> DataFrame:
            part = B.slice_range(t, rth=not s.full_session)
            return s.build(part, B.numbered(B.build_bars(part, HOUR)), HOUR, p)
        one = api.probe_entries(ticks, build).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("o99_contracts", "SELECT DISTINCT upper(trim(regexp_replace(contract, '[_\\s]+', ' ', 'g'))) AS contract FROM tape WHERE contract IS NOT NULL")
def o99(spark, d):
    return L.contracts(table(spark, d, "tape"))


@query("o05_catalog", "WITH c AS (SELECT DISTINCT upper(trim(regexp_replace(contract, '[_\\s]+', ' ', 'g'))) AS contract FROM tape WHERE contract IS NOT NULL UNION SELECT 'ALL') SELECT row_number() OVER (ORDER BY contract <> 'ALL', contract) AS place, contract FROM c")
def o05(spark, d):
    tape = table(spark, d, "tape").select("contract")
    return L.catalog(tape.unionByName(spark.createDataFrame([("ALL",)], "contract string")))


@query("o94_first_rows", f"WITH {TRADES} SELECT account, trade_no, pnl_c FROM trades_c ORDER BY pnl_c DESC, account, trade_no LIMIT 25")
def o94(spark, d):
    return L.first_rows(_trades(spark, d), 25, F.col("pnl_c").desc(), F.col("account"), F.col("trade_no")).select("account", "trade_no", "pnl_c")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
