"""The governed walk keeps limits and breakevens, and counts the day that is named."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom import api
from tickloom.operators import fills as X
from tickloom.sources import mappings

SF = "/root/testdata/sf0.001"
FVG = {"min_ticks": 4, "expiry_bars": 3}
BREAK = {"lookback": 2, "min_range_ticks": 1, "max_range_ticks": 2000}


@pytest.mark.parametrize("name,params", [("fvg", FVG), ("range_break", BREAK)])
def test_governor_out_of_reach_changes_nothing(spark, name, params):
    ticks = mappings.ticks(spark.read.parquet(f"{SF}/events.parquet"))
    rules = {"max_gap_s": 20_000, "cooldown_min": 0}
    a, b = (sorted(tuple(r[c] for c in ("contract", "entry_seq", "fill", "exit_seq", "exit_px", "reason")) for r in api.backtest(ticks, name, "1h", params, rules=X.FillRules(**rules, **more)).collect()) for more in ({}, {"day_loss": 1e9}))
    assert a == b and (a or name == "range_break")


def tape(spark, rows):
    """Ticks of contract A from (day, hour, price)."""
    day = lambda d: dt.date(2026, 1, 5) + dt.timedelta(d)
    return spark.createDataFrame([("A", day(d), s, (d * 86_400 + h * 3600) * 1_000_000, h * 3600, p) for s, (d, h, p) in enumerate(rows)], "contract string, cal_day date, seq long, us long, sod long, px_ticks long")


def test_limit_and_breakeven_under_a_governor(spark):
    t = tape(spark, [(0, 9, 100), (0, 10, 112), (0, 11, 99), (0, 12, 90)])
    cand = t.where("seq = 0").select("contract", "cal_day", F.col("seq").alias("entry_seq"), F.lit(1).alias("dir"), F.lit(80).alias("stop"), F.lit(200.0).alias("target"), F.lit(101.0).alias("limit_px"), F.lit(110.0).alias("be_px"))
    got = X.resolve(t, cand, X.FillRules(slip=0.0, max_gap_s=7200, day_loss=500.0)).first()
    assert (got["fill"], got["reason"], got["exit_px"]) == (101.0, "be", 99.0)


def test_session_day(spark):
    # Each entry loses 10 by its next tick; the loss limit of 10 holds back the rest of the day.
    t = tape(spark, [(0, 9, 100), (0, 10, 90), (0, 17, 100), (0, 19, 100), (0, 20, 90), (1, 9, 100), (1, 10, 90), (1, 19, 100), (1, 20, 90)])
    cand = t.where("px_ticks = 100").select("contract", "cal_day", F.col("seq").alias("entry_seq"), F.lit(1).alias("dir"), F.lit(90).alias("stop"), F.lit(200.0).alias("target"))
    rules = X.FillRules(slip=0.0, max_gap_s=86_400, day_loss=10.0)
    taken = lambda *day: sorted(r["entry_seq"] for r in X.resolve(t, cand, rules, *day).collect())
    assert taken() == [0, 5] and taken(X.session_day()) == [0, 3, 7]
