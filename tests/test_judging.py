"""Gate, fidelity, cost basis, phase chains, front contracts, ledgers and sweeps against hand-made cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import api
from tickloom.functions import stats
from tickloom.operators import bars as B
from tickloom.operators import continuous as C
from tickloom.operators import fills as X
from tickloom.operators import matching as M
from tickloom.operators import strategies as S
from tickloom.operators import summary as T
from tickloom.sources import files, mappings

SF = "/root/testdata/sf0.001"


def test_gate(spark):
    rows = [("none", None, 500, 3), ("nan", float("nan"), 500, 3), ("few", 3.0, 79, 3), ("one", 3.0, 80, 1), ("low", 1.49, 500, 3), ("noise", 1.9, 80, 2), ("test", 1.91, 80, 2), ("fewlow", 1.0, 10, 0)]
    df = spark.createDataFrame(rows, "k string, t double, n int, positive int")
    got = {r["k"]: r["v"] for r in df.select("k", stats.verdict(F.col("t"), F.col("n"), F.col("positive"), 1.9).alias("v")).collect()}
    assert got == {"none": "no signal", "nan": "no signal", "few": "below the bar", "one": "below the bar", "low": "below the bar", "noise": "indistinguishable from noise", "test": "earns a forward test", "fewlow": "below the bar"}


def test_subperiods_below_three_dates(spark):
    day = lambda i: dt.date(2026, 1, 5 + i)
    rows = [("a", day(0), 5)] + [("b", day(0), 5), ("b", day(1), -9)] + [("c", day(i), v) for i, v in enumerate((1, -2, 3))]
    got = {r["account"]: tuple(r)[1:] for r in T.subperiods(spark.createDataFrame(rows, "account string, d date, pnl_c long")).collect()}
    assert got == {"a": (5, 0, 0, 1), "b": (-4, 0, 0, 0), "c": (1, -2, 3, 2)}


def test_fidelity(spark):
    rows = [("a", "x", None, None, None, "Tick", 1.0, "unknown"), ("b", "nt8-performance-metric", "High", "Tick", 1.0, "Tick", 1.0, "unknown"), ("c", "x", "High", "Tick", 1.0, "Minute", 5.0, "exact"), ("d", "x", "High", "Tick", 5.0, "Minute", 5.0, "fills-guessed"),
            ("e", "x", "High", "Minute", 1.0, "Minute", 1.0, "fills-guessed"), ("f", "x", "Standard", "Minute", 1.0, "Tick", 1.0, "exact"), ("g", "x", "Standard", None, None, "Tick", 4.0, "fills-guessed"), ("h", None, "High", "Tick", None, None, None, "exact"), ("i", "x", "", None, None, None, None, "fills-guessed")]
    df = spark.createDataFrame(rows, "k string, source string, fill_resolution string, fill_resolution_type string, fill_resolution_value double, bar_type string, bar_value double, want string")
    assert df.withColumn("level", M.fidelity()).where("level != want").count() == 0


def test_cost_basis(spark):
    runs = [("net", 90.0, None, None), ("gross", None, 300.0, -210.0), ("both", 90.0, 300.0, -210.0), ("none", None, None, None), ("odd", 50.0, 10.0, 0.0), ("free", 90.0, None, None), ("empty", None, 0.0, 0.0)]
    trades = [(k, 45.0, 2.0, 1.0) for k in ("net", "gross", "both", "none", "odd") for _ in range(2)] + [("free", 90.0, None, None), ("free", None, 0.5, float("nan"))]
    got = {r["run_id"]: (r["basis"], r["subtract_costs"]) for r in M.cost_basis(spark.createDataFrame(runs, "run_id string, perf_cum_profit double, perf_gross_profit double, perf_gross_loss double"), spark.createDataFrame(trades, "run_id string, profit double, commission double, fee double")).collect()}
    assert got == {"net": ("net", False), "gross": ("gross", True), "both": ("net", False), "none": ("no totals", True), "odd": ("unreconciled", True), "free": ("unreconciled", True), "empty": ("gross", True)}


def test_phase_chain(spark):
    rows = [("A", "pro_eval", "evaluation", 50, 20), ("A", "pro_funded", "funded_sim", 50, 25), ("A", "pro_legacy", "funded_sim", 50, 20), ("A", "pro_funded", "funded_sim", 100, 25), ("A", "pro_eval", "evaluation", 150, 20),
            ("B", "one", "evaluation", 50, 20), ("B", "one", "funded_sim", 50, 9), ("B", "one_plan", "funded_sim", 50, 20), ("C", "zip_path", "evaluation", 50, 20), ("C", "ex_path", "funded_sim", 50, 20), ("C", "wy", "funded_sim", 50, 30),
            ("D", "fast-track", "evaluation", 50, 20), ("D", "track_retired", "funded_sim", 50, 20)]
    got = {(r["firm"], r["size"]): (r["next_variant"], r["quality"]) for r in M.phase_chain(spark.createDataFrame(rows, "firm string, variant string, phase string, size int, max_dd int")).collect()}
    assert got == {("A", 50): ("pro_funded", "family"), ("A", 150): (None, "none"), ("B", 50): ("one", "exact"), ("C", 50): ("ex_path", "inferred"), ("D", 50): ("track_retired", "family")}


def test_front_contracts_by_month(spark):
    days = [dt.date(2026, 1, i) for i in range(1, 7)]
    held = [{"NVX 12-25": 9, "NVX 03-26": 1}, {"NVX 12-25": 3, "NVX 03-26": 8}, {"NVX 12-25": 9, "NVX 03-26": 1}, {"NVX 12-25": 4}, {"NVX 12-25": 5, "NVX 03-26": 5}, {"NVX 03-26": 2}]
    rows = [(d, c, v) for d, x in zip(days, held) for c, v in x.items()]
    got = C.front_contracts(spark.createDataFrame(rows, "cal_day date, contract string, volume long")).orderBy("cal_day").collect()
    assert [r["contract"][4:] for r in got] == ["12-25", "03-26", "03-26", "12-25", "12-25", "03-26"]


def test_ledger_chain(spark):
    rows = [("l", i, f"body {i}") for i in range(1, 7)] + [("m", 1, "x"), ("m", 2, None)]
    kept = stats.chain(spark.createDataFrame(rows, "ledger string, seq long, body string"), "ledger", "seq", "body").cache()
    breaks = lambda df: sorted((r["ledger"], r["seq"], r["reason"]) for r in stats.chain_breaks(df, "ledger", "seq", "body").collect())
    assert breaks(kept) == []
    assert breaks(kept.withColumn("body", F.when(F.col("seq") == 3, "other").otherwise(F.col("body"))).where("ledger = 'l'")) == [("l", 3, "edited")]
    assert breaks(kept.where("not (ledger = 'l' and seq = 2)")) == [("l", 3, "broken link")]
    # A record moved with its own digest: its link no longer fits.
    moved = kept.withColumn("seq", F.when((F.col("ledger") == "l") & (F.col("seq") == 2), 9).otherwise(F.col("seq")))
    assert {s for _, s, _ in breaks(moved)} == {3, 9}


def test_pairs_stay_in_their_instrument(spark):
    rows = [("a", "X", 1, 1, True, False, 0), ("a", "Y", 2, 2, True, False, 0), ("a", "X", 3, 3, False, True, 2), ("a", "Y", 4, 4, False, True, 2)]
    got = sorted((r["instrument"], r["entry_seq"], r["exit_seq"]) for r in M.pair_executions(spark.createDataFrame(rows, "account string, instrument string, seq long, us long, is_entry boolean, is_exit boolean, action int")).collect())
    assert got == [("X", 1, 3), ("Y", 2, 4)]


def test_walk_is_the_same_with_any_stretch(monkeypatch):
    rng = np.random.default_rng(5)
    px = 100 + np.cumsum(rng.integers(-2, 3, 400))
    us, sod, seq = np.arange(400) * 1_000_000, np.arange(400), np.arange(400)
    rules = X.FillRules(max_gap_s=5, timeout_min=5, be_offset=1.0)
    asks = [(i, d, float(px[i] - d * s), float(px[i] + d * 2 * s), be and float(px[i] + d * s)) for i in range(0, 380, 13) for d in (1, -1) for s in (4, 9, 60) for be in (None, True)]
    run = lambda: [X.walk(seq, us, sod, px, i, d, stop, target, None, be, rules) for i, d, stop, target, be in asks]
    whole = run()
    for near in (1, 3, 50):
        monkeypatch.setattr(X, "NEAR", near)
        assert run() == whole


def test_grid_of_averages_is_each_one_alone(spark):
    bars = B.numbered(B.build_bars(mappings.ticks(spark.read.parquet(f"{SF}/events.parquet")), 3600)).cache()
    ranges = {"fast": [2.0, 3.0], "slow": [3.0, 5.0]}
    combos = stats.grid(spark, ranges).withColumns({"stop_ticks": F.lit(40.0), "rr": F.lit(2.0)})
    got = S.ma_cross_grid(bars, combos).collect()
    for no, (f, s) in enumerate((f, s) for f in (2, 3) for s in (3, 5)):
        alone = {tuple(r) for r in S.ma_cross(bars, f, s, 40, 2.0).collect()}
        assert {tuple(r)[1:] for r in got if r["combo_no"] == no} == alone


def test_sweep_is_ranked(spark, tmp_path):
    ticks = mappings.ticks(spark.read.parquet(f"{SF}/events.parquet"))
    rules = X.FillRules(max_gap_s=20_000)
    out = api.sweep(ticks, "ma_cross", {"fast": [2.0, 3.0], "slow": [5.0]}, "1h", rules).orderBy("place").collect()
    assert [r["place"] for r in out] == [1, 2]
    for r in out:
        alone = api.backtest(ticks, "ma_cross", "1h", {"fast": r["fast"], "slow": r["slow"]}, rules=rules).collect()
        assert r["n"] == len(alone) and abs(r["pnl"] - sum(x["pnl"] for x in alone)) < 1e-6
    book = str(tmp_path / "trials.jsonl")
    for _ in range(2):  # the same sweep twice is charged once
        api.sweep(ticks, "ma_cross", {"fast": [2.0, 3.0], "slow": [5.0]}, "1h", rules, ledger=book)
    api.sweep(ticks, "orb", {"range_min": [30.0, 60.0, 90.0]}, "1h", rules, ledger=book)
    assert files.ledger_trials(book) == 5 and files.verify_ledger(book) is None
    fvg = api.sweep(ticks, "fvg", {"min_ticks": [4.0, 8.0]}, "1h", rules).collect()
    assert len(fvg) == 2
    with pytest.raises(ValueError):
        api.sweep(ticks, "ma_cross", {"fats": [1.0]})
