"""The side-by-side walk of bootstrap paths against the walk of one account."""

import numpy as np
import pytest

from tickloom import reference_queries as R
from tickloom.operators import paths as P
from tickloom.operators import summary as T
from tickloom.sources import mappings

SF = "/root/testdata/sf0.001"
NAMES = ["open", "passed", "busted"]


@pytest.mark.parametrize("name", [*R.RULE_SETS, "no floor", "mixed"])
def test_paths_against_one_walk(name):
    extra = {"no floor": R.BASE | {"max_dd": None, "target": None}, "mixed": R.BASE | {"hwm": "intraday", "breach": "realized", "lock": 5_000, "day_loss": 30_000, "soft": True, "consistency": 0.4, "min_days": 3}}
    rules = R.RULE_SETS.get(name) or extra[name]
    rng = np.random.default_rng(3)
    width = rng.integers(1, 6, 30)
    pnl = rng.integers(-60_000, 61_000, width.sum())
    trades = {"pnl_c": pnl, "mae_c": np.minimum(pnl, 0) - rng.integers(0, 20_000, len(pnl)), "mfe_c": np.maximum(pnl, 0) + rng.integers(0, 20_000, len(pnl)), "fall_c": rng.integers(0, 90_000, len(pnl))}
    begin, drawn = np.cumsum(width) - width, P.draw_block(7, 0, 120, 40) % len(width)
    got = P.walk_paths(drawn, begin, width, trades, rules)
    for i, path in enumerate(drawn):
        w = P.Walk(rules)
        for day, k in enumerate(path):
            if w.outcome == "open":
                for t in range(begin[k], begin[k] + width[k]):
                    w.trade(day, *(int(trades[c][t]) for c in ("pnl_c", "mae_c", "mfe_c", "fall_c")))
                w.end_day()
                w.day = None
        assert (NAMES[got[0][i]], got[1][i], got[2][i]) == (w.outcome, w.days, w.bal)


def test_draws_are_those_of_the_expression(spark):
    grid = spark.sql("select p as path, y as day, 540L as n from (select explode(sequence(4998, 5003)) p), (select explode(sequence(0, 6)) y)")
    want = {(r["path"], r["day"]): r["i"] for r in grid.select("path", "day", P.day_draw("path", "day", "n", 7).alias("i")).collect()}
    block = P.draw_block(7, 4998, 5004, 7) % 540
    assert all(block[p - 4998, y] == i for (p, y), i in want.items())


def test_whole_bootstrap(spark):
    """20,000 paths over 90 days for every account, whatever the blocks."""
    out = R.queries()["o115_bootstrap"](spark, SF)
    trades = mappings.trades(spark.read.parquet(f"{SF}/lineitem.parquet"))
    rows = out.collect()
    assert {r["n_paths"] for r in rows} == {20_000} and len(rows) == trades.select("account").distinct().count()
    one = T.day_pool(trades.where("account = 1"))
    a, b = (sorted(map(tuple, P.bootstrap(one, R.RULE_SETS["eod"], paths=23, days=90, block=k).collect())) for k in (5_000, 7))
    assert a == b and len(a) == 23 and max(r[3] for r in a) > 60


def walked(pnl, rules, mfe=None):
    """Outcome, days and balance of one path of days with the given trades."""
    width = np.array([len(d) for d in pnl])
    flat = np.array([x for d in pnl for x in d], np.int64)
    trades = {"pnl_c": flat, "mae_c": np.minimum(flat, 0), "mfe_c": np.maximum(flat, 0) if mfe is None else np.array(mfe), "fall_c": np.zeros(len(flat), np.int64)}
    out = P.walk_paths(np.arange(len(pnl))[None, :], np.cumsum(width) - width, width, trades, rules)
    return NAMES[out[0][0]], int(out[1][0]), int(out[2][0]) - rules["start"]


def test_effects_of_the_consistency_share():
    rules = R.BASE | {"target": 1_000, "max_dd": 100_000, "consistency": 0.5}
    days = [[480, 400], [300], [250]]
    assert walked(days, rules) == ("open", 3, 1_430)  # the first day won 880, so 1,760 are needed
    assert walked(days, rules | {"effect": "inflates"}) == ("passed", 3, 1_030)  # no more that day behind 475
    assert walked(days, rules | {"effect": "blocks"}) == ("passed", 3, 1_030)
    assert walked([[900], [150], [800]], rules | {"effect": "blocks"}) == ("passed", 3, 1_850)  # 900 is no more than half of it then


def test_day_that_ends_at_the_floor_of_unrealized_peaks():
    rules = R.BASE | {"hwm": "intraday", "max_dd": 1_000, "lock": None, "target": 10_000}
    # A peak of 1,200 inside a trade that closes at 150: 1,050 below it, while the trade's own fall is not known.
    assert walked([[150], [10]], rules, [1_200, 10]) == ("busted", 0, 150)


@pytest.mark.parametrize("name", [k for k in R.RULE_SETS if P.flat_floor(R.RULE_SETS[k])] + ["no floor", "late"])
def test_accounts_side_by_side_against_paths(name):
    extra = {"no floor": R.BASE | {"max_dd": None, "lock": None}, "late": R.BASE | {"hwm": "eod", "lock": 0, "min_days": 9, "max_dd": 90_000, "target": 60_000}}
    rules = R.RULE_SETS.get(name) or extra[name]
    assert P.flat_floor(rules)
    rng = np.random.default_rng(5)
    account, d = np.repeat(np.arange(3), 90), np.tile(np.repeat(np.arange(30), 3), 3)
    kept = rng.random(270) < 0.7
    kept[::3] = True
    account, d = account[kept], d[kept]
    pnl = rng.integers(-60_000, 61_000, len(d))
    trades = {"pnl_c": pnl, "mae_c": np.minimum(pnl, 0) - rng.integers(0, 20_000, len(d)), "mfe_c": np.maximum(pnl, 0), "fall_c": np.zeros(len(d), np.int64)}
    for scale in (1, 10**9):  # the second needs eight bytes
        big, r = {c: v * scale for c, v in trades.items()}, rules | {c: rules[c] * scale for c in ("start", "target", "max_dd", "lock") if rules[c] is not None}
        pool, drawn = P.packed_days(account, d, big, r), P.draw_block(7, 0, 500, 40) % 30
        got = P.walk_days(np.ascontiguousarray(drawn.T), pool, np.arange(3) * 30 + np.arange(30)[:, None], r, tile=123)
        for a in range(3):
            want = P.walk_paths(drawn, pool["first"][a * 30 : a * 30 + 30], pool["width"][a * 30 : a * 30 + 30], big, r)
            assert all((x[:, a] == y).all() for x, y in zip(got, want))


@pytest.mark.parametrize("name", ["eod", "close", "intra", "dll_soft"])
def test_rollup_without_a_row_per_path(spark, name):
    """Equal to the rolled up rows of paths, with one shuffle, whatever the blocks."""
    listed = mappings.listed_trades(spark.read.parquet(f"{SF}/lineitem.parquet")).where("account < 12")
    trades = mappings.trades(spark.read.parquet(f"{SF}/lineitem.parquet")).where("account < 12")
    want = sorted(map(tuple, P.rollup(P.bootstrap(T.day_pool(trades), R.RULE_SETS[name], paths=301, days=90)).collect()), key=str)
    for more in ({}, {"block": 100, "rows": 60}):
        out = P.bootstrap_rollup(listed, R.RULE_SETS[name], paths=301, days=90, order=mappings.ORDER, **more)
        assert out._jdf.queryExecution().toString().split("Physical Plan")[1].count("Exchange hashpartitioning") == 1
        assert sorted(map(tuple, out.collect()), key=str) == want
