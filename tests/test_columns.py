"""Performance columns put together from parts of an account, against a plain loop."""

import random
from datetime import date, timedelta

import pytest

from tickloom import reference_queries as R
from tickloom.operators import summary as T

SF = "/root/testdata/sf0.001"


def by_loop(trades):
    """(drawdown, longest run of wins, of losses, days, net) of trades in their order."""
    run = peak = deep = wins = losses = most_wins = most_losses = 0
    for _, _, _, _, p in trades:
        run += p
        peak = max(peak, run)
        deep = min(deep, run - peak)
        wins, losses = (wins + 1 if p > 0 else 0), (losses + 1 if p < 0 else 0)
        most_wins, most_losses = max(most_wins, wins), max(most_losses, losses)
    return deep, most_wins, most_losses, run


@pytest.mark.parametrize("width", [1, 5, 256])
def test_columns_against_a_loop(spark, width):
    rng = random.Random(11)
    rows = []
    for account, n in ((1, 120), (2, 40), (3, 1), (None, 5)):
        day = date(2024, 1, 1)
        for no in range(1, n + 1):
            day += timedelta(days=rng.choice((0, 0, 1, 3)))
            lean = 0 if account == 2 else rng.choice((-1, 1))  # long runs of one sign
            rows.append((account, no, day, rng.choice((-1, 1, 1)), (lean or rng.choice((-1, -1, -1, 0, 1))) * rng.randrange(1, 900)))
    rows.append((3, 2, None, 1, 0))
    sent = [(*r, 500, min(r[4], 0) - 10, max(r[4], 0) + 20, None) for r in rows]
    rng.shuffle(sent)
    df = spark.createDataFrame(sent, "account long, trade_no long, d date, direction int, pnl_c long, comm_c long, mae_c long, mfe_c long, fall_c long")
    df = df.where("not (account = 3 and d is null)") if width == 1 else df
    got = {(r["account"], r["direction"]): r for r in T.performance_columns(df, width=width).collect()}
    assert {a for a, _ in got} == {1, 2, 3}
    for (account, side), r in got.items():
        mine = [x for x in rows if x[0] == account and side in (0, x[3]) and not (width == 1 and x[2] is None)]
        mine = sorted(mine, key=lambda x: (x[2] is not None, x[1]))
        days = len({x[2] for x in rows if x[0] == account and x[2]})
        assert (r["max_drawdown_c"], r["max_wins"], r["max_losses"], r["net_c"]) == by_loop(mine)
        assert r["n"] == len(mine) and r["per_day"] == pytest.approx(len(mine) / days, abs=1e-6)


def test_trades_are_shuffled_once(spark):
    """The trades once, their parts once, the sides of an account once."""
    plan = R.queries()["o64_performance_columns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3 and plan.count("FileScan") == 1 and "Join" not in plan
