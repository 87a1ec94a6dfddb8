"""Fills against a plain loop over ticks, with and without a governor."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import fills as X
from tickloom.operators import strategies as S
from tickloom.sources import mappings

SF = "/root/testdata/sf0.001"


def by_hand(ticks, cands, rules, governed):
    """(contract, entry_seq, fill, exit_seq, exit_px, reason, low, high) tick by tick."""
    out = []
    days = {}
    for t in ticks:
        days.setdefault((t["contract"], t["cal_day"]), []).append(t)
    free, total, locked, now = {}, 0.0, False, None
    for c in sorted(cands, key=lambda c: (c["contract"], c["entry_seq"], c["stop"], c["target"])):
        day = days[c["contract"], c["cal_day"]]
        key = (c["contract"], c["cal_day"])
        if now != key:
            now, total, locked = key, 0.0, False
            if governed:
                free[c["contract"]] = -1
        i = next(i for i, t in enumerate(day) if t["seq"] == c["entry_seq"])
        d, t0 = c["dir"], day[i]
        if locked or t0["us"] < free.get(c["contract"], -1):
            continue
        fill = t0["px_ticks"] + d * rules.slip if c.get("limit_px") is None else c["limit_px"]
        if d * (fill - c["stop"]) <= 0 or d * (fill - c["target"]) >= 0:
            continue
        last, reason, px, low, high = i, "close", t0["px_ticks"], 0.0, 0.0
        for k in range(i + 1, len(day)):
            t = day[k]
            if t["us"] > t0["us"] + rules.timeout_min * X.MINUTE_US:
                reason = "timeout"
                break
            if t["us"] - day[k - 1]["us"] > rules.max_gap_s * 1_000_000:
                reason = "gap"
                break
            last, px = k, t["px_ticks"]
            move = d * (px - fill)
            low, high = min(low, move), max(high, move)
            if d * (px - c["stop"]) <= 0:
                reason, px = "stop", min(c["stop"], px) if d > 0 else max(c["stop"], px)
                break
            if d * (px - c["target"]) >= 0:
                reason, px = "target", c["target"]
                break
            if governed and (total + move >= rules.day_target or total + move <= -rules.day_loss):
                reason = "governor"
                break
        done = px - d * rules.slip
        out.append((c["contract"], c["entry_seq"], float(fill), day[last]["seq"], float(done), reason, float(low), float(high)))
        free[c["contract"]] = day[last]["us"] + rules.cooldown_min * X.MINUTE_US
        total += d * (done - fill) - rules.commission
        locked = reason == "governor" or (governed and (total >= rules.day_target or total <= -rules.day_loss))
    return out


@pytest.mark.parametrize("governed", [False, True])
@pytest.mark.parametrize("name", ["cross", "fvg"])
def test_against_a_plain_loop(spark, governed, name):
    ticks = mappings.ticks(spark.read.parquet(f"{SF}/events.parquet")).cache()
    bars = B.numbered(B.build_bars(ticks, 3600)).cache()
    cands = S.ma_cross(bars, 2, 4, 30, 2.0) if name == "cross" else S.fvg(ticks, bars, 3600, 4, 6, 30, 2.0).drop("gap_bar")
    rules = X.FillRules(slip=2.0, max_gap_s=9_000, cooldown_min=5, commission=1.0, **({"day_target": 50.0, "day_loss": 35.0} if governed else {}))
    got = [tuple(r[c] for c in ("contract", "entry_seq", "fill", "exit_seq", "exit_px", "reason", "low", "high")) for r in X.resolve(ticks, cands, rules).collect()]
    rows = [r.asDict() for r in ticks.orderBy("contract", "seq").collect()]
    want = by_hand(rows, [r.asDict() for r in cands.collect()], rules, governed)
    assert sorted(got) == sorted(want) and len(got) > 20
    assert {r[5] for r in got} >= ({"governor"} if governed else {"stop"})


def test_edges(spark):
    ticks = mappings.ticks(spark.read.parquet(f"{SF}/events.parquet"))
    cands = ticks.limit(3).select("contract", "cal_day", F.col("seq").alias("entry_seq"), F.lit(1).alias("dir"), F.lit(None).cast("double").alias("stop"), F.lit(10.0**6).alias("target"))
    assert X.resolve(ticks, cands, X.FillRules()).count() == 0
    assert X.resolve(ticks, cands.withColumn("stop", F.lit(0.0)).withColumn("entry_seq", F.lit(-1).cast("long")), X.FillRules()).count() == 0
    assert X.resolve(ticks.limit(0), cands, X.FillRules()).count() == 0 and X.resolve(ticks, cands.limit(0), X.FillRules()).count() == 0
