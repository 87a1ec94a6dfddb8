"""Fill resolution: from candidate entries to trades.

Each candidate's exit depends on its own row and its day's ticks only, so exits
are found for all candidates in parallel, one group per contract and day. The ticks are
shuffled once, however many combinations of a sweep the candidates come from: a
candidate that several combinations share is walked once. Which candidates become
trades (one position at a time, cooldown) is a fold over the few candidates of a
contract. With a daily governor the exit depends on the trades before it; the same walk
then runs serially over a day.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fold import TYPES, ordered_fold

MINUTE_US = 60_000_000


@dataclass(frozen=True)
class FillRules:
    """Slippage in ticks a side, timeout and cooldown in minutes, longest gap between
    ticks in seconds, flatten time in seconds of the day, breakeven offset in ticks,
    the governor's profit target and loss limit of a day in ticks (None: off), and the
    commission of a round trip in ticks, which counts in the governor's day."""

    slip: float = 2.0
    timeout_min: int = 240
    cooldown_min: float = 5
    max_gap_s: int = 120
    flatten_sod: int | None = None
    be_offset: float = 0.0
    day_target: float | None = None
    day_loss: float | None = None
    commission: float = 0.0


#: Ticks behind an entry that are searched first; most exits lie among them.
NEAR = 4_096
EXIT = "contract string, cal_day date, cand_no long, entry_seq long, entry_us long, dir int, fill double, exit_seq long, exit_us long, exit_px double, reason string, low double, high double, fall double"


def walk(seq: np.ndarray, us: np.ndarray, sod: np.ndarray, px: np.ndarray, i0: int, d: int, stop: float, target: float, limit_px: float | None, be_px: float | None, rules: FillRules, day_pnl: float = 0.0) -> tuple | None:
    """Exit of one candidate on its day's ticks; None if it is not taken.

    In order at each tick: gap, extremes, breakeven, stop, target, governor.
    """
    n = len(px)
    fill = float(px[i0]) + d * rules.slip if limit_px is None else float(limit_px)
    if d * (fill - stop) <= 0 or d * (fill - target) >= 0:
        return None
    end, reason = n, "close"
    late = int(np.searchsorted(us, us[i0] + rules.timeout_min * MINUTE_US, "right"))
    if late < end:
        end, reason = late, "timeout"
    if rules.flatten_sod is not None:
        if sod[i0] >= rules.flatten_sod:
            return None
        cut = i0 + int(np.searchsorted(sod[i0:], rules.flatten_sod, "left"))
        if cut < end:
            end, reason = cut + 1, "flatten"
    if be_px is not None and d * (be_px - fill) <= 0:
        be_px = None
    far, near = end - i0 - 1, NEAR
    while True:  # first hits lie in the shortest stretch that has any
        cut = min(end, i0 + 1 + near)
        p = px[i0 + 1:cut].astype(float)
        none = len(p)
        first = lambda mask: int(np.argmax(mask)) if mask.any() else none  # noqa: B023, E731
        gap = first(np.diff(us[i0:cut]) > rules.max_gap_s * 1_000_000)
        be = none if be_px is None else first(d * (p - be_px) >= 0)
        moved = np.arange(len(p)) >= be
        level = np.where(moved, fill + d * rules.be_offset, stop)
        hit_stop = first(d * (p - level) <= 0)
        hit_target = first(d * (p - target) >= 0)
        hit_gov = none
        if rules.day_target is not None or rules.day_loss is not None:
            open_pnl = day_pnl + d * (p - fill)
            hit_gov = first((open_pnl >= (rules.day_target if rules.day_target is not None else np.inf)) | (open_pnl <= -(rules.day_loss if rules.day_loss is not None else np.inf)))
        at = min(gap, hit_stop, hit_target, hit_gov)
        if at < none or none == far:
            break
        near *= 8
    if at == none:
        k, out = end - 1, float(px[end - 1]) if end - 1 > i0 else float(px[i0])
        k = max(k, i0)
        seen = p
    elif at == gap:
        k, reason, seen = i0 + at, "gap", p[:at]
        out = float(px[k])
    else:
        k, seen = i0 + 1 + at, p[:at + 1]
        if at == hit_stop:
            out = min(level[at], p[at]) if d > 0 else max(level[at], p[at])
            reason = "be" if moved[at] else "stop"
        elif at == hit_target:
            out, reason = float(target), "target"
        else:
            out, reason = float(p[at]), "governor"
    path = d * (np.r_[fill, seen] - fill)
    fall = float((np.maximum.accumulate(path) - path).max())
    return k, fill, out - d * rules.slip, reason, float(path.min()), float(path.max()), fall


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    kinds = [pa.list_(pa.int64()) if t == "array<long>" else TYPES[t] for _, t in fields]
    return pa.table({n: pa.array(c, k) for (n, _), k, c in zip(fields, kinds, zip(*rows) if rows else [()] * len(fields))})


def _sides(ticks: DataFrame, candidates: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(ticks of the days with candidates, different candidates with their combinations)."""
    extra = [F.col(c).cast("double").alias(c) if c in candidates.columns else F.lit(None).cast("double").alias(c) for c in ("limit_px", "be_px")]
    combo = F.col("combo_no") if "combo_no" in candidates.columns else F.lit(0)
    cand = candidates.select("contract", "cal_day", F.col("entry_seq").alias("seq"), F.col("dir").cast("int").alias("dir"), F.col("stop").cast("double").alias("stop"), F.col("target").cast("double").alias("target"), *extra, combo.cast("long").alias("combo"))
    cand = cand.groupBy("contract", "cal_day", "seq", "dir", "stop", "target", "limit_px", "be_px").agg(F.collect_set("combo").alias("combos"))
    days = cand.select("contract", "cal_day").distinct()
    tape = ticks.select("contract", "cal_day", "seq", "us", "sod", "px_ticks", *more).join(days, ["contract", "cal_day"], "left_semi")
    return tape, cand.withColumnsRenamed({"contract": "c_contract", "cal_day": "c_day"})  # candidates come of the same ticks


def _day(tape: pa.Table) -> list[np.ndarray]:
    """seq, us, sod and px of a day's ticks in order."""
    order = np.argsort(tape.column("seq").to_numpy(), kind="stable")
    return [tape.column(c).to_numpy()[order] for c in ("seq", "us", "sod", "px_ticks")]


def _listed(asked: pa.Table, seq: np.ndarray) -> Iterator[tuple[int, int, dict]]:
    """(place among the ticks, number at its tick, candidate) in order of seq, stop, target."""
    rows = sorted(asked.to_pylist(), key=lambda c: (c["seq"], *((c[k] is None, c[k] or 0.0) for k in ("stop", "target", "limit_px", "be_px")), c["dir"]))
    at = np.searchsorted(seq, [c["seq"] for c in rows])
    no, last = 0, None
    for i, c in zip(at.tolist(), rows):
        no, last = (no + 1 if c["seq"] == last else 0), c["seq"]
        if i < len(seq) and seq[i] == c["seq"] and c["stop"] is not None and c["target"] is not None:
            yield i, no, c


def exits(ticks: DataFrame, candidates: DataFrame, rules: FillRules) -> DataFrame:
    """Every candidate's exit (schema EXIT), each as if it were alone.

    candidates: contract, cal_day, entry_seq, dir, stop, target and optionally
    limit_px, be_px and combo_no, which the result then has too. cand_no numbers the
    candidates of a tick by stop and target. A candidate of no tick, or without stop or
    target, is not taken; repeated ones are one.
    """
    tape, cand = _sides(ticks, candidates)
    schema = EXIT + ", combos array<long>"

    def run(day: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if day.num_rows and asked.num_rows:
            contract, date = asked.column("c_contract")[0].as_py(), asked.column("c_day")[0].as_py()
            seq, us, sod, px = _day(day)
            for i, no, c in _listed(asked, seq):
                got = walk(seq, us, sod, px, i, c["dir"], c["stop"], c["target"], c["limit_px"], c["be_px"], rules)
                if got:
                    k, fill, out, reason, low, high, fall = got
                    rows.append((contract, date, no, int(seq[i]), int(us[i]), c["dir"], fill, int(seq[k]), int(us[k]), out, reason, low, high, fall, c["combos"]))
        return _table(rows, schema)

    found = tape.groupBy("contract", "cal_day").cogroup(cand.groupBy("c_contract", "c_day")).applyInArrow(run, schema)
    if "combo_no" in candidates.columns:
        return found.withColumn("combo_no", F.explode("combos")).drop("combos")
    return found.drop("combos")


def one_at_a_time(found: DataFrame, cooldown_min: float) -> DataFrame:
    """The exits that become trades: the next candidate at or after the time at which
    the last one's exit and the cooldown are over, in order of (entry_seq, cand_no), in
    each contract, and each combination if there are several."""

    def step(state: list, row: object) -> Iterator[tuple]:
        if row.entry_us >= state[0]:
            state[0] = row.exit_us + int(cooldown_min * MINUTE_US)
            yield tuple(row)

    key = ["contract"] if "combo_no" not in found.columns else ["combo_no", "contract"]
    return ordered_fold(found, key, ["entry_seq", "cand_no"], lambda: [-(2**62)], step, EXIT + (", combo_no long" if len(key) > 1 else ""))


def resolve(ticks: DataFrame, candidates: DataFrame, rules: FillRules = FillRules(), governor_day: Column | None = None) -> DataFrame:
    """Trades of the candidates: EXIT and pnl in ticks. ``governor_day``, an expression on
    ticks, is the day over which the governor adds up (default cal_day)."""
    if rules.day_target is not None or rules.day_loss is not None:
        out = _governed(ticks, candidates, rules, governor_day)
    else:
        out = one_at_a_time(exits(ticks, candidates, rules), rules.cooldown_min)
    return out.withColumn("pnl", F.col("dir") * (F.col("exit_px") - F.col("fill")))


def session_day(open_sod: int = 64_800) -> Column:
    """Day of the session that a tick is in, when sessions open at open_sod (18:00) of the date before."""
    return F.date_add("cal_day", F.when(F.col("sod") >= open_sod, 1).otherwise(0))


def _governed(ticks: DataFrame, candidates: DataFrame, rules: FillRules, governor_day: Column | None = None) -> DataFrame:
    """Serial walk with the running result of the governor's day.

    By cal_day each contract and day is walked alone, so the cooldown ends at midnight.
    A day that the caller names may begin inside a date while a position is open: then
    all days of a contract with candidates are one task's work and memory. A position
    ends with its cal_day's ticks, as in exits, and counts for the day of its entry.
    """
    gday = F.col("cal_day") if governor_day is None else governor_day
    tape, cand = _sides(ticks, candidates, gday.alias("gday"))
    schema = EXIT + (", combo_no long" if "combo_no" in candidates.columns else "")

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if not held.num_rows or not asked.num_rows:
            return _table(rows, schema)
        contract = asked.column("c_contract")[0].as_py()
        days, asked_days = held.column("cal_day").to_pylist(), asked.column("c_day").to_pylist()
        states: dict[int, dict] = {}
        for date in sorted(set(asked_days)):
            part = held.filter(pa.array([x == date for x in days]))
            if not part.num_rows:
                continue
            seq, us, sod, px = _day(part)
            place = np.argsort(part.column("seq").to_numpy(), kind="stable")
            gdays = part.column("gday")
            for i, no, c in _listed(asked.filter(pa.array([x == date for x in asked_days])), seq):
                now = gdays[int(place[i])].as_py()
                for combo in sorted(c["combos"]):
                    st = states.setdefault(combo, {"free": -(2**62), "now": None})
                    if st["now"] != now:
                        st.update(now=now, total=0.0, locked=False)
                    if st["locked"] or us[i] < st["free"]:
                        continue
                    d = c["dir"]
                    got = walk(seq, us, sod, px, i, d, c["stop"], c["target"], c["limit_px"], c["be_px"], rules, st["total"])
                    if not got:
                        continue
                    k, fill, out, reason, low, high, fall = got
                    rows.append((contract, date, no, int(seq[i]), int(us[i]), d, fill, int(seq[k]), int(us[k]), out, reason, low, high, fall, combo)[:len(schema.split(", "))])
                    total = st["total"] + d * (out - fill) - rules.commission
                    locked = reason == "governor" or (rules.day_target is not None and total >= rules.day_target) or (rules.day_loss is not None and total <= -rules.day_loss)
                    st.update(free=int(us[k] + rules.cooldown_min * MINUTE_US), total=total, locked=locked)
        return _table(rows, schema)

    key = ["contract", "cal_day"] if governor_day is None else ["contract"]
    return tape.groupBy(*key).cogroup(cand.groupBy(*["c_contract", "c_day"][:len(key)])).applyInArrow(run, schema)
