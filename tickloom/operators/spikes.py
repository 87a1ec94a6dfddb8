"""Implausible spikes, stuck runs and impossible readings (problem 3).

Per source: a robust AR(1) on the increments gives residuals and their usual
size; increments whose residual is far beyond it are tested one after another as
additive outlier or level shift. An additive outlier is a patch of at most
``patch`` readings away from the level before it that ends with one abrupt step
back; its readings are flagged, taken out, and the test is repeated on what is
left until nothing changes. A level that stays, or that comes back in small
steps, is a level shift and no case. Runs of equal readings are compared with
the longest run that the source's own repeat rate explains.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import over_sequence
from ..sources.tables import NET_SECOND, contract_key

#: Residuals beyond REACH times the usual size are tested.
REACH = 12.0
#: Longest patch of readings that still is an outlier rather than a level.
PATCH = 8
#: A run is stuck beyond this multiple of the longest run that chance explains.
STUCK = 1.5


def usual_step(d: np.ndarray) -> tuple[float, float]:
    """(AR coefficient, robust residual size) of increments, in units of readings.

    The size is a trimmed root mean square: the 2 % largest increments count as
    the size of the 98th percentile, so it is not zero where most increments are.
    """
    if len(d) == 0:
        return 0.0, 0.0
    cap = np.quantile(np.abs(d), 0.98)
    w = np.clip(d, -cap, cap)
    phi = 0.0
    if len(w) > 20 and (w[:-1] ** 2).sum() > 0:
        phi = float(np.clip((w[1:] * w[:-1]).sum() / (w[:-1] ** 2).sum(), -0.9, 0.9))
    e = w.copy()
    e[1:] -= phi * w[:-1]
    return phi, float(np.sqrt((e**2).mean()))


def outlier_patches(x: np.ndarray, floor: float, reach: float = REACH, patch: int = PATCH) -> np.ndarray:
    """Boolean mask of additive outliers in a sequence; ``floor`` is the least usual step."""
    bad = np.zeros(len(x), bool)
    while True:  # each round but the last takes readings out
        at = np.flatnonzero(~bad)
        y = x[at]
        d = np.diff(y)
        if len(d) < 2:
            break
        phi, size = usual_step(d)
        size = max(size, floor)
        e = d.copy()
        e[1:] -= phi * np.clip(d[:-1], -5 * size, 5 * size)
        # The usual size around a reading: quiet stretches keep the source's, lively ones get their own.
        w = pd.Series(np.clip(d, -8 * size, 8 * size) ** 2)
        local = np.sqrt(w.rolling(61, center=True, min_periods=1).mean().to_numpy())
        limit = reach * np.maximum(size, 0.8 * local)
        found = np.zeros(len(y), bool)
        done = 0
        for t in np.flatnonzero(np.abs(e) > limit) + 1:
            if t < done:
                continue
            level = np.median(y[max(0, t - 3):t])
            away = limit[t - 1]
            for j in range(t + 1, min(len(y), t + patch + 1)):
                back = abs(y[j] - y[j - 1])
                if abs(y[j] - level) <= max(0.5 * away, 0.15 * abs(y[j - 1] - level)):
                    if back >= 0.6 * away:
                        found[t:j] = True
                        done = j
                    break
                if abs(y[j] - level) < 0.6 * away:
                    break
        if not found.any():
            break
        bad[at[found]] = True
    return bad


def run_lengths(x: np.ndarray) -> np.ndarray:
    """For each reading the length of the run of equal readings that holds it."""
    if len(x) == 0:
        return np.zeros(0, int)
    starts = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1]
    return np.repeat(np.diff(np.r_[starts, len(x)]), np.diff(np.r_[starts, len(x)]))


def stuck_limit(x: np.ndarray, factor: float = STUCK) -> float:
    """Length beyond which a run of equal readings is stuck.

    With repeat rate q a run of n readings of chance length reaches about
    log(n)/log(1/q). Runs beyond that length are left out of q until it stays, so that
    stuck runs do not raise their own limit.
    """
    n = len(x)
    if n < 3:
        return np.inf
    same = x[1:] == x[:-1]
    lengths = run_lengths(x)
    q = same.mean()
    kept = len(same) + 1
    while True:  # fewer and fewer readings are kept
        q = min(max(q, 0.05), 0.95)
        keep = lengths[1:] <= factor * np.log(max(n, 1_000)) / np.log(1 / q)
        if not keep.any() or keep.sum() >= kept:
            break
        kept, q = keep.sum(), same[keep].mean()
    return factor * np.log(max(n, 1_000)) / np.log(1 / min(max(q, 0.05), 0.95)) + 2


def judge(part: pd.DataFrame) -> pd.DataFrame:
    """Cases of one ordered stretch of one source: columns tick_id, px, tick_size, own."""
    px = part["px"].to_numpy(float)
    unit = part["tick_size"].iloc[0]
    known = unit is not None and np.isfinite(unit) and unit > 0
    if not known:
        steps = np.abs(np.diff(px))
        unit = np.quantile(steps[steps > 0], 0.1) if (steps > 0).any() else 1.0
    x = px / unit
    with np.errstate(invalid="ignore", over="ignore"):
        slack = 2 * np.spacing(np.abs(px).astype(np.float32)).astype(float) / unit + 1e-6
        off = known & (np.abs(x - np.round(x)) > slack)
    limit_case = ~(px > 0) | off | ~np.isfinite(px)
    fine = np.flatnonzero(~limit_case)
    spike = np.zeros(len(px), bool)
    spike[fine] = outlier_patches(np.round(x[fine]) if known else x[fine], 0.5)
    repeats = np.r_[False, px[1:] == px[:-1]] if len(px) else np.zeros(0, bool)
    stuck = repeats & (run_lengths(px) > stuck_limit(px))
    kind = np.select([limit_case, spike, stuck], ["limit", "spike", "stuck"], "")
    hit = (kind != "") & part["own"].to_numpy()
    return pd.DataFrame({"contract": part["contract"].to_numpy()[hit], "tick_id": part["tick_id"].to_numpy()[hit], "kind": kind[hit]})


def implausible_prints(tape: DataFrame, instruments: DataFrame, chunk: int = 60_000) -> DataFrame:
    """(contract, tick_id, kind 'limit'|'spike'|'stuck') of implausible prints.

    Prints without contract, ts, tick_id or px (null or NaN) are not judged. Equal
    ts are ordered by tick_id; rows sent twice are two readings, so a repeated
    spike is one patch of two. A root without tick size has no grid test. Empty
    input gives no rows; extra columns are ignored. Judged in stretches of about
    ``chunk`` prints of one contract with 1,000 neighbours on both sides.
    """
    rows = tape.select(contract_key("contract").alias("contract"), "ts", "tick_id", F.col("px").cast("double").alias("px"))
    rows = rows.where("contract is not null and ts is not null and tick_id is not null and px is not null and not isnan(px)")
    sizes = instruments.select(F.upper(F.trim("root")).alias("_root"), F.col("tick_size").cast("double").alias("tick_size")).where("_root is not null").groupBy("_root").agg(F.min("tick_size").alias("tick_size"))
    rows = rows.join(sizes, F.split("contract", " ")[0] == F.col("_root"), "left").drop("_root")
    return over_sequence(rows, "contract", ["ts", "tick_id"], judge, "contract string, tick_id long, kind string", bin_width=60 * NET_SECOND, target=chunk)
