"""Path-dependent folds over trades: replay under a moving floor, and its bootstrap.

A rule set is a dict: start, target (None: none), max_dd, hwm ('none', 'eod' or
'intraday'), breach ('intraday' or 'realized'), lock (floor limit above start, None),
day_loss (None), soft (bool), min_days, consistency (share of the total that the
best day may be, None), and optionally for the bootstrap effect: 'inflates' or 'blocks',
what the consistency share does to the target or the pass of a trader who minds it. Money is in whole cents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fold import ordered_fold
from .summary import fall_bound


class Walk:
    """State of one account under one rule set."""

    def __init__(self, rules: dict) -> None:
        self.r = rules
        self.bal = self.hwm = self.open = rules["start"]
        self.low, self.best, self.days = rules["start"], 0, 0
        self.day, self.outcome, self.reason, self.paused, self.n = None, "open", "", False, 0

    def floor(self) -> float:
        if self.r["max_dd"] is None:
            return -np.inf
        f = self.hwm - self.r["max_dd"]
        return f if self.r["lock"] is None else min(f, self.r["start"] + self.r["lock"])

    def end_day(self) -> None:
        """Close of a day: ratchet, best day, target."""
        if self.day is None or self.outcome != "open":
            return
        self.days += 1
        if self.r["hwm"] == "eod":
            self.hwm = max(self.hwm, self.bal)
        self.best = max(self.best, self.bal - self.open)
        if self.r["target"] is not None:
            profit, need = self.bal - self.r["start"], self.r["target"]
            if self.r["consistency"] is not None:
                need = max(need, self.best / self.r["consistency"])
            if profit >= need and self.days >= self.r["min_days"]:
                self.outcome, self.reason = "passed", "target"

    def trade(self, day: object, pnl: int, low: int, high: int, fall: int) -> None:
        if day != self.day:
            self.end_day()
            self.day, self.open, self.paused = day, self.bal, False
        if self.outcome != "open" or self.paused:
            return
        self.n += 1
        r = self.r
        low, high = min(low, pnl), max(high, pnl)
        fall = max(fall, -low)
        if r["hwm"] != "intraday":
            broken = r["breach"] == "intraday" and self.bal + low <= self.floor()
        else:
            up = max(self.hwm, self.bal + high)
            if r["breach"] != "intraday" or r["max_dd"] is None:
                broken = False
            else:
                broken = max(self.hwm - self.bal - low, fall) >= r["max_dd"] and (r["lock"] is None or self.bal + low <= r["start"] + r["lock"])
            if not broken:
                self.hwm = up
        self.low = min(self.low, self.bal + low)
        if broken:
            self.outcome, self.reason = "busted", "inside the trade"
            return
        self.bal += pnl
        if r["breach"] != "intraday" and self.bal <= self.floor():
            self.outcome, self.reason = "busted", "at the close"
        elif r["day_loss"] is not None and self.bal - self.open <= -r["day_loss"]:
            if r["soft"]:
                self.paused = True
            else:
                self.outcome, self.reason = "busted", "day loss"


def replay(trades: DataFrame, rules: dict) -> DataFrame:
    """Deterministic replay of each account's trades in order of trade_no."""
    rows = trades.select("account", "trade_no", "d", "pnl_c", F.col("mae_c").alias("low"), F.col("mfe_c").alias("high"), fall_bound().alias("fall"))

    def start() -> dict:
        return {"w": Walk(rules), "account": None}

    def step(state: dict, row: object) -> Iterator[tuple]:
        state["account"] = row.account
        state["w"].trade(row.d, int(row.pnl_c), int(row.low), int(row.high), int(row.fall))
        return iter(())

    def finish(state: dict) -> Iterator[tuple]:
        w = state["w"]
        w.end_day()
        yield state["account"], w.outcome, w.reason, w.days, w.n, int(w.bal), int(w.low), int(w.best)

    return ordered_fold(rows, ["account"], ["trade_no"], start, step, "account long, outcome string, reason string, days long, n_trades long, balance_c long, low_water_c long, best_day_c long", finish)


def day_draw(path: str, day: str, n_days: str, seed: int) -> Column:
    """Pool day of a path and day: a hash, so any engine and any task draws the same."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(path), F.col(day))), 1, 8), 16, 10).cast("long")
    return F.pmod(u, F.col(n_days))


@lru_cache(maxsize=8)
def draw_block(seed: int, lo: int, hi: int, days: int) -> np.ndarray:
    """The hashes of ``day_draw`` before the remainder: a row per path lo .. hi - 1. They
    do not depend on the account, so a worker makes them once."""
    u = [int.from_bytes(hashlib.md5(f"{seed}:{p}:{y}".encode()).digest()[:4], "big") for p in range(lo, hi) for y in range(days)]
    return np.array(u, np.int64).reshape(hi - lo, days)


def walk_paths(drawn: np.ndarray, begin: np.ndarray, width: np.ndarray, trades: dict[str, np.ndarray], r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Many paths side by side: outcome (0 open, 1 passed, 2 busted), days and balance of
    each row of ``drawn``, which holds a pool day per day of the path. As ``Walk``; where
    the rules name an effect, no more is traded on a day that has won 95 % of the
    consistency share of the target. A day that ends at or below the floor of the
    unrealized peaks is a bust too.

    Pool day i has the trades begin[i] .. begin[i] + width[i] - 1 of ``trades``.
    """
    n, pnl = len(drawn), trades["pnl_c"]
    low, high = np.minimum(trades["mae_c"], pnl), np.maximum(trades["mfe_c"], pnl)
    fall = np.maximum(trades["fall_c"], -low)
    strict, cap = r["breach"] == "intraday", np.inf if r["lock"] is None else r["start"] + r["lock"]
    floor = lambda h: np.full(len(h), -np.inf) if r["max_dd"] is None else np.minimum(h - r["max_dd"], cap)
    bounded = r.get("effect") is not None and r["consistency"] is not None and r["target"] is not None
    enough = 0.95 * r["consistency"] * r["target"] if bounded else np.inf
    bal, hwm = np.full(n, r["start"], np.int64), np.full(n, r["start"], np.int64)
    best, days, outcome = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int8)
    live = np.arange(n)
    for day in range(drawn.shape[1]):
        if not len(live):
            break
        first, size = begin[drawn[live, day]], width[drawn[live, day]]
        opened, b, h = bal[live], bal[live], hwm[live]
        bust, stopped = np.zeros(len(live), bool), np.zeros(len(live), bool)
        for k in range(int(size.max())):
            at = np.flatnonzero((size > k) & ~bust & ~stopped & (b - opened < enough))
            t, now, top = first[at] + k, b[at], h[at]
            worst = now + low[t]
            if r["hwm"] != "intraday":
                broken = worst <= floor(top) if strict else np.zeros(len(at), bool)
            else:
                broken = (np.maximum(top - worst, fall[t]) >= r["max_dd"]) & (worst <= cap) if strict and r["max_dd"] is not None else np.zeros(len(at), bool)
                top = np.where(broken, top, np.maximum(top, now + high[t]))
            now = np.where(broken, now, now + pnl[t])
            if not strict:
                broken = now <= floor(top)
            if r["day_loss"] is not None:
                lost = ~broken & (now - opened[at] <= -r["day_loss"])
                if r["soft"]:
                    stopped[at] = lost
                else:
                    broken = broken | lost
            b[at], h[at], bust[at] = now, top, broken
        bust |= b <= floor(h)
        ends = ~bust
        days[live[ends]] += 1
        if r["hwm"] == "eod":
            h = np.where(ends, np.maximum(h, b), h)
        best[live[ends]] = np.maximum(best[live], b - opened)[ends]
        bal[live], hwm[live], outcome[live[bust]] = b, h, 2
        if r["target"] is not None:
            blocks = bounded and r["effect"] == "blocks"
            need = r["target"] if r["consistency"] is None or blocks else np.maximum(r["target"], best[live] / r["consistency"])
            passed = ends & (b - r["start"] >= need) & (days[live] >= r["min_days"])
            if blocks:
                passed &= best[live] <= r["consistency"] * (b - r["start"])
            outcome[live[passed]] = 1
            ends = ends & ~passed
        live = live[ends]
    return outcome, days, bal


def bootstrap(pool: DataFrame, rules: dict, paths: int, days: int, seed: int = 7, block: int = 5_000) -> DataFrame:
    """Day-block bootstrap: each path draws ``days`` days of the pool with repetition
    and is walked under the rules. Returns account, path, outcome, days, balance_c.

    The pool's days are numbered per account. A task walks ``block`` paths of an
    account side by side over that account's packed days, so neither the draws nor
    the paths' days are ever rows; accounts without a name have no paths.
    """
    def run(days_of: pa.Table) -> pa.Table:
        days_of = days_of.sort_by("d").combine_chunks()
        held = days_of.column("trades").combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        flat, width = held.flatten(), pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        trades = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pnl_c", "mae_c", "mfe_c", "fall_c")}
        lo = int(days_of.column("block")[0].as_py()) * block
        hi = min(paths, lo + block)
        outcome, walked, bal = walk_paths(draw_block(seed, lo, hi, days) % len(width), np.cumsum(width) - width, width, trades, rules)
        names = pa.DictionaryArray.from_arrays(pa.array(outcome), pa.array(["open", "passed", "busted"])).cast(pa.string())
        return pa.table({"account": pa.array(np.full(hi - lo, days_of.column("account")[0].as_py()), pa.int64()), "path": pa.array(np.arange(lo, hi), pa.int32()), "outcome": names, "days": pa.array(walked), "balance_c": pa.array(bal)})

    blocks = F.explode(F.sequence(F.lit(0), F.lit((paths - 1) // block)))
    rows = pool.where("account is not null").select(F.col("account").cast("long").alias("account"), "d", "trades", blocks.alias("block"))
    return rows.groupBy("account", "block").applyInArrow(run, "account long, path int, outcome string, days long, balance_c long")


def flat_floor(r: dict) -> bool:
    """Whether the floor stands still within a day and nothing but it and the target ends
    a path: then a day is known by its total and its deepest point."""
    whole = all(isinstance(r[c], int) for c in ("start", "target", "max_dd", "lock") if r[c] is not None)
    return whole and r["hwm"] != "intraday" and r["day_loss"] is None and (r["consistency"] is None or r["target"] is None)


def packed_days(account: np.ndarray, d: np.ndarray, trades: dict[str, np.ndarray], r: dict) -> dict[str, np.ndarray]:
    """Pool days of trades in order of account, d and trade: account, first trade, width,
    total and deepest point (``low``) of each, and of each trade the result of its day up
    to it (``deep`` at its worst, ``left`` where it breaks the floor)."""
    first = np.flatnonzero(np.r_[True, (account[1:] != account[:-1]) | (d[1:] != d[:-1])])
    width, pnl = np.diff(np.r_[first, len(d)]), trades["pnl_c"]
    before = np.cumsum(pnl) - pnl
    before -= np.repeat(before[first], width)
    strict = r["breach"] == "intraday"
    deep = before + (np.minimum(trades["mae_c"], pnl) if strict else pnl)
    return {"account": account[first], "first": first, "width": width, "total": np.add.reduceat(pnl, first), "low": np.minimum.reduceat(deep, first), "deep": deep, "left": before if strict else before + pnl}


def walk_days(drawn: np.ndarray, pool: dict[str, np.ndarray], rows: np.ndarray, r: dict, tile: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``walk_paths`` for accounts with equally many pool days, under rules with a
    ``flat_floor``: outcome, days and balance with a row per path and a column per
    account. ``drawn`` has a row per day of the path, ``rows`` a row per pool day with its
    place in ``pool`` for each account. One look-up of a drawn day serves all accounts,
    ``tile`` paths at a time."""
    (days, n), a = drawn.shape, rows.shape[1]
    dd, start = r["max_dd"] or 0, r["start"]
    total, low = pool["total"][rows], pool["low"][rows]
    most = days * int(np.abs(total).max()) + int(np.abs(low).max()) + 4 * (dd + abs(r["target"] or 0) + abs(r["lock"] or 0))
    kind = np.int32 if most < 2**30 else np.int64
    total, low = np.ascontiguousarray(total, kind), np.ascontiguousarray(low + dd, kind)
    cap = kind(most if r["lock"] is None else r["lock"])
    outcome, walked, balance = np.zeros((n, a), np.int8), np.full((n, a), days, np.int16 if days < 2**15 else np.int64), np.empty((n, a), np.int64)
    tile = tile or 24_000 // a  # what a cache holds
    for lo in range(0, n, tile):
        shape = (min(n - lo, tile), a)
        # Money above the floor that an equally high peak would give, the floor, both seen from the start.
        c, floor = np.full(shape, -dd, kind), np.full(shape, min(kind(-dd), cap), kind)
        m, bust, won, done = np.empty(shape, kind), np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, bool)
        flat_c, flat_line, flat_done, flat_bust = c.ravel(), floor.ravel(), done.ravel(), bust.ravel()
        ended, open_ = [], done.size
        for day in range(days):
            i = drawn[day, lo : lo + tile]
            if r["max_dd"] is not None:
                np.take(low, i, axis=0, out=m, mode="clip")
                np.add(m, c, out=m)
                np.less_equal(m, floor, out=bust)
            np.take(total, i, axis=0, out=m, mode="clip")
            np.add(c, m, out=c)
            if r["target"] is not None and day + 1 >= r["min_days"]:
                np.greater_equal(c, kind(r["target"] - dd), out=won)
                np.logical_or(won, bust, out=won)
            else:
                won[:] = bust
            np.greater(won, done, out=won)
            at = np.flatnonzero(won)
            if len(at):
                ended.append((at, np.full(len(at), day), i[at // a], flat_c[at], flat_line[at], flat_bust[at]))
                flat_done[at] = True
                open_ -= len(at)
                if not open_:
                    break
            if r["hwm"] == "eod":
                np.minimum(c, cap, out=m)
                np.maximum(floor, m, out=floor)
        end = balance[lo : lo + tile].ravel()  # a tile of whole rows is one piece, so these are views
        end[:] = flat_c
        end += dd + start
        if ended:
            at, day, i, now, line, broke = (np.concatenate(x) for x in zip(*ended))
            outcome[lo : lo + tile].ravel()[at] = np.where(broke, 2, 1)
            walked[lo : lo + tile].ravel()[at] = np.where(broke, day, day + 1)
            now = now.astype(np.int64) + dd
            at_b, place, line = at[broke], rows[i[broke], at[broke] % a], line[broke].astype(np.int64)
            held, t = now[broke] - pool["total"][place], pool["first"][place]
            while True:  # to the trade that breaks the floor; the day has one
                on = np.flatnonzero(held + pool["deep"][t] > line)
                if not len(on):
                    break
                t[on] += 1
            end[at] = now + start
            end[at_b] = held + pool["left"][t] + start
    return outcome, walked, balance


@lru_cache(maxsize=16)
def drawn_days(seed: int, lo: int, hi: int, days: int) -> np.ndarray:
    """``draw_block`` with a row per day of the path."""
    return np.ascontiguousarray(draw_block.__wrapped__(seed, lo, hi, days).T.astype(np.uint32))


def shares_of(pool: dict[str, np.ndarray], trades: dict[str, np.ndarray], rules: dict, paths: int, days: int, seed: int, block: int) -> Iterator[tuple]:
    """Of each account of the pool: account, paths, passed, busted, sum of days to the
    pass, and percentiles 5, 50 and 95 of the balances."""
    begin = np.flatnonzero(np.r_[True, pool["account"][1:] != pool["account"][:-1]])
    held = np.diff(np.r_[begin, len(pool["account"])])
    blocks = [(lo, min(paths, lo + block)) for lo in range(0, paths, block)]
    flat = flat_floor(rules)
    for n in np.unique(held):
        of, drawn = np.flatnonzero(held == n), {}
        while len(of):
            a = next(k for k in (8, 4, 2, 1) if k <= len(of)) if flat else 1
            mine, of = of[:a], of[a:]
            parts = []
            for lo, hi in blocks:
                if flat:
                    if lo not in drawn:
                        u = drawn_days(seed, lo, hi, days)
                        drawn = {lo: (u - u // np.uint32(n) * np.uint32(n)).astype(np.intp)}
                    parts.append(walk_days(drawn[lo], pool, begin[mine] + np.arange(n)[:, None], rules))
                else:
                    at = slice(begin[mine[0]], begin[mine[0]] + n)
                    parts.append(tuple(x[:, None] for x in walk_paths(draw_block(seed, lo, hi, days) % n, pool["first"][at], pool["width"][at], trades, rules)))
            outcome, walked, bal = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts))
            passed = outcome == 1
            spots = [(paths - 1) * (q / 100) for q in (5, 50, 95)]
            bal = np.partition(np.ascontiguousarray(bal.T), sorted({k for s in spots for k in (int(np.floor(s)), int(np.ceil(s)))}), axis=1)
            for j, k in enumerate(mine):
                mid = []
                for s in spots:
                    l, h = int(np.floor(s)), int(np.ceil(s))
                    x, y = int(bal[j, l]), int(bal[j, h])
                    mid.append(float(x) if l == h or x == y else (h - s) * x + (s - l) * y)
                yield int(pool["account"][begin[k]]), paths, int(passed[:, j].sum()), int((outcome[:, j] == 2).sum()), int(walked[:, j][passed[:, j]].sum(dtype=np.int64)), *mid


def bootstrap_rollup(trades: DataFrame, rules: dict, paths: int, days: int, seed: int = 7, order: tuple[str, ...] = ("trade_no",), block: int = 20_000, rows: int = 1_000_000) -> DataFrame:
    """The ``rollup`` of the ``bootstrap`` of the trades' day pool, without a row per path.

    ``order`` orders the trades of an account and date. The trades are shuffled once, by
    account; a task packs the accounts of about ``rows`` trades at a time and walks those
    with equally many days side by side, ``block`` paths at a time. An account's trades
    and the balances of its paths are in one task.
    """
    used = ["pnl_c", "mae_c", *["mfe_c", "fall_c"] * (not flat_floor(rules))]
    names = ["account", "n_paths", "passed", "busted", "pass_days", "balance_p5", "balance_p50", "balance_p95"]

    def summed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        account, d, *money = (np.concatenate(x) for x in zip(*held))
        trades = dict(zip(used, money)) | {c: np.zeros(0, np.int64) for c in ("mfe_c", "fall_c") if c not in used}
        out = zip(*shares_of(packed_days(account, d, trades, rules), trades, rules, paths, days, seed, block))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 5 else pa.float64()) for k, x in enumerate(out)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if n + cut >= rows and (cut or held[-1][0][-1] != now[0][0]):
                yield summed([*held, [c[:cut] for c in now]])
                held, n, now = [], 0, [c[cut:] for c in now]
            held, n = [*held, now], n + len(now[0])
        if held:
            yield summed(held)

    day = F.coalesce(F.unix_date("d"), F.lit(2**31 - 1)).alias("_d")
    money = {"fall_c": fall_bound().alias("fall_c")}
    listed = trades.where("account is not null").select(F.col("account").cast("long").alias("account"), day, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *[money.get(c, F.col(c)) for c in used])
    # By number: a partition is hours of walking where it is few bytes, so it is not for the adaptive plan to merge.
    parts = listed.repartition(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), "account").sortWithinPartitions("account", "_d", *[f"_o{k}" for k in range(len(order))])
    got = parts.select("account", "_d", *used).mapInArrow(run, ", ".join(f"{c} {'long' if k < 5 else 'double'}" for k, c in enumerate(names)))
    share = lambda c: F.round(F.col(c) / F.col("n_paths"), 6)
    return got.select(
        "account", "n_paths", share("passed").alias("p_pass"), share("busted").alias("p_bust"), F.round((F.col("n_paths") - F.col("passed") - F.col("busted")) / F.col("n_paths"), 6).alias("p_open"),
        F.round(F.try_divide("pass_days", "passed"), 6).alias("mean_pass_day"), *[F.round(c, 2).alias(c) for c in names[5:]])


def rollup(paths: DataFrame) -> DataFrame:
    """Shares of outcomes, mean days and balance percentiles of each account's paths."""
    share = lambda o: F.round(F.avg((F.col("outcome") == o).cast("int")), 6)
    return paths.groupBy("account").agg(
        F.count(F.lit(1)).alias("n_paths"), share("passed").alias("p_pass"), share("busted").alias("p_bust"), share("open").alias("p_open"),
        F.round(F.avg(F.when(F.col("outcome") == "passed", F.col("days"))), 6).alias("mean_pass_day"),
        *[F.round(F.percentile("balance_c", F.lit(q / 100)), 2).alias(f"balance_p{q}") for q in (5, 50, 95)])


def parametric_trades(grid: DataFrame, p: float, rr: float, risk_c: int, friction_c: int, seed: int = 7) -> DataFrame:
    """Bernoulli trades for each (path, slot): won with probability p for rr times the
    risk, else lost; half of the other side is given up on the way. Hash draws."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "path", "slot")), 1, 8), 16, 10).cast("long")
    won = u < int(p * 2**32)
    reward = int(round(rr * risk_c))
    pnl = F.when(won, F.lit(reward)).otherwise(F.lit(-risk_c)) - friction_c
    return grid.select("path", "slot", pnl.cast("long").alias("pnl_c"), F.when(won, -(risk_c // 2)).otherwise(-risk_c).cast("long").alias("mae_c"), F.when(won, reward).otherwise(reward // 2).cast("long").alias("mfe_c"))
