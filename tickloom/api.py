"""The engine as functions: status, strategies, backtests, sweeps, plugin checks."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import stats
from .operators import bars as B
from .operators import fills as X
from .operators import strategies as S
from .operators import summary as T
from .operators import window_break as W
from .sources import files

#: A strategy makes candidates from (ticks, numbered bars, bar seconds, parameters).
Builder = Callable[[DataFrame, DataFrame, int, dict], DataFrame]


@dataclass(frozen=True)
class Strategy:
    """Builder, parameters as (default, lo, hi), whether it trades the whole session, and,
    where all combinations of a sweep can be made at once, a builder of candidates with
    combo_no out of (bars, table of all parameters by combo_no). A parameter cooldown_min
    is the rest after a trade closes, in minutes."""

    build: Builder
    params: dict[str, tuple[float, float, float]]
    full_session: bool = False
    grid: Callable[[DataFrame, DataFrame], DataFrame] | None = None


STRATEGIES: dict[str, Strategy] = {
    "ma_cross": Strategy(lambda t, b, s, p: S.ma_cross(b, int(p["fast"]), int(p["slow"]), int(p["stop_ticks"]), p["rr"]), {"fast": (20, 2, 200), "slow": (60, 5, 500), "stop_ticks": (40, 4, 200), "rr": (2.0, 0.5, 6.0)}, grid=S.ma_cross_grid),
    "orb": Strategy(lambda t, b, s, p: S.orb(t, int(p["range_min"]), int(p["stop_ticks"]), p["rr"], bool(p["one_per_day"])), {"range_min": (15, 1, 120), "stop_ticks": (40, 4, 200), "rr": (2.0, 0.5, 6.0), "one_per_day": (1, 0, 1)}),
    "range_break": Strategy(lambda t, b, s, p: S.range_break(t, b, s, int(p["lookback"]), int(p["min_range_ticks"]), int(p["max_range_ticks"]), int(p.get("atr_period", 14)), p.get("atr_stop", 1.0), p.get("atr_target", 2.0), p.get("max_stop_ticks", 160), p.get("be_trigger_pct", 50), int(p.get("session_start", 570)), int(p.get("last_entry", 900)), bool(p.get("one_per_day", 0))),
                            {"lookback": (10, 2, 60), "min_range_ticks": (30, 1, 400), "max_range_ticks": (140, 10, 2000), "atr_period": (14, 2, 100), "atr_stop": (1.0, 0.1, 5.0), "atr_target": (2.0, 0.2, 10.0), "max_stop_ticks": (160, 8, 800), "be_trigger_pct": (50, 0, 100), "session_start": (570, 0, 1439), "last_entry": (900, 1, 1440), "one_per_day": (0, 0, 1)}),
    "sweep_follow": Strategy(lambda t, b, s, p: S.sweep_follow(t, int(p["min_volume"]), int(p["cluster_ms"]) * 1000, int(p["stop_ticks"]), p["rr"]), {"min_volume": (150, 10, 2000), "cluster_ms": (150, 10, 2000), "stop_ticks": (40, 4, 200), "rr": (2.0, 0.5, 6.0), "cooldown_min": (5, 0, 60)}),
    "fvg": Strategy(lambda t, b, s, p: S.fvg(t, b, s, int(p["min_ticks"]), int(p["expiry_bars"]), int(p["stop_ticks"]), p["rr"], bool(p.get("one_per_day", 0))), {"min_ticks": (8, 1, 200), "expiry_bars": (12, 1, 200), "stop_ticks": (40, 4, 200), "rr": (2.0, 0.5, 6.0), "one_per_day": (0, 0, 1)}),
    "vwap_revert": Strategy(lambda t, b, s, p: S.vwap_revert(b, int(p["stretch_ticks"]), int(p["min_bar"]), int(p["stop_ticks"]), p["rr"]), {"stretch_ticks": (60, 4, 400), "min_bar": (6, 0, 100), "stop_ticks": (40, 4, 200), "rr": (1.0, 0.5, 6.0), "cooldown_min": (15, 0, 240)}),
    "window_break": Strategy(lambda t, b, s, p: W.window_break(t, b, s, W.BreakRules(hold_s=int(p["hold_seconds"]), candle_s=int(p["candle_seconds"]), extension=p["extension"])), {"hold_seconds": (30, 0, 600), "candle_seconds": (30, 5, 600), "extension": (0.25, 0.0, 3.0)}, full_session=True),
}


def register(name: str, strategy: Strategy) -> None:
    """Adds a strategy; a name that is taken is refused."""
    if name in STRATEGIES:
        raise ValueError(f"the name is taken: {name}")
    STRATEGIES[name] = strategy


def tape_status(ticks: DataFrame) -> DataFrame:
    """First and last day, sessions and ticks of each contract."""
    return B.available_range(ticks)


def _parameters(s: Strategy, given: dict | None) -> dict:
    unknown = set(given or {}) - set(s.params)
    if unknown:
        raise ValueError(f"no such parameters: {sorted(unknown)}")
    return {k: v[0] for k, v in s.params.items()} | (given or {})


def _rested(rules: X.FillRules, p: dict) -> X.FillRules:
    return replace(rules, cooldown_min=p["cooldown_min"]) if "cooldown_min" in p else rules


def backtest(ticks: DataFrame, name: str, period: str | int = "5m", params: dict | None = None, first: str | None = None, last: str | None = None, rules: X.FillRules = X.FillRules(), governor_day: Column | None = None) -> DataFrame:
    """Trades of a strategy: slice, bars, candidates, fills."""
    s = STRATEGIES[name]
    p, seconds = _parameters(s, params), B.parse_period(period)
    part = B.slice_range(ticks, first, last, rth=not s.full_session)
    return X.resolve(part, s.build(part, B.numbered(B.build_bars(part, seconds)), seconds, p), _rested(rules, p), governor_day)


def priced(trades: DataFrame, tick_size: float, point_value: float, commission: float = 0.0, contracts: int = 1) -> DataFrame:
    """Trades in money: gross, costs (``commission`` for a contract's round trip) and net."""
    gross = F.col("pnl") * tick_size * point_value * contracts
    return trades.withColumns({"gross": gross, "costs": F.lit(float(commission * contracts)), "net": gross - commission * contracts})


def run_summary(trades: DataFrame, point_value: float = 1.0, tick_size: float = 1.0, commission: float = 0.0) -> DataFrame:
    """Totals in money of a backtest per contract: trades, result, win rate, worst fall."""
    money = F.col("pnl") * tick_size * point_value - commission
    return trades.withColumn("money", money).groupBy("contract").agg(
        F.count(F.lit(1)).alias("n"), F.sum("money").alias("pnl"), F.avg((F.col("money") > 0).cast("int")).alias("win_rate"), F.max(F.col("fall") * tick_size * point_value).alias("max_fall"))


def sweep_candidates(part: DataFrame, name: str, ranges: dict[str, list[float]], seconds: int) -> tuple[DataFrame, int]:
    """(candidates with combo_no, number of combinations) of all combinations over one slice."""
    s = STRATEGIES[name]
    _parameters(s, {k: None for k in ranges})
    combos = stats.grid(part.sparkSession, ranges)
    bars = B.numbered(B.build_bars(part, seconds))
    rows = combos.collect()
    if s.grid:
        return s.grid(bars, combos.withColumns({k: F.lit(float(v[0])) for k, v in s.params.items() if k not in ranges})), len(rows)
    cands = None
    for c in rows:
        one = s.build(part, bars, seconds, {k: v[0] for k, v in s.params.items()} | {k: c[k] for k in ranges}).withColumn("combo_no", F.lit(c["combo_no"]).cast("long"))
        cands = one if cands is None else cands.unionByName(one, allowMissingColumns=True)
    return cands, len(rows)


def sweep(ticks: DataFrame, name: str, ranges: dict[str, list[float]], period: str | int = "5m", rules: X.FillRules = X.FillRules(), governor_day: Column | None = None, ledger: str | None = None) -> DataFrame:
    """One row per combination, best first by ``place``: trades, result, sub-periods and
    verdict. The combination is a column of the candidates: the ticks are read and shuffled
    once for all of them. A cooldown is the strategy's own and cannot be swept. With a
    ``ledger`` the sweep is charged to it before anything is judged, and the noise ceiling
    is that of all its trials."""
    s, seconds = STRATEGIES[name], B.parse_period(period)
    if "cooldown_min" in ranges:
        raise ValueError("cooldown_min is one for the whole sweep; set it in the rules")
    part = B.slice_range(ticks, rth=not s.full_session)
    cands, n = sweep_candidates(part, name, ranges, seconds)
    trials = n
    if ledger:
        what = {"kind": "sweep", "strategy": name, "period": seconds, "ranges": ranges}
        files.append_ledger(ledger, "sweep", strategy=name, fp=stats.fingerprint(what), n_trials=n, ranges=ranges)
        trials = files.ledger_trials(ledger)
    done = X.resolve(part, cands, _rested(rules, {k: v[0] for k, v in s.params.items()}), governor_day)
    daily = done.groupBy("combo_no", "cal_day").agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n"))
    rows = daily.groupBy("combo_no").agg(F.sum("n").alias("n"), F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("days"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"))
    t = F.when((F.col("days") >= 20) & (F.col("s") > 0), F.col("m") / (F.col("s") / F.sqrt("days")))
    rows = rows.withColumn("t_daily", t).drop("m", "s").join(T.subperiods(daily, "combo_no", "cal_day", "pnl"), "combo_no")
    rows = stats.grid(ticks.sparkSession, ranges).join(rows, "combo_no", "left").fillna(0, ["n", "pnl", "days", "positive"])
    rows = rows.withColumn("verdict", stats.verdict(F.col("t_daily"), F.col("n"), F.col("positive"), stats.expected_max_t(trials)))
    return stats.ranked(rows, "combo_no")


def check_candidates(candidates: DataFrame, ticks: DataFrame) -> DataFrame:
    """(entry_seq, problem): candidates that break the contract of a strategy's output:
    unknown tick, direction not 1 or -1, stop or target missing or on the wrong side."""
    at = ticks.select("contract", F.col("seq").alias("entry_seq"), "px_ticks")
    rows = candidates.join(at, ["contract", "entry_seq"], "left")
    d = F.col("dir")
    problem = (F.when(F.col("px_ticks").isNull(), "no such tick").when(~d.isin(1, -1), "direction").when(F.col("stop").isNull() | F.col("target").isNull() | F.isnan(F.col("stop").cast("double")) | F.isnan(F.col("target").cast("double")), "not a number")
               .when(d * (F.col("px_ticks") - F.col("stop")) <= 0, "stop on the wrong side").when(d * (F.col("px_ticks") - F.col("target")) >= 0, "target on the wrong side"))
    return rows.select("contract", "entry_seq", problem.alias("problem")).where("problem is not null")


#: Names that plugin code may not use, and the modules that it may import.
FORBIDDEN = frozenset("eval exec compile open input __import__ globals locals vars getattr setattr delattr breakpoint".split())
ALLOWED = frozenset(("math", "numpy", "pyspark", "tickloom"))


def check_source(source: str) -> list[str]:
    """Why plugin code is refused, without running it; empty if it is not."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"line {e.lineno}: not Python"]
    out = []
    for node in ast.walk(tree):
        line = getattr(node, "lineno", 0)
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""]
            out += [f"line {line}: import of {n}" for n in names if n.split(".")[0] not in ALLOWED]
        elif isinstance(node, ast.Name) and node.id in FORBIDDEN:
            out.append(f"line {line}: {node.id}")
        elif isinstance(node, ast.Attribute) and node.attr.startswith("__"):
            out.append(f"line {line}: {node.attr}")
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            out.append(f"line {line}: {type(node).__name__.lower()}")
    return out


def lookahead_probe(ticks: DataFrame, build: Callable[[DataFrame], DataFrame], cut_day: str, shift: int = 37) -> int:
    """Number of entries before ``cut_day`` that change when later prices are shifted; see
    probe_entries for cuts inside days and for sides."""
    cut = F.lit(cut_day).cast("date")
    moved = ticks.withColumn("px_ticks", F.when(F.col("cal_day") >= cut, F.col("px_ticks") + shift).otherwise(F.col("px_ticks")))
    a, b = (build(t).where(F.col("cal_day") < cut) for t in (ticks, moved))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).count()


def probe_cuts(entries: DataFrame, cuts: int = 6) -> list[tuple[int, int]]:
    """(cut_no, cut) of up to ``cuts`` cuts, each at the seq behind an entry: the entries'
    first, last and those at even ranks between them. seq orders the ticks of all contracts."""
    seqs = entries.select("entry_seq").distinct()
    w = Window.orderBy("entry_seq")  # one row per entry
    n = seqs.count()
    ranks = sorted({i * (n - 1) // (cuts - 1) if cuts > 1 else 0 for i in range(min(n, cuts))} if n > cuts else range(n))
    rows = seqs.withColumn("r", F.row_number().over(w) - 1).where(F.col("r").isin(ranks)).orderBy("r").collect()
    return [(i, int(r["entry_seq"]) + 1) for i, r in enumerate(rows)]


def perturbed(ticks: DataFrame, cut: int, shift: int = 100) -> DataFrame:
    """Ticks with prices shifted and sides turned from seq ``cut`` on; times, and so the bars' bounds, stay."""
    late = F.col("seq") >= cut
    return ticks.withColumns({"px_ticks": F.when(late, F.col("px_ticks") + shift).otherwise(F.col("px_ticks")), "side": F.when(late, -F.col("side")).otherwise(F.col("side")).cast(ticks.schema["side"].dataType)})


def probe_entries(ticks: DataFrame, build: Callable[[DataFrame], DataFrame], cuts: int = 6, shift: int = 100) -> DataFrame:
    """(cut_no, cut, compared, differing): for cuts one tick behind sampled entries, the
    entries up to the cut and how many of them change, come or go when all that is
    behind it changes. No row means that there was no entry to test."""
    base = build(ticks)
    found = probe_cuts(base, cuts)
    if not found:
        return ticks.sparkSession.createDataFrame([], "cut_no int, cut long, compared long, differing long")
    tag = lambda no, cut: F.struct(F.lit(no).alias("cut_no"), F.lit(cut).cast("long").alias("cut"))
    rows = base.withColumn("_c", F.explode(F.array(*[tag(*c) for c in found]))).withColumn("_w", F.lit(1))
    for no, cut in found:
        rows = rows.unionByName(build(perturbed(ticks, cut, shift)).withColumn("_c", tag(no, cut)).withColumn("_w", F.lit(-1)))
    # Equal entries of both runs cancel; what is left came, went or changed.
    rows = rows.where("entry_seq < _c.cut").groupBy("_c", *base.columns).agg(F.sum("_w").alias("d"), F.count_if(F.col("_w") == 1).alias("n"))
    return rows.groupBy("_c").agg(F.sum("n").alias("compared"), F.sum(F.abs("d")).alias("differing")).select("_c.cut_no", "_c.cut", "compared", "differing")
