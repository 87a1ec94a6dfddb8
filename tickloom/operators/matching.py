"""Join-shaped operators on executions, accounts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import bucketed_prior


def pair_executions(executions: DataFrame, key: tuple[str, ...] = ("account", "instrument")) -> DataFrame:
    """Entry and exit of each round trip of one account in one instrument.

    A later entry replaces an open one and an exit closes it, so an exit pairs with
    the entry exactly where the entry is the row before it among entries and exits.
    A row flagged both is an entry. Exits without entry are dropped.
    """
    rows = executions.where("is_entry or is_exit")
    prior = {"seq": "p_seq", "us": "p_us", "action": "p_action", "is_entry": "p_entry"}
    rows = bucketed_prior(rows, [*key], "us", 86_400_000_000, prior, ("seq",)).where("not is_entry and p_entry")
    return rows.select(*key, F.col("p_seq").alias("entry_seq"), F.col("seq").alias("exit_seq"), F.col("p_action").alias("entry_action"), F.col("action").alias("exit_action"), (F.col("us") - F.col("p_us")).alias("held_us"))


def side_check(pairs: DataFrame) -> DataFrame:
    """Pairs whose two actions are on one side (dropped from trades) and the rest, counted."""
    same = F.pmod(F.col("entry_action"), F.lit(2)).isNotNull() & (F.col("entry_action") == F.col("exit_action"))
    return pairs.groupBy(same.alias("same_side")).agg(F.count(F.lit(1)).alias("n"))


def attributed(pairs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Strategy of each pair by the bridge (execution, strategy): the entry's, else the exit's."""
    e = bridge.select(F.col("execution").alias("entry_seq"), F.col("strategy").alias("se"))
    x = bridge.select(F.col("execution").alias("exit_seq"), F.col("strategy").alias("sx"))
    out = pairs.join(e, "entry_seq", "left").join(x, "exit_seq", "left")
    return out.select("account", "instrument", "entry_seq", "exit_seq", F.coalesce("se", "sx", F.lit("?")).alias("strategy"))


def longest_prefix(names: DataFrame, prefixes: DataFrame, name: str) -> DataFrame:
    """Label of the longest prefix (case-blind) that begins each name; ties to the
    smaller prefix_no. An equi-join on the prefixes of each name, no theta join."""
    p = prefixes.select(F.upper("prefix").alias("px"), "label", "prefix_no").groupBy("px").agg(F.min_by("label", "prefix_no").alias("label"))
    probes = names.select(name, F.explode(F.sequence(F.lit(1), F.length(name))).alias("n")).where(F.length(name) > 0).withColumn("px", F.upper(F.substring(F.col(name), F.lit(1), F.col("n"))))
    best = probes.join(p, "px").groupBy(name).agg(F.max_by("label", "n").alias("label"))
    return names.join(best, name, "left").withColumn("label", F.coalesce("label", F.lit("?")))


def fidelity() -> Column:
    """How far the fills of a run (columns source, fill_resolution, fill_resolution_type,
    fill_resolution_value, bar_type, bar_value) can be trusted: 'unknown' where they were
    not recorded, 'exact' if they were resolved on single ticks, by High resolution of one
    tick or on bars of one tick, else 'fills-guessed'. High alone is not tick resolution."""
    one = lambda c: F.coalesce(F.col(c), F.lit(0.0)) <= 1
    fine = F.coalesce((F.col("fill_resolution") == "High") & (F.col("fill_resolution_type") == "Tick") & one("fill_resolution_value"), F.lit(False))
    bars = F.coalesce((F.col("bar_type") == "Tick") & one("bar_value"), F.lit(False))
    return F.when(F.col("fill_resolution").isNull() | F.coalesce(F.col("source") == "nt8-performance-metric", F.lit(False)), "unknown").when(fine | bars, "exact").otherwise("fills-guessed")


def capture_level(source: str = "source", resolution: str = "fill_resolution") -> Column:
    """Whether a capture recorded how its fills were made: 'unknown' for one by the
    performance metric, which never sees the strategy, or without a fill resolution."""
    return F.when((F.col(source) == "nt8-performance-metric") | F.col(resolution).isNull(), "unknown").otherwise("known")


def first_entries(records: DataFrame) -> DataFrame:
    """(run_id, first_entry): earliest entry of the listed trades with both times; a run
    without any has no row."""
    return records.where("entry is not null and exit is not null").groupBy("run_id").agg(F.min("entry").alias("first_entry"))


def dedup_runs(runs: DataFrame, key: list[str], label: str, order: str) -> DataFrame:
    """One row per key: labelled before unknown, then the newest by ``order``; rows with
    a null key part pass through."""
    whole = None
    for k in key:
        whole = F.col(k).isNotNull() if whole is None else whole & F.col(k).isNotNull()
    rank = F.struct((F.lower(F.coalesce(label, F.lit("unknown"))) != "unknown").alias("a"), F.col(order).alias("b"))
    names = runs.columns
    best = runs.where(whole).groupBy(*key).agg(F.max_by(F.struct(*names), rank).alias("x")).select("x.*")
    return best.unionByName(runs.where(~whole)).select(*names)


def cost_basis(runs: DataFrame, trades: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, basis, subtract_costs): whether the profits of a run's trades already bear
    commission and fee, told by the run's own totals.

    trades: run, profit, commission, fee (null counts as zero); a run without trades has
    sums of zero. 'net': the sum of the profits is the total, and the costs are more than
    the tolerance, the larger of 1 and half a percent; 'gross': it is gross profit plus
    gross loss; 'no totals': none is recorded; else 'unreconciled'. Costs are still to be
    taken off in all but the first.
    """
    zero = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    sums = trades.select(run, zero("profit").alias("p"), (zero("commission") + zero("fee")).alias("c")).groupBy(run).agg(F.sum("p").alias("_profit"), F.sum("c").alias("_costs"))
    rows = runs.join(sums, run, "left").fillna(0.0, ["_profit", "_costs"])
    tol = F.greatest(F.lit(1.0), 0.005 * F.abs("_profit"))
    near = lambda c: F.coalesce(F.abs(F.col("_profit") - c) <= tol, F.lit(False))
    none = F.col("perf_cum_profit").isNull() & F.col("perf_gross_profit").isNull() & F.col("perf_gross_loss").isNull()
    basis = F.when(near(F.col("perf_cum_profit")) & (F.col("_costs") > tol), "net").when(near(F.col("perf_gross_profit") + F.col("perf_gross_loss")), "gross").when(none, "no totals").otherwise("unreconciled")
    return rows.select(run, basis.alias("basis"), (basis != "net").alias("subtract_costs"))


#: Words of a variant's name that say nothing of its family, and that mark it as no longer sold.
GENERIC = ("eval", "evaluation", "funded", "sim", "s2f", "account", "path", "default", "plan", "current")
RETIRED = ("retired", "legacy", "sunset")


def phase_chain(contracts: DataFrame) -> DataFrame:
    """(firm, variant, size, next_variant, quality) for each evaluation contract: the funded
    one of the firm and size that follows.

    contracts: firm, variant, phase, size, max_dd. The same variant is 'exact'. Else, among
    those not retired if there are any, the one whose name shares the most family words,
    then equal drawdown, then the one offered in most sizes, then by name: 'family' if a
    word is shared, else 'inferred'. 'none' without any funded contract of the size.
    """
    stem = lambda c: F.array_except(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "-", "_"), "_"), lambda w: w != "")), F.array(*map(F.lit, GENERIC)))
    rows = contracts.where("firm is not null and variant is not null and size is not null")
    e = rows.where("phase = 'evaluation'").groupBy("firm", "variant", "size").agg(F.first("max_dd").alias("max_dd"))
    f = rows.where("phase = 'funded_sim'").groupBy("firm", F.col("variant").alias("v"), "size").agg(F.first("max_dd").alias("dd"))
    sizes = f.groupBy("firm", "v").agg(F.count(F.lit(1)).alias("n"))
    retired = F.lit(False)
    for word in RETIRED:
        retired = retired | F.lower("v").contains(word)
    f = f.join(sizes, ["firm", "v"]).withColumn("retired", retired)
    shared = F.coalesce(F.size(F.array_intersect(stem(F.col("variant")), stem(F.col("v")))), F.lit(0))
    # Retired ones come last of all, so they are taken only where there is nothing else; the same name goes first.
    order = F.struct((F.col("v") != F.col("variant")).alias("a"), F.col("retired").alias("b"), (-shared).alias("c"), (~F.col("dd").eqNullSafe(F.col("max_dd"))).alias("d"), (-F.col("n")).alias("e"), F.col("v").alias("f"))
    best = e.join(f, ["firm", "size"], "left").groupBy("firm", "variant", "size").agg(F.min(F.when(F.col("v").isNotNull(), order)).alias("k"))
    quality = F.when(F.col("k").isNull(), "none").when(~F.col("k.a"), "exact").when(F.col("k.c") < 0, "family").otherwise("inferred")
    return best.select("firm", "variant", "size", F.col("k.f").alias("next_variant"), quality.alias("quality"))
