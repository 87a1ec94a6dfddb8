"""Overlapping and gapped time intervals (problem 2).

Starts and ends are ranked independently per entity. With n spans, a hole lies after
rank i exactly where the (i+1)-th start exceeds the i-th end: then i spans have begun
and all i have ended. Starts and ends are put into buckets of time once; ranks inside a
bucket and the counts of the buckets before it give the global ranks. Where the two
ranks meet in one bucket the boundaries are compared there; an end whose next start is
not in its bucket has a hole behind it exactly if all starts so far are of its rank or
lower, and the next start is the first of a later bucket. Consecutive holes bound one
period. No entity is ever in one task: windows hold the rows of an (entity, bucket), or
one row per bucket of an entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import iso_micros, merged_trades, micros

DAY_US = 86_400_000_000


def continuous_periods(spans: DataFrame, entity: str, start: str, end: str, bucket: int = DAY_US) -> DataFrame:
    """Periods and gaps of integer spans.

    Args: ``start``/``end`` are bigint columns (any unit); ``bucket`` the width
    by which ranks are spread.
    Returns rows (entity, kind 'period'|'gap', start, end).

    Spans with a null entity, start or end, or with end < start, carry no time
    and are left out. Equal ends and starts touch and are joined; a span of no
    length is a period of no length where nothing else covers it. Repeated spans
    change nothing. An empty input gives no rows. Other columns are ignored.
    """
    rows = spans.select(F.col(entity).alias("e"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("t"))
    rows = rows.where("e is not null and s is not null and t is not null and t >= s")
    edge = lambda c, first: F.struct(F.floor(F.col(c) / bucket).cast("long").alias("b"), F.col(c).alias("v"), F.lit(first).alias("first"))
    edges = rows.select("e", F.explode(F.array(edge("s", True), edge("t", False))).alias("x")).select("e", "x.b", "x.v", "x.first").repartition("e", "b")
    ranked = edges.withColumn("r", F.row_number().over(Window.partitionBy("e", "b", "first").orderBy("v")))
    # One row per bucket: starts and ends before it, starts up to its end, the next bucket's first start.
    per = edges.groupBy("e", "b").agg(F.count_if("first").alias("ns"), F.count_if(~F.col("first")).alias("nt"), F.min(F.when(F.col("first"), F.col("v"))).alias("v0"))
    over = Window.partitionBy("e").orderBy("b")
    before, behind = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    per = per.select(
        F.col("e").alias("_e"), F.col("b").alias("_b"), F.coalesce(F.sum("ns").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("nt").over(before), F.lit(0)).alias("t0"), "ns",
        F.min("v0").over(behind).alias("later"), F.min("v0").over(Window.partitionBy("e")).alias("opening"))
    placed = ranked.join(per, (F.col("e") == F.col("_e")) & (F.col("b") == F.col("_b")))
    placed = placed.withColumn("i", F.when(F.col("first"), F.col("s0") + F.col("r") - 1).otherwise(F.col("t0") + F.col("r")))
    met = placed.groupBy("e", "b", "i").agg(F.min(F.when(F.col("first"), F.col("v"))).alias("s"), F.min(F.when(~F.col("first"), F.col("v"))).alias("t"), F.first("later").alias("later"), F.first("opening").alias("opening"), F.first(F.col("s0") + F.col("ns")).alias("begun"))
    holes = met.where("t is not null and (s > t or (s is null and begun = i))").select("e", "b", "i", "t", F.coalesce("s", "later").alias("next"), "opening")
    # The hole before, in the bucket or as the last one of an earlier bucket, opened the period that a hole closes.
    last = holes.groupBy("e", "b").agg(F.max_by("next", "i").alias("z"))
    last = last.select(F.col("e").alias("_e"), F.col("b").alias("_b"), F.lag("z").over(over).alias("prior"))
    holes = holes.withColumn("own", F.lag("next").over(Window.partitionBy("e", "b").orderBy("i"))).join(last, (F.col("e") == F.col("_e")) & (F.col("b") == F.col("_b")))
    piece = lambda kind, a, z: F.struct(F.lit(kind).alias("kind"), a.alias("s"), z.alias("t"))
    both = F.array(piece("period", F.coalesce("own", "prior", "opening"), F.col("t")), piece("gap", F.col("t"), F.col("next")))
    out = holes.select("e", F.explode(both).alias("x")).where("x.t is not null")
    return out.select(F.col("e").alias(entity), "x.kind", F.col("x.s").alias(start), F.col("x.t").alias(end))


def market_periods(trades: DataFrame) -> DataFrame:
    """In-market periods of each account and the gaps inside one date.

    One span per trade_id (states merged); see ``continuous_periods`` for nulls,
    ties and repeats. Returns account, kind, start_at, end_at (ISO, six decimals).
    """
    merged = merged_trades(trades, "account", "entry_time", "exit_time")
    spans = merged.select("account", micros("entry_time").alias("s"), micros("exit_time").alias("t"))
    out = continuous_periods(spans, "account", "s", "t")
    same_day = F.floor(F.col("s") / DAY_US) == F.floor(F.col("t") / DAY_US)
    out = out.where((F.col("kind") == "period") | same_day)
    return out.select("account", "kind", iso_micros(F.col("s")).alias("start_at"), iso_micros(F.col("t")).alias("end_at"))
