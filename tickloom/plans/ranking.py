"""Ranks and neighbours inside a key without ever putting a key in one task.

``Window.partitionBy(key)`` sends all rows of a key to one task; a key that
holds a third of the table then bounds the job. Here rows are first put into
buckets of the order value; the counts of (key, bucket) are aggregated on the
map side, their running sums give each bucket's offset, and the row window is
partitioned by (key, bucket). The window over counts has one row per bucket, so
it is bounded by the span of the order value, not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, key: list[str], order: str, width: int, name: str = "rank", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``: 1-based rank by (order, ties) within key.

    ``order`` is an integral column; ``width`` the bucket width in its unit.
    Rows with a null order get bucket null and rank first (nulls sort first).
    The result keeps ``_bucket``-free columns only.
    """
    bucket = F.floor(F.col(order) / F.lit(width)).cast("long")
    rows = df.withColumn("_bucket", F.coalesce(bucket, F.lit(-(2**62))))
    within = Window.partitionBy(*key, "_bucket").orderBy(order, *ties)
    local = rows.withColumn("_local", F.row_number().over(within))
    counts = rows.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
    )
    on: Column = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(base, on).withColumn(name, F.col("_base") + F.col("_local")).select(*df.columns, name)


def bucketed_prior(df: DataFrame, key: list[str], order: str, width: int, columns: dict[str, str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds for each ``columns`` name -> alias the value of the row before within key by
    (order, ties), which are unique: ranks joined to the rank before, no window over a
    whole key."""
    ranked = bucketed_rank(df, key, order, width, "_rank", ties)
    prior = ranked.select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(key)], (F.col("_rank") + 1).alias("_next"), *[F.col(c).alias(a) for c, a in columns.items()])
    on: Column = F.col("_rank") == F.col("_next")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_q{i}"))
    return ranked.join(prior, on, "left").select(*df.columns, *columns.values())


def running_sum(df: DataFrame, key: list[str], bucket: str, order: str, value: str) -> DataFrame:
    """Adds ``run`` (sum of ``value`` up to the row within key) and ``peak`` (the largest
    run so far, at least zero). ``bucket`` is a column that never falls along ``order``;
    windows hold the rows of one (key, bucket), or one row per bucket of a key."""
    inner = Window.partitionBy(*key, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_in", F.sum(value).over(inner)).withColumn("_top", F.max("_in").over(inner))
    per = rows.groupBy(*key, bucket).agg(F.sum(value).alias("_sum"), F.max("_in").alias("_max"))
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    per = per.withColumn("_high", F.greatest(F.lit(0), F.max(F.col("_base") + F.col("_max")).over(before)))
    per = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*key, bucket])], "_base", "_high")
    on: Column = F.lit(True)
    for i, k in enumerate([*key, bucket]):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(per, on).withColumn("run", F.col("_base") + F.col("_in"))
    return out.withColumn("peak", F.greatest(F.lit(0), F.col("_high"), F.col("_base") + F.col("_top"))).select(*df.columns, "run", "peak")
