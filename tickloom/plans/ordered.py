"""Ordered sequences of any length, cut into even chunks with a halo.

A sequence operator (spikes, runs, recursive filters) wants a key's rows in
order with some neighbours on both sides, but a key may hold a third of all
rows. The rows of each key are counted per coarse bin of the order value; the
running counts give every bin its range of positions, and the key is divided
into chunks of nearly equal size. A bin goes to every chunk that its positions
or the chunk's halo touch; a bin of more rows than a chunk is cut into PARTS finer
ones first. Each chunk is then one group of bounded size, in which every row knows
its exact position.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Finer bins of a bin that is larger than a chunk.
PARTS = 4_096
#: Large bins up to which their list is broadcast; more are joined.
MOST_BROADCAST = 100_000


def chunked(df: DataFrame, key: str, order: str, bin_width: int, target: int, halo: int) -> DataFrame:
    """Adds _chunk, _base (position of the first row of the chunk's group), _lo and
    _hi (the positions that the chunk owns, end exclusive). Rows in a halo appear
    in more than one chunk. ``target`` is the wished number of rows in a chunk.
    """
    rows = df.withColumn("_bin", F.floor(F.col(order) / F.lit(bin_width)).cast("long"))
    # One row per bin, kept: the large bins are looked for among them, mostly in vain.
    bins = checkpointed(rows.groupBy(key, "_bin").agg(F.count(F.lit(1)).alias("_n")))
    large = bins.where(F.col("_n") > target).select(F.col(key).alias("_lk"), F.col("_bin").alias("_lb"))
    found = large.limit(MOST_BROADCAST + 1).count()
    if found:
        large = F.broadcast(large) if found <= MOST_BROADCAST else large
        rows = rows.join(large, (F.col(key) == F.col("_lk")) & (F.col("_bin") == F.col("_lb")), "left")
        fine = F.floor(F.col(order) / F.lit(max(1, bin_width // PARTS))).cast("long")
        rows = rows.withColumn("_fine", F.when(F.col("_lk").isNotNull(), fine).otherwise(F.lit(0).cast("long"))).drop("_lk", "_lb")
        bins = rows.groupBy(key, "_bin", "_fine").agg(F.count(F.lit(1)).alias("_n"))
    else:
        rows, bins = (x.withColumn("_fine", F.lit(0).cast("long")) for x in (rows, bins))
    running = Window.partitionBy(key).orderBy("_bin", "_fine").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    bins = bins.withColumn("_end", F.sum("_n").over(running)).withColumn("_total", F.sum("_n").over(whole))
    bins = bins.withColumn("_start", F.col("_end") - F.col("_n"))
    bins = bins.withColumn("_size", F.ceil(F.col("_total") / F.greatest(F.lit(1), F.round(F.col("_total") / target))).cast("long"))
    first = F.greatest(F.lit(0), F.floor((F.col("_start") - halo) / F.col("_size"))).cast("long")
    last = F.least(F.floor((F.col("_total") - 1) / F.col("_size")), F.floor((F.col("_end") - 1 + halo) / F.col("_size"))).cast("long")
    bins = bins.withColumn("_chunk", F.explode(F.sequence(first, last)))
    bins = bins.withColumn("_base", F.min("_start").over(Window.partitionBy(key, "_chunk")))
    bins = bins.select(F.col(key).alias("_k"), F.col("_bin").alias("_b"), F.col("_fine").alias("_f"), "_chunk", "_base", (F.col("_chunk") * F.col("_size")).alias("_lo"), ((F.col("_chunk") + 1) * F.col("_size")).alias("_hi"))
    return rows.join(bins, (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")) & (F.col("_fine") == F.col("_f"))).drop("_k", "_b", "_f", "_bin", "_fine")


def over_sequence(df: DataFrame, key: str, order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, bin_width: int, target: int = 60_000, halo: int = 1_000) -> DataFrame:
    """Applies ``fn`` to each chunk in order.

    ``fn`` gets the ordered rows of one chunk with its halo and the boolean
    column ``own``; it returns one row per row that it wants to report, and must
    not report rows that are not its own.
    """
    cut = chunked(df, key, order[0], bin_width, target, halo)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable", ignore_index=True)
        place = part["_base"].iloc[0] + part.index.to_numpy()
        part["own"] = (place >= part["_lo"].iloc[0]) & (place < part["_hi"].iloc[0])
        return fn(part.drop(columns=["_chunk", "_base", "_lo", "_hi"]))

    return cut.groupBy(key, "_chunk").applyInPandas(run, schema)
