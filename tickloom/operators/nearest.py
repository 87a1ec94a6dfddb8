"""Matching records by nearest time (problem 7).

Both sides are cut into time blocks (the high bits of the timestamp), an anchor
also going to the block beside it when its tolerance reaches there. In a block
the low bits of the readings form an x-fast trie: one hash table per prefix
length, each present prefix knowing its smallest and largest leaf. A query
binary-searches the longest present prefix; the branch that is missing there
gives predecessor or successor, the linked leaves give the other. The nearer one
within the tolerance wins.

Readings outside all blocks that hold an anchor never reach Python: a semi-join
on (entity, block) drops them in the JVM. No task holds more than a few blocks of one
entity, however many rows the entity has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class XFastTrie:
    """Predecessor and successor over distinct integers below 2**bits."""

    def __init__(self, keys: list[int], bits: int) -> None:
        """keys: sorted and distinct."""
        self.bits, self.keys = bits, keys
        self.place = {k: i for i, k in enumerate(keys)}
        #: levels[n] maps each prefix of n bits to the places of its smallest and largest leaf.
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(bits + 1)]
        last = {k: (i, i) for i, k in enumerate(keys)}
        self.levels[bits] = last
        for n in range(bits - 1, -1, -1):
            table: dict[int, tuple[int, int]] = {}
            for prefix, (lo, hi) in last.items():
                up = prefix >> 1
                held = table.get(up)
                table[up] = (lo, hi) if held is None else (min(held[0], lo), max(held[1], hi))
            self.levels[n] = last = table

    def around(self, x: int) -> tuple[int | None, int | None]:
        """Places of the largest key <= x and of the smallest key >= x."""
        if not self.keys:
            return None, None
        exact = self.place.get(x)
        if exact is not None:
            return exact, exact
        low, high = 0, self.bits  # the prefix of length low is present, that of length high is not
        while high - low > 1:
            mid = (low + high) // 2
            if x >> (self.bits - mid) in self.levels[mid]:
                low = mid
            else:
                high = mid
        first, final = self.levels[low][x >> (self.bits - low)]
        if (x >> (self.bits - low - 1)) & 1:  # only the 0-branch exists: its largest leaf precedes x
            return final, final + 1 if final + 1 < len(self.keys) else None
        return first - 1 if first else None, first


def _match_block(asked: list[tuple[int, int]], keys: list[int], ids: list[int], bits: int, tolerance: int) -> Iterator[tuple[int, int, int]]:
    """(anchor id, distance, reading id) of one block; keys are sorted and distinct."""
    base = keys[0]
    trie = XFastTrie([k - base for k in keys], bits)
    for aid, t in asked:
        x = t - base
        pair = (None, 0) if x < 0 else (len(keys) - 1, None) if x >> bits else trie.around(x)
        best = min(((abs(keys[p] - t), ids[p]) for p in pair if p is not None), default=None)
        if best and best[0] <= tolerance:
            yield aid, best[0], best[1]


def nearest_in_time(anchors: DataFrame, readings: DataFrame, entity: str, anchor_id: str, anchor_t: str, reading_id: str, reading_t: str, tolerance: int, block_bits: int = 29) -> DataFrame:
    """The nearest reading of the same entity within ``tolerance`` of each anchor.

    Times are integral in one unit; ids are bigint; ``2**block_bits`` must be at
    least the tolerance. Returns (anchor_id, reading_id, distance), one row per
    anchor that has a match. Equal distances give the smallest reading_id, also
    among readings of one instant. Anchors and readings with null entity, time
    or id match nothing; an anchor id given twice at different times keeps its
    nearest match; empty sides give no rows; other columns are ignored.
    """
    if (1 << block_bits) < tolerance:
        raise ValueError("a block must be at least as long as the tolerance")
    shift = lambda c: F.shiftright(c, block_bits)
    a = anchors.select(F.col(entity).alias("e"), F.col(anchor_id).cast("long").alias("aid"), F.col(anchor_t).cast("long").alias("t")).where("e is not null and aid is not null and t is not null")
    blocks = F.array_distinct(F.array(shift(F.col("t") - tolerance), shift(F.col("t")), shift(F.col("t") + tolerance)))
    a = a.withColumn("b", F.explode(blocks)).distinct()
    r = readings.select(F.col(entity).alias("e"), F.col(reading_id).cast("long").alias("rid"), F.col(reading_t).cast("long").alias("t")).where("e is not null and rid is not null and t is not null")
    r = r.withColumn("b", shift(F.col("t"))).join(a.select("e", "b").distinct(), ["e", "b"], "left_semi")
    r = r.groupBy("e", "b", "t").agg(F.min("rid").alias("rid"))
    both = a.select("e", "b", "t", F.lit(True).alias("is_anchor"), F.col("aid").alias("id")).unionAll(r.select("e", "b", "t", F.lit(False).alias("is_anchor"), F.col("rid").alias("id")))
    bits = block_bits

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of a block lie together (hash partition, sorted); a block may straddle two batches.
        def closed(part: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple[int, int, int]] = []
            e, b, t, isa = (part[c].to_numpy() for c in ("e", "b", "t", "is_anchor"))
            ids = part["id"].to_numpy()
            cuts = np.flatnonzero((e[1:] != e[:-1]) | (b[1:] != b[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
                ask = isa[lo:hi]
                if ask.any() and not ask.all():
                    asked = list(zip(ids[lo:hi][ask].tolist(), t[lo:hi][ask].tolist()))
                    found += _match_block(asked, t[lo:hi][~ask].tolist(), ids[lo:hi][~ask].tolist(), bits, tolerance)
            return pd.DataFrame(found, columns=["aid", "distance", "rid"]).astype("int64")

        held: list[pd.DataFrame] = []  # batches of the block that is not complete yet
        for batch in batches:
            if batch.empty:
                continue
            e, b = batch["e"].to_numpy(), batch["b"].to_numpy()
            if held and (e[-1], b[-1]) == (held[-1]["e"].iloc[-1], held[-1]["b"].iloc[-1]) == (e[0], b[0]):
                held.append(batch)
                continue
            tail = (e == e[-1]) & (b == b[-1])
            if held or not tail.all():
                yield closed(pd.concat([*held, batch[~tail]], ignore_index=True))
            held = [batch[tail]]
        if held:
            yield closed(pd.concat(held, ignore_index=True))

    laid = both.repartition(F.col("e"), F.col("b")).sortWithinPartitions("e", "b", "t")
    found = laid.mapInPandas(match, "aid long, distance long, rid long")
    best = found.groupBy("aid").agg(F.min(F.struct("distance", "rid")).alias("m"))
    return best.select(F.col("aid").alias(anchor_id), F.col("m.rid").alias(reading_id), F.col("m.distance").alias("distance"))
