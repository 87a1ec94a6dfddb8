"""Mixing sources to target weights (problem 9).

Each source's texts, in a hash order, are laid end to end and cut into blocks of
about ``block`` tokens. Block k of a source with weight w is released at slot
floor(k/w) and due at slot ceil((k+1)/w); the earliest deadline first among the
released blocks gives every prefix of the mix its share to within one block (Pfair).

The schedule repeats after a period of at most PERIOD slots and one per source. A
source's blocks are made so much smaller than ``block`` that a whole number of them, at
least one, fills its share of a period: at the end of each period every source is
exactly on its share, however small that is. One period is simulated on the driver and
every block computes its own slot from it. Running token sums use hash buckets, so no
source is ever one task.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .tokens import token_counts

#: Blocks of full size in a period, after which the schedule repeats.
PERIOD = 10_000
#: Target sources that are read on the driver; more are refused.
MOST_TARGETS = 100_000
#: Hash buckets of a source for its running sums.
BUCKETS = 1_024


def blocks_of(want: dict[str, int], block: int, period: int = PERIOD) -> tuple[int, dict[str, int]]:
    """(periods, blocks of each source in a period) for the tokens wanted of each source.

    All sources' blocks of full size would fill ``period`` slots or fewer; a source's
    count is rounded up, so its blocks are of the same size, at most ``block`` tokens.
    """
    periods = max(1, -(-sum(want.values()) // (block * period)))
    return periods, {s: max(1, -(-n // (block * periods))) for s, n in want.items()}


def pfair_period(slots: dict[str, int]) -> dict[str, list[int]]:
    """Slot numbers of each source's blocks within one period, by earliest deadline first."""
    period = sum(slots.values())
    waiting: list[tuple[int, str, int]] = []  # (release, source, block)
    for s, q in slots.items():
        if q:
            heapq.heappush(waiting, (0, s, 0))
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in slots}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            due = -(-(k + 1) * period // slots[s])
            heapq.heappush(ready, (due, s, k))
        if not ready:  # cannot be while demands add up to the period
            continue
        _, s, k = heapq.heappop(ready)
        out[s].append(slot)
        if k + 1 < slots[s]:
            heapq.heappush(waiting, (max(slot + 1, (k + 1) * period // slots[s]), s, k + 1))
    return out


def source_key(name: str = "source") -> Column:
    """Canonical source: lower case, no blanks around, '-', '_' and blanks as one form."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.col(name), r"[\s_-]+", " ")), " ", "_")), F.lit(""))


def sized_texts(documents: DataFrame, doc_id: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, h): one row per different text, that of the
    smallest id among the rows whose source is known; texts without tokens are out."""
    rows = documents.where(F.col(doc_id).isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    rows = rows.select(F.col(doc_id).cast("long").alias("d"), source_key().alias("s"), F.col("text"))
    rows = rows.where("s is not null").withColumn("h", F.xxhash64("text")).withColumn("m", F.md5("text"))
    first = rows.groupBy("m").agg(F.min("d").alias("d"))
    # Tokens are counted before the copies are dropped: the text itself is never shuffled.
    sized = token_counts(rows, "d", "text", vocabulary).where("n_tokens > 0")
    return sized.join(first, ["m", "d"], "left_semi").groupBy("d").agg(F.min("s").alias("s"), F.min("n_tokens").alias("n_tokens"), F.min("h").alias("h"))


def targets_of(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Source -> (weight, max_repeats); a short fixed list read on the driver. Rows
    with null or no positive weight, or no positive repeats, are no targets;
    spellings of one source add up, with the larger cap. More than MOST_TARGETS
    sources are refused."""
    rows = mix_targets.select(source_key().alias("s"), "weight", "max_repeats").where("s is not null and weight > 0 and not isnan(weight) and max_repeats > 0")
    found = rows.groupBy("s").agg(F.sum("weight").alias("w"), F.max("max_repeats").alias("m")).limit(MOST_TARGETS + 1).collect()
    if len(found) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    return {r["s"]: (r["w"], r["m"]) for r in found}


def demands(targets: dict[str, tuple[float, int]], held: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens wanted of each source that has both a target and texts.

    Without ``total``: the largest mix in which every such source has its share
    of the weights and none exceeds its tokens times max_repeats. With ``total``:
    shares of that, capped; what a capped source lacks goes to the others in
    proportion to their weights until all are capped.
    """
    both = {s: targets[s] for s in targets if held.get(s, 0) > 0}
    if not both:
        return {}
    room = {s: held[s] * m for s, (_, m) in both.items()}
    weight = {s: Fraction(w) for s, (w, _) in both.items()}
    if total is None:
        size = min(room[s] / (weight[s] / sum(weight.values())) for s in both)
        return {s: int(weight[s] / sum(weight.values()) * size) for s in both}
    given: dict[str, int] = {}
    open_, left = dict(weight), Fraction(total)
    while open_:
        unit = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * unit >= room[s]]
        if not full:
            return given | {s: int(w * unit) for s, w in open_.items()}
        for s in full:
            given[s] = room[s]
            left -= room[s]
            del open_[s]
    return given


def mixed(documents: DataFrame, mix_targets: DataFrame, doc_id: str = "doc_id", total: int | None = None, block: int = 2_048, vocabulary: str | None = None) -> DataFrame:
    """The selection: (doc_id, source, repeat_no, n_tokens, block_no, slot).

    Ordered by (slot, doc_id) it is the mix; any prefix of whole slots has each
    source's share to within one block and one text. repeat_no counts the uses of a text from
    1 to at most max_repeats. A text belongs to the block in which it begins; the
    last text of a source may end beyond its demand, so a share is met to within
    one text. Equal texts are one text (of the smallest doc_id with a source).
    Sources without target or without texts, null and empty texts contribute
    nothing; empty tables give no rows.

    The token sizes are used twice, so they are kept in the shared checkpoint folder.
    """
    sized = checkpointed(sized_texts(documents, doc_id, vocabulary))
    targets = targets_of(mix_targets)
    held = {r["s"]: r["n"] for r in sized.groupBy("s").agg(F.sum("n_tokens").alias("n")).where(F.col("s").isin(list(targets) or [""])).collect()}
    want = {s: n for s, n in demands(targets, held, total).items() if n > 0}
    spark = documents.sparkSession
    if not want:
        return spark.createDataFrame([], "doc_id long, source string, repeat_no int, n_tokens long, block_no long, slot long")
    periods, per = blocks_of(want, block)
    place = pfair_period(per)
    plan = spark.createDataFrame([(s, held[s], n, n / (periods * per[s]), place[s]) for s, n in sorted(want.items())], "ps string, held long, want long, size double, slots array<int>")
    rows = sized.withColumn("b", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    within = Window.partitionBy("s", "b").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("s", "b").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("s", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = rows.withColumn("run", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(base, ["s", "b"]).withColumn("at", F.col("base") + F.col("run"))
    rows = rows.join(F.broadcast(plan), F.col("s") == F.col("ps"))  # one row per target source, at most PERIOD and MOST_TARGETS slots in all
    # Uses of a text: the epochs in which its place still lies before the demand.
    uses = F.ceil((F.col("want") - F.col("at")) / F.col("held")).cast("int")
    rows = rows.where(F.col("at") < F.col("want")).withColumn("repeat_no", F.explode(F.sequence(F.lit(1), uses)))
    rows = rows.withColumn("block_no", F.floor((F.col("at") + (F.col("repeat_no") - 1) * F.col("held")) / F.col("size")).cast("long"))
    block_no = F.least(F.col("block_no"), F.lit(periods) * F.size("slots") - 1)  # the end of the last block, rounded up
    rows = rows.withColumn("block_no", block_no.cast("long"))
    slot = F.floor(F.col("block_no") / F.size("slots")) * sum(per.values()) + F.get("slots", (F.col("block_no") % F.size("slots")).cast("int"))
    return rows.select(F.col("d").alias("doc_id"), F.col("s").alias("source"), "repeat_no", "n_tokens", "block_no", slot.cast("long").alias("slot"))


def reached_shares(selection: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, weight, n_tokens, n_texts, n_uses, most_uses, share) for every target
    source, also those that contribute nothing, and the share of all chosen tokens."""
    got = selection.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_texts"), F.count(F.lit(1)).alias("n_uses"), F.max("repeat_no").alias("most_uses"))
    goal = mix_targets.select(source_key().alias("source"), "weight").where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"))
    out = goal.join(got, "source", "full_outer").fillna(0, ["n_tokens", "n_texts", "n_uses", "most_uses"])
    whole = Window.partitionBy()
    return out.withColumn("share", F.try_divide(F.col("n_tokens").cast("double"), F.sum("n_tokens").over(whole)))
