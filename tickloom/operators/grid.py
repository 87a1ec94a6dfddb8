"""Irregular readings onto a regular grid (problem 6).

A cumulative counter is differenced between consecutive readings (a fall is a
reset: the new reading counts from zero), each increment is spread over the grid
cells in proportion to the overlap of its interval, and cells that no reading
covers are marked. A gauge (price) takes its last reading in the cell.

Prints report an increment at one instant rather than a counter. Such a print is
two readings of the session's counter at the same instant, before and after it,
so its interval has no length and its increment falls into one cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import running_sum
from ..sources.tables import NET_EPOCH, NET_SECOND, contract_key


def counter_increments(readings: DataFrame, key: list[str], ts: str, counter: str, bucket: int) -> DataFrame:
    """(key, t0, t1, inc) between consecutive readings of a counter.

    Repeats of one instant keep the highest reading. Null key parts group
    together; rows with null ts or counter are left out. The window is
    partitioned by (key, bucket of ts); the reading before a bucket's first is
    taken from the buckets' last readings, one row per bucket.
    """
    rows = readings.where(F.col(ts).isNotNull() & F.col(counter).isNotNull())
    rows = rows.groupBy(*key, F.col(ts).cast("long").alias("t1")).agg(F.max(counter).alias("c"))
    rows = rows.withColumn("_b", F.floor(F.col("t1") / bucket).cast("long"))
    inner = Window.partitionBy(*key, "_b").orderBy("t1")
    rows = rows.withColumn("_p", F.lag(F.struct("t1", "c")).over(inner))
    ends = rows.groupBy(*key, "_b").agg(F.max(F.struct("t1", "c")).alias("_last"))
    across = Window.partitionBy(*key).orderBy("_b")
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_b").alias("_eb"), F.lag("_last").over(across).alias("_q"))
    on = F.col("_b") == F.col("_eb")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(ends, on).withColumn("_p", F.coalesce("_p", "_q")).where("_p is not null")
    inc = F.when(F.col("c") >= F.col("_p.c"), F.col("c") - F.col("_p.c")).otherwise(F.col("c"))
    return rows.select(*key, F.col("_p.t1").alias("t0"), "t1", inc.alias("inc"))


def regular_grid(readings: DataFrame, key: list[str], session: str, cell: int, session_length: int) -> DataFrame:
    """One row per key, session and cell from the first to the last covered cell.

    readings: key, t0 <= t1 and inc (the increment between t0 and t1; all three
    null if there is none), t, value and tie (a gauge reading at t; null value
    if there is none). A session is t div session_length, which is a multiple of
    ``cell``, and is named by the column ``session``.
    Returns key, session, slot (cell number), total (proportional share of the
    increments), value (last reading, ties by the larger ``tie``), readings,
    covered (boolean). A cell is covered if it holds a gauge reading. Sessions
    without any gauge reading have no rows, increments before the first and
    after the last covered cell of a session belong to no cell of its series.
    No readings: no rows. One pass: the shuffle carries one partial row per task
    and cell, and the window one row per cell of a session.
    """
    c = F.lit(cell)
    at = lambda col: F.floor(F.col(col) / c).cast("long")
    cells = F.when(F.col("inc").isNull(), F.array(at("t"))).when(F.col("t").isNull() | (at("t") == at("t1")), F.sequence(at("t0"), at("t1"))).otherwise(
        F.array_distinct(F.concat(F.sequence(at("t0"), at("t1")), F.array(at("t")))))
    rows = readings.withColumn("slot", F.explode(cells))
    overlap = F.least(F.col("t1"), (F.col("slot") + 1) * c) - F.greatest(F.col("t0"), F.col("slot") * c)
    share = F.when(F.col("t1") == F.col("t0"), (F.col("slot") == at("t0")).cast("double")).otherwise(F.greatest(overlap, F.lit(0)) / (F.col("t1") - F.col("t0")))
    mine = F.col("value").isNotNull() & (F.col("slot") == at("t"))
    seen = rows.groupBy(*key, "slot").agg(
        F.sum(F.col("inc") * share).alias("total"),
        F.max(F.when(mine, F.struct("t", "tie", "value")))["value"].alias("value"),
        F.count(F.when(mine, 1)).alias("readings"))
    seen = seen.withColumn(session, F.floor(F.col("slot") / (session_length // cell)).cast("long"))
    per_session = Window.partitionBy(*key, session)
    covered = F.when(F.col("readings") > 0, F.col("slot"))
    seen = seen.withColumn("_a", F.min(covered).over(per_session)).withColumn("_z", F.max(covered).over(per_session))
    seen = seen.where("slot between _a and _z")
    # The cells between a covered cell and the next row of the session are the empty ones.
    seen = seen.withColumn("_next", F.lead("slot").over(per_session.orderBy("slot")))
    seen = seen.withColumn("_run", F.explode(F.sequence(F.col("slot"), F.coalesce(F.col("_next") - 1, F.col("slot")))))
    own = F.col("_run") == F.col("slot")
    return seen.select(*key, session, F.col("_run").alias("slot"), F.when(own, F.coalesce("total", F.lit(0.0))).otherwise(0.0).alias("total"),
                       F.when(own, F.col("value")).alias("value"), F.when(own, F.col("readings")).otherwise(0).alias("readings"),
                       (own & (F.col("readings") > 0)).alias("covered"))


def tape_grid(tape: DataFrame, cell_seconds: int = 300) -> DataFrame:
    """Five-minute px and vol of each contract and date.

    px: last px above zero in the slot; vol: sum of all prints' vol with a ts.
    Prints without contract or ts are left out; a px that is null, NaN or not
    above zero covers nothing; null vol adds nothing. A date without any usable
    px has no slots. Late rows and rows sent twice are readings like any other.
    """
    cell = cell_seconds * NET_SECOND
    usable = (F.col("px") > 0) & ~F.isnan("px")
    rows = tape.where(F.col("ts").isNotNull()).select(
        contract_key("contract").alias("contract"), F.col("ts").alias("t"), F.col("ts").alias("t0"), F.col("ts").alias("t1"),
        F.col("vol").cast("double").alias("inc"), F.when(usable, F.col("px").cast("double")).alias("value"), F.col("tick_id").alias("tie"))
    out = regular_grid(rows.where("contract is not null"), ["contract"], "session", cell, 86_400 * NET_SECOND)
    start = F.timestamp_seconds(F.col("slot") * cell_seconds - F.lit(NET_EPOCH // NET_SECOND))
    return out.select("contract", F.to_date(start).alias("session_day"), (F.col("slot") % (86_400 // cell_seconds)).cast("int").alias("slot_no"),
                      F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss").alias("slot_start"), F.col("value").alias("px"), F.col("total").cast("long").alias("vol"), "readings", "covered")


def counter_grid(readings: DataFrame, key: list[str], ts: str, counter: str, session: str, cell: int, session_length: int, bucket: int | None = None) -> DataFrame:
    """A cumulative counter on the grid: resets detected, increments spread by
    overlap. A cell is covered if a reading lies in it. See the two parts."""
    moves = counter_increments(readings, key, ts, counter, bucket or session_length)
    moves = moves.select(*key, "t0", "t1", F.col("inc").cast("double").alias("inc"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("tie"))
    none = F.lit(None).cast("long")
    marks = readings.where(F.col(ts).isNotNull() & F.col(counter).isNotNull()).select(
        *key, none.alias("t0"), none.alias("t1"), F.lit(None).cast("double").alias("inc"), F.col(ts).cast("long").alias("t"), F.col(counter).cast("double").alias("value"), F.lit(0).cast("long").alias("tie"))
    return regular_grid(moves.unionAll(marks), key, session, cell, session_length)


def volume_counter(tape: DataFrame) -> DataFrame:
    """(contract, t, counter): the volume that each contract had traded in its session (a
    date) at each instant with a print, a counter that begins again every date.

    Prints without contract, ts or vol are no reading. Prints of one instant are one
    reading. Running sums use windows over one hour of a contract, and one row per hour.
    """
    rows = tape.where("ts is not null and vol is not null").select(contract_key("contract").alias("contract"), F.col("ts").alias("t"), F.col("vol").cast("long").alias("vol"))
    rows = rows.where("contract is not null").groupBy("contract", "t").agg(F.sum("vol").alias("vol"))
    rows = rows.withColumn("day", F.floor(F.col("t") / (86_400 * NET_SECOND))).withColumn("hour", F.floor(F.col("t") / (3_600 * NET_SECOND)))
    return running_sum(rows, ["contract", "day"], "hour", "t", "vol").select("contract", "t", F.col("run").alias("counter"))


def counter_tape_grid(tape: DataFrame, cell_seconds: int = 300) -> DataFrame:
    """The session's volume counter on the grid: contract, slot_start, total (increments
    between readings, spread over the slots in proportion to their overlap; what a counter
    shows behind its reset was traded since the last reading), readings and covered.
    Where ``tape_grid`` books a print where it happened, this uses the counter alone."""
    out = counter_grid(volume_counter(tape), ["contract"], "t", "counter", "session", cell_seconds * NET_SECOND, 86_400 * NET_SECOND, 3_600 * NET_SECOND)
    start = F.timestamp_seconds(F.col("slot") * cell_seconds - F.lit(NET_EPOCH // NET_SECOND))
    return out.select("contract", F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss").alias("slot_start"), "total", "readings", "covered")
