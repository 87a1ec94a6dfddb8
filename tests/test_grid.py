"""Problem 6: counters with resets, proportional spreading, marked cells."""

from tickloom.operators.grid import counter_grid, counter_increments, tape_grid
from tickloom.sources.tables import NET_EPOCH, NET_SECOND


def test_counter_reset_and_overlap(spark):
    rows = [("a", 5, 10.0), ("a", 25, 30.0), ("a", 45, 6.0), ("a", 47, 8.0), ("a", 47, 8.0), ("a", None, 1.0), ("a", 9, None)]
    df = spark.createDataFrame(rows, "k string, t long, c double")
    inc = sorted(tuple(r) for r in counter_increments(df, ["k"], "t", "c", 20).collect())
    assert inc == [("a", 5, 25, 20.0), ("a", 25, 45, 6.0), ("a", 45, 47, 2.0)]
    got = [(r["slot"], round(r["total"], 6), r["value"], r["covered"]) for r in counter_grid(df, ["k"], "t", "c", "session", 10, 1000).orderBy("slot").collect()]
    assert got == [(0, 5.0, 10.0, True), (1, 10.0, None, False), (2, 5.0 + 1.5, 30.0, True), (3, 3.0, None, False), (4, 1.5 + 2.0, 8.0, True)]
    assert counter_grid(df.limit(0), ["k"], "t", "c", "session", 10, 1000).count() == 0


def test_tape_edges(spark):
    at = lambda s: NET_EPOCH + s * NET_SECOND
    rows = [(1, "nvx_03-26 ", at(10), 5.0, 2, 1), (2, "NVX 03-26", at(10), 6.0, 3, 2), (3, "NVX 03-26", at(1000), 7.0, None, 3), (4, "NVX 03-26", at(400), float("nan"), 9, 4), (5, "NVX 03-26", at(700), None, 1, 5),
            (6, "NVX 03-26", at(2000), -1.0, 4, 6), (7, None, at(10), 5.0, 2, 7), (8, "NVX 03-26", None, 5.0, 2, 8)]
    df = spark.createDataFrame(rows, "tick_id long, contract string, ts long, px float, vol int, slot int")
    got = [(r["slot_start"], r["px"], r["vol"], r["covered"]) for r in tape_grid(df).orderBy("slot_start").collect()]
    assert got == [("1970-01-01T00:00:00", 6.0, 5, True), ("1970-01-01T00:05:00", None, 9, False), ("1970-01-01T00:10:00", None, 1, False), ("1970-01-01T00:15:00", 7.0, 0, True)]
    assert tape_grid(df.limit(0)).count() == 0
