"""All four checks of a stitched series."""

import datetime as dt

from tickloom.operators import continuous as C


def test_violations(spark):
    mon = dt.date(2026, 1, 5)
    day = lambda i: mon + dt.timedelta(i)
    # (day, time, price): Wednesday lies a roll out of line, Monday after the weekend may.
    path = [(0, 1, 100), (0, 2, 110), (1, 1, 111), (1, 0, 112), (2, 1, 900), (2, 2, 901), (3, 1, 115), (3, 2, 800), (4, 1, 801), (7, 1, 2000)]
    series = spark.createDataFrame([(day(d), s, d * 1000 + t, float(p)) for s, (d, t, p) in enumerate(path)], "cal_day date, seq long, us long, px_adj double")
    spreads = spark.createDataFrame([(day(2), "A", "B", 9, 900.0), (day(4), "B", "C", 9, 50.0), (day(6), "C", "D", 1, None), (day(8), "D", "E", 0, None)], "cal_day date, from_contract string, to_contract string, n long, spread double")
    got = sorted(((r["cal_day"] - mon).days, r["problem"], r["n"], r["size"]) for r in C.violations(series, spreads, 600, 700, (600, 1400)).collect())
    assert got == [(1, "unsorted", 1, None), (2, "session gap", 1, 788.0), (3, "session gap", 1, 786.0), (3, "wide step", 1, None), (4, "spread", 1, 50.0), (6, "no spread", 1, None), (8, "no spread", 1, None)]
