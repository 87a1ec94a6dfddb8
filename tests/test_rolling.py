"""Problem 5 against brute force."""

import datetime as dt
import random

from tickloom.operators.rolling import trailing_totals


def test_against_brute_force(spark):
    rng = random.Random(5)
    day0 = dt.date(2026, 1, 1)
    rows = [(rng.choice("ab"), day0 + dt.timedelta(rng.randrange(90)), rng.randrange(-50, 50)) for _ in range(60)]
    df = spark.createDataFrame(rows + [(None, day0, 1), ("a", None, 1), ("a", day0, None)], "e string, d date, v long")
    got = {(r["e"], r["d"]): (r["total_7"], r["total_30"]) for r in trailing_totals(df, "e", "d", "v").collect()}
    for e in "ab":
        own = [(d, v) for x, d, v in rows if x == e]
        lo, hi = min(d for d, _ in own), max(d for d, _ in own) + dt.timedelta(29)
        assert sum(k[0] == e for k in got) == (hi - lo).days + 1
        for i in range((hi - lo).days + 1):
            at = lo + dt.timedelta(i)
            want = tuple(sum(v for d, v in own if 0 <= (at - d).days < n) for n in (7, 30))
            assert got[e, at] == want
    assert trailing_totals(df.limit(0), "e", "d", "v").count() == 0
