"""Problem 2: ranks against a plain sweep, and the stated edge cases."""

import random

from tickloom.operators.intervals import continuous_periods, market_periods


def sweep(spans):
    out = []
    for e in sorted({x[0] for x in spans if x[0] is not None}):
        cur = None
        for s, t in sorted((s, t) for x, s, t in spans if x == e and s is not None and t is not None and t >= s):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], t)
            else:
                if cur:
                    out += [(e, "period", *cur), (e, "gap", cur[1], s)]
                cur = [s, t]
        if cur:
            out.append((e, "period", *cur))
    return sorted(out)


def run(spark, spans, bucket):
    df = spark.createDataFrame(spans, "e string, s long, t long")
    return sorted(tuple(r) for r in continuous_periods(df, "e", "s", "t", bucket).collect())


def test_against_sweep(spark):
    rng = random.Random(3)
    spans = []
    for _ in range(300):
        s = rng.randrange(900)
        spans.append((rng.choice("ab"), s, s + rng.choice([0, 1, 3, 9, 200])))
    spans = [x for x in spans if x[2] - x[1] < 200 or x[0] == "b"]
    assert run(spark, spans, 37) == sweep(spans)


def test_edges(spark):
    spans = [("a", 1, 2), ("a", 2, 3), ("a", 5, 5), ("a", 5, 5), (None, 1, 9), ("a", None, 4), ("a", 8, None), ("a", 9, 7)]
    assert run(spark, spans, 10) == [("a", "gap", 3, 5), ("a", "period", 1, 3), ("a", "period", 5, 5)]
    assert run(spark, [], 10) == []


def test_merged_states_and_clashing_columns(spark):
    rows = spark.sql("""SELECT * FROM VALUES
      (1L, 7L, ' a1', timestamp'2026-03-02 09:00:00', cast(null as timestamp), 1), (2L, 7L, 'A1 ', null, timestamp'2026-03-02 09:10:00', 2),
      (3L, 8L, 'A1', timestamp'2026-03-02 09:10:00', timestamp'2026-03-02 09:20:00', 3), (4L, 9L, 'A1', timestamp'2026-03-03 09:10:00', timestamp'2026-03-03 09:20:00', 4),
      (5L, null, 'A1', timestamp'2026-03-05 09:10:00', timestamp'2026-03-05 09:20:00', 5)
      AS t(row_id, trade_id, account, entry_time, exit_time, kind)""").withColumn("instrument", __import__("pyspark").sql.functions.lit("X"))
    got = sorted(tuple(r) for r in market_periods(rows).collect())
    assert got == [("A1", "period", "2026-03-02T09:00:00.000000", "2026-03-02T09:20:00.000000"), ("A1", "period", "2026-03-03T09:10:00.000000", "2026-03-03T09:20:00.000000")]
