"""Bucketed ranks, neighbours and running sums against plain Python."""

import random
from itertools import accumulate

from tickloom.plans.ranking import bucketed_prior, bucketed_rank, running_sum


def rows_of(n, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.randrange(400), i, rng.randrange(-9, 10)) for i in range(n)]


def test_rank_and_prior(spark):
    rows = rows_of(300)
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    rank = {r["i"]: r["n"] for r in bucketed_rank(df, ["k"], "t", 37, "n", ("i",)).collect()}
    prior = {r["i"]: r["p"] for r in bucketed_prior(df, ["k"], "t", 37, {"v": "p"}, ("i",)).collect()}
    for k in ("a", "b", None):
        own = sorted((t, i, v) for x, t, i, v in rows if x == k)
        for n, (t, i, v) in enumerate(own):
            assert rank[i] == n + 1 and prior[i] == (own[n - 1][2] if n else None)
    whole = {r["i"]: r["n"] for r in bucketed_rank(df, [], "t", 37, "n", ("i",)).collect()}
    assert [i for i in sorted(whole, key=whole.get)] == [i for _, i in sorted((t, i) for _, t, i, _ in rows)]
    assert bucketed_rank(df.limit(0), ["k"], "t", 37, "n").count() == 0


def test_running_sum(spark):
    rows = [(k, i // 7, i, v) for k, _, i, v in rows_of(300, 4)]
    df = spark.createDataFrame(rows, "k string, d long, i long, v long")
    got = {(r["i"]): (r["run"], r["peak"]) for r in running_sum(df, ["k"], "d", "i", "v").collect()}
    for k in ("a", "b", None):
        own = sorted((i, v) for x, _, i, v in rows if x == k)
        runs = list(accumulate(v for _, v in own))
        peaks = list(accumulate(runs, max, initial=0))[1:]
        assert [got[i] for i, _ in own] == list(zip(runs, peaks))
