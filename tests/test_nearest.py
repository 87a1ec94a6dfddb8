"""Problem 7: the trie against sorted search, the operator against brute force."""

import random
from bisect import bisect_left, bisect_right

from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.operators.nearest import XFastTrie, nearest_in_time


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 1023), min_size=1, max_size=60), st.integers(0, 1023))
def test_trie(keys, x):
    ks = sorted(keys)
    a, b = XFastTrie(ks, 10).around(x)
    i, j = bisect_right(ks, x) - 1, bisect_left(ks, x)
    assert (a, b) == (i if i >= 0 else None, j if j < len(ks) else None)


def test_against_brute_force(spark):
    rng = random.Random(9)
    anchors = [(i, rng.choice("xyz"), rng.randrange(5000)) for i in range(120)] + [(500, None, 3), (501, "x", None)]
    prints = [(i, rng.choice("xy"), rng.randrange(5000)) for i in range(300)] + [(900, "x", None), (901, None, 5)]
    prints += [(1000 + i, c, t) for i, c, t in prints[:40]]
    a = spark.createDataFrame(anchors, "aid long, c string, t long")
    p = spark.createDataFrame(prints, "rid long, c string, t long").withColumnRenamed("t", "ts")
    got = {r["aid"]: (r["distance"], r["rid"]) for r in nearest_in_time(a, p, "c", "aid", "t", "rid", "ts", 12, block_bits=5).collect()}
    want = {}
    for i, c, t in anchors:
        near = [(abs(u - t), r) for r, k, u in prints if None not in (c, t, u) and k == c and abs(u - t) <= 12]
        if near:
            want[i] = min(near)
    assert got == want
    assert nearest_in_time(a.limit(0), p, "c", "aid", "t", "rid", "ts", 12).count() == 0
    assert nearest_in_time(a, p.limit(0), "c", "aid", "t", "rid", "ts", 12).count() == 0
