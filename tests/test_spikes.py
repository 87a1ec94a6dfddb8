"""Problem 3 on planted cases, whole and cut into chunks."""

import numpy as np

from tickloom.operators.spikes import implausible_prints, outlier_patches, stuck_limit
from tickloom.sources.tables import NET_EPOCH, NET_SECOND


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    return 4000 + np.cumsum(rng.choice([-2, -1, 0, 0, 1, 2], n))


def test_levels_are_no_spikes():
    x = walk(3000).astype(float)
    x[1000:] += 200  # stays
    x[2000:] += np.r_[np.linspace(150, 0, 60), np.zeros(940)].round()  # fades
    assert not outlier_patches(x, 0.5).any()
    for at, size, n in ((500, 90, 1), (700, -80, 4), (1500, 5000, 2)):
        x[at:at + n] += size
    assert np.flatnonzero(outlier_patches(x, 0.5)).tolist() == [500, 700, 701, 702, 703, 1500, 1501]


def test_operator(spark):
    n = 4000
    k = walk(n, 4).astype(float)
    k[1200:1203] += 300
    k[2500:2580] = k[2500]
    k[2499] = k[2500] + 1
    px = k * 0.25
    px[100], px[200] = 0.0, px[200] + 0.1
    rows = [(i, "NVX_03-26" if i % 7 else "nvx 03-26 ", NET_EPOCH + i * NET_SECOND // 2, float(px[i]), i) for i in range(n)]
    rows += [(n + 1, "NVX 03-26", None, 5.0, 1), (n + 2, "NVX 03-26", NET_EPOCH, None, 1), (n + 3, None, NET_EPOCH, 5.0, 1), (n + 4, "NVX 03-26", NET_EPOCH, float("nan"), 1)]
    tape = spark.createDataFrame(rows, "tick_id long, contract string, ts long, px float, own int")
    dim = spark.createDataFrame([("NVX", 0.25), (None, 1.0)], "root string, tick_size double")
    want = {100: "limit", 200: "limit", **{i: "spike" for i in (1200, 1201, 1202)}, **{i: "stuck" for i in range(2501, 2580)}}
    for chunk in (60_000, 700):
        assert {r["tick_id"]: r["kind"] for r in implausible_prints(tape, dim, chunk).collect()} == want
    assert implausible_prints(tape.limit(0), dim).count() == 0
    assert implausible_prints(tape, dim.limit(0)).where("kind = 'spike'").count() == 3


def test_stuck_limit_follows_the_source():
    rng = np.random.default_rng(2)
    quiet, lively = np.cumsum(rng.random(20_000) < 0.4), np.cumsum(rng.random(20_000) < 0.8)
    assert stuck_limit(lively) < stuck_limit(quiet) < 45
