"""Even chunks with a halo, also where one bin holds most of a key."""

import pandas as pd
from pyspark.sql import functions as F

from tickloom.plans import ordered


def test_large_bin_is_cut(spark):
    # 3,000 rows within one bin of 1,000,000 units, a few around it.
    df = spark.range(3_000).selectExpr("'a' as k", "id * 300 as t", "id").unionByName(spark.range(50).selectExpr("'a' as k", "2000000 + id * 1000000 as t", "5000 + id as id")).unionByName(spark.range(3).selectExpr("'b' as k", "id as t", "id"))
    cut = ordered.chunked(df, "k", "t", 1_000_000, 200, 20)
    sizes = cut.groupBy("k", "_chunk").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 400

    def places(part: pd.DataFrame) -> pd.DataFrame:
        return part[part["own"]][["k", "id"]]

    got = ordered.over_sequence(df, "k", ["t", "id"], places, "k string, id long", bin_width=1_000_000, target=200, halo=20)
    assert got.count() == df.count() and got.exceptAll(df.select("k", "id")).count() == 0


def test_halo_is_whole(spark):
    df = spark.range(2_000).selectExpr("'a' as k", "id * 300 as t", "id")

    def seen(part: pd.DataFrame) -> pd.DataFrame:
        own = part.index[part["own"]]
        rest = lambda side: (own.min() if side < 0 else len(part) - 1 - own.max())
        first, last = part["id"].iloc[own.min()], part["id"].iloc[own.max()]
        return pd.DataFrame({"first": [first], "last": [last], "before": [rest(-1)], "behind": [rest(1)], "gapless": [(part["id"].diff().dropna() == 1).all()]})

    rows = ordered.over_sequence(df, "k", ["t", "id"], seen, "first long, last long, before long, behind long, gapless boolean", bin_width=1_000_000, target=200, halo=20).orderBy("first").collect()
    assert rows[0]["first"] == 0 and rows[-1]["last"] == 1_999 and all(r["gapless"] for r in rows)
    assert all(r["before"] >= 20 for r in rows[1:]) and all(r["behind"] >= 20 for r in rows[:-1])
    assert all(b["first"] == a["last"] + 1 for a, b in zip(rows, rows[1:]))


def test_empty(spark):
    df = spark.range(0).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    assert ordered.chunked(df, "k", "t", 10, 5, 1).count() == 0
