"""The lookahead probe sees later ticks of the entry's own day, and sides."""

from pyspark.sql import functions as F

from tickloom import api
from tickloom.sources import mappings

SF = "/root/testdata/sf0.001"


def test_probe_sees_the_own_day(spark):
    ticks = mappings.ticks(spark.read.parquet(f"{SF}/events.parquet")).cache()
    sound = lambda t: t.where("seq % 97 = 5 and side != 0").select("contract", "cal_day", F.col("seq").alias("entry_seq"), F.col("side").alias("dir"), F.col("px_ticks").alias("stop"), F.col("px_ticks").alias("target"))

    def peek(what):
        return lambda t: sound(t).join(t.groupBy("contract", "cal_day").agg(what.alias("x")), ["contract", "cal_day"]).withColumn("target", F.col("target") + F.col("x")).drop("x")

    got = api.probe_entries(ticks, sound, cuts=3).orderBy("cut_no").collect()
    assert len(got) == 3 and [r["differing"] for r in got] == [0, 0, 0] and got[-1]["compared"] == sound(ticks).count()
    for what in (F.max_by("px_ticks", "seq"), F.sum("side")):
        assert sum(r["differing"] for r in api.probe_entries(ticks, peek(what), cuts=3).collect()) > 0
    assert api.probe_entries(ticks.limit(0), sound).count() == 0
