"""Problem 1: learned precedence, partial orders, cycles, times."""

from pyspark.sql import functions as F

from tickloom.llm import survivors

COLS = "g string, id string, v string, at int, trust int"


def captures(spark, rows):
    return spark.createDataFrame(rows, COLS).withColumn("at", F.timestamp_seconds("at"))


def chosen(df):
    out = survivors.most_current(df, "g", "id", ("v",), F.col("trust"), "at")
    return {r["g"]: (r["id"], r["value"]) for r in out.collect()}


#: Dated captures of other groups, by which alpha comes before Beta twice and after it once.
LEARNED = [("l1", "p", "alpha", 1, 0), ("l1", "q", "Beta", 2, 0), ("l2", "p", "Alpha", 5, 0), ("l2", "q", "beta", 9, 0), ("l3", "p", "beta", 1, 0), ("l3", "q", "alpha", 2, 0)]


def test_learned_edges_decide_without_times(spark):
    rows = LEARNED + [("x", "a", "alpha", None, 1), ("x", "b", "beta", None, 1), ("y", "a", "gamma", None, 1), ("y", "b", "delta", None, 1)]
    got = chosen(captures(spark, rows))
    assert got["x"] == ("b", "beta")  # the later value, though "a" is the smaller id
    assert got["y"] == ("a", "gamma")  # nothing learned: the smaller id


def test_trust_and_time_go_before_learned_edges(spark):
    rows = LEARNED + [("x", "a", "alpha", None, 0), ("x", "b", "beta", None, 1), ("x", "c", "beta", None, 1), ("y", "a", "alpha", 3, 1), ("y", "b", "beta", None, 1), ("z", "a", "beta", 3, 1), ("z", "b", "alpha", 4, 1)]
    got = chosen(captures(spark, rows))
    assert got["x"] == ("a", "alpha") and got["y"] == ("a", "alpha") and got["z"] == ("b", "alpha")


def test_chain_of_edges_and_several_undated_ones(spark):
    rows = [("l1", "p", "one", 1, 0), ("l1", "q", "two", 2, 0), ("l1", "r", "three", 3, 0), ("x", "a", "one", None, 0), ("x", "b", "two", None, 0), ("x", "c", "three", None, 0), ("x", "d", "three", None, 0)]
    assert chosen(captures(spark, rows))["x"] == ("c", "three")


def test_cycle_is_settled_by_votes(spark):
    rows = []
    for a, b, n in (("a", "b", 3), ("b", "c", 2), ("c", "a", 1)):
        for i in range(n):
            rows += [(f"{a}{b}{i}", "p", a, 1, 0), (f"{a}{b}{i}", "q", b, 2, 0)]
    rows += [("x", "1", "a", None, 0), ("x", "2", "b", None, 0), ("x", "3", "c", None, 0)]
    assert chosen(captures(spark, rows))["x"] == ("3", "c")  # c to a has one vote only


def test_edges(spark):
    rows = [("x", "a", None, None, 0), ("x", "b", " ", 1, 0), ("one", "a", "v", 1, 0), (None, "a", "v", 1, 0), ("same", "a", "v", 1, 0), ("same", "a", "v", 1, 0), ("tie", "b", "w", 1, 0), ("tie", "a", "v", 1, 0)]
    df = captures(spark, rows).withColumn("against", F.lit(1))
    assert chosen(df) == {"tie": ("a", "v")}
    assert chosen(df.limit(0)) == {}


def test_times(spark):
    texts = ["2026-03-05T10:00:00", "20260305T100000", "2026-03-05 10:00:00.250", "2026-03-05T10:00:00Z", "2026-03-05T10:00:00.123Z", "2026-03-05T12:00:00+02:00", "2026-03-05T04:30:00.5-0530", "05 Mar 2026 10:00:00", "2026-03-05T10:00"]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts + ["2026-03-05", "soon", "", None]], "w string").select(F.date_format(survivors.written_at("w"), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()]
    assert got == ["2026-03-05 10:00:00"] * len(texts) + ["2026-03-05 00:00:00", None, None, None]
