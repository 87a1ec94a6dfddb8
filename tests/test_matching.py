"""Import of runs: what makes two captures one."""

import json

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_runs_with_other_first_entries_are_kept(spark, tmp_path):
    def trades(*days):
        return json.dumps([{"entry": f"2026-02-{d}T10:04:00", "exit": f"2026-02-{d}T10:09:00", "dir": 1, "qty": 1, "entry_price": 1.0, "exit_price": 1.0, "profit": 1.0, "commission": 1.0, "fee": 1.0, "mae": 1.0, "mfe": 1.0, "signal": "L"} for d in days])

    metric, fitness = "nt8-performance-metric", "nt8-optimization-fitness"
    rows = [
        ("a", "X 03-26", 2, 5.0, "S", fitness, "High", trades(11, 12)),
        ("b", "X 03-26", 2, 5.0, "S", fitness, "High", trades(19, 20)),  # another run: it begins later
        ("c", "Y 03-26", 2, 5.0, None, fitness, "High", trades(11, 12)),  # the labelled capture, without a name
        ("d", "y 03-26 ", 2, 5.0, "S", metric, None, trades(12, 11)),
        ("e", "Z 03-26", 0, 5.0, "S", fitness, "High", "[]"),  # no first entry: each passes through
        ("f", "Z 03-26", 0, 5.0, "S", fitness, "High", "[]"),
    ]
    spark.createDataFrame(rows, "run_id string, instrument string, n_trades int, perf_cum_profit double, strategy string, source string, fill_resolution string, trades string").coalesce(1).write.parquet(str(tmp_path / "backtests.parquet"))
    spark.read.parquet(f"{SF}/trade_fields.parquet").write.parquet(str(tmp_path / "trade_fields.parquet"))
    got = sorted(r["run_id"] for r in entry.queries()["o73_import_dedup"](spark, str(tmp_path)).collect())
    assert got == ["a", "b", "c", "e", "f"]
