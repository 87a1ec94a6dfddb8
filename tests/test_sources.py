"""File sources on generated files."""

import json
import sqlite3
import struct

from tickloom.sources import files


def tick_file(records, unit=0.25, first=100.0, ts=1000):
    return struct.pack("<Iddq", 1, unit, first, ts) + b"".join(records)


def test_decode():
    data = tick_file([
        bytes([0b01_001_001, 0b001_10010, 5, 3]),          # +5 ticks of time, price +2, bid 1, volume 3
        bytes([0b10_010_010, 0b010_00000, 1, 0, 126, 2]),  # 256 of time, price -2, ask off 2, volume 200
        bytes([0b00_110_101, 0b101_00000, 2, 0x31, 1, 0]),  # 2 s, both offsets, volume 256
        bytes([0b11_111_000, 0b001_00000]) + (2**31 + 4).to_bytes(4, "big") + bytes([7, 9, 1]),
    ])
    assert list(files.decode_ticks(data)) == [(1005, 100.5, 1, 0, 3), (1261, 100.0, 0, 2, 200), (20001261, 100.0, 3, 1, 256), (20001261, 101.0, 7, 9, 1)]
    assert list(files.decode_ticks(b"short")) == []


def test_tape(spark, tmp_path):
    good, bad = tmp_path / "C1" / "202608070000.Last", tmp_path / "C1" / "202608080100.Last"
    good.parent.mkdir()
    record = bytes([0b01_000_001, 0b001_10001, 1, 5])
    good.write_bytes(tick_file([record] * 3, ts=500))
    bad.write_bytes(tick_file([record, bytes([0b00_000_110, 0b001_00000, 1])], ts=100))
    tape, cut = files.build_tape(files.read_tick_files(spark, str(tmp_path)))
    rows = tape.collect()
    assert [r["ts"] for r in rows] == [101, 501, 502, 503] and {r["side"] for r in rows} == {-1} and cut.count() == 1
    inv = files.inventory(spark, str(tmp_path)).collect()[0]
    assert (inv["contract"], inv["files"], inv["days"]) == ("C1", 2, 2)
    days = spark.createDataFrame([("202608070000",), ("202608062300",), ("202608060100",), ("202601010000",), ("x",), (None,)], "n string")
    assert [r[0] for r in days.select(files.file_day("n")).collect()] == ["20260806", "20260806", "20260806", "20251231", None, None]


def test_depth_header(spark, tmp_path):
    slot = struct.Struct("<didddddiqqq")
    buf = bytearray(3520)
    for n, (count, volume) in {10: (4, 10), 11: (6, 20), 2: (9, 77)}.items():
        slot.pack_into(buf, n * 80, 0.0, count, 0.0, 0.0, 0.0, 1.0, 0.25, 0, 0, 0, volume)
    (tmp_path / "a.bin").write_bytes(bytes(buf))
    r = files.depth_headers(spark, str(tmp_path)).collect()[0]
    assert (r["depth_events"], r["tape_volume"], r["mean_depth_size"]) == (10, 77, 3.0)


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('Entry date,Net Profit,MAE\n2026-01-02 09:00,"$1,000.50",20\n2026-01-02 10:00,($5.00),x\n2026-01-03 10:00,oops,1\n2026-01-03 11:00,7,\n2026-01-02 12:00,8,1\n')
    got = [(r["day_no"], r["slot"], r["pnl"], r["mae"], r["mfe"]) for r in files.read_trade_csv(spark, str(p)).orderBy("day_no", "slot").collect()]
    assert got == [(0, 0, 1000.5, -20.0, 1000.5), (0, 1, -5.0, -5.0, 0.0), (1, 0, 7.0, 0.0, 7.0), (2, 0, 8.0, -1.0, 8.0)]


def test_runs_sqlite_ledger(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "trades/1", "trades": []}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"schema": "trades/2"}))
    (tmp_path / "c.json").write_text("broken")
    good, bad = files.read_runs(spark, str(tmp_path) + "/*.json")
    assert good.count() == 1 and bad.count() == 2
    db = tmp_path / "x.db"
    con = sqlite3.connect(db)
    con.execute("create table t (a int, b text)")
    con.execute("insert into t values (1, 'x')")
    con.commit()
    con.close()
    assert [tuple(r) for r in files.read_sqlite(spark, str(db), "select * from t").collect()] == [(1, "x")]
    led = str(tmp_path / "l.jsonl")
    for i in range(3):
        files.append_ledger(led, "score", t=i)
    assert files.verify_ledger(led) is None
    lines = open(led).read().splitlines()
    open(led, "w").write("\n".join([lines[0], lines[1].replace('"t": 1', '"t": 9'), lines[2]]))
    assert files.verify_ledger(led) == (1, "edited")
    open(led, "w").write("\n".join([lines[0], lines[2]]))
    assert files.verify_ledger(led) == (1, "broken link")
