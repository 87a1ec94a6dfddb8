"""File sources: binary tick files, depth headers, run documents, CSV trade lists,
SQLite exports and the evidence ledger."""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TICK_SCHEMA = "path string, seq long, ts long, px double, bid_off int, ask_off int, vol long, error string"

# Fixed values of the tick format: bytes behind each flag, and the unit of what they hold.
TIME_BYTES = {0: (0, 0), 1: (1, 1), 2: (2, 1), 3: (4, 1), 4: (8, 1), 5: (1, 10_000_000)}
VOLUME_BYTES = {1: (1, 1), 2: (1, 100), 3: (1, 500), 4: (1, 1000), 5: (2, 1), 6: (4, 1), 7: (8, 1)}
QUOTE_SCALE = {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}
HEADER = struct.Struct("<4xddq")
DEPTH_SLOT = "<didddddiqqq"


class _Bytes:
    """A cursor over a buffer; reading past its end raises."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def number(self, width: int) -> int:
        end = self.at + width
        if end > len(self.data):
            raise ValueError(f"cut off at {self.at}")
        value = int.from_bytes(self.data[self.at:end], "big")
        self.at = end
        return value


def decode_ticks(data: bytes) -> Iterator[tuple[int, float, int, int, int]]:
    """(ts, px, bid_off, ask_off, vol) of a tick file; ValueError at a record that cannot be read."""
    if len(data) < HEADER.size:
        return
    unit, first, ts = HEADER.unpack_from(data)
    level = round(first / unit) if unit else 0
    exact = first  # the opening price stands until the first change
    cur = _Bytes(data, HEADER.size)
    while len(data) - cur.at >= 2:
        head, tail = cur.number(1), cur.number(1)
        when, price, quote, size = head & 7, head >> 6, head >> 3 & 7, tail >> 5
        if when not in TIME_BYTES:
            raise ValueError(f"time flag {when} at {cur.at}")
        width, scale = TIME_BYTES[when]
        ts += cur.number(width) * scale if width else 0
        move = (0, (tail & 31) - 16)[price] if price < 2 else cur.number(1) - 128 if price == 2 else cur.number(4) - (1 << 31)
        if move:
            level += move
            exact = unit * level
        if quote == 6:
            bid, ask = divmod(cur.number(1), 16)
        elif quote == 7:
            bid, ask = cur.number(1), cur.number(1)
        else:
            bid, ask = (QUOTE_SCALE[quote], 0) if quote & 1 else (0, QUOTE_SCALE[quote])
        if size not in VOLUME_BYTES:
            raise ValueError(f"volume flag {size} at {cur.at}")
        width, scale = VOLUME_BYTES[size]
        yield ts, exact, bid, ask, cur.number(width) * scale


def read_tick_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Ticks of all files below ``path``; a file is one row of the scan and one unit of
    work. A record that cannot be read ends its file: the ticks before it stay, and
    one row with null seq carries the error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                try:
                    for i, t in enumerate(decode_ticks(content)):
                        rows.append((name, i, *t, None))
                except ValueError as e:
                    rows.append((name, None, None, None, None, None, None, str(e)))
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in TICK_SCHEMA.split(", ")])
                yield frame.astype({"seq": "Int64", "ts": "Int64", "bid_off": "Int32", "ask_off": "Int32", "vol": "Int64"})

    return files.mapInPandas(run, TICK_SCHEMA)


def build_tape(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tape with aggressor side in order of ts, path, seq; one row per truncated file)."""
    side = F.when(F.col("ask_off") == 0, 1).when(F.col("bid_off") == 0, -1).otherwise(0)
    tape = decoded.where("error is null").withColumn("side", side).orderBy("ts", "path", "seq")
    return tape, decoded.where("error is not null").select("path", "error")


def file_day(name: str) -> Column:
    """Calendar day of an hourly file named after the end of its hour; null if malformed."""
    hour = F.try_to_timestamp(F.substring(F.col(name), 1, 10), F.lit("yyyyMMddHH"))
    ok = F.col(name).rlike(r"^\d{10}")
    return F.when(ok, F.date_format(hour - F.expr("INTERVAL 1 HOUR"), "yyyyMMdd"))


def depth_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, depth_events, tape_volume, mean_depth_size) of replay files' headers: 44
    slots of 80 bytes; slots 10 and 11 hold depth, slot 2 the tape."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.substring(F.col("content"), 1, 3520).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, c in zip(batch["path"], batch["content"]):
                if len(c) < 3520:
                    continue
                held = [struct.unpack_from(DEPTH_SLOT, c, n * 80) for n in (10, 11, 2)]
                n, v = held[0][1] + held[1][1], held[0][10] + held[1][10]
                rows.append((name, n, held[2][10], round(v / n, 2) if n else 0.0))
            yield pd.DataFrame(rows, columns=["path", "depth_events", "tape_volume", "mean_depth_size"])

    return files.mapInPandas(run, "path string, depth_events long, tape_volume long, mean_depth_size double")


def inventory(spark: SparkSession, path: str, bytes_per_tick: float = 5.6) -> DataFrame:
    """Files, days, bytes and estimated ticks of each contract folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = F.split("path", "/")
    rows = files.withColumn("contract", F.element_at(parts, -2)).withColumn("name", F.element_at(parts, -1)).withColumn("day", file_day("name"))
    return rows.groupBy("contract").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("day").alias("days"), F.sum("length").alias("bytes"), F.floor(F.sum("length") / bytes_per_tick).alias("est_ticks"))


def read_runs(spark: SparkSession, path: str, version: str = "/1") -> tuple[DataFrame, DataFrame]:
    """(runs whose schema label ends with ``version``, rejected documents) of multi-line JSON."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    keyed = docs.withColumn("schema", F.get_json_object("value", "$.schema"))
    good = F.col("schema").isNotNull() & F.col("schema").endswith(version)
    return keyed.where(good), keyed.where(~good | F.col("schema").isNull())


def read_trade_csv(spark: SparkSession, path: str, friction: float = 0.0) -> DataFrame:
    """day_no, slot, pnl, mae, mfe of a CSV trade list.

    Columns are found by parts of their names; money may carry $, thousands commas
    and parentheses. A day block is a run of rows of one date in file order, so a
    date that comes back later starts a new block; without a date column every
    trade is a block. Rows without a number are left out.
    """
    raw = spark.read.option("header", True).csv(path)

    def pick(*parts: str) -> str | None:
        return next((c for p in parts for c in raw.columns if p in c.lower().strip()), None)

    pnl, date = pick("profit", "pnl", "p&l", "net"), pick("date", "time", "entry")
    if pnl is None:
        raise ValueError("no profit column")
    mae, mfe = pick("mae", "adverse", "drawdown"), pick("mfe", "favorable", "favourable", "runup", "run-up")
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.col(f"`{c}`"), r"[$,)]", ""), r"\(", "-").try_cast("double")
    rows = raw.select(clean(pnl).alias("v"), (F.substring(F.col(f"`{date}`"), 1, 10) if date else F.lit(None).cast("string")).alias("day"), (clean(mae) if mae else F.lit(None).cast("double")).alias("m"), (clean(mfe) if mfe else F.lit(None).cast("double")).alias("f"))
    rows = rows.withColumn("line", F.monotonically_increasing_id()).where("v is not null")
    w = Window.orderBy("line")  # one file's trade list in its own order
    new = F.lit(1) if not date else (~F.lag("day").over(w).eqNullSafe(F.col("day")) | F.lag("line").over(w).isNull()).cast("int")
    rows = rows.withColumn("new", new).withColumn("day_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    slot = F.row_number().over(Window.partitionBy("day_no").orderBy("line")) - 1
    return rows.select("day_no", slot.alias("slot"), (F.col("v") - friction).alias("pnl"), F.coalesce(-F.abs("m"), F.least(F.col("v"), F.lit(0.0))).alias("mae"), F.coalesce(F.abs("f"), F.greatest(F.col("v"), F.lit(0.0))).alias("mfe"))


def read_sqlite(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Rows of a query on a consistent copy of a local SQLite file (driver side: such
    exports are small and live on one machine)."""
    with tempfile.TemporaryDirectory() as folder:
        copy = os.path.join(folder, "copy.db")
        source, target = sqlite3.connect(f"file:{path}?mode=ro", uri=True), sqlite3.connect(copy)
        with source, target:
            source.backup(target)
        if target.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
            raise ValueError("the database is torn")
        frame = pd.read_sql_query(query, target)
        source.close()
        target.close()
    return spark.createDataFrame(frame)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that cannot be read is kept in ``corrupt``."""
    return spark.read.schema("seq long, ts string, kind string, prev string, hash string, fields map<string,string>, corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)


def append_ledger(path: str, kind: str, **fields: object) -> dict:
    """Appends one record chained to the last one's hash (serial by nature, on the driver)."""
    from ..functions.stats import canonical
    import hashlib

    last = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    last = json.loads(line)
    body = {"seq": (last["seq"] + 1) if last else 0, "kind": kind, "prev": last["hash"] if last else "", **fields}
    body["hash"] = hashlib.sha256(canonical(body).encode()).hexdigest()[:16]
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps(body) + "\n")
    return body


def ledger_trials(path: str) -> int:
    """Trials charged so far by backtests, imports and sweeps; a repeated fingerprint counts once."""
    seen, total = set(), 0
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for record in (json.loads(x) for x in lines if x.strip()):
                fp = record.get("fp")
                if record.get("kind") in ("backtest", "import", "sweep") and (fp is None or fp not in seen):
                    seen.add(fp)
                    total += record.get("n_trials") or 1
    return total


def verify_ledger(path: str) -> tuple[int, str] | None:
    """Position and reason of the first break of the chain, or None."""
    from ..functions.stats import canonical
    import hashlib

    prior = ""
    with open(path, encoding="utf-8") as lines:
        for i, line in enumerate(x for x in lines if x.strip()):
            record = json.loads(line)
            own = record.pop("hash", None)
            if record.get("prev") != prior:
                return i, "broken link"
            if hashlib.sha256(canonical(record).encode()).hexdigest()[:16] != own:
                return i, "edited"
            prior = own
    return None


def write_tape(tape: DataFrame, path: str) -> None:
    """Tape as Parquet by contract and day, so that date ranges prune to their folders."""
    tape.write.mode("overwrite").partitionBy("contract", "cal_day").parquet(path)


def finite(c: str) -> Column:
    """Null for NaN and infinities, as JSON has neither."""
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))), F.col(c))
