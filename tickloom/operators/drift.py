"""Schemas that drift between files (problem 4).

The records of a file form a schema graph: its names, joined to the kinds and JSON
types of their content (wrapped values are looked through), to the names before and
behind them in the record, and to the names whose values theirs bound. The documented
fields form the same graph by their order, KINDS and BOUNDS. Similarity flooding
(``flood``) starts every pair of a name and a field whose contents agree from the
likeness of the two names, which is a weak hint, and passes scores along equal edges
until no score changes any more; pairs of the documented fields under their own names
are where the scores come from. The best consistent one-to-one pairs above ACCEPT are
taken, and every record is cast to the documented fields.

What one file cannot tell is taken from all of them: a name that stands beside a field
in the records of other files is hardly that field. The files are read once; what is
shuffled is the graphs of the files that have both strange names and missing fields.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words by which trade records often name a documented field. A hint
#: only: a name without any of these words is found by its place and content.
HINTS = {
    "entry": "entry open opened start", "exit": "exit close closed end", "dir": "direction side position", "qty": "quantity contracts size lots",
    "entry_price": "entryprice avgentry pxin", "exit_price": "exitprice avgexit pxout", "profit": "profit pnl gross net result", "commission": "commission comm brokerage",
    "fee": "fee fees exchange charges", "mae": "mae adverse drawdown", "mfe": "mfe favorable runup", "signal": "signal entryname tag label",
}
#: Words that do not tell fields apart.
FILLER = {"currency", "time", "date", "price", "px", "avg", "max", "value"}
#: Share of a score that is passed on by the graph; the rest is the first score.
PASSED = 0.75
#: Weights of the edges to the neighbours, to the content and to the bounded fields.
PLACE, CONTENT, BOUND = 0.45, 0.3, 0.25
#: Power with which the share of files that have a name beside a field speaks against the two.
WITNESS = 4
#: A correspondence needs this score, of 1.
ACCEPT = 0.5

_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_ISO = re.compile(r"\s*(\d{4})-(\d\d)-(\d\d)(?:[T ]+(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?\s*Z?$")
_NUMBER = re.compile(r"\s*[$€£]?\s*([+-]?\(?)\s*[$€£]?\s*(\d[\d,]*\.?\d*|\.\d+)\s*[A-Za-z%]*\)?\s*$")


def json_type(value: object) -> str | None:
    """Type of a JSON value; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def bare(value: object) -> object:
    """The content of a wrapped value: a one-element array, {'amount': ..}, {'name': ..}."""
    while True:
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        elif isinstance(value, dict) and set(value) >= {"day", "time"}:
            return f"{value['day']}T{value['time']}"
        elif isinstance(value, dict) and ({"amount", "value", "name"} & set(value)):
            value = next(value[k] for k in ("amount", "value", "name") if k in value)
        else:
            return value


def as_time(value: object) -> str | None:
    """ISO time to the second (fraction kept only if it is not zero), else None.
    Numbers are seconds or milliseconds since 1970."""
    value = bare(value)
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        seconds = value / 1000 if abs(value) > 1e11 else value
        if not 1e8 < seconds < 1e10:
            return None
        return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)).isoformat(timespec="seconds")
    m = _ISO.match(value) if isinstance(value, str) else None
    if not m or not m[4]:
        return None
    fraction = (m[7] or "").rstrip("0")
    return f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}:{m[6] or '00'}" + (f".{fraction}" if fraction else "")


def as_number(value: object) -> float | None:
    """Number of a JSON number, a formatted string, a direction word or a boolean direction."""
    value = bare(value)
    if isinstance(value, bool):
        return 1.0 if value else -1.0
    if isinstance(value, (int, float)):
        return float(value)
    if not isinstance(value, str):
        return None
    word = value.strip().lower()
    if word in ("long", "buy", "short", "sell"):
        return 1.0 if word in ("long", "buy") else -1.0
    m = _NUMBER.match(value)
    return float(m[2].replace(",", "")) * (-1 if m[1] in ("-", "(") else 1) if m else None


def words(name: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _SPLIT.findall(name))


@lru_cache(maxsize=65_536)
def name_likeness(name: str, field: str) -> float:
    """Likeness of a name to a documented field, 0 to 1: equal letters, else the hinted
    words among its words, else shared groups of three letters."""
    own, other = words(name), words(field)
    a, b = "".join(own), "".join(other)
    hints = HINTS.get(field, "").split()
    if a == b or a in hints:
        return 1.0
    core = [w for w in own if w not in FILLER] or list(own)
    hits = sum(w in hints for w in core) / max(1, len(core))
    grams = lambda s: {s[i:i + 3] for i in range(max(1, len(s) - 2))}
    shared = len(grams(a) & grams(b)) / max(1, len(grams(a) | grams(b)))
    return max(0.8 * hits, shared)


def content_kind(values: list[object]) -> str:
    """Kind of content: time, direction, count, level, money, text, flag, list, none."""
    seen = [v for v in values if v is not None]
    if not seen:
        return "none"
    flat = [bare(v) for v in seen]
    if all(as_time(v) for v in seen):
        return "time"
    if all(isinstance(v, bool) for v in flat):
        return "flag"
    numbers = [as_number(v) for v in flat]
    if all(isinstance(v, str) and v.strip().lower() in ("long", "short", "buy", "sell") for v in flat):
        return "direction"
    if all(n is not None for n in numbers):
        if all(abs(n) == 1 for n in numbers):
            return "direction" if any(n < 0 for n in numbers) else "count"
        if all(n == int(n) and 0 < n < 1000 for n in numbers):
            return "count"
        return "money±" if any(n < 0 for n in numbers) else "money"
    return "text" if all(isinstance(v, str) for v in flat) else "list"


#: Kinds of content that each documented field may hold.
KINDS = {
    "entry": {"time"}, "exit": {"time"}, "dir": {"direction", "flag", "count"}, "qty": {"count"},
    "entry_price": {"money", "count"}, "exit_price": {"money", "count"}, "profit": {"money", "money±", "count", "direction"},
    "commission": {"money", "count"}, "fee": {"money", "count"}, "mae": {"money", "count", "money±"}, "mfe": {"money", "count", "money±"},
    "signal": {"text", "count", "list"},
}


def _number_pairs(mine: list[object], theirs: list[object]) -> list[tuple[float, float]]:
    both = [(as_number(a), as_number(b)) for a, b in zip(mine, theirs)]
    return [(a, b) for a, b in both if a is not None and b is not None]


def _not_below(sign: float) -> Callable[[list, list], float | None]:
    def test(mine: list[object], theirs: list[object]) -> float | None:
        pairs = [(abs(a), sign * b) for a, b in _number_pairs(mine, theirs)]
        return sum(a >= b for a, b in pairs) / len(pairs) if pairs else None
    return test


def _ordered(sign: int) -> Callable[[list, list], float | None]:
    def test(mine: list[object], theirs: list[object]) -> float | None:
        pairs = [(a, b) for a, b in ((as_time(x), as_time(y)) for x, y in zip(mine, theirs)) if a and b]
        return sum(a >= b if sign > 0 else a <= b for a, b in pairs) / len(pairs) if pairs else None
    return test


def _same_level(mine: list[object], theirs: list[object]) -> float | None:
    pairs = [(a, b) for a, b in _number_pairs(mine, theirs) if b]
    return sum(0.3 < a / b < 3 for a, b in pairs) / len(pairs) if pairs else None


#: How a field's values stand to those of another in the same record.
BOUNDS: dict[tuple[str, str], Callable[[list, list], float | None]] = {
    ("exit", "entry"): _ordered(1), ("entry", "exit"): _ordered(-1), ("entry_price", "exit_price"): _same_level, ("exit_price", "entry_price"): _same_level,
    ("mfe", "profit"): _not_below(1.0), ("mae", "profit"): _not_below(-1.0),
}


def schema_graph(records: list[dict], fields: dict[str, str]) -> dict | None:
    """The file's graph beside the documented one: ``shapes``, the different orders of
    names in a record that hold a strange one, and ``pairs``, [name, field, likeness,
    content, bound] of each strange name and missing field that may correspond. None if
    there is no such pair. Two names of one record are two fields."""
    shapes = list(dict.fromkeys(tuple(r) for r in records))
    strange = list(dict.fromkeys(k for s in shapes for k in s if k not in fields))
    lacking = [f for f in fields if any(f not in s for s in shapes)]
    if not strange or not lacking:
        return None
    pairs = []
    for k in strange:
        mine = [s for s in shapes if k in s]
        free = [f for f in lacking if not any(f in s for s in mine)]
        if not free:
            continue
        own = [r for r in records if k in r]
        values = [r[k] for r in own]
        kind = content_kind(values)
        seen = [t for t in map(json_type, values) if t]
        for f in free:
            if kind != "none" and kind not in KINDS.get(f, {kind}):
                continue
            content = 0.6 if kind == "none" else 0.85 + 0.15 * seen.count(fields[f]) / len(seen)
            held = [t for (a, b), test in BOUNDS.items() if a == f and b in fields and (t := test(values, [r.get(b) for r in own])) is not None]
            if held and min(held) == 0.0 and f.endswith("price"):
                continue  # on another level than every other price
            # What holds in a good part of the records by chance says little; what fails in some says much.
            pairs.append([k, f, round(name_likeness(k, f), 4), round(content, 4), round(max(0.0, 2 * min(held) - 1) ** 2, 4) if held else None])
    return {"shapes": [s for s in shapes if any(k not in fields for k in s)], "pairs": pairs} if pairs else None


def _beside(shape: tuple[str, ...], at: int, field: int, side: int, place: dict[str, int], free: dict[str, list[int]]) -> Iterator[tuple[tuple[str, int] | None, float]]:
    """Edges of the pair (shape[at], field) to pairs on one side, with weights.

    A pair on the other end is a strange name with a field, or None for a field under
    its own name or the record's end. Names and fields between the two ends weigh the
    edge down if there are more of them in one graph than in the other. A field of the
    record that lies between, or on the wrong side, breaks the edge.
    """
    present = {place[k] for k in shape if k in place}
    skipped, i = 0, at + side
    bar = min((abs(p - field) for p in present if (p - field) * side > 0), default=None)  # the nearest present field on this side
    while 0 <= i < len(shape):
        k = shape[i]
        if k in place:
            apart = (place[k] - field) * side
            if apart > 0 and apart == bar:
                yield None, 1 / (1 + abs(skipped - (apart - 1)))
            return
        for g in free.get(k, ()):
            apart = (g - field) * side
            if apart > 0 and (bar is None or apart < bar):
                yield (k, g), 1 / (1 + abs(skipped - (apart - 1)))
        skipped, i = skipped + 1, i + side
    if bar is None:
        beyond = len(place) - 1 - field if side > 0 else field
        yield None, 1 / (1 + abs(skipped - beyond))


def flood(start: dict, edges: dict, fixed: dict, damp: dict) -> dict:
    """Scores of all pairs at the fixed point.

    start: first scores; edges: pair -> for each shape the edges to the left and to the
    right, (pair or None, weight); fixed: (content, bound or None). A pair passes its
    score, times the weight, to its neighbours, which keep the best that comes from
    either side; None passes 1. ``damp`` scales what a pair may reach. Every round moves
    no score further than PASSED times the round before did, so the rounds end by
    themselves, when nothing changes by more than 1e-6.
    """
    score = {p: damp[p] * s for p, s in start.items()}
    while True:
        new = {}
        for p, s in start.items():
            best = 0.0
            for sides in edges[p]:
                best = max(best, sum(max((w * (1.0 if q is None else score[q]) for q, w in side), default=0.0) for side in sides) / 2)
            content, bound = fixed[p]
            got = (PLACE * best + CONTENT * content + (BOUND * bound if bound is not None else 0.0)) / (PLACE + CONTENT + (BOUND if bound is not None else 0.0))
            new[p] = damp[p] * ((1 - PASSED) * s + PASSED * got)
        moved = max((abs(new[p] - score[p]) for p in new), default=0.0)
        score = new
        if moved <= 1e-6:
            return score


@lru_cache(maxsize=16_384)
def _selected(graph: str, listed: tuple[str, ...], beside: tuple[tuple[str, tuple[float, ...]], ...]) -> tuple[tuple[str, str], ...]:
    made = json.loads(graph)
    place = {f: i for i, f in enumerate(listed)}
    free: dict[str, list[int]] = {}
    for k, f, *_ in made["pairs"]:
        free.setdefault(k, []).append(place[f])
    known = dict(beside)
    start, fixed, damp, edges = {}, {}, {}, {}
    for k, f, like, content, bound in made["pairs"]:
        p = (k, place[f])
        start[p], fixed[p] = like, (content, bound)
        damp[p] = (1 - known[k][p[1]]) ** WITNESS if k in known else 1.0
        edges[p] = [[list(_beside(s, s.index(k), p[1], side, place, free)) for side in (-1, 1)] for s in map(tuple, made["shapes"]) if k in s]
    score = flood(start, edges, fixed, damp)
    first = {k: i for i, k in enumerate(dict.fromkeys(k for s in made["shapes"] for k in s))}
    taken: dict[str, str] = {}
    for (k, i), s in sorted(score.items(), key=lambda x: (-round(x[1], 6), first[x[0][0]], x[0][1])):
        if s >= ACCEPT and k not in taken and listed[i] not in taken.values():
            taken[k] = listed[i]
    return tuple(taken.items())


def correspond(records: list[dict], fields: dict[str, str], beside: dict[str, list[float]] | None = None) -> dict[str, str]:
    """Name in the records -> documented field, for names other than the field's own.

    ``beside``: for a name the share of all files holding it in which it stands in one
    record with each field, in their order.
    """
    graph = schema_graph(records, fields)
    return dict(_selected(json.dumps(graph), tuple(fields), tuple((k, tuple(v)) for k, v in sorted((beside or {}).items())))) if graph else {}


def parse_records(text: str | None) -> list[dict]:
    """Objects of a JSON array; anything else holds no records."""
    try:
        data = json.loads(text) if text else []
    except (ValueError, TypeError, RecursionError):
        return []
    data = [data] if isinstance(data, dict) else data if isinstance(data, list) else []
    return [r for r in data if isinstance(r, dict)]


def typed_shapes(records: list[dict]) -> list[list[tuple[str, str | None]]]:
    """The different records as lists of (name, JSON type of its value or None)."""
    return [list(s) for s in dict.fromkeys(tuple((k, json_type(v)) for k, v in r.items()) for r in records)]


def deviations(shapes: list[list[tuple[str, str | None]]], fields: dict[str, str], match: dict[str, str]) -> set[tuple[str, str]]:
    """(field, change) shown by at least one of the ``typed_shapes`` of a file."""
    out: set[tuple[str, str]] = set()
    for shape in shapes:
        seen = set()
        for name, kind in shape:
            field = name if name in fields else match.get(name)
            if field is None:
                out.add((name, "added"))
                continue
            seen.add(field)
            if name != field:
                out.add((field, "renamed"))
            if kind is not None and kind != fields[field]:
                out.add((field, "retyped"))
        out |= {(f, "removed") for f in fields if f not in seen}
    return out


def documented(trade_fields: DataFrame) -> dict[str, str]:
    """The documented fields in order, read on the driver: the document of one record.
    More than 10,000 are refused."""
    rows = trade_fields.where("field is not null").select("field", "json_type", "field_no").orderBy("field_no", "field").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 documented fields")
    return {r["field"]: r["json_type"] for r in rows}


_CHANGES = pa.list_(pa.struct([("field", pa.string()), ("change", pa.string())]))
_NAMES = pa.list_(pa.struct([("name", pa.string()), ("beside", pa.list_(pa.bool_()))]))


def described(files: DataFrame, fields: dict[str, str], file_id: str, records: str) -> DataFrame:
    """One row per file: i (its id), k (digest of its records), changes (where the file
    alone decides them), names (each strange name with whether it stands beside each
    field), and graph and shapes (JSON) where correspondences are to be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changes, names, graphs, shapes = [], [], [], []
            for text in batch.column(2).to_pylist():
                held = parse_records(text)
                typed = typed_shapes(held)
                sets = [{k for k, _ in s} for s in typed]
                strange = dict.fromkeys(k for s in typed for k, _ in s if k not in fields)
                names.append([{"name": k, "beside": [any(f in s for s in sets if k in s) for f in fields]} for k in strange])
                graph = schema_graph(held, fields) if strange else None
                graphs.append(json.dumps(graph) if graph else None)
                shapes.append(json.dumps(typed) if graph else None)
                changes.append(None if graph else [{"field": f, "change": c} for f, c in sorted(deviations(typed, fields, {}))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(changes, _CHANGES), pa.array(names, _NAMES), pa.array(graphs, pa.string()), pa.array(shapes, pa.string())], names=["i", "k", "changes", "names", "graph", "shapes"])

    text = F.col(records).cast("string")
    rows = files.select(F.col(file_id).cast("string").alias("i"), F.md5(F.coalesce(text, F.lit(""))).alias("k"), text.alias("t"))
    return rows.mapInArrow(run, "i string, k string, changes array<struct<field: string, change: string>>, names array<struct<name: string, beside: array<boolean>>>, graph string, shapes string")


def read_once(rows: DataFrame, key: str) -> DataFrame:
    """The rows behind one exchange that all their uses share. A condition that always
    holds and looks at every column keeps the uses from pruning columns below it, which
    would make each use an exchange, and a reading of the files, of its own."""
    laid = rows.repartition(key)
    return laid.where(F.rand(0) + F.pmod(F.xxhash64(*laid.columns), F.lit(2)) >= 0)


def correspondences(laid: DataFrame, fields: dict[str, str], by: list[str]) -> DataFrame:
    """(by, shapes, match): for every described file with a graph the names that hold a
    field's content, a JSON object name -> field.

    Counts of all files' names are aggregated on the map side to a row per name and
    joined to the names of the graphs, never collected.
    """
    listed = tuple(fields)
    counts = [F.avg(F.get("x.beside", F.lit(i)).cast("int")).alias(f"b{i}") for i in range(len(listed))]
    evidence = laid.select(F.explode("names").alias("x")).groupBy(F.col("x.name").alias("name")).agg(*counts)
    evidence = evidence.select("name", F.array(*[f"b{i}" for i in range(len(listed))]).alias("share"))
    opened = laid.where("graph is not null").select(*by, "graph", "shapes", F.explode("names.name").alias("name")).join(evidence, "name")
    opened = opened.groupBy(*by).agg(F.first("graph").alias("graph"), F.first("shapes").alias("shapes"), F.sort_array(F.collect_set(F.struct("name", "share"))).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for graph, known in zip(batch.column("graph").to_pylist(), batch.column("known").to_pylist()):
                # Shares to two digits: files whose graphs are alike are solved once.
                out.append(json.dumps(dict(_selected(graph, listed, tuple((x["name"], tuple(round(s, 2) for s in x["share"])) for x in known)))))
            keep = [n for n in batch.schema.names if n not in ("graph", "known")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(out, pa.string())], names=[*keep, "match"])

    return opened.mapInArrow(run, ", ".join(f"{b} string" for b in by) + ", shapes string, match string")


def schema_changes(files: DataFrame, trade_fields: DataFrame, file_id: str = "run_id", records: str = "trades") -> DataFrame:
    """(file_id, field, change): every deviation of every file, one row each.

    change: renamed, removed, retyped (field is the documented name) or added
    (field is the name as written). A null is of every type. A file whose array
    is null, empty or not JSON shows nothing; a file listed twice is reported
    once if both copies show the same. Null file ids and extra columns are
    allowed; the schema label of a file is not looked at. A strange name that
    alone stands in a missing field's place with content like the field's is taken
    for it, whatever it is called, unless other files have it beside the field.
    """
    fields = documented(trade_fields)
    laid = read_once(described(files, fields, file_id, records), "k")
    plain = laid.select("i", F.explode("changes").alias("x")).select("i", "x.field", "x.change")
    found = correspondences(laid.withColumn("i", F.coalesce(F.concat(F.lit("="), "i"), F.lit(""))), fields, ["i", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fid, shapes, match in zip(*[batch.column(n).to_pylist() for n in ("i", "shapes", "match")]):
                rows += [(fid[1:] if fid else None, f, c) for f, c in sorted(deviations(json.loads(shapes), fields, json.loads(match)))]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["i", "field", "change"])

    out = plain.unionByName(found.mapInArrow(run, "i string, field string, change string"))
    return out.select(F.col("i").alias(file_id), "field", "change").distinct()


def matched_files(files: DataFrame, trade_fields: DataFrame, records: str = "trades") -> DataFrame:
    """The files with the column ``match``: a JSON object of the names that hold a
    documented field's content, null where there are none. For ``cast_records``."""
    fields, text = documented(trade_fields), F.col(records).cast("string")
    one = files.where(text.isNotNull()).select(F.lit(None).cast("string").alias("i"), text.alias("t"))
    found = correspondences(read_once(described(one, fields, "i", "t"), "k"), fields, ["k"]).where("match != '{}'").select(F.col("k").alias("_k"), "match")
    # A row per different text with renamed fields: broadcast while that is small, else joined by digest.
    rows = files.withColumn("_d", F.md5(F.coalesce(text, F.lit(""))))
    return rows.join(found, F.col("_d") == F.col("_k"), "left").drop("_d", "_k")


def _caster(fields: dict[str, str]) -> tuple[list[str], Callable[[str, object], object]]:
    """The fields that are kept as text, and the cast of a value to its field. The two
    documented strings that hold times are known by their content, not by their type."""
    times = [f for f in fields if "time" in KINDS.get(f, ())]
    texts = [f for f, t in fields.items() if t == "string" and f not in times]

    def cast(field: str, value: object) -> object:
        if field in times:
            return as_time(value)
        if field in texts:
            flat = bare(value)
            return None if flat is None else flat if isinstance(flat, str) else json.dumps(flat)
        return as_number(value)
    return times + texts, cast


def cast_records(text: str | None, match: str | None, fields: dict[str, str]) -> Iterator[tuple[dict, dict]]:
    """(documented fields, rest) of each record of a file; see ``unified_records``."""
    _, cast = _caster(fields)
    names = json.loads(match) if match else {}
    for record in parse_records(text):
        row, extra = dict.fromkeys(fields), {}
        for name, value in record.items():
            field = name if name in fields else names.get(name)
            done = cast(field, value) if field else None
            if field:
                row[field] = done
            if field is None or done is None and value is not None:
                extra[name] = value
        yield row, extra


def unified_records(files: DataFrame, trade_fields: DataFrame, file_id: str = "run_id", records: str = "trades") -> DataFrame:
    """All records of all files with the documented fields.

    file_id, record_no (1-based in the file), entry and exit (ISO strings to the
    second), dir, qty and the money fields as double, signal as string, extra
    (JSON object of the added names, null if none). A value that cannot be cast
    is null in its column and kept under its name in ``extra``.
    """
    fields = documented(trade_fields)
    strings, _ = _caster(fields)
    schema = "i string, record_no int, " + ", ".join(f"`{f}` {'string' if f in strings else 'double'}" for f in fields) + ", extra string"
    kinds = [pa.string(), pa.int32(), *[pa.string() if f in strings else pa.float64() for f in fields], pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fid, text, match in zip(*[c.to_pylist() for c in batch.columns]):
                rows += [(fid, no, *row.values(), json.dumps(extra) if extra else None) for no, (row, extra) in enumerate(cast_records(text, match, fields), 1)]
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["i", "record_no", *fields, "extra"])

    laid = matched_files(files.select(F.col(file_id).cast("string").alias("i"), F.col(records).cast("string").alias("t")), trade_fields, "t")
    return laid.select("i", "t", "match").mapInArrow(run, schema).withColumnRenamed("i", file_id)
