"""Problem 4: correspondences, deviations, casts and edge cases."""

import json
import random

import pytest

from tickloom.operators import drift

FIELDS = {"entry": "string", "exit": "string", "dir": "number", "qty": "number", "entry_price": "number", "exit_price": "number", "profit": "number", "commission": "number", "fee": "number", "mae": "number", "mfe": "number", "signal": "string"}
FULL = {"entry": "2026-03-02T09:00:00", "exit": "2026-03-02T09:05:00", "dir": 1, "qty": 2, "entry_price": 100.0, "exit_price": 101.0, "profit": 40.0, "commission": 8.08, "fee": 2.2, "mae": 5.0, "mfe": 44.0, "signal": "Long1"}


def but(**changes):
    """FULL with fields renamed in place ('old': ('new', value))."""
    return {changes.get(k, (k, v))[0]: changes.get(k, (k, v))[1] for k, v in FULL.items()}


def test_changes():
    records = [but(profit=("pnl", "($40.00)"), mae=("MAE", None)), {**but(), "etd": 3.5}, {k: v for k, v in FULL.items() if k != "fee"} | {"slip": 1}]
    match = drift.correspond(records, FIELDS)
    assert match == {"pnl": "profit", "MAE": "mae"}
    assert drift.deviations(drift.typed_shapes(records), FIELDS, match) == {("profit", "renamed"), ("profit", "retyped"), ("mae", "renamed"), ("etd", "added"), ("fee", "removed"), ("slip", "added")}


def test_name_beside_its_field_is_added():
    records = [but() | {"pnl": 3.0}]
    assert drift.deviations(drift.typed_shapes(records), FIELDS, drift.correspond(records, FIELDS)) == {("pnl", "added")}


def sample(rng, n=8):
    """n records whose values stand to each other as the documented fields do."""
    out = []
    for i in range(n):
        p = round(rng.uniform(-400, 400), 2)
        out.append({"entry": f"2026-03-02T09:{i:02}:00", "exit": f"2026-03-02T09:{i:02}:45", "dir": rng.choice([1, -1]), "qty": rng.choice([1, 2, 3]), "entry_price": 100.25 + i, "exit_price": 101.5 + i, "profit": p, "commission": 8.08, "fee": 2.2,
                    "mae": round(max(0, -p) + rng.uniform(0, 50), 2), "mfe": round(max(0, p) + rng.uniform(0, 50), 2), "signal": rng.choice(["Long1", "Echo L"])})
    return out


#: Names that share no word with the hints.
UNSEEN = {"entry": "begin_ts", "exit": "finish_at", "dir": "bs", "qty": "nr", "entry_price": "p_zero", "exit_price": "p_one", "profit": "delta", "commission": "brk", "fee": "costs", "mae": "worst", "mfe": "best", "signal": "reason_code"}


@pytest.mark.parametrize("field", UNSEEN)
def test_unseen_name_is_found_by_place_and_content(field):
    records = [{(UNSEEN[k] if k == field else k): v for k, v in r.items()} for r in sample(random.Random(3))]
    assert drift.correspond(records, FIELDS) == {UNSEEN[field]: field}


def test_all_names_unseen():
    records = [{UNSEEN[k]: v for k, v in r.items()} for r in sample(random.Random(4))]
    assert drift.correspond(records, FIELDS) == {v: k for k, v in UNSEEN.items()}


def test_unseen_names_recall_and_precision():
    """Random renamings, removals and additions without any hinted word."""
    rng, right, found, true = random.Random(7), 0, 0, 0
    extras = {"zeta": lambda: rng.choice([0, 0.5, 1]), "theta": lambda: round(rng.uniform(1, 300), 2), "kappa": lambda: rng.choice(["a", "b"]), "omega": lambda: rng.choice([True, False])}
    for _ in range(300):
        records = sample(rng, rng.randint(3, 12))
        renamed = rng.sample([f for f in FIELDS], rng.randint(0, 3))
        gone = rng.sample([f for f in FIELDS if f not in renamed and f != "signal"], rng.choice([0, 0, 1]))
        added = rng.sample(list(extras), rng.choice([0, 1, 2]))
        records = [{(UNSEEN[k] if k in renamed else k): v for k, v in r.items() if k not in gone} | {a: extras[a]() for a in added} for r in records]
        match = drift.correspond(records, FIELDS)
        right += len(set(match.items()) & {(UNSEEN[f], f) for f in renamed})
        found, true = found + len(match), true + len(renamed)
    assert right / true >= 0.95 and right / found >= 0.95


def test_flooding_decides():
    """Names alone, the scores that flooding starts from, do not give the matches."""
    records = [{(UNSEEN[k] if k in ("mae", "mfe") else k): v for k, v in r.items()} for r in sample(random.Random(3))]
    graph = drift.schema_graph(records, FIELDS)
    assert all(like < 0.2 for _, _, like, *_ in graph["pairs"]) and drift.correspond(records, FIELDS) == {"worst": "mae", "best": "mfe"}


def test_flood_ends_at_the_fixed_point():
    n = 300
    start = {("n", i): (1.0 if i == 0 else 0.0) for i in range(n)}
    edges = {("n", i): [[[(("n", i - 1), 1.0)] if i else [(None, 1.0)], [(("n", i + 1), 1.0)] if i + 1 < n else [(None, 1.0)]]] for i in range(n)}
    fixed, damp = {p: (1.0, None) for p in start}, dict.fromkeys(start, 1.0)
    score = drift.flood(start, edges, fixed, damp)
    again = drift.flood(score | start, edges, fixed, damp)
    assert max(abs(score[p] - again[p]) for p in start) < 1e-5


def test_other_files_have_the_name_beside_the_field(spark):
    """A text behind the last number may be the missing signal, unless it is elsewhere found beside one."""
    rng = random.Random(9)
    dim = spark.createDataFrame([(f, t, i) for i, (f, t) in enumerate(FIELDS.items())], "field string, json_type string, field_no int")
    lone = [{k: v for k, v in r.items() if k != "signal"} | {"kappa": "x"} for r in sample(rng)]
    others = [(f"o{i}", json.dumps([r | {"kappa": "y"} for r in sample(rng)])) for i in range(3)]
    alone = spark.createDataFrame([("a", json.dumps(lone))], "run_id string, trades string")
    got = {(r["field"], r["change"]) for r in drift.schema_changes(alone, dim).collect()}
    assert got == {("signal", "renamed")}
    many = alone.union(spark.createDataFrame(others, "run_id string, trades string"))
    got = {(r["field"], r["change"]) for r in drift.schema_changes(many, dim).where("run_id = 'a'").collect()}
    assert got == {("kappa", "added"), ("signal", "removed")}


def test_many_documented_fields_are_refused(spark):
    dim = spark.range(10_001).selectExpr("concat('f', id) as field", "'number' as json_type", "cast(id as int) as field_no")
    with pytest.raises(ValueError):
        drift.schema_changes(spark.createDataFrame([("a", "[]")], "run_id string, trades string"), dim)


def test_casts():
    assert drift.as_time({"day": "2026-03-02", "time": "09:00:01"}) == "2026-03-02T09:00:01"
    assert drift.as_time(1772442000) == drift.as_time(1772442000000) == "2026-03-02T09:00:00"
    assert drift.as_time("2026-03-02 09:00:01.500") == "2026-03-02T09:00:01.5" and drift.as_time("2026-03-02T09:00") == "2026-03-02T09:00:00"
    assert drift.as_time("soon") is None and drift.as_time(True) is None
    assert drift.as_number("$1,350.00") == 1350.0 and drift.as_number("(2.5)") == -2.5 and drift.as_number({"amount": 3}) == 3.0 and drift.as_number([2]) == 2.0 and drift.as_number("Short") == -1.0 and drift.as_number("x") is None


def test_operator_edges(spark):
    dim = spark.createDataFrame([(f, t, i) for i, (f, t) in enumerate(FIELDS.items())], "field string, json_type string, field_no int")
    rows = [("a", json.dumps([but()])), ("b", json.dumps([but(qty=("Qty", "2"))])), ("b", json.dumps([but(qty=("Qty", "2"))])), ("c", None), ("d", ""), ("e", "no json"), ("f", "[]"), ("g", "[1, null]"), (None, json.dumps([but() | {"note": ""}]))]
    files = spark.createDataFrame([(a, b, "x") for a, b in rows], "run_id string, trades string, change string")
    got = sorted((str(r["run_id"]), r["field"], r["change"]) for r in drift.schema_changes(files, dim).collect())
    assert got == [("None", "note", "added"), ("b", "qty", "renamed"), ("b", "qty", "retyped")]
    table = drift.unified_records(files, dim).where("run_id = 'b'").collect()
    assert len(table) == 2 and table[0]["qty"] == 2.0 and table[0]["entry"] == "2026-03-02T09:00:00" and table[0]["extra"] is None
    assert drift.schema_changes(files.limit(0), dim).count() == 0
