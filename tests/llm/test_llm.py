"""Problems 1, 8, 9 and 10 on small fixtures."""

import base64
import json
from collections import Counter

import pytest
import tiktoken

from tickloom.llm import mixing, sentences, survivors, tokens

FIELDS = [("entry", "string", 1), ("exit", "string", 2), ("dir", "number", 3)]


def trades(*minutes):
    return json.dumps([{"entry": f"2026-03-02T09:{m:02}:00", "exit": f"2026-03-02T09:{m:02}:30", "dir": 1} for m in minutes])


def test_surviving_fields(spark):
    cols = "run_id string, instrument string, trades string, written string, fidelity string, strategy string, entry_signal string, bar_type string, calculate string, params string, perf_cum_profit double, run string"
    rows = [
        ("a", "NVX 03-26", trades(1, 2, 3), "2026-03-05T10:00:00", "unknown", None, "Long1", None, None, "{}", 5.0, "x"),
        ("b", "nvx_03-26 ", trades(1, 2), "20260305T110000", "Fills_Guessed", "unknown", None, None, " ", '{"a": 1}', float("nan"), "x"),
        ("c", "NVX 03-26", trades(3, 1, 2), None, "fills-guessed", "Tide", None, None, None, None, 7.0, "x"),
        ("c", "NVX 03-26", trades(3, 1, 2), None, "fills-guessed", "Tide", None, None, None, None, 7.0, "x"),
        ("d", "NVX 03-26", trades(1, 2, 4), "2026-03-05T10:00:00", "exact", "Other", None, None, None, None, 1.0, "x"),
        ("e", "ERL 03-26", trades(1, 2, 3), "2026-03-05T10:00:00", "exact", "Other", None, None, None, None, 1.0, "x"),
        ("f", None, trades(1, 2, 3), None, None, None, None, None, None, None, None, "x"), ("g", "NVX 03-26", "[]", None, None, None, None, None, None, None, None, "x"), (None, "NVX 03-26", trades(1, 2, 3), None, None, None, None, None, None, None, None, "x"),
    ]
    files = spark.createDataFrame(rows[:4] + rows[5:], cols)
    dim = spark.createDataFrame(FIELDS, "field string, json_type string, field_no int")
    got = {(r["run_id"], r["field"]) for r in survivors.surviving_fields(files, dim).collect()}
    assert got == {("b", "fidelity"), ("c", "strategy"), ("a", "entry_signal"), ("b", "params"), ("c", "perf_cum_profit")}
    assert survivors.surviving_fields(files.limit(0), dim).count() == 0
    every = survivors.run_groups(spark.createDataFrame(rows, cols), dim).distinct().collect()
    assert len({r["run"] for r in every if r["run_id"] in "abcd"}) == 1 and "e" in {r["run_id"] for r in every}


def test_precedence(spark):
    rows = [("g1", "a", "unknown", 1), ("g1", "b", "guessed", 2), ("g1", "c", "exact", 3), ("g2", "d", "unknown", 1), ("g2", "e", "guessed", 5), ("g3", "f", "guessed", 1), ("g3", "g", "unknown", 2), ("g4", "h", None, 1)]
    df = spark.createDataFrame(rows, "g string, id string, v string, s int").selectExpr("g", "id", "v", "timestamp_seconds(s) as at")
    got = {(r["earlier"], r["later"]): (r["n_forward"], r["n_backward"], r["precedes"]) for r in survivors.value_precedence(df, "g", "id", "v", "at").collect()}
    assert got == {("unknown", "guessed"): (2, 1, True), ("guessed", "unknown"): (1, 2, False), ("guessed", "exact"): (1, 0, True)}


@pytest.fixture(scope="module")
def both():
    bpe = tokens.BytePairEncoder(tokens.default_vocabulary(), tokens.default_pattern())
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokens.default_vocabulary(), "rb"))}
    return bpe, tiktoken.Encoding("own", pat_str=tokens.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_library(both):
    bpe, lib = both
    for t in ["", " ", "a" * 40_000, "<|endoftext|>", "Émigré naïve—日本語テキスト、ไทย 🙂\r\n\t x", "".join(chr(i) for i in range(1, 3000) if not 0xD800 <= i < 0xE000), "ab ba " * 500, "0123456789" * 99]:
        ids = bpe.encode(t)
        assert ids == lib.encode_ordinary(t) and bpe.decode(ids) == t


def test_encoded_rows(spark, both):
    df = spark.createDataFrame([(1, "one two", "x"), (2, "", "x"), (3, None, "x"), (1, "one two", "x"), (None, " ", "x")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encoded(df).collect()]
    assert Counter(map(str, got)) == Counter(map(str, [(1, both[1].encode_ordinary("one two"))] * 2 + [(2, []), (3, []), (None, both[1].encode_ordinary(" "))]))
    assert tokens.encoded(df.limit(0)).count() == 0
    assert [r["text"] for r in tokens.decoded(tokens.encoded(df).where("doc_id = 1")).collect()] == ["one two"] * 2


def test_pfair_lag():
    periods, slots = mixing.blocks_of({"a": 500_000, "b": 300_000, "c": 190_000, "d": 10_000}, 1_000)
    place = mixing.pfair_period(slots)
    assert periods == 1 and sorted(x for v in place.values() for x in v) == list(range(1000))
    for s, v in place.items():
        for k, slot in enumerate(v):
            assert abs((k + 1) - (slot + 1) * slots[s] / 1000) < 1 + 1e-9


def test_every_source_has_blocks_of_its_own():
    """A weight of a millionth, over many periods: one block a period, of a small size."""
    want = {"a": 10**12, "b": 10**12, "tiny": 2 * 10**6}
    periods, per = mixing.blocks_of(want, 2_048)
    place = mixing.pfair_period(per)
    assert per["tiny"] == 1 and periods > 90_000 and sum(per.values()) <= mixing.PERIOD + len(want)
    assert sorted(x for v in place.values() for x in v) == list(range(sum(per.values())))
    # At every period's end all sources are on their share, and in it less than a block away from it.
    for s, n in want.items():
        size = n / (periods * per[s])
        assert size <= 2_048
        for k, slot in enumerate(place[s]):
            assert abs((k + 1) - (slot + 1) * per[s] / sum(per.values())) < 1 + 1e-9


def test_too_many_targets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_TARGETS", 20)
    goal = spark.range(21).selectExpr("concat('source', id) as source", "1.0D as weight", "1 as max_repeats")
    with pytest.raises(ValueError):
        mixing.targets_of(goal)
    assert len(mixing.targets_of(goal.limit(20))) == 20


def test_mix_of_the_test_tables(spark):
    """Shares, caps, slots and lag over whole tables, with a target of a millionth beside the others."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    small = spark.createDataFrame([(10**9 + i, f"small text {i} of a small source", "dust") for i in range(4)], "doc_id long, text string, source string")
    goal = spark.read.parquet(f"{d}/mix_targets.parquet").unionByName(spark.createDataFrame([("dust", 1e-6, 1)], "source string, weight double, max_repeats int"))
    docs, block = docs.unionByName(small), 128
    mix = mixing.mixed(docs, goal, block=block).orderBy("slot", "doc_id").collect()
    targets = mixing.targets_of(goal)
    uses, owner = Counter((r["doc_id"]) for r in mix), {}
    assert max(uses[r["doc_id"]] - targets[r["source"]][1] for r in mix) <= 0
    for r in mix:
        assert owner.setdefault(r["slot"], r["source"]) == r["source"]  # a slot is one source's
    longest = max(r["n_tokens"] for r in mix)
    total, whole = Counter(), 0
    for r in mix:
        total[r["source"]] += r["n_tokens"]
    goal_share = {s: targets[s][0] / sum(targets[x][0] for x in total if x != "dust") for s in total if s != "dust"}
    amount, run = sum(total.values()), Counter()
    for s, w in goal_share.items():
        assert abs(total[s] - w * amount) <= 2 * longest
    for i, r in enumerate(mix):
        run[r["source"]] += r["n_tokens"]
        whole += r["n_tokens"]
        if i + 1 == len(mix) or mix[i + 1]["slot"] != r["slot"]:
            for s in total:
                # One block, and one text at each end of what a source has so far and of what the prefix holds.
                assert abs(run[s] - total[s] / amount * whole) <= block + 2 * longest


def test_demands():
    t = {"a": (0.5, 1), "b": (0.25, 4), "c": (0.25, 1)}
    assert mixing.demands(t, {"a": 1000, "b": 100, "x": 9}) == {"a": 800, "b": 400}
    assert mixing.demands(t, {"a": 1000, "b": 10, "c": 1000}, 1000) == {"a": 640, "b": 40, "c": 320}
    assert mixing.demands(t, {}) == {}


def test_mix(spark):
    docs = [(i, f"text number {i} of the journal", "Journal") for i in range(40)] + [(100 + i, f"a forum text {i}", "forum ") for i in range(6)]
    docs += [(200, "text number 3 of the journal", "journal"), (201, None, "forum"), (202, "", "forum"), (203, "no target", "wiki"), (204, "no source", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    goal = spark.createDataFrame([("journal", 0.5, 1), ("forum", 0.5, 3), ("news", 0.2, 2), ("bad", None, 1)], "source string, weight double, max_repeats int")
    mix = mixing.mixed(df, goal, block=16)
    rows = mix.collect()
    used = Counter(r["doc_id"] for r in rows)
    assert 200 not in used and all(n <= (1 if d < 100 else 3) for d, n in used.items())
    share = {r["source"]: r["share"] for r in mixing.reached_shares(mix, goal).collect()}
    assert abs(share["journal"] - 0.5) < 0.05 and abs(share["forum"] - 0.5) < 0.05 and share["news"] == 0.0
    assert mixing.mixed(df.limit(0), goal).count() == 0 and mixing.mixed(df, goal.limit(0)).count() == 0


CASES = [
    ("Mr. Wibra and Ms. Torny share one machine, e.g. for sweeps.|No.|No. 5 beat it.|Out."),
    ("We only trade the U.S.|Prof. Quori calls this noise.|The U.S. session was thin."),
    ("The desk opens at 3 a.m.|It stayed there until 4:10 p.m. Eastern.|The list holds fees, etc.|Hm... the second leg is late."),
    ('"Is it back?" asked Ulhep, and nobody answered.|“Read the log first. Cut it.” wrote Wizan.|Fenma said: "No adds today! Out."|Commission is $2.'),
    ("Am 14. Februar lief es gut.|Laut Abs. 7 gilt das ab dem 2. Handelstag.|Das kostet z. B. 3 $, d. h. wenig.|„Wer war das?“, fragte Nyri."),
    ("Quelle journée !|« On coupe tout. Pas d'ajout. » a écrit Fenel.|M. Ulhep attend 5 min. avant midi."),
    ("В 2019 г. такого не было.|Нужны логи и т. п.|См. табл. 1 и рис. 2.|«Хватит. Завтра», — написал Кави."),
    ("Ποιος έτρεξε το 9b5;|Ο κ. Ulul έφυγε.|Προμήθειες κ.λπ. μειώνουν το κέρδος."),
    ("د. Maulfen يطلب السجلات.|لا.|كتب X: «انتهينا اليوم. نعود غدا.» ثم خرج."),
    ("डॉ. Rika ने रिपोर्ट माँगी है।|Zan ने लिखा, “आज बस। कल।” और चला गया।|क्यों?"),
    ("아니다.|Wide는 \"오늘은 끝. 내일 다시 보자.\"라고 적었다.|손절은 0.2, 목표는 4,152.3에 두었다."),
    ("O Sr. Malun saiu.|“Sem pressa. Basta.” escreveu Ulel.|Veja a pág. 3.|A perda máx. foi de 2 $."),
    ("That is 2 % of the daily cap.|Set it to 31 s.|It took 3 min.|See fig. 3 and sec. 2.1 now."),
    ("after 9:07, it stopped.|the log is lost.|did it? 😅|keep 3 lots."),
    ("EE. UU. abre a las 9.|¿Por qué?|La Sra. Ulel salió, p. ej. el martes."),
]


@pytest.mark.parametrize("case", CASES)
def test_spaced_scripts(case):
    text = case.replace("|", " ")
    assert [text[a:b] for a, b in sentences.sentences(text)] == case.split("|")


def test_scripts_without_spaces():
    for case in ("不对！|手续费、价差、滑点……都要算进去。|“谁动了我的止损？”Torul问道。|Nyzan说：“到此为止。明天再看。”|止损在5。", "「誰が動かした？」とNyが聞いた。|違う！|平均は4,130.70である。", "ผลนี้เชื่อได้ไหมคะ| |ไม่ใช่ครับ| |ราคาของNVX 03-26ขึ้นมา5ติ๊กครับ"):
        parts = [x for x in case.split("|") if x.strip()]
        text = case.replace("|", "")
        assert [text[a:b] for a, b in sentences.sentences(text)] == parts


def test_layout():
    text = "2.1 Setup\nWas it real? 👀 Yes.\n- Choose the account SIM1. Then press start.\nstop = fill - 0.2; target = fill + 0.5\nNet result: 33\nBest, Deul"
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["2.1 Setup", "Was it real? 👀", "Yes.", "- Choose the account SIM1.", "Then press start.", "stop = fill - 0.2; target = fill + 0.5", "Net result: 33", "Best, Deul"]
    wrapped = "Slippage on WHT 03-26 was approx.\n1.75 ticks per side.\nShe closed\nit."
    assert [wrapped[a:b] for a, b in sentences.sentences(wrapped)] == ["Slippage on WHT 03-26 was approx.\n1.75 ticks per side.", "She closed\nit."]


def test_sentence_edges(spark):
    long = "One two three. " * 20_000
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, " \n\t ", 9), (4, "...", 9), (5, "No end", 9), (6, long, 9)], "doc_id long, text string, start_char int")
    got = Counter(r["doc_id"] for r in sentences.sentence_spans(df).collect())
    assert got == {4: 1, 5: 1, 6: 20_000}
    assert sentences.sentence_spans(df.limit(0)).count() == 0
