"""The spoken cascade on sentences of our own: each step, state between rows, windows, streams and timers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from livetext.functions import text as tx
from livetext.operators import flow as fl
from livetext.streaming import flow as sf
from livetext.streaming import sessions as st

LEX = fl.lexicon(
    own=[r"\bmnq\b"],
    foreign=[r"\bgold\b"],
    commentary=[r"\bi was like\b"],
    automatic_commentary=[r"\byou can (?:go|get|be) (?:long|short)\b", r"\byou can pay yourself\b"],
    entry_commentary=[r"\bwas it this (?:long|short) here\b"],
    exit_commentary=[r"\balmost stopped out\b"],
    retrospective=[r"\btook a loss\b"],
)
MARKET = 21243.75


def table(spark, sessions):
    """sessions: {name: [(second, sentence)]}."""
    rows = [(s, f"{k:04d}", float(t), x, MARKET) for s, spoken in sessions.items() for k, (t, x) in enumerate(spoken)]
    made = spark.createDataFrame(rows, "session_id string, segment_id string, at double, text string, market double")
    return made.withColumn("text", tx.normalize_text(F.col("text")))


def said(spark, *sentences, gap=10.0, **options):
    """(tag, side, entry, stop, target) of each sentence, ``gap`` seconds apart; None for nothing."""
    rows = table(spark, {"s": [(k * gap, x) for k, x in enumerate(sentences)]})
    found = {r.segment_id: r for r in fl.interpret(rows, LEX, "session_id", "at", "segment_id", "text", **options).collect()}
    return [found[f"{k:04d}"] if f"{k:04d}" in found else None for k in range(len(sentences))]


def tags(spark, *sentences, **options):
    return [r and r.tag for r in said(spark, *sentences, **options)]


def test_order_of_the_cascade():
    assert [s.name for s in fl.STEPS][:6] == ["other instrument", "commentary", "cancel", "exit commentary", "conditional exit with a price", "conditional exit"]
    assert len({s.name for s in fl.STEPS}) == len(fl.STEPS) and all(s.mask & s.value == s.value for s in fl.STEPS)


def test_entries_and_prices(spark):
    long, short, again, add = said(spark, "I'm long at 52, stop under 41, up to 75", "getting short from forty four", "I am short now", "We're flat, scratch that", gap=60)
    assert (long.tag, long.entry, long.stop, long.target, long.after) == ("ENTER_LONG", 21252.0, 21241.0, 21275.0, "LONG")
    assert (short.tag, short.entry, short.before, short.after) == ("ENTER_SHORT", 21244.0, "LONG", "SHORT")
    assert (again.tag, again.side, add.tag, add.after) == ("ADD", "SHORT", "CANCEL_SETUP", "SHORT")


#: (sentence, its tag without a position, its tag in a long position)
CASES = [
    ("taking some off", "TRIM", "TRIM"),
    ("take profit folks", None, "TRIM"),
    ("you can pay yourself", None, None),
    ("I'm flat", "EXIT_ALL", "EXIT_ALL"),
    ("almost stopped out there", None, None),
    ("if it loses the level then I'm out", None, None),
    ("no reclaim of 40 or I'm out", None, "MOVE_STOP"),
    ("I'll cut the whole position below 30", "MOVE_STOP", "MOVE_STOP"),
    ("break even now", "MOVE_TO_BREAKEVEN", "MOVE_TO_BREAKEVEN"),
    ("leave a runner", "TRIM", "TRIM"),
    ("adding here", None, "ADD"),
    ("my stop is 35", None, "MOVE_STOP"),
    ("looking for a short", "SETUP_SHORT", "SETUP_SHORT"),
    ("I was like I'm long now", None, None),
    ("was it this long here", None, None),
    ("the candle is green", None, None),
    ("got a small piece on", None, "ADD"),
    ("well then folks in this long.", "ENTER_LONG", "ADD"),
    ("still in this long now", None, None),
    ("okay long here", "ENTER_LONG", "ADD"),
    ("it went long here", None, None),
    ("scratch that", "CANCEL_SETUP", "CANCEL_SETUP"),
]


def test_steps_with_and_without_a_position(spark):
    flat = {f"f{k:02d}": [(0, x)] for k, (x, _, _) in enumerate(CASES)}
    held = {f"h{k:02d}": [(0, "I'm long now"), (60, x)] for k, (x, _, _) in enumerate(CASES)}
    rows = fl.interpret(table(spark, flat | held), LEX, "session_id", "at", "segment_id", "text", windows=False).collect()
    got = {(r.session_id, r.segment_id): r.tag for r in rows}
    assert [(x, got[f"f{k:02d}", "0000"], got[f"h{k:02d}", "0001"]) for k, (x, _, _) in enumerate(CASES)] == CASES


def test_a_side_is_remembered(spark):
    assert tags(spark, "I'm short now", "I'm out now", "got a small piece on", gap=60) == ["ENTER_SHORT", "EXIT_ALL", "ENTER_SHORT"]
    assert tags(spark, "looking for a short", "got something on here", gap=5)[1] == "ENTER_SHORT"
    assert tags(spark, "looking for a short", "got something on here", gap=7)[1] is None


def test_seeds_take_the_side_of_a_target(spark):
    up, down = said(spark, "got a little piece on up to 70", "got a small piece on down to 20", gap=3000)
    assert (up.tag, up.target, down.tag, down.target) == ("ENTER_LONG", 21270.0, "ENTER_SHORT", 21220.0)


def test_guards_and_repeats(spark):
    rows = said(spark, "I'm long now", "I'm long now", "I'm flat", "I'm short now", "I'm flat", "I'm short now", gap=2)
    assert [r and r.tag for r in rows] == ["ENTER_LONG", "ADD", "EXIT_ALL", "ENTER_SHORT", "EXIT_ALL", "ENTER_SHORT"]
    assert [r.guard for r in rows if r.tag and r.tag.startswith("ENTER")] == [None, "recent exit cue detected", "recent exit cue detected"]
    assert tags(spark, "break even", "break even", "break even", gap=2) == ["MOVE_TO_BREAKEVEN", None, "MOVE_TO_BREAKEVEN"]
    scores = [r.score for r in said(spark, "I'm long now", "I'm flat", "I'm short, maybe", gap=15)]
    assert scores == [0.91, 0.93, 0.68]


def test_other_instruments(spark):
    assert tags(spark, "gold is long here", "I'm long now", "on the mnq I'm long now", gap=20) == [None, None, "ENTER_LONG"]
    assert tags(spark, "gold is rising", "I'm long now", gap=31) == [None, "ENTER_LONG"]


def test_review_shows_advice(spark):
    assert tags(spark, "you can get long") == [None] and tags(spark, "you can get long", review=True) == ["ENTER_LONG"]


def test_stitched_rows(spark):
    assert tags(spark, "and now I'm", "long versus 30", gap=3) == [None, "ENTER_LONG"]
    assert tags(spark, "and now I'm", "long versus 30", gap=5, windows=False) == [None, None]


def test_windows_recover_what_is_said_in_pieces(spark):
    one, two = said(spark, "putting a little piece on", "short versus 44", gap=5)
    assert (one.tag, two.tag, two.stop, two.recovered) == (None, "ENTER_SHORT", 21244.0, True)
    assert tags(spark, "putting a little piece on", "short versus 44", gap=5, windows=False) == [None, None]
    assert tags(spark, "putting a little piece on", "short versus 44", gap=7) == [None, None]
    assert tags(spark, "putting a little piece on", "short versus 44 and took a loss", gap=5) == [None, None]


def test_positions_of_their_own_time(spark):
    rows = table(spark, {"s": [(0, "adding here"), (60, "adding here"), (120, "my stop is 35")]})
    rows = rows.withColumn("pos", F.when(F.col("at") == 60, "LONG")).withColumn("pos_stop", F.when(F.col("at") == 60, 21200.0))
    got = fl.interpret(rows, LEX, "session_id", "at", "segment_id", "text", position="pos", position_stop="pos_stop").orderBy("segment_id").collect()
    assert [(r.tag, r.stop) for r in got] == [(None, None), ("ADD", 21200.0), (None, None)]


def test_odd_rows(spark):
    rows = [(None, "1", 0.0, "i m long now", None), ("a", "1", 0.0, None, 1.0), ("a", "2", 1.0, "  ", 1.0), ("a", "3", 2.0, "i m long now", None), ("a", "3", 2.0, "i m long now", None)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "session_id string, segment_id string, at double, text string, market double, bits int, tag string")
    got = sorted(((r.session_id or "", r.segment_id, r.tag, r.before, r.after) for r in fl.interpret(df, LEX, "session_id", "at", "segment_id", "text").collect()), key=repr)
    assert got == [("", "1", "ENTER_LONG", "FLAT", "LONG"), ("a", "3", "ADD", "LONG", "LONG"), ("a", "3", "ENTER_LONG", "FLAT", "LONG")]
    assert fl.interpret(df.limit(0), LEX, "session_id", "at", "segment_id", "text").collect() == []
    with pytest.raises(KeyError):
        fl.lexicon(no_such_group=[])


# --- streams ---------------------------------------------------------------------------------------------------

SPOKEN = ["I'm long at 52", "putting a little piece on", "short versus 44", "and now I'm", "flat", "taking some off", "gold is rising", "looking for a short", "got something on here", "break even", "the candle is green", "no reclaim of 40 or I'm out", "I'm short now", "adding here", "my stop is 35", "scratch that"]
SCHEMA = "session_id string, segment_id string, received_at timestamp, status string, text string, market double"


def talk(sessions=3, rows=40):
    """Rows of some sessions in the order of time."""
    out, t = [], 0.0
    for k in range(rows):
        t += [1.0, 2.5, 4.0, 6.0, 9.0, 35.0][(k * 7 + k // 5) % 6]
        out += [(f"s{s}", f"{k:04d}", t, SPOKEN[(k * (s + 3) + s) % len(SPOKEN)]) for s in range(sessions)]
    pieces = [("r", f"{k:04d}", out[0][2] + 30.0 * (k // 2) + 5.0 * (k % 2), ["putting a little piece on", "short versus 44"][k % 2]) for k in range(6)]
    return sorted(out + pieces, key=lambda r: r[2])


def feed(spark, folder, rows, parts):
    os.makedirs(folder)
    normal = {x: n for x, n in spark.createDataFrame([(x,) for x in sorted({r[3] for r in rows})], "x string").select("x", tx.normalize_text(F.col("x"))).collect()}
    size = -(-len(rows) // parts)
    for k in range(parts):
        lines = [json.dumps(dict(session_id=s, segment_id=i, received_at=f"2026-03-01T00:{int(t) // 60:02d}:{t % 60:06.3f}Z", status="final", text=normal[x], market=MARKET)) for s, i, t, x in rows[k * size : (k + 1) * size]]
        name = f"{folder}/{k:03d}.json"
        open(name, "w").write("\n".join(lines))
        os.utime(name, (1_800_000_000 + k, 1_800_000_000 + k))
    return str(folder)


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(400)
    finally:
        q.stop()


def to_files(stream, at):
    return stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp")


@pytest.fixture()
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_stream_says_what_the_batch_says(spark, tmp_path, few_partitions, parts):
    rows = talk()
    folder = feed(spark, tmp_path / "in", rows, parts)
    stream = sf.stream_interpret(st.segment_source(spark, folder, SCHEMA, per_trigger=1), LEX, market=F.col("market"))
    drain(to_files(stream, tmp_path))
    batch = spark.read.schema(SCHEMA).json(folder).withColumn("at", F.col("received_at").cast("double"))
    want = fl.interpret(batch, LEX, "session_id", "at", "segment_id", "text")
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.filter("recovered").count() > 0 and got.filter("tag is not null").count() > 20


def state_rows(spark, at, operator, name):
    read = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name)
    return read.load(f"{at}/cp").count()


def test_state_is_dropped_when_its_time_is_over(spark, tmp_path, few_partitions):
    """One session speaks; another moves the watermark on: each memory is gone after its seconds, and all after the idle time."""
    folder, at = tmp_path / "in", tmp_path
    stream = lambda: sf.stream_interpret(st.segment_source(spark, str(folder), SCHEMA, per_trigger=1), LEX, late="0 seconds", market=F.col("market"))
    start = [("a", "0001", 100.0, "gold is rising"), ("a", "0002", 101.0, "taking some off"), ("b", "0001", 100.0, "I'm flat"), ("c", "0001", 100.0, "putting a little piece on")]
    feed(spark, folder, start, 1)
    drain(to_files(stream(), at))
    names = [(1, "last")] + [(0, n) for n in ("cues", "intent", "window", "recent", "held")]
    count = lambda: {n: state_rows(spark, at, op, n) for op, n in names}
    first = count()
    assert first["cues"] == 2 and first["intent"] == 1 and first["window"] == 2 and first["held"] == 3 and first["last"] >= 3
    seen = {}
    for k, t in enumerate([102.6, 106.2, 109.2, 120.2, 131.2, 50000.0], 1):
        name = f"{folder}/{k:03d}.json"
        minutes, seconds = divmod(t, 60)
        stamp = f"2026-03-01T{int(minutes) // 60:02d}:{int(minutes) % 60:02d}:{seconds:06.3f}Z"
        lines = [json.dumps(dict(session_id="z", segment_id=f"{k:04d}{x}", received_at=stamp, status="final", text="the candle is green", market=MARKET)) for x in "ab"]
        open(name, "w").write("\n".join(lines))
        os.utime(name, (1_800_000_000 + k, 1_800_000_000 + k))
        drain(to_files(stream(), at))
        drain(to_files(stream(), at))
        seen[t] = count()
    assert [seen[t]["window"] for t in (102.6, 106.2, 109.2)] == [2, 1, 0]
    assert seen[109.2]["intent"] == 0 and seen[106.2]["intent"] == 1
    assert seen[120.2]["cues"] == 1 and seen[109.2]["cues"] == 2
    assert seen[131.2]["cues"] == 0
    assert seen[50000.0]["held"] == 1 and seen[131.2]["held"] == 4


def test_previews_are_confirmed_flattened_or_expire(spark, tmp_path, few_partitions):
    folder = tmp_path / "in"
    os.makedirs(folder)
    schema = "session_id string, segment_id string, received_at timestamp, kind string, stop double"
    parts = [[("a", "1", 0, "preview", 35.0), ("b", "1", 0, "preview", 35.0), ("c", "1", 0, "preview", 35.0)], [("a", "2", 5, "strong", 35.0), ("b", "2", 5, "strong", 36.0)], [("z", "1", 60, "none", None)], [("z", "2", 61, "none", None)]]
    for k, part in enumerate(parts):
        open(f"{folder}/{k}.json", "w").write("\n".join(json.dumps(dict(session_id=s, segment_id=i, received_at=f"2026-03-01T00:{t // 60:02d}:{t % 60:02d}Z", kind=x, stop=p)) for s, i, t, x, p in part))
        os.utime(f"{folder}/{k}.json", (1_800_000_000 + k, 1_800_000_000 + k))
    source = st.segment_source(spark, str(folder), schema, per_trigger=1)
    kind = F.col("kind")
    drain(to_files(sf.stream_confirm_preview(source, kind == "preview", kind == "strong", kind == "strong", F.col("stop"), late="1 seconds"), tmp_path))
    got = {r.session_id: (r.outcome, r.confirmed_by) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a": ("confirmed", "2"), "b": ("flattened", None), "c": ("expired", None)}


def test_late_rows_have_a_table_of_their_own(spark, tmp_path):
    rows = [("a", "1", 0.0, "x"), ("a", "2", 50.0, "x"), ("a", "3", 10.0, "late"), ("a", "4", 41.0, "x"), ("a", "5", 90.0, "x"), ("a", "6", 80.0, "late"), ("a", "7", 200.0, "x")]
    folder = feed(spark, tmp_path / "in", rows, 4)
    drain(sf.split_late(st.segment_source(spark, folder, SCHEMA, per_trigger=1), "received_at", 10.0, str(tmp_path / "split"), str(tmp_path / "cp")))
    ids = lambda name: sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/split/{name}").select(F.col("segment_id").cast("string")).collect())
    assert ids("late") == ["3"] and ids("on_time") == ["1", "2", "4", "5", "6", "7"]


def test_the_stream_query_says_what_the_batch_says(spark):
    from livetext.plans import flows

    folder = "/root/testdata/sf0.001"
    rows = flows.segments(spark, folder).withColumn("at", F.col("received_at").cast("double"))
    want = fl.interpret(rows, flows.SURROGATE, "session_id", "at", "segment_id", "text", resolve=flows.by_length)
    got = flows.interpret_stream(spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.filter("tag is not null").count() > 10


def test_a_rule_is_matched_once_for_all_joined_texts(spark):
    """Where each rule hits among texts that end in one another, by brute force; rules that ask what stands before them are tried on each."""
    import re

    rows = ["in the end", "we are. in", "begin", "the long term", "long here"]
    texts = [" ".join(rows[len(rows) - k :]) for k in range(1, 6)]
    rules = [r"^in ", r"(?:^|[ .])(?:in|we)(?:[ .]|$)", r"\bbegin\b", r"\blong\b(?!\s+term)", r"here$", r"(?<!the )long", r"nothing", r"[^a-z]in"]
    assert [fl._suffix_safe(p) for p in rules] == [False, True, True, True, True, False, True, True]
    for n in range(1, 6):
        data = spark.createDataFrame([(texts[:n],)], "t array<string>")
        got = data.select(*[fl._where(F.col("t"), [p]).alias(f"r{k}") for k, p in enumerate(rules)]).first()
        for k, p in enumerate(rules):
            assert [bool(got[k] >> j & 1) for j in range(1, n + 1)] == [bool(re.search(p, t)) for t in texts[:n]], (p, n)
