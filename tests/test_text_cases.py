"""Cases of text, captions, prices, risk, evaluation and stream state in sentences of our own."""

import random

import pytest
from pyspark.sql import functions as F

from livetext.functions import prices
from livetext.functions import text as tx
from livetext.operators import evaluation as ev
from livetext.operators import ordered as od
from livetext.operators import risk
from livetext.sources import transcripts as src
from livetext.streaming import state


def ask(spark, f, *values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_misheard_words(spark):
    texts = ["Above the view up, broke even and the M N Q", "Paying myself a peace", "peace on here, not at peace", "Sold 1,250,300 of E S", None, "got my ad on"]
    want = ["above the vwap, breakeven and the mnq", "paying myself piece", "piece on here, not at peace", "sold 1250300 of es", None, "got my add on"]
    assert ask(spark, tx.asr_correct, *texts) == want
    assert ask(spark, tx.normalize_text, "Café — point of 5.5!", "½ off_it") == ["café point 5.5", "½ off_it"]


def test_markup_decodes_all_references_and_joins_words(spark):
    raw = ["he<b>l</b>lo &eacute;&#8364;&#x41;", "a&nbsp;​b<br>c", "&amp;lt;i&gt; stays", "", None]
    assert ask(spark, tx.clean_markup, *raw) == ["hello é€A", "a bc", "&lt;i> stays", "", None]


def test_degenerate_texts(spark):
    one = "a b c d e f g h i j k l"
    bad = ["go " * 10, one + " x x x x x", one + " p q p q p q p q", one + " p q r p q r p q r", one + " p q r s p q r s p q r s"]
    assert ask(spark, tx.degenerate_text, *bad, one, one + " x x x x", one + " p q p q p q", "go " * 9, "") == [True] * 5 + [False] * 5


def test_same_side_entries_are_adds(spark):
    tag = lambda t: tx.detect_signal(t, {"long": ["buy"], "out": ["flat"]}, {"long": "ENTER_LONG", "out": "EXIT_ALL"}, F.lit("LONG"))
    assert ask(spark, tag, "buy it", "flat now", "nothing") == ["ADD", "EXIT_ALL", None]


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n1\n00:00:07.000 --> 00:00:08.000\nHere we\n\n00:00:07.500 --> 00:00:09.000\nHere we go &amp; stay\n\n00:01:09.000 --> 00:01:10.000\n<c>Next</c> line\nof it\n"
    files = spark.createDataFrame([("f", vtt)], "file string, text string")
    cues = od.collapse_captions(src.parse_vtt(files).select("file", "ts_s", "text"), "file", "ts_s", "text").withColumn("seq", F.col("ts_s"))
    assert src.transcript_files(src.render_transcript(cues)).first().text == "[00:00:07] Here we go & stay\n[00:01:09] Next line of it\n"
    json3 = '{"events": [{"tStartMs": 431000, "segs": [{"utf8": "quite "}, {"utf8": "a day"}]}, {"tStartMs": 433900}, {"tStartMs": 4330000, "segs": [{"utf8": "over"}]}]}'
    found = src.parse_json3(spark.createDataFrame([("f", json3)], "file string, text string"))
    assert [r.value for r in src.render_transcript(found).orderBy("seq").collect()] == ["[00:07:11] quite a day", "[01:12:10] over"]
    name = spark.createDataFrame([("20260306", "Jobs report / a recap", "x1"), ("soon", "///", "x2")], "d string, t string, v string").select(src.transcript_name(F.col("d"), F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in name] == ["2026-03-06__Jobs-report-a-recap__x1.txt", "unknown-date__x2__x2.txt"]


def test_tracks_fall_back_to_all(spark):
    rows = [("a", "automatic", "en"), ("a", "manual", "fr"), ("b", "automatic", "en-GB"), ("b", "automatic", "en-orig"), ("b", "automatic", "de"), ("c", "manual", "My_Live_Chat"), ("d", "manual", "EN"), ("d", "manual", "en-US")]
    got = {r.video: (r.kind, r.lang) for r in src.rank_tracks(spark.createDataFrame(rows, "video string, kind string, lang string")).collect()}
    assert got == {"a": ("manual", "fr"), "b": ("automatic", "en-GB"), "d": ("manual", "EN")}


def test_reviewed_files_keep_corrupt_lines_aside(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n')
    (tmp_path / "b.jsonl").write_text('{"id": 2}\n')
    got = src.read_reviewed(spark, [str(tmp_path / x) for x in ("a.jsonl", "b.jsonl", "a.jsonl")], "id long").collect()
    assert sorted((r.id or 0, r.input_ordinal, r._corrupt_record is not None) for r in got) == [(0, 0, True), (1, 0, False), (2, 1, False)]


PRICES = [("forty six", 21243.75, 21246.0), ("five fifty", 548.0, 550.0), ("twenty five thousand twenty", 24962.5, 25020.0), ("nineteen fifty half", 19440.0, 1950.5), ("80 quarter", 19450.0, 19480.25), ("1,234", 5.0, 1234.0), ("12", None, 12.0), ("no price", 100.0, None), ("twenty oh five", 2000.0, 2005.0)]


def test_spoken_prices(spark):
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(PRICES)], "k int, raw string, market double, want double")
    got = rows.select("k", "raw", prices.resolve_price(F.col("raw"), F.col("market")).alias("p"), "want").orderBy("k").collect()
    near = [r for r in got if r.raw != "nineteen fifty half"]  # of its readings the nearest to the market counts
    assert [r.p for r in near] == [r.want for r in near]
    assert abs(next(r.p for r in got if r.raw == "nineteen fifty half") - 19440.0) < 200


BASE = {"tag": "ENTER_LONG", "age_ms": 0, "stale_after_ms": 5000, "latency_ms": 0, "confidence": 0.95, "guard": None, "last": 21240.0, "held": None, "held_stop": None, "entry": 21241.0, "stop": 21230.0, "size": 1}
RISKS = [
    ({}, "Approved."), ({"stop": None}, "Stop price is required for entries."), ({"latency_ms": 29000}, "Entry signal too old (29000 ms)."), ({"guard": "a cue"}, "Entry blocked by context guard: a cue."),
    ({"tag": "ADD", "held": 1, "held_stop": 21210.0, "stop": None}, "Approved."), ({"held": 1}, "Position already open."), ({"age_ms": 5001}, "Intent is stale."), ({"confidence": 0.7}, "Confidence below threshold."),
    ({"last": None}, "No market price available."), ({"entry": 21249.0}, "Entry too far from current market."), ({"tag": "ADD", "held": 4}, "Position would exceed max contract size."), ({"tag": "TRIM"}, "No open position to manage."), ({"entry": None}, "Approved."),
]


def test_risk_reasons(spark):
    kinds = {"tag": "string", "guard": "string", **{c: "double" for c in ("confidence", "last", "held_stop", "entry", "stop")}}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in BASE) + ", want string"
    rows = spark.createDataFrame([(*(BASE | x).values(), want) for x, want in RISKS], schema)
    got = rows.select(risk.risk_gate({c: F.col(c) for c in BASE}).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_ledger_rejects_a_command_without_contracts(spark):
    rows = [(1, "ENTER", 2, 100.0, 95.0), (2, "ADD", None, 110.0, None), (3, "ADD", 2, 110.0, None), (4, "BREAKEVEN", None, None, None), (5, "TRIM", 1, None, None), (6, "EXIT", None, None, None), (7, "TRIM", 1, None, None)]
    data = spark.createDataFrame([(1, o, k, "LONG", q, p, s) for o, k, q, p, s in rows], "key int, o long, kind string, side string, qty int, price double, stop double")
    got = [(r.qty, r.ok, r.avg_price, r.stop) for r in risk.position_ledger(data, "key", "o").orderBy("o").collect()]
    assert got == [(2, True, 100.0, 95.0), (2, False, 100.0, 95.0), (4, True, 105.0, 95.0), (4, True, 105.0, 105.0), (3, True, 105.0, 105.0), (0, True, 0.0, None), (0, False, 0.0, None)]


def test_paired_t(spark):
    rows = [("a", k, x) for k, x in enumerate((0.8, 0.82, 0.79, 0.85, 0.81))] + [("b", k, x) for k, x in enumerate((0.7, 0.75, 0.74, 0.72, 0.71))] + [("c", k, x - 0.1) for k, x in enumerate((0.7, 0.75, 0.74, 0.72, 0.71))]
    got = {(r.model_a, r.model_b): r for r in ev.paired_t(spark.createDataFrame(rows, "model string, fold int, value double")).collect()}
    one = got["a", "b"]
    assert one.mean_difference == 0.09 and one.p_value < 0.01 and one.significant and one.ci_lower < 0.09 < one.ci_upper
    assert abs(ev.t_p_value(2.7764451051977987, 4) - 0.05) < 1e-9 and abs(ev.t_critical(9) - 2.2621571628540993) < 1e-9
    same = ev.paired_t(spark.createDataFrame([(m, k, 0.5) for m in "ab" for k in range(3)], "model string, fold int, value double")).first()
    assert (same.t_statistic, same.p_value, same.significant, same.ci_lower, same.ci_upper) == (0.0, 1.0, False, 0.0, 0.0)


def test_overall_metrics(spark):
    rows = spark.createDataFrame([("none", "none"), ("none", "long"), ("long", "long"), ("short", "none"), ("short", "long")], "y string, p string")
    got = ev.overall_metrics(rows, ["none", "long", "short"], "none").first()
    assert (got.accuracy, got.action_precision, got.action_recall, got.action_f1) == (0.4, 0.6667, 0.6667, 0.6667) and got.macro_f1 == round((0.5 + 0.5 + 0) / 3, 4)


def partial_rows(texts):
    return [("u", k, t) for k, t in enumerate(texts)]


def test_stable_words_stay(spark):
    texts = ["price into that level we", "price into that level we just", "we just talked about right here", "", "about right here, now"]
    got = state.stabilize_partials(spark.createDataFrame(partial_rows(texts), "utterance_id string, seq long, text string")).orderBy("seq").collect()
    assert got[1].committed == "price into that level" and got[2].shown == "price into that level we just talked about right here"
    assert all(r.shown.startswith(p.committed) for p, r in zip(got, got[1:], strict=False)) and got[3].shown == got[3].committed


def feed(spark, rows, schema, folder, parts):
    for k in range(parts):
        spark.createDataFrame([r for j, r in enumerate(rows) if j * parts // len(rows) == k], schema).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


@pytest.mark.parametrize("which", ["intents", "partials"])
def test_stream_equals_batch(spark, tmp_path, which):
    rng = random.Random(3)
    words = "buy it now the level holds sell flat trim wait for more".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(4))
    if which == "intents":
        schema = "session_id string, segment_id string, at double, status string, text string"
        rows = [(f"s{k % 3}", f"{k:04d}", float(k), rng.choice(["final", "final", "partial"]), text()) for k in range(90)]
        op = lambda df: state.stream_intents(df, [("flat", "EXIT_ALL"), ("trim", "TRIM"), ("buy", "ENTER_LONG"), ("sell", "ENTER_SHORT")])
    else:
        schema = "utterance_id string, seq long, text string"
        rows = [(f"u{k % 3}", k, text()) for k in range(60)]
        op = state.stabilize_partials
    stream = op(feed(spark, rows, schema, str(tmp_path / "in"), 5))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    want = op(spark.createDataFrame(rows, schema)).collect()
    assert len(want) > 20 and sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want))


def test_duplicates_of_the_last_kept_intent(spark):
    rows = [(1, 0.0, "ENTER_LONG", "LONG", 5.0, False), (2, 2.0, "ENTER_LONG", "LONG", 5.0, False), (3, 4.0, "ENTER_LONG", "LONG", 5.0, False), (4, 5.0, "ADD", "LONG", 5.0, True), (5, 6.0, "ADD", "LONG", 6.0, True), (6, 7.0, "TRIM", "LONG", None, False), (7, 8.0, "TRIM", "LONG", None, False)]
    data = spark.createDataFrame([(1, *r[:5], None, None, r[5]) for r in rows], "key int, id long, t double, tag string, side string, entry double, stop double, target double, follow boolean")
    assert sorted(r.id for r in od.suppress_duplicates(data, "key", "t", "id", F.col("follow")).collect()) == [1, 3, 5, 6]
