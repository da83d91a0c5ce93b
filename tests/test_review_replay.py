"""Cases of the review rules, the repair of examples and its report, and replays."""

import random

from pyspark.sql import functions as F

from livetext.operators import review as rv

FIELDS = "id int, label string, side string, status string, current_text string, evidence_text string"


def reviewed(spark, *rows):
    data = [(k, label, side, "pending", text, None) for k, (label, side, text) in enumerate(rows)]
    got = rv.auto_review(spark.createDataFrame(data, FIELDS)).orderBy("id").collect()
    return [(r.status, r.reviewed_label, r.reviewed_side, r.note) for r in got]


def test_every_rule_decides(spark):
    cases = {
        ("TRIM", "LONG", "peeled a bit of NVDA, trim there"): ("rejected", "NO_ACTION", None, "other instrument"),
        ("SETUP_LONG", "LONG", "whatever it says"): ("accepted", "SETUP_LONG", "LONG", "auto setup"),
        ("ENTER_LONG", "LONG", "Now we're looking to sell it"): ("corrected", "SETUP_SHORT", "SHORT", "auto setup short"),
        ("ADD", "SHORT", "let it dip, I buy dips"): ("corrected", "SETUP_LONG", "LONG", "auto setup long"),
        ("ENTER_SHORT", "sell", "so I got my ad on"): ("corrected", "ADD", "SHORT", "explicit add"),
        ("ENTER_SHORT", None, "so I got my ad on"): ("corrected", "ADD", None, "explicit add"),
        ("ADD", "LONG", "later I will maybe add"): ("rejected", "NO_ACTION", None, "future or conditional add"),
        ("ADD", "LONG", "yes, popped one back on"): ("accepted", "ADD", "LONG", "explicit add"),
        ("ENTER_LONG", "LONG", "I'm in a long"): ("accepted", "ENTER_LONG", "LONG", "explicit entry"),
        ("ENTER_SHORT", "SHORT", "they are reselling here"): ("rejected", "NO_ACTION", None, "ambiguous market action"),
        ("TRIM", "LONG", "now you can pay yourself, trim"): ("rejected", "NO_ACTION", None, "second person advice"),
        ("TRIM", "LONG", "covering some"): ("accepted", "TRIM", "LONG", "explicit trim"),
        ("EXIT_ALL", "LONG", "and cut the rest into it, then flat now"): ("rejected", "NO_ACTION", None, "future exit target"),
        ("EXIT_ALL", "LONG", "Flat -- now!"): ("accepted", "EXIT_ALL", "LONG", "explicit exit"),
        ("MOVE_TO_BREAKEVEN", "LONG", "stop break even"): ("accepted", "MOVE_TO_BREAKEVEN", "LONG", "explicit stop move"),
        ("NO_ACTION", None, None): ("accepted", "NO_ACTION", None, "already no action"),
        ("TARGET", "BUY", "feeler on long"): ("accepted", "TARGET", "BUY", "explicit side action"),
    }
    assert reviewed(spark, *cases) == list(cases.values())
    assert {c[3] for c in cases.values()} == {r.note for r in rv.RULES}


def test_what_no_rule_hits_stays_pending(spark):
    rows = [("TARGET", None, "feeler on long"), ("TARGET", "x", "feeler on long"), ("TRIM", "LONG", "hello"), ("EXIT_ALL", "LONG", None), ("HOLD", "LONG", "nvda"), (None, "LONG", "nvda")]
    assert reviewed(spark, *rows) == [("pending", None, None, None)] * len(rows)


def test_reviewed_rows_keep_their_results(spark):
    schema = FIELDS + ", reviewed_label string, reviewed_side string, note string"
    rows = [(1, "NO_ACTION", None, "rejected", "x", None, "TRIM", "LONG", "by hand"), (2, "ENTER_LONG", "LONG", None, "and", "a small piece on", None, None, None), (3, "TRIM", None, None, "x", "y", "a", "b", "c")]
    got = {r.id: (r.status, r.reviewed_label, r.reviewed_side, r.note) for r in rv.auto_review(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("rejected", "TRIM", "LONG", "by hand"), 2: ("accepted", "ENTER_LONG", "LONG", "explicit entry"), 3: ("pending", "a", "b", "c")}
    assert rv.auto_review(spark.createDataFrame([], FIELDS)).count() == 0


EXAMPLE = "id long, file string, line long, label string, position_side string, original_side string, last_side string, prompt string, symbol string, text string"


def examples(spark, rows):
    return rv.cleanup_examples(spark.createDataFrame(rows, EXAMPLE), F.when(F.col("text").contains("you can"), "you can"))


def test_repair_flags_and_prompts(spark):
    old = "symbol=ES\nposition=FLAT\nmarket_price=5\nrecent=a b\ncurrent="
    rows = [
        (1, "f", 1, "TRIM", "FLAT", "SHORT", "LONG", old, "ES", "x"),
        (2, "f", 4, "TRIM", None, "none", "LONG", None, None, "x"),  # three lines after: a repeat
        (3, "f", 5, "TRIM", "LONG", None, None, "", None, "x"),  # four lines after the last kept one
        (4, "f", 6, "NO_ACTION", "FLAT", "LONG", None, "", None, "you can"),
        (5, "f", 7, "NO_ACTION", "FLAT", "LONG", None, "", None, "x"),  # no action is never a repeat
        (6, "f", 8, "TRIM", "FLAT", None, "NONE", "", None, "you can"),  # another label came between
        (7, "g", 8, "ENTER_LONG", "FLAT", None, None, "", None, "so you can"),
        (8, "g", 8, "ENTER_LONG", "FLAT", None, None, "", None, "x"),
        (9, "g", 20, None, None, None, None, None, None, None),
    ]
    got = {r.id: r for r in examples(spark, rows).collect()}
    assert {k: (r.position_side, r.repaired, r.flag_reason) for k, r in got.items()} == {
        1: ("SHORT", True, None),
        2: ("LONG", True, "duplicate_same_action_within_3_lines"),
        3: ("LONG", False, None),
        4: ("FLAT", False, None),
        5: ("FLAT", False, None),
        6: ("FLAT", False, "TRIM_while_FLAT"),
        7: ("FLAT", False, "advice_pattern: you can"),
        8: ("FLAT", False, "duplicate_same_action_within_3_lines"),
        9: ("FLAT", False, None),
    }
    assert got[1].prompt == "symbol=ES\nposition=SHORT\nlast_side=LONG\nrecent=a b\ncurrent=" and got[1].rebuilt
    assert got[9].prompt == "symbol=MNQ 03-26\nposition=FLAT\nlast_side=NONE"
    again = spark.createDataFrame([(1, "f", 1, "TRIM", "SHORT", None, "LONG", got[1].prompt, "ES", "x")], EXAMPLE)
    assert not rv.cleanup_examples(again, F.lit("")).first().rebuilt
    report = {(r.measure, r.name): r.n for r in rv.cleanup_report(examples(spark, rows)).collect()}
    assert report["input_examples", ""] == 9 and report["output_clean", ""] + report["output_flagged", ""] == 9
    assert report["duplicates_removed", ""] == 2 and report["impossible_state_flagged", ""] == 1 == report["advice_pattern_flagged", ""]
    assert report["flag_reason", "TRIM_while_FLAT"] == 1 and report["clean_label", "TRIM"] == 2 and ("flag_reason", "") not in report
    empty = {(r.measure, r.name): r.n for r in rv.cleanup_report(examples(spark, rows[:1]).filter("id < 0")).collect()}
    assert empty == {}


def test_repeats_equal_a_walk_over_all_rows(spark):
    rng = random.Random(5)
    rows, line = [], 0
    for k in range(400):
        line = 0 if k % 100 == 0 else line + rng.randint(0, 3)
        rows.append((k, f"f{k // 100}", line, rng.choice(["TRIM", "TRIM", "TRIM", "EXIT_ALL", "NO_ACTION"]), "LONG", None, None, "", None, ""))
    last, want = None, set()
    for r in rows:
        if last and r[3] != "NO_ACTION" and (r[1], r[3]) == (last[1], last[3]) and r[2] - last[2] <= 3:
            want.add(r[0])
        else:
            last = r
    got = examples(spark, rows).filter("flag_reason like 'duplicate%'").collect()
    assert {r.id for r in got} == want and len(want) > 50
