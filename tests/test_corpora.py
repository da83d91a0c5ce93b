"""Files of reviewed corpora, counts of the data set built from them, and context of hard negatives."""

from pyspark.sql import functions as F

from livetext.operators import corpora as co


def test_inputs_are_files_and_folders_once(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    (tmp_path / "a" / "reviewed_examples.jsonl").write_text("{}")
    (tmp_path / "other.jsonl").write_text("{}")
    a, b, other = (str(tmp_path / n) for n in ("a", "b", "other.jsonl"))
    assert co.resolve_inputs(spark, [other, b, a + "/", a, f"{a}/reviewed_examples.jsonl", f"{b}/none.jsonl"]) == [other, f"{a}/reviewed_examples.jsonl"]
    assert co.resolve_inputs(spark, []) == []


def test_counts_of_a_data_set(spark):
    rows = [("f", 1, 0, 0, "ADD", "LONG"), ("f", 1, 1, 0, "TRIM", None), ("f", 1, 1, 1, "ADD", None), ("f", 2, 0, 1, "SETUP_LONG", None), ("f", 2, 0, 2, "SETUP_LONG", None), ("g", 1, 0, 3, None, None)]
    data = spark.createDataFrame(rows, "file string, line int, ordinal int, row int, label string, side string")
    got = {(r.measure, r.name): r.n for r in co.dataset_summary(data, ["side"]).collect()}
    assert got == {
        ("input", "0"): 4, ("input", "1"): 2, ("raw_label", "ADD"): 2, ("raw_label", "TRIM"): 1, ("raw_label", "SETUP_LONG"): 2, ("raw_label", ""): 1,
        ("output_label", "TRIM"): 1, ("output_label", "NO_ACTION"): 1, ("output_label", ""): 1, ("dropped", "add_without_side"): 1, ("replaced_same_line_examples", ""): 2, ("exported_examples", ""): 3,
    }
    assert co.dataset_summary(data.filter("line < 0"), ["side"]).count() == 0


def test_hard_negatives_with_context(spark):
    said = ["Got knocked out", "so I was long on it", None, "hello", "if you re short, fine", "hello there", "I was short on that", "bye"]
    lines = spark.createDataFrame([(f, k + 1, t) for f in ("a", "b") for k, t in enumerate(said)], "file string, line int, text string")
    reviewed = spark.createDataFrame([("a", 2, "NO_ACTION"), ("a", 6, "TRIM")], "file string, line int, label string")
    covered = spark.createDataFrame([("b",)], "file string")
    got = {r.line: r for r in co.mine_hard_negatives(lines, reviewed, covered).collect()}
    assert set(got) == {1}  # 2 is reviewed, 5 and 7 stand beside an action
    assert (got[1].recent_text, got[1].analysis_text, got[1].entry_text) == (None, "got knocked out so i was long on it", "got knocked out")
    assert (got[1].label, got[1].position_side, got[1].family) == ("NO_ACTION", "LONG", "retrospective_position_story")
    assert got[1].prompt == "symbol=MNQ 03-26\nposition=LONG\nlast_side=LONG\nanalysis=got knocked out so i was long on it\ncurrent=Got knocked out"
    free = co.mine_hard_negatives(lines, reviewed, most=2).select("file", "line", "family").collect()
    assert sorted(map(tuple, free)) == [("a", 1, "retrospective_position_story"), ("b", 1, "retrospective_position_story"), ("b", 5, "advisory_or_hypothetical")]
    five = co.mine_hard_negatives(lines, reviewed.limit(0), most=9).filter("file = 'b' and line = 5").first()
    assert five.recent_text.split() == ["hello"] and five.entry_text == "hello if you re short, fine" and five.position_side == "SHORT"


def test_a_prompt_leaves_out_what_repeats(spark):
    c = lambda x: F.lit(x).cast("string")
    row = spark.range(1).select(co.context_prompt(c("s"), c("FLAT"), c("NONE"), c(None), c("x"), c("x y"), c("x"), c(" ".join(map(str, range(60))))).alias("p")).first()
    lines = row.p.split("\n")
    assert lines[3] == "entry=x y" and lines[4] == "current=" + " ".join(map(str, range(12, 60))) and len(lines) == 5
