"""Reviewed corpora from files to one data set with its counts, and hard negatives with their context."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetext.functions import text as tx
from livetext.operators import cascade as cc
from livetext.operators import relational as rel

# Families of talk that looks like an intent and is none, the first that hits counts; and words that hint at a side.
FAMILIES = {
    "retrospective_entry_loss": [
        r"\bi thought\b.*\b(?:put|got)\s+(?:a\s+)?(?:small|little)?\s*(?:piece|peace)\s+on\b",
        r"\b(?:put|got)\s+(?:a\s+)?(?:small|little)?\s*(?:piece|peace)\s+on\b.*\b(?:took|take)\s+a\s+loss\b",
        r"\bdidn t stick to my rules\b",
    ],
    "retrospective_position_story": [
        r"\bremember\b.*\b(?:i was|we were|we re|we are)\s+(?:long|short)\b",
        r"\bi was (?:long|short)\s+on\b",
        r"\bwe(?: re| are)\s+(?:long|short)\s+from\b",
        r"\blong from down here\b",
        r"\bshort from up here\b",
        r"\bgot knocked out\b",
    ],
    "advisory_or_hypothetical": [
        r"\bdon t want to be (?:a buyer|a seller|buying|selling|entering (?:long|short))\b",
        r"\bthe only time we can be a buyer\b",
        r"\bi ll look for a reload\b",
        r"\byou could (?:be|get|go) (?:long|short)\b",
        r"\bif you(?: re| are| were)\s+(?:long|short)\b",
    ],
}
LONG_HINT, SHORT_HINT = r"\b(?:long|buyer|buying|buy)\b", r"\b(?:short|seller|selling|sell)\b"
# End of the fixed values.


def resolve_inputs(spark: SparkSession, inputs: list[str], name: str = "reviewed_examples.jsonl") -> list[str]:
    """The files that ``inputs`` name, each once, in order: a path with the ending of ``name`` is itself, any other one a folder that
    holds ``name``. What doesn't exist is left out. A file may be a folder of parts, as Spark writes it."""

    def exists(path: str) -> bool:
        try:
            spark.read.format("text").load(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    ending = "." + name.rsplit(".", 1)[-1]
    paths = [p.rstrip("/") if p.rstrip("/").endswith(ending) else f"{p.rstrip('/')}/{name}" for p in inputs]
    return [p for p in dict.fromkeys(paths) if exists(p)]


def dataset_summary(corpora: DataFrame, sides: list[str]) -> DataFrame:
    """(measure, name, n) of what ``dataset_build`` makes of its rows: rows by input, labels before and after, rows dropped by
    reason, rows of a line that a later row replaces, and rows kept. A null label is the empty name."""
    x = cc.remap_labels(corpora.withColumn("raw", F.coalesce("label", F.lit(""))), sides)
    latest = Window.partitionBy("file", "line", F.col("dropped").isNull()).orderBy(F.desc("ordinal"), F.desc("row"))
    x = x.withColumn("rn", F.row_number().over(latest))
    label, valid = F.coalesce("label", F.lit("")), F.col("dropped").isNull()
    kept = valid & (F.col("rn") == 1)
    say = lambda measure, name, holds: F.struct(F.lit(measure).alias("measure"), name.alias("name"), holds.cast("long").alias("n"))
    all_, none = F.lit(True), F.lit("")
    says = F.array(
        say("input", F.col("ordinal").cast("string"), all_),
        say("raw_label", F.col("raw"), all_),
        say("output_label", label, kept),
        say("dropped", F.coalesce("dropped", none), ~valid),
        say("replaced_same_line_examples", none, valid & (F.col("rn") > 1)),
        say("exported_examples", none, kept),
    )
    counts = x.select(F.explode(says).alias("s")).select("s.*").groupBy("measure", "name").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") > 0) | F.col("measure").isin("replaced_same_line_examples", "exported_examples"))


def hinted_side(text: Column, long: str = LONG_HINT, short: str = SHORT_HINT) -> tuple[Column, Column]:
    """(position, last side) that a corrected text hints at: only where one of the two sides is named."""
    is_long, is_short = F.coalesce(text.rlike(long), F.lit(False)), F.coalesce(text.rlike(short), F.lit(False))
    side = F.when(is_long & ~is_short, "LONG").when(is_short & ~is_long, "SHORT")
    return F.coalesce(side, F.lit("FLAT")), F.coalesce(side, F.lit("NONE"))


def context_prompt(symbol: Column, position: Column, last_side: Column, recent: Column, analysis: Column, entry: Column, normal: Column, current: Column) -> Column:
    """A classifier's prompt: texts that only repeat another one, or are empty, are left out; each is cut to its last 48 words."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    line = lambda name, c: F.concat(F.lit(name + "="), tx.clip_words(c))
    head = [F.concat(F.lit(n + "="), c) for n, c in (("symbol", symbol), ("position", position), ("last_side", last_side))]
    parts = [
        F.when(said(recent), line("recent", recent)),
        F.when(said(analysis) & (analysis != normal), line("analysis", analysis)),
        F.when(said(entry) & (entry != normal) & (entry != analysis), line("entry", entry)),
        line("current", F.coalesce(current, F.lit(""))),
    ]
    return F.concat_ws("\n", *head, *parts)


def mine_hard_negatives(
    lines: DataFrame,
    reviewed: DataFrame,
    covered: DataFrame | None = None,
    families: dict = FAMILIES,
    most: int = 40,
    symbol: str = "MNQ 03-26",
    hints: tuple[str, str] = (LONG_HINT, SHORT_HINT),
) -> DataFrame:
    """Rows (file, line, text) of a family as examples of no action: family, label, texts of their context, side and prompt.

    Not taken are lines of ``reviewed`` (file, line, label), the lines next to one that is an action there, and files of ``covered``; then
    ``most`` lines a family stay, in the order of file and line. The context is that of all rows of a file: two before
    (``recent_text``), those, the row and the next (``analysis_text``), one before and the row (``entry_text``), each corrected.
    Null texts are empty rows of the context and of no family.
    """
    fixed, text = tx.asr_correct, F.coalesce("text", F.lit(""))
    w = Window.partitionBy("file").orderBy("line")
    at = lambda k: F.lag(text, k).over(w) if k > 0 else F.lead(text, -k).over(w)
    # nulls, before the first and after the last row, are no texts
    x = lines.withColumn("family", tx.detect_signal(fixed(text), families, {f: f for f in families}))
    x = x.withColumns({"recent_text": F.concat_ws(" ", at(2), at(1)), "analysis_text": F.concat_ws(" ", at(2), at(1), text, at(-1)), "entry_text": F.concat_ws(" ", at(1), text), "first": F.row_number().over(w) == 1})
    found = rel.exclude_reviewed(x.filter("family is not null"), reviewed)
    found = rel.guard_neighbours(found, reviewed.filter("label <> 'NO_ACTION'"))
    found = found if covered is None else rel.exclude_covered(found, covered)
    # few rows are left before their texts are corrected
    kept = rel.first_by(found, ["family"], ["file", "line"], most)
    kept = kept.withColumns({c: fixed(F.col(c)) for c in ("recent_text", "analysis_text", "entry_text")}).withColumn("recent_text", F.when(~F.col("first"), F.col("recent_text")))
    position, last = hinted_side(F.col("analysis_text"), *hints)
    kept = kept.withColumns({"label": F.lit("NO_ACTION"), "position_side": position, "last_side": last})
    texts = [F.col(c) for c in ("recent_text", "analysis_text", "entry_text")]
    prompt = context_prompt(F.lit(symbol), F.col("position_side"), F.col("last_side"), *texts, fixed(text), F.col("text"))
    return kept.withColumn("prompt", prompt).drop("rn", "first")
