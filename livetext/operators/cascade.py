"""Intent cascade, candidate windows, gates and curation compositions on ordered transcript rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from livetext.functions import prices
from livetext.functions import text as tx
from livetext.operators import ordered as od
from livetext.operators import relational as rel


def position_effect(tag: Column) -> Column:
    """The side that a tag leaves behind; null where it changes nothing."""
    return F.when(tag == "ENTER_LONG", "LONG").when(tag == "ENTER_SHORT", "SHORT").when(tag == "EXIT_ALL", "FLAT")


def settle_tag(tag: Column, position: Column) -> Column:
    """An entry on the held side is an ADD; management without a position is no intent."""
    return F.when(tag.isin("TRIM", "MOVE_STOP", "EXIT_ALL") & (position == "FLAT"), F.lit(None)).when(tag == F.concat(F.lit("ENTER_"), position), "ADD").otherwise(tag)


def parse_intent(rows: DataFrame, text: Column, groups: dict, tags: dict, key: str, order: str) -> DataFrame:
    """``tag`` and ``position``: the first rule group that hits, read against the position that earlier rows left."""
    tagged = rows.withColumn("tag", tx.detect_signal(text, groups, tags))
    held = od.session_state(tagged, key, [order], position_effect(F.col("tag")), "position")
    return held.withColumn("tag", settle_tag(F.col("tag"), F.col("position")))


def safety_override(tag: Column, side: Column, position: Column, trim_words: Column, hard_exit: Column) -> Column:
    """An exit that only trims is a TRIM; an ADD without a position is an entry on its side; other management then drops."""
    softened = F.when((tag == "EXIT_ALL") & trim_words & ~hard_exit, "TRIM").otherwise(tag)
    entered = F.when((softened == "ADD") & (position == "FLAT"), F.concat(F.lit("ENTER_"), side)).otherwise(softened)
    return F.when(entered.isin("TRIM", "MOVE_STOP", "EXIT_ALL") & (position == "FLAT"), F.lit(None)).otherwise(entered)


def extract_price(text: Column, patterns: list[str], market: Column) -> Column:
    """The first pattern, in order, whose first group resolves to a price."""
    return F.coalesce(*[prices.resolve_price(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), market) for p in patterns])


def entry_side(text: Column, strong: dict[str, str], seed: str, target: Column, market: Column) -> Column:
    """A strong phrase decides; a seed alone takes its side from a target above or below the market."""
    hits = {side: text.rlike(p) for side, p in strong.items()}
    clear = reduce(lambda a, s: a.when(hits[s] & ~reduce(lambda x, y: x | y, [h for o, h in hits.items() if o != s]), s), hits, F.when(F.lit(False), F.lit(None)))
    return F.coalesce(clear, F.when(text.rlike(seed) & (target > market), "LONG").when(text.rlike(seed) & (target < market), "SHORT"))


def candidate_windows(rows: DataFrame, key: str, at: str, id_col: str, score: Column, fragment: Column, gap: int, start: float = 0.43, keep: float = 0.28, last: int = 5, before: int = 0) -> DataFrame:
    """(key, window, start, end, n, text): a row of ``start`` or more opens a window that rows of ``keep`` or more extend
    while they come at most ``gap`` after the one before.

    Rows below ``keep`` change no window, so windows are the runs of the other rows without a longer gap, each from its
    first opener on: two window functions, no state to fold. The text holds the ``last`` fragments, of
    which the first may come from any rows up to ``before`` earlier than the window's first row.
    """
    w = Window.partitionBy(key).orderBy(at, id_col)
    scored = rows.withColumn("score", score).withColumn("fragment", fragment)
    # times in a range frame: rows of one time are no lead to each other
    ahead = Window.partitionBy(key).orderBy(F.col(at).cast("long")).rangeBetween(-before, -1)
    lead = F.transform(F.array_sort(F.collect_list(F.struct(at, id_col, "fragment")).over(ahead)), lambda x: x["fragment"]) if before else F.array().cast("array<string>")
    kept = scored.withColumn("lead", F.slice(lead, F.greatest(F.size(lead) - last + 1, F.lit(1)), F.lit(last))).filter(F.col("score") >= keep)
    run = kept.withColumn("new", F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("long"))
    run = run.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(key, "run").orderBy(at, id_col)
    open_ = run.withColumn("opened", F.max((F.col("score") >= start).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0))).filter("opened = 1")
    tail = open_.withColumn("back", F.row_number().over(Window.partitionBy(key, "run").orderBy(F.desc(at), F.desc(id_col))))
    # at most ``last`` rows of a window reach the list
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("back") <= last, F.struct(at, id_col, "fragment")))), lambda x: x["fragment"])
    both = F.concat(F.min_by("lead", F.struct(at, id_col)), own)
    text = F.array_join(F.slice(both, F.greatest(F.size(both) - last + 1, F.lit(1)), F.lit(last)), " ")
    return tail.groupBy(key, "run").agg(F.min(id_col).alias("window"), F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), text.alias("text")).drop("run")


def recover_windows(rows: DataFrame, text: str, groups: dict, tags: dict, key: str, order: str, size: int = 5) -> DataFrame:
    """Rows that say nothing by themselves, with the tag of the open window's text: this row and up to ``size`` - 1 before it.

    A window closes where a row is an action or a window was recovered, and starts anew with the next row; NO_ACTION text recovers
    nothing. Rows up to an action are folded by themselves, so no session is one array.
    """
    quiet = ("NO_ACTION", "SETUP")
    own = tx.detect_signal(F.col(text), groups, tags)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    acts = F.coalesce(~F.col("own").isin(*quiet), F.lit(False)).cast("int")
    isles = rows.withColumn("own", own).withColumn("isle", F.coalesce(F.sum(acts).over(w), F.lit(0)))
    lists = isles.groupBy(key, "isle").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(text).alias("x"), F.col("own").isNull().alias("open")))).alias("s"))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("parts"), F.array().cast("array<struct<o:long,tag:string>>").alias("out"))

    def step(acc, x):
        parts = F.concat(F.slice(acc["parts"], F.greatest(F.size(acc["parts"]) - size + 2, F.lit(1)), F.lit(size - 1)), F.array(x["x"]))
        tag = F.when(x["open"], tx.detect_signal(F.array_join(parts, " "), groups, tags))
        hit = F.coalesce(~tag.isin(*quiet), F.lit(False))
        return F.struct(F.when(hit, empty).otherwise(parts).alias("parts"), F.when(hit, F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), tag.alias("tag"))))).otherwise(acc["out"]).alias("out"))

    return lists.select(key, F.explode(F.aggregate("s", start, step)["out"]).alias("r")).select(key, F.col("r.o").alias(order), "r.tag")


def segment_utterances(frames: DataFrame, key: str, at: str, id_col: str, voiced: Column, silence: int, longest: int, least: int) -> DataFrame:
    """(key, start, end, n) of utterances: voiced frames up to a silence or the greatest length, with ``least`` frames or more."""
    w = Window.partitionBy(key).orderBy(at, id_col)
    x = frames.filter(voiced).select(key, at, id_col)
    x = x.withColumn("new", F.coalesce(F.col(at) - F.lag(at).over(w) >= silence, F.lit(True)).cast("long")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = od.greedy_keep(x, [key, "run"], at, id_col, longest).withColumn("begins", F.lit(1))
    inside = Window.partitionBy(key, "run").orderBy(at, id_col).rowsBetween(Window.unboundedPreceding, 0)
    cut = x.join(starts.hint("merge"), [key, "run", id_col], "left").withColumn("part", F.sum("begins").over(inside))
    return cut.groupBy(key, "run", "part").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).filter(F.col("n") >= least).select(key, "start", "end", "n")


def classifier_gate(rows: DataFrame, block: float = 0.84) -> DataFrame:
    """``decision`` of rows with tag, strong, p (of the tag), p_none, guess, p_guess and threshold: support keeps, a strong
    rule keeps, a likely "no action" blocks, an agreeing guess is promoted where nothing was parsed.

    ``final_confidence``: an intent that stays has the greater of its own confidence and the classifier's support (p); a promoted
    one has the guess's. A missing number counts as none.
    """
    tag, decided = F.col("tag"), F.col("tag").isNotNull()
    decision = (
        F.when(decided & (F.col("p") >= F.col("threshold")), "support")
        .when(decided & F.col("strong"), "rule")
        .when(decided & (F.col("p_none") >= block), "block")
        .when(decided, "keep")
        .when(F.col("p_guess") >= F.col("threshold"), "promote")
        .otherwise("none")
    )
    out = rows.withColumn("decision", decision)
    final = F.when(F.col("decision").isin("block", "none"), F.lit(None)).when(F.col("decision") == "promote", F.col("guess")).otherwise(tag)
    out = out.withColumn("final_tag", final)
    if "confidence" not in rows.columns:
        return out
    raised = F.when(F.col("decision") == "promote", F.col("p_guess")).otherwise(F.greatest("confidence", "p"))
    return out.withColumn("final_confidence", F.when(F.col("final_tag").isNotNull(), raised))


def confirmation_gate(intents: DataFrame, confirmations: DataFrame, key: str) -> DataFrame:
    """Entries pass if confirmed; after a system failure only a strong one with a stop, 0.9 confidence and no guard."""
    x = intents.join(confirmations.select(key, "status").hint("merge"), key, "left")
    fail_open = (F.col("status") == "failed") & F.col("strong") & F.col("stop").isNotNull() & (F.col("confidence") >= 0.9) & F.col("guard").isNull()
    passes = ~F.col("tag").startswith("ENTER_") | F.coalesce((F.col("status") == "confirmed") | fail_open, F.lit(False))
    return x.withColumn("passes", passes)


def auto_review(rows: DataFrame, text: Column, rules: list[tuple[str, str, str]], floor: float) -> DataFrame:
    """``status`` by the first (label, pattern, status) rule whose label and pattern hold; else accepted at ``floor`` confidence."""
    first = reduce(lambda a, r: a.when((F.col("label") == r[0]) & text.rlike(r[1]), r[2]), rules, F.when(F.lit(False), F.lit(None)))
    return rows.withColumn("status", F.coalesce(first, F.when(F.col("confidence") >= floor, "accepted"), F.lit("pending")))


def mine_hard_negatives(lines: DataFrame, text: Column, families: dict, positive: DataFrame, most: int = 40) -> DataFrame:
    """Lines of a family, away from positives and their neighbours, at most ``most`` a family in file order."""
    family = tx.detect_signal(text, families, {f: f for f in families})
    found = lines.withColumn("family", family).filter(F.col("family").isNotNull())
    free = rel.guard_neighbours(found, positive)
    return rel.first_by(free, ["family"], ["file", "line"], most).select("file", "line", "family")


def build_examples(lines: DataFrame, labels: DataFrame, text: Column, groups: dict, tags: dict) -> DataFrame:
    """(file, line, label, prompt): each line with its stitched text, the position before it and its label."""
    parsed = parse_intent(lines.withColumn("norm", text), F.col("norm"), groups, tags, "file", "line")
    stitched = od.stitch_context(parsed, F.col("norm"), "file", "line")
    prompt = tx.render_context(position=F.nullif("position", F.lit("FLAT")), analysis=F.col("analysis_text"), current=F.col("norm"))
    return rel.attach_labels(stitched, labels, ["file", "line"]).select("file", "line", F.coalesce("label", F.lit("NO_ACTION")).alias("label"), prompt.alias("prompt"))


def cleanup_examples(rows: DataFrame, advice: Column, reach: int = 3) -> DataFrame:
    """Rows of (id, file, line, label, side, last_side, text) repaired, freed of near repeats, and flagged.

    Management without a side takes the last side; without that it is impossible. A row at most ``reach`` lines after
    the last kept one of its file and label is a repeat.
    """
    managed = F.col("label").isin("TRIM", "EXIT_ALL", "MOVE_STOP")
    fixed = rows.withColumn("side", F.when(managed & (F.col("side") == "FLAT"), F.col("last_side")).otherwise(F.col("side")))
    kept = od.greedy_keep(fixed, ["file", "label"], "line", "id", reach).select("id")
    flag = F.when(managed & F.coalesce(F.col("side") == "FLAT", F.lit(True)), "impossible").when(advice, "advice")
    return fixed.join(kept.hint("merge"), "id", "left_semi").withColumn("flag", F.coalesce(flag, F.lit("clean")))


def remap_labels(rows: DataFrame, sides: list[str]) -> DataFrame:
    """Labels for execution: setups are no action, an ADD is an entry on the first side of ``sides`` that is LONG or SHORT, and
    ``dropped`` names why a row has no label."""
    valid = F.coalesce(*[F.when(F.col(c).isin("LONG", "SHORT"), F.col(c)) for c in sides])
    label = F.when(F.col("label").startswith("SETUP_"), "NO_ACTION").when(F.col("label") == "ADD", F.concat(F.lit("ENTER_"), valid)).otherwise(F.col("label"))
    return rows.withColumn("dropped", F.when((F.col("label") == "ADD") & valid.isNull(), "add_without_side")).withColumn("label", label)


def export_review(candidates: DataFrame, key: list[str], order: list, reviewed: Column, dropped: Column) -> tuple[DataFrame, DataFrame]:
    """The best candidate of each key with ``status`` (pending, reviewed, dropped), and the counts by label and status."""
    best = rel.first_by(candidates, key, order).drop("rn")
    done = best.withColumn("status", F.when(~reviewed, "pending").when(dropped, "dropped").otherwise("reviewed"))
    return done, done.groupBy("label", "status").agg(F.count("*").alias("n"))


def dataset_build(corpora: DataFrame, sides: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reviewed rows of several corpora (file, line, ordinal, row, label) as one dataset: labels remapped, rows without one
    dropped, later corpora first; and its counts by label and corpus."""
    rows = rel.merge_corpora(remap_labels(corpora, sides).filter("dropped is null").drop("dropped"))
    return rows, rows.groupBy("label", "ordinal").agg(F.count("*").alias("n"))


def windowed_utterances(frames: DataFrame, key: str, at: str, id_col: str, voiced: Column, size: int, needed: int, silence: int, longest: int, least: int) -> DataFrame:
    """(key, start, end, n) of utterances that open where ``needed`` of the last ``size`` frames are voiced, from the first of
    these on, and close after ``silence`` without a voiced frame or at the greatest length; n voiced frames, ``least`` or more.

    Where the last ``size`` frames are unvoiced and the silence is over, nothing is open: frames between such places are folded by
    themselves, and an opening never reaches back over one.
    """
    w = Window.partitionBy(key).orderBy(at, id_col)
    recent, past = w.rowsBetween(1 - size, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    x = frames.withColumn("v", voiced).withColumn("k", F.sum(F.col("v").cast("int")).over(recent)).withColumn("first", F.first(at).over(recent))
    heard = F.max(F.when(F.col("v"), F.col(at))).over(past)
    x = x.withColumn("dead", (F.col("k") == 0) & F.coalesce(F.col(at) - heard >= silence, F.lit(True)))
    x = x.withColumn("isle", F.sum(F.col("dead").cast("int")).over(past)).withColumn("bound", F.max(F.when(F.col("dead"), F.col(at))).over(past))
    begin = F.greatest(F.col("first"), F.coalesce("bound", "first"))
    fields = F.struct(F.col(at).cast("long").alias("t"), F.col(id_col).cast("long").alias("id"), "v", F.col("k").cast("long").alias("k"), begin.cast("long").alias("begin"))
    lists = x.filter(~F.col("dead")).groupBy(key, "isle").agg(F.array_sort(F.collect_list(fields)).alias("s"))
    none = F.lit(None).cast("long")
    start = F.struct(none.alias("begin"), F.lit(0).cast("long").alias("n"), none.alias("last"), none.alias("ended"), none.alias("now"), F.array().cast("array<struct<start:long,end:long,n:long>>").alias("out"))

    def step(a, f):
        idle = a["begin"].isNull()
        opens = idle & (f["k"] >= needed)
        begin = F.when(opens, F.greatest(f["begin"], F.coalesce(a["ended"], f["begin"]))).otherwise(a["begin"])
        n = F.when(opens, f["k"]).when(idle, 0).otherwise(a["n"] + f["v"].cast("long"))
        last = F.when(opens | f["v"], f["t"]).otherwise(a["last"])
        ends = ~idle & ((f["t"] - last >= silence) | (f["t"] - begin >= longest))
        made = F.struct(begin.alias("start"), f["t"].alias("end"), n.alias("n"))
        return F.struct(F.when(~ends, begin).alias("begin"), n.alias("n"), last.alias("last"), F.when(ends, f["t"]).otherwise(a["ended"]).alias("ended"), f["t"].alias("now"), F.when(ends, F.concat(a["out"], F.array(made))).otherwise(a["out"]).alias("out"))

    def finish(a):
        rest = F.struct(a["begin"].alias("start"), a["now"].alias("end"), a["n"].alias("n"))
        return F.when(a["begin"].isNotNull(), F.concat(a["out"], F.array(rest))).otherwise(a["out"])

    return lists.select(key, F.explode(F.aggregate("s", start, step, finish)).alias("u")).filter(F.col("u.n") >= least).select(key, "u.start", "u.end", "u.n")
