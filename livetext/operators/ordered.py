"""Operators on rows in session order: windows, and greedy folds over compact structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from livetext.operators.folds import ordered_fold


#: Beginnings that carry on the row before, and ends that leave a thought open.
CONTINUES = [
    r"^(?:and|or|but|so|then|because)\b",
    r"^(?:if|if you|if you re|if you are|if we|if they)\b",
    r"^(?:here|versus|at|from|through|under|over|stop)\b",
    r"^(?:this (?:long|short))\b",
    r"^(?:out|flat|done)\b",
    r"^(?:of this|of that|of it)\b",
    r"^(?:myself|some|more|off|partial|partials|profit)\b",
    r"^(?:a little|a piece)\b",
    r"^(?:break ?even|even|be)\b",
    r"^(?:my stop|to be|to break ?even)\b",
]
UNFINISHED = [
    r"\b(?:and|or|but|so|then|because)$",
    r"\b(?:if|if you|if you re|if you are|if we|if they)$",
    r"\b(?:i m|i am|we re|we are)$",
    r"\b(?:long|short)$",
    r"\b(?:in long|in short)$",
    r"\b(?:in this|in)$",
    r"\b(?:piece|peace)$",
    r"\b(?:all|fully)$",
    r"\b(?:out of|out)$",
    r"\b(?:stopped|knocked)$",
    r"\b(?:cut|cutting|flatten|flattening)$",
    r"\b(?:taking|peeling|trimming|covering|selling|paying)$",
    r"\b(?:move|moving|moved)$",
    r"\b(?:my stop|stop|stops)$",
    r"\b(?:break)$",
]


def stitch_context(rows: DataFrame, text: Column, key: str, order: str, gap: Column = None, most: float = 4.0) -> DataFrame:
    """analysis_text: the row before and this one, if the gap allows; entry_text: so only where this one carries on or the one
    before is unfinished."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(text).over(w)
    joined = before.isNotNull() if gap is None else before.isNotNull() & (gap - F.lag(gap).over(w) <= most)
    any_of = lambda patterns: "|".join(f"(?:{p})" for p in patterns)
    both = F.trim(F.concat_ws(" ", before, text))
    open_ = text.rlike(any_of(CONTINUES)) | before.rlike(any_of(UNFINISHED))
    return rows.withColumn("analysis_text", F.when(joined, both).otherwise(text)).withColumn("entry_text", F.when(joined & open_, both).otherwise(text))


def context_window(rows: DataFrame, key: str, order: str, text: str, start: int, end: int, out: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(start, end)
    return rows.withColumn(out, F.array_join(F.collect_list(text).over(w), " | "))


def session_state(rows: DataFrame, key: str, order: list, effect: Column, out: str) -> DataFrame:
    """The last effect before each row; ``effect`` is null where a row changes nothing."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.last(effect, ignorenulls=True).over(w), F.lit("FLAT")))


def label_state(rows: DataFrame, key: str, order: list, tag: Column, side: Column, price: Column) -> DataFrame:
    """``position``, ``last_side`` and ``stop`` at each row from the labels before it.

    Entries with a side set the position at the price, an exit clears it; any side or setup sets the last side; a move to
    breakeven sets the stop at the position's price, an entry clears it. All are last values over windows.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(tag.endswith("_LONG"), "LONG").when(tag.endswith("_SHORT"), "SHORT")
    entered = F.when(tag.isin("ENTER_LONG", "ENTER_SHORT", "ADD"), F.coalesce(side, F.when(tag != "ADD", named)))
    effect = F.when(tag == "EXIT_ALL", F.struct(F.lit("FLAT").alias("side"), F.lit(None).cast("double").alias("price"))).when(entered.isNotNull(), F.struct(entered.alias("side"), price.alias("price")))
    turn = F.coalesce(F.when(tag.startswith("SETUP_"), named), side, entered)
    x = rows.withColumn("held", F.last(effect, ignorenulls=True).over(w)).withColumn("last_side", F.last(turn, ignorenulls=True).over(w))
    # a stop holds from a move to breakeven until the next effect
    move = F.when(effect.isNotNull(), F.struct(F.lit(None).cast("double").alias("stop"))).when((tag == "MOVE_TO_BREAKEVEN") & (F.col("held.side") != "FLAT"), F.struct(F.col("held.price").alias("stop")))
    x = x.withColumn("moved", move)
    out = x.withColumn("stop", F.last("moved", ignorenulls=True).over(w).getField("stop"))
    return out.withColumn("position", F.coalesce("held.side", F.lit("FLAT"))).drop("held", "moved")


def recent_cue(rows: DataFrame, key: str, order: list, cue: Column, seconds: str, within: int, out: str) -> DataFrame:
    """Whether a cue stood at most ``within`` seconds before each row (inclusive)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.col(seconds) - F.last(F.when(cue, F.col(seconds)), ignorenulls=True).over(w) <= within, F.lit(False)))


def greedy_keep(rows: DataFrame, keys: list[str], order: str, id_col: str, reach: int) -> DataFrame:
    """Rows more than ``reach`` after the last kept row of their key.

    Rows further apart than ``reach`` from the row before are kept whatever came earlier, so each such island is folded by itself:
    a hot key is dealt out by islands, and an island is read in batches. A row without an order is kept only as the first one.
    """
    w = Window.partitionBy(*keys).orderBy(order, id_col)
    new = F.coalesce(F.col(order) - F.lag(order).over(w) > reach, F.lit(True))
    isles = rows.withColumn("new", new.cast("int")).withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = isles.select(*keys, "isle", F.col(order).cast("long").alias("t"), F.col(id_col).cast("long").alias("n"))

    def step(last, row):
        take = last is None or (row.t is not None and row.t - last > reach)
        return (row.t, (row.n,)) if take else (last, None)

    return ordered_fold(x, [*keys, "isle"], ["t", "n"], [], step, "kept long").select(*keys, F.col("kept").alias(id_col))


def collapse_captions(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rolling captions: a text equal to the last kept one is dropped; one that extends it within a second replaces it."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("t"), F.col(text).alias("x")))).alias("s"))
    start = F.array().cast("array<struct<t:long,x:string>>")

    def step(acc, c):
        last = F.element_at(acc, -1)
        some = F.size(acc) > 0
        return F.when(some & (last["x"] == c["x"]), acc).when(some & (c["t"] <= last["t"] + 1) & F.startswith(c["x"], last["x"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["t"].alias("t"), c["x"].alias("x"))))).otherwise(F.concat(acc, F.array(c)))

    # an empty array has no last element: element_at needs null there
    safe = lambda acc, c: F.when(F.size(acc) == 0, F.array(c)).otherwise(step(acc, c))
    return lists.select(key, F.explode(F.aggregate("s", start, safe)).alias("c")).select(key, F.col("c.t").alias(order), F.col("c.x").alias(text))


def chunk_lines(rows: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk, line): chunk k holds lines k(size - overlap) to +size, of rows numbered from 1 by ``line``."""
    step = size - overlap
    n = Window.partitionBy(key)
    r = F.col("line") - 1
    last = F.greatest(F.lit(0), F.ceil((F.count("*").over(n) - overlap) / step) - 1)
    lo, hi = F.greatest(F.lit(0), F.floor((r - size) / step) + 1), F.floor(r / step)
    spread = rows.withColumn("last", last).withColumn("lo", lo).withColumn("hi", F.least(hi, F.col("last")))
    return spread.filter("lo <= hi").select(key, F.explode(F.sequence("lo", "hi")).alias("chunk"), "line")


def shrink_chunks(chunks: DataFrame, lines: DataFrame, key: str, text: str, most: int, least: int = 8) -> DataFrame:
    """Chunks without the last lines that take them over ``most`` characters; ``least`` lines stay."""
    sized = chunks.join(lines.select(key, "line", F.length(text).alias("c")).hint("merge"), [key, "line"])
    w = Window.partitionBy(key, "chunk").orderBy("line")
    run = sized.withColumn("n", F.row_number().over(w)).withColumn("chars", F.sum(F.col("c") + 1).over(w) - 1)
    return run.filter((F.col("n") <= least) | (F.col("chars") <= most)).select(key, "chunk", "line")


def cut_intervals(intervals: DataFrame, key: str, size: int) -> DataFrame:
    """(key, start, end) pieces of at most ``size`` lines of each interval, both ends included."""
    at = F.explode(F.sequence(F.col("start"), F.col("end"), F.lit(size).cast("long"))).alias("from")
    return intervals.select(key, "end", at).select(key, F.col("from").alias("start"), F.least(F.col("from") + size - 1, F.col("end")).alias("end"))


def select_best(rows: DataFrame, line: list[str], label: list[str], best: list) -> DataFrame:
    """The best row of each (line, label), and of these the best of each line."""
    from livetext.operators.relational import first_by

    return first_by(first_by(rows, [*line, *label], best).drop("rn"), line, best).drop("rn")


def materialize_session(patches: DataFrame, key: str, order: str, fields: dict[str, str]) -> DataFrame:
    """The state after patches (a map of text values, where a key with null clears and an absent key keeps).

    ``fields`` maps a field to "null" or "empty" (what clearing leaves), or "keep" (null keeps the value).
    """
    def last(name, rule):
        value = F.col("patch")[name]
        named = F.map_contains_key("patch", name) & (value.isNotNull() if rule == "keep" else F.lit(True))
        found = F.max_by(F.struct(value.alias("v")), F.when(named, F.col(order))).getField("v")
        return (F.when(F.max(named.cast("int")) == 1, F.coalesce(found, F.lit(""))) if rule == "empty" else found).alias(name)

    return patches.groupBy(key).agg(*[last(n, r) for n, r in fields.items()])


def merge_intervals(rows: DataFrame, key: str, start: Column, end: Column, gap: int) -> DataFrame:
    """Intervals merged where the gap to all before is at most ``gap``."""
    w = Window.partitionBy(key).orderBy("s", "e")
    x = rows.select(key, start.alias("s"), end.alias("e"))
    x = x.withColumn("new", F.coalesce(F.col("s") - F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap, F.lit(True)).cast("int"))
    x = x.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "island").agg(F.min("s").alias("start"), F.max("e").alias("end")).select(key, "start", "end")


def resample_series(rows: DataFrame, key: str, index: str, value: str, ratio: float) -> DataFrame:
    """Linear interpolation of a series numbered from 0 onto floor(n x ratio) points (one at least)."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    grid = n.select(key, "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.col("n") * ratio)) - 1)).alias("j"))
    at = grid.withColumn("x", F.col("j") / ratio).withColumn("i", F.least(F.floor("x"), F.col("n") - 1)).withColumn("i2", F.least(F.col("i") + 1, F.col("n") - 1))
    a, b = rows.select(key, F.col(index).alias("i"), F.col(value).alias("va")), rows.select(key, F.col(index).alias("i2"), F.col(value).alias("vb"))
    return at.join(a.hint("merge"), [key, "i"]).join(b.hint("merge"), [key, "i2"]).select(key, "j", F.round(F.col("va") + (F.col("vb") - F.col("va")) * (F.col("x") - F.col("i")), 6).alias(value))


def suppress_duplicates(intents: DataFrame, key: str, at: str, id_col: str, follow_up: Column, same: float = 2.5, entry: float = 8.0) -> DataFrame:
    """Intents (tag, side, entry, stop, target) that are no duplicates of the last kept one of their key: the same tag, side
    and prices within ``same`` seconds, or within ``entry`` seconds an entry after an entry of the same side and prices whose text
    is a ``follow_up``.

    A row further than ``entry`` seconds from the row before is kept whatever came earlier, so such islands are folded by
    themselves, in batches.
    """
    w = Window.partitionBy(key).orderBy(at, id_col)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > max(same, entry), F.lit(True)).cast("int")
    isles = intents.withColumn("follow", follow_up).withColumn("isle", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prices = ["entry", "stop", "target"]
    x = isles.select(key, "isle", F.col(at).cast("double").alias("t"), F.col(id_col).cast("long").alias("n"), "tag", "side", *[F.col(c).cast("double").alias(c) for c in prices], "follow")
    family = ("ENTER_LONG", "ENTER_SHORT", "ADD")

    def equal(a, b):
        return a == b or (a != a and b != b)  # no number equals no number

    def step(last, row):
        if last is not None and None not in (row.t, last.t) and all(equal(getattr(row, c), getattr(last, c)) for c in ["side", *prices]):
            age = row.t - last.t
            repeat = age <= same and row.tag is not None and row.tag == last.tag
            if repeat or (age <= entry and row.tag in family and last.tag in family and row.follow):
                return last, None
        return row, (row.n,)

    return ordered_fold(x, [key, "isle"], ["t", "n"], ["tag", "side", *prices, "follow"], step, "kept long").select(key, F.col("kept").alias(id_col))


def instrument_context(rows: DataFrame, key: str, order: list, seconds: str, foreign: Column, own: Column, within: int, out: str) -> DataFrame:
    """Whether the latest mention of an instrument, this row's included, is a foreign one at most ``within`` seconds ago."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = F.last(F.when(foreign, F.struct(F.col(seconds).alias("at"))).when(own, F.struct(F.lit(None).cast("long").alias("at"))), ignorenulls=True).over(w)
    return rows.withColumn(out, F.coalesce(F.col(seconds) - since["at"] <= within, F.lit(False)))
