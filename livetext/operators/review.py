"""Review of annotated candidates by ordered rules, and the repair of training examples with its report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from livetext.functions import text as tx
from livetext.operators import ordered as od

# Results depend on these patterns.
PATTERNS = {
    "first_person_entry": [
        r"\blet'?s put one of these on\b",
        r"\bsmall piece on\b",
        r"\bsmall (?:long|short) now\b",
        r"\bput(?:ting)? (?:a |one of these |something |a little )?piece on\b",
        r"\bput something on\b",
        r"\bput a little piece on here just in case\b",
        r"\bfeeler on (?:short|long)\b",
        r"\bback on again\b",
        r"\b(?:i'?m|im) in (?:a |this )?(?:short|long)\b",
        r"\b(?:i'?m|im) (?:short|long)(?: again)? now\b",
        r"\bstick this back on here again\b",
        r"\bback in this now (?:short|long) side\b",
        r"\b(?:short|long) versus this\b",
        r"\bputting a little piece on\b",
    ],
    "setup_short": [
        r"\bwe(?:'re| are)? looking to sell\b",
        r"\blooking to sell\b",
        r"\blooking for (?:a |this )?short\b",
        r"\bwatching\b.*\bsell into\b",
        r"\bwatching\b",
        r"\bcan look for this short\b",
        r"\bfade this market\b",
        r"\bsell pops\b",
        r"\bpop to sell\b",
        r"\blook for the same trade again\b",
    ],
    "setup_long": [
        r"\bwe(?:'re| are)? looking to buy\b",
        r"\blooking to buy\b",
        r"\blooking for (?:a |this )?long\b",
        r"\bwatching\b.*\bbuy into\b",
        r"\bbuy dips\b",
        r"\bpullback to buy\b",
    ],
    "future_add": [
        r"\b(?:i'?ll|i will)\b.*\badd\b",
        r"\b(?:i'?m|im) going to add\b",
        r"\blooking for .*add\b",
        r"\blook for an ad\b",
        r"\btry and add on pops\b",
        r"\bif .* add\b",
    ],
    "explicit_add": [
        r"\bgot my ad on\b",
        r"\bpopped one back on\b",
        r"\badded back into this\b",
        r"\badded back in on this\b",
        r"\badd back on here\b",
    ],
    "first_person_trim": [
        r"\bpay yourself\b",
        r"\bpay(?:ing)? myself\b",
        r"\btrim(?:ming)?\b",
        r"\blittle piece off\b",
        r"\btake a partial\b",
        r"\btake partial\b",
        r"\bcover(?:ing)? some\b",
        r"\bpeel(?:ing)?\b",
    ],
    "second_person_trim": [
        r"\bso you can pay yourself\b",
        r"\byou should be paying yourself\b",
        r"\byou can pay yourself\b",
    ],
    "explicit_exit": [
        r"\bi(?:'| )?m out\b",
        r"\bout of that\b",
        r"\bout of this now\b",
        r"\bout here\b",
        r"\bout completely\b",
        r"\bflat now\b",
        r"\bout\.\s*done\.\s*finished\b",
        r"\bout\s+done\s+finished\b",
    ],
    "exit_target": [
        r"\bi(?:'| )?ll cut the rest\b",
        r"\bcut the rest into\b",
    ],
    "stop_move": [
        r"\bmove my stop\b",
        r"\bstop tighter\b",
        r"\bstops? break even\b",
        r"\bbreak even stop\b",
        r"\brisk(?:ing)? up to\b",
    ],
    "other_instrument": [
        r"\bunh\b",
        r"\bnvda\b",
        r"\bnvidia\b",
    ],
    "ambiguous_action": ["reselling here"],
}
# End of the fixed values.

ENTRIES, SETUPS = ("ENTER_LONG", "ENTER_SHORT"), ("SETUP_LONG", "SETUP_SHORT")
STOPS = ("MOVE_STOP", "MOVE_TO_BREAKEVEN")
OTHERS = ("TARGET", "CANCEL_SETUP", "COMMENTARY")
LABELS = (*ENTRIES, *SETUPS, *STOPS, *OTHERS, "ADD", "TRIM", "EXIT_ALL", "NO_ACTION")


@dataclass(frozen=True)
class Rule:
    """A candidate with one of ``labels`` whose text hits ``group`` (None: any text) gets ``status`` and ``note``, and a corrected one
    the label ``to``. ``sided`` asks for a side too."""

    labels: tuple[str, ...]
    group: str | None
    status: str
    note: str
    to: str | None = None
    sided: bool = False


#: The review in order: the first rule that holds decides.
RULES = [
    Rule(LABELS, "other_instrument", "rejected", "other instrument"),
    Rule(SETUPS, None, "accepted", "auto setup"),
    Rule((*ENTRIES, "ADD"), "setup_short", "corrected", "auto setup short", to="SETUP_SHORT"),
    Rule((*ENTRIES, "ADD"), "setup_long", "corrected", "auto setup long", to="SETUP_LONG"),
    Rule(ENTRIES, "explicit_add", "corrected", "explicit add", to="ADD"),
    Rule(("ADD",), "future_add", "rejected", "future or conditional add"),
    Rule(("ADD",), "explicit_add", "accepted", "explicit add"),
    Rule(ENTRIES, "first_person_entry", "accepted", "explicit entry"),
    Rule(ENTRIES, "ambiguous_action", "rejected", "ambiguous market action"),
    Rule(("TRIM",), "second_person_trim", "rejected", "second person advice"),
    Rule(("TRIM",), "first_person_trim", "accepted", "explicit trim"),
    Rule(("EXIT_ALL",), "exit_target", "rejected", "future exit target"),
    Rule(("EXIT_ALL",), "explicit_exit", "accepted", "explicit exit"),
    Rule(STOPS, "stop_move", "accepted", "explicit stop move"),
    Rule(("NO_ACTION",), None, "accepted", "already no action"),
    Rule(OTHERS, "first_person_entry", "accepted", "explicit side action", sided=True),
]


def review_text(*texts: Column) -> Column:
    """Texts in a row as the rules read them: lower case, only letters a to z, digits and apostrophes."""
    x = F.replace(F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])), F.lit("vwop"), F.lit("vwap"))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s']", " "), r"\s+", " "))


def known_side(side: Column) -> Column:
    token = F.upper(F.trim(side))
    return F.when(token.isin("LONG", "BUY"), "LONG").when(token.isin("SHORT", "SELL"), "SHORT")


def auto_review(rows: DataFrame, text: str = "current_text", evidence: str = "evidence_text", patterns: dict = PATTERNS, rules: list[Rule] = RULES) -> DataFrame:
    """``rows`` of (label, side, status, both texts) with ``status``, ``reviewed_label``, ``reviewed_side`` and ``note`` by the rules.

    Accepted rows keep label and side, rejected ones are NO_ACTION without a side, corrected ones get the rule's label, and its side
    or else their own. Rows that were reviewed before keep their status, and so do rows that no rule hits or whose label
    is null or unknown; their other results are the columns of these names if there are any, or null. Null texts are empty.
    """
    groups = sorted({r.group for r in rules if r.group})
    read = rows.withColumn("_read", review_text(F.col(text), F.col(evidence)))
    # each group is matched once, whatever rules ask for it
    hits = F.struct(*[(F.col("_read").rlike(tx.group_pattern(patterns[g])) if patterns[g] else F.lit(False)).alias(g) for g in groups])
    read = read.withColumn("_hits", hits)

    def holds(r: Rule) -> Column:
        x = F.col("label").isin(*r.labels)
        x = x & F.col(f"_hits.{r.group}") if r.group else x
        return x & known_side(F.col("side")).isNotNull() if r.sided else x

    number = reduce(lambda a, kr: a.when(holds(kr[1]), F.lit(kr[0])), list(enumerate(rules)), F.when(F.lit(False), F.lit(None)))
    open_ = F.coalesce(~F.col("status").isin("accepted", "corrected", "rejected"), F.lit(True))
    read = read.withColumn("_rule", F.when(open_, number))
    of = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("_rule"))
    did = F.col("_rule").isNotNull()
    status, to, was = of([r.status for r in rules]), of([r.to for r in rules]), lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    label = F.when(status == "rejected", "NO_ACTION").when(status == "corrected", to).otherwise(F.col("label"))
    side = F.when(status == "corrected", F.when(to.endswith("_LONG"), "LONG").when(to.endswith("_SHORT"), "SHORT").otherwise(known_side(F.col("side"))))
    side = side.when(status == "accepted", F.col("side"))
    made = {
        "reviewed_label": F.when(did, label).otherwise(was("reviewed_label")),
        "reviewed_side": F.when(did, side).otherwise(was("reviewed_side")),
        "note": F.when(did, of([r.note for r in rules])).otherwise(was("note")),
        "status": F.coalesce(status, F.col("status"), F.lit("pending")),
    }
    return read.withColumns(made).drop("_read", "_hits", "_rule")


# --- repair of training examples -------------------------------------------------------------------------------------

HELD = ("TRIM", "EXIT_ALL", *STOPS)
ACTIONS = (*ENTRIES, *HELD)


def rebuilt_prompt(prompt: Column, symbol: Column, position: Column, last_side: Column) -> Column:
    """A prompt with its symbol, position and last side set, its own texts kept and all other lines, such as prices, gone."""
    head = [F.concat(F.lit(f"{n}="), c) for n, c in (("symbol", symbol), ("position", position), ("last_side", last_side))]
    kept = [F.nullif(F.regexp_extract(prompt, f"(?md)^({n}=.*)$", 1), F.lit("")) for n in ("recent", "analysis", "current")]
    return F.concat_ws("\n", *head, *kept)


def cleanup_examples(rows: DataFrame, advice: Column, reach: int = 3, symbol: str = "MNQ 03-26") -> DataFrame:
    """Examples (id, file, line, label, position_side, original_side, last_side, prompt, symbol) repaired, with what is wrong with them.

    - ``position_side`` of a management label that stands FLAT becomes the original side, or else the last one (``repaired``)
    - ``prompt`` is written anew from that (``rebuilt`` where it changed)
    - ``flag_reason``: a repeat, that is an action at most ``reach`` lines after the last kept example if that is of its file and label;
      else a management label that is still FLAT; else, for actions, what ``advice`` names (empty or null: nothing); null for clean rows

    Examples are in the order of file, line and id. Null sides are no side, a null last side is "NONE", a null position FLAT.
    """
    side = F.coalesce("position_side", F.lit("FLAT"))
    valid = lambda c: F.when(F.col(c).isin("LONG", "SHORT"), F.col(c))
    held, acts = F.coalesce(F.col("label").isin(*HELD), F.lit(False)), F.coalesce(F.col("label").isin(*ACTIONS), F.lit(False))
    other = F.coalesce(valid("original_side"), valid("last_side"))
    x = rows.withColumn("repaired", held & (side == "FLAT") & other.isNotNull())
    x = x.withColumn("position_side", F.when(F.col("repaired"), other).otherwise(side)).withColumn("_was", F.col("prompt"))
    x = x.withColumn("prompt", rebuilt_prompt(F.coalesce("prompt", F.lit("")), F.coalesce("symbol", F.lit(symbol)), F.col("position_side"), F.coalesce("last_side", F.lit("NONE"))))
    x = x.withColumn("rebuilt", ~F.col("_was").eqNullSafe(F.col("prompt"))).drop("_was")
    # an example of another label ends a run, so only within a run can one repeat the last kept one
    w = Window.partitionBy("file").orderBy("line", "id")
    new = (~F.lag("label").over(w).eqNullSafe(F.col("label"))).cast("int")
    x = x.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    kept = od.greedy_keep(x.filter(acts).select("file", "_run", "line", "id"), ["file", "_run"], "line", "id", reach)
    x = x.join(kept.select("id", F.lit(True).alias("_kept")).hint("merge"), "id", "left")
    flat = held & (F.col("position_side") == "FLAT")
    why = (
        F.when(acts & F.col("_kept").isNull(), f"duplicate_same_action_within_{reach}_lines")
        .when(flat, F.concat("label", F.lit("_while_FLAT")))
        .when(acts & (F.coalesce(advice, F.lit("")) != ""), F.concat(F.lit("advice_pattern: "), advice))
    )
    return x.withColumn("flag_reason", why).drop("_run", "_kept")


def cleanup_report(cleaned: DataFrame) -> DataFrame:
    """(measure, name, n) of a repair: its totals (name is empty), and the rows by label, clean and flagged, and by reason."""
    reason = F.col("flag_reason")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    totals = {
        "input_examples": F.lit(1).cast("long"),
        "position_side_repaired": one(F.col("repaired")),
        "prompts_rebuilt": one(F.col("rebuilt")),
        "duplicates_removed": one(reason.startswith("duplicate_")),
        "impossible_state_flagged": one(reason.endswith("_while_FLAT")),
        "advice_pattern_flagged": one(reason.startswith("advice_pattern")),
        "output_clean": one(reason.isNull()),
        "output_flagged": one(reason.isNotNull()),
    }
    label = F.coalesce("label", F.lit(""))
    # every row names what it counts for, so one pass and one shuffle of small rows make the whole report
    says = [F.struct(F.lit(m).alias("measure"), F.lit("").alias("name"), n.alias("n")) for m, n in totals.items()]
    says.append(F.struct(F.when(reason.isNull(), "clean_label").otherwise("flagged_label").alias("measure"), label.alias("name"), F.lit(1).cast("long").alias("n")))
    says.append(F.struct(F.lit("flag_reason").alias("measure"), F.coalesce(reason, F.lit("")).alias("name"), one(reason.isNotNull()).alias("n")))
    told = cleaned.select(F.explode(F.array(*says)).alias("s")).select("s.*")
    counts = told.groupBy("measure", "name").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") > 0) | F.col("measure").isin(*totals))
