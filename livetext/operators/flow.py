"""The spoken intent cascade as data: flags of rules by Catalyst, then a fold over flags only.

1. ``readings``: the rules of a lexicon are matched by column expressions on a row's own text, on the text stitched with the row before
   (analysis) and on the text stitched only where a thought goes on (entry). What a row says is packed into the
   bits of one number, with the few sides, sizes and prices that a step may need.
2. ``advance``: a session's rows are folded in order. ``STEPS`` is the cascade's order: the first step whose bits are set decides, and
   the position after row n is a bit of row n + 1. State: the position, the last side, times of the last exit, management
   and other instrument, the last intent (for repeats) and the open candidate window (for intents said in pieces).

A window's text is that of up to five rows in a row that end here; its flags are computed with the row's, so the fold
matches no text. It opens with a score of ``OPEN`` or more, goes on while rows of ``KEEP`` or more come within ``WINDOW`` seconds, and
closes at an intent. Rows inside it that score nothing are part of its text.

``interpret`` runs the fold on tables: sessions are dealt out, sorted and read in batches, so no session is held as a whole.
``livetext.streaming.flow`` runs the same fold on streams.

A null or blank text says nothing and leaves no trace. A null session is a session. Rows of one time go by their id. Null prices and
markets leave prices out. Repeated rows are read each; the second says what the first did, so it is a repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import reduce
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from livetext.functions import phrases as ph
from livetext.functions import text as tx
from livetext.functions.prices import resolve_price
from livetext.operators.ordered import CONTINUES, UNFINISHED

#: Seconds that state holds.
STITCH, WINDOW, LEAD, REPEAT, ENTRY_REPEAT, GUARD, INSTRUMENT = 4.0, 6.0, 2.4, 2.5, 8.0, 20.0, 30.0
#: A session that is silent for longer (seconds) starts anew.
IDLE = 43_200.0
#: Scores that open a window and keep it open, and rows of its text.
OPEN, KEEP, FRAGMENTS = 0.43, 0.28, 5

Lexicon = dict[str, list[str]]


def lexicon(own: list[str] = (), foreign: list[str] = (), **changes: list[str]) -> Lexicon:
    """Rule groups of the cascade. ``own`` and ``foreign`` are patterns of the session's instrument and of others; ``commentary``,
    ``automatic_commentary``, ``entry_commentary``, ``exit_commentary`` and ``retrospective`` are empty unless given."""
    groups = {
        "seed": ph.SEEDS,
        "direct_long": ph.DIRECT_LONG,
        "direct_short": ph.DIRECT_SHORT,
        "in_long": [ph.LEAD_IN + r"in this long\b", r"\bin this long\b(?!\s+(?:term|period|time))"],
        "in_short": [ph.LEAD_IN + r"in this short\b", r"\bin this short\b(?!\s+(?:term|period|time))"],
        "not_my_position": ph.NOT_MY_POSITION,
        "long_here": [r"\blong here\b"],
        "short_here": [r"\bshort here\b"],
        "bare_long": [ph.LEAD_IN + r"long here\b", r"\blong here\b.*" + ph.BARE_CONTEXT],
        "bare_short": [ph.LEAD_IN + r"short here\b", r"\bshort here\b.*" + ph.BARE_CONTEXT],
        "long": [r"\blong\b"],
        "short": [r"\bshort\b"],
        "long_versus": [r"\blong versus\b"],
        "short_versus": [r"\bshort versus\b"],
        "up": [r"\bup to\b"],
        "down": [r"\bdown to\b"],
        "cancel": ["cancel that", "scratch that"],
        "exit": ph.EXITS,
        "conditional_exit": ph.CONDITIONAL_EXITS,
        "breakeven": ph.BREAKEVENS,
        "trim": ph.TRIMS,
        "runner": ph.RUNNERS,
        "trim_command": ph.TRIM_COMMANDS,
        "no_trim_command": ph.NOT_TRIM_COMMANDS,
        "advised_trim": ph.ADVISED_TRIMS,
        "advised_long": ph.ADVISED_LONG,
        "advised_short": ph.ADVISED_SHORT,
        "move_stop": ph.STOP_MOVES,
        "risk_word": ["versus", "reclaim"],
        "heavy": ["stay heavy"],
        "add": ph.ADDS,
        "tentative_add": ph.TENTATIVE_ADDS,
        "setup_long": ph.SETUP_LONG,
        "setup_short": ph.SETUP_SHORT,
        "candidate_seed": ph.CANDIDATE_SEEDS,
        "candidate_continues": ph.CANDIDATE_CONTINUES,
        "follow_up": [*ph.FOLLOW_UPS, *ph.SEEDS],
        "no_follow_up": ph.NO_FOLLOW_UPS,
        "hedge": ["maybe", "could"],
        "trade_word": [],
        "risk_price": [*ph.RISK_PRICES, *ph.STOP_PRICES],
        "cut_price": ph.CUT_STOPS,
        "target_price": ph.TARGET_PRICES,
        "entry_price": ph.ENTRY_PRICES,
        "own": list(own),
        "foreign": list(foreign),
        "commentary": [],
        "automatic_commentary": [],
        "entry_commentary": [],
        "exit_commentary": [],
        "retrospective": [],
    }
    unknown = changes.keys() - groups.keys()
    if unknown:
        raise KeyError(f"no such rule groups: {sorted(unknown)}")
    return groups | changes


# --- flags ----------------------------------------------------------------------------------------------------

#: What a row says, a bit each; the last ones are set by the fold.
FLAGS = (
    "own foreign candidate commentary own_commentary trigger_text cancel exit_commentary conditional_exit conditional_price risk exit cut breakeven "
    "trim_command advised_trim advised_long advised_short trim most add entry_trigger stop_price entry_risk setup_long setup_short follow_up hedge "
    "retrospective goes_on held override away"
).split()
BIT = {name: 1 << k for k, name in enumerate(FLAGS)}
PRICES = "conditional_stop cut_stop stop target entry entry_stop entry_target stitched_entry".split()


def groups_of(lex: Lexicon) -> Lexicon:
    """The lexicon's groups and those that follow from them."""
    out = dict(lex)
    for s in ("long", "short"):
        out[f"strong_{s}"] = [p for p in lex[f"direct_{s}"] if p not in lex[f"{s}_here"]]
    out["unfinished"] = UNFINISHED
    out["talk"] = [p for g in ("trade_word", "long", "short", "exit", "trim", "breakeven", "candidate_seed", "seed", "risk_word") for p in lex[g]]
    out["small"] = ["feeler", r"\b(?:little|small)\s+(?:piece|peace)\b"]
    return out


_SIDES = "strong_long strong_short in_long in_short not_my_position long_here short_here bare_long bare_short seed long short entry_commentary unfinished"
#: The groups that are matched on a row's own text, on the analysis text and on the entry text.
_ON = {
    "text": f"{_SIDES} commentary automatic_commentary long_versus short_versus direct_long direct_short cancel setup_long setup_short follow_up no_follow_up hedge retrospective candidate_seed candidate_continues small",
    "analysis": "own foreign talk commentary automatic_commentary entry_commentary exit_commentary conditional_exit risk_word heavy move_stop advised_trim advised_long advised_short setup_long setup_short candidate_seed",
    "entry_text": f"{_SIDES} up down exit breakeven trim runner trim_command no_trim_command add tentative_add risk_word move_stop candidate_seed small",
}
#: The prices: the text each is looked for in, and its group.
_PRICED = {
    "conditional_stop": ("analysis", "risk_price"),
    "cut_stop": ("entry_text", "cut_price"),
    "stop": ("text", "risk_price"),
    "target": ("text", "target_price"),
    "entry": ("text", "entry_price"),
    "entry_stop": ("entry_text", "risk_price"),
    "entry_target": ("entry_text", "target_price"),
    "stitched_entry": ("entry_text", "entry_price"),
}


def _suffix_safe(pattern: str) -> bool:
    """Whether a text that ends in a blank and a text that matches also matches: nothing in the pattern asks what stands before. A row's
    beginning is a blank there, so a beginning or a blank will do."""
    plain = pattern.replace("(?:^|[ .])", "").replace("[^", "[")
    return not any(x in plain for x in ("^", r"\A", r"\G", r"\B", "(?<"))


def _where(texts: Column, patterns: list[str]) -> Column:
    """For texts that each end in the one before: bit k is set if the k-th of them matches. Most texts aren't matched: a match of the
    first is one of all, and without a match of the last there is none."""
    if not patterns:
        return F.lit(0)
    n, pattern = F.size(texts), tx.group_pattern(patterns)
    hit = lambda k: F.coalesce(F.get(texts, k).rlike(pattern), F.lit(False))
    if not all(map(_suffix_safe, patterns)):
        return reduce(lambda p, q: p + q, [F.when((n >= k) & hit(F.lit(k - 1)), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(1, FRAGMENTS + 1)])
    since = lambda k: F.lit(sum(1 << j for j in range(k, FRAGMENTS + 1)))
    out = F.when(hit(F.lit(0)), since(1)).when((n <= 1) | ~hit(n - 1), F.lit(0))
    for k in range(2, FRAGMENTS):
        out = out.when(n == k, since(k)).when(hit(F.lit(k - 1)), since(k))
    return out.otherwise(since(FRAGMENTS))


def _first(*steps: tuple[Column, str]) -> Column:
    return reduce(lambda c, s: c.when(*s), steps[1:], F.when(*steps[0]))


def entry_side(h: Column, target: Column | None = None, market: Column | None = None) -> Column:
    """The side of an entry by a text's hits: a direct phrase, a position in context, a bare side with context, or a seed with a side
    or a target above or below the market; none in commentary or an unfinished thought."""
    context = {s: h[f"in_{s}"] & ~h["not_my_position"] for s in ("long", "short")}
    bare = {s: h[f"{s}_here"] & (h[f"bare_{s}"] | h["seed"]) for s in ("long", "short")}
    steps = [(h["strong_long"], "LONG"), (h["strong_short"], "SHORT"), (context["long"], "LONG"), (context["short"], "SHORT"), (bare["long"], "LONG"), (bare["short"], "SHORT")]
    steps += [(h["seed"] & h["long"], "LONG"), (h["seed"] & h["short"], "SHORT")]
    if target is not None:
        steps += [(h["seed"] & h["up"] & F.coalesce(target > market, F.lit(False)), "LONG"), (h["seed"] & h["down"] & F.coalesce(target < market, F.lit(False)), "SHORT")]
    return F.when(~h["entry_commentary"] & ~h["unfinished"], _first(*steps))


def entry_trigger(h: Column) -> Column:
    return ~h["entry_commentary"] & ~h["unfinished"] & (entry_side(h).isNotNull() | h["seed"])


def text_side(h: Column) -> Column:
    """The side that a text names as its own; none in commentary."""
    return F.when(~h["entry_commentary"], _first((h["long_versus"], "LONG"), (h["short_versus"], "SHORT"), (h["direct_long"], "LONG"), (h["direct_short"], "SHORT")))


def _flags(v: Column, review: bool, market: Column) -> Column:
    """What a reading says: its bits, sides, sizes and prices, from its hits and prices."""
    t, a, e, price = v["text_hits"], v["analysis_hits"], v["entry_text_hits"], {n: v["prices"][k] for k, n in enumerate(PRICES)}
    trade = lambda h: h["commentary"] if review else h["commentary"] | h["automatic_commentary"]
    advised = F.lit(review)
    trigger = entry_trigger(e)
    acts = e["exit"] | e["breakeven"] | e["trim"] | e["add"] | trigger
    scores = [(acts, 0.96), (a["setup_long"] | a["setup_short"], 0.74), (e["candidate_seed"] | t["candidate_seed"], 0.58), (t["candidate_continues"] & a["candidate_seed"], 0.48)]
    said = {
        "own": a["own"],
        "foreign": a["foreign"],
        "candidate": a["talk"],
        "commentary": trade(a) | a["entry_commentary"],
        "own_commentary": trade(t) | t["entry_commentary"],
        "trigger_text": entry_trigger(t),
        "cancel": t["cancel"],
        "exit_commentary": a["exit_commentary"],
        "conditional_exit": a["conditional_exit"],
        "conditional_price": price["conditional_stop"].isNotNull(),
        "risk": a["risk_word"] | a["heavy"] | a["move_stop"],
        "exit": e["exit"],
        "cut": price["cut_stop"].isNotNull(),
        "breakeven": e["breakeven"],
        "trim_command": e["trim_command"] & ~e["no_trim_command"],
        "advised_trim": advised & a["advised_trim"],
        "advised_long": advised & a["advised_long"],
        "advised_short": advised & a["advised_short"],
        "trim": e["trim"] | e["runner"],
        "most": v["entry_said"]["most"] | e["runner"],
        "add": e["add"] & ~e["tentative_add"],
        "entry_trigger": trigger,
        "stop_price": price["stop"].isNotNull(),
        "entry_risk": e["risk_word"] | e["move_stop"],
        "setup_long": t["setup_long"],
        "setup_short": t["setup_short"],
        "follow_up": t["follow_up"] & ~t["no_follow_up"],
        "hedge": t["hedge"],
        "retrospective": t["retrospective"],
        "goes_on": t["candidate_continues"],
    }
    size = lambda h, said: F.when(h["small"] | h["seed"], "one").otherwise(said["quantity"])
    return F.struct(
        v["k"].alias("k"),
        reduce(lambda p, q: p + q, [F.when(c, F.lit(BIT[n])).otherwise(F.lit(0)).cast("long") for n, c in said.items()]).alias("bits"),
        text_side(t).alias("text_side"),
        entry_side(e, price["entry_target"], market).alias("entry_side"),
        F.when(e["long"] & ~e["short"], "LONG").when(e["short"] & ~e["long"], "SHORT").alias("hint_side"),
        v["entry_said"]["quantity"].alias("quantity"),
        size(e, v["entry_said"]).alias("size"),
        size(t, v["said"]).alias("text_size"),
        _first(*[(c, F.lit(p)) for c, p in scores]).otherwise(F.lit(0.0)).alias("score"),
        *[price[n].alias(n) for n in PRICES],
    )


# --- rows before ----------------------------------------------------------------------------------------------


def chained(rows: DataFrame, key: str, at: str, id_col: str, text: str) -> DataFrame:
    """``rows`` with ``before``: the texts and times of up to four rows that lead here without a gap over ``WINDOW``, latest first."""
    w = Window.partitionBy(key).orderBy(at, id_col)
    past = [F.struct(F.lag(text, k).over(w).alias("text"), F.lag(F.col(at).cast("double"), k).over(w).alias("at")) for k in range(1, FRAGMENTS)]
    x = rows.withColumn("before", F.array(*past))
    now = F.col(at).cast("double")
    ok = [F.coalesce((now if k == 0 else F.col("before")[k - 1]["at"]) - F.col("before")[k]["at"] <= WINDOW, F.lit(False)) for k in range(FRAGMENTS - 1)]
    n = reduce(lambda tail, c: F.when(c, 1 + tail).otherwise(0), reversed(ok), F.lit(0))
    return x.withColumn("before", F.slice("before", F.lit(1), n))


#: Flags without which a joined text can say nothing.
SAYS = sum(BIT[n] for n in "cancel conditional_exit exit cut breakeven trim_command advised_trim advised_long advised_short trim add entry_trigger stop_price setup_long setup_short".split())


def readings(rows: DataFrame, lex: Lexicon, at: str, text: str, market: str, review: bool = False, windows: bool = True, resolve=resolve_price) -> DataFrame:
    """``rows`` (see ``chained``) with ``readings``: the row's own (``k`` = 1: its text and the texts stitched with the row before) and, for
    ``k`` up to five, those of the last ``k`` rows' text that say something. Texts and rows before are dropped.

    A reading of the row and the row before is one of the last two rows' text, and all of these texts end in the row's own. So each rule is
    matched once for all of them (see ``_where``), and prices and sizes are read once from each.
    """
    groups = groups_of(lex)
    before, own, last = F.col("before"), F.col(text), F.get(F.col("before"), F.lit(0))
    near = F.coalesce(F.col(at).cast("double") - last["at"] <= STITCH, F.lit(False))
    open_ = F.coalesce(own.rlike(tx.group_pattern(CONTINUES)) | last["text"].rlike(tx.group_pattern(UNFINISHED)), F.lit(False))
    joined = lambda k: F.trim(F.array_join(F.concat(F.reverse(F.transform(F.slice(before, F.lit(1), k - 1), lambda b: b["text"])), F.array(own)), " "))
    n = F.size(before) + 1 if windows else F.when(near, 2).otherwise(1)
    texts = F.transform(F.sequence(F.lit(1), n), joined)
    priced = sorted({g for _, g in _PRICED.values()})
    names = sorted({g for on in _ON.values() for g in on.split()})
    alone = set() if windows else set(_ON["text"].split()) - set(f"{_ON['analysis']} {_ON['entry_text']}".split())

    def parts(t):
        raws = [F.array(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in groups[g]]) if groups[g] else F.array().cast("array<string>") for g in priced]
        return F.struct(F.array(*raws).alias("raws"), tx.quantity_hint(t).alias("quantity"), t.contains("most my size").alias("most"))

    def worth(t):
        first = lambda raws: F.get(F.filter(F.transform(F.filter(raws, lambda r: r.isNotNull()), lambda r: resolve(r, F.col(market)).cast("double")), lambda x: x.isNotNull()), F.lit(0))
        return F.struct(F.transform(t["raws"], first).alias("prices"), t["quantity"].alias("quantity"), t["most"].alias("most"))

    def matched(ts):
        where = F.struct(*[_where(F.slice(ts, 1, 1) if g in alone else ts, groups[g]).alias(g) for g in names])
        return F.struct(where.alias("where"), F.transform(F.transform(ts, parts), worth).alias("said"), near.alias("near"), (near & open_).alias("joins"))

    def variants(m):
        which = lambda k: F.struct(k.alias("text"), F.when((k == 1) & m["near"], 2).otherwise(k).alias("analysis"), F.when((k == 1) & m["joins"], 2).otherwise(k).alias("entry_text"))
        numbers = F.sequence(F.lit(1), F.size(m["said"]) if windows else F.lit(1))
        return F.transform(F.transform(numbers, which), lambda w: variant(m, w))

    def variant(m, w):
        bit = {source: F.get(F.array(*[F.lit(1 << k) for k in range(1, FRAGMENTS + 1)]), w[source] - 1) for source in _ON}
        said = {source: F.get(m["said"], w[source] - 1) for source in _ON}
        hits = [F.struct(*[(m["where"][g].bitwiseAND(bit[source]) != 0).alias(g) for g in on.split()]).alias(f"{source}_hits") for source, on in _ON.items()]
        prices = F.array(*[F.get(said[source]["prices"], F.lit(priced.index(g))) for source, g in _PRICED.values()])
        return F.struct(w["text"].alias("k"), said["text"].alias("said"), said["entry_text"].alias("entry_said"), prices.alias("prices"), *hits)

    of = F.transform(F.transform(F.array(texts), matched), variants)
    said = F.transform(F.get(of, F.lit(0)), lambda v: _flags(v, review, F.col(market)))
    found = F.filter(said, lambda r: (r["k"] == 1) | (r["bits"].bitwiseAND(F.lit(SAYS)) != 0))
    return rows.select(*[c for c in rows.columns if c not in ("before", text)], found.alias("readings"))


# --- the fold -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """One step of the cascade: flags that must be set (``!`` in front: not set), and what it says. Without a tag it ends the cascade with nothing."""

    name: str
    when: str
    tag: str | None = None
    side: str = ""
    entry: str = ""
    stop: str = ""
    target: str = ""
    size: str = ""
    marks: str = ""
    guarded: bool = False
    turns: bool = False
    mask: int = field(init=False, default=0)
    value: int = field(init=False, default=0)

    def __post_init__(self):
        names = self.when.split()
        object.__setattr__(self, "mask", sum(BIT[n.lstrip("!")] for n in names))
        object.__setattr__(self, "value", sum(BIT[n] for n in names if n[0] != "!"))


_HELD_OR_SAID, _ENTRY = "held text last", dict(tag="ENTER", guarded=True, turns=True)
_TRIM_AT = "target entry market"
#: The cascade in its order. Sides and prices name their sources, the first that is known counts.
STEPS = [
    Step("other instrument", "away candidate"),
    Step("commentary", "commentary !override"),
    Step("cancel", "cancel", "CANCEL_SETUP", "text"),
    Step("exit commentary", "exit_commentary"),
    Step("conditional exit with a price", "conditional_exit conditional_price held risk", "MOVE_STOP", "held", stop="conditional_stop", marks="management"),
    Step("conditional exit", "conditional_exit"),
    Step("exit", "exit", "EXIT_ALL", _HELD_OR_SAID, size="all", marks="exit"),
    Step("cut at a price", "cut", "MOVE_STOP", _HELD_OR_SAID, stop="cut_stop", marks="management"),
    Step("breakeven", "breakeven", "MOVE_TO_BREAKEVEN", _HELD_OR_SAID, marks="management"),
    Step("trim command", "trim_command held", "TRIM", "held", target=_TRIM_AT, size="some", marks="management"),
    Step("advised trim", "advised_trim", "TRIM", _HELD_OR_SAID, target=_TRIM_AT, size="some", marks="management"),
    Step("advised long", "advised_long", side="LONG", entry="entry market", stop="stop", target="target", size="text_size", **_ENTRY),
    Step("advised short", "advised_short", side="SHORT", entry="entry market", stop="stop", target="target", size="text_size", **_ENTRY),
    Step("most of it", "trim most", "TRIM", _HELD_OR_SAID, target=_TRIM_AT, size="most", marks="management"),
    Step("trim", "trim", "TRIM", _HELD_OR_SAID, target=_TRIM_AT, size="quantity", marks="management"),
    Step("add", "add held", "ADD", "held", entry="stitched_entry market", stop="entry_stop held_stop", size="quantity", turns=True),
    Step("entry", "entry_trigger", side="entry text last setup", entry="stitched_entry market", stop="entry_stop", target="entry_target", size="size", **_ENTRY),
    Step("add without a position", "add !held", side="entry text last setup", entry="stitched_entry market", stop="entry_stop", target="entry_target", size="size", **_ENTRY),
    Step("stop move", "stop_price held entry_risk", "MOVE_STOP", "held", stop="stop", marks="management"),
    Step("long setup", "setup_long", "SETUP_LONG", "LONG"),
    Step("short setup", "setup_short", "SETUP_SHORT", "SHORT"),
]
ENTRIES, SETUPS = ("ENTER_LONG", "ENTER_SHORT", "ADD"), ("SETUP_LONG", "SETUP_SHORT")


@dataclass
class Flow:
    """A session's state between two rows. Times are seconds; None is nothing."""

    position: str | None = None
    average: float | None = None
    stop: float | None = None
    last_side: str | None = None
    management_at: float | None = None
    exit_at: float | None = None
    away_at: float | None = None
    tag: str | None = None
    side: str | None = None
    said_at: float | None = None
    prices: tuple = (None, None, None)
    window_at: float | None = None
    window_tag: str | None = None
    window_side: str | None = None
    window_rows: int = 0
    recent: tuple = ()
    seen_at: float | None = None


def _within(at: float | None, now: float, most: float) -> bool:
    return at is not None and now - at <= most


def _same(a: float | None, b: float | None) -> bool:
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 0.01


@dataclass(slots=True)
class Intent:
    tag: str
    side: str | None
    entry: float | None
    stop: float | None
    target: float | None
    size: str | None
    guard: str | None
    score: float


def _score(tag: str, prices: tuple, guard: str | None, hedged: bool) -> float:
    score = tx.BASE_SCORES.get(tag, 0.7)
    if not tag.startswith(("SETUP", "CANCEL")):
        score += sum(x for x, p in zip((0.03, 0.05, 0.02), prices, strict=True) if p is not None) - 0.15 * hedged - 0.08 * (guard is not None)
    return max(0.0, min(0.99, round(score, 3)))


def read(row, now: float, market: float | None, flow: Flow) -> Intent | None:
    """What a reading says after ``flow``, which it changes."""
    if flow.position:
        flow.last_side = flow.position
    bits = row.bits
    if bits & BIT["own"]:
        flow.away_at = None
    elif bits & BIT["foreign"]:
        flow.away_at = now
    setup = flow.window_side if _within(flow.window_at, now, WINDOW) and flow.window_tag in SETUPS else None
    bits |= BIT["held"] * bool(flow.position) | BIT["away"] * _within(flow.away_at, now, INSTRUMENT)
    bits |= BIT["override"] * bool(setup and bits & BIT["trigger_text"] and not bits & BIT["own_commentary"])
    # a side that the text names is remembered from here on, unless the cascade has ended
    for number, step in enumerate(STEPS):
        if number == 2 and row.text_side:
            flow.last_side = row.text_side
        if bits & step.mask == step.value:
            break
    else:
        return None
    if not step.tag:
        return None
    known = {"held": flow.position, "text": row.text_side, "last": flow.last_side, "entry": row.entry_side, "setup": setup, "LONG": "LONG", "SHORT": "SHORT"}
    side = next((known[s] for s in step.side.split() if known[s]), None)
    if step.tag == "ENTER" and side is None:
        return None
    if step.turns:
        flow.last_side = side
    if step.marks == "management":
        flow.management_at = now
    elif step.marks == "exit":
        flow.exit_at = now
    worth = lambda sources: next((p for s in sources.split() if (p := {"market": market, "held_stop": flow.stop}.get(s) if s in ("market", "held_stop") else getattr(row, s)) is not None), None)
    prices = worth(step.entry), worth(step.stop), worth(step.target)
    tag = step.tag if step.tag != "ENTER" else "ADD" if flow.position == side else f"ENTER_{side}"
    guard = None
    if step.guarded:
        guard = "recent management cue detected" if _within(flow.management_at, now, GUARD) else "recent exit cue detected" if _within(flow.exit_at, now, GUARD) else None
    size = {"": None}.get(step.size, step.size if step.size in ("all", "some", "most") else getattr(row, step.size, None))
    alike = side == flow.side and all(map(_same, prices, flow.prices))
    if alike and (_within(flow.said_at, now, REPEAT) and tag == flow.tag or _within(flow.said_at, now, ENTRY_REPEAT) and tag in ENTRIES and flow.tag in ENTRIES and bits & BIT["follow_up"]):
        return None
    flow.tag, flow.side, flow.said_at, flow.prices = tag, side, now, prices
    return Intent(tag, side, *prices, size, guard, _score(tag, prices, guard, bool(bits & BIT["hedge"])))


def _track(row, now: float, intent: Intent | None, flow: Flow) -> None:
    """Open, extend or close the candidate window."""
    active = _within(flow.window_at, now, WINDOW)
    flow.recent = tuple(t for t in flow.recent if now - t <= LEAD)
    if not active:
        flow.window_at = flow.window_tag = flow.window_side = None
        flow.window_rows = 0
    if intent and intent.tag not in SETUPS:
        flow.window_at = flow.window_tag = flow.window_side = None
        flow.window_rows, flow.recent = 0, ()
        return
    score = max(row.score, 0.74 if intent else 0.0)
    if not score and active and row.bits & BIT["goes_on"]:
        score = KEEP
    if score >= (KEEP if active else OPEN):
        if not active:
            lead = flow.recent
            if flow.tag not in SETUPS and _within(flow.said_at, now, ENTRY_REPEAT):
                lead = tuple(t for t in lead if t > flow.said_at)
            flow.window_rows = len(lead)
        flow.window_at = now
        if intent:
            flow.window_tag, flow.window_side = intent.tag, intent.side
        elif row.bits & (BIT["setup_long"] | BIT["setup_short"]) and row.score <= 0.74:
            flow.window_tag = "SETUP_LONG" if row.bits & BIT["setup_long"] else "SETUP_SHORT"
            flow.window_side = flow.window_tag.removeprefix("SETUP_")
        elif row.hint_side:
            flow.window_side = row.hint_side
    if flow.window_at is not None:
        flow.window_rows = min(flow.window_rows + 1, FRAGMENTS)
    flow.recent = (*flow.recent, now)[-(FRAGMENTS - 1) :]


def advance(flow: Flow, row, feedback: bool = True, windows: bool = True) -> tuple[Intent | None, bool]:
    """(intent, recovered) of one row after ``flow``, which it changes. With ``feedback`` an intent sets the position; without, each
    row brings its own (position, position_stop)."""
    now, market = float(row.at), row.market
    own, *joined = [SimpleNamespace(**(r if isinstance(r, dict) else r.asDict())) for r in row.readings]
    if flow.seen_at is not None and now - flow.seen_at > IDLE:
        vars(flow).update(vars(Flow()))
    flow.seen_at = now
    if not feedback:
        flow.position, flow.stop = row.position or None, row.position_stop
    intent, recovered = read(own, now, market, flow), False
    if windows:
        _track(own, now, intent, flow)
        if (intent is None or intent.tag in SETUPS) and _within(flow.window_at, now, WINDOW) and flow.window_rows >= 2:
            whole = next((r for r in joined if r.k == flow.window_rows), None)
            found = read(whole, now, market, flow) if whole is not None else None
            if found and found.tag not in (*SETUPS, "CANCEL_SETUP") and not (found.tag in ENTRIES and whole.bits & BIT["retrospective"]):
                intent, recovered = found, True
                flow.window_at = flow.window_tag = flow.window_side = None
                flow.window_rows, flow.recent = 0, ()
    if feedback and intent:
        if intent.tag in ("ENTER_LONG", "ENTER_SHORT") or intent.tag == "ADD" and not flow.position:
            flow.position, flow.stop = intent.side, intent.stop
            flow.average = intent.entry if intent.entry is not None else market or 0.0
        elif intent.tag == "EXIT_ALL":
            flow.position = flow.stop = flow.average = None
        elif intent.tag == "MOVE_STOP" and flow.position and intent.stop is not None:
            flow.stop = intent.stop
        elif intent.tag == "MOVE_TO_BREAKEVEN" and flow.position:
            flow.stop = flow.average
    return intent, recovered


OUT = "tag string, side string, entry double, stop double, target double, size string, guard string, score double, recovered boolean, before string, after string"


def said(flow: Flow, row, feedback: bool = True, windows: bool = True) -> tuple:
    """``advance`` as a row of ``OUT``: the intent, if any, and the position before and after it."""
    fresh = flow.seen_at is None or float(row.at) - flow.seen_at > IDLE
    before = ((None if fresh else flow.position) if feedback else row.position) or "FLAT"
    intent, recovered = advance(flow, row, feedback, windows)
    parts = [getattr(intent, f.name) for f in fields(Intent)] if intent else [None] * 8
    return (*parts, recovered, before, flow.position or "FLAT")


def plain_rows(pdf: pd.DataFrame) -> list:
    """Rows of a batch with None for what is null."""
    plain = {c: [None if x is None or isinstance(x, float) and math.isnan(x) else x for x in pdf[c].astype(object)] for c in pdf.columns}
    return [SimpleNamespace(**dict(zip(plain, r, strict=True))) for r in zip(*plain.values(), strict=True)]


def interpret(rows: DataFrame, lex: Lexicon, key: str, at: str, id_col: str, text: str, market: str = "market", review: bool = False, windows: bool = True, position: str | None = None, position_stop: str | None = None, resolve=resolve_price) -> DataFrame:
    """(key, id, ``OUT``) for each row with a text: what it says, after all that its session said before.

    ``text`` is normalised. With ``position`` (and its stop) each row brings the position of its time; else intents make it.
    Sessions are dealt out and sorted; a task folds its sessions row by row and holds one batch.
    """
    spoken = rows.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    keep = [F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(at).cast("double").alias("at"), F.trim(text).alias("said"), F.col(market).cast("double").alias("market")]
    keep += [(F.col(c) if c else F.lit(None).cast(t)).alias(n) for c, n, t in ((position, "position", "string"), (position_stop, "position_stop", "double"))]
    x = spoken.select(*keep)
    if windows:
        x = chained(x, "key", "at", "id", "said")
    else:
        w = Window.partitionBy("key").orderBy("at", "id")
        one = F.struct(F.lag("said").over(w).alias("text"), F.lag("at").over(w).alias("at"))
        x = x.withColumn("before", F.when(one["at"].isNotNull(), F.array(one)).otherwise(F.array().cast("array<struct<text:string,at:double>>")))
    found = readings(x, lex, "at", "said", "market", review, windows, resolve)
    kinds = dict(rows.select(F.col(key).alias("key"), F.col(id_col).alias("id")).dtypes)
    columns = [key, id_col, *[c.split()[0] for c in OUT.split(", ")]]
    feedback = position is None

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flow, session = Flow(), None
        for pdf in batches:
            out = []
            for row in plain_rows(pdf):
                if session != (row.key,):
                    flow, session = Flow(), (row.key,)
                out.append((row.key, row.id, *said(flow, row, feedback, windows)))
            yield pd.DataFrame(out, columns=columns)

    ordered = found.repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(fold, f"`{key}` {kinds['key']}, `{id_col}` {kinds['id']}, {OUT}")
