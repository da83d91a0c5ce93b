"""Risk checks, protective prices, quantities and positions as Column expressions and one window program."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from livetext.operators.folds import ordered_fold

ENTRIES = ("ENTER_LONG", "ENTER_SHORT", "ADD")
MANAGEMENT = ("TRIM", "EXIT_ALL", "MOVE_STOP", "MOVE_TO_BREAKEVEN")
#: Limits of the risk checks and brackets.
LIMITS = {
    "stale_ms": 5000, "min_confidence": 0.74, "max_signal_age_ms": 20000, "max_distance_points": 12.0, "max_chase_points": 8.0,
    "max_contracts": 4, "stop_points": 120.0, "target_points": 240.0, "tick": 0.25,
}


def risk_gate(x: dict[str, Column], limits: dict = LIMITS) -> Column:
    """The reason of the first failing check, or "Approved.".

    ``x`` holds tag, age_ms, stale_after_ms, confidence, latency_ms, guard, last (market price), held (contracts, null without a
    position), held_stop, entry, stop and size (contracts of an order).
    """
    entry, add = x["tag"].isin(*ENTRIES), x["tag"] == "ADD"
    age = x["age_ms"] + F.greatest(F.lit(0), x["latency_ms"])
    distance = F.abs(F.coalesce(F.when(x["entry"] != 0, x["entry"]), x["last"]) - x["last"])
    held = F.coalesce(x["held"], F.lit(0))
    checks = [
        (x["age_ms"] > F.least(x["stale_after_ms"], F.lit(limits["stale_ms"])), F.lit("Intent is stale.")),
        (x["confidence"] < limits["min_confidence"], F.lit("Confidence below threshold.")),
        (entry & (age > limits["max_signal_age_ms"]), F.concat(F.lit("Entry signal too old ("), age.cast("long").cast("string"), F.lit(" ms)."))),
        (entry & (F.coalesce(x["guard"], F.lit("")) != ""), F.concat(F.lit("Entry blocked by context guard: "), x["guard"], F.lit("."))),
        (entry & x["last"].isNull(), F.lit("No market price available.")),
        (entry & ~add & x["held"].isNotNull(), F.lit("Position already open.")),
        (entry & x["stop"].isNull() & x["held_stop"].isNull(), F.lit("Stop price is required for entries.")),
        (entry & (distance > min(limits["max_distance_points"], limits["max_chase_points"])), F.lit("Entry too far from current market.")),
        (entry & (held + x["size"] > limits["max_contracts"]), F.lit("Position would exceed max contract size.")),
        (x["tag"].isin(*MANAGEMENT) & x["held"].isNull(), F.lit("No open position to manage.")),
        (entry & (held > limits["max_contracts"]), F.lit("Position size already exceeds cap.")),
    ]
    return reduce(lambda w, c: w.when(*c), checks[1:], F.when(*checks[0])).otherwise("Approved.")


def wide_brackets(tag: Column, side: Column, entry: Column, last: Column, held_side: Column, average: Column, limits: dict = LIMITS) -> Column:
    """(stop, target) of an entry at fixed offsets from its reference: entry price, market, or the position's average."""
    known = F.coalesce(side, F.when(tag == "ENTER_LONG", "LONG").when(tag == "ENTER_SHORT", "SHORT").when(tag == "ADD", held_side))
    sign = F.when(tag.isin(*ENTRIES), F.when(known == "LONG", 1).when(known == "SHORT", -1))
    ref = F.coalesce(entry, last, average)
    stop = max(1.0, limits["stop_points"])
    return F.struct((ref - stop * sign).alias("stop"), (ref + max(stop, limits["target_points"]) * sign).alias("target"))


def to_tick(price: Column, tick: float, up: Column) -> Column:
    return F.when(up, F.ceil(price / tick)).otherwise(F.floor(price / tick)) * tick


def protective_prices(side: Column, entry: Column, stop: Column, target: Column, last: Column, bid: Column, ask: Column, limits: dict = LIMITS) -> Column:
    """(stop, target) of an entry, where missing ones are set from a reference: the entry price, or the quote's side (the ask
    first for a buy, the bid first for a sale). The offset is the wide stop, or forty ticks if these are more."""
    tick = limits["tick"]
    long, positive = side == "LONG", lambda c: F.when(c > 0, c)
    ref = F.coalesce(positive(entry), F.when(long, F.coalesce(*map(positive, (ask, last, bid)))).otherwise(F.coalesce(*map(positive, (bid, last, ask)))))
    away = max(limits["stop_points"], 40 * tick)
    made_stop = to_tick(F.when(long, ref - away).otherwise(ref + away), tick, ~long)
    made_target = to_tick(F.when(long, ref + max(limits["target_points"], away)).otherwise(ref - max(limits["target_points"], away)), tick, long)
    return F.struct(F.coalesce(positive(stop), made_stop).alias("stop"), F.coalesce(positive(target), made_target).alias("target"))


def reseat(side: Column, price: Column, average: Column, market: Column, is_stop: bool, tick: float = LIMITS["tick"]) -> Column:
    """A stop or target on a tick; within two ticks of the market or beyond, it moves away by its distance from the average
    price, forty ticks at least."""
    long = side == "LONG"
    below = long if is_stop else ~long  # the price stands below the market
    away = F.greatest(F.abs(price - average), F.lit(40 * tick))
    crossed = F.when(below, price >= market - 2 * tick).otherwise(price <= market + 2 * tick)
    return to_tick(F.when(crossed, F.when(below, market - away).otherwise(market + away)).otherwise(price), tick, ~below)


def trim_quantity(hint: Column, held: Column) -> Column:
    """Contracts of a trim: all, half, most, a number word or a number; one where nothing says (all of one)."""
    h = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    at_least = lambda n: F.greatest(F.lit(1), n)
    words = {"one": F.lit(1), "two": F.least(F.lit(2), held), "three": F.least(F.lit(3), held), "all": held, "half": at_least(F.floor(held / 2)), "most": at_least(held - 1)}
    number = F.when(h.rlike(r"^[+-]?[0-9]{1,9}$"), h.cast("long"))
    said = reduce(lambda w, k: w.when(h == k, words[k]), list(words)[1:], F.when(h == "one", words["one"]))
    said = said.when(number.isNotNull(), F.when(number <= 0, 0).otherwise(F.least(number, held))).otherwise(F.least(F.lit(1), held))
    return F.when(held <= 0, 0).otherwise(said).cast("long")


def expand_manual(action: Column, position: Column) -> Column:
    """(tag, side) steps of BUY, SELL or CLOSE for a position (LONG, SHORT or null): a reversal is an exit and an entry, more
    of the held side an ADD."""
    step = lambda tag, side: F.struct(F.lit(tag).alias("tag"), side.alias("side"))
    exit_ = step("EXIT_ALL", position)

    def order(side):
        enter = step(f"ENTER_{side}", F.lit(side))
        return F.when(position.isNull(), F.array(enter)).when(position == side, F.array(step("ADD", F.lit(side)))).otherwise(F.array(exit_, enter))

    return F.when(action == "CLOSE", F.array(exit_)).when(action == "BUY", order("LONG")).otherwise(order("SHORT"))


def route(account: list[Column], symbol: Column, override: Column, market_symbol: Column, configured: Column) -> Column:
    """(account, symbol) of an order: the first account given; a given symbol, the override, a market symbol that is a contract,
    or the configured one. Blank texts are none."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    contract = F.when(F.trim(market_symbol).rlike(r"\s\d{2}-\d{2}$"), F.trim(market_symbol))
    return F.struct(F.coalesce(*map(some, account)).alias("account"), F.coalesce(some(symbol), some(override), contract, some(configured)).alias("symbol"))


def position_ledger(commands: DataFrame, key: str, order: str) -> DataFrame:
    """Side, contracts, average price, stop and ``ok`` after each of (kind, side, qty, price, stop): kinds ENTER, ADD, TRIM, EXIT,
    STOP and BREAKEVEN; all but ENTER need a position, ENTER needs none. A command without contracts, or of another kind or none, is rejected.

    A position lives from an ENTER to the row that closes it, so a session is folded island by island: the rows from
    one ENTER to the next EXIT. An island is read in batches, so a position that is never closed may have any number of commands.
    """
    w = Window.partitionBy(key).orderBy(order)
    # an EXIT leaves no position whatever came before: the rows up to it are an island
    closed = F.coalesce(F.sum((F.col("kind") == "EXIT").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = [F.col("qty").cast("int").alias("qty"), F.col("price").cast("double").alias("price"), F.col("stop").cast("double").alias("stop")]
    x = commands.select(key, closed.alias("island"), F.col(order).cast("long").alias("o"), "kind", "side", *numbers)
    out = "o long, now_side string, now_qty int, avg double, now_stop double, ok boolean"
    found = ordered_fold(x, [key, "island"], ["o"], ["kind", "side", "qty", "price", "stop"], _after_command, out)
    return found.select(key, F.col("o").alias(order), F.col("now_side").alias("side"), F.col("now_qty").alias("qty"), F.col("avg").alias("avg_price"), F.col("now_stop").alias("stop"), "ok")


def _after_command(held: tuple | None, x) -> tuple[tuple, tuple]:
    """The position (side, contracts, average, stop) after a command, and its row of the ledger."""
    side, qty, avg, stop = held or ("FLAT", 0, 0.0, None)
    opens, grows = x.kind == "ENTER", x.kind in ("ENTER", "ADD")
    known = x.kind in ("ENTER", "ADD", "TRIM", "EXIT", "STOP", "BREAKEVEN")
    sized = x.kind not in ("ENTER", "ADD", "TRIM") or (x.qty or 0) > 0
    ok = known and sized and opens == (qty == 0)
    if ok:
        side = x.side if opens else side
        more = x.qty if grows else -min(x.qty, qty) if x.kind == "TRIM" else -qty if x.kind == "EXIT" else 0
        if x.kind == "BREAKEVEN":
            stop = avg
        elif x.kind in ("STOP", "ENTER") or (x.kind == "ADD" and x.stop is not None):
            stop = x.stop
        if grows:
            avg = (avg * qty + (avg if x.price is None else x.price) * more) / (qty + more)
        qty += more
    if qty == 0:
        side, avg, stop = "FLAT", 0.0, None
    return (side, qty, avg, stop), (x.o, side, qty, avg, stop, ok)
